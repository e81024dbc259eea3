"""Decisions fall by row: a third of the doc_ids null, a third repeated, equal rows, and columns with the operators' inner names."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadlens.llm import common, line_dedup, mixing, ngram_join, packing, quality
from tests.llm.test_corpus import SF, every_window, groups, lowered, sets

KINDS = "doc_id long, text string, source string, n_chars long, row long, gone string, h string, t long, tx long, comp long, cls long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, len(t or ""), 1, "g", "h", 2, 3, 4, 5) for d, t, s in rows], KINDS).repartition(4)


def ids(rnd, i):
    return [None, 7, 1000 + i][rnd.randrange(3)]


def texts(rnd, n):
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nt", "rs", "lk", "mp")]
    return [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(n)]


def edited(rnd, text):
    w = text.split(" ")
    w[rnd.randrange(len(w))] = "changed"
    return " ".join(w)


def test_one_of_every_group_stays(spark):
    rnd = random.Random(1)
    base = texts(rnd, 60)
    rows = [(ids(rnd, i), t, "a") for i, t in enumerate(base)]
    rows += [(ids(rnd, 100 + i), edited(rnd, t), "b") for i, t in enumerate(base[:20])]
    rows += [(None, base[0], "a")] * 3 + [(7, base[1], "a")] * 3 + [(None, None, "a"), (7, "", "a"), (7, None, None)]
    out = ngram_join.keep_one(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in KINDS.split(", ")]
    kept = [(r.doc_id, r.text) for r in out.collect()]
    every = sets([(i, t, s) for i, (_, t, s) in enumerate(rows)], 5)
    links = [(i, j) for i in every for j in every if i < j and every[i] and 100 * len(every[i] & every[j]) >= 80 * len(every[i] | every[j])]
    root = groups(list(every), links)
    want = {}
    for i, (d, t, _) in enumerate(rows):
        if every[i]:
            want.setdefault(root[i], []).append((d is None, d or 0))
    assert len([1 for _, t in kept if t and t.strip()]) == len(want) == 60
    assert len([1 for _, t in kept if not t]) == 3
    for i, (d, t, _) in enumerate(rows[:60]):
        assert any(t2 == t or (t2 and t2.count(" ") == 59 and sum(a != b for a, b in zip(t.split(" "), t2.split(" "))) <= 1) for _, t2 in kept)


def test_null_ids_link_groups(spark):
    """A row without an id joins others and never names their component."""
    rnd = random.Random(2)
    a, b, c = texts(rnd, 3)
    mid = edited(rnd, a)
    rows = [(5, a, "s"), (None, mid, "s"), (9, b, "s"), (None, b, "s"), (None, c, "s"), (None, c, "s"), (3, None, "s"), (None, "", "s")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.near_groups(frame(spark, rows)).collect())
    assert got == sorted([(5, 56, 5), (-1, 56, 5), (9, 56, 9), (-1, 56, 9), (-1, 56, -1), (-1, 56, -1), (3, 0, 3), (-1, 0, -1)])


def test_lines_go_by_row(spark):
    rnd = random.Random(3)
    base = texts(rnd, 40)
    rows = [(ids(rnd, i), "\n".join(rnd.sample(base, 3) + [f"own line of document number {'abcdefghij'[i % 10]}{'klmnop'[i // 10]} only"]), "a") for i in range(50)]
    rows += [(None, rows[0][1], "a")] * 2 + [(7, rows[1][1], "b")] * 2 + [(7, None, "a"), (None, "", "b"), (7, " \n ", "a"), (None, "lone line without an id", "a")]
    out = line_dedup.without_repeats(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in KINDS.split(", ")]
    left = out.collect()
    assert all(r.n_chars == len(r.text) for r in left if r.text and r.text.strip())
    lines = [re.sub(" +", " ", lowered(x)).strip() for r in left for x in (r.text or "").split("\n")]
    lines = [x for x in lines if x]
    feats = {x: every_window(x, line_dedup.WIDTH) for _, t, _ in rows for x in [y.strip() for y in lowered(t).split("\n")] if x}
    links = [(x, y) for x in feats for y in feats if x < y and 100 * len(feats[x] & feats[y]) >= 80 * len(feats[x] | feats[y])]
    root = groups(list(feats), links)
    assert sorted(root[x] for x in lines) == sorted(set(root.values()))  # one line of every group, none lost
    report = line_dedup.line_report(frame(spark, rows)).collect()
    assert len(report) == len(rows)
    assert sum(r.n_lines - r.n_removed for r in report) == len(lines)


def test_quality_by_row(spark):
    rnd = random.Random(4)
    base = texts(rnd, 30)
    rows = [(ids(rnd, i), t, "a") for i, t in enumerate(base)] + [(7, "short", "a"), (None, "short too", "a"), (7, None, "a"), (None, "", None)]
    notice = "this very common notice stands on each and every page of the host here and it is rather long"
    rows += [(ids(rnd, 500 + i), f"{notice}\n{edited(rnd, t)} {i}", "h") for i, t in enumerate(texts(rnd, 80))]
    rows += [(7, f"{notice}\nfew words", "h"), (None, f"{notice}\nwords so few", "h"), (None, f"{notice}\nfew words", "a")]
    out = quality.keep_good(frame(spark, rows), host="source")
    assert out.columns == [c.split()[0] for c in KINDS.split(", ")]
    kept = sorted(r.text for r in out.collect())
    good = [t for _, t, _ in rows[:30]] + [t for _, t, _ in rows[34:114]]
    assert [t for t in kept if "few" not in t] == sorted(good)
    assert [t for t in kept if "few" in t] == [f"{notice}\nfew words"]  # under host a, where the notice is not common
    judged = quality.judged(frame(spark, rows)).collect()
    assert len(judged) == len(rows) and sum(r.kept for r in judged) == len(kept)


@pytest.mark.parametrize("tables", [1, 4])
def test_packed_members_are_whole(spark, monkeypatch, tables):
    """Every key that different nodes hold, with all its nodes; hot keys and repeated rows as well."""
    monkeypatch.setattr(common, "PACK", 50)
    rnd = random.Random(tables)
    rows = [(n, [rnd.randrange(60) for _ in range(3)] + ([999] if n % 3 == 0 else []) + [5000 + n]) for n in range(-40, 160)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "node long, keys array<long>").repartition(tables)
    got = common.packed_members(df, 5 * len(rows), "test").collect()
    held = {}
    for n, keys in rows:
        for k in keys:
            held.setdefault(k, set()).add(n)
    want = {k: v for k, v in held.items() if len(v) > 1}
    seen = {}
    for r in got:
        seen.setdefault(r.key, set()).add(r.node)
        assert r.lo in want[r.key] and r.lo <= r.node and r.n >= len(want[r.key])
    assert seen == want
    # every key's nodes hang together by (node, lo)
    for k in want:
        root = groups(list(want[k]), [(r.node, r.lo) for r in got if r.key == k])
        assert len(set(root.values())) == 1


def test_freed_tables_are_gone(spark):
    kept, gone = common.stored(spark.range(5), "kept"), common.stored(spark.range(5), "gone")
    common.free(gone)
    assert kept.count() == 5
    with pytest.raises(Exception):
        gone.agg(F.sum("id")).collect()


def test_mixing_keeps_columns_of_any_name(spark):
    names = "doc_id long, text string, source string, n_chars long, rid long, runs string, parts int, run string, _run int, lane long, size long"
    rows = [(i if i % 3 else None, f"word{i} " * (i % 50), "ab"[i % 2], 0, 7, "r", 8, "x", 9, 10, 11) for i in range(200)]
    out = mixing.mixed_documents(spark.createDataFrame(rows, names))
    assert out.columns == [c.split()[0] for c in names.split(", ")]
    got = out.collect()
    assert got and all((r.rid, r.runs, r.parts, r.run, r["_run"], r.lane, r.size, r.n_chars) == (7, "r", 8, "x", 9, 10, 11, len(r.text)) for r in got)


def test_equal_pieces_are_spread(spark):
    rows = spark.createDataFrame([(None, 0, 1, 5) for _ in range(5000)], "doc_id long, start long, length long, ids_crc32 long").repartition(6)
    rows = common.saved(rows, "equal-pieces")
    out = packing.place(rows, 2048, 100).collect()
    groups_ = {}
    for r in out:
        groups_.setdefault(r.sequence_id // packing.GROUP_SPAN, []).append(r)
    assert len(out) == 5000 and len(groups_) == 50 and max(map(len, groups_.values())) < 200
    assert len({(r.sequence_id, r.offset) for r in out}) == 5000


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    """An empty table and one of nulls, empty texts, repeated ids and odd columns pass all stages; their tables go as they pass."""
    import os

    import corpus_pipeline

    base = spark.conf.get("spark.checkpoint.dir")
    tables = lambda: {d for d in os.listdir(base) if d.startswith("corpus-")}
    rnd = random.Random(9)
    odd = [(ids(rnd, i), t, ["a", "b", None][i % 3]) for i, t in enumerate(texts(rnd, 12))] + [(None, None, None), (7, "", "a"), (7, "x" * 9000, "a")]
    for n, rows in enumerate(([], odd)):
        docs, sizes = frame(spark, rows), []
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = tables()
            stage(spark, docs, "").write.parquet(f"{tmp_path}/{n}-{i}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{i}")
            sizes.append(docs.count())
            assert name == "packing" or docs.columns == [c.split()[0] for c in KINDS.split(", ")]
            if i:
                assert not written & tables()  # the stage before left nothing behind
            written = tables() - before
        assert sizes[:3] == ([0, 0, 0] if not rows else [12, 12, 12])


def test_sketches_bound_and_choose_pairs(spark, monkeypatch):
    """A sketch differs in no more bits than the sets in items; only pairs that it leaves fetch their sets."""
    rnd = random.Random(8)
    base = texts(rnd, 1)[0].split(" ")
    some = [ngram_join.shingle_hashes(common.mix(np.array([rnd.randrange(60) if j % 9 == i else j for j in range(40 * i)], dtype=np.uint64)), 3) for i in range(9)]
    bits = ngram_join.sketches(some)
    for x, p in zip(some, bits):
        for y, q in zip(some, bits):
            assert sum(int(w).bit_count() for w in p ^ q) <= len(set(x.tolist()) ^ set(y.tolist()))
    rows = [(i, " ".join(base[:30] + texts(rnd, 1)[0].split(" ")[:3 if i < 6 else 60]), "a") for i in range(40)]
    fetched, made = [], ngram_join.shingle_sets
    monkeypatch.setattr(ngram_join, "shingle_sets", lambda t, n: fetched.append(t.count()) or made(t, n))
    out = {r.doc_id: r.component_id for r in ngram_join.near_groups(frame(spark, rows), 5, 80).collect()}
    s = sets(rows, 5)
    links = [(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    assert out == groups(list(s), links)
    assert all(n <= 6 for n in fetched)


def test_written_stages_are_removed(spark, monkeypatch):
    """When a stage runs, its predecessor's written result is the only one of the pipeline that is still there."""
    import os

    import corpus_pipeline

    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs)
        there = [os.path.exists(d.inputFiles()[0].removeprefix("file://").removeprefix("file:")) for d in seen[1:]]
        assert there == [False] * (len(seen) - 2) + [True] * (len(seen) > 1)
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, stage) for name in ("one", "two", "three", "four")])
    assert corpus_pipeline.run(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count() and len(seen) == 4


def test_ids_travel_narrow(spark):
    for ids in ([5, 65535], [5, 65536], [], [1]):
        x = np.array(ids, dtype="<u4")
        sent = packing.narrowed(x)
        assert len(sent) == len(ids) * (2 if ids and max(ids) < 65536 else 4)
        assert packing.widened(pa.array([sent], type=pa.binary()), [len(ids)])[0].as_py() == x.tobytes()
