"""SimHash components against every pair, with nulls, empty, long and repeated texts and a hot ball."""

import random
import re

import numpy as np
import pytest
import xxhash

from roadlens.llm import simhash
from tests.llm.test_corpus import DOCS, ROWS, SF, groups, lowered, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(lowered(text))
    if not w:
        return 0
    parts = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def components(fps):
    links = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    return groups(fps, links)


def brute(rows):
    fp = [plain(t) for _, t in rows]
    root = components(sorted(set(fp)))
    least = {}
    for (d, _), f in zip(rows, fp):
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    return sorted(((d, signed(f), least.get(root[f])) for (d, _), f in zip(rows, fp)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fp, r.component_id) for r in df.collect()), key=str)


def test_fingerprints_and_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(d, t, s) for d, t, s in ROWS] + [(1000 + r.doc_id, r.text, "a") for r in docs]
    rows += [(None, ROWS[0][1], "a"), (None, None, None), (None, "only once here", "b"), (900, long, "a"), (901, long + " end", "a")]
    want = brute([(d, t) for d, t, _ in rows])
    assert got(simhash.near_fingerprints(table(spark, rows))) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})  # some different fingerprints are linked


def test_spark_hash_is_the_same(spark):
    """A single shingle's fingerprint is its hash, which the built-in function gives as well."""
    x = spark.sql("select xxhash64('one two three four') as h").first().h
    assert signed(simhash.fingerprint(b"One  two\tthree four")) == x


def test_every_pair_in_the_radius_is_linked(spark):
    """Planted neighbours at each distance, and a centre with many holders that are 4 apart."""
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(300)]
    fps = set(base)
    for i, b in enumerate(base):
        x = b
        for bit in rnd.sample(range(64), 1 + i % 6):
            x ^= 1 << bit
        fps.add(x)
    centre = rnd.getrandbits(64)
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)}
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(7)
    found = set()
    for part in range(simhash.SLICES):
        found |= {(r.a, r.b) for r in simhash.slice_links(nodes, len(fps), part, 4).collect()}
    fps = sorted(fps)
    want = components(fps)
    have = groups(fps, [(a % (1 << 64), b % (1 << 64)) for a, b in found])
    assert {f: min(g for g in fps if have[g] == have[f]) for f in base} == {f: min(g for g in fps if want[g] == want[f]) for f in base}
    assert len({have[f] for f in fps}) == len({want[f] for f in fps})
    assert all((a ^ b).bit_count() <= 4 for a, b in ((a % (1 << 64), b % (1 << 64)) for a, b in found))


def test_ball_is_dealt_whole():
    masks = simhash.ball(2)
    assert sum(map(len, masks)) == 1 + 64 + 64 * 63 // 2
    assert all((simhash.codes(m) == c).all() for c, m in enumerate(masks))
    x = np.array([3, 1 << 63, 12345678901234567890], dtype=np.uint64)
    assert (simhash.codes(x ^ x[::-1].copy()) == (simhash.codes(x) ^ simhash.codes(x[::-1].copy()))).all()


def test_empty_table_and_one_row(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_fingerprints(empty).collect() == []
    assert got(simhash.near_fingerprints(table(spark, [(None, None, None)]))) == [(None, 0, None)]
    with pytest.raises(ValueError):
        simhash.near_fingerprints(empty, radius=3)
