"""The conversation trie against a plain one: nulls, ties, repeated rows, missing and turnless conversations, deep ones."""

import collections
import hashlib
import random
import re
import zlib

from roadlens.llm import prefix_trie

KINDS = "conv_id long, turn long, role string, text string, part int, at long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h, b = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(b, [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out, below = {}, collections.defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(p[-1][1])) if p else 0
        kids = below[p]
        sums[p] = (sum(sums[k][0] for k in kids) or 1, (len(members[p]) - 1) * words + sum(sums[k][1] for k in kids))
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(kids), *sums[p],
                                        hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7) for r in rows], KINDS).repartition(5)


def test_small_corner_cases(spark):
    rows = [(c, t, "user" if t % 2 else None, f"hello {t} there" if c % 3 else "same  first turn") for c in range(-45, 90, 2) for t in range(c % 7)]
    rows += [(None, 1, "user", "lost"), (7, None, "user", "null turn first"), (7, None, None, None), (9, 2, "a", "tie"), (9, 2, "a", "tie"),
             (9, 2, "b", "tie"), (11, 0, "user", "x " * 5000), (13, 1, "ab", "c"), (33, 1, "a", "bc"), (2**63 - 1, 0, "user", "hi"), (-2**63, 0, "user", "hi")]
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rows)


def test_hot_conversations_and_turns(spark):
    """One conversation with a third of all rows (repeated turns as well), one opening turn and one whole conversation held by many."""
    rnd = random.Random(3)
    rows = [(40, t // 3, "user", f"turn {t % 50} of many") for t in range(3000)]
    rows += [(c, t, "user", "opening" if t == 0 else f"{rnd.randrange(3)}") for c in range(100, 700) for t in range(rnd.randrange(1, 5))]
    rows += [(c, t, "user", "copied") for c in range(1000, 1400) for t in range(4)]
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rows)


def test_blocks_and_places(spark, monkeypatch):
    """Chains cut into blocks give the same tour, and the arcs' places are a permutation that nests subtrees."""
    rows = [(c, t, "user", f"{t}" if t < c % 40 else f"{c} {t}") for c in range(60) for t in range(45)]
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    out = prefix_trie.prefix_trie(frame(spark, rows)).collect()
    assert {(r.conv_id, r.depth): r.saved_tokens for r in out} == {k: v[4] for k, v in brute(rows).items()}
    assert sorted(x for r in out for x in (r.enter_at, r.exit_at)) == list(range(1, 2 * len(out) + 1))
    place = {(r.conv_id, r.depth): (r.enter_at, r.exit_at) for r in out}
    for r in out:
        if r.depth:
            a, b = place[r.parent_conv_id, r.depth - 1]
            assert a < r.enter_at < r.exit_at < b


def test_given_table_and_empty(spark):
    convs = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in convs.collect()]
    assert got(prefix_trie.op11_prefix_trie(spark, SF)) == brute(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], KINDS)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, 1)], KINDS)).collect() == []
