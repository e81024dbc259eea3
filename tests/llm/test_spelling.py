"""Spelling variants against all pairs: nulls, accents, long words, ties, anagrams in one cell, chains of forms."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from roadlens.llm import spelling
from tests.llm.test_corpus import DOCS, ROWS, SF, lowered, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    c = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            c[w] += 1
    return {w: n for w, n in c.items() if n >= 2 and len(w) >= 7}


def neighbours(words):
    """By deletion keys: equal rests at one place are a replaced letter, a rest that is a word is a deleted one."""
    near, rest = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest[i, w[:i] + w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in words:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for held in rest.values():
        for w in held:
            near[w] |= held - {w}
    return near


def brute(rows):
    n = counted(rows)
    near = neighbours(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_given_documents_and_corner_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = ROWS + [(2000 + r.doc_id, r.text, "a") for r in docs] + [(None, ROWS[0][1], "a"), (None, "letterédd letterèdd " * 9, "a"), (None, None, None)]
    rows += [(31, "z" * 40_000 + " " + "z" * 39_999 + "y", "a"), (32, "z" * 40_000 + " " + "z" * 39_999 + "y", "a"), (33, "×÷Àbcdefg " * 3, "b")]
    rows += [(d, "abcdefghi " * 2000 + "abcdefghj " * 130 + "abcdefgjj " * 8 + "abcdegjj ", "a") for d in range(3000, 3040)]
    want = brute([(d, t) for d, t, _ in rows])
    assert any(r != f and f for f, r, *_ in want.values())  # a chain of forms
    assert got(spelling.spelling_variants(table(spark, rows))) == want


@pytest.mark.parametrize("cell", [16, 64])
def test_small_cells_and_anagrams(spark, monkeypatch, cell):
    """Cells of few words: many cells, anagrams that no tree divides, and words of two lengths around them."""
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "cell_words", lambda length: cell)
    monkeypatch.setattr(spelling, "LEAF", 4)
    rnd = random.Random(cell)
    words = {"".join(p) + "ab" for p in permutations("abcdef")} | {"".join(rnd.choice("aeinst") for _ in range(rnd.randrange(7, 11))) for _ in range(1500)}
    words |= {w[:3] + rnd.choice("aeinstxé") + w[3:] for w in rnd.sample(sorted(words), 300)}
    n = {w: rnd.randrange(1, 400) for w in words}
    vocab = spark.createDataFrame([(w, k, len(w)) for w, k in n.items()], "word string, n long, len int").repartition(3)
    trees = spelling.upper_trees(spark, vocab)
    rows = spelling.parted(spelling.routed(vocab, trees))
    assert rows.select("cell").distinct().count() > 5 and rows.filter("sub > 0").count() > 0
    found = spelling.near_words(vocab).collect()
    near = neighbours(words)
    assert {frozenset((r.a, r.b)) for r in found} == {frozenset((a, b)) for a in near for b in near[a]}
    assert len(found) == len({frozenset((r.a, r.b)) for r in found}) and all(n[r.a] == r.na and n[r.b] == r.nb for r in found)


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling.spelling_variants(table(spark, [(1, None, None), (None, "once upon", "a")])).collect() == []
