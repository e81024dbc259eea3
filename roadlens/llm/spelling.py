"""Spelling variants grouped by k-d trees over letter-count vectors.

A word is a point whose coordinates count its letters.  One replaced letter moves a point by one up in one coordinate and
by one down in another, one inserted letter by one up: a distance of at most two.  For every pair of lengths (L, L)
and (L, L + 1) the words of length L search the trees of the other length; boxes that no such move
reaches are pruned, and of the words in the leaves that are left the order of letters is verified.

Scale: words are counted in Arrow batches and summed before and after one shuffle.  The upper part of every length's tree
is grown on the driver from a sample of at most ``SAMPLE`` vectors and only divides the space into cells; every
word is dealt to its cell, and as a query to each cell its moves can reach, so the result never depends on the sample.
A cell is one task's work: it grows its own lower tree over all its words.  Cells that still hold too many words (a tree can't
divide equal vectors) are divided by the halves of the words, one of which two near words share.
A word's near words are summed before the shuffle; roots are found by pointer jumping.

Defined results: a null text has no words; with a null doc_id the checksum is that of ``:<run>``; repeated rows count
again; of near words with equal counts the least in code-point order is the form; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm import common as C

LEAST, TWICE, OFTEN = 7, 2, 10
#: One run in so many (per document) loses a letter.
SLIP = 31
#: Words to a cell and to a leaf; vectors that the upper trees are grown from; bytes of words to a cell.
CELL, LEAF, SAMPLE, CELL_BYTES = 4096, 48, 50_000, 1 << 26
#: Entries of a batch's count before it is handed on.
FLUSH = 200_000
LETTERS = 26 + 64
_LOWER = bytes(C.LOWER)
_DIM = np.zeros(256, dtype=np.int64)
_DIM[97:123] = np.arange(26)
_DIM[0xC0:] = 26 + np.arange(64)
_BIT = np.uint64(1) << np.array([*range(26), *[26 + i % 38 for i in range(64)]], dtype=np.uint64)
_MOVE = {0: (0, 0), 1: (1, 1), 2: (1, 0)}  # letters more and less that a move may bring: none, replaced, inserted


# --- counts -------------------------------------------------------------------------------------

def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n): the words of at least ``least`` letters, after the slips."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def rows(count):
        return pa.RecordBatch.from_arrays([pa.array(list(count), type=pa.string()), pa.array(list(count.values()), type=pa.int64())], ["word", "n"])

    def run(batches):
        for batch in batches:
            count: Counter = Counter()
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
                lowered = text.as_buffer().to_pybytes().translate(_LOWER).decode()
                for word, n in Counter(runs.findall(lowered)).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % SLIP == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    count[word] += n
                if len(count) > FLUSH:
                    yield rows(count)
                    count = Counter()
            yield rows(count)

    each = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


# --- k-d trees ----------------------------------------------------------------------------------

def letters(words: list[bytes]) -> np.ndarray:
    """Letter counts of Latin-1 words, a row each."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    at = np.repeat(np.arange(len(words)) * LETTERS, size) + _DIM[np.frombuffer(b"".join(words), dtype=np.uint8)]
    return np.bincount(at, minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


def parity(vec: np.ndarray) -> np.ndarray:
    """A bit per letter (some share one), set where the count is odd: one edit changes at most two."""
    odd = np.where(vec & 1, _BIT[None, :], np.uint64(0))
    return np.bitwise_xor.reduce(odd, axis=1)


class Tree:
    """A k-d tree over rows of counts: inner nodes cut one coordinate, leaves hold row numbers."""

    def __init__(self, vec: np.ndarray, leaf: int):
        self.cut: list[tuple | None] = []
        self.box: list[tuple] = []
        self.rows: list[np.ndarray | None] = []
        stack = [(np.arange(len(vec)), {}, None)]
        while stack:
            rows, box, parent = stack.pop()
            me = len(self.cut)
            if parent is not None:
                up, side = parent
                self.cut[up] = (*self.cut[up][:2], *((me, self.cut[up][3]) if side == 0 else (self.cut[up][2], me)))
            dims = np.array(sorted(box), dtype=np.int64)
            self.box.append((dims, np.array([box[d][0] for d in dims], dtype=np.int64), np.array([box[d][1] for d in dims], dtype=np.int64)))
            part = vec[rows]
            spread = part.var(axis=0) if len(rows) > leaf else np.zeros(1)
            d = int(spread.argmax())
            if spread[d] == 0:
                self.cut.append(None)
                self.rows.append(rows)
                continue
            x = part[:, d]
            t = int(np.partition(x, len(x) // 2)[len(x) // 2])
            t -= int(t == x.max())
            low, high = box.get(d, (0, 1 << 40))
            self.cut.append((d, t, -1, -1))
            self.rows.append(None)
            stack.append((rows[x <= t], {**box, d: (low, t)}, (me, 0)))
            stack.append((rows[x > t], {**box, d: (t + 1, high)}, (me, 1)))

    def reach(self, vec: np.ndarray, more: int, less: int):
        """Yield (leaf, query rows): the leaves with boxes that a query reaches by ``more`` letters more and ``less`` letters less."""
        stack = [(0, np.arange(len(vec)))]
        while stack:
            node, q = stack.pop()
            if self.cut[node] is None:
                yield node, q
                continue
            for kid in self.cut[node][2:]:
                dims, low, high = self.box[kid]
                x = vec[q][:, dims]
                near = (np.maximum(low - x, 0).sum(axis=1) <= more) & (np.maximum(x - high, 0).sum(axis=1) <= less)
                if near.any():
                    stack.append((kid, q[near]))

    def leaves(self) -> dict[int, int]:
        return {node: i for i, node in enumerate(n for n, cut in enumerate(self.cut) if cut is None)}


def cell_words(length: int) -> int:
    """Words of a length to a cell: ``CELL``, fewer of long words."""
    return max(16, min(CELL, CELL_BYTES // max(length, 1)))


def upper_trees(spark: SparkSession, vocab: DataFrame) -> dict[int, Tree]:
    """Trees of the lengths with more words than a cell takes, from a sample of bounded size."""
    counts = {r.len: r.n for r in vocab.groupBy("len").agg(F.count("*").alias("n")).filter(
        F.col("n") > F.greatest(F.lit(16), F.least(F.lit(CELL), F.floor(F.lit(CELL_BYTES) / F.col("len"))))).collect()}
    if not counts:
        return {}

    def vectors(batches):
        for batch in batches:
            v = letters([w.encode("latin-1") for w in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in v], type=pa.binary())], ["len", "vec"])

    some = vocab.filter(F.col("len").isin(list(counts))).orderBy(F.xxhash64("word"), "word").limit(SAMPLE)
    sample: dict[int, list] = {}
    for r in some.select("len", "word").mapInArrow(vectors, "len int, vec binary").collect():
        sample.setdefault(r.len, []).append(np.frombuffer(r.vec, dtype=np.int32))
    # a sampled row stands for counts / rows words; a leaf of fewer than 16 rows says too little about them
    return {n: Tree(np.stack(v), max(16, len(v) * cell_words(n) // counts[n])) for n, v in sample.items()}


# --- search -------------------------------------------------------------------------------------

def routed(vocab: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(len, cell, kind, word, n): kind 0 a word in its cell, 1 a query to another cell of its length, 2 a query to words longer by one."""
    cells = {n: t.leaves() for n, t in trees.items()}

    def spots(length: int, vec: np.ndarray, kind: int):
        if length not in trees:
            return np.zeros(len(vec), dtype=np.int32), np.arange(len(vec))
        found = [(np.full(len(q), cells[length][leaf], dtype=np.int32), q) for leaf, q in trees[length].reach(vec, *_MOVE[kind])]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))

    def run(batches):
        for batch in batches:
            size = batch.column(2).to_numpy()
            for length in np.unique(size).tolist():
                rows = batch.take(pa.array(np.flatnonzero(size == length)))
                vec = letters([w.encode("latin-1") for w in rows.column(0).to_pylist()])
                cell, q = spots(length, vec, 0)
                own = np.empty(len(vec), dtype=np.int32)
                own[q] = cell
                out = [(length, own, 0, np.arange(len(vec)))]
                if length in trees:
                    cell, q = spots(length, vec, 1)
                    later = cell > own[q]  # the pair's other word finds it the other way round
                    out.append((length, cell[later], 1, q[later]))
                out.append((length + 1, *[x for x in spots(length + 1, vec, 2)]))
                out[-1] = (out[-1][0], out[-1][1], 2, out[-1][2])
                for to, cell, kind, q in out:
                    if len(q):
                        some = rows.take(pa.array(q))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(q), to, dtype=np.int32)), pa.array(cell), pa.array(np.full(len(q), kind, dtype=np.int32)),
                             some.column(0), some.column(1)], ["len", "cell", "kind", "word", "n"])

    return vocab.select("word", "n", "len").mapInArrow(run, "len int, cell int, kind int, word string, n long")


def parted(rows: DataFrame) -> DataFrame:
    """Add ``sub``: 0, or in cells with far too many words a number for each half of a word; near words share a half."""
    limit = 4 * F.greatest(F.lit(16), F.least(F.lit(CELL), F.floor(F.lit(CELL_BYTES) / F.col("len"))))
    full = rows.filter("kind = 0").groupBy("len", "cell").agg(F.count("*").alias("held")).filter(F.col("held") > limit)
    full = full.select("len", "cell", F.ceil(F.lit(4) * F.col("held") / limit).alias("parts"))
    rows = rows.join(F.broadcast(full), ["len", "cell"], "left")  # at most one row per leaf of the upper trees
    # one edit lies behind the first (len - 1) div 2 letters, or before the last len - 1 - that many
    front = F.expr("substring(word, 1, (len - 1) div 2)")
    back = F.expr("right(word, len - 1 - (len - 1) div 2)")
    halves = F.array(*[1 + 2 * F.pmod(F.xxhash64(x), F.col("parts")) + i for i, x in enumerate((front, back))])
    return rows.withColumn("sub", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(halves))).drop("parts")


def one_edit(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether rows of letters of ``q`` and ``p`` differ by one replaced letter, or one inserted if ``p`` is longer by one."""
    if q.shape[1] == p.shape[1]:
        return (q != p).sum(axis=1) == 1
    n = q.shape[1]
    ahead = np.cumprod(q == p[:, :n], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    behind = np.cumprod((q == p[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return ahead + behind >= n


def near_in(points: list[bytes], queries: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(query rows, point rows) of the words one edit apart; ``kind`` 0: queries are the points, each pair once."""
    vec = letters(points)
    tree, odd = Tree(vec, LEAF), parity(vec)
    p = np.frombuffer(b"".join(points), dtype=np.uint8).reshape(len(points), -1)
    q = p if kind == 0 else np.frombuffer(b"".join(queries), dtype=np.uint8).reshape(len(queries), -1)
    some = max(1, (1 << 22) // p.shape[1])
    found = []
    for at in range(0, len(q), 4096):
        qvec = vec[at:at + 4096] if kind == 0 else letters(queries[at:at + 4096])
        qodd = parity(qvec)
        for leaf, rows in tree.reach(qvec, *_MOVE[kind or 1]):
            held = tree.rows[leaf]
            flips = np.bitwise_count(qodd[rows][:, None] ^ odd[held][None, :])
            x, y = np.nonzero(flips == 1 if kind == 2 else flips <= 2)
            x, y = rows[x] + at, held[y]
            if kind == 0:
                x, y = x[x < y], y[x < y]
            for lo in range(0, len(x), some):
                a, b = x[lo:lo + some], y[lo:lo + some]
                ok = one_edit(q[a], p[b])
                found.append((a[ok], b[ok]))
    return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2


def search(group: pa.Table) -> pa.Table:
    """The near pairs (a, na, b, nb) of one cell."""
    group = group.combine_chunks()
    kind = group.column("kind").to_numpy()
    points = group.take(pa.array(np.flatnonzero(kind == 0)))
    held = [w.encode("latin-1") for w in points.column("word").to_pylist()]
    out = []
    for k in (0, 1, 2):
        asked = points if k == 0 else group.take(pa.array(np.flatnonzero(kind == k)))
        if not held or not asked.num_rows:
            continue
        queries = held if k == 0 else [w.encode("latin-1") for w in asked.column("word").to_pylist()]
        x, y = near_in(held, queries, k)
        a, b = asked.select(["word", "n"]).take(pa.array(x)), points.select(["word", "n"]).take(pa.array(y))
        out.append(pa.table([*a.columns, *b.columns], names=["a", "na", "b", "nb"]))
    kinds = pa.schema([("a", pa.string()), ("na", pa.int64()), ("b", pa.string()), ("nb", pa.int64())])
    return pa.concat_tables([t.cast(kinds) for t in out]) if out else kinds.empty_table()


def near_words(vocab: DataFrame) -> DataFrame:
    """(a, na, b, nb): every pair of words (word, n, len) one edit apart, once."""
    rows = C.stored(routed(vocab, upper_trees(vocab.sparkSession, vocab)), "routed")
    found = parted(rows).groupBy("len", "cell", "sub").applyInArrow(search, "a string, na long, b string, nb long")
    return C.stored(found.distinct(), "near-words")  # words whose halves are both equal meet twice in a divided cell


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): forms followed to the last."""
    now = C.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        then = C.stored(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        C.free(now)
        now = then.select("word", "root")
        if then.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least: int = LEAST, twice: int = TWICE, often: int = OFTEN) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    counted = word_counts(docs, least).filter(F.col("n") >= twice)
    vocab = C.stored(counted.select("word", "n", F.char_length("word").alias("len")), "vocabulary")
    pairs = near_words(vocab)
    both = pairs.union(pairs.select("b", "nb", "a", "na"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("m"), F.col("b"))).alias("x"))
    out = vocab.select("word", "n").join(best, "word", "left")
    formed = -F.col("x.m") >= often * F.col("n")
    out = C.stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("x.b")).alias("form"),
                              F.when(formed, -F.col("x.m")).alias("form_n")), "forms")
    root = roots(out.filter("form is not null"))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH RECURSIVE bit AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v
  FROM (SELECT unnest(range(0, 256)) AS i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bit),
run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
b AS (SELECT doc_id, w, n, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS p FROM run),
h AS (SELECT doc_id, w, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(p,
    lambda c: CASE WHEN c < 128 THEN [c] ELSE [195, c - 64] END))), lambda a, c: xor(a // 256, t[1 + xor(a % 256, c)]))) AS h FROM b, tab),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0
    THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
e AS (SELECT DISTINCT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT DISTINCT v.word, cut.word FROM v JOIN cut ON cut.rest = v.word UNION SELECT DISTINCT cut.word, v.word FROM v JOIN cut ON cut.rest = v.word),
k AS (SELECT a AS word, count(*) AS n_near, max(v.n) AS most FROM e JOIN v ON v.word = e.b GROUP BY a),
f AS (SELECT k.word, min(e.b) AS form, max(k.most) AS form_n FROM k JOIN v USING (word) JOIN e ON e.a = k.word JOIN v o ON o.word = e.b AND o.n = k.most
  WHERE k.most >= 10 * v.n GROUP BY k.word),
r AS (SELECT word, form AS root, 1 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root)
SELECT v.word, f.form, coalesce(l.root, v.word) AS root, v.n, coalesce(k.n_near, 0) AS n_near, f.form_n
FROM v LEFT JOIN k USING (word) LEFT JOIN f USING (word) LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word) l USING (word)
"""
