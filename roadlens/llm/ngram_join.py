"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles.  Sets at or over the similarity threshold have
sizes in the same or in neighbouring *bands* and differ in at most k items, where k follows from the
band's largest size.  For every band the 64-bit item domain is cut into n1 ranges and each of them
into n2; if two sets differ in at most k items, some first-level range holds at most k2 of the
differences, so the two agree on some choice of n2 - k2 of its parts.  Each choice, hashed with band,
range and content, is one signature: a pair over the threshold always shares one.  By default half as many
ranges as differences are cut into ``parts`` = 3, and the subsets with one part left out (k2 = 1) are enumerated;
``parts`` = 1 is plain partitioning, n1 = k + 1 ranges with k2 = 0.

Scale: one Arrow pass hashes all words of a chunk of texts at once, keeps only signatures (about
(1 - t) / (1 + t) * 6 per shingle), and nodes are classes of equal sets, so thousands of copies
are one node.  Signatures travel sorted and packed, and meet by ranges; only those held by several
classes go further, where pairs are verified against one representative per signature and the rest
by rarest shared items (``common.linked_groups``); nothing is ever expanded into all pairs.  Pairs that the sets' parity sketches
rule out (most, where few documents are alike) never fetch their sets.

Defined results: a null or wordless text has an empty set and links with nothing; a text with fewer
words than a shingle is one shingle; repeated rows get equal results; a row with a null doc_id is linked like any
other, but never names a component (null only if no reachable row has an id); an empty table gives an empty table;
other columns are not read (``keep_one`` keeps them).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import common as C

_U = np.uint64
#: Parts of a range, one of which may hold a difference; 1: plain partitioning.
PARTS = 3
#: Passes over the texts of ``keep_one``, each for its share of the ranges: half of the signatures are shuffled at a time, and those of
#: parts without items are left out (``PartEnum``).
PASSES = 2
_FOLD = (0x9E6C63D0876A9F2B, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA6B2F2A1D4D,
         0xFF51AFD7ED558CCD, 0xB492B66FBE98F273, 0xA24BAED4963EE407)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; all words as one shingle when there are fewer."""
    if len(words) == 0:
        return words
    if len(words) < n:
        x = (words * np.array(_FOLD, dtype=_U)[np.arange(len(words)) % 8]).sum(dtype=_U, keepdims=True)
        return C.mix(x + _U(len(words)))
    x = words[:len(words) - n + 1] * _U(_FOLD[0])
    for j in range(1, n):
        x = x + words[j:len(words) - n + 1 + j] * _U(_FOLD[j % 8])
    return C.distinct(C.mix(x ^ (x >> _U(29))))


def bands(pct: int, upto: int) -> list[tuple[int, int]]:
    """Size bands [low, high] from 1 on; sets over the threshold lie in one band or two neighbours."""
    out, low = [], 1
    while low <= upto:
        out.append((low, low * 100 // pct))
        low = out[-1][1] + 1
    return out


class PartEnum:
    """Signatures of a sorted array of distinct 64-bit items."""

    def __init__(self, pct: int, parts: int = PARTS, spare: bool = True):
        self.pct, self.parts, self.spare, self.edges, self.table = pct, parts, spare, {}, []

    def band(self, size: int) -> int:
        while not self.table or self.table[-1][1] < size:
            self.table = bands(self.pct, max(size, 2 * (self.table[-1][1] if self.table else 64)))
            self.highs = np.array([h for _, h in self.table])
        return int(np.searchsorted(self.highs, size))

    def ranges(self, band: int) -> tuple[np.ndarray, int]:
        """Lower edges of the n1 * n2 domain ranges of a band (n2 = parts, at most parts - 1 kept out), and how many first-level
        ranges there are beyond those that k differences can spoil, less one: so many may be left out."""
        if band not in self.edges:
            high = self.table[band][1]
            k = (100 - self.pct) * 2 * high // (100 + self.pct)
            n1 = k + 1 if self.parts == 1 else k // 2 + 1  # k2 = 0, or 1 difference allowed in a range
            spare = n1 // 10 + 1 if self.spare and high >= 16 else 0
            n = (n1 + spare) * self.parts
            self.edges[band] = np.array([-(-(j << 64) // n) for j in range(n)], dtype=_U), spare
        return self.edges[band]

    def signatures(self, items: np.ndarray, part: int = 0, of: int = 1) -> np.ndarray:
        """The set's signatures from every ``of``-th first-level range.  Sets have signatures of nothing in common wherever both hold no item in a choice of parts; such ones
        are left out if no more ranges have any than are spare, as an agreeing range with items is left then."""
        if len(items) == 0:
            return items
        own = self.band(len(items))
        self.band(self.table[own][1] + 1)
        total = np.zeros(len(items) + 1, dtype=_U)
        np.cumsum(C.mix(items + _U(0x632BE59BD9B4E019)), dtype=_U, out=total[1:])
        out = []
        for band in (own, own + 1):
            edges, spare = self.ranges(band)
            cut = np.append(np.searchsorted(items, edges), len(items))
            sums = total[cut[1:]] - total[cut[:-1]]
            place = np.arange(len(sums), dtype=_U) * _U(0x9FB21C651E98DF25) + _U((band + 1) * 0xD1B54A32D192ED03 % (1 << 64))
            content = C.mix(sums ^ place).reshape(-1, self.parts)
            held = np.diff(cut).reshape(-1, self.parts)
            names, full = [], []
            for keep in combinations(range(self.parts), max(self.parts - 1, 1)):
                x = np.zeros(len(content), dtype=_U)
                for j in keep:
                    x = x * _U(_FOLD[1]) + content[:, j]
                names.append(C.mix(x + _U(keep[0] * 64 + keep[-1])))
                full.append(held[:, keep].any(axis=1))
            names, full = np.stack(names), np.stack(full)
            if (~full).any(axis=0).sum() > spare:
                full[:] = True
            out.append(names[:, part::of][full[:, part::of]])
        return np.concatenate(out)


#: Longs of a set's parity sketch: a bit tells whether an odd number of items fall on it, so two sets differ in at least as many
#: items as their sketches in bits.
SKETCH = [f"q{j}" for j in range(16)]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches (row: set, column: long) of arrays of distinct hashes."""
    bits, out = 64 * len(SKETCH), np.zeros((len(sets), len(SKETCH)), dtype=_U)
    for at in range(0, len(sets), 512):
        some = sets[at:at + 512]
        row = np.repeat(np.arange(len(some)), [len(s) for s in some])
        place = row * bits + (np.concatenate(some) & _U(bits - 1)).astype(np.int64)
        odd = (np.bincount(place, minlength=len(some) * bits) & 1).astype(np.uint8)
        out[at:at + 512] = np.packbits(odd, bitorder="little").view("<u8").reshape(len(some), -1)
    return out


def may_reach(classes: DataFrame, pct: int):
    """A function that keeps the pairs (a, b) whose sets may reach ``pct`` by their sketches: sets that do differ in at most
    (1 - t) / (1 + t) of both sizes.  ``classes``: (node, n_shingles, the sketch)."""
    def side(x):
        return classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"{x}_n"), *[F.col(c).alias(f"{x}_{c}") for c in SKETCH])

    def keep(pairs: DataFrame) -> DataFrame:
        apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH), F.lit(0))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.filter(F.lit(100 + pct) * apart <= F.lit(100 - pct) * (F.col("a_n") + F.col("b_n"))).select("a", "b")

    return keep


def named_sets(docs: DataFrame, n: int) -> DataFrame:
    """(row, doc_id, tx, n_shingles, cls, the sketch) of (row, doc_id, text): tx names the text, cls the set (null when empty)."""

    def run(batches):
        for batch in batches:
            for first, sets, size, cls in batch_sets(batch.column(3), n):
                odd = sketches(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(first, len(sets)) for i in range(3)], pa.array(size), pa.array(cls.view(np.int64), mask=size == 0),
                     *[pa.array(np.ascontiguousarray(x)) for x in odd.T]], ["row", "doc_id", "tx", "n_shingles", "cls", *SKETCH])

    text = F.col("text").cast("string")
    return docs.select("row", F.col("doc_id").cast("long"), F.xxhash64(text), text).mapInArrow(
        run, "row long, doc_id long, tx long, n_shingles long, cls long, " + ", ".join(f"{c} long" for c in SKETCH))


def signed_batches(n: int, pct: int, parts: int, spare: bool, part: int, of: int):
    """From batches of texts to batches (node, keys): every set's name and its signatures from every ``of``-th range."""

    def run(batches):
        scheme = PartEnum(pct, parts, spare)
        for batch in batches:
            for _, sets, size, cls in batch_sets(batch.column(0), n):
                full = np.flatnonzero(size)
                keys = C.lists([scheme.signatures(sets[i], part, of) for i in full], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cls[full].view(np.int64)), keys], ["node", "keys"])

    return run


def batch_sets(texts: pa.Array, n: int):
    """Yield (first row, shingle sets, their sizes, their names) for runs of texts."""
    for first, bounds, words, _, _, _ in C.text_words(texts, lower=True):
        sets = [shingle_hashes(words[a:b], n) for a, b in zip(bounds[:-1], bounds[1:])]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        yield first, sets, size, C.mix(np.array([C.mix(s * _U(_FOLD[3])).sum(dtype=_U) for s in sets], dtype=_U) ^ size.astype(_U))


def shingle_sets(texts: DataFrame, n: int) -> DataFrame:
    """(cls, items) of rows (text): the sorted distinct shingle hashes."""

    def run(batches):
        for batch in batches:
            for _, sets, _, cls in batch_sets(batch.column(0), n):
                yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)), C.lists(sets, pa.int64())], ["cls", "items"])

    return texts.mapInArrow(run, "cls long, items array<long>")


def linked_rows(docs: DataFrame, n: int, pct: int, parts: int, passes: int) -> DataFrame:
    """(row, doc_id, tx, n_shingles, cls, comp) of (row, doc_id, text): comp names the group of a row's set (null when empty)."""
    rows = C.stored(named_sets(docs, n), "sets")
    some = rows.agg(F.sum("n_shingles")).first()[0] or 0  # about a signature a shingle
    members, texts = None, docs.select(F.col("text").cast("string"))
    for part in range(passes):  # a pass's shuffle is freed before the next
        found = C.packed_members(texts, some // passes, "partenum", signed_batches(n, pct, parts, passes > 1, part, passes))
        members = found if members is None else members.unionByName(found)

    def sets_of(nodes: DataFrame) -> DataFrame:
        text = rows.join(C.small(nodes, limit=C.BROADCAST_LINKS), rows["cls"] == nodes["node"], "left_semi").groupBy("cls").agg(F.min("tx").alias("tx"))
        wanted = C.stored(text, "wanted")
        of = docs.select(F.col("text").cast("string").alias("text")).withColumn("tx", F.xxhash64("text"))
        of = of.join(C.small(wanted.select("tx").distinct(), limit=C.BROADCAST_LINKS), "tx", "left_semi").select("text")
        made = shingle_sets(of, n).join(wanted.select("cls"), "cls", "left_semi")
        return made.select(F.col("cls").alias("node"), "items").dropDuplicates(["node"])

    def may(nodes: DataFrame):
        held = rows.join(C.small(nodes, limit=C.BROADCAST_LINKS), rows["cls"] == nodes["node"], "left_semi")
        held = held.groupBy(F.col("cls").alias("node")).agg(*[F.first(c).alias(c) for c in ("n_shingles", *SKETCH)])
        return may_reach(C.stored(held, "sketches"), pct)

    comp = C.linked_groups(members, sets_of, pct, "partenum", may=may).withColumnRenamed("node", "cls")
    rows = rows.drop(*SKETCH)
    return rows.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def near_groups(docs: DataFrame, n: int = 5, pct: int = 80, parts: int = PARTS, passes: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id): the least doc_id reachable over links of at least ``pct`` %
    Jaccard similarity of n-word shingle sets; a document without links is its own component."""
    rows = C.stored(linked_rows(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text"), n, pct, parts, passes).drop("row", "tx"), "placed")
    classes = rows.filter("cls is not null").groupBy("cls", "comp").agg(F.min("doc_id").alias("least"))
    least = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = C.stored(classes.select("cls", "comp").join(least, "comp").select("cls", "component_id"), "named")
    out = rows.join(named, "cls", "left")
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, pct: int = 80, parts: int = PARTS, passes: int = PASSES) -> DataFrame:
    """The documents without those that another of their group stands for: the first by doc_id (null last), text and row stays.
    Rows are told apart whatever their doc_id is."""
    row = C.fresh(docs, "row")
    held = C.stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-docs")
    rows = linked_rows(held.select(F.col(row).alias("row"), "doc_id", "text"), n, pct, parts, passes).filter("cls is not null")
    rows = C.stored(rows.select("comp", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tx", "row").alias("place")), "placed")
    first = rows.groupBy("comp").agg(F.min("place").alias("first"))
    gone = rows.join(first, "comp").filter("place.row <> first.row").select(F.col("place.row").alias(row))
    return held.join(C.small(C.stored(gone, "gone")), row, "left_anti").select(*docs.columns)


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, pct=90)


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2)) WHEN len(w) > 0 THEN [w] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS doc, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc AS doc_id, min(root) AS component_id FROM r GROUP BY doc) c USING (doc_id)
"""
