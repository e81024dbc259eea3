"""Substring dedup by recompression.

Every text is a string of words.  A recompression round gives each symbol a pseudorandom side, left
or right, from its name, and drops the boundary between two neighbours that are equal (a token run)
or stand left-right (a pair); what stays together is a new symbol, named by a hash of its parts, so
equal runs and pairs get equal names on every executor without a dictionary.  A boundary's fate
depends on its two neighbours only.  After t rounds a surviving boundary therefore depends on a known
span of words around it, its *context*; wherever the same words stand in another document, the same
boundary with the same context name is found there.  That makes the parse consistent inside equal
substrings.

Each window of ``size`` words takes as its *seed* the boundary of the highest round whose context
lies wholly in the window (ties: least context hash), and the whole window where there is none (in
long runs).  Two equal windows always have the same seed, so windows whose seed occurs in one text
only cannot repeat.  Documents with equal words are one class; seeds of classes meet in a partially
aggregated group-by, seeds of two or more classes are *shared*, and only the windows of shared seeds
are hashed whole and compared over all classes.  A word goes when a window over it also starts in a
document with a smaller id.

Scale: texts are read three times (seeds; windows of documents with shared seeds; output of documents
that lose words) and are shuffled only for the last two kinds; what is shuffled besides is one
(seed, class) row per about five words and one row per window of a shared seed.  A passage in a third
of all documents is a partially aggregated key and a skew-splittable join key.  Seeds, classes and
windows are named by 64-bit hashes.

Defined results: a null or wordless text has no words and an empty kept text; a text shorter than a
window keeps all its words; equal documents keep the one with the least id (rows repeated under one
id all get that id's result); a null doc_id neither loses words nor makes others lose any; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import common as C

_U = np.uint64
_FAR = 1 << 40
_NONE = np.uint64((1 << 64) - 1)


def _span_hashes(words: np.ndarray):
    """Prefix sums from which any span of words is named: span(a, b) = (acc[b] - acc[a]) * down[a]."""
    up, down = C.powers(len(words) + 1)
    acc = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * up[:len(words)], dtype=_U, out=acc[1:])
    return acc, down


def parse(words: np.ndarray, bounds: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Surviving boundaries (word positions) with their context [lo, hi) after each round.

    ``bounds`` are the documents' limits in ``words``; a context that leaves its document is marked
    by a far lo or hi.
    """
    n = len(words)
    at = np.arange(n, dtype=np.int64)
    lo, hi = at.copy(), at.copy()
    opens = np.zeros(n + 1, dtype=bool)
    opens[bounds] = True
    first = opens[:n].copy()
    name, out = words, []
    for r in range(rounds):
        m = len(name)
        left = (C.mix(name ^ _U(0x5851F42D4C957F2D + r)) & _U(1)).astype(bool)
        keep = np.ones(m, dtype=bool)
        keep[1:] = ~((name[1:] == name[:-1]) | (left[:-1] & ~left[1:])) | first[1:]
        # a boundary is judged by the symbols on both sides, so its context grows to theirs
        wide_lo = np.empty(m, dtype=np.int64)
        wide_lo[0] = -_FAR
        wide_lo[1:] = lo[:-1]
        wide_lo[first] = -_FAR
        last = np.append(first[1:], True)
        # single words end where the next begins, also at a document's end; later that needs the next symbol
        wide_hi = np.where(last, at + 1 if r == 0 else _FAR, np.append(hi[1:], _FAR))
        idx = np.flatnonzero(keep)
        name = C.mix(np.add.reduceat(C.mix(name + _U(r + 1)), idx) + _U(r)) if m else name
        at, lo, hi, first = at[idx], wide_lo[idx], wide_hi[idx], first[idx]
        out.append((at, lo, hi))
    return out


def seeds(words: np.ndarray, bounds: np.ndarray, size: int, rounds: int = 3, least_round: int = 2):
    """The seed of every window: array over window starts (``_NONE`` where no window starts)."""
    n = len(words)
    best = np.full(n, _NONE, dtype=_U)
    if n == 0:
        return best
    acc, down = _span_hashes(words)
    levels = parse(words, bounds, rounds)
    for level in range(rounds, least_round - 1, -1):
        at, lo, hi = levels[level - 1]
        ok = np.flatnonzero((lo >= 0) & (hi <= n) & (hi - lo <= size))
        p, a, b = at[ok], lo[ok], hi[ok]
        rank = C.mix(((acc[b] - acc[a]) * down[a]) ^ ((p - a).astype(_U) * _U(64) + (b - a).astype(_U)))
        rank = (rank >> _U(2)) | (_U(rounds - level) << _U(62))
        value = np.full(n + size, _NONE, dtype=_U)
        value[p] = rank
        before = np.full(n + size, 255, dtype=np.uint8)
        after = np.full(n + size, 255, dtype=np.uint8)
        before[p] = p - a
        after[p] = b - p
        for o in range(1, size):
            fits = (before[o:o + n] <= o) & (after[o:o + n] <= size - o)
            np.minimum(best, np.where(fits, value[o:o + n], _NONE), out=best)
    starts = np.zeros(n, dtype=bool)  # windows stay inside their document
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            starts[a:b - size + 1] = True
    lone = np.flatnonzero(starts & (best == _NONE))
    if len(lone):
        best[lone] = C.mix((acc[lone + size] - acc[lone]) * down[lone]) >> _U(2) | _U(3 << 62)
    best[~starts] = _NONE
    return best


def _classes(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A name for each document's whole word sequence."""
    acc, down = _span_hashes(words)
    a, b = bounds[:-1], bounds[1:]
    return C.mix((acc[b] - acc[a]) * down[a] + (b - a).astype(_U)).view(np.int64)


def describe(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_words, cls, sha, seeds): cls names the word sequence, sha is of the whole text's words."""
    schema = "doc_id long, n_words long, cls long, sha string, seeds array<long>"

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, bounds, words, starts, ends, data in C.text_words(texts):
                best = seeds(words, bounds, size)
                a, b = bounds[:-1], bounds[1:]
                picks, shas = [], []
                for i, j in zip(a, b):
                    own = best[i:max(i, j - size + 1)]
                    picks.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
                    shas.append(_sha(data, starts[i:j], ends[i:j]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(a)), pa.array(b - a), pa.array(_classes(words, bounds)), pa.array(shas),
                     C.lists(picks, pa.int64())], ["doc_id", "n_words", "cls", "sha", "seeds"])

    return docs.mapInArrow(run, schema)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' bytes joined by one space."""
    if len(starts) == 0:
        return data[:0]
    sizes = ends - starts + 1
    total = int(sizes.sum())
    to = np.cumsum(sizes) - sizes
    src = np.arange(total) + np.repeat(starts - to, sizes)
    src[to[1:] - 1] = 0
    out = data[np.minimum(src, len(data) - 1)]
    out[to[1:] - 1] = 32
    return out[:total - 1]


def _sha(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    h = hashlib.sha256()
    for i in range(0, len(starts), 200_000):  # long texts piece by piece
        if i:
            h.update(b" ")
        h.update(joined_words(data, starts[i:i + 200_000], ends[i:i + 200_000]).tobytes())
    return h.hexdigest()


def windows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, cls, names, places) of the windows whose seed is in the row's ``seeds``.

    Rows are (doc_id, text, cls, seeds); a text of another class than ``cls`` gives no row."""

    def run(batches):
        for batch in batches:
            ids, texts, classes, wanted = batch.columns
            classes = classes.to_numpy(zero_copy_only=False)
            for first, bounds, words, _, _, _ in C.text_words(texts):
                own = np.flatnonzero(_classes(words, bounds) == classes[first:first + len(bounds) - 1])
                best = seeds(words, bounds, size)
                acc, down = _span_hashes(words)
                names, places = [], []
                for k in own:
                    i, j = bounds[k], bounds[k + 1]
                    keys = np.asarray(wanted[int(first + k)].values, dtype=np.int64).view(_U)
                    at = i + np.flatnonzero(np.isin(best[i:max(i, j - size + 1)], keys))
                    names.append(C.mix((acc[at + size] - acc[at]) * down[at]))
                    places.append(at - i)
                rows = pa.array(first + own)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), pa.array(classes[first + own]), C.lists(names, pa.int64()), C.lists(places, pa.int64())],
                    ["doc_id", "cls", "names", "places"])

    return docs.select("doc_id", "text", "cls", "seeds").mapInArrow(
        run, "doc_id long, cls long, names array<long>, places array<long>")


def cut(docs: DataFrame, size: int) -> DataFrame:
    """(cls, n_removed, sha, kept) of rows (doc_id, text, cls, places) without the windows at ``places``."""

    def run(batches):
        for batch in batches:
            _, texts, classes, places = batch.columns
            classes = classes.to_numpy(zero_copy_only=False)
            for first, bounds, words, starts, ends, data in C.text_words(texts):
                own = np.flatnonzero(_classes(words, bounds) == classes[first:first + len(bounds) - 1])
                gone, shas, kept = [], [], []
                for k in own:
                    i, j = bounds[k], bounds[k + 1]
                    at = np.asarray(places[int(first + k)].values, dtype=np.int64)
                    delta = np.zeros(j - i + 1, dtype=np.int64)
                    np.add.at(delta, at, 1)
                    np.add.at(delta, at + size, -1)
                    stay = np.cumsum(delta[:-1]) == 0
                    gone.append(int(j - i - stay.sum()))
                    shas.append(_sha(data, starts[i:j][stay], ends[i:j][stay]))
                    kept.append(joined_words(data, starts[i:j][stay], ends[i:j][stay]).tobytes().decode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(classes[first + own]), pa.array(gone, type=pa.int64()), pa.array(shas, type=pa.string()),
                     pa.array(kept, type=pa.string())], ["cls", "n_removed", "sha", "kept"])

    return docs.select("doc_id", "text", "cls", "places").mapInArrow(run, "cls long, n_removed long, sha string, kept string")


def repeated_windows(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a table (doc_id, text): the described documents, the classes (cls, least doc_id), and the
    window starts to remove in each class's first document (doc_id, cls, places)."""
    told = C.saved(describe(docs, size), "recompress")
    live = told.filter("doc_id is not null")
    classes = C.saved(live.groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "classes")
    spots = live.select(F.explode("seeds").alias("key"), F.col("cls").alias("node"))
    shared = C.shared_keys(spots, "seeds").select("key")
    held = C.saved(spots.join(shared, "key").distinct().groupBy("node").agg(
        F.collect_set("key").alias("seeds")).withColumnRenamed("node", "cls"), "held")
    held = C.saved(held.join(classes, "cls").select("doc_id", "cls", "seeds"), "firsts")
    texts = docs.join(C.small(held.select("doc_id")), "doc_id", "left_semi")
    rows = C.saved(windows(texts.join(held, "doc_id"), size), "windows")
    each = rows.select("doc_id", "cls", F.explode(F.arrays_zip("names", "places")).alias("w")).select(
        F.col("w.names").alias("key"), F.col("doc_id").alias("node"), "cls", F.col("w.places").alias("place"))
    first = C.shared_keys(each, "repeats")
    late = each.join(first, "key").filter("node > lo")
    places = late.groupBy(F.col("node").alias("doc_id"), "cls").agg(F.collect_set("place").alias("places"))
    return told, classes, C.saved(places, "places")


def remove_repeats(docs: DataFrame, size: int = 13, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, with the kept words when asked for."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    told, classes, places = repeated_windows(docs, size)
    texts = docs.join(C.small(places.select("doc_id")), "doc_id", "left_semi").join(places, "doc_id")
    done = cut(texts, size).dropDuplicates(["cls"])
    done = C.saved(done.select("cls", "n_removed", "sha", "kept") if with_text
                   else done.select("cls", "n_removed", "sha"), "cut")
    out = told.drop("seeds").join(classes.withColumnRenamed("doc_id", "least"), "cls", "left").join(
        done.withColumnRenamed("sha", "cut_sha"), "cls", "left")
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_words") >= size)
    cut_here = (F.col("doc_id") == F.col("least")) & F.col("cut_sha").isNotNull()
    out = out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(cut_here, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(cut_here, F.col("cut_sha")).otherwise(
            F.col("sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).when(cut_here, F.col("kept")).alias("kept_if_changed")] if with_text else []))
    return out


def op9_substring(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=13)


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 12), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM w WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT doc_id, p FROM win JOIN f USING (g) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(p, p + 13)) AS pos FROM hit)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
