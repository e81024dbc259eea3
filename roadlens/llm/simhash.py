"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's fingerprint has a bit set where over half of its shingles' XXH64 hashes have it (words with
A-Z lower-cased, shingles of ``words`` words joined by one space, repeats included).  Two fingerprints at
most ``radius`` bits apart have a 64-bit word between them that lies at most ``radius / 2`` bits from
each: every fingerprint emits all words of that ball (2,081 for radius 4), the words are shuffled, and
the holders of one word are linked.  Each colliding pair is verified by its differing bits.

Scale: nodes are distinct fingerprints, so thousands of copies emit one ball.  The ball is dealt over
``SLICES`` passes by a linear code of the words (a pass makes just its own words, none is thrown away), and
a pass's shuffle is freed before the next.  Words travel as packed arrays, one row per chunk of fingerprints
and bucket.  Holders of one word are all within the radius of each other, so they are linked to the least
of them and never expanded into pairs; a chunk settles its own collisions first and sends one holder a word, so
a word that a third of all fingerprints hold reaches its bucket as one row of numbers a chunk.

Defined results: a null text or one without words has fingerprint zero, linked like any other; a text with
fewer words than a shingle is one shingle; repeated rows give equal rows; a null doc_id is linked through its
fingerprint and never names a component (null only if no reachable row has an id); an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import common as C

WORDS, RADIUS, SEED = 4, 4, 42
#: Passes over the ball: what one of them shuffles is about an eighth of the ball's 16 bytes a word and holder.
SLICES = 16
#: Fingerprints whose words are sorted together, and words to a bucket.
CHUNK, BUCKET = 16_384, 1 << 20
_U = np.uint64
_LOWER = bytes(C.LOWER)
_SOME = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    found = text.translate(_LOWER).split()  # splits at the six ASCII gaps
    if not found:
        return 0
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    last = ends[words - 1:] if len(found) >= words else ends[-1:]
    flat, digest = b" ".join(found), xxhash.xxh64_intdigest
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(last), _SOME):
        spans = zip(starts[at:at + _SOME].tolist(), last[at:at + _SOME].tolist())
        h = np.array([digest(flat[a:b], SEED) for a, b in spans], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(last), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fp = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in texts], dtype=_U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def ball(half: int) -> list[np.ndarray]:
    """The masks of at most ``half`` set bits, by code: the code of a word is the exclusive or of its set bits' numbers modulo ``SLICES``."""
    masks: list[list[int]] = [[] for _ in range(SLICES)]
    for k in range(half + 1):
        for bits in combinations(range(64), k):
            code = 0
            for b in bits:
                code ^= b % SLICES
            masks[code].append(sum(1 << b for b in bits))
    return [np.array(m, dtype=_U) for m in masks]


def codes(fp: np.ndarray) -> np.ndarray:
    """The code of every fingerprint, linear over exclusive or."""
    out = np.zeros(len(fp), dtype=np.int64)
    for j in range(SLICES.bit_length() - 1):
        held = _U(sum(1 << b for b in range(64) if (b % SLICES) >> j & 1))
        out |= (np.bitwise_count(fp & held).astype(np.int64) & 1) << j
    return out


def settled(key: np.ndarray, holder: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every key once with its least holder, in order, and the distinct links (least, other) among the holders."""
    order = np.argsort(key)
    key, holder = key[order], holder[order]
    head = np.ones(len(key), dtype=bool)
    head[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(head)
    if len(first) == len(key):
        return key, holder, key[:0], key[:0]
    least = np.minimum.reduceat(holder, first)
    mine = np.repeat(least, np.diff(np.append(first, len(key))))
    other = mine != holder
    pairs = np.unique(np.stack([mine[other], holder[other]], axis=1), axis=0)
    return key[first], least, pairs[:, 0], pairs[:, 1]


def slice_links(nodes: DataFrame, n: int, part: int, radius: int) -> DataFrame:
    """Links (a, b) of the fingerprints ``nodes`` (fp) that meet in a word of slice ``part`` of their balls."""
    masks = ball(radius // 2)
    buckets = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-n * len(masks[0]) // BUCKET))
    edges = np.array([-(-(j << 64) // buckets) for j in range(1, buckets)], dtype=_U)
    schema = "bucket int, links boolean, x binary, y binary"

    def blob(x: np.ndarray) -> pa.Array:
        return pa.array([x.tobytes()], type=pa.binary())

    def emit(batches):
        for batch in batches:
            every = batch.column(0).to_numpy().view(_U)
            for at in range(0, len(every), CHUNK):
                fp = every[at:at + CHUNK]
                code = codes(fp)
                words = [(f[:, None] ^ m[None, :]).ravel() for f, m in ((fp[code == c], masks[c ^ part]) for c in range(SLICES))]
                held = [np.repeat(f, len(m)) for f, m in ((fp[code == c], masks[c ^ part]) for c in range(SLICES))]
                key, holder, a, b = settled(C.mix(np.concatenate(words)), np.concatenate(held))
                cut = np.concatenate(([0], np.searchsorted(key, edges), [len(key)]))
                rows = [(j, False, key[lo:hi], holder[lo:hi]) for j, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if lo < hi]
                rows += [(int(a[0] % _U(buckets)), True, a, b)] if len(a) else []
                for j, linked, x, y in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([j], type=pa.int32()), pa.array([linked]), blob(x), blob(y)],
                                                     ["bucket", "links", "x", "y"])

    def meet(group: pa.Table) -> pa.Table:
        def column(name, linked):
            some = [v for v, k in zip(group.column(name).to_pylist(), group.column("links").to_pylist()) if k == linked]
            return np.concatenate([np.frombuffer(v, dtype=_U) for v in some] or [np.zeros(0, dtype=_U)])

        _, _, a, b = settled(column("x", False), column("y", False)) if not all(group.column("links").to_pylist()) else (0, 0, *np.zeros((2, 0), dtype=_U))
        a, b = np.concatenate([a, column("x", True)]), np.concatenate([b, column("y", True)])
        near = np.bitwise_count(a ^ b) <= radius
        return pa.table({"a": pa.array(a[near].view(np.int64)), "b": pa.array(b[near].view(np.int64))})

    return nodes.mapInArrow(emit, schema).groupBy("bucket").applyInArrow(meet, "a long, b long")


def near_fingerprints(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id reachable over fingerprints at most ``radius`` bits apart."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4: the ball of half of it is emitted whole")
    rows = C.stored(fingerprints(docs, words), "fingerprints")
    classes = C.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fp-classes")
    nodes = classes.select("fp")
    n = nodes.count()
    found = [C.stored(slice_links(nodes, n, part, radius).distinct(), "fp-links") for part in range(SLICES)] if n > 1 else []
    links = rows.sparkSession.createDataFrame([], "a long, b long")
    for f in found:
        links = links.union(f)
    comp = C.stored(C.components(links, "fp-cc"), "fp-comp")
    named = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("comp", "fp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = C.stored(named.join(least, "comp").select("fp", "component_id"), "fp-named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    near = near_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
