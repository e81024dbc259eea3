"""Helpers shared by the corpus operators: written intermediate tables, vectorised word hashes and
distributed grouping of linked nodes.

Intermediate tables are Parquet folders below ``spark.checkpoint.dir`` (shared by all executors), so
a lost executor costs a re-read, never a recomputation from the start, and lineage stays short.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.session import ensure_checkpoint_dir

#: Words are runs of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: White space in a line that is not one space already.
UNEVEN = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"

#: A side of a join is broadcast only below this many rows (two longs each, 16 MB); beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000
#: The same for links, their least neighbours and open candidates (4 MB): several of them are held at a time.
BROADCAST_LINKS = 250_000


_noted: list[list[str]] = []


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a fresh folder in the shared checkpoint folder and read it back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/corpus-{tag}-{uuid.uuid4().hex}"
    for notes in _noted:
        notes.append(path)
    df.write.option("compression", "zstd").parquet(path)  # texts take far less room than by the default
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noted():
    """The folders of all tables that are written inside the block."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def _remove(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_unused(paths: list[str], *read: DataFrame) -> list[str]:
    """Remove the tables below ``paths`` that none of the frames ``read`` is made from; returns the others."""
    used = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in read for f in df.inputFiles()}
    kept = [p for p in paths if p.rsplit("/", 1)[1] in used]
    for p in paths:
        if read and p not in kept:
            _remove(read[0].sparkSession, p)
    return kept


#: Frees a query's shuffle files when it ends; a written table doesn't need them any more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """As ``saved``; the shuffle files behind the table are freed once it stands."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return saved(df, tag)
    finally:
        conf.set(_CLEANUP, before)


def free(*tables: DataFrame) -> None:
    """Remove tables that ``saved`` or ``stored`` wrote and that no later query reads."""
    for t in tables:
        for name in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if name.rsplit("/", 1)[1].startswith("corpus-"):
                _remove(t.sparkSession, name)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table of two long columns for broadcast when it is counted to be small."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --- vectorised words ---------------------------------------------------------------------------

_U = np.uint64
_GAP_BYTE = np.zeros(256, dtype=bool)
_GAP_BYTE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, _CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            t = np.full(size, base, dtype=_U)
            t[0] = 1
            _tables[name] = np.cumprod(t, dtype=_U)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (shift-xor-multiply rounds)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _chunk_words(data: np.ndarray, bounds: np.ndarray, lower: bool):
    """Word hashes, byte starts and byte ends in ``data``; a word never crosses one of ``bounds``."""
    n = len(data)
    gap = _GAP_BYTE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    opens, closes = edge[:-1].copy(), edge[1:].copy()
    opens[1:] |= gap[:-1]
    closes[:-1] |= gap[1:]
    word = ~gap
    starts = np.flatnonzero(word & opens)
    ends = np.flatnonzero(word & closes) + 1
    return span_names(LOWER[data] if lower else data, starts, ends), starts, ends


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span."""
    n = len(data)
    up, down = powers(n + 1)
    acc = np.empty(n + 1, dtype=_U)
    acc[0] = 0
    np.cumsum(data.astype(_U) * up[:n] + up[:n], dtype=_U, out=acc[1:])
    h = (acc[ends] - acc[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)))


def _long_words(data: np.ndarray, lower: bool):
    """As ``_chunk_words`` for one long text, cut at gaps into pieces of about a chunk."""
    parts, at = [], 0
    while at < len(data):
        to = min(at + _CHUNK, len(data))
        while to < len(data) and not _GAP_BYTE[data[to]]:
            more = np.flatnonzero(_GAP_BYTE[data[to:to + _CHUNK]])
            to = to + int(more[0]) if len(more) else min(to + _CHUNK, len(data))
        h, s, e = _chunk_words(data[at:to], np.array([0, to - at]), lower)
        parts.append((h, s + at, e + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts))


def text_words(texts: pa.Array, lower: bool = False):
    """Yield (first row, row bounds in words, hashes, byte starts, byte ends, bytes) for runs of rows
    of about a megabyte; ``bounds[i]:bounds[i + 1]`` are the words of row ``first + i``.  A null is an
    empty text.  Memory follows the chunk (or the longest single text), not the batch."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    n = len(texts)
    if n == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, raw = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + _CHUNK, side="right")) - 1)
        data = raw[off[first]:off[last]]
        edges = off[first:last + 1] - off[first]
        h, s, e = _chunk_words(data, edges, lower) if len(data) <= 2 * _CHUNK else _long_words(data, lower)
        yield first, np.searchsorted(s, edges), h, s, e, data
        first = last


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One Arrow list per array."""
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if flat.dtype == _U else flat, type=kind))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order (numpy's own way hashes first, which takes far longer on names that share bits)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))[:len(x)]]


# --- groups of linked nodes ---------------------------------------------------------------------

def components(links: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, comp): the smallest node reachable over ``links`` (a, b), for nodes that have a link.

    Alternating large-star / small-star rounds: every round is a min per node (combined before the
    shuffle) and a join, both spread over nodes, and the edges are written between rounds.  Stars stay
    as they are, a chain of n nodes takes about log n rounds.
    """
    def written(edges: DataFrame) -> tuple[DataFrame, tuple]:
        edges = stored(edges.filter("u <> v").distinct(), tag)
        return edges, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()

    edges, now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while now[0]:
        before, earlier = now, edges
        few = F.broadcast if now[0] <= BROADCAST_LINKS else (lambda d: d)  # a least neighbour per node: no more rows than edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(few(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        little = large.join(few(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, now = written(little.union(least.select("u", F.col("m").alias("v"))))
        free(earlier)
        if now == before:
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return found.union(found.select("comp", "comp").distinct())


def similar(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) whose sets hold 100 * intersection >= pct * union, by exact counts."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("xa"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("xb"))
    joined = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return joined.select("a", "b", common.alias("i"), F.size("xa").alias("p"), F.size("xb").alias("q")).filter(
        F.lit(100) * F.col("i") >= F.lit(pct) * (F.col("p") + F.col("q") - F.col("i"))).select("a", "b")


def shared_keys(rows: DataFrame, tag: str) -> DataFrame:
    """(key, lo): keys of (key, node) rows that two or more different nodes hold, with the least node."""
    return saved(rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
                 .filter("lo < hi").select("key", "lo"), tag)


#: Keys that are sorted together before they travel, and keys to a bucket.
PACK, PACK_BUCKET = 1 << 20, 1 << 20


def packed_members(rows: DataFrame, n: int, tag: str, make=None) -> DataFrame:
    """(key, node, lo, n), written: of ``rows`` (node, keys array<long>; about ``n`` keys in all), or of what ``make`` turns batches of
    ``rows`` into, every key that different nodes hold, with its nodes; ``lo`` is one of the key's nodes, at most the node itself, and ``n`` counts them (at least;
    a batch counts 200 at most).

    Keys travel sorted, as packed arrays.  A batch settles its own keys first and sends one node a key, so a key that a
    third of all rows hold reaches its bucket as one number a batch.
    """
    buckets = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PACK_BUCKET))
    edges = np.array([-(-(j << 64) // buckets) for j in range(1, buckets)], dtype=_U)
    names = ["key", "node", "lo", "n"]

    def unlike(key: np.ndarray, node: np.ndarray):
        """Sorted distinct (key, node), and where every key begins."""
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        return key, node, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[:len(key)]), order[new]

    def cut(key, *columns, held: bool):
        at = np.concatenate(([0], np.searchsorted(key, edges), [len(key)]))
        for j, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
            if lo < hi:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([j], type=pa.int32()), pa.array([held]), *[pa.array([c[lo:hi].tobytes()], type=pa.binary()) for c in (key, *columns)]],
                    ["bucket", "held", "key", "node", "more"])

    def flush(keys, nodes):
        key, node, first, _ = unlike(np.concatenate(keys), np.concatenate(nodes))
        count = np.diff(np.append(first, len(key)))
        many = np.repeat(count > 1, count)
        lo = np.repeat(node[first], count)
        yield from cut(key[first], node[first], np.minimum(count, 200).astype(np.uint8), held=False)
        yield from cut(key[many], node[many], lo[many], held=True)

    def emit(batches):
        keys, nodes, size = [], [], 0
        for batch in make(batches) if make else batches:
            lists = batch.column(1)
            each = np.diff(lists.offsets.to_numpy())
            keys.append(lists.flatten().to_numpy().view(_U))
            nodes.append(np.repeat(batch.column(0).to_numpy(), each))
            size += len(keys[-1])
            if size >= PACK:
                yield from flush(keys, nodes)
                keys, nodes, size = [], [], 0
        if size:
            yield from flush(keys, nodes)

    def meet(table: pa.Table) -> pa.Table:
        held = np.array(table.column("held").to_pylist())

        def column(name, which, kind=np.int64):
            return np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x, k in zip(table.column(name), held) if k == which] or [np.zeros(0, dtype=kind)])

        key, node, first, kept = unlike(column("key", False, _U), column("node", False))
        sent, count = column("key", False, _U), column("more", False, np.uint8)
        heads = key[first]
        total = np.zeros(len(heads), dtype=np.int64)
        np.add.at(total, np.searchsorted(heads, sent), count)
        runs = np.diff(np.append(first, len(key)))
        many = np.repeat(runs > 1, runs)
        own = column("key", True, _U)
        out = [np.concatenate([key[many], own]).view(np.int64), np.concatenate([node[many], column("node", True)]),
               np.concatenate([np.repeat(node[first], runs)[many], column("more", True)]),
               np.concatenate([np.repeat(total, runs)[many], total[np.searchsorted(heads, own)]])]
        return pa.table([pa.array(x) for x in out], names=names)

    sent = (rows if make else rows.select("node", "keys")).mapInArrow(emit, "bucket int, held boolean, key binary, node binary, more binary")
    return stored(sent.groupBy("bucket").applyInArrow(meet, "key long, node long, lo long, n long"), f"{tag}-members")


#: Representatives of a key that its nodes are compared with, after each of two rounds.
KEY_REPS = (3, 12)


def several(members: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of ``members`` whose keys hold nodes of several components, with ``comp``."""
    placed = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    span = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return placed.drop("lo").join(span, "key", "left_semi").select("key", "node", "n", "comp").distinct()


def linked_groups(members: DataFrame, sets_of, pct: int, tag: str, near=similar, items=None, may=None) -> DataFrame:
    """(node, comp) for nodes linked by set similarity; every candidate pair shares a key of ``members``.

    ``members``: as ``packed_members`` gives them (removed in the end); ``sets_of(nodes)``: (node, items array<long>,
    distinct), or rows of another form that ``near`` compares as ``similar`` does and ``items`` turns into sets.  ``may(nodes)``, if
    given, makes a function that leaves out pairs which a bound rules out; sets are then made for the other pairs' nodes alone.
    No bucket is expanded into its pairs.  Each node is first verified against one node it
    shares a key with, and keys of just two nodes are settled so; linked nodes become components.
    Where a key still holds several components, its nodes are verified against representatives of it in other components, in
    rounds of ``KEY_REPS``, which settles keys of no more nodes than that.  Nodes of larger keys that hold several components even then go on to their rarest items (prefix filter): a few
    representatives per item merge most components, and every pair of different components that may
    still link is verified, so none is lost.
    """
    nodes = stored(members.select("node").distinct(), f"{tag}-nodes")
    whole = None if may else stored(sets_of(nodes), f"{tag}-sets")
    bound = may(nodes) if may else None

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, written."""
        if not may:
            return stored(near(pairs.distinct(), whole, pct), f"{tag}-links")
        left = stored(bound(pairs.distinct()), f"{tag}-may")
        if left.isEmpty():
            return left
        ends = stored(left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), f"{tag}-ends")
        own = stored(sets_of(ends), f"{tag}-sets")
        links = stored(near(left, own, pct), f"{tag}-links")
        free(left, ends, own)
        return links

    first = members.filter("node <> lo").groupBy("node").agg(F.min("lo").alias("b")).select(F.col("node").alias("a"), "b")
    two = members.filter("n = 2 and node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    links = verified(first.union(two))
    comp = stored(components(links, f"{tag}-cc"), f"{tag}-comp")
    open_ = stored(several(members.filter("n > 2"), comp), f"{tag}-open")
    free(members)
    for low, high in zip((0, *KEY_REPS[:-1]), KEY_REPS):  # a few merge most components, the others meet what is still apart
        numbered = open_.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))).filter(F.col("r") <= high)
        reps = numbered.filter(F.col("r") > low).select("key", F.col("node").alias("rep"), F.col("comp").alias("other"))
        new = open_.join(reps, "key").filter("comp <> other").select(F.greatest("node", "rep").alias("a"), F.least("node", "rep").alias("b"))
        new = verified(new)
        if not new.isEmpty():
            links = stored(links.union(new), f"{tag}-links")
            comp = stored(components(links, f"{tag}-cc"), f"{tag}-comp")
            open_ = stored(several(open_.drop("comp"), comp), f"{tag}-open")
    # keys of no more nodes than representatives are settled now
    still = stored(open_.filter(F.col("n") > KEY_REPS[-1]).select("node").distinct(), f"{tag}-still")
    free(links, open_)
    if still.isEmpty():
        free(*([] if may else [whole]))
        return comp
    sets = whole.join(still, "node", "left_semi") if not may else stored(sets_of(still), f"{tag}-sets")
    head = rare_items(still, items(sets) if items else sets, pct, tag)
    rows = stored(head.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), f"{tag}-placed")
    stars = star_pairs(rows, pct, 0)
    for turn in range(1, STAR_TURNS):
        stars = stars.union(star_pairs(rows, pct, turn))
    for pairs in (lambda r: stars, lambda r: mixed_pairs(r, pct)):
        new = verified(pairs(rows))
        if not new.isEmpty():
            comp = stored(components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(new), f"{tag}-cc"), f"{tag}-comp")
            rows = head.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    free(sets if may else whole, head)
    return comp


#: Representatives of a rare item that its nodes are compared with before what is left is compared pair by pair.
STAR_TURNS = 3
_PARITY = [f"s{j}" for j in range(8)]


def rare_items(nodes: DataFrame, sets: DataFrame, pct: int, tag: str) -> DataFrame:
    """(item, node, n, pos, s0 .. s7), written: the rarest items of every node that others hold as well.

    Items are ordered by how few of the nodes hold them.  Two sets over the threshold share an item
    among the first (1 - t) of each.  s0 .. s7 hold one bit per item, by parity: two sets differ in at
    least as many items as these words differ in bits.
    """
    held = sets.join(nodes, "node").select("node", F.size("items").alias("n"), F.explode("items").alias("item"))
    held = stored(held, f"{tag}-held")
    seen = held.groupBy("item").agg(F.count("*").alias("freq")).filter("freq > 1")
    flip = F.expr("shiftleft(1L, cast(item & 63 as int))")
    parity = [F.bit_xor(F.when(F.expr("shiftright(item, 6) & 7") == j, flip).otherwise(F.lit(0).cast("long"))).alias(f"s{j}")
              for j in range(8)]
    order = held.join(seen, "item", "left").groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(1)).alias("freq"), "item"))).alias("o"), *parity)
    lead = F.expr(f"slice(o, 1, int(n - ceil(n * {pct} / 100.0)) + 1)")
    head = order.select("node", "n", *_PARITY, F.posexplode(lead).alias("pos", "x")).filter("x.freq > 1")
    return stored(head.select(F.col("x.item").alias("item"), "node", "n", "pos", *_PARITY), f"{tag}-head")


def may_link(a, b, pct: int):
    """Whether two rows of ``rare_items`` in different components may reach ``pct``: at their first shared
    item at least t / (1 + t) of both sizes must lie ahead, and the sets differ in at most
    (1 - t) / (1 + t) of both sizes."""
    ahead = F.least(a("n") - a("pos"), b("n") - b("pos"))
    both = a("n") + b("n")
    apart = sum((F.bit_count(a(w).bitwiseXOR(b(w))) for w in _PARITY), F.lit(0))
    return ((a("comp") != b("comp")) & (F.lit(100 + pct) * ahead >= F.lit(pct) * both)
            & (F.lit(100 + pct) * apart <= F.lit(100 - pct) * both))


def star_pairs(rows: DataFrame, pct: int, turn: int) -> DataFrame:
    """Pairs (a, b) of each node with the representative of the rare items that it shares with other components."""
    row = F.struct("node", "comp", "n", "pos", *_PARITY)
    reps = rows.groupBy("item").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                    F.min_by(row, F.xxhash64("node", F.lit(turn))).alias("rep")).filter("lo < hi")
    near = rows.join(reps.select("item", "rep"), "item").filter(may_link(F.col, lambda c: F.col(f"rep.{c}"), pct))
    return near.select(F.col("node").alias("a"), F.col("rep.node").alias("b"))


def mixed_pairs(rows: DataFrame, pct: int) -> DataFrame:
    """All pairs of different components that share a rare item and may reach ``pct``: nothing is left out."""
    mixed = rows.groupBy("item").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("item")
    rows = rows.join(mixed, "item", "left_semi")
    names = ("node", "comp", "n", "pos", *_PARITY)
    a = rows.select("item", *[F.col(c).alias(f"{c}_a") for c in names])
    b = rows.select("item", *[F.col(c).alias(f"{c}_b") for c in names])
    cond = (a["item"] == b["item"]) & (F.col("node_a") < F.col("node_b")) & may_link(
        lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"), pct)
    return a.join(b, cond).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
