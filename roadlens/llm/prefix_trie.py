"""Conversation prefix trie by the Euler-tour technique.

Every conversation is rebuilt (``rebuilt``: the first turns of its group's first conversation, then its own
later turns) and its prefixes become the nodes of a trie.  A node's Euler tour has an enter and an exit arc;
every arc knows the next one.  The tour is ranked distributedly and sums of what stands at the enter arcs up to any
position follow from it: what a subtree holds is the difference of two of them.

Scale: order inside a conversation, prefixes and sibling links come from range-partitioned sorts with a carry
table of one row a partition, so neither a conversation, a node's members nor a node's children ever meet in one
task.  A prefix is named by depth and 128 bits (the exclusive or of its turns' MD5 values with their positions).
Arcs that follow each other along one conversation are contracted first (in blocks of depths), so the
pointer jumping runs over branches instead of turns; it takes log2 of their number rounds, each a join of
pointers alone, whose tables and shuffles are freed as it goes.  A node's member list is joined in chunks of an Arrow
batch and hashed as a stream (SHA-256 is sequential, so one task reads a node's chunks, at constant memory).

Defined results: a null conv_id takes no part; null role or text is empty; turns are ordered by turn (null first), then
role, then text, so repeated rows are turns of their own and row order never matters; ``%`` has the sign of its
dividend, as in SQL; a conversation left without turns ends at the root; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm import common as C

#: Depths of one conversation that are contracted together.
BLOCK = 1024
GROUP = 20
_KEY = ["d", "pa", "pb"]
_BEFORE = (Window.unboundedPreceding, -1)
EMPTY = hashlib.sha256(b"").hexdigest()


def half(hexed: Column, at: int) -> Column:
    """Sixteen hexadecimal digits as a signed long."""
    return F.conv(F.substring(hexed, at, 16), 16, -10).cast("long")


def ranged(df: DataFrame, keys: list, columns: list[str], tag: str) -> DataFrame:
    """``columns`` of ``df``, written in the order of ``keys``: ``part`` numbers its ranges, ``at`` rises with the order."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return C.stored(ordered.select(*columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), tag)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Add the number, from 1, of every row of a ``ranged`` table in its conversation."""
    spans = rows.groupBy("c", "part").agg(F.count("*").alias("n"))
    spread = spans.withColumn("k", F.count("*").over(Window.partitionBy("c"))).filter("k > 1")  # at most two a range
    carry = spread.select("c", "part", F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(*_BEFORE)).alias("before"))
    here = rows.withColumn("lo", F.min("at").over(Window.partitionBy("c", "part")))
    out = here.join(F.broadcast(carry), ["c", "part"], "left")
    return out.withColumn(name, F.col("at") - F.col("lo") + 1 + F.coalesce("before", F.lit(0))).drop("lo", "before")


def turns(convs: DataFrame) -> DataFrame:
    """(c, pos, words, turn): the turns in order, by a hash of role and text."""
    text, role = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("text", "role"))
    t = convs.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"), role.alias("role"), text.alias("text"),
                     F.monotonically_increasing_id().alias("row")).filter("c is not null")
    t = t.withColumn("words", F.regexp_count("text", F.lit(C.WORD)).cast("long"))
    t = t.withColumn("turn", F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))
    return numbered(ranged(t, ["c", "t", "role", "text", "row"], ["c", "words", "turn"], "turns"), "pos").select("c", "pos", "words", "turn")


def rebuilt(own: DataFrame, ids: DataFrame) -> DataFrame:
    """The rebuilt conversations' turns: (c, late, pos, words, turn); first the head's, then the own ones."""
    taken = (F.crc32(F.col("c").cast("string")) % 4).alias("h")
    own_late = own.withColumn("h", taken).filter("pos > h").select("c", F.lit(True).alias("late"), "pos", "words", "turn")
    heads = own.filter(f"pos <= 3 and c % {GROUP} = 0").withColumnRenamed("c", "b")
    heads = heads.withColumn("off", F.explode(F.sequence(F.lit(1 - GROUP), F.lit(GROUP - 1)))).withColumn("c", F.expr("try_add(b, off)"))
    heads = heads.filter(f"c - c % {GROUP} = b").withColumn("h", taken).filter("pos <= h").join(ids, "c", "left_semi")
    return own_late.unionByName(heads.select("c", F.lit(False).alias("late"), "pos", "words", "turn"))


def prefixes(turns_: DataFrame) -> DataFrame:
    """(c, d, words, pa, pb, qa, qb): every prefix of d turns by name, with its parent's name."""
    rows = numbered(ranged(turns_, ["c", "late", "pos"], ["c", "words", "turn"], "rebuilt"), "d")
    z = F.md5(F.concat(F.col("d").cast("string"), F.lit(":"), "turn"))
    rows = C.stored(rows.select("c", "part", "at", "d", "words", half(z, 1).alias("za"), half(z, 17).alias("zb")), "named-turns")
    totals = rows.groupBy("c", "part").agg(F.bit_xor("za").alias("ta"), F.bit_xor("zb").alias("tb"))
    spread = totals.withColumn("k", F.count("*").over(Window.partitionBy("c"))).filter("k > 1")
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(*_BEFORE)
    carry = spread.select("c", "part", *[F.bit_xor(t).over(earlier).alias(t) for t in ("ta", "tb")])
    sofar = Window.partitionBy("c", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"xa": F.bit_xor("za").over(sofar), "xb": F.bit_xor("zb").over(sofar)})
    rows = rows.join(F.broadcast(carry), ["c", "part"], "left")
    for x in "ab":
        rows = rows.withColumn(f"p{x}", F.col(f"x{x}").bitwiseXOR(F.coalesce(f"t{x}", F.lit(0).cast("long"))))
        rows = rows.withColumn(f"q{x}", F.col(f"p{x}").bitwiseXOR(F.col(f"z{x}")))
    return C.stored(rows.select("c", "d", "words", "pa", "pb", "qa", "qb"), "prefixes")


def end_hashes(ends: DataFrame) -> DataFrame:
    """(d, pa, pb, sha): of the nodes (d, pa, pb) that conversations c end at, the hash of their joined ids in order."""
    kinds = "d long, pa long, pb long"

    def changes(batch) -> np.ndarray:
        cols = [batch.column(i).to_numpy() for i in range(3)]
        head = np.ones(batch.num_rows, dtype=bool)
        head[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        return np.flatnonzero(head)

    def joined(batches):
        for batch in batches:
            first = changes(batch)
            ids = [str(x) for x in batch.column(3).to_pylist()]
            lists = [",".join(ids[a:b]) for a, b in zip(first, [*first[1:], len(ids)])]
            heads = batch.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(lists, type=pa.string())], ["d", "pa", "pb", "c", "ids"])

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for *k, _, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            yield rows(done)
        if key:
            yield rows([(*key, state.hexdigest())])

    def rows(done):
        cols = list(zip(*done)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()])], ["d", "pa", "pb", "sha"])

    order = [*_KEY, "c"]
    chunks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, f"{kinds}, c long, ids string")
    return chunks.repartition(*_KEY).sortWithinPartitions(*order).mapInArrow(hashed, f"{kinds}, sha string")


def nodes_of(members: DataFrame, ids: DataFrame) -> DataFrame:
    """The trie's nodes: (d, pa, pb, c, n_convs, words, qa, qb, n_children, sha); c is the least member."""
    nodes = members.groupBy(*_KEY).agg(F.min("c").alias("c"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
                                       F.max("qa").alias("qa"), F.max("qb").alias("qb"))
    zero = F.lit(0).cast("long")
    root = ids.agg(F.min("c").alias("c"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    nodes = C.stored(nodes.unionByName(root.withColumns({x: zero for x in (*_KEY, "words", "qa", "qb")})), "nodes")
    last = members.groupBy("c").agg(F.max(F.struct("d", "pa", "pb")).alias("x"))
    ends = ids.join(last, "c", "left").select("c", *[F.coalesce(f"x.{k}", zero).alias(k) for k in _KEY])
    below = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(
        F.count("*").alias("n_children"))
    out = nodes.join(below, _KEY, "left").join(end_hashes(ends), _KEY, "left")
    return C.stored(out.fillna({"n_children": 0, "sha": EMPTY}), "whole-nodes")


def family(nodes: DataFrame) -> DataFrame:
    """Every node (c, d) with its least child, its next sibling and its parent, by their c."""
    child = nodes.filter("d > 0").select((F.col("d") - 1).alias("d"), F.col("qa").alias("pa"), F.col("qb").alias("pb"), F.lit(1).alias("kind"), "c")
    both = ranged(nodes.select(*_KEY, F.lit(0).alias("kind"), "c").union(child), [*_KEY, "kind", "c"], [*_KEY, "kind", "c"], "family")
    self = F.struct(*_KEY, "c").alias("x")
    w, parts = Window.partitionBy("part").orderBy("at"), Window.orderBy("part")  # ``edge`` has one row a range
    edge = both.groupBy("part").agg(F.min_by(F.struct(*_KEY, "c"), "at").alias("x"), F.max_by("c", F.when(F.col("kind") == 0, F.col("at"))).alias("top"))
    edge = edge.select("part", F.lead("x").over(parts).alias("after"), F.last("top", True).over(parts.rowsBetween(*_BEFORE)).alias("carried"))
    rows = both.select("part", "at", *_KEY, "kind", "c", F.lead(self).over(w).alias("then"), F.last(F.when(F.col("kind") == 0, F.col("c")), True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)).alias("top")).join(F.broadcast(edge), "part")
    nxt = F.coalesce("then", "after")
    same = (nxt["d"] == F.col("d")) & (nxt["pa"] == F.col("pa")) & (nxt["pb"] == F.col("pb"))
    rows = C.stored(rows.select("kind", "c", (F.col("d") + F.col("kind")).alias("d"), F.when(same, nxt["c"]).alias("next"),
                                F.coalesce("top", "carried").alias("top")), "links")
    down = rows.filter("kind = 0").select("c", "d", F.col("next").alias("child"))
    side = rows.filter("kind = 1").select("c", "d", F.col("next").alias("sibling"), F.col("top").alias("parent"))
    return down.join(side, ["c", "d"], "left")


def arcs_of(tree: DataFrame) -> DataFrame:
    """The tour: arc (c, e) with e = 2 * depth, 1 more for an exit; the next arc (nc, ne); what stands at it; its segment's first arc
    (c, he) and the segment's sums up to it."""
    enter = F.struct((2 * F.col("d")).alias("e"), F.coalesce("child", "c").alias("nc"), F.when(
        F.col("child").isNull(), 2 * F.col("d") + 1).otherwise(2 * F.col("d") + 2).alias("ne"), "leaves", "saved")
    leave = F.struct((2 * F.col("d") + 1).alias("e"), F.coalesce("sibling", "parent").alias("nc"), F.when(
        F.col("sibling").isNotNull(), 2 * F.col("d")).when(F.col("parent").isNotNull(), 2 * F.col("d") - 1).alias("ne"),
        F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    arcs = tree.select("c", "d", F.floor(F.col("d") / BLOCK).alias("block"), F.explode(F.array(enter, leave)).alias("x")).select("c", "d", "block", "x.*")
    w = Window.partitionBy("c", "block").orderBy(F.col("e") % 2, F.when(F.col("e") % 2 == 0, F.col("e")).otherwise(-F.col("e")))
    follows = (F.lag("nc").over(w) == F.col("c")) & (F.lag("ne").over(w) == F.col("e"))
    arcs = arcs.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    arcs = arcs.withColumns({"seg": F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "o": F.row_number().over(w)})
    run = Window.partitionBy("c", "block", "seg").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"steps": F.count("*").over(run), "leaves_to": F.sum("leaves").over(run), "saved_to": F.sum("saved").over(run)}
    return C.stored(arcs.withColumns({"he": F.first("e").over(run), **sums}).select(
        "c", "d", "e", "nc", "ne", "he", "leaves", "saved", *sums), "arcs")


def ranked(arcs: DataFrame) -> DataFrame:
    """(c, he, steps, leaves, saved) of every segment: the sums from its first arc to the tour's end, by pointer jumping."""
    tail = F.max_by(F.struct("nc", "ne"), "steps").alias("x")
    now = C.stored(arcs.groupBy("c", "he").agg(F.max("steps").alias("steps"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), tail)
                   .select("c", "he", "x.nc", "x.ne", "steps", "leaves", "saved"), "ranks")
    while not now.filter("nc is not null").isEmpty():
        ahead = now.select(F.col("c").alias("nc"), F.col("he").alias("ne"), *[F.col(x).alias(f"_{x}") for x in ("nc", "ne", "steps", "leaves", "saved")])
        step = now.filter("nc is not null").join(ahead, ["nc", "ne"]).select(
            "c", "he", F.col("_nc").alias("nc"), F.col("_ne").alias("ne"), *[(F.col(x) + F.col(f"_{x}")).alias(x) for x in ("steps", "leaves", "saved")])
        then = C.stored(step.unionByName(now.filter("nc is null")), "ranks")
        C.free(now)
        now = then
    return now


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the places of its enter and exit arc in the tour."""
    own = C.stored(turns(convs), "ordered-turns")
    ids = C.stored(own.select("c").distinct(), "conv-ids")
    members = prefixes(rebuilt(own, ids))
    nodes = nodes_of(members, ids)
    tree = family(nodes)
    weights = nodes.select("c", "d", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
                           ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    tree = C.stored(tree.join(weights, ["c", "d"]), "tree")
    arcs = arcs_of(tree)
    rank = ranked(arcs)
    total = rank.agg(F.max("steps")).first()[0] or 0
    rest = rank.select("c", "he", *[F.col(x).alias(f"{x}_from") for x in ("steps", "leaves", "saved")])
    at = {x: F.col(f"{x}_to") - F.col(f"{x}_from") for x in ("leaves", "saved")} | {"steps": F.col("steps") - F.col("steps_from") + F.lit(total)}
    spots = arcs.join(rest, ["c", "he"]).select("c", "d", (F.col("e") % 2).alias("leaving"), "leaves", "saved", *[v.alias(f"{x}_at") for x, v in at.items()])

    def between(x: str) -> Column:
        return F.sum(F.when(F.col("leaving") == 1, F.col(f"{x}_at")).otherwise(F.col(x) - F.col(f"{x}_at")))

    held = spots.groupBy("c", "d").agg(between("leaves").alias("n_leaves"), between("saved").alias("saved_tokens"),
                                       F.min("steps_at").alias("enter_at"), F.max("steps_at").alias("exit_at"))
    out = nodes.select("c", "d", "n_convs", "n_children", "sha").join(held, ["c", "d"]).join(tree.select("c", "d", "parent"), ["c", "d"])
    return out.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                      "n_leaves", "saved_tokens", F.col("sha").alias("ends_sha256"), "enter_at", "exit_at")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("enter_at", "exit_at")


OP11_SQL = r"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 4 AS h
  FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY late, pos) AS d, role, text FROM (
  SELECT ids.c, 0 AS late, pos, role, text FROM ids JOIN o ON o.c = ids.c - ids.c % 20 WHERE pos <= h
  UNION ALL SELECT c, 1, pos, role, text FROM o JOIN ids USING (c) WHERE pos > h)),
m AS (SELECT c, d, text, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY d)) AS p
  FROM r UNION ALL SELECT c, 0, '', 'root' FROM ids),
l AS (SELECT c, max(d) AS d FROM m GROUP BY c),
n AS (SELECT m.d, m.p, min(m.c) AS c, count(*) AS n_convs, max(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words,
  sha256(coalesce(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) FILTER (WHERE l.d = m.d), '')) AS ends
  FROM m JOIN l USING (c) GROUP BY m.d, m.p),
up AS (SELECT n.c, n.d, q.c AS parent, q.d AS pd FROM n JOIN m ON m.c = n.c AND m.d = n.d - 1 JOIN n q ON q.d = m.d AND q.p = m.p),
kids AS (SELECT parent AS c, pd AS d, count(*) AS k FROM up GROUP BY ALL),
s AS (SELECT m.d, m.p, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n_convs - 1) * x.words) AS saved
  FROM n x LEFT JOIN kids ON kids.c = x.c AND kids.d = x.d JOIN m ON m.c = x.c AND m.d <= x.d GROUP BY m.d, m.p)
SELECT n.c AS conv_id, n.d AS depth, up.parent AS parent_conv_id, n_convs, coalesce(kids.k, 0) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM n JOIN s USING (d, p) LEFT JOIN up ON up.c = n.c AND up.d = n.d LEFT JOIN kids ON kids.c = n.c AND kids.d = n.d
"""
