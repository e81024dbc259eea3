"""Mixing sources to target weights, with built-in functions only.

The words of each source form one stream, documents in a pseudorandom order.  The stream is packed into
blocks of a fixed length, ``block_words`` (lengths within a source differ by at most one word, so no block is short); a source
of fewer than ``min_blocks`` such blocks is cut into ``min_blocks`` shorter ones, as whole draws of few long blocks
would miss its target by up to half a block.
Every source has a number of draws that meets its target.  All draws are dealt over the slots of the
output shards by one pseudorandom permutation: the sources a shard receives are a multinomial draw
(without replacement, so totals are met exactly).  The per-shard counts number the slots of a source;
slot j takes block pi(j mod n) of epoch j div n, with pi a permutation of the source's n blocks of its
own per epoch, and blocks are joined by that index.  Permutations are swap-or-not shuffles: exact on any
length, computed per row, equal on reruns.

Scale: texts are read once for sizes.  Positions in a source's stream come from lanes (a hash of doc_id,
the square root of the row count in number) and one offset row per lane, so a source with a third of all
rows is spread over many lanes; draws are generated in bounded chunks, counted per shard before the shuffle, and meet blocks
in an equi-join on (source, block).  Per-source figures are one row per source.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, last
in order; a null doc_id is a document like others; rows repeated under one doc_id are separate
documents; sources without words have target 0; an empty table gives an empty table; other columns
are not read (``mixed_documents`` keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm import common as C

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS, MIN_BLOCKS, SHARD_SLOTS = 512, 400, 1024
CHUNK = 20_000
ROUNDS = 16


def size_of(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, C.GAP), "")), F.lit(0)).cast("long")


def shuffled(x: Column, n: Column, *seed) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 at x: per round, x and its mirror about a random point
    trade places or don't, by a bit that both of them compute."""
    def one(acc: Column, r: Column) -> Column:
        point = F.pmod(F.xxhash64(F.lit(11), r, *seed), n)
        mirror = F.pmod(point - acc, n)
        swap = F.xxhash64(F.lit(13), r, *seed, F.greatest(acc, mirror)).bitwiseAND(1) == 1
        return F.when(swap, mirror).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x.cast("long"), one)


def running(rows: DataFrame, key: str, lane: str, order: list, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of ``key`` before this one, lane by lane."""
    w = Window.partitionBy(key, lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("_in", F.sum(value).over(w) - F.col(value))
    lanes = rows.groupBy(key, lane).agg(F.sum(value).alias("_sum"))
    lw = Window.partitionBy(key).orderBy(lane).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lanes = lanes.withColumn("_before", F.sum("_sum").over(lw) - F.col("_sum")).drop("_sum")
    return inside.join(lanes, [key, lane]).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before")


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, sid, source_size, target) of rows (source, size): weights by code point order, null last;
    shares of the whole stop at ``repeats`` times a source, the excess going to the rest by weight."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    every = Window.partitionBy()
    by = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    rest = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return per.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rest)).select(
        "source", "sid", "source_size", "target")


def plan(sizes: DataFrame, block_words: int, min_blocks: int) -> DataFrame:
    """Targets with n (blocks), draws (block draws) and base (draws of the sources before)."""
    t = targets(sizes).filter("source_size > 0")
    length = F.least(F.lit(block_words).cast("double"), F.ceil(F.col("source_size") / min_blocks).cast("double"))
    t = t.withColumn("n", F.ceil(F.col("source_size") / length).cast("long"))
    draws = F.least(F.round(F.col("target") * F.col("n") / F.col("source_size")).cast("long"), F.col("n") * MAX_REPEATS)
    t = t.withColumn("draws", draws)
    w = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.withColumn("base", F.sum("draws").over(w) - F.col("draws")).withColumn("total", F.sum("draws").over(Window.partitionBy()))


def shard_slots(planned: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(sid, shard, j, epoch, block): every slot with its source's slot number and the block it takes."""
    parts = planned.filter("draws > 0").withColumn("c", F.explode(F.expr(f"sequence(0, cast((draws - 1) div {CHUNK} as int))")))
    parts = parts.repartition("sid", "c")
    dealt = parts.withColumn("k", F.explode(F.expr(f"sequence(cast(c as long) * {CHUNK}, least(draws, (cast(c as long) + 1) * {CHUNK}) - 1)")))
    slot = shuffled(F.col("base") + F.col("k"), F.col("total"), F.lit(seed))
    counts = dealt.select("sid", F.floor(slot / shard_slots).cast("long").alias("shard")).groupBy("sid", "shard").agg(
        F.count("*").alias("drawn"))
    counts = C.saved(counts, "counts")
    lane_shards = max(1, math.isqrt(counts.count()))
    counts = counts.withColumn("lane", F.floor(F.col("shard") / lane_shards))
    first = running(counts, "sid", "lane", ["shard"], "drawn", "first")
    slots = first.select("sid", "shard", F.explode(F.expr("sequence(first, first + drawn - 1)")).alias("j"))
    slots = slots.join(planned.select("sid", "n"), "sid")
    slots = slots.withColumn("epoch", F.floor(F.col("j") / F.col("n")).cast("long"))
    block = shuffled(F.pmod("j", "n"), F.col("n"), F.lit(seed), F.col("sid"), F.col("epoch"))
    return slots.select("sid", "shard", "j", "epoch", block.alias("block"))


def spans(rows: DataFrame, planned: DataFrame, order: list) -> DataFrame:
    """Rows with a size: the blocks they touch, as (row columns, sid, off, block, word, words)."""
    d = rows.join(planned.select(F.col("source").alias("_s"), "sid", "source_size", "n"), rows["source"].eqNullSafe(F.col("_s"))).drop("_s")
    d = running(d.filter("size > 0"), "sid", "lane", order, "size", "off")
    # block b holds the words [b * size / n, (b + 1) * size / n) of its source, rounded down
    edge = lambda b: f"({b} * cast(source_size as decimal(38, 0)) div n)"
    nth = "cast(((cast({0} as decimal(38, 0)) + 1) * n - 1) div source_size as long)"
    d = d.withColumn("b0", F.expr(nth.format("off"))).withColumn("b1", F.expr(nth.format("(off + size - 1)")))
    d = d.withColumn("block", F.explode(F.expr("sequence(b0, b1)")))
    d = d.withColumn("_from", F.greatest(F.expr(f"cast({edge('block')} as long)"), F.col("off")))
    d = d.withColumn("_to", F.least(F.expr(f"cast({edge('(block + 1)')} as long)"), F.col("off") + F.col("size")))
    return d.select(*rows.columns, "sid", "off", "block", (F.col("_from") - F.col("off")).alias("word"), (F.col("_to") - F.col("_from")).alias("words"))


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, source, size, lane) of every row, written once."""
    d = C.saved(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), *more), "sizes")
    lanes = max(1, math.isqrt(d.count()))  # as many lanes as rows in a lane, so that both stay small
    return d.withColumn("lane", F.pmod(F.xxhash64(F.lit(17), "doc_id", "size"), F.lit(lanes)))


def mix(rows: DataFrame, block_words: int, min_blocks: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of sized rows: the plan, the slots, and the rows' block pieces."""
    planned = C.saved(plan(rows, block_words, min_blocks), "plan")
    slots = shard_slots(planned, SHARD_SLOTS, seed)
    return planned, slots, spans(rows, planned, [F.xxhash64(F.lit(19), "doc_id"), "doc_id", "size"])


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS, min_blocks: int = MIN_BLOCKS, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    rows = sized(docs)
    goal = C.saved(targets(rows), "targets")
    _, slots, pieces = mix(rows, block_words, min_blocks, seed)
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    hit = pieces.join(times, ["sid", "block"], "left")
    used = hit.groupBy("sid", "off", "doc_id", "size").agg(
        F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    used = used.join(goal.drop("source"), "sid").select("doc_id", "size", "source_size", "target", "taken")
    none = rows.filter("size = 0").select("doc_id", "size", F.col("source").alias("_s"))
    none = none.join(goal, goal["source"].eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return used.union(none)


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, min_blocks: int = MIN_BLOCKS, seed: int = 1) -> DataFrame:
    """The documents as mixed: one row per run of consecutive drawn blocks of a document and epoch, with
    all columns; ``text`` holds the run's words with the white space between them (the whole text when
    all of it is drawn) and ``n_chars`` its length."""
    named = F.xxhash64("doc_id", "source", "text")
    rows = sized(docs.select("doc_id", "source", "text"), named.alias("rid"))
    _, slots, pieces = mix(rows, block_words, min_blocks, seed)
    hit = pieces.select("rid", "sid", "off", "size", "block", "word", "words").join(slots.select("sid", "block", "epoch"), ["sid", "block"])
    w = Window.partitionBy("sid", "off", "epoch").orderBy("word")
    hit = hit.withColumn("_new", F.when(F.col("word") == F.lag(F.col("word") + F.col("words")).over(w), 0).otherwise(1))
    hit = hit.withColumn("_run", F.sum("_new").over(w))
    runs = hit.groupBy("rid", "sid", "off", "epoch", "_run", "size").agg(F.min("word").alias("word"), F.sum("words").alias("words"))
    rid, held, parts, run = (C.fresh(docs, c) for c in ("rid", "runs", "parts", "run"))  # columns of docs may have any name
    runs = C.saved(runs.groupBy(F.col("rid").alias(rid)).agg(F.collect_list(F.struct("word", "words", "size")).alias(held)), "runs")
    again = C.saved(rows.groupBy(F.col("rid").alias(rid)).agg(F.count("*").alias("n")).filter("n > 1").select(rid), "again")
    d = docs.withColumn(rid, named)
    d = d.join(C.small(again), rid, "left_anti").unionByName(d.join(C.small(again), rid, "left_semi").dropDuplicates([rid]))
    d = d.join(runs, rid).drop(rid)
    d = d.withColumn(parts, F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + C.WORD), F.lit(0)))
    d = d.withColumn(run, F.explode(held))
    part = F.array_join(F.slice(parts, (F.col(f"{run}.word") + 1).cast("int"), F.col(f"{run}.words").cast("int")), "")
    d = d.withColumn("text", F.when(F.col(f"{run}.words") == F.col(f"{run}.size"), F.col("text")).otherwise(
        F.regexp_replace(part, "^" + C.GAP, "")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
