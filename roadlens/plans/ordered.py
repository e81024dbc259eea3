"""Ordered computations that stay partitioned at scale.

An unpartitioned window (``Window.orderBy(t)``) runs in one task.  The helpers here
split the order column into range buckets: each bucket is windowed on its own and
the running offset of every bucket comes from a tiny per-bucket table (one row per
bucket), so the work is spread over (partition key, bucket) tasks and a hot key
is cut into many buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.session import scratch_table


def running_sums(df: DataFrame, part: list[str], order: str, values: list[str], bucket: Column,
                 inclusive: bool = True, prefix: str = "cum_") -> DataFrame:
    """Add ``prefix + v`` = running sum of v over ``order`` within ``part`` (inclusive or exclusive).

    Rows must be unique on (part, order) for the result to be order-stable.
    """
    b = "_rb"
    d = df.withColumn(b, bucket)
    lo = Window.unboundedPreceding
    w_local = Window.partitionBy(*part, b).orderBy(order).rowsBetween(lo, 0 if inclusive else -1)
    local = d.withColumns({f"_l_{v}": F.coalesce(F.sum(v).over(w_local), F.lit(0)) for v in values})
    totals = d.groupBy(*part, b).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    w_b = Window.partitionBy(*part).orderBy(b).rowsBetween(lo, -1)
    offsets = totals.select(*part, b, *[F.coalesce(F.sum(f"_t_{v}").over(w_b), F.lit(0)).alias(f"_o_{v}")
                                        for v in values])
    out = local.join(offsets, [*part, b])
    return out.select(*df.columns, *[(F.col(f"_o_{v}") + F.col(f"_l_{v}")).alias(prefix + v) for v in values])


def dense_index(df: DataFrame, part: list[str], order: list[str], bucket: Column, name: str = "idx") -> DataFrame:
    """1-based position of each row within ``part`` ordered by ``order`` (rows unique on part+order);
    ``bucket`` must be non-decreasing in the order."""
    b = "_ib"
    d = df.withColumn(b, bucket)
    local = d.withColumn("_li", F.row_number().over(Window.partitionBy(*part, b).orderBy(*order)))
    counts = d.groupBy(*part, b).agg(F.count("*").alias("_n"))
    w_b = Window.partitionBy(*part).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, b, F.coalesce(F.sum("_n").over(w_b), F.lit(0)).alias("_off"))
    return local.join(offsets, [*part, b]).select(*df.columns, (F.col("_off") + F.col("_li")).alias(name))


def trailing_frame(df: DataFrame, part: list[str], idx: str, aggs: dict[str, tuple[Column, int, int]],
                   block: int = 4096) -> DataFrame:
    """Row-frame aggregates over a dense index ``idx`` per ``part``; ``aggs`` maps output name ->
    (aggregate Column, lo, hi) for ``rowsBetween(lo, hi)`` with lo <= 0 <= hi.

    Work is split per block of ``block`` rows; each block also receives the rows of its
    neighbours that its frames reach (a halo), so a key holding a third of all rows is
    still many tasks, and the result equals the single-partition window exactly.
    """
    back = max([-lo for _, lo, _ in aggs.values()] + [0])
    ahead = max([hi for _, _, hi in aggs.values()] + [0])
    blk = max(block, back, ahead, 1)
    pos = (F.col(idx) - 1) % blk
    own = df.withColumn("_blk", F.floor((F.col(idx) - 1) / blk)).withColumn("_own", F.lit(True))
    parts = [own]
    if back > 0:
        parts.append(own.filter(pos >= blk - back).withColumn("_blk", F.col("_blk") + 1).withColumn("_own", F.lit(False)))
    if ahead > 0:
        parts.append(own.filter(pos < ahead).withColumn("_blk", F.col("_blk") - 1).withColumn("_own", F.lit(False)))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    base = Window.partitionBy(*part, "_blk").orderBy(idx)
    out = both.withColumns({k: a.over(base.rowsBetween(lo, hi)) for k, (a, lo, hi) in aggs.items()})
    return out.filter("_own").drop("_blk", "_own")


def asof_latest(left: DataFrame, right: DataFrame, by: list[str], ts: str, cols: list[str],
                tie: str | None = None, ranges: int | None = None) -> DataFrame:
    """For every left row, the values of the latest right row with the same ``by`` key and
    right.ts <= left.ts (unbounded look-back); of right rows at one time that with the largest ``tie``.

    Both sides are unioned and cut into ranges of (key, time) of even size, however the rows lie in time; inside a range the
    last right row is carried forward, and the value entering each range comes from a table of one row per range, so no
    key is ever a single window partition.
    """
    order = F.col(tie) if tie else F.lit(0)
    obs = F.struct(*[F.col(c) for c in cols], F.col(ts).alias("_rts"))
    right = right.dropna(subset=[*by, ts])
    r = right.select(*by, F.col(ts).alias("_ts"), F.lit(0).alias("_side"), order.alias("_tie"), obs.alias("_obs"))
    lcols = list(left.columns)
    row = F.struct(*[F.col(c) for c in lcols])
    l_ = left.select(*by, F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"),
                     F.lit(None).cast(r.schema["_obs"].dataType).alias("_obs"), row.alias("_row"))
    u = r.withColumn("_row", F.lit(None).cast(l_.schema["_row"].dataType)).unionByName(l_)
    key = [*by, "_ts", "_side", "_tie"]
    u = u.repartitionByRange(*([ranges] if ranges else []), *key).sortWithinPartitions(*key)
    u = u.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    u = scratch_table(u, "as-of")
    w = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = u.withColumn("_loc", F.last("_obs", ignorenulls=True).over(w))
    # only keys that lie in several ranges carry anything on: at most two a range
    per = u.groupBy(*by, "_part").agg(F.max_by("_obs", F.when(F.col("_obs").isNotNull(), F.col("_at"))).alias("_last"))
    per = per.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).filter("_n > 1")
    wb = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*[F.col(b).alias(f"_c_{b}") for b in by], F.col("_part").alias("_c"), F.last("_last", ignorenulls=True).over(wb).alias("_carry"))
    same = F.col("_part") == F.col("_c")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_c_{b}"))
    out = local.filter(F.col("_side") == 1).join(F.broadcast(carry), same, "left")
    got = F.coalesce(F.col("_loc"), F.col("_carry"))
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in lcols],
                      *[got[c].alias(c) for c in cols], got["_rts"].alias("matched_ts"))
