"""Monitoring operators: drift, latency fallback, histograms, quality windows, health.

Ordered "last N" statistics go through ``plans.ordered`` (bucketed dense index + block
frames with halo); "latest"/"top N" use aggregates (``max_by``) or row_number <= N,
which Spark plans as a per-partition group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.plans.ordered import dense_index, running_sums, trailing_frame

# Monitoring thresholds.
BASELINE_MAE = 3.5
DRIFT_FACTOR = 1.05
DRIFT_WINDOWS = (100, 500)
FALLBACK_WINDOW = 5
FALLBACK_THRESHOLD_MS = 500.0
HISTOGRAM_BUCKETS_MS = (100.0, 500.0)
HISTOGRAM_SAMPLES = 1000
BREAKER_MIN_CALLS = 5
BREAKER_ERROR_RATE = 0.5
BREAKER_LATENCY_MS = 500.0
BREAKER_LATENCY_SAMPLES = 100
DQ_MIN_TOTAL = 100
DQ_MIN_PASS_RATE = 0.90
DQ_MAX_MISSING = 0.40
API_P95_MS = 450.0
API_P99_MS = 500.0

SEQ_BUCKET = 65536  # range bucket of a sequence column for bucketed ordered work


def _indexed(df: DataFrame, part: list[str], order: str) -> DataFrame:
    return dense_index(df, part, [order], F.floor(F.col(order) / SEQ_BUCKET), "idx")


def drift_mae(df: DataFrame, part=("model",), order="seq", pred="predicted", actual="actual",
              windows=DRIFT_WINDOWS, baseline=BASELINE_MAE, factor=DRIFT_FACTOR) -> DataFrame:
    d = _indexed(df.withColumn("_err", F.abs(F.col(pred) - F.col(actual))), list(part), order)
    out = trailing_frame(d, list(part), "idx", {f"_a{n}": (F.avg("_err"), -(n - 1), 0) for n in windows})
    cols = {f"mae_{n}": F.when(F.col("idx") >= n, F.col(f"_a{n}")) for n in windows}
    drift = F.lit(False)
    for n in windows:
        # compared at 1e-9 so the summation order of the engine cannot flip a boundary case
        drift = drift | F.coalesce((F.col("idx") >= n) & (F.round(F.col(f"_a{n}"), 9) > round(baseline * factor, 9)),
                                   F.lit(False))
    cols["drift"] = drift
    return out.withColumns(cols).drop(*[f"_a{n}" for n in windows], "_err")


def latency_fallback(df: DataFrame, part=("service",), order="seq", value="latency_ms",
                     window=FALLBACK_WINDOW, threshold=FALLBACK_THRESHOLD_MS) -> DataFrame:
    """On iff the last ``window`` values all exceed the threshold (state only changes once the
    window is full); ``transition`` marks rows where the state flips."""
    d = _indexed(df, list(part), order)
    out = trailing_frame(d, list(part), "idx", {"_m": (F.min(value), -(window - 1), 0),
                                                "_mp": (F.min(value), -window, -1)})
    on = (F.col("idx") >= window) & (F.col("_m") > threshold)
    prev = (F.col("idx") - 1 >= window) & (F.col("_mp") > threshold)
    return out.withColumns({"fallback_on": on, "transition": on != prev}).drop("_m", "_mp")


def latency_moving_avg(df: DataFrame, part=("service",), order="seq", value="latency_ms", n=50) -> DataFrame:
    d = _indexed(df, list(part), order)
    out = trailing_frame(d, list(part), "idx", {"moving_avg_50": (F.avg(value), -(n - 1), 0)})
    return out.withColumn("delta_from_avg", F.col(value) - F.col("moving_avg_50"))


def last_n(df: DataFrame, part: list[str], order: str, n: int) -> DataFrame:
    """The newest n rows per key (row_number <= n -> per-partition group limit before shuffle)."""
    w = Window.partitionBy(*part).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def metric_histogram(df: DataFrame, part=("service",), order="seq", value="latency_ms",
                     buckets=HISTOGRAM_BUCKETS_MS, samples=HISTOGRAM_SAMPLES) -> DataFrame:
    recent = last_n(df, list(part), order, samples)
    aggs = [F.count_if(F.col(value) <= b).alias(f"le_{int(b)}") for b in buckets]
    return recent.groupBy(*part).agg(*aggs, F.count("*").alias("le_inf"), F.sum(value).alias("sum_ms"),
                                     F.count("*").alias("n"))


def latency_stats(df: DataFrame, part=("service",), order="seq", value="latency_ms") -> DataFrame:
    return df.groupBy(*part).agg(F.count("*").alias("n"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"),
                                 F.avg(value).alias("avg_ms"), F.max_by(value, order).alias("latest_ms"))


def latency_budget_total(df: DataFrame, operations: list[str], budget_ms: float, part="service", order="seq",
                         value="latency_ms") -> DataFrame:
    latest = df.filter(F.col(part).isin(*operations)).groupBy(part).agg(F.max_by(value, order).alias("latest"))
    return latest.agg(F.sum("latest").alias("total_ms"), (F.sum("latest") > budget_ms).alias("over_budget"),
                      F.count("*").alias("operations"))


def service_error_rate(df: DataFrame, part="service", order="seq", value="latency_ms", ok="ok") -> DataFrame:
    totals = df.groupBy(part).agg(F.count("*").alias("calls"),
                                  (F.count_if(~F.col(ok)) / F.count("*")).alias("error_rate"))
    lat = last_n(df, [part], order, BREAKER_LATENCY_SAMPLES).groupBy(part).agg(F.avg(value).alias("avg_latency_100"))
    j = totals.join(lat, part)
    enough = F.col("calls") >= BREAKER_MIN_CALLS
    return j.withColumn("would_open", (enough & (F.col("avg_latency_100") > BREAKER_LATENCY_MS))
                        | (enough & (F.col("error_rate") > BREAKER_ERROR_RATE)))


def metric_counters(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


def latest_per_key(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Last update wins: one partial-aggregated ``max_by`` per key (no sort of the whole key)."""
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_last"))
    return latest.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in cols])


def admission_cap(df: DataFrame, key: str, order: str, n: int = 50) -> DataFrame:
    """Rows of the first n distinct keys (by first appearance); later new keys are ignored."""
    firsts = df.groupBy(key).agg(F.min(order).alias("_first"))
    admitted = firsts.orderBy("_first", key).limit(n).select(key)  # top-n: bounded by n
    return df.join(F.broadcast(admitted), key, "left_semi")


def chrono_split(df: DataFrame, step: str, train=0.6, val=0.2) -> DataFrame:
    n = df.agg((F.max(step) + 1).alias("_n")).withColumn("_k", F.lit(1))
    j = df.withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k")
    split = (F.when(F.col(step) < F.floor(F.col("_n") * train), "train")
             .when(F.col(step) < F.floor(F.col("_n") * (train + val)), "val").otherwise("test"))
    return j.withColumn("split", split).drop("_k", "_n")


def arrival_number(df: DataFrame, part: list[str], order: str) -> DataFrame:
    return _indexed(df, part, order)


def incident_sequence(df: DataFrame, part: list[str], order: str, feats: list[str], length: int = 5) -> DataFrame:
    """Up to length-1 past + current feature vectors, oldest first, zero-padded on the left."""
    d = _indexed(df.withColumn("_v", F.array(*[F.col(c).cast("double") for c in feats])), part, order)
    out = trailing_frame(d, part, "idx", {"_h": (F.collect_list("_v"), -(length - 1), 0)})
    zeros = F.array(*[F.lit(0.0)] * len(feats))
    pad = F.array_repeat(zeros, F.lit(length) - F.size("_h"))
    return out.withColumn("sequence", F.concat(pad, F.col("_h"))).drop("_h", "_v", "idx")


def sliding_samples(df: DataFrame, part: list[str], order: str, value: str, n_in: int = 24,
                    n_out: int = 6) -> DataFrame:
    d = _indexed(df, part, order)
    out = trailing_frame(d, part, "idx", {"x": (F.collect_list(value), -(n_in - 1), 0),
                                          "y": (F.collect_list(value), 1, n_out)})
    return out.filter((F.size("x") == n_in) & (F.size("y") == n_out))


def in_area(lat: Column, lon: Column) -> Column:
    from roadlens.config import SERVICE_AREA as a
    return lat.between(a["lat_min"], a["lat_max"]) & lon.between(a["lon_min"], a["lon_max"])


def dq_window_metrics(df: DataFrame, width: str = "1 day", ts="start_datetime") -> DataFrame:
    ok = in_area(F.col("latitude"), F.col("longitude"))
    g = df.groupBy(F.window(F.col(ts), width).start.alias("window_start"))
    return g.agg(F.count("*").alias("received"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"),
                 F.count_if(~F.col("event_observed")).alias("missing_end"),
                 (F.count_if(ok) / F.count("*")).alias("pass_rate"),
                 (1 - (F.count_if(F.col("temperature").isNull()) + F.count_if(F.col("priority").isNull()))
                  / (2.0 * F.count("*"))).alias("completeness"))


def dq_threshold_alerts(df: DataFrame, order="arrival_seq", fields=("temperature", "priority", "veh_type")) -> DataFrame:
    """Cumulative totals over arrival order; alert rows once total > 100 and the pass rate is
    below 0.90 or any of ``fields`` is missing in more than 40 %.

    The totals before a bucket come from sums per bucket and per block of buckets, so the offsets of
    any number of buckets are never one task.
    """
    names = ["one", "pass_", *[f"miss_{f}" for f in fields]]
    d = df.select(F.col(order).alias("seq"), F.lit(1).alias("one"),
                  in_area(F.col("latitude"), F.col("longitude")).cast("int").alias("pass_"),
                  *[F.col(f).isNull().cast("int").alias(f"miss_{f}") for f in fields])
    block = F.floor(F.col("seq") / (SEQ_BUCKET * SEQ_BUCKET))
    d = d.withColumn("_block", block)
    c = running_sums(d, ["_block"], "seq", names, F.floor(F.col("seq") / SEQ_BUCKET))
    totals = d.groupBy("_block").agg(*[F.sum(n).alias(n) for n in names])
    w = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per billion reports and more
    before = totals.select("_block", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"before_{n}") for n in names])
    c = c.join(before, "_block").withColumns({f"cum_{n}": F.col(f"cum_{n}") + F.col(f"before_{n}") for n in names})
    pr = F.col("cum_pass_") / F.col("cum_one")
    rates = {f: F.col(f"cum_miss_{f}") / F.col("cum_one") for f in fields}
    high = F.greatest(*rates.values()) > DQ_MAX_MISSING if len(rates) > 1 else next(iter(rates.values())) > DQ_MAX_MISSING
    return (c.filter((F.col("cum_one") > DQ_MIN_TOTAL) & ((pr < DQ_MIN_PASS_RATE) | high))
            .select("seq", pr.alias("pass_rate"), *[r.alias(f"missing_{f}_rate") for f, r in rates.items()],
                    (pr < DQ_MIN_PASS_RATE).alias("low_pass_rate"), high.alias("high_missing")))


def health_snapshot(df: DataFrame, ts="ts", value="latency_ms", width: float = 50.0) -> DataFrame:
    """Hourly 95th and 99th percentiles, calls per minute and status.

    Exact percentiles come from counts per (hour, value) and their running sums over ranges of values, so
    an hour of any size is many tasks.
    """
    d = df.filter(F.col(value).isNotNull()).groupBy(F.date_trunc("hour", F.col(ts)).alias("hour"), F.col(value).alias("v")).agg(
        F.count("*").alias("n"))
    total = df.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(F.count(value).alias("total"), F.count("*").alias("calls"))
    c = running_sums(d, ["hour"], "v", ["n"], F.floor(F.col("v") / F.lit(width))).join(total, "hour")

    def quantile(p):
        at = (F.col("total") - 1) * F.lit(p)
        low, high = (F.min(F.when(F.col("cum_n") > f(at), F.col("v"))) for f in (F.floor, F.ceil))
        return low + (high - low) * F.max(at - F.floor(at))

    out = c.groupBy("hour").agg(quantile(0.95).alias("p95_ms"), quantile(0.99).alias("p99_ms"),
                                (F.max("calls") / 60.0).alias("calls_per_minute"))
    status = F.when((F.col("p95_ms") > API_P95_MS) | (F.col("p99_ms") > API_P99_MS), "degraded").otherwise("healthy")
    return out.withColumn("status", status)
