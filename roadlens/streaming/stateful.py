"""Per-key sequential rules (alert suppression, auth lockout, rate windows) as parallel jobs.

All three are the same chain: an event that counts starts a period of fixed length, events inside the
period don't start one, and the next event at or after its end starts the next.  The start that follows
a given start is therefore known from times alone.  Times of a key are cut into slices; a slice's
chain is walked by array search from every possible entry (the first event at or after the end of a
period that began before), so slices are independent tasks.  An entry can only lie in the slice's first
period, and chains from different entries soon meet, so a slice answers with few (entry, exit) rows.
A fold over slices then tells each slice where it is entered, and a second pass over the slices marks
the starts.  No task holds a whole key; the fold holds one small row per slice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Suppression window, lockout rule and rate window.
ALERT_WINDOW_S = 15 * 60
LOCKOUT_FAILURES = 5
LOCKOUT_S = 900
RATE_WINDOW_S = 60
RATE_LIMIT = 1000
SLICE_PERIODS = 96  # a slice is this many periods long


def _epoch_us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _exits(t: np.ndarray, low: int, high: int, period: int) -> tuple[list[int], list[int]]:
    """Breaks and exits of a slice [low, high): entered with a period that ends at e, low <= e < low +
    period, the chain leaves with a period that ends at the exit of the last break <= e; an exit of
    -1 keeps e (no event at or after it)."""
    first = t[(t >= low) & (t < low + period)]
    breaks, exits = [low], []
    for x in first:  # entered at most at x: x starts a period; past x: the next event does
        breaks.append(int(x) + 1)
    for e in breaks:
        i, end = int(np.searchsorted(t, e)), -1
        while i < len(t):
            end = int(t[i]) + period
            i = int(np.searchsorted(t, end))
        exits.append(end)
    keep = [0] + [i for i in range(1, len(exits)) if exits[i] != exits[i - 1]]
    return [breaks[i] for i in keep], [exits[i] for i in keep]


def period_starts(events: DataFrame, period_s: int, begin: DataFrame | None = None) -> DataFrame:
    """Mark the events (key, seq, t in microseconds) that start a period: adds ``starts`` (boolean) and
    ``ends`` (end of the period in force after the event).  ``begin`` (key, t0): a key's chain starts at
    t0 instead of its first event."""
    period = period_s * 1_000_000
    width = SLICE_PERIODS * period
    ev = events.withColumn("_slice", F.floor(F.col("t") / width))
    if begin is not None:
        ev = ev.join(begin, "key", "left").filter(F.col("t0").isNull() | (F.col("t") >= F.col("t0"))).drop("t0")
    lanes = ev.select("key", "_slice", "t").distinct()

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["_slice"].iloc[0])
        b, x = _exits(np.sort(pdf["t"].to_numpy()), s * width, (s + 1) * width, period)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "_slice": [s], "b": [b], "x": [x]})

    slices = lanes.groupBy("key", "_slice").applyInPandas(answer, "key string, _slice long, b array<long>, x array<long>")
    # the chain over slices: the end in force on entering each (0: none yet)
    step = lambda a, v: F.struct(F.array_append(a["e"], a["end"]).alias("e"), F.when(
        a["end"] >= (v["s"] + 1) * width, a["end"]).otherwise(_out(v, F.greatest(a["end"], v["s"] * width), a["end"])).alias("end"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("_slice").alias("s"), "b", "x")))
    zero = F.struct(F.array().cast("array<bigint>").alias("e"), F.lit(-(1 << 62)).cast("long").alias("end"))
    fold = slices.groupBy("key").agg(rows.alias("r")).withColumn("f", F.aggregate("r", zero, step))
    entry = fold.select("key", F.explode(F.arrays_zip(F.transform("r", lambda v: v["s"]).alias("s"), F.col("f.e").alias("e"))).alias("z")).select(
        "key", F.col("z.s").alias("_slice"), F.col("z.e").alias("_entry"))

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "seq"], kind="stable")
        t, end = pdf["t"].to_numpy(), int(pdf["_entry"].iloc[0])
        starts, ends = np.zeros(len(t), dtype=bool), np.empty(len(t), dtype=np.int64)
        i = 0
        while i < len(t):
            j = int(np.searchsorted(t, end))
            ends[i:max(i, j)] = end
            if j >= len(t):
                break
            j = max(i, j)
            starts[j], end, i = True, int(t[j]) + period, j
            k = int(np.searchsorted(t, end))
            ends[j:k] = end
            i = k
        return pdf.assign(starts=starts, ends=ends)[["key", "seq", "t", "starts", "ends"]]

    return ev.join(entry, ["key", "_slice"]).groupBy("key", "_slice").applyInPandas(
        mark, "key string, seq long, t long, starts boolean, ends long")


def _out(v, entered, end):
    """The exit of the last break at or before ``entered``; an exit of -1 keeps the end in force."""
    at = F.size(F.filter(v["b"], lambda b: b <= entered))
    got = F.element_at(v["x"], F.greatest(at, F.lit(1)))
    return F.when(got == -1, end).otherwise(got)


def alert_dedup(alerts: DataFrame, key="alert_id", ts="ts", seq="seq", severity="severity") -> DataFrame:
    """Per alert id: fired when no alert fired in the 15 minutes before; fired critical alerts escalate."""
    d = alerts.select(F.col(key).alias("key"), F.col(seq).alias("seq"), _epoch_us(ts).alias("t"))
    sev = alerts.select(F.col(seq).alias("seq"), F.col(severity).alias("severity"))
    out = period_starts(d, ALERT_WINDOW_S).join(sev, "seq")
    return out.select("seq", F.col("key").alias("alert_id"), F.col("starts").alias("fired"),
                      (F.col("starts") & (F.col("severity") == "CRITICAL")).alias("escalated"))


def auth_lockout(calls: DataFrame, key="service", ts="ts", seq="seq", ok="ok") -> DataFrame:
    """Failures counted per key; from the 5th on, each failure outside a block blocks the key for 15 min,
    and every call inside a block is rejected."""
    d = calls.select(F.col(key).alias("key"), F.col(seq).alias("seq"), _epoch_us(ts).alias("t"), F.col(ok).alias("ok"))
    bad = d.filter(~F.col("ok")).select("key", "seq", "t")
    w = Window.partitionBy("key").orderBy("t", "seq")
    fifth = bad.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= LOCKOUT_FAILURES).filter(
        F.col("_r") == LOCKOUT_FAILURES).select("key", F.col("t").alias("t0"), F.col("seq").alias("_s0"))
    chain = bad.join(fifth, "key").filter((F.col("t") > F.col("t0")) | ((F.col("t") == F.col("t0")) & (F.col("seq") >= F.col("_s0"))))
    blocks = period_starts(chain.select("key", "seq", "t"), LOCKOUT_S).filter("starts").select(
        "key", F.col("t").alias("b"), F.col("seq").alias("bs"))
    # a call is rejected when the last block before it has not ended; a block lies in one or two slots
    slot = LOCKOUT_S * 1_000_000
    blocks = blocks.withColumn("_k", F.explode(F.array(F.floor(F.col("b") / slot), F.floor(F.col("b") / slot) + 1)))
    hit = d.withColumn("_k", F.floor(F.col("t") / slot)).join(blocks, ["key", "_k"]).filter(
        ((F.col("t") > F.col("b")) | ((F.col("t") == F.col("b")) & (F.col("seq") > F.col("bs")))) & (F.col("t") < F.col("b") + slot))
    hit = hit.select("key", "seq").distinct().withColumn("rejected_locked", F.lit(True))
    return d.join(hit, ["key", "seq"], "left").select("seq", "key", F.coalesce("rejected_locked", F.lit(False)).alias("rejected_locked"))


def rate_limit_flags(requests: DataFrame, key="user_id", ts="ts", seq="event_id") -> DataFrame:
    """Per key: windows of 60 s from the first request after the last window; requests beyond the limit of a
    window are flagged.  Columns: seq, key, window_end (microseconds), limited."""
    d = requests.select(F.col(key).cast("string").alias("key"), F.col(seq).alias("seq"), _epoch_us(ts).alias("t"))
    out = period_starts(d, RATE_WINDOW_S)
    w = Window.partitionBy("key", "ends").orderBy("t", "seq")  # one window's requests
    return out.withColumn("_n", F.row_number().over(w)).select(
        "seq", "key", F.col("ends").alias("window_end"), (F.col("_n") > RATE_LIMIT).alias("limited"))
