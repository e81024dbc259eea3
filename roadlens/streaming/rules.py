"""The per-key sequential rules as streams: Spark's arbitrary state operator with event-time timers.

A micro-batch brings events in any order.  A key's state holds the events that the watermark has not passed yet, and what
the rule remembers (the period in force, the failures so far); when the watermark passes events, they are taken in the
order of their times and answered, and a timer calls the key again for those that still wait.  A key with nothing waiting
and no period in force leaves the state (a lockout keeps its one counter).  So state is bounded by the events
of the watermark's delay, and results don't depend on how events are cut into batches or on restarts.

``to_the_end`` closes a finite input: it runs what is there, writes an end mark far behind the last event to the
stream's second source, and starts the same query again from its checkpoint.  Rows that came later than the
delay are dropped by the watermark; ``late_rows`` gives them, whole, by comparing the source with the answers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadlens.session import scratch_path
from roadlens.streaming import stateful as S

INPUT = "key string, seq long, t long, flag boolean, at timestamp"
STATE = "t binary, seq binary, flag binary, a long, b long"
MARK = "\0end"
#: A state without a period: times are microseconds, so this is before any of them.
NEVER = -(1 << 62)


def alert_step(t: int, flag: bool, a: int, b: int):
    """(answer, a, b): whether an alert fires (1) and escalates (2); a: end of the suppression in force."""
    if t < a:
        return 0, a, b
    return 2 if flag else 1, t + S.ALERT_WINDOW_S * 1_000_000, b


def lockout_step(t: int, ok: bool, a: int, b: int):
    """Whether a call is rejected; a: end of the block, b: failures so far."""
    if t < a:
        return 1, a, b
    if ok:
        return 0, a, b
    return 0, (t + S.LOCKOUT_S * 1_000_000 if b + 1 >= S.LOCKOUT_FAILURES else a), b + 1


def rate_step(t: int, _: bool, a: int, b: int, limit: int = S.RATE_LIMIT):
    """Whether a request is over the limit; a: end of the window, b: its requests so far."""
    if t >= a:
        a, b = t + S.RATE_WINDOW_S * 1_000_000, 0
    return int(b + 1 > limit), a, b + 1


#: Answers of a key that are made at once.
ANSWERS = 50_000
KINDS = (np.int64, np.int64, np.bool_)
NONE = pd.DataFrame({"key": pd.Series(dtype=object), **{c: np.zeros(0, dtype=np.int64) for c in ("seq", "t", "answer", "a")}})


def rule(step: Callable, keeps_b: bool, packed: bool = False):
    """The state function of a rule: answers (key, seq, t, answer, a) of the events that the watermark has passed.  Events are held in
    arrays, and answered ``ANSWERS`` at a time; ``packed``: the state keeps them as the arrays' bytes, not as lists of objects."""
    hold = np.ndarray.tobytes if packed else np.ndarray.tolist

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        *held, a, b = state.get if state.exists else (b"", b"", b"", NEVER, 0)
        parts = [[np.frombuffer(x, dtype=k) if isinstance(x, (bytes, bytearray)) else np.asarray(x, dtype=k)] for x, k in zip(held, KINDS)]
        del held
        if not state.hasTimedOut:
            for pdf in batches:
                for part, column, kind in zip(parts, ("t", "seq", "flag"), KINDS):
                    part.append(pdf[column].to_numpy(dtype=kind))
        t, seq, flag = (np.concatenate(part) for part in parts)
        del parts
        order = np.lexsort((seq, t))
        t, seq, flag = t[order], seq[order], flag[order]
        del order
        done = 0 if key[0] == MARK else int(np.searchsorted(t, passed * 1000, side="right"))
        for at in range(0, done, ANSWERS):
            to = min(at + ANSWERS, done)
            answers, ends = np.empty(to - at, dtype=np.int64), np.empty(to - at, dtype=np.int64)
            for i, (when, what) in enumerate(zip(t[at:to].tolist(), flag[at:to].tolist())):
                answers[i], a, b = step(when, what, a, b)
                ends[i] = a
            yield pd.DataFrame({"key": key[0], "seq": seq[at:to], "t": t[at:to], "answer": answers, "a": ends})
        if not done:
            yield NONE
        rest = 0 if key[0] == MARK else len(t) - done
        if rest or (keeps_b and b) or a > passed * 1000:
            state.update((*(hold(x[len(t) - rest:]) for x in (t, seq, flag)), a, b))
            call = -(-int(t[done]) // 1000) if rest else -(-a // 1000)
            if rest or a > passed * 1000:
                state.setTimeoutTimestamp(max(call, passed + 1))
        elif state.exists:
            state.remove()

    return run


def answered(events: DataFrame, step: Callable, delay: str, keeps_b: bool = False) -> DataFrame:
    """The stream (key, seq, t, answer, a) of events (``INPUT``), in append mode."""
    return events.withWatermark("at", delay).groupBy("key").applyInPandasWithState(
        rule(step, keeps_b, packed=True), "key string, seq long, t long, answer int, a long", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def events_of(df: DataFrame, key: str, ts: str, seq: str, flag) -> DataFrame:
    at = F.col(ts).cast("timestamp")
    return df.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.unix_micros(at).alias("t"),
                     F.coalesce(flag, F.lit(False)).alias("flag"), at.alias("at")).filter("key is not null and at is not null")


def to_the_end(events: DataFrame, step: Callable, name: str, delay: str = "2 days", keeps_b: bool = False) -> DataFrame:
    """All answers over a finite input stream: runs what is there, then the end mark, from one checkpoint."""
    spark = events.sparkSession
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:8]}")
    spark.createDataFrame([], INPUT).write.parquet(f"{base}/marks")
    marks = spark.readStream.schema(INPUT).parquet(f"{base}/marks")

    def go():
        out = answered(events.unionByName(marks), step, delay, keeps_b)
        out.writeStream.option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).format("parquet").option(
            "path", f"{base}/data").start().awaitTermination()

    go()
    far = F.timestamp_micros(F.lit(1 << 52).cast("long"))  # in the year 2112
    spark.range(1).select(F.lit(MARK).alias("key"), F.lit(0).cast("long").alias("seq"), F.lit(1 << 52).cast("long").alias("t"),
                          F.lit(False).alias("flag"), far.alias("at")).write.mode("append").parquet(f"{base}/marks")
    go()
    return spark.read.schema("key string, seq long, t long, answer int, a long").parquet(f"{base}/data")


def late_rows(source: DataFrame, answers: DataFrame, seq: str) -> DataFrame:
    """The rows of a source that were too late for their stream."""
    return source.join(answers.select(F.col("seq").alias(seq)), seq, "left_anti")


def alert_stream(alerts: DataFrame, delay: str = "2 days", **cols) -> DataFrame:
    """(seq, alert_id, fired, escalated) of an alert stream."""
    names = {"key": "alert_id", "ts": "ts", "seq": "seq"} | cols
    out = to_the_end(events_of(alerts, **names, flag=F.col("severity") == "CRITICAL"), alert_step, "alerts", delay)
    return out.select("seq", F.col("key").alias("alert_id"), (F.col("answer") > 0).alias("fired"), (F.col("answer") == 2).alias("escalated"))


def lockout_stream(calls: DataFrame, delay: str = "2 days", **cols) -> DataFrame:
    """(seq, key, rejected_locked) of a stream of calls."""
    names = {"key": "service", "ts": "ts", "seq": "seq"} | cols
    out = to_the_end(events_of(calls, **names, flag=F.col("ok")), lockout_step, "lockout", delay, keeps_b=True)
    return out.select("seq", "key", (F.col("answer") == 1).alias("rejected_locked"))


def rate_stream(requests: DataFrame, delay: str = "2 days", **cols) -> DataFrame:
    """(seq, key, window_end, limited) of a stream of requests."""
    names = {"key": "user_id", "ts": "ts", "seq": "event_id"} | cols
    out = to_the_end(events_of(requests, **names, flag=F.lit(False)), partial(rate_step, limit=S.RATE_LIMIT), "rates", delay)
    return out.select("seq", "key", F.col("a").alias("window_end"), (F.col("answer") == 1).alias("limited"))
