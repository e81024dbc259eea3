"""Model promotion as a parallel scan of state maps.

A candidate becomes active when none is, or when its score exceeds ``factor`` times the active score; a rollback makes its
version active at once.  What a slice of a component's events does to any state it may be entered with is a small
map: up to its first rollback only the running maxima of the scores (records) can be what an entry score first yields to,
and from there on the slice's course is known.  Slices answer with their maps independently; neighbouring maps are
composed pair by pair, so a component with any number of events takes log2 of its slices rounds and no task ever sees more
than two maps.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.session import scratch_table

SLICE = 1024
#: A state is (version, score or None, promotions on the way); None: no version is active.
State = tuple[int, float | None, int]

_STATE = "struct<v:long,s:double,n:long>"
MAP = f"component string, slice long, rec array<double>, exits array<{_STATE}>, rest {_STATE}, fresh {_STATE}, blank {_STATE}"


@dataclass
class Course:
    """A slice's map: entered with a score, the state goes to the exit of the first record above ``factor`` times it, else to
    ``rest`` (None: unchanged); entered without a version to ``fresh``; with a version without a score to ``blank``."""

    rec: list[float] = field(default_factory=list)
    exits: list[State] = field(default_factory=list)
    rest: State | None = None
    fresh: State | None = None
    blank: State | None = None

    def after(self, state: State | None, factor: float) -> State | None:
        if state is None:
            return self.fresh
        v, s, n = state
        if s is None:
            to = self.blank
        else:
            i = int(np.searchsorted(self.rec, factor * s, side="right"))
            to = self.exits[i] if i < len(self.rec) else self.rest
        return state if to is None else (to[0], to[1], n + to[2])

    def then(self, later: Course, factor: float) -> Course:
        """This map followed by that of the next slice."""
        go = lambda s: later.after(s, factor)
        out = Course(list(self.rec), [go(s) for s in self.exits], None, go(self.fresh), go(self.blank) if self.blank else later.blank)
        if self.rest:
            out.rest = go(self.rest)
            return out
        top = self.rec[-1] if self.rec else -np.inf
        more = [i for i, r in enumerate(later.rec) if r > top]
        out.rec += [later.rec[i] for i in more]
        out.exits += [later.exits[i] for i in more]
        out.rest = later.rest
        return out


def course(rb: np.ndarray, v: np.ndarray, s: np.ndarray, factor: float) -> Course:
    """The map of events in order; a score of NaN is none."""
    n = len(v)
    ends: list[State] = [(0, None, 0)] * n
    for i in range(n - 1, -1, -1):
        met = rb[i + 1:] | (s[i + 1:] > factor * s[i])  # nothing exceeds a missing score
        score = None if np.isnan(s[i]) else float(s[i])
        if met.any():
            j = i + 1 + int(met.argmax())
            ends[i] = (ends[j][0], ends[j][1], ends[j][2] + int(not rb[j]))
        else:
            ends[i] = (int(v[i]), score, 0)
    entered = lambda i: (ends[i][0], ends[i][1], ends[i][2] + int(not rb[i]))
    back = int(rb.argmax()) if rb.any() else n
    out = Course(rest=entered(back) if back < n else None, fresh=entered(0) if n else None, blank=entered(back) if back < n else None)
    for i in range(back):
        if not np.isnan(s[i]) and (not out.rec or s[i] > out.rec[-1]):
            out.rec.append(float(s[i]))
            out.exits.append(entered(i))
    return out


def _row(component, number: int, c: Course) -> pd.DataFrame:
    as_row = lambda s: None if s is None else {"v": s[0], "s": s[1], "n": s[2]}
    return pd.DataFrame({"component": [component], "slice": [number], "rec": [c.rec], "exits": [[as_row(s) for s in c.exits]],
                         "rest": [as_row(c.rest)], "fresh": [as_row(c.fresh)], "blank": [as_row(c.blank)]})


def _course(row) -> Course:
    def state(x):
        return None if x is None or x["v"] is None else (int(x["v"]), None if x["s"] is None or np.isnan(x["s"]) else float(x["s"]), int(x["n"]))
    return Course([float(r) for r in row.rec], [state(x) for x in row.exits], state(row.rest), state(row.fresh), state(row.blank))


def registry_states(events: DataFrame, factor: float, slice_rows: int = SLICE) -> DataFrame:
    """(component, active_version, active_score, promotions) after all events (component, seq, rb, v, s)."""
    ranges = max(1, -(-events.count() // slice_rows))
    order = ["component", "seq", "rb", "v"]
    ranged = events.repartitionByRange(ranges, *order).withColumn("slice", F.spark_partition_id().cast("long"))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "rb", "v"])
        c = course(pdf["rb"].to_numpy(dtype=bool), pdf["v"].to_numpy(), pdf["s"].to_numpy(dtype=float), factor)
        return _row(pdf["component"].iloc[0], int(pdf["slice"].iloc[0]), c)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice")
        c = _course(pdf.iloc[0])
        if len(pdf) == 2:
            c = c.then(_course(pdf.iloc[1]), factor)
        return _row(pdf["component"].iloc[0], int(pdf["slice"].iloc[0]) // 2, c)

    maps = scratch_table(scratch_table(ranged, "registry-events").groupBy("component", "slice").applyInPandas(answer, MAP), "courses")
    while maps.agg(F.max("slice")).first()[0]:
        pairs = maps.groupBy("component", F.floor(F.col("slice") / 2).alias("pair"))
        maps = scratch_table(pairs.applyInPandas(join, MAP), "courses")
    return maps.select("component", F.col("fresh.v").alias("active_version"), F.col("fresh.s").alias("active_score"),
                       F.col("fresh.n").cast("int").alias("promotions"))
