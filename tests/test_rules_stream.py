"""The rules' streams against their batch forms: shuffled batches, restarts, late rows, state that goes."""

import random

import pytest
from pyspark.sql import functions as F

from roadlens.streaming import rules as R
from roadlens.streaming import stateful as S
from tests.test_stateful import events, frame


def stream_of(spark, df, path, files, shuffle):
    """A file stream of ``df``: blocks of rows in the order of time, or blocks dealt at random."""
    n = df.count()
    block = F.floor(F.col("seq") * files / n) if not shuffle else F.pmod(F.xxhash64("seq"), F.lit(files))
    for i in range(files):  # one write a file, so the files' times follow the blocks
        df.filter(block == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


CASES = [("alert", S.alert_dedup, R.alert_stream, 300), ("lockout", S.auth_lockout, R.lockout_stream, 300), ("rate", S.rate_limit_flags, R.rate_stream, 12)]


@pytest.mark.parametrize("name,batch,stream,gap", CASES, ids=[c[0] for c in CASES])
@pytest.mark.parametrize("shuffle", [False, True])
def test_stream_equals_batch(spark, tmp_path, monkeypatch, name, batch, stream, gap, shuffle):
    monkeypatch.setattr(S, "RATE_LIMIT", 4)
    df = frame(spark, events(gap, gap, 300))
    cols = {"key": "key", "seq": "seq"}
    span = f"{300 * gap * 2} seconds" if shuffle else "1 seconds"
    got = stream(stream_of(spark, df, f"{tmp_path}/in", 4, shuffle), delay=span, **cols)
    want = batch(df, **cols)
    both = lambda d: sorted(tuple(r) for r in d.select(*want.columns).collect())
    assert both(got) == both(want)


def test_late_rows_are_kept_apart(spark, tmp_path):
    """With a delay that is too short, what is answered is in order and what is late is given whole."""
    df = frame(spark, events(7, 300, 300))
    out = R.to_the_end(R.events_of(stream_of(spark, df, f"{tmp_path}/in", 4, True), "key", "ts", "seq", F.lit(False)), R.alert_step, "late", "10 seconds")
    late = R.late_rows(df, out, "seq")
    assert 0 < late.count() < 300 and late.count() + out.count() == 300 and late.columns == df.columns


def test_state_goes():
    """Keys without waiting events and periods leave the state; a lockout keeps its counter."""

    class State:
        exists, hasTimedOut, held, timer = False, False, None, None

        def __init__(self, passed):
            self.passed = passed

        def getCurrentWatermarkMs(self):
            return self.passed

        @property
        def get(self):
            return self.held

        def update(self, x):
            self.exists, self.held = True, x

        def remove(self):
            self.exists, self.held = False, None

        def setTimeoutTimestamp(self, x):
            assert x > self.passed
            self.timer = x

    import pandas as pd

    rows = pd.DataFrame({"t": [5_000_000, 3_000_000], "seq": [2, 1], "flag": [False, False]})
    for step, keeps in ((R.alert_step, False), (R.lockout_step, True)):
        s = State(1000)
        out = pd.concat(R.rule(step, keeps)(("k",), iter([rows]), s))
        assert len(out) == 0 and s.timer == 3000 and s.held[0] == [3_000_000, 5_000_000]
        s.passed, s.hasTimedOut = 4000, True
        assert list(pd.concat(R.rule(step, keeps)(("k",), iter([]), s))["seq"]) == [1]
        s.passed = 10_000_000
        assert list(pd.concat(R.rule(step, keeps)(("k",), iter([]), s))["seq"]) == [2]
        assert s.exists == keeps and (not keeps or s.held == ([], [], [], R.NEVER, 2))


def test_rules_of_random_order(spark):
    """The steps themselves follow the plain rules whatever the order of arrival."""
    rnd = random.Random(2)
    times = sorted(rnd.randrange(10**10) for _ in range(200))
    a, b, last = R.NEVER, 0, None
    for t in times:
        answer, a, b = R.alert_step(t, False, a, b)
        fired = last is None or t - last >= S.ALERT_WINDOW_S * 1_000_000
        assert bool(answer) == fired
        last = t if fired else last
