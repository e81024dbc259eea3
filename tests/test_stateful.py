"""Sequential per-key rules against plain loops."""

import random

import pytest

from roadlens.streaming import stateful as S


def events(seed, gap, n=600):
    rng, t, rows = random.Random(seed), 1_700_000_000.0, []
    for i in range(n):
        t += rng.choice([0, 0, rng.expovariate(1 / gap)])
        rows.append((i, f"k{rng.randrange(2)}", round(t, 3), rng.random() < 0.6, "CRITICAL" if rng.random() < 0.2 else "WARNING"))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "seq long, key string, s double, ok boolean, severity string")
    return df.selectExpr("seq", "key", "timestamp_micros(cast(round(s * 1000000) as long)) as ts", "ok", "severity")


@pytest.mark.parametrize("gap", [5, 300, 4000, 200000])
def test_alert_dedup(spark, gap):
    rows, last, want = events(gap, gap), {}, {}
    for seq, key, t, _, sev in rows:
        t = round(t * 1e6)
        fired = key not in last or t - last[key] >= 900_000_000
        if fired:
            last[key] = t
        want[seq] = (fired, fired and sev == "CRITICAL")
    got = {r.seq: (r.fired, r.escalated) for r in S.alert_dedup(frame(spark, rows), key="key").collect()}
    assert got == want


@pytest.mark.parametrize("gap", [5, 300, 4000])
def test_auth_lockout(spark, gap):
    rows, failures, until, want = events(gap + 1, gap), {}, {}, {}
    for seq, key, t, ok, _ in rows:
        t = round(t * 1e6)
        want[seq] = t < until.get(key, -1)
        if not want[seq] and not ok:
            failures[key] = failures.get(key, 0) + 1
            if failures[key] >= 5:
                until[key] = t + 900_000_000
    got = {r.seq: r.rejected_locked for r in S.auth_lockout(frame(spark, rows), key="key").collect()}
    assert got == want


def test_rate_limit(spark, monkeypatch):
    monkeypatch.setattr(S, "RATE_LIMIT", 4)
    rows, state, want = events(9, 12), {}, {}
    for seq, key, t, _, _ in rows:
        t = round(t * 1e6)
        reset, count = state.get(key, (-1, 0))
        if t >= reset:
            reset, count = t + 60_000_000, 0
        count += 1
        want[seq] = (reset, count > 4)
        state[key] = (reset, count)
    got = {r.seq: (r.window_end, r.limited) for r in S.rate_limit_flags(frame(spark, rows), key="key", seq="seq").collect()}
    assert got == want
