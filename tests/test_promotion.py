"""The scan of state maps against the plain fold; hot blocks of the duplicate search; the radius search across the 180th meridian."""

import math
import random

import pytest

from roadlens.operators import dedup, models, promotion
from roadlens.plans import blocking


def fold(events, factor=1.05):
    out = {}
    for c, seq, kind, v, s in sorted(events, key=lambda e: (e[0], e[1])):
        a = out.get(c)
        if kind == "rollback":
            out[c] = (v, s, a[2] if a else 0)
        elif a is None or (a[1] is not None and s is not None and s > factor * a[1]):
            out[c] = (v, s, (a[2] if a else 0) + 1)
    return out


@pytest.mark.parametrize("slice_rows,shape", [(4, "random"), (16, "rising"), (7, "rollbacks"), (1024, "random")])
def test_scan_equals_fold(spark, monkeypatch, slice_rows, shape):
    monkeypatch.setattr(promotion.registry_states, "__defaults__", (slice_rows,))
    rnd = random.Random(slice_rows)
    events = []
    for c in ("a", "b", "c"):
        for i in range({"a": 300, "b": 40, "c": 1}[c]):
            score = {"random": rnd.random(), "rising": i / 100 + rnd.random() / 50, "rollbacks": rnd.random()}[shape]
            back = shape != "rising" and rnd.random() < (0.2 if shape == "rollbacks" else 0.02)
            events.append((c, i, "rollback" if back else "candidate", i, None if rnd.random() < 0.05 else round(score, 9)))
    rnd.shuffle(events)
    df = spark.createDataFrame(events, "component string, seq long, kind string, version long, score double").repartition(5)
    got = {r.component: (r.active_version, r.active_score, r.promotions) for r in models.promotion_fold(df, "component").collect()}
    assert got == fold(events)


def test_no_events(spark):
    df = spark.createDataFrame([], "component string, seq long, kind string, version long, score double")
    assert models.promotion_fold(df, "component").collect() == []


def test_hot_blocks_are_divided(spark, monkeypatch):
    """A third of all reports at one place and time: the pairs are the same, and no block holds more than its load."""
    rnd = random.Random(3)
    rows = [(f"h{i}", i, "accident", 1_700_000_000 + rnd.randrange(300), 10.0, 20.0 + rnd.random() / 1000) for i in range(150)]
    rows += [(f"x{i}", 1000 + i, "accident", 1_700_000_000 + rnd.randrange(10_000), 10.0 + rnd.random() / 10, 20.0) for i in range(150)]
    df = spark.createDataFrame(rows, "incident_id string, arrival_seq long, incident_type string, s long, latitude double, longitude double")
    df = df.selectExpr("*", "timestamp_seconds(s) as start_datetime")
    want = {(a[1], b[1]) for a in rows for b in rows if b[1] < a[1] and abs(a[3] - b[3]) <= 1800 and math.dist(a[4:], b[4:]) * 111.0 <= 2.0}
    for load in (20, 10_000):
        monkeypatch.setattr(blocking.split_blocks, "__defaults__", (load,))
        assert {(r.seq, r.dup_seq) for r in dedup.duplicate_pairs(df).collect()} == want
    keys = ["k"]
    build = spark.createDataFrame([(i % 3 if i < 30 else 7, i) for i in range(500)], "k long, i long")
    probe, parts, by = blocking.split_blocks(build, build, keys, "i", 50)
    assert parts.groupBy(*by).count().agg({"count": "max"}).first()[0] < 100 and probe.filter("k < 3").count() == 30
    late, early = df.filter("arrival_seq % 5 = 0"), df
    assert {(r.seq, r.dup_seq) for r in dedup.duplicate_pairs(late, earlier=early).collect()} == {p for p in want if p[0] % 5 == 0}


def test_radius_across_the_meridian(spark):
    rnd = random.Random(8)
    pts = [(i, rnd.choice([0.0, 60.0, -89.995, 89.99]) + rnd.uniform(-0.005, 0.005), rnd.choice([-180, 180, 179.99, 0]) + rnd.uniform(-0.02, 0.02)) for i in range(200)]
    pts = [(i, max(-90, min(90, a)), b - 360 if b > 180 else b + 360 if b < -180 else b) for i, a, b in pts]
    p = spark.createDataFrame(pts, "pid long, latitude double, longitude double")
    c = spark.createDataFrame([(1000 + i, a, b) for i, a, b in pts[:60]] + [(1, None, 0.0)], "center_id long, c_lat double, c_lon double")

    def far(a, b):
        p1, p2 = math.radians(a[1]), math.radians(b[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000.0 * math.asin(min(1, math.sqrt(h)))

    want = {(1000 + a[0], b[0]) for a in pts[:60] for b in pts if far(a, b) <= 2000}
    out = dedup.radius_search(p, c).collect()
    assert {(r.center_id, r.pid) for r in out} == want and len(out) == len(want)
