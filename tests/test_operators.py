"""Literal cases (FIXTURES 2) and invariants for the core operators."""

import datetime as dt

from pyspark.sql import functions as F

from roadlens.operators import dedup, features, survival, validate
from roadlens.functions import scalars

T0 = dt.datetime(2024, 1, 15, 14, 30)
REPORT_SCHEMA = ("incident_id string, arrival_seq long, incident_type string, start_datetime timestamp_ntz, "
                 "latitude double, longitude double")


def _reports(spark, rows):
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def _dups(spark, rows):
    out = dedup.dup_detect(_reports(spark, rows)).collect()
    return {r["arrival_seq"]: list(r["duplicate_incident_ids"]) for r in out}


def test_dup_same_place_two_minutes(spark):
    rows = [("a", 0, "accident", T0, -33.87, 151.21), ("b", 1, "accident", T0 + dt.timedelta(minutes=2), -33.87, 151.21)]
    assert _dups(spark, rows) == {1: ["a"]}


def test_dup_negative_cases(spark):
    rows = [("a", 0, "accident", T0, -33.87, 151.21),
            ("b", 1, "congestion", T0, -33.87, 151.21),                       # other type
            ("c", 2, "accident", T0 + dt.timedelta(hours=2), -33.87, 151.21),  # 2 h apart
            ("d", 3, "accident", T0, -33.82, 151.21)]                         # +0.05 deg
    assert _dups(spark, rows) == {}


def test_dup_three_earlier_and_resend(spark):
    rows = [(x, i, "accident", T0 + dt.timedelta(minutes=i), -33.87, 151.21) for i, x in enumerate("abc")]
    rows.append(("d", 3, "accident", T0 + dt.timedelta(minutes=5), -33.87, 151.21))
    rows.append(("d", 4, "accident", T0 + dt.timedelta(minutes=5), -33.87, 151.21))  # same record re-sent
    d = _dups(spark, rows)
    assert d[3] == ["a", "b", "c"] and d[4] == ["a", "b", "c", "d"]


def _validated(spark, desc_list):
    rows = [(str(i), i, "accident", T0, -33.87, 151.21, d) for i, d in enumerate(desc_list)]
    df = spark.createDataFrame(rows, REPORT_SCHEMA + ", description string")
    return validate.validate(df, "2024-02-01 00:00:00").orderBy("arrival_seq").collect()


def test_noise_and_batch(spark):
    out = _validated(spark, ["aaaaaaaaaa", "Multi-vehicle collision on M1 northbound", None])
    assert not out[0]["valid"] and out[0]["errors"][0]["error_code"] == "description_quality_low"
    assert out[1]["valid"]
    assert not out[2]["valid"] and out[2]["errors"][0]["error_code"] == "missing"


def test_time_bins_and_rush(spark):
    hours = [(6, "morning"), (12, "afternoon"), (18, "evening"), (2, "night")]
    df = spark.createDataFrame([(dt.datetime(2024, 1, 15, h, 30),) for h, _ in hours], "start_datetime timestamp_ntz")
    got = [r["time_of_day_bins"] for r in features.derive_time(df).collect()]
    assert got == [b for _, b in hours]
    rush = spark.createDataFrame([(dt.datetime(2024, 1, 15, h, 30),) for h in (8, 12, 18)], "start_datetime timestamp_ntz")
    assert [r["is_rush_hour"] for r in features.derive_time(rush).collect()] == [True, False, True]


def test_l2_zero_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0],), ([3.0, 4.0, 0.0],)], "v array<double>")
    out = [r[0] for r in df.select(scalars.l2_normalize(F.col("v"))).collect()]
    assert out[0] == [0.0, 0.0, 0.0] and abs(sum(x * x for x in out[1]) - 1) < 1e-12


def test_km_monotone_and_bounded(spark):
    rows = [("x", float(d), d % 4 != 0) for d in range(1, 200)]
    df = spark.createDataFrame(rows, "incident_type string, duration_min double, event_observed boolean")
    c = survival.km_curves(df, min_samples=50).filter(F.col("grp") == "x").orderBy("t").collect()
    s = [r["survival"] for r in c]
    assert all(0 <= v <= 1 for v in s) and all(a >= b - 1e-12 for a, b in zip(s, s[1:]))


def test_impute_known_and_unseen(spark):
    hist = spark.createDataFrame([("accident", float(d), True) for d in range(1, 120)],
                                 "incident_type string, duration_min double, event_observed boolean")
    curves = survival.km_curves(hist)
    summ = survival.km_summary(curves)
    q = spark.createDataFrame([("k", "accident", T0, T0 + dt.timedelta(minutes=5)), ("u", "novel", T0, None)],
                              "incident_id string, incident_type string, start_datetime timestamp_ntz, end_datetime timestamp_ntz")
    out = {r["incident_id"]: r for r in survival.impute_end_datetime(q, summ).collect()}
    assert out["k"]["imputation_method"] == "known_value" and out["k"]["duration_estimate_min"] is None
    assert "population" in out["u"]["imputation_method"]
    assert 0 < out["u"]["ci_lower"] <= out["u"]["ci_upper"]


def test_format_duration(spark):
    df = spark.createDataFrame([(None,), (0.0,), (59.0,), (61.0,), (1501.0,), (2880.0,)], "m double")
    got = [r[0] for r in df.select(scalars.format_duration(F.col("m"))).collect()]
    assert got == ["0 min", "0 min", "59 min", "1 hr 1 min", "1 day 1 hr 1 min", "2 days"]
