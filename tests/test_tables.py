"""Typed tables: what fits its declaration is read back typed, what doesn't is told by rule; categories of an encoder."""

import datetime as dt
from decimal import Decimal

from roadlens.operators import encoder
from roadlens.sources import tables


def test_rows_that_break_rules_are_kept_apart(spark, tmp_path):
    rows = [("1", "10.5", 20.0, "a", "ok", "pending", "2024-01-02 03:04:05"), ("2", "north", 20.0, "a", "ok", "pending", "2024-01-02 03:04:05"),
            ("3", "95", 20.0, "a", "ok", "pending", "2024-01-02 03:04:05"), (None, "1", 2.0, "a", "ok", "odd", "2024-01-02 03:04:05"),
            ("5", "1", None, None, "ok", None, "never")]
    df = spark.createDataFrame(rows, "incident_id string, location_latitude string, location_longitude double, incident_type string, "
                                     "description string, status string, start_datetime string")
    df = df.selectExpr("*", "start_datetime as timestamp")
    t = tables.TABLES["incidents"]
    tables.write_table(df, t, str(tmp_path))
    good = tables.read_table(spark, "incidents", str(tmp_path)).collect()
    assert [(r.incident_id, r.location_latitude, r.start_datetime, r.end_datetime, r.day) for r in good] == [
        ("1", Decimal("10.50000000"), dt.datetime(2024, 1, 2, 3, 4, 5), None, dt.date(2024, 1, 2))]
    bad = {r.row.incident_id: r.broken for r in tables.read_rejected(spark, "incidents", str(tmp_path)).collect()}
    assert bad == {"2": ["type:location_latitude"], "3": ["check:valid_location"], None: ["required:incident_id", "check:status"],
                   "5": ["required:location_longitude", "type:timestamp", "type:start_datetime", "required:incident_type"]}
    assert tables.read_table(spark, "incidents", str(tmp_path)).schema["location_longitude"].dataType.simpleString() == "decimal(11,8)"


def test_every_declaration_holds(spark, tmp_path):
    for t in tables.TABLES.values():
        empty = spark.createDataFrame([], "x int")
        tables.write_table(empty, t, str(tmp_path))
        names = [f.name for f in t.fields()]
        assert tables.read_table(spark, t.name, str(tmp_path)).columns[:len(names)] == names
        assert set(t.required) <= set(names) and tables.read_table(spark, t.name, str(tmp_path)).count() == 0


def test_encoder_of_many_categories(spark):
    rows = [(i, float(i % 5) if i % 4 else None, f"c{i % 300}" if i % 7 else None, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, n double, many string, one string")
    fit = encoder.fit(df, ["n"], ["many", "one"])
    cats = {(r.feature, r.category): r.n for r in fit.categories.collect()}
    assert len(cats) == 302 and cats["many", "unknown"] == 429 and cats["one", "x"] == 3000
    stats = fit.stats.first()
    assert stats["one__mode"] == "x" and stats["num_samples"] == 3000
    new = spark.createDataFrame([(1, 2.0, "c5", "x"), (2, None, "never seen", None)], "id long, n double, many string, one string")
    out = {r.id: r for r in encoder.encode(new, fit, ["n"], ["many", "one"]).collect()}
    assert out[1].onehot_names == ["many_c5", "one_x"] and out[2].onehot_names == [None, "one_x"]
    assert out[2].imputed_features == ["n", "one"] and out[2].n_standardized is not None
