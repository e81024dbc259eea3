"""Plans at size: what the files' sizes understate is not passed through the driver or copied whole."""

from pyspark.sql import functions as F

from roadlens.operators import dedup


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def reports(spark, path, n=400):
    spark.range(n).select(F.col("id").cast("string").alias("incident_id"), F.col("id").alias("arrival_seq"), F.lit("accident").alias("incident_type"),
                          F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("start_datetime"), (F.col("id") % 7 / 500.0).alias("latitude"),
                          F.lit(20.0).alias("longitude")).write.parquet(path)
    return spark.read.parquet(path)


def test_probes_of_duplicates_are_not_broadcast(spark, tmp_path):
    """Small files, many exploded probes: both sides of the blocked join meet in a shuffle."""
    df = reports(spark, f"{tmp_path}/r")
    centers = df.selectExpr("arrival_seq as center_id", "latitude as c_lat", "longitude as c_lon")
    for out in (dedup.duplicate_pairs(df), dedup.radius_search(df, centers)):
        joins = [line for line in plan(out).splitlines() if "Join" in line and "_part" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_map_view_shuffles_short_texts(spark):
    """Descriptions are shortened before incidents are shuffled by their id."""
    from roadlens.plans.scalar_reports import q_map_incident_view
    from tests.conftest import SF_SMALL

    out = q_map_incident_view(spark, SF_SMALL)
    text = plan(out)
    top = next(i for i, line in enumerate(text.splitlines()) if "Join" in line and "incident_id" in line)
    assert "substring(" not in "\n".join(text.splitlines()[:top + 1]) and "substring(" in text


def test_landed_csv_files_are_bounded(spark, monkeypatch):
    """A file of the CSV source holds a bounded number of records, and all records are read."""
    import glob

    from roadlens.plans import io_reports
    from tests.conftest import SF_SMALL

    where = []
    path = io_reports._path
    monkeypatch.setattr(io_reports, "_path", lambda *a: where.append(path(*a)) or where[-1])
    whole = {tuple(r) for r in io_reports.q_src_csv_incidents(spark, SF_SMALL).collect()}
    monkeypatch.setattr(io_reports, "CSV_FILE_RECORDS", 40)
    cut = io_reports.q_src_csv_incidents(spark, SF_SMALL)
    assert {tuple(r) for r in cut.collect()} == whole
    files = glob.glob(f"{where[-1].removeprefix('file:')}/*.csv")
    rows = [spark.read.csv(f, header=True, multiLine=True, escape='"').count() for f in files]
    assert max(rows) <= 40 and len(files) >= 20


def test_attributions_are_dealt_over_tasks(spark, monkeypatch):
    """Rows of one file are scored in several tasks, with the same values."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    from roadlens.operators import shapley

    df = spark.createDataFrame([(i, [float(i % 5), float(i % 3)], float(i % 5 + 2 * (i % 3))) for i in range(90)], "id long, x array<double>, y double").coalesce(1)
    model = LinearRegression(labelCol="y").fit(df.withColumn("features", array_to_vector("x")))
    monkeypatch.setattr(shapley, "TASK_ROWS", 10)
    out = shapley.shapley(df, "id", "x", shapley.coalitions([[0.0, 0.0]], [(0, 1), (1, 2)]), {"m": model})
    assert "RoundRobinPartitioning(9)" in plan(out)
    assert all(abs(r["values"][0] - r.id % 5) < 1e-6 and abs(r["values"][1] - 2 * (r.id % 3)) < 1e-6 for r in out.collect())


def test_waiting_events_are_held_as_bytes():
    """A state of many events is a few arrays, and answers come in parts."""
    import numpy as np
    import pandas as pd

    from roadlens.streaming import rules as R

    class State:
        exists, hasTimedOut, get, passed = False, False, None, 0

        def getCurrentWatermarkMs(self):
            return self.passed

        def update(self, x):
            self.exists, self.get = True, x

        def remove(self):
            self.exists = False

        def setTimeoutTimestamp(self, x):
            pass

    n, s = 2 * R.ANSWERS + 7, State()
    rows = pd.DataFrame({"t": np.arange(n)[::-1] * 1000 + 1, "seq": np.arange(n)[::-1], "flag": np.zeros(n, dtype=bool)})
    run = R.rule(R.lockout_step, True, packed=True)
    assert sum(len(x) for x in run(("k",), iter([rows[:100], rows[100:]]), s)) == 0
    assert [len(x) for x in s.get[:3]] == [8 * n, 8 * n, n]
    s.passed, s.hasTimedOut = 10 * n, True
    parts = list(run(("k",), iter([]), s))
    assert [len(x) for x in parts] == [R.ANSWERS, R.ANSWERS, 7] and [*pd.concat(parts)["seq"]] == list(range(n))


def test_exact_search_by_parts(spark, monkeypatch):
    """Parts and blocks of any size give the same ranking: copies by id, missing values and other lengths last."""
    import math
    import random

    from roadlens.operators import lookups as L

    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1.0, 0.5, 2.0, rnd.random()]) for _ in range(3)]) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 3.0]) for i in range(40)] + [(300, None), (301, [1.0, None, 2.0]), (302, [1.0, 2.0]), (None, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    queries = df.filter("id % 20 = 0 and id != 300").selectExpr("id as qid", "v as q")

    def score(a, b):
        if a is None or len(a) != len(b) or None in a + b:
            return None
        dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
        return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))

    def want(q, k):
        held = [(i, score(v, q)) for i, v in rows]
        held.sort(key=lambda x: (x[1] is None, -(x[1] or 0), -1 if x[0] is None else x[0]))
        return [i for i, _ in held[:k]]

    for size, block, k in ((20_000, 4096, 5), (17, 3, 5), (17, 3, 170)):
        monkeypatch.setattr(L, "PART_VECTORS", size)
        monkeypatch.setattr(L, "PART_QUERIES", block)
        out = L.vector_topk(df, "id", "v", queries, k).orderBy("query_label", "rk").collect()
        for q in queries.collect():
            assert [r.id for r in out if r.query_label == q.qid][:160] == want(q.q, k)[:160], (q.qid, size, k)


def odd_reports(spark, n=300):
    """Reports in few blocks, some without a place, time or number, some under one number."""
    import random

    rnd = random.Random(8)
    rows = []
    for i in range(n):
        seq = None if i % 41 == 0 else i - i % 2 if i % 19 == 0 else i
        rows.append((f"r{rnd.randrange(n)}" if i % 23 else None, seq, rnd.choice(["a", "b", None]), 1_700_000_000 + rnd.randrange(4 * 3600),
                     None if i % 31 == 0 else rnd.uniform(10, 10.05), float("nan") if i % 37 == 0 else rnd.uniform(-0.03, 0.03)))
    df = spark.createDataFrame(rows, "incident_id string, arrival_seq long, incident_type string, s long, latitude double, longitude double")
    return rows, df.withColumn("start_datetime", F.timestamp_seconds("s")).drop("s")


def plain_lists(rows):
    def like(p, b):
        if None in (*p[1:], *b[1:]) or p[2] != b[2] or b[1] >= p[1] or abs(p[3] - b[3]) > 1800:
            return False
        return ((p[4] - b[4]) ** 2 + (p[5] - b[5]) ** 2) ** 0.5 * 111.0 <= 2.0

    found = {}
    for p in rows:
        found.setdefault(p[1], []).extend((b[1], b[0] or "", b[0]) for b in rows if like(p, b))
    return {k: [x[2] for x in sorted(v, key=lambda x: x[:2])] for k, v in found.items() if v}


def test_duplicate_lists_need_no_shuffle_of_pairs(spark, monkeypatch):
    """dup_detect: lists are made where a report's block is read: one shuffle of reports, nothing collected or sorted behind it."""
    from roadlens.plans import blocking
    from roadlens.plans.validation_reports import q_dup_detect
    from tests.conftest import SF_SMALL

    text = plan(q_dup_detect(spark, SF_SMALL))
    assert "collect_list" not in text and text.count("Exchange hashpartitioning") == 1
    rows, df = odd_reports(spark)
    want = plain_lists(rows)
    for load, candidates, answers in ((2000, dedup.CANDIDATES, dedup.ANSWERS), (7, 5, 3)):
        monkeypatch.setattr(blocking.split_blocks, "__defaults__", (load,))
        monkeypatch.setattr(dedup, "CANDIDATES", candidates)
        monkeypatch.setattr(dedup, "ANSWERS", answers)
        got = dedup.dup_detect(df).collect()
        assert {r.arrival_seq: r.duplicate_incident_ids for r in got} == want and len(got) == len(want)
        every = dedup.with_matches(df).collect()
        assert len(every) == len(rows) and all(r.duplicate_incident_ids == want.get(r.arrival_seq) for r in every)


def test_block_over_several_batches(spark):
    """A block whose rows come in many Arrow batches gives the same lists."""
    rows, df = odd_reports(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.arrival_seq: r.duplicate_incident_ids for r in dedup.dup_detect(df).collect()} == plain_lists(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_validated_reports_are_not_joined_with_their_lists(spark):
    """val_combined, val_stats: lists are attached where they are made, not shuffled, sorted and joined; same lists as dup_detect."""
    from roadlens.operators import validate

    rows, df = odd_reports(spark)
    v = df.withColumns({"schema_ok": F.col("incident_id").isNotNull(), "errors": F.array().cast(validate.ERROR_TYPE)})
    out = validate.with_duplicates(v)
    assert out.columns[0] == "arrival_seq" and set(out.columns) == {*v.columns, dedup.MATCHES}
    got = out.collect()
    want = plain_lists([r for r in rows if r[0] is not None])
    assert len(got) == len(rows)
    for r in got:
        assert r.duplicate_incident_ids == (want.get(r.arrival_seq, []) if r.schema_ok else None)
    unlike = v.filter("arrival_seq % 2 = 1")
    text = plan(validate.with_duplicates(unlike))
    assert "collect_list" not in text and "SortMergeJoin" not in text and "ShuffledHashJoin" not in text


def test_large_csv_landings_are_compressed(spark, monkeypatch):
    """src_csv_incidents: a large landing takes a fraction of its texts, and gives the same rows."""
    import glob
    import os

    from roadlens.plans import io_reports
    from tests.conftest import SF_SMALL

    where = []
    path = io_reports._path
    monkeypatch.setattr(io_reports, "_path", lambda *a: where.append(path(*a)) or where[-1])
    sizes, rows = [], []
    for plain in (io_reports.CSV_PLAIN_RECORDS, 10):
        monkeypatch.setattr(io_reports, "CSV_PLAIN_RECORDS", plain)
        rows.append(sorted((tuple(r) for r in io_reports.q_src_csv_incidents(spark, SF_SMALL).collect()), key=repr))
        sizes.append(sum(os.path.getsize(f) for f in glob.glob(f"{where[-1].removeprefix('file:')}/part-*")))
    assert rows[0] == rows[1] and len(rows[0]) > 900 and sizes[1] < sizes[0] / 2


def test_copies_of_centers_stay_in_proportion(spark, monkeypatch):
    """radius_search: a center meets a bounded number of parts, however many points its block holds; same pairs."""
    import random

    from roadlens.plans import blocking

    rnd = random.Random(3)
    points = spark.createDataFrame([(i, 10 + rnd.random() / 500, 20 + rnd.random() / 500) for i in range(600)], "i long, latitude double, longitude double")
    centers = spark.createDataFrame([(i, 10 + rnd.random() / 40, 20 + rnd.random() / 40) for i in range(30)], "center_id long, c_lat double, c_lon double")
    rows = lambda: sorted((r.center_id, r.i) for r in dedup.radius_search(points, centers, 1000.0).collect())
    whole, seen = rows(), []
    monkeypatch.setattr(blocking.split_blocks, "__defaults__", (2,))
    monkeypatch.setattr(dedup, "MOST_PARTS", 4)
    split = dedup.split_blocks
    monkeypatch.setattr(dedup, "split_blocks", lambda *a, **k: seen.append(split(*a, **k)) or seen[-1])
    assert rows() == whole and len(whole) > 500
    probe, build, keys = seen[-1]
    assert build.select("_part").distinct().count() == 4
    assert probe.count() <= 4 * probe.select("center_id", "_cy", "_cx").distinct().count()


def test_line_keys_are_shuffled_once(spark, monkeypatch):
    """op7_line_dedup: the least node of a key is found where its nodes meet; nothing but (key, node) travels."""
    from roadlens.llm import line_dedup

    lines = spark.createDataFrame([(i, [i // 2, 100 + i % 3, 200 + i]) for i in range(12)], "node long, keys array<long>")
    want = sorted((k, n) for n in range(12) for k in (n // 2, 100 + n % 3))
    plans = []
    stored = line_dedup.C.stored
    monkeypatch.setattr(line_dedup.C, "stored", lambda df, tag: plans.append(plan(df)) or stored(df, tag))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = line_dedup.key_members(lines, "t").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sorted((r.key, r.node) for r in rows) == want
    assert all(r.lo == (min(n for k, n in want if k == r.key)) and r.n == sum(k == r.key for k, _ in want) for r in rows)
    assert len(plans) == 2 and all(p.count("Exchange hashpartitioning") == 2 and p.count("ReusedExchange") == 1 for p in plans)


def test_tree_fits_take_two_tasks_a_core(spark, monkeypatch):
    """duration_model, calibrate_confidence, quantile_severity: tasks, and with them the sums they send, are bounded by the cores."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    from roadlens.operators import models

    seen = []
    fit = GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    df = spark.range(400).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") % 7).cast("double").alias("y"))
    models.fit_gbt(df, "y", max_iter=1, max_depth=2, rows_per_task=1)
    models.fit_gbt(df, "y", max_iter=1, max_depth=2, rows_per_task=200)
    assert seen == [2 * spark.sparkContext.defaultParallelism, 2]
