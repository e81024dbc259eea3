"""Streams over a table of several part files in mixed time order: nothing is lost or counted twice."""

from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens.plans import stream_reports as S
from roadlens.streaming import pipelines as P

from .conftest import SF_SMALL


def split_table(spark, tmp_path):
    d = f"{tmp_path}/sf"
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(3, F.col("event_id") % 7).write.parquet(f"{d}/events.parquet")
    return d


def test_windows_of_a_folder_of_part_files(spark, tmp_path):
    d = split_table(spark, tmp_path)
    got = {r.day: (r.received, r.passed) for r in S.q_stream_dq(spark, d).collect()}
    inc = A.table(spark, SF_SMALL, "incidents")
    inside = F.col("latitude").between(-33.95, -33.75) & F.col("longitude").between(150.95, 151.35)
    want = inc.groupBy(F.date_format("start_datetime", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(inside).alias("p"))
    assert got == {r.day: (r.n, r.p) for r in want.collect()} and sum(n for n, _ in got.values()) == 1000


def test_duplicates_of_late_reports(spark, tmp_path):
    d = split_table(spark, tmp_path)
    key = lambda df: sorted(tuple(r) for r in df.select("id", "b_id", "typ").collect())
    assert key(P.dup_pairs(spark, d)) == key(P.dup_pairs(spark, SF_SMALL))


def test_latest_and_dead_letter(spark, tmp_path):
    d = split_table(spark, tmp_path)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(P.latest_table(spark, d)) == rows(P.latest_table(spark, SF_SMALL))
    assert P.dead_letter(spark, d).count() == 1000


def test_duplicates_with_a_short_delay(spark, tmp_path):
    """Most reports are too late for a short delay: the second pass finds their pairs, none twice."""
    d = split_table(spark, tmp_path)
    key = lambda df: sorted(tuple(r) for r in df.select("id", "b_id", "typ").collect())
    want = key(P.dup_pairs(spark, SF_SMALL))
    taken = spark.read.parquet(f"{P.run_available(P.once(P.incident_stream(spark, d), '1 minute'), 'short')}/data").count()
    assert 0 < taken < 1000
    got = key(P.dup_pairs(spark, d, delay="1 minute"))
    assert got == want and len(set(got)) == len(got)


def test_sketches_merge_and_keep_their_error(spark):
    import random

    rnd = random.Random(6)
    rows = [(i, rnd.randrange(0, 3600), rnd.choice([rnd.lognormvariate(3, 2), 0.0, -rnd.random() * 50])) for i in range(4000)]
    calls = spark.createDataFrame(rows, "seq long, s long, latency_ms double").selectExpr("*", "timestamp_seconds(1700000040 + s) as event_time")
    parts = None
    for i in range(3):  # sketches of parts of the rows, merged
        part = P.pane_sketches(calls.filter(F.col("seq") % 3 == i))
        parts = part if parts is None else parts.unionByName(part)
    out = P.sliding_quantiles(parts, {"p10": 0.1, "p50": 0.5, "p99": 0.99}).selectExpr("unix_seconds(window_start) - 1700000040 as w", "*").collect()
    assert len(out) == 60 + 4
    for r in out:
        held = sorted(v for _, s, v in rows if r.w <= s < r.w + 300)
        assert abs(r.per_minute * 5 - len(held)) < 1e-9
        for name, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            true = held[max(0, -(-int(q * 1000) * len(held) // 1000) - 1)]
            assert abs(r[name] - true) <= P.SKETCH_ERROR * abs(true) * (1 + 1e-9)


def test_health_of_a_folder_of_part_files(spark, tmp_path):
    d = split_table(spark, tmp_path)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(S.q_stream_health(spark, d)) == rows(S.q_stream_health(spark, SF_SMALL))


def test_duplicates_are_counted_by_batch(spark, tmp_path, monkeypatch):
    """Counts of part files in mixed time order equal those of the pairs, no pair is written, and the join keeps no state of reports."""
    import glob

    d = split_table(spark, tmp_path)
    bases = []
    run = P.run_available
    monkeypatch.setattr(P, "run_available", lambda *a, **k: bases.append(run(*a, **k)) or bases[-1])
    want = {r.typ: r["count"] for r in P.dup_pairs(spark, SF_SMALL).groupBy("typ").count().collect()}
    bases.clear()
    assert sum(want.values()) > 0
    for delay in ("1 day", "1 minute"):
        assert {r.typ: r.duplicate_pairs for r in P.dup_counts(spark, d, delay=delay).collect()} == want
    assert {r.typ: r.duplicate_pairs for r in S.q_stream_dup_detect(spark, d).collect()} == want
    for base in bases:
        base = base.removeprefix("file:")
        assert not glob.glob(f"{base}/pairs*") and glob.glob(f"{base}/counts/batch=*")
        assert len(glob.glob(f"{base}/_checkpoint/state/*")) == 1  # ids of the reports, nothing of the join
