"""The description rules by built-ins against plain Python, on texts around one half and of odd characters."""

import random
from collections import Counter

from pyspark.sql import functions as F

from roadlens.operators import validate as V


def test_rate_and_words(spark):
    rnd = random.Random(12)
    alphabet = "abcdefghijklmnopqrstuvwxyz .,-!0123456789éßÀ漢\n\t"
    texts = [None, "", "   ", "　 x  ", "aaaa", "abab", "a a a", "aab", "...... .", "Aa" * 10 + "b" * 19, "!" * 50 + "word " * 9, "t" * 30 + "e" * 30]
    for _ in range(400):
        c, share = rnd.choice(alphabet), rnd.random()
        texts.append("".join(c if rnd.random() < share else rnd.choice(alphabet) for _ in range(rnd.randrange(1, 200))))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, description string")
    out = {r.id: r for r in V.with_text_stats(df).select("id", "_desc_rate", "_desc_words", F.col("_desc_s").alias("s")).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        if t is None:
            assert r.s is None and r["_desc_rate"] is None
            continue
        s = t.strip()
        count = Counter(s.lower())
        count.pop(" ", None)
        rate = max(count.values()) / len(s) if count else None
        assert r.s == s and r["_desc_words"] == len(s.split()), repr(t)
        if rate is not None and rate > 0.5:
            assert abs(r["_desc_rate"] - rate) < 1e-12, repr(t)
        else:
            assert r["_desc_rate"] is None or r["_desc_rate"] <= 0.5, repr(t)


def _evaluations(df, name: str) -> int:
    """How often the optimized plan computes a function."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"{name}(")


def test_rules_run_once_a_report(spark):
    """Neither a filter on errors nor their explosion brings the text rules into the plan a second time, and no side is broadcast."""
    rows = [("a", "word " * 20), ("b", "x" * 40), ("c", None), ("d", "two words here\nand\x1cthere")]
    df = spark.createDataFrame(rows, "incident_id string, description string").selectExpr(
        "*", "timestamp'2024-01-02 00:00:00' AS start_datetime", "-33.9D AS latitude", "151D AS longitude", "'accident' AS incident_type",
        "true AS is_ongoing", "cast(null AS timestamp) AS end_datetime")
    once = _evaluations(V.validate(df, "2024-01-30 12:00:00").select("incident_id", "errors"), "regexp_replace")
    for out in (V.failing(V.validate(df, "2024-01-30 12:00:00")).select("incident_id", "errors"), V.each_error(V.validate(df, "2024-01-30 12:00:00"), "incident_id")):
        assert _evaluations(out, "regexp_replace") <= once
    bad = {r.incident_id: [e.error_code for e in r.errors] for r in V.failing(V.validate(df, "2024-01-30 12:00:00")).collect()}
    each = sorted((r.incident_id, r.e.error_code) for r in V.each_error(V.validate(df, "2024-01-30 12:00:00"), "incident_id").collect())
    assert set(bad) == {"b", "c"} and each == sorted((k, c) for k, v in bad.items() for c in v) and len(bad["b"]) == 2


def test_texts_are_dealt_over_tasks(spark):
    from roadlens import adapters as A

    from .conftest import SF_SMALL

    plan = A.table(spark, SF_SMALL, "incidents_text").select("incident_id", "description")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
