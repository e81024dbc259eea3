"""Views that give the driver's tables the shape of the incident data model.

The view texts are plain SQL that both Spark and DuckDB accept unchanged, so the
same text feeds the Spark side (``spark.sql`` with DataFrame arguments, no global
temp views) and the DuckDB oracle (as CTEs).  Table references are written as
``{name}``; a DataFrame or a view name is substituted at use.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# The adapter views (names, mappings and constants are part of the test contract).
VIEWS: dict[str, str] = {
    "incidents": """
SELECT CAST(event_id AS STRING) AS incident_id, event_id AS arrival_seq, ts AS start_datetime, user_id,
  CASE event_type WHEN 'error' THEN 'accident' WHEN 'view' THEN 'congestion' WHEN 'click' THEN 'roadwork'
                  WHEN 'purchase' THEN 'weather' ELSE 'unknown' END AS incident_type,
  CAST(-33.97 AS DOUBLE) + CAST(user_id % 8 AS DOUBLE) * CAST(0.035 AS DOUBLE)
    + CAST((event_id*7919) % 100 AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS latitude,
  CAST(150.93 AS DOUBLE) + CAST((user_id*3) % 8 AS DOUBLE) * CAST(0.06 AS DOUBLE)
    + CAST((event_id*104729) % 100 AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS longitude,
  value AS severity_raw, value AS duration_min, k, k % 4 <> 0 AS event_observed,
  CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(30 AS DOUBLE) - k * CAST(0.4 AS DOUBLE) END AS temperature,
  CASE k % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' ELSE NULL END AS priority,
  CASE k % 8 WHEN 0 THEN 'accident' WHEN 1 THEN 'congestion' WHEN 2 THEN 'road_closure' WHEN 3 THEN 'hazard'
             WHEN 4 THEN 'event' WHEN 5 THEN 'construction' WHEN 6 THEN 'vip_movement' ELSE 'water_logging' END AS event_cause,
  CASE k % 6 WHEN 0 THEN 'truck' WHEN 1 THEN 'lcv' WHEN 2 THEN 'bmtc_bus' WHEN 3 THEN 'car' ELSE NULL END AS veh_type,
  CASE k % 5 WHEN 0 THEN 'ORR East' WHEN 1 THEN 'CBD 1' WHEN 2 THEN 'Tumkur Road' ELSE 'Other' END AS corridor
FROM (SELECT *, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k FROM {events}) e
""",
    # The document index is computed in a projection (scalar subquery) so the join is a
    # plain equi-join of two relations that the optimizer cannot turn into a cross product.
    "incidents_text": """
SELECT i.*, d.text AS description
FROM (SELECT *, arrival_seq % (SELECT COUNT(*) FROM {documents}) AS doc_key FROM {incidents}) i
  JOIN {documents} d ON d.doc_id = i.doc_key
""",
    "predictions": """
SELECT CAST(event_id AS STRING) AS incident_id, event_id AS seq, ts, CONCAT('m', CAST(user_id % 3 AS STRING)) AS model,
  LEAST(value, CAST(100 AS DOUBLE)) AS predicted,
  LEAST(value, CAST(100 AS DOUBLE)) + CAST((event_id*31) % 100 - 50 AS DOUBLE) * CAST(0.15 AS DOUBLE) AS actual FROM {events}
""",
    "service_calls": """
SELECT event_id AS seq, event_type AS service, ts, value * CAST(10 AS DOUBLE) AS latency_ms, (event_id*13) % 10 >= 3 AS ok FROM {events}
""",
    "alerts": """
SELECT event_id AS seq, CONCAT(event_type, '_', CAST(user_id % 4 AS STRING)) AS alert_id, ts,
  CASE WHEN event_id % 10 = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM {events}
""",
    "audit_entries": """
SELECT event_id AS seq, ts, CAST(event_id AS STRING) AS incident_id,
  CASE event_id % 4 WHEN 0 THEN 'validation_batch' WHEN 1 THEN 'embedding_generation'
                    WHEN 2 THEN 'missing_value_imputation' ELSE 'duplicate_detection' END AS operation,
  CASE WHEN event_type='error' THEN 'failure' WHEN event_type='click' THEN 'partial' ELSE 'success' END AS status FROM {events}
""",
    "road_nodes": """
SELECT s_suppkey AS node_id,
  CAST(150.93 AS DOUBLE) + CAST((s_suppkey*37) % 100 AS DOUBLE)*CAST(0.0042 AS DOUBLE) + CAST(s_suppkey AS DOUBLE)*CAST(0.0000013 AS DOUBLE) AS lon,
  CAST(-33.97 AS DOUBLE) + CAST((s_suppkey*53) % 100 AS DOUBLE)*CAST(0.0025 AS DOUBLE) AS lat FROM {supplier}
""",
    "node_series": """
SELECT user_id % 8 AS node_id, (day(ts)-1)*24 + hour(ts) AS step, LEAST(AVG(value)/100, CAST(1 AS DOUBLE)) AS occupancy
FROM {events} GROUP BY user_id % 8, (day(ts)-1)*24 + hour(ts)
""",
    "weather_obs": """
SELECT event_id AS obs_id, user_id % 8 AS site, ts, CAST(GREATEST(event_id % 100 - 60, 0) AS DOUBLE)/10 AS precipitation
FROM {events} WHERE event_type = 'purchase'
""",
    "news": """
SELECT doc_id AS news_id, text AS title, source, doc_id % 120 AS age_days FROM {documents}
""",
}

_REF = re.compile(r"\{(\w+)\}")


def deps(name: str) -> list[str]:
    return _REF.findall(VIEWS[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or an adapter view as a DataFrame."""
    if name in VIEWS:
        args = {d: table(spark, sf_dir, d) for d in set(deps(name))}
        if name == "incidents_text":  # a broadcast side would leave the texts of a file, times its incidents, to one task
            args["documents"] = args["documents"].hint("merge")
        return spark.sql(VIEWS[name], **args)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@lru_cache(maxsize=None)
def _closure(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in VIEWS or n in order:
            return
        for d in deps(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_views(sql: str, *extra_ctes: tuple[str, str]) -> str:
    """Prefix an oracle query with the CTEs of every adapter view it mentions.

    ``extra_ctes`` are (name, DuckDB SQL) pairs for oracle-only helper views and may
    themselves refer to adapter views.
    """
    text = sql + " ".join(s for _, s in extra_ctes)
    used = tuple(n for n in VIEWS if re.search(rf"\b{n}\b", text))
    ctes = [(n, _REF.sub(lambda m: m.group(1), VIEWS[n])) for n in _closure(used)]
    ctes += list(extra_ctes)
    if not ctes:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in ctes) + "\n" + sql


def incident_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident reports as submitted: the text view plus the fields the validator reads.

    end_datetime = start + duration when the event was observed; is_ongoing is
    the negation, except every 7th k also claims to be ongoing (so the
    consistency rule has something to catch).
    """
    df = table(spark, sf_dir, "incidents_text")
    end = F.timestamp_add("MICROSECOND", F.round(F.col("duration_min") * 60000000).cast("long"),
                          F.col("start_datetime"))
    return df.select(
        "incident_id", "arrival_seq", "start_datetime", "incident_type", "latitude", "longitude",
        "description", F.col("severity_raw").alias("severity_initial"), "temperature",
        F.when(F.col("event_observed"), end).alias("end_datetime"),
        (~F.col("event_observed") | (F.col("k") % 7 == 0)).alias("is_ongoing"),
        "priority", "event_cause", "veh_type", "corridor", "duration_min", "event_observed", "user_id", "k")


# DuckDB text of the same derivation, used as an oracle CTE.
INCIDENT_REPORTS_SQL = ("incident_reports", """
SELECT incident_id, arrival_seq, start_datetime, incident_type, latitude, longitude, description,
  severity_raw AS severity_initial, temperature,
  CASE WHEN event_observed THEN start_datetime + to_microseconds(CAST(round(duration_min * 60000000) AS BIGINT)) END AS end_datetime,
  (NOT event_observed) OR k % 7 = 0 AS is_ongoing,
  priority, event_cause, veh_type, corridor, duration_min, event_observed, user_id, k
FROM incidents_text""")
