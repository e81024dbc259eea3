"""Streaming and stateful keys.  Streams run with availableNow over the table files."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens.streaming import pipelines as P
from roadlens.streaming import rules as RS
from roadlens.plans.registry import AS_OF, register, rounded


@register("stream_ingest", A.with_views("""
SELECT incident_id, incident_type, strftime(start_datetime, '%Y-%m-%d %H:%M:%S') AS event_text, round(latitude, 6) AS latitude,
  round(longitude, 6) AS longitude, round(severity_raw, 6) AS severity_raw FROM incidents"""))
def q_stream_ingest(spark, sf):
    d = P.ingest(spark, sf)
    return rounded(d.withColumn("event_text", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")).drop("event_time"))


@register("stream_dead_letter", A.with_views("""
SELECT CASE WHEN severity_raw > 100 THEN 'dead_letter' ELSE 'main' END AS sink, count(*) AS rows FROM incidents GROUP BY 1"""))
def q_stream_dead_letter(spark, sf):
    return P.dead_letter(spark, sf).groupBy("sink").agg(F.count("*").alias("rows"))


@register("snk_dead_letter", A.with_views("SELECT incident_id, round(severity_raw, 6) AS severity_raw FROM incidents WHERE severity_raw > 100"))
def q_snk_dead_letter(spark, sf):
    return rounded(P.dead_letter(spark, sf).filter(F.col("sink") == "dead_letter").select("incident_id", "severity_raw"))


@register("stream_dq", A.with_views("""
SELECT strftime(date_trunc('day', start_datetime), '%Y-%m-%d') AS day, count(*) AS received,
  count_if(latitude BETWEEN -33.95 AND -33.75 AND longitude BETWEEN 150.95 AND 151.35) AS passed
FROM incidents GROUP BY 1"""))
def q_stream_dq(spark, sf):
    return P.dq_windows(spark, sf).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "received", "passed")


_RATIO = f"CAST({P.SKETCH_RATIO!r} AS DOUBLE)"


@register("stream_health", A.with_views(f"""
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, round(min(v) FILTER (WHERE upto >= ceil(0.95 * n)), 6) AS p95_ms,
  round(min(v) FILTER (WHERE upto >= ceil(0.99 * n)), 6) AS p99_ms, round(max(n) / 5.0, 6) AS per_minute FROM (
  SELECT w, 2 * pow({_RATIO}, b) / ({_RATIO} + 1) AS v, sum(n) OVER (PARTITION BY w ORDER BY b) AS upto, sum(n) OVER (PARTITION BY w) AS n FROM (
    SELECT date_trunc('minute', ts) - to_minutes(back) AS w, CAST(ceil(ln(latency_ms) / ln({_RATIO})) AS BIGINT) AS b, count(*) AS n
    FROM service_calls, range(5) r(back) GROUP BY ALL) x) y GROUP BY w"""))
def q_stream_health(spark, sf):
    """Sliding latency quantiles from mergeable sketches, at most one per cent off, and calls a minute."""
    return rounded(P.health_windows(spark, sf).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")))


@register("stream_dup_detect", A.with_views("""
SELECT p.incident_type AS typ, count(*) AS duplicate_pairs
FROM incidents p JOIN incidents b ON p.incident_type = b.incident_type AND b.arrival_seq < p.arrival_seq
  AND abs(epoch_us(p.start_datetime) - epoch_us(b.start_datetime)) <= 1800000000
  AND sqrt(pow(abs(p.latitude - b.latitude), 2) + pow(abs(p.longitude - b.longitude), 2)) * 111.0 <= 2.0
GROUP BY p.incident_type"""))
def q_stream_dup_detect(spark, sf):
    return P.dup_counts(spark, sf)


@register("stream_latest", A.with_views("""
SELECT user_id % 50 AS key, max_by(event_id, event_id) AS last_seq, max_by(value, event_id) AS last_value
FROM events GROUP BY user_id % 50"""))
def q_stream_latest(spark, sf):
    return P.latest_table(spark, sf)


def _stream(spark, sf, view):
    """A view over the event stream."""
    return spark.sql(A.VIEWS[view], events=P.table_stream(spark, sf, "events"))


def _chain(rows: str, first: str, period: int) -> str:
    """SQL of the starts (key, t, seq) of a key's periods among ``rows`` (key, t, seq): ``first`` gives each key's first one, and the
    first row at or after a period's end starts the next."""
    return f"""WITH RECURSIVE r AS ({rows}), p AS ({first}
  UNION ALL SELECT n.key, n.s.t, n.s.seq FROM (SELECT p.key, min({{'t': r.t, 'seq': r.seq}}) AS s FROM p JOIN r ON r.key = p.key AND r.t >= p.t + {period}
    GROUP BY p.key, p.t) n)
SELECT * FROM p"""


_FIRST = "SELECT key, s.t, s.seq FROM (SELECT key, min({'t': t, 'seq': seq}) AS s FROM r GROUP BY key) f"
_FIFTH = "SELECT key, t, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS k FROM r) f WHERE k = 5"
FIRED_SQL = ("fired", _chain("SELECT alert_id AS key, epoch_us(ts) AS t, seq FROM alerts", _FIRST, 900_000_000))
BLOCKS_SQL = ("blocks", _chain("SELECT service AS key, epoch_us(ts) AS t, seq FROM service_calls WHERE NOT ok", _FIFTH, 900_000_000))
WINDOWS_SQL = ("windows", _chain("SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS t, event_id AS seq FROM events", _FIRST, 60_000_000))


@register("alert_dedup", A.with_views("""
SELECT a.seq, alert_id, f.seq IS NOT NULL AS fired, f.seq IS NOT NULL AND severity = 'CRITICAL' AS escalated
FROM alerts a LEFT JOIN fired f ON f.key = a.alert_id AND f.seq = a.seq""", FIRED_SQL))
def q_alert_dedup(spark, sf):
    return RS.alert_stream(_stream(spark, sf, "alerts"))


@register("auth_lockout", A.with_views("""
SELECT c.seq, service AS key, EXISTS (SELECT 1 FROM blocks b WHERE b.key = c.service AND epoch_us(c.ts) < b.t + 900000000
  AND (epoch_us(c.ts) > b.t OR (epoch_us(c.ts) = b.t AND c.seq > b.seq))) AS rejected_locked FROM service_calls c""", BLOCKS_SQL))
def q_auth_lockout(spark, sf):
    return RS.lockout_stream(_stream(spark, sf, "service_calls"))


@register("rate_limit_flags", A.with_views("""
SELECT e.event_id AS seq, w.key, w.t + 60000000 AS window_end,
  row_number() OVER (PARTITION BY w.key, w.t ORDER BY e.ts, e.event_id) > 1000 AS limited
FROM events e JOIN windows w ON w.key = CAST(e.user_id AS VARCHAR) AND epoch_us(e.ts) >= w.t AND epoch_us(e.ts) < w.t + 60000000""", WINDOWS_SQL))
def q_rate_limit_flags(spark, sf):
    return RS.rate_stream(P.table_stream(spark, sf, "events"))


# Time-to-live per cached kind, in seconds.
TTL_SECONDS = {"embedding": 86400, "prediction": 7 * 86400, "location": 30 * 86400, "news": 120, "survival_model": 7 * 86400}


@register("ttl_expiry", A.with_views(f"""
SELECT seq, kind FROM (SELECT seq, ts, CASE seq % 5 WHEN 0 THEN 'embedding' WHEN 1 THEN 'prediction' WHEN 2 THEN 'location'
  WHEN 3 THEN 'news' ELSE 'survival_model' END AS kind FROM audit_entries) x
WHERE ts + to_seconds(CASE kind WHEN 'embedding' THEN 86400 WHEN 'prediction' THEN 604800 WHEN 'location' THEN 2592000
  WHEN 'news' THEN 120 ELSE 604800 END) > TIMESTAMP '{AS_OF}'"""))
def q_ttl_expiry(spark, sf):
    from roadlens.operators.features import map_lookup
    a = A.table(spark, sf, "audit_entries")
    kinds = list(TTL_SECONDS)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("seq") % 5 + 1).cast("int"))
    d = a.select("seq", "ts", kind.alias("kind"))
    ttl = map_lookup(TTL_SECONDS, F.col("kind"))
    return d.filter(F.timestamp_add("SECOND", ttl, F.col("ts")) > F.lit(AS_OF).cast("timestamp_ntz")).select("seq", "kind")
