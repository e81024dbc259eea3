"""Window keys and the monitoring aggregates built on them.

Per-key ordered frames ("last N rows") use ``plans.ordered``: a dense index per key
computed bucket-wise, then row frames evaluated per block with a halo, so no single
task ever holds a whole hot key.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens.operators import monitoring as M
from roadlens.plans.registry import register, rounded


@register("drift_mae", A.with_views("""
SELECT incident_id, model, idx,
  CASE WHEN idx >= 100 THEN round(avg(err) OVER (PARTITION BY model ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) END AS mae_100,
  CASE WHEN idx >= 500 THEN round(avg(err) OVER (PARTITION BY model ORDER BY seq ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 6) END AS mae_500,
  coalesce(idx >= 100 AND round(avg(err) OVER (PARTITION BY model ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) > 3.675, false)
   OR coalesce(idx >= 500 AND round(avg(err) OVER (PARTITION BY model ORDER BY seq ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 9) > 3.675, false) AS drift
FROM (SELECT *, abs(predicted - actual) AS err, row_number() OVER (PARTITION BY model ORDER BY seq) AS idx FROM predictions) p"""))
def q_drift_mae(spark, sf):
    out = M.drift_mae(A.table(spark, sf, "predictions"))
    return rounded(out.select("incident_id", "model", "idx", "mae_100", "mae_500", "drift"))


@register("latency_fallback", A.with_views("""
SELECT seq, service, on_now AS fallback_on, on_now <> coalesce(lag(on_now) OVER (PARTITION BY service ORDER BY seq), false) AS transition
FROM (SELECT seq, service, idx >= 5 AND min(latency_ms) OVER (PARTITION BY service ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 500 AS on_now
      FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY seq) AS idx FROM service_calls) s) t"""))
def q_latency_fallback(spark, sf):
    out = M.latency_fallback(A.table(spark, sf, "service_calls"))
    return out.select("seq", "service", "fallback_on", "transition")


@register("latency_moving_avg", A.with_views("""
SELECT seq, service, round(avg(latency_ms) OVER w, 6) AS moving_avg_50, round(latency_ms - avg(latency_ms) OVER w, 6) AS delta_from_avg
FROM service_calls WINDOW w AS (PARTITION BY service ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"""))
def q_latency_moving_avg(spark, sf):
    out = M.latency_moving_avg(A.table(spark, sf, "service_calls"))
    return rounded(out.select("seq", "service", "moving_avg_50", "delta_from_avg"))


@register("metric_histogram", A.with_views("""
SELECT service, count_if(latency_ms <= 100) AS le_100, count_if(latency_ms <= 500) AS le_500, count(*) AS le_inf,
  round(sum(latency_ms), 6) AS sum_ms, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY seq DESC) AS rn FROM service_calls) s WHERE rn <= 1000
GROUP BY service"""))
def q_metric_histogram(spark, sf):
    return rounded(M.metric_histogram(A.table(spark, sf, "service_calls")))


@register("latency_stats", A.with_views("""
SELECT service, count(*) AS n, round(min(latency_ms), 6) AS min_ms, round(max(latency_ms), 6) AS max_ms,
  round(avg(latency_ms), 6) AS avg_ms, round(max_by(latency_ms, seq), 6) AS latest_ms FROM service_calls GROUP BY service"""))
def q_latency_stats(spark, sf):
    return rounded(M.latency_stats(A.table(spark, sf, "service_calls")))


@register("latency_budget_total", A.with_views("""
SELECT round(sum(latest), 6) AS total_ms, sum(latest) > 500 AS over_budget, count(*) AS operations
FROM (SELECT service, max_by(latency_ms, seq) AS latest FROM service_calls WHERE service IN ('view', 'click', 'error')
      GROUP BY service) s"""))
def q_latency_budget_total(spark, sf):
    return rounded(M.latency_budget_total(A.table(spark, sf, "service_calls"), ["view", "click", "error"], 500.0))


@register("service_error_rate", A.with_views("""
SELECT a.service, a.calls, round(a.error_rate, 6) AS error_rate, round(l.avg_latency_100, 6) AS avg_latency_100,
  (a.calls >= 5 AND l.avg_latency_100 > 500) OR (a.calls >= 5 AND a.error_rate > 0.5) AS would_open
FROM (SELECT service, count(*) AS calls, count_if(NOT ok) / count(*) AS error_rate FROM service_calls GROUP BY service) a
JOIN (SELECT service, avg(latency_ms) AS avg_latency_100 FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY seq DESC) AS rn
      FROM service_calls) s WHERE rn <= 100 GROUP BY service) l ON a.service = l.service"""))
def q_service_error_rate(spark, sf):
    return rounded(M.service_error_rate(A.table(spark, sf, "service_calls")))


@register("metric_counters", A.with_views("""
SELECT service AS name, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status, count(*) AS n FROM service_calls GROUP BY 1, 2"""))
def q_metric_counters(spark, sf):
    sc = A.table(spark, sf, "service_calls")
    return M.metric_counters(sc.select(F.col("service").alias("name"),
                                       F.when(F.col("ok"), "ok").otherwise("error").alias("status")), ["name", "status"])


@register("latest_per_incident", A.with_views("""
SELECT user_id % 50 AS incident_key, max_by(event_id, event_id) AS last_seq, max_by(value, event_id) AS last_value
FROM events GROUP BY user_id % 50"""))
def q_latest_per_incident(spark, sf):
    ev = A.table(spark, sf, "events").select((F.col("user_id") % 50).alias("incident_key"),
                                             F.col("event_id").alias("seq"), "value")
    out = M.latest_per_key(ev, ["incident_key"], "seq", ["seq", "value"])
    return out.select("incident_key", F.col("seq").alias("last_seq"), F.col("value").alias("last_value"))


@register("admission_cap", A.with_views("""
WITH firsts AS (SELECT user_id, min(event_id) AS first_seq FROM events GROUP BY user_id),
admitted AS (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY first_seq) AS r FROM firsts) x WHERE r <= 50)
SELECT e.user_id, count(*) AS updates, max(e.event_id) AS last_seq FROM events e SEMI JOIN admitted a ON e.user_id = a.user_id
GROUP BY e.user_id"""))
def q_admission_cap(spark, sf):
    ev = A.table(spark, sf, "events")
    adm = M.admission_cap(ev, "user_id", "event_id", 50)
    return adm.groupBy("user_id").agg(F.count("*").alias("updates"), F.max("event_id").alias("last_seq"))


@register("chrono_split", A.with_views("""
SELECT CASE WHEN step < floor(n * 0.6) THEN 'train' WHEN step < floor(n * 0.8) THEN 'val' ELSE 'test' END AS split,
  count(*) AS rows, min(step) AS first_step, max(step) AS last_step
FROM (SELECT step, (SELECT max(step) + 1 FROM node_series) AS n FROM node_series) s GROUP BY 1"""))
def q_chrono_split(spark, sf):
    ns = A.table(spark, sf, "node_series")
    out = M.chrono_split(ns, "step")
    return out.groupBy("split").agg(F.count("*").alias("rows"), F.min("step").alias("first_step"),
                                    F.max("step").alias("last_step"))


@register("arrival_order", A.with_views("""
SELECT incident_type, arrival_seq, row_number() OVER (PARTITION BY incident_type ORDER BY arrival_seq) AS type_arrival_no
FROM incidents"""))
def q_arrival_order(spark, sf):
    inc = A.table(spark, sf, "incidents")
    out = M.arrival_number(inc, ["incident_type"], "arrival_seq")
    return out.select("incident_type", "arrival_seq", F.col("idx").alias("type_arrival_no"))


@register("incident_sequence", A.with_views("""
SELECT incident_id, len(seq5) AS seq_len,
  round(list_sum(list_transform(seq5, lambda v: v[1])), 6) AS sum_first_feature,
  round(seq5[5][2], 6) AS current_second_feature, round(seq5[1][1], 6) AS oldest_first_feature
FROM (SELECT incident_id, list_concat(list_transform(range(5 - cnt), lambda i: [0.0, 0.0, 0.0]), hist) AS seq5
      FROM (SELECT incident_id,
              list([latitude, longitude, severity_raw]) OVER (PARTITION BY incident_type ORDER BY arrival_seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hist,
              count(*) OVER (PARTITION BY incident_type ORDER BY arrival_seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS cnt
            FROM incidents) h) s"""))
def q_incident_sequence(spark, sf):
    inc = A.table(spark, sf, "incidents")
    out = M.incident_sequence(inc, ["incident_type"], "arrival_seq", ["latitude", "longitude", "severity_raw"], 5)
    s = F.col("sequence")
    return rounded(out.select("incident_id", F.size(s).alias("seq_len"),
                              F.aggregate(F.transform(s, lambda v: v[0]), F.lit(0.0), lambda a, x: a + x).alias("sum_first_feature"),
                              s[4][1].alias("current_second_feature"), s[0][0].alias("oldest_first_feature")))


@register("sliding_samples", A.with_views("""
SELECT node_id, step, round(list_sum(x), 6) AS sum_inputs, round(list_sum(y), 6) AS sum_targets, len(x) AS n_in, len(y) AS n_out
FROM (SELECT node_id, step,
        list(occupancy) OVER (PARTITION BY node_id ORDER BY step ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS x,
        list(occupancy) OVER (PARTITION BY node_id ORDER BY step ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS y
      FROM node_series) s WHERE len(x) = 24 AND len(y) = 6"""))
def q_sliding_samples(spark, sf):
    ns = A.table(spark, sf, "node_series")
    out = M.sliding_samples(ns, ["node_id"], "step", "occupancy", 24, 6)
    return rounded(out.select("node_id", "step",
                              F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("sum_inputs"),
                              F.aggregate("y", F.lit(0.0), lambda a, v: a + v).alias("sum_targets"),
                              F.size("x").alias("n_in"), F.size("y").alias("n_out")))


@register("dq_window_metrics", A.with_views("""
SELECT time_bucket(INTERVAL 1 DAY, start_datetime) AS window_start, count(*) AS received,
  count_if(latitude BETWEEN -33.95 AND -33.75 AND longitude BETWEEN 150.95 AND 151.35) AS passed,
  count_if(NOT (latitude BETWEEN -33.95 AND -33.75 AND longitude BETWEEN 150.95 AND 151.35)) AS failed,
  count_if(NOT event_observed) AS missing_end,
  round(count_if(latitude BETWEEN -33.95 AND -33.75 AND longitude BETWEEN 150.95 AND 151.35) / count(*), 6) AS pass_rate,
  round(1 - (count_if(temperature IS NULL) + count_if(priority IS NULL)) / (2.0 * count(*)), 6) AS completeness
FROM incidents GROUP BY 1"""))
def q_dq_window_metrics(spark, sf):
    return rounded(M.dq_window_metrics(A.table(spark, sf, "incidents"), "1 day"))


@register("dq_threshold_alerts", A.with_views("""
SELECT seq, round(cum_pass / cum_total, 6) AS pass_rate, round(cum_missing_temp / cum_total, 6) AS missing_temperature_rate,
  round(cum_missing_priority / cum_total, 6) AS missing_priority_rate, round(cum_missing_veh / cum_total, 6) AS missing_veh_type_rate,
  cum_pass / cum_total < 0.9 AS low_pass_rate,
  greatest(cum_missing_temp, cum_missing_priority, cum_missing_veh) / cum_total > 0.4 AS high_missing
FROM (SELECT arrival_seq AS seq,
        count(*) OVER w AS cum_total,
        sum(CASE WHEN latitude BETWEEN -33.95 AND -33.75 AND longitude BETWEEN 150.95 AND 151.35 THEN 1 ELSE 0 END) OVER w AS cum_pass,
        sum(CASE WHEN temperature IS NULL THEN 1 ELSE 0 END) OVER w AS cum_missing_temp,
        sum(CASE WHEN priority IS NULL THEN 1 ELSE 0 END) OVER w AS cum_missing_priority,
        sum(CASE WHEN veh_type IS NULL THEN 1 ELSE 0 END) OVER w AS cum_missing_veh
      FROM incidents WINDOW w AS (ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) c
WHERE cum_total > 100 AND (cum_pass / cum_total < 0.9
  OR greatest(cum_missing_temp, cum_missing_priority, cum_missing_veh) / cum_total > 0.4)"""))
def q_dq_threshold_alerts(spark, sf):
    return rounded(M.dq_threshold_alerts(A.table(spark, sf, "incidents")))


@register("health_snapshot", A.with_views("""
SELECT date_trunc('hour', ts) AS hour, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,
  round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, round(count(*) / 60.0, 6) AS calls_per_minute,
  CASE WHEN quantile_cont(latency_ms, 0.95) > 450 OR quantile_cont(latency_ms, 0.99) > 500 THEN 'degraded' ELSE 'healthy' END AS status
FROM service_calls GROUP BY 1"""))
def q_health_snapshot(spark, sf):
    return rounded(M.health_snapshot(A.table(spark, sf, "service_calls")))
