"""Survival keys (KM curves, medians, intervals, imputation) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens.operators import survival as S
from roadlens.plans.registry import register, rounded

KM_CTES = [
    ("km_base", "SELECT incident_type AS grp, duration_min AS t, event_observed AS e FROM incidents WHERE duration_min > 0"),
    ("km_all", "SELECT * FROM km_base UNION ALL SELECT '__population__' AS grp, t, e FROM km_base"),
    ("km_agg", "SELECT grp, t, count_if(e) AS d, count(*) AS c FROM km_all GROUP BY grp, t"),
    ("km_sizes", "SELECT grp, sum(c) AS n_total FROM km_agg GROUP BY grp HAVING grp = '__population__' OR sum(c) >= 50"),
    ("km_r", """SELECT a.grp, a.t, a.d, a.c, s.n_total,
  s.n_total - coalesce(sum(a.c) OVER (PARTITION BY a.grp ORDER BY a.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_at_risk
  FROM km_agg a JOIN km_sizes s ON a.grp = s.grp"""),
    ("curves", """SELECT grp, t, d, c, n_total, n_at_risk,
  CASE WHEN sum(CASE WHEN d >= n_at_risk THEN 1 ELSE 0 END) OVER w > 0 THEN 0.0
       ELSE exp(sum(CASE WHEN d < n_at_risk THEN ln(1 - d / n_at_risk) ELSE 0 END) OVER w) END AS survival
  FROM km_r WINDOW w AS (PARTITION BY grp ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    ("km_med", """SELECT grp, min(CASE WHEN survival <= 0.5 + 1e-12 THEN t END) AS km_median, min(n_total) AS n_samples
  FROM curves GROUP BY grp"""),
    ("km_obs", """SELECT grp, quantile_cont(t, 0.5) AS duration_median, count_if(e) AS n_observed,
  quantile_cont(t, 0.025) FILTER (WHERE e) AS p_lo, quantile_cont(t, 0.975) FILTER (WHERE e) AS p_hi FROM km_all GROUP BY grp"""),
    ("km_pts", """SELECT g.grp, p.point FROM (SELECT DISTINCT grp FROM curves) g,
  (SELECT unnest([10, 25, 50, 75, 90]) AS point) p"""),
    ("km_steps", """SELECT p.grp, p.point, coalesce(max_by(c.survival, c.t), 1.0) AS s_at
  FROM km_pts p LEFT JOIN curves c ON c.grp = p.grp AND c.t <= p.point GROUP BY p.grp, p.point"""),
    ("km_summary", """SELECT m.grp, m.n_samples, o.n_observed,
  coalesce(m.km_median, o.duration_median, 30.0) AS median_duration,
  CASE WHEN o.n_observed > 10 THEN greatest(1.0, o.p_lo) ELSE greatest(1.0, coalesce(m.km_median, o.duration_median, 30.0) * 0.6) END AS ci_lower,
  CASE WHEN o.n_observed > 10 THEN greatest(coalesce(m.km_median, o.duration_median, 30.0), o.p_hi)
       ELSE coalesce(m.km_median, o.duration_median, 30.0) * 1.8 END AS ci_upper
  FROM km_med m JOIN km_obs o ON m.grp = o.grp"""),
]


def _km(spark, sf):
    inc = A.table(spark, sf, "incidents")
    curves = S.km_curves(inc)
    return inc, curves, S.km_summary(curves)


def _sql(sql):
    return A.with_views(sql, *KM_CTES)


@register("km_fit_population", _sql("""
SELECT t, d, n_at_risk, round(survival, 6) AS survival FROM curves WHERE grp = '__population__'"""))
def q_km_fit_population(spark, sf):
    _, curves, _ = _km(spark, sf)
    return rounded(curves.filter(F.col("grp") == S.POPULATION).select("t", "d", "n_at_risk", "survival"))


@register("km_fit_by_type", _sql("""
SELECT grp AS incident_type, t, d, n_at_risk, round(survival, 6) AS survival FROM curves WHERE grp <> '__population__'"""))
def q_km_fit_by_type(spark, sf):
    _, curves, _ = _km(spark, sf)
    return rounded(curves.filter(F.col("grp") != S.POPULATION).select(
        F.col("grp").alias("incident_type"), "t", "d", "n_at_risk", "survival"))


@register("km_median", _sql("SELECT grp, round(median_duration, 6) AS median_duration, n_samples FROM km_summary"))
def q_km_median(spark, sf):
    _, _, summ = _km(spark, sf)
    return rounded(summ.select("grp", "median_duration", "n_samples"))


@register("km_surv_at", _sql("SELECT grp, point, round(s_at, 6) AS survival_probability FROM km_steps"))
def q_km_surv_at(spark, sf):
    _, _, summ = _km(spark, sf)
    return rounded(summ.select("grp", F.explode("survival_at").alias("p")).select(
        "grp", F.col("p.point").alias("point"), F.col("p.s_at").alias("survival_probability")))


@register("km_interval", _sql("""
SELECT grp, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper, n_observed FROM km_summary"""))
def q_km_interval(spark, sf):
    _, _, summ = _km(spark, sf)
    return rounded(summ.select("grp", "ci_lower", "ci_upper", "n_observed"))


@register("model_fit_summary", _sql("""
SELECT (SELECT count(*) FROM km_base) AS num_samples,
  (SELECT count(*) FROM km_sizes WHERE grp <> '__population__') AS km_types_fitted,
  (SELECT count(*) FROM km_sizes WHERE grp = '__population__') = 1 AS population_fitted,
  (SELECT string_agg(grp || ':' || CAST(n_total AS VARCHAR), '|' ORDER BY grp) FROM km_sizes WHERE grp <> '__population__') AS samples_per_type"""))
def q_model_fit_summary(spark, sf):
    inc, curves, _ = _km(spark, sf)
    base = S.km_input(inc, "incident_type", "duration_min", "event_observed")
    sizes = curves.select("grp", "n_total").distinct()
    typed = sizes.filter(F.col("grp") != S.POPULATION)
    per = typed.agg(F.count("*").alias("km_types_fitted"),
                    F.concat_ws("|", F.array_sort(F.collect_list(
                        F.concat(F.col("grp"), F.lit(":"), F.col("n_total").cast("string"))))).alias("samples_per_type"))
    popf = sizes.agg(F.count_if(F.col("grp") == S.POPULATION).alias("_p")).select((F.col("_p") == 1).alias("population_fitted"))
    n = base.agg(F.count("*").alias("num_samples"))
    one = F.lit(1).alias("_k")
    return (n.select("*", one).join(per.select("*", one), "_k").join(popf.select("*", one), "_k").drop("_k"))


IMPUTE_SQL = """
SELECT i.incident_id,
  CASE WHEN i.end_datetime IS NOT NULL THEN 'known_value' WHEN f.grp IS NOT NULL THEN 'KM_' || i.incident_type ELSE 'KM_population' END AS imputation_method,
  CASE WHEN i.end_datetime IS NOT NULL THEN NULL ELSE round(coalesce(f.median_duration, p.median_duration), 6) END AS duration_estimate_min,
  CASE WHEN i.end_datetime IS NOT NULL THEN NULL ELSE round(coalesce(f.ci_lower, p.ci_lower), 6) END AS ci_lower,
  CASE WHEN i.end_datetime IS NOT NULL THEN NULL ELSE round(coalesce(f.ci_upper, p.ci_upper), 6) END AS ci_upper,
  CASE WHEN i.end_datetime IS NOT NULL THEN i.end_datetime
       ELSE i.start_datetime + to_microseconds(CAST(round(coalesce(f.median_duration, p.median_duration) * 60000000) AS BIGINT)) END AS imputed_end_datetime
FROM imp_in i LEFT JOIN (SELECT * FROM km_summary WHERE grp <> '__population__') f ON f.grp = i.incident_type
  CROSS JOIN (SELECT * FROM km_summary WHERE grp = '__population__') p"""
IMP_IN = ("imp_in", """SELECT incident_id, CASE WHEN k % 13 = 0 THEN 'novel_type' ELSE incident_type END AS incident_type,
  start_datetime, CASE WHEN event_observed THEN start_datetime + to_microseconds(CAST(round(duration_min * 60000000) AS BIGINT)) END AS end_datetime
  FROM incidents""")


@register("impute_end_datetime", A.with_views(IMPUTE_SQL, *KM_CTES, IMP_IN))
def q_impute_end_datetime(spark, sf):
    inc, _, summ = _km(spark, sf)
    end = F.timestamp_add("MICROSECOND", F.round(F.col("duration_min") * 60000000).cast("long"), F.col("start_datetime"))
    src = inc.select("incident_id", F.when(F.col("k") % 13 == 0, F.lit("novel_type")).otherwise(F.col("incident_type"))
                     .alias("incident_type"), "start_datetime", F.when(F.col("event_observed"), end).alias("end_datetime"))
    out = S.impute_end_datetime(src, summ)
    return rounded(out.select("incident_id", "imputation_method", "duration_estimate_min", "ci_lower", "ci_upper",
                              "imputed_end_datetime"))


@register("km_curve_lookup", A.with_views("""
SELECT t.event_cause, coalesce(f.grp, '__population__') AS curve, count(*) AS n_points, round(min(c.survival), 6) AS final_survival
FROM (SELECT DISTINCT event_cause FROM incidents) t
  LEFT JOIN (SELECT DISTINCT grp FROM curves) f ON f.grp = t.event_cause
  JOIN curves c ON c.grp = coalesce(f.grp, '__population__')
GROUP BY t.event_cause, coalesce(f.grp, '__population__')""", *KM_CTES))
def q_km_curve_lookup(spark, sf):
    inc, curves, _ = _km(spark, sf)
    types = inc.select("event_cause").distinct()
    j = S.curve_for(types, curves, "event_cause")
    return rounded(j.groupBy("event_cause", "curve").agg(F.count("*").alias("n_points"),
                                                          F.min("survival").alias("final_survival")))


@register("historical_median", A.with_views("""
SELECT incident_id, coalesce(CASE lower(event_cause) WHEN 'accident' THEN 45.0 WHEN 'congestion' THEN 70.0
  WHEN 'road_closure' THEN 120.0 WHEN 'hazard' THEN 60.0 WHEN 'event' THEN 90.0 END, 70.0) AS historical_median FROM incidents"""))
def q_historical_median(spark, sf):
    inc = A.table(spark, sf, "incidents")
    return inc.select("incident_id", S.historical_median(F.col("event_cause")).alias("historical_median"))
