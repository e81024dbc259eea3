"""Aggregation keys and the feature encoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens.operators import encoder as E
from roadlens.operators import features as FE
from roadlens.plans.registry import joined, register, rounded

ENC_IN_SQL = ("enc_in", """SELECT incident_id, temperature, CASE WHEN k % 3 = 0 THEN NULL ELSE severity_raw END AS severity_initial,
  incident_type, ['monday','tuesday','wednesday','thursday','friday','saturday','sunday'][isodow(start_datetime)] AS day_of_week,
  CASE WHEN temperature IS NULL THEN 'unknown' WHEN temperature < 0 THEN 'cold' WHEN temperature < 15 THEN 'cool'
       WHEN temperature < 25 THEN 'mild' ELSE 'warm' END AS weather_category FROM incidents""")


def enc_input(spark, sf):
    inc = A.table(spark, sf, "incidents")
    df = FE.derive_weather_category(FE.derive_time(inc))
    return df.select("incident_id", "temperature",
                     F.when(F.col("k") % 3 != 0, F.col("severity_raw")).alias("severity_initial"),
                     "incident_type", "day_of_week", "weather_category")


NUM = ["temperature", "severity_initial"]
CAT = ["incident_type", "day_of_week", "weather_category"]


def _mode_sql(c):
    return f"(SELECT {c} FROM enc_in WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@register("enc_fit_stats", A.with_views(" UNION ALL ".join(
    [f"""SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, NULL AS mode, round(100.0 * count_if({c} IS NULL) / count(*), 6) AS missing_pct,
  100.0 * count_if({c} IS NULL) / count(*) > 40 AS warning FROM enc_in""" for c in NUM]
    + [f"""SELECT '{c}', NULL, coalesce({_mode_sql(c)}, 'unknown'), round(100.0 * count_if({c} IS NULL) / count(*), 6),
  100.0 * count_if({c} IS NULL) / count(*) > 40 FROM enc_in""" for c in CAT]), ENC_IN_SQL))
def q_enc_fit_stats(spark, sf):
    return rounded(E.fit_stats_long(E.fit(enc_input(spark, sf), NUM, CAT), NUM, CAT))


@register("enc_scaler_fit", A.with_views(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg(coalesce({c}, 0)), 6) AS scale_mean,
  round(CASE WHEN stddev_pop(coalesce({c}, 0)) = 0 THEN 1.0 ELSE stddev_pop(coalesce({c}, 0)) END, 6) AS scale_std FROM enc_in""" for c in NUM),
    ENC_IN_SQL))
def q_enc_scaler_fit(spark, sf):
    fit = E.fit(enc_input(spark, sf), NUM, CAT)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}__scale_mean").alias("scale_mean"),
                     F.col(f"{c}__scale_std").alias("scale_std")) for c in NUM]
    return rounded(fit.stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))


@register("enc_onehot_fit", A.with_views(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, coalesce({c}, 'unknown') AS category, count(*) AS n FROM enc_in GROUP BY 2"""
    for c in CAT), ENC_IN_SQL))
def q_enc_onehot_fit(spark, sf):
    """A row per column of the one-hot encoding, with the reports that have it."""
    return E.fit(enc_input(spark, sf), NUM, CAT).categories


@register("encode_features", A.with_views("""
SELECT e.incident_id, round((coalesce(e.temperature, st.m_t) - st.sm_t) / st.sd_t, 6) AS temperature_standardized,
  round((coalesce(e.severity_initial, st.m_s) - st.sm_s) / st.sd_s, 6) AS severity_initial_standardized,
  concat_ws('|', CASE WHEN e.temperature IS NULL THEN 'temperature' END, CASE WHEN e.severity_initial IS NULL THEN 'severity_initial' END) AS imputed_features,
  'incident_type_' || e.incident_type || '|day_of_week_' || e.day_of_week || '|weather_category_' || e.weather_category AS hot_columns
FROM enc_in e, st""", ENC_IN_SQL, ("st", """SELECT avg(temperature) AS m_t, avg(severity_initial) AS m_s,
  avg(coalesce(temperature, 0)) AS sm_t, CASE WHEN stddev_pop(coalesce(temperature, 0)) = 0 THEN 1.0 ELSE stddev_pop(coalesce(temperature, 0)) END AS sd_t,
  avg(coalesce(severity_initial, 0)) AS sm_s, CASE WHEN stddev_pop(coalesce(severity_initial, 0)) = 0 THEN 1.0 ELSE stddev_pop(coalesce(severity_initial, 0)) END AS sd_s
  FROM enc_in""")))
def q_encode_features(spark, sf):
    src = enc_input(spark, sf)
    enc = E.encode(src, E.fit(src, NUM, CAT), NUM, CAT)
    hot = F.concat_ws("|", F.filter(F.col("onehot_names"), lambda x: x.isNotNull()))
    return rounded(enc.select("incident_id", "temperature_standardized", "severity_initial_standardized",
                              F.concat_ws("|", "imputed_features").alias("imputed_features"), hot.alias("hot_columns")))


@register("audit_op_stats", A.with_views("""
SELECT operation, count_if(status = 'success') AS success, count_if(status = 'failure') AS failure,
  count_if(status = 'partial') AS partial FROM audit_entries GROUP BY operation"""))
def q_audit_op_stats(spark, sf):
    a = A.table(spark, sf, "audit_entries")
    return a.groupBy("operation").pivot("status", ["success", "failure", "partial"]).count().fillna(0)


@register("audit_summary", A.with_views("""
SELECT coalesce(op, 'all') AS operation, count(*) AS total, count_if(status = 'success') AS successes,
  count_if(status = 'failure') AS failures, round(count_if(status = 'success') / count(*), 6) AS success_rate
FROM (SELECT operation AS op, status FROM audit_entries UNION ALL SELECT NULL, status FROM audit_entries) x GROUP BY op"""))
def q_audit_summary(spark, sf):
    a = A.table(spark, sf, "audit_entries")

    def summ(df, label):
        return df.agg(F.lit(label).alias("operation"), F.count("*").alias("total"),
                      F.count_if(F.col("status") == "success").alias("successes"),
                      F.count_if(F.col("status") == "failure").alias("failures"),
                      (F.count_if(F.col("status") == "success") / F.count("*")).alias("success_rate"))
    per_op = a.groupBy("operation").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("successes"),
        F.count_if(F.col("status") == "failure").alias("failures"),
        (F.count_if(F.col("status") == "success") / F.count("*")).alias("success_rate"))
    return rounded(per_op.unionByName(summ(a, "all")))


@register("audit_op_details", A.with_views("""
SELECT operation, count(*) AS entries, count(DISTINCT incident_id) AS incidents,
  round(count_if(status <> 'success') / count(*), 6) AS non_success_rate, min(ts) AS first_ts, max(ts) AS last_ts,
  round(CASE WHEN operation = 'embedding_generation' THEN count_if(seq % 3 = 0) / count(*) END, 6) AS cached_rate,
  round(CASE WHEN operation = 'embedding_generation' THEN avg(seq % 97 + 0.5) END, 6) AS average_latency_ms,
  CAST(sum(CASE WHEN operation = 'missing_value_imputation' THEN seq % 4 END) AS BIGINT) AS fields_imputed,
  CAST(sum(CASE WHEN operation = 'duplicate_detection' THEN seq % 5 END) AS BIGINT) AS duplicates_found,
  CAST(sum(CASE WHEN operation = 'validation_batch' THEN seq % 50 + 1 END) AS BIGINT) AS reports_validated
FROM audit_entries GROUP BY operation"""))
def q_audit_op_details(spark, sf):
    """Per operation the metrics that its details carry: a JSON text per entry, read by schema."""
    a = A.table(spark, sf, "audit_entries")
    op, seq = F.col("operation"), F.col("seq")
    fields = F.transform(F.sequence(F.lit(0), (seq % 4 - 1).cast("int")), lambda i: F.concat(F.lit("field_"), i.cast("string")))
    details = (F.when(op == "embedding_generation", F.to_json(F.struct((seq % 3 == 0).alias("cached"), (seq % 97 + 0.5).alias("latency_ms"))))
               .when(op == "missing_value_imputation", F.to_json(F.struct(
                   F.when(seq % 4 > 0, fields).otherwise(F.array().cast("array<string>")).alias("fields_imputed"), (seq % 4).alias("field_count"))))
               .when(op == "duplicate_detection", F.to_json(F.struct((seq % 5).alias("duplicate_count"))))
               .otherwise(F.to_json(F.struct((seq % 50 + 1).alias("total_reports")))))
    d = F.from_json("details", "cached boolean, latency_ms double, field_count long, duplicate_count long, total_reports long")
    x = a.withColumn("details", details).withColumn("d", d)
    return rounded(x.groupBy("operation").agg(
        F.count("*").alias("entries"), F.count_distinct("incident_id").alias("incidents"),
        (F.count_if(F.col("status") != "success") / F.count("*")).alias("non_success_rate"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.avg(F.col("d.cached").cast("int")).alias("cached_rate"), F.avg("d.latency_ms").alias("average_latency_ms"),
        F.sum("d.field_count").alias("fields_imputed"), F.sum("d.duplicate_count").alias("duplicates_found"),
        F.sum("d.total_reports").alias("reports_validated")))


@register("class_distribution", A.with_views("""
SELECT event_cause, count(*) AS n FROM incidents GROUP BY event_cause HAVING count(*) > 5"""))
def q_class_distribution(spark, sf):
    inc = A.table(spark, sf, "incidents")
    return inc.groupBy("event_cause").agg(F.count("*").alias("n")).filter(F.col("n") > 5)


@register("feature_store_stats", A.with_views("""
SELECT dataset_version, count(*) AS vectors, CAST(max(width) AS BIGINT) AS features, round(sum(width) * 8 / 1048576.0, 6) AS size_mb
FROM (SELECT CASE WHEN event_observed THEN 'v1' ELSE 'v0' END AS dataset_version, 8 AS width FROM incidents) x GROUP BY 1"""))
def q_feature_store_stats(spark, sf):
    """Stored vectors per version with their width and size, from the vectors themselves."""
    inc = FE.structured_features(A.table(spark, sf, "incidents"))
    store = inc.select(F.when(F.col("event_observed"), "v1").otherwise("v0").alias("dataset_version"),
                       F.array(*FE.STRUCTURED_COLUMNS).alias("vector"))
    return rounded(store.groupBy("dataset_version").agg(
        F.count("*").alias("vectors"), F.max(F.size("vector")).cast("long").alias("features"),
        (F.sum(F.size("vector")) * 8 / 1048576.0).alias("size_mb")))


@register("model_usage_stats", A.with_views("""
SELECT model, count(*) AS predictions, round(avg(abs(predicted - actual)), 6) AS mae,
  round(count_if(abs(predicted - actual) > 5) / count(*), 6) AS error_rate,
  round((avg(abs(predicted - actual)) - 3.5) / 3.5 * 100, 6) AS degradation_pct, round(avg(latency_ms), 6) AS average_latency_ms
FROM predictions p JOIN service_calls c ON c.seq = p.seq GROUP BY model"""))
def q_model_usage_stats(spark, sf):
    p = A.table(spark, sf, "predictions").withColumn("_e", F.abs(F.col("predicted") - F.col("actual")))
    p = p.join(A.table(spark, sf, "service_calls").select("seq", "latency_ms"), "seq")
    return rounded(p.groupBy("model").agg(
        F.avg("latency_ms").alias("average_latency_ms"), F.count("*").alias("predictions"), F.avg("_e").alias("mae"),
        (F.count_if(F.col("_e") > 5) / F.count("*")).alias("error_rate"),
        ((F.avg("_e") - 3.5) / 3.5 * 100).alias("degradation_pct")))


@register("reg_metrics", A.with_views("""
SELECT model, round(sqrt(avg(pow(predicted - actual, 2))), 6) AS rmse, round(avg(abs(predicted - actual)), 6) AS mae,
  round(1 - sum(pow(actual - predicted, 2)) / sum(pow(actual - ma, 2)), 6) AS r2
FROM (SELECT *, avg(actual) OVER (PARTITION BY model) AS ma FROM predictions) p GROUP BY model"""))
def q_reg_metrics(spark, sf):
    from roadlens.operators.models import reg_metrics
    return rounded(reg_metrics(A.table(spark, sf, "predictions"), "predicted", "actual", ["model"]))


@register("mean_pool", A.with_views("""
SELECT label, count(*) AS dims, round(sum(v), 6) AS sum_components, round(max(v), 6) AS max_component FROM (
  SELECT label, pos, sum(CASE WHEN vec_id % 4 <> 0 THEN x ELSE 0 END) / greatest(count_if(vec_id % 4 <> 0), 1e-9) AS v FROM (
    SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) e GROUP BY label, pos) g
GROUP BY label"""))
def q_mean_pool(spark, sf):
    """Masked mean of the vectors of a group; a fourth of them stands for padding."""
    from roadlens.operators.lookups import masked_mean
    emb = A.table(spark, sf, "embeddings").withColumn("mask", (F.col("vec_id") % 4 != 0).cast("int"))
    c = masked_mean(emb, "embedding", "mask", "label")
    return rounded(c.select("label", F.size("c").alias("dims"),
                            F.aggregate("c", F.lit(0.0), lambda a, x: a + x).alias("sum_components"),
                            F.array_max("c").alias("max_component")))
