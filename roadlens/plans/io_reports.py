"""Source and sink keys: round trips through files in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens.operators import sets as SE
from roadlens.plans.registry import AS_OF, register, rounded
from roadlens.plans.set_reports import STRATIFIED_SQL
from roadlens.session import scratch_path
from roadlens.sources import readers as R
from roadlens.sources import sinks as K
from roadlens.sources import tables as TB


def _path(spark, name):
    return scratch_path(spark, f"io/{name}-{uuid.uuid4().hex[:8]}")


def _csv_source(spark, sf):
    inc = A.table(spark, sf, "incidents_text")
    return inc.select(
        F.when(F.col("k") % 17 == 0, F.lit("n/a")).otherwise(F.col("latitude").cast("string")).alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"),
        F.date_format("start_datetime", "yyyy-MM-dd HH:mm:ss").alias("start_datetime"),
        F.when(F.col("event_observed"), F.lit("not a date")).alias("end_datetime"),
        F.lit(None).cast("string").alias("resolved_datetime"), F.lit(None).cast("string").alias("closed_datetime"),
        "event_cause", "priority", (F.col("event_cause") == "road_closure").cast("string").alias("requires_road_closure"),
        "veh_type", "corridor", "description",
        F.col("corridor").alias("address"))


#: Records of a landed CSV file: one file is read by one task, as texts hold line breaks, and small files share a task.
CSV_FILE_RECORDS = 5000
#: Landings of more records than this are compressed, as every record holds a whole text.
CSV_PLAIN_RECORDS = 50_000


@register("src_csv_incidents", A.with_views("""
SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, strftime(start_datetime, '%Y-%m-%d %H:%M:%S') AS start_text,
  CAST(NULL AS VARCHAR) AS end_text, CAST(NULL AS VARCHAR) AS resolved_text, CAST(NULL AS VARCHAR) AS closed_text, event_cause,
  priority, event_cause = 'road_closure' AS requires_road_closure, veh_type, corridor, description, corridor AS address
FROM incidents_text WHERE k % 17 <> 0"""))
def q_src_csv_incidents(spark, sf):
    p = _path(spark, "csv")
    packed = "gzip" if A.table(spark, sf, "incidents").count() > CSV_PLAIN_RECORDS else "none"
    _csv_source(spark, sf).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                                         maxRecordsPerFile=CSV_FILE_RECORDS, compression=packed).csv(p)
    d = R.read_incident_csv(spark, p)
    text = {f"{c}_text": F.date_format(f"{c}_datetime", "yyyy-MM-dd HH:mm:ss") for c in ("start", "end", "resolved", "closed")}
    return rounded(d.withColumns(text).drop("start_datetime", "end_datetime", "resolved_datetime", "closed_datetime"))


@register("src_json_incidents", A.with_views("""
SELECT CASE WHEN k % 19 > 2 THEN incident_id END AS incident_id, round(CASE WHEN k % 19 > 2 THEN latitude END, 6) AS lat,
  round(CASE WHEN k % 19 > 2 THEN longitude END, 6) AS lon, CASE WHEN k % 19 > 2 THEN description END AS description,
  CASE WHEN k % 19 > 2 THEN incident_type END AS incident_type, round(CASE WHEN k % 19 > 2 THEN severity_raw END, 6) AS severity,
  CASE WHEN k % 19 = 0 THEN '{broken ' || incident_id END AS broken_text, k % 19 <= 2 AS corrupt
FROM incidents_text"""))
def q_src_json_incidents(spark, sf):
    inc = A.table(spark, sf, "incidents_text")

    def payload(lat):
        return F.to_json(F.struct("incident_id", F.struct(lat.alias("latitude"), "longitude").alias("location"),
                                  F.col("start_datetime").cast("string").alias("timestamp"), "description", "incident_type",
                                  F.col("severity_raw").alias("severity_initial")))

    good = payload(F.col("latitude"))
    text = (F.when(F.col("k") % 19 == 0, F.concat(F.lit("{broken "), F.col("incident_id")))
            .when(F.col("k") % 19 == 1, payload(F.lit("abc"))).when(F.col("k") % 19 == 2, F.concat(good, F.lit(" and more")))
            .otherwise(good))
    out = R.parse_incident_json(inc.select(text.alias("payload")))
    i = "incident."
    broken = F.when(F.col("_corrupt").startswith("{broken"), F.col("_corrupt"))
    return rounded(out.select(
        F.col(i + "incident_id").alias("incident_id"), F.col(i + "location.latitude").alias("lat"),
        F.col(i + "location.longitude").alias("lon"), F.col(i + "description").alias("description"),
        F.col(i + "incident_type").alias("incident_type"), F.col(i + "severity_initial").alias("severity"),
        broken.alias("broken_text"), F.col("_corrupt").isNotNull().alias("corrupt")))


_SRC_TABLES = """
SELECT 'incidents' AS tbl, count(*) FILTER (WHERE {ok}) AS n_rows, count(*) FILTER (WHERE NOT ({ok})) AS n_rejected,
  CAST(round(sum(CASE WHEN {ok} THEN CAST(latitude AS DECIMAL(10,8)) END), 6) AS DOUBLE) AS total, 12 AS n_columns, 'decimal(10,8)' AS kind FROM incidents
UNION ALL SELECT 'predictions', count(*) FILTER (WHERE seq % 31 <> 0), count(*) FILTER (WHERE seq % 31 = 0),
  CAST(round(sum(CASE WHEN seq % 31 <> 0 THEN CAST(predicted AS DECIMAL(5,2)) END), 2) AS DOUBLE), 11, 'decimal(5,2)' FROM predictions
UNION ALL SELECT 'playbook_recommendations', count(*), 0, CAST(sum(length(event_cause)) AS DOUBLE), 6, 'string' FROM incidents
UNION ALL SELECT 'models', count(*), 0, CAST(sum(n) AS DOUBLE), 7, 'int' FROM (SELECT model, count(*) AS n FROM predictions GROUP BY model) m
UNION ALL SELECT 'audit_log', count(*), 0, CAST(sum(seq) AS DOUBLE), 5, 'bigint' FROM audit_entries""".format(
    ok="k % 23 <> 0 AND k % 29 <> 0 AND severity_raw < 999.995")


@register("src_incident_tables", A.with_views(_SRC_TABLES))
def q_src_incident_tables(spark, sf):
    """The typed tables written from the views with some rows that break a rule, and what they hold when read back."""
    p = _path(spark, "typed")
    inc, pred = A.table(spark, sf, "incidents"), A.table(spark, sf, "predictions")
    k = F.col("k")
    rows = {"incidents": inc.select(
        "incident_id", F.when(k % 23 == 0, F.lit("north")).otherwise(F.col("latitude").cast("decimal(10,8)").cast("string")).alias("location_latitude"),
        F.when(k % 29 == 0, F.lit(200.0)).otherwise(F.col("longitude")).cast("decimal(11,8)").alias("location_longitude"),
        F.col("start_datetime").alias("timestamp"), "start_datetime", F.col("event_cause").alias("description"), "incident_type",
        F.col("severity_raw").alias("severity_initial"), F.lit("pending").alias("status"), (~F.col("event_observed")).alias("is_ongoing"))}
    rows["predictions"] = pred.select(F.col("seq").cast("string").alias("prediction_id"), F.when(F.col("seq") % 31 != 0, F.col("incident_id")).alias("incident_id"),
                                      F.col("predicted").cast("decimal(5,2)").alias("severity_score"), F.lit("completed").alias("status"),
                                      F.col("ts").alias("created_at"), F.col("model").alias("module_a_model_version"))
    rows["playbook_recommendations"] = inc.select(*[F.col("incident_id").alias(c) for c in ("playbook_id", "prediction_id", "incident_id")],
                                                  F.col("event_cause").alias("driver_alert"), F.col("start_datetime").alias("created_at"))
    rows["models"] = pred.groupBy(F.col("model").alias("model_name")).agg(F.count("*").cast("int").alias("training_samples")).withColumns(
        {"version": F.lit("v1"), "status": F.lit("testing")})
    rows["audit_log"] = A.table(spark, sf, "audit_entries").select(F.col("seq").alias("entry_id"), "incident_id", "operation", "status", F.col("ts").alias("created_at"))
    shown = {"incidents": "location_latitude", "predictions": "severity_score", "playbook_recommendations": "driver_alert",
             "models": "training_samples", "audit_log": "entry_id"}
    out = None
    for name, table in TB.TABLES.items():
        TB.write_table(rows[name], table, p)
        d, c = TB.read_table(spark, name, p), shown[name]
        kind = d.schema[c].dataType.simpleString()
        value = F.length(c) if kind == "string" else F.col(c)
        bad = TB.read_rejected(spark, name, p).agg(F.count("*").alias("n_rejected"))
        row = d.agg(F.count("*").alias("n_rows"), F.sum(value).cast("double").alias("total")).join(F.broadcast(bad), F.lit(True)).select(
            F.lit(name).alias("tbl"), "n_rows", "n_rejected", F.round("total", 2 if name == "predictions" else 6).alias("total"),
            F.lit(len(table.fields())).alias("n_columns"), F.lit(kind).alias("kind"))
        out = row if out is None else out.unionByName(row)
    return out


@register("src_news_xml", A.with_views(f"""
SELECT trim(title, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS title, source, age_days,
  strftime(TIMESTAMP '{AS_OF}' - to_days(CAST(age_days AS INT)), '%a, %d %b %Y %H:%M:%S GMT') AS pub_date FROM news"""))
def q_src_news_xml(spark, sf):
    p = _path(spark, "rss")
    news = A.table(spark, sf, "news")
    item = F.concat(F.lit("<item><title>"), F.regexp_replace(F.regexp_replace("title", "&", "&amp;"), "<", "&lt;"),
                    F.lit("</title><pubDate>"),
                    F.date_format(F.timestamp_add("DAY", -F.col("age_days"), F.lit(AS_OF).cast("timestamp")),
                                  "EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
                    F.lit("</pubDate><source url=\"https://news.example\">"), F.col("source"), F.lit("</source></item>"))
    # feeds of at most 1000 items each (a bounded group), one RSS document per feed folder
    feeds = (news.select(F.floor(F.col("news_id") / 1000).alias("feed"), "news_id", item.alias("value"))
             .groupBy("feed").agg(F.concat(F.lit("<rss><channel>"),
                                           F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("news_id", "value"))),
                                                                       lambda x: x["value"])),
                                           F.lit("</channel></rss>")).alias("value")))
    feeds.repartition("feed").write.partitionBy("feed").text(p)
    x = R.read_news_xml(spark, p)
    return x.withColumn("age_days", R.rfc822_age_days(F.col("pub_date"), AS_OF))


@register("snk_audit_jsonl", A.with_views("SELECT seq, operation, 'REDACTED_GRID_CELL' AS location, status FROM audit_entries"))
def q_snk_audit_jsonl(spark, sf):
    p = _path(spark, "audit")
    a = A.table(spark, sf, "audit_entries")
    det = F.create_map(F.lit("location"), F.concat(F.lit("cell_"), F.col("seq").cast("string")),
                       F.lit("user_ip"), F.lit("10.0.0.1"), F.lit("status"), F.col("status"))
    K.write_audit_jsonl(a.select("seq", "ts", "operation", det.alias("details")), p)
    return spark.read.json(p).select("seq", "operation", F.col("details.location").alias("location"),
                                    F.col("details.status").alias("status"))


@register("snk_feedback", A.with_views("""
SELECT strftime(start_datetime, '%Y-%m-%d %H:%M:%S') AS start_text, incident_id, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS approval,
  '2 Traffic Constables' AS manpower, '4 Standard Barricades' AS barricading FROM incidents"""))
def q_snk_feedback(spark, sf):
    p = _path(spark, "feedback")
    inc = A.table(spark, sf, "incidents")
    fb = inc.select(F.date_format("start_datetime", "yyyy-MM-dd HH:mm:ss").alias("ts"), "incident_id",
                    (F.col("k") % 2 == 0).alias("approval"), F.lit("2 Traffic Constables").alias("manpower"),
                    F.lit("4 Standard Barricades").alias("barricading"))
    K.write_feedback(fb, p)
    return spark.read.option("header", True).csv(p).withColumnRenamed("ts", "start_text")


@register("snk_audit_export", A.with_views("""
SELECT 'csv' AS fmt, seq, incident_id, '{"operation":"' || operation || '";"status":"' || status || '"}' AS details
FROM (SELECT seq, CASE WHEN seq % 7 <> 0 THEN incident_id END AS incident_id, operation, status FROM audit_entries) a
UNION ALL SELECT 'json', seq, incident_id, '{"operation":"' || operation || '","status":"' || status || '"}'
FROM (SELECT seq, CASE WHEN seq % 7 <> 0 THEN incident_id END AS incident_id, operation, status FROM audit_entries) b"""))
def q_snk_audit_export(spark, sf):
    a = A.table(spark, sf, "audit_entries")
    src = a.select("seq", F.when(F.col("seq") % 7 != 0, F.col("incident_id")).alias("incident_id"),
                   F.struct("operation", "status").alias("details"))
    csv, js = _path(spark, "export-csv"), _path(spark, "export-json")
    K.export_audit(src, "csv", csv)
    K.export_audit(src, "json", js)
    back = spark.read.schema("seq long, incident_id string, details string").options(header=True, quote="").csv(csv)
    lines = spark.read.schema("seq long, incident_id string, details struct<operation:string,status:string>").json(js)
    return back.select(F.lit("csv").alias("fmt"), "*").unionByName(
        lines.select(F.lit("json").alias("fmt"), "seq", "incident_id", F.to_json("details").alias("details")))


FORECAST_SQL = ("shown", """SELECT n.day, r.node_id, r.lon, r.lat, n.value / 100.0 AS weight
  FROM (SELECT step // 24 AS day, node_id + 1 AS node_id, occupancy * 100 AS value FROM node_series) n
  JOIN road_nodes r ON r.node_id = n.node_id WHERE n.value >= 5""")


def _shown(spark, sf):
    ns = A.table(spark, sf, "node_series")
    pts = ns.select((F.floor(F.col("step") / 24)).alias("day"), (F.col("node_id") + 1).alias("node_id"),
                    (F.col("occupancy") * 100).alias("value")).join(A.table(spark, sf, "road_nodes"), "node_id")
    return K.forecast_features(pts, "day")


@register("snk_geojson", A.with_views("""
SELECT day, count(*) AS n_features, round(sum(weight), 6) AS total_weight, round(sum(lon), 6) AS total_lon, round(sum(lat), 6) AS total_lat
FROM shown GROUP BY day""", FORECAST_SQL))
def q_snk_geojson(spark, sf):
    p = _path(spark, "geojson")
    K.write_geojson(_shown(spark, sf), "day", p)
    schema = ("type string, geometry struct<type:string,coordinates:array<double>>, "
              "properties struct<weight:double,node_id:long>, day long")
    d = spark.read.schema(schema).json(p).filter("type = 'Feature' and geometry.type = 'Point'")
    at = F.col("geometry.coordinates")
    return rounded(d.groupBy("day").agg(F.count("*").alias("n_features"), F.sum("properties.weight").alias("total_weight"),
                                        F.sum(at[0]).alias("total_lon"), F.sum(at[1]).alias("total_lat")))


@register("heatmap_weights", A.with_views("""
SELECT day, node_id, round(lon, 8) AS lon, round(lat, 8) AS lat, round(w, 8) AS weight FROM (
  SELECT s.*, s.weight * CASE WHEN m.node_id IS NOT NULL THEN 0.35 ELSE 1 END AS w FROM shown s LEFT JOIN
    (SELECT DISTINCT user_id % 8 + 1 AS node_id, day(start_datetime) - 1 AS day FROM incidents WHERE incident_type = 'roadwork') m
    ON m.node_id = s.node_id AND m.day = s.day WHERE s.weight >= 0.15) x WHERE w > 0.05""", FORECAST_SQL))
def q_heatmap_weights(spark, sf):
    """Weights of shown nodes; nodes with roadwork dispatched on the day count as mitigated (35 %)."""
    inc = A.table(spark, sf, "incidents").filter("incident_type = 'roadwork'")
    done = inc.select((F.col("user_id") % 8 + 1).alias("node_id"), (F.dayofmonth("start_datetime") - 1).cast("long").alias("day")) \
        .distinct().withColumn("_m", F.lit(True))
    shown = _shown(spark, sf).filter(F.col("weight") >= 0.15).join(done, ["node_id", "day"], "left")
    w = F.when(F.col("_m"), F.col("weight") * 0.35).otherwise(F.col("weight"))
    # eight digits: a product of two short numbers has halves at the sixth, which engines round differently
    return rounded(shown.withColumn("weight", w).filter(F.col("weight") > 0.05).select("day", "node_id", "lon", "lat", "weight"), 8)


@register("snk_splits", A.with_views(f"SELECT split, count(*) AS samples FROM ({STRATIFIED_SQL}) s GROUP BY split"))
def q_snk_splits(spark, sf):
    p = _path(spark, "splits")
    inc = SE.split_stratified(A.table(spark, sf, "incidents"), "incident_id", "event_cause")
    K.write_splits(inc.select("incident_id", "event_cause", "split"), p)
    return spark.read.json(f"{p}/metadata")


@register("snk_feature_store", A.with_views("SELECT incident_id, 'v1' AS dataset_version, round(severity_raw + 1, 6) AS severity_raw FROM incidents"))
def q_snk_feature_store(spark, sf):
    p = _path(spark, "features")
    inc = A.table(spark, sf, "incidents").select("incident_id", "severity_raw", "arrival_seq")
    base = F.lit(AS_OF).cast("timestamp")
    K.append_features(inc, p, "v1", base)
    K.append_features(inc.withColumn("severity_raw", F.col("severity_raw") + 1), p, "v1",
                      F.timestamp_add("MINUTE", F.lit(1), base))
    return rounded(K.read_features(spark, p).select("incident_id", "dataset_version", "severity_raw"))
