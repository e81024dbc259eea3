"""Scalar-function keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens.functions import scalars as SC
from roadlens.operators import features as FE
from roadlens.operators.playbook import playbook_lookup, playbook_rules
from roadlens.plans.feature_reports import PLAYBOOK_CTE, RULES_CTE
from roadlens.plans.registry import joined, register, rounded

FMT_DUR_SQL = """CASE WHEN m IS NULL OR m = 0 THEN '0 min' ELSE concat_ws(' ',
  CASE WHEN m // 1440 > 0 THEN CAST(m // 1440 AS VARCHAR) || ' day' || CASE WHEN m // 1440 > 1 THEN 's' ELSE '' END END,
  CASE WHEN (m % 1440) // 60 > 0 THEN CAST((m % 1440) // 60 AS VARCHAR) || ' hr' END,
  CASE WHEN m % 60 > 0 OR (m // 1440 <= 0 AND (m % 1440) // 60 <= 0) THEN CAST(m % 60 AS VARCHAR) || ' min' END) END"""


@register("format_duration", A.with_views(f"""
SELECT incident_id, {FMT_DUR_SQL} AS duration_text FROM (SELECT incident_id, CAST(floor(duration_min * 10) AS BIGINT) AS m FROM incidents) x"""))
def q_format_duration(spark, sf):
    inc = A.table(spark, sf, "incidents")
    return inc.select("incident_id", SC.format_duration(F.col("duration_min") * 10).alias("duration_text"))


@register("translate_terms", A.with_views(f"""
SELECT term, coalesce(CASE term {' '.join("WHEN '" + k.replace("'", "''") + "' THEN '" + v + "'" for k, v in SC.TRANSLATIONS.items())} END, term) AS display,
  count(*) AS incidents
FROM (SELECT unnest([manpower, barricading, diversion]) AS term FROM pb) x GROUP BY term""", RULES_CTE, PLAYBOOK_CTE))
def q_translate_terms(spark, sf):
    """The display text of every resource that the incidents' playbooks name."""
    df = A.table(spark, sf, "incidents").select("incident_id", "event_cause", F.col("severity_raw").alias("severity_score"))
    pb = playbook_lookup(df, playbook_rules(spark), type_col="event_cause")
    terms = pb.select(F.explode(F.array("manpower", "barricading", "diversion")).alias("term")).groupBy("term").agg(
        F.count("*").alias("incidents"))
    return terms.select("term", SC.translate_terms(F.col("term")).alias("display"), "incidents")


NEWS_Q_SQL = f"""
SELECT incident_id, concat_ws(' ', '{SC.NEWS_BASE_TERMS}', CASE WHEN loc <> '' THEN loc END, CASE WHEN term <> '' THEN term END) AS news_query
FROM (SELECT incident_id,
        CASE WHEN upper(trim(l0)) IN ('', 'NULL', 'NONE') THEN '' ELSE trim(split_part(l0, ',', 1)) END AS loc,
        coalesce(CASE lower(raw) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SC.NEWS_TYPE_TERMS.items())} END, replace(raw, '_', ' ')) AS term
      FROM (SELECT incident_id, coalesce(nullif(address, ''), nullif(corridor, ''), '') AS l0,
              coalesce(nullif(event_cause, ''), nullif(incident_type, ''), '') AS raw
            FROM (SELECT incident_id, event_cause, incident_type, corridor,
                    CASE k % 3 WHEN 0 THEN 'NULL' WHEN 1 THEN corridor || ', Bengaluru' END AS address FROM incidents) a) b) c"""


@register("build_news_query", A.with_views(NEWS_Q_SQL))
def q_build_news_query(spark, sf):
    inc = A.table(spark, sf, "incidents")
    addr = F.when(F.col("k") % 3 == 0, F.lit("NULL")).when(F.col("k") % 3 == 1, F.concat(F.col("corridor"), F.lit(", Bengaluru")))
    none = F.lit(None).cast("string")
    q = SC.build_news_query(addr, none, F.col("corridor"), none, none, F.col("event_cause"), F.col("incident_type"))
    return inc.select("incident_id", q.alias("news_query"))


@register("l2_normalize", A.with_views("""
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(v[1], 6) AS first
FROM (SELECT vec_id, CASE WHEN n > 0 THEN list_transform(e, lambda x: x / n) ELSE e END AS v
      FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n
            FROM (SELECT vec_id, CAST(CASE WHEN label = 0 THEN list_transform(embedding, lambda x: 0.0) ELSE list_transform(embedding, lambda x: x * 3) END AS DOUBLE[]) AS e
                  FROM embeddings) a) b) c"""))
def q_l2_normalize(spark, sf):
    emb = A.table(spark, sf, "embeddings")
    e = F.when(F.col("label") == 0, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(
        F.transform("embedding", lambda x: x.cast("double") * 3))
    v = SC.l2_normalize(e)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return rounded(emb.select("vec_id", norm.alias("norm"), v[0].alias("first")))


@register("text_hash", A.with_views("SELECT doc_id, sha256(text) AS text_hash FROM documents"))
def q_text_hash(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", SC.text_hash(F.col("text")).alias("text_hash"))


@register("log_duration", A.with_views("""
SELECT incident_id, round(ln(1 + greatest(0.0, duration_min - 50)), 6) AS log_duration,
  round(greatest(0.0, exp(ln(1 + greatest(0.0, duration_min - 50))) - 1), 6) AS back FROM incidents"""))
def q_log_duration(spark, sf):
    inc = A.table(spark, sf, "incidents")
    y = SC.log_duration(F.col("duration_min") - 50)
    return rounded(inc.select("incident_id", y.alias("log_duration"), SC.from_log_duration(y).alias("back")))


@register("duration_interval", A.with_views("""
SELECT incident_id, round(duration_min * 0.8, 6) AS ci_lower, round(duration_min * 1.2, 6) AS ci_upper,
  round(duration_min * 0.7, 6) AS wide_lower, round(duration_min * 1.5, 6) AS wide_upper FROM incidents"""))
def q_duration_interval(spark, sf):
    inc = A.table(spark, sf, "incidents")
    a, b = SC.duration_interval(F.col("duration_min")), SC.duration_interval(F.col("duration_min"), 0.7, 1.5)
    return rounded(inc.select("incident_id", a["ci_lower"].alias("ci_lower"), a["ci_upper"].alias("ci_upper"),
                              b["ci_lower"].alias("wide_lower"), b["ci_upper"].alias("wide_upper")))


@register("news_boost", A.with_views("""
SELECT incident_id, round(CASE WHEN m THEN least(s + 15.0, 100.0) ELSE s END, 6) AS severity,
  round(CASE WHEN m THEN d * 1.5 ELSE d END, 6) AS duration
FROM (SELECT incident_id, least(severity_raw, 100.0) AS s, duration_min AS d,
        contains(lower(description), 'protest') OR contains(lower(description), 'strike') OR contains(lower(description), 'und') AS m
      FROM incidents_text) x"""))
def q_news_boost(spark, sf):
    it = A.table(spark, sf, "incidents_text")
    low = F.lower("description")
    m = F.contains(low, F.lit("protest")) | F.contains(low, F.lit("strike")) | F.contains(low, F.lit("und"))
    b = SC.news_boost(F.least("severity_raw", F.lit(100.0)), F.col("duration_min"), m)
    return rounded(it.select("incident_id", b["severity"].alias("severity"), b["duration"].alias("duration")))


@register("alert_multiplier", A.with_views("""
SELECT incident_id, round(CASE WHEN event_cause = 'water_logging' THEN ln(1 + duration_min) * 1.3 ELSE ln(1 + duration_min) END, 6) AS log_estimate
FROM incidents"""))
def q_alert_multiplier(spark, sf):
    inc = A.table(spark, sf, "incidents")
    return rounded(inc.select("incident_id", SC.alert_multiplier(F.log1p("duration_min"), F.col("event_cause") == "water_logging")
                              .alias("log_estimate")))


@register("weighted_blend", A.with_views("""
SELECT incident_id, round(least(greatest(least(severity_raw, 100.0) * 0.7 + 50.0 * 0.3, 0.0), 100.0), 6) AS severity,
  round(greatest(duration_min * 0.6 + 30.0 * 0.4, 0.0), 6) AS duration FROM incidents"""))
def q_weighted_blend(spark, sf):
    inc = A.table(spark, sf, "incidents")
    b = SC.weighted_blend(F.least("severity_raw", F.lit(100.0)), F.lit(50.0), F.col("duration_min"), F.lit(30.0))
    return rounded(inc.select("incident_id", b["severity"].alias("severity"), b["duration"].alias("duration")))


@register("mask_secret", A.with_views("""
SELECT doc_id, name, CASE WHEN contains(lower(name), 'password') OR contains(lower(name), 'secret') OR contains(lower(name), 'token')
  OR contains(lower(name), 'key') OR contains(lower(name), 'api_key')
  THEN CASE WHEN length(v) > 6 THEN substring(v, 1, 3) || repeat('*', length(v) - 6) || substring(v, length(v) - 2, 3) ELSE '***' END
  ELSE v END AS shown, substring(v, 1, 8) || '...' AS api_key_shown
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'DB_PASSWORD' WHEN 1 THEN 'SERVICE_HOST' ELSE 'API_TOKEN' END AS name,
        CASE doc_id % 2 WHEN 0 THEN source ELSE lang || '_' || source || '_' || CAST(doc_id AS VARCHAR) END AS v FROM documents) x"""))
def q_mask_secret(spark, sf):
    d = A.table(spark, sf, "documents")
    name = (F.when(F.col("doc_id") % 3 == 0, "DB_PASSWORD").when(F.col("doc_id") % 3 == 1, "SERVICE_HOST")
            .otherwise("API_TOKEN"))
    v = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(
        F.concat_ws("_", "lang", "source", F.col("doc_id").cast("string")))
    x = d.select("doc_id", name.alias("name"), v.alias("v"))
    return x.select("doc_id", "name", SC.mask_secret(F.col("name"), F.col("v")).alias("shown"),
                    SC.mask_api_key(F.col("v")).alias("api_key_shown"))


@register("redact_details", A.with_views("""
SELECT seq, 'REDACTED_GRID_CELL' AS location, 'REDACTED_IP' AS user_ip, operation FROM audit_entries"""))
def q_redact_details(spark, sf):
    a = A.table(spark, sf, "audit_entries")
    det = F.create_map(F.lit("location"), F.concat(F.lit("cell_"), F.col("seq").cast("string")),
                       F.lit("user_ip"), F.lit("10.0.0.1"), F.lit("operation"), F.col("operation"))
    r = SC.redact_details(det)
    return a.select("seq", r["location"].alias("location"), r["user_ip"].alias("user_ip"),
                    r["operation"].alias("operation"))


TITLE_SQL = "array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@register("incident_label", A.with_views(f"""
SELECT incident_id, {TITLE_SQL.format(c='event_cause')} || ' at ' || substring(corridor || ' - ' || incident_type || ' corridor zone', 1, 40)
  || CASE WHEN length(corridor || ' - ' || incident_type || ' corridor zone') > 40 THEN '...' ELSE '' END AS label FROM incidents"""))
def q_incident_label(spark, sf):
    inc = A.table(spark, sf, "incidents")
    addr = F.concat(F.col("corridor"), F.lit(" - "), F.col("incident_type"), F.lit(" corridor zone"))
    return inc.select("incident_id", SC.incident_label(F.col("event_cause"), addr).alias("label"))


@register("plan_b", A.with_views("""
SELECT incident_id, bucket,
  round(sev_duration, 6) AS plan_b_duration, plan_b_manpower, plan_b_barricading, plan_b_action
FROM (SELECT pb.incident_id, pb.bucket, dur * CASE pb.bucket WHEN 'high_severity' THEN 1.45 WHEN 'medium_severity' THEN 1.25 ELSE 1.0 END AS sev_duration,
    CASE WHEN bucket <> 'low_severity' THEN '1 Constable' ELSE manpower END AS plan_b_manpower,
    CASE bucket WHEN 'high_severity' THEN '5 Cones' WHEN 'medium_severity' THEN '2 Standard Barricades' ELSE barricading END AS plan_b_barricading,
    CASE bucket WHEN 'high_severity' THEN 'Rely heavily on VMS alerts instead of physical diversions.'
      WHEN 'medium_severity' THEN 'Prioritize heavy vehicle diversion only.' ELSE diversion END AS plan_b_action FROM pb) x""", RULES_CTE, PLAYBOOK_CTE))
def q_plan_b(spark, sf):
    """The plan with one constable: its own resources and a longer duration, the playbook's own for low severity."""
    inc = A.table(spark, sf, "incidents").select("incident_id", "event_cause", "duration_min", F.col("severity_raw").alias("severity_score"))
    pb = playbook_lookup(inc, playbook_rules(spark), type_col="event_cause", duration_col="duration_min")
    b = F.col("severity_bucket")
    # The constrained plan's texts and factors.
    pick = lambda high, medium, low: F.when(b == "high_severity", high).when(b == "medium_severity", medium).otherwise(low)
    return rounded(pb.select(
        "incident_id", b.alias("bucket"), (F.col("duration_min") * pick(1.45, 1.25, 1.0)).alias("plan_b_duration"),
        pick("1 Constable", "1 Constable", F.col("manpower")).alias("plan_b_manpower"),
        pick("5 Cones", "2 Standard Barricades", F.col("barricading")).alias("plan_b_barricading"),
        pick("Rely heavily on VMS alerts instead of physical diversions.", "Prioritize heavy vehicle diversion only.",
             F.col("diversion")).alias("plan_b_action")))


@register("id_defaults", A.with_views("""
SELECT arrival_seq, coalesce(CASE WHEN k % 10 = 0 THEN NULL ELSE incident_id END, 'batch_item_' || CAST(arrival_seq AS VARCHAR)) AS incident_id
FROM incidents"""))
def q_id_defaults(spark, sf):
    inc = A.table(spark, sf, "incidents")
    given = F.when(F.col("k") % 10 != 0, F.col("incident_id"))
    return inc.select("arrival_seq", F.coalesce(given, F.concat(F.lit("batch_item_"), F.col("arrival_seq").cast("string")))
                      .alias("incident_id"))


@register("coalesce_location", A.with_views("""
SELECT incident_id, round(coalesce(nullif(m, 0.0), latitude, 12.9716), 6) AS lat FROM (
  SELECT incident_id, latitude, CASE WHEN k % 6 = 0 THEN 0.0 WHEN k % 6 = 1 THEN NULL ELSE latitude + 0.001 END AS m FROM incidents) x"""))
def q_coalesce_location(spark, sf):
    inc = A.table(spark, sf, "incidents")
    m = F.when(F.col("k") % 6 == 0, F.lit(0.0)).when(F.col("k") % 6 == 1, F.lit(None)).otherwise(F.col("latitude") + 0.001)
    return rounded(inc.select("incident_id", FE.coalesce_location(m, F.col("latitude"), 12.9716).alias("lat")))


@register("map_incident_view", A.with_views(f"""
SELECT i.incident_id, round(CASE WHEN m.incident_id IS NOT NULL THEN least(i.severity_raw, 100.0) * 0.4 ELSE least(i.severity_raw, 100.0) END, 6) AS effective_severity,
  {TITLE_SQL.format(c='i.event_cause')} AS type_title,
  substring(i.description, 1, 100) || CASE WHEN length(i.description) > 100 THEN '...' ELSE '' END AS desc_short,
  {FMT_DUR_SQL.replace('m IS NULL', 'CAST(floor(i.duration_min) AS BIGINT) IS NULL').replace('m ', 'CAST(floor(i.duration_min) AS BIGINT) ').replace('(m', '(CAST(floor(i.duration_min) AS BIGINT)')} AS duration_display,
  'Unknown Location' AS address
FROM incidents_text i LEFT JOIN (SELECT DISTINCT incident_id FROM nearby) m ON m.incident_id = i.incident_id""",
    ("targets", "SELECT incident_type, max_by(incident_id, arrival_seq) AS target_id, max_by(latitude, arrival_seq) AS t_lat, max_by(longitude, arrival_seq) AS t_lon FROM incidents GROUP BY incident_type"),
    ("nearby", "SELECT t.target_id, i.incident_id FROM targets t JOIN incidents i ON abs(i.latitude - t.t_lat) < 0.015 AND abs(i.longitude - t.t_lon) < 0.015")))
def q_map_incident_view(spark, sf):
    from roadlens.operators.dedup import nearby_targets
    from roadlens.operators.lookups import mitigated_flag
    it = A.table(spark, sf, "incidents_text")
    inc = A.table(spark, sf, "incidents")
    targets = inc.groupBy("incident_type").agg(F.max_by("incident_id", "arrival_seq").alias("incident_id"),
                                               F.max_by("latitude", "arrival_seq").alias("latitude"),
                                               F.max_by("longitude", "arrival_seq").alias("longitude"))
    covered = nearby_targets(targets, inc).select("incident_id")
    short = SC.ellipsis(F.col("description"), 100).alias("desc_short")  # before the shuffle by incident: whole texts would travel with it
    v = mitigated_flag(it.select("incident_id", "severity_raw", "event_cause", short, "duration_min"), covered)
    sev = F.least("severity_raw", F.lit(100.0))
    return rounded(v.select("incident_id", F.when(F.col("mitigated"), sev * 0.4).otherwise(sev).alias("effective_severity"),
                            SC.title_words(F.col("event_cause")).alias("type_title"),
                            "desc_short",
                            SC.format_duration(F.col("duration_min")).alias("duration_display"),
                            F.lit("Unknown Location").alias("address")))
