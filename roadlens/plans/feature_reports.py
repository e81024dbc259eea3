"""Feature keys and the flagship briefing used by ``entry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens.operators import features as FE
from roadlens.operators import validate as V
from roadlens.operators.playbook import playbook_lookup, playbook_rules, severity_key, DEFAULT_RULES
from roadlens.plans.registry import AS_OF, joined, register, rounded


def incident_briefing(spark, sf):
    """Validate, de-duplicate, derive grid/time/weather, bucket severity and attach the playbook."""
    v = V.validate_with_duplicates(A.incident_reports(spark, sf), AS_OF)
    v = FE.derive_weather_category(FE.derive_time(FE.derive_grid(v)))
    sev = F.least(F.col("severity_initial"), F.lit(100.0))
    v = v.withColumn("severity_score", sev).withColumn("duration_estimate", F.col("duration_min"))
    pb = playbook_lookup(v, playbook_rules(spark), type_col="event_cause")
    return rounded(pb.select(
        "incident_id", "incident_type", "valid", F.size("errors").alias("error_count"),
        F.size("duplicate_incident_ids").alias("n_duplicates"), "location_grid_cell", "distance_to_highway",
        "day_of_week", "time_of_day_bins", "is_rush_hour", "weather_category",
        FE.severity_bucket(F.col("severity_score")).alias("severity_level"), "severity_bucket", "manpower",
        "barricading", F.size("actions").alias("n_actions"), "public_alert"))


@register("derive_grid", A.with_views("""
SELECT incident_id, gx AS grid_x, gy AS grid_y,
  least(abs(gx % 10 - 5) * 0.5 + abs(gy % 10 - 5) * 0.5, 50.0) AS distance_to_highway,
  'cell_' || CAST(floor(gx / 10) AS BIGINT) || '_' || CAST(floor(gy / 10) AS BIGINT) AS location_grid_cell
FROM (SELECT incident_id, CAST(floor((longitude + 180.0) / 0.01) AS BIGINT) AS gx,
             CAST(floor((latitude + 90.0) / 0.01) AS BIGINT) AS gy FROM incidents) g"""))
def q_derive_grid(spark, sf):
    df = FE.derive_grid(A.table(spark, sf, "incidents"))
    return rounded(df.select("incident_id", "grid_x", "grid_y", "distance_to_highway", "location_grid_cell"))


@register("derive_time", A.with_views("""
SELECT incident_id, hour(start_datetime) AS hour_of_day,
  ['monday','tuesday','wednesday','thursday','friday','saturday','sunday'][isodow(start_datetime)] AS day_of_week,
  (hour(start_datetime) >= 7 AND hour(start_datetime) < 9) OR (hour(start_datetime) >= 17 AND hour(start_datetime) < 19) AS is_rush_hour,
  CASE WHEN hour(start_datetime) >= 5 AND hour(start_datetime) < 9 THEN 'morning'
       WHEN hour(start_datetime) >= 9 AND hour(start_datetime) < 12 THEN 'mid_morning'
       WHEN hour(start_datetime) >= 12 AND hour(start_datetime) < 17 THEN 'afternoon'
       WHEN hour(start_datetime) >= 17 AND hour(start_datetime) < 21 THEN 'evening' ELSE 'night' END AS time_of_day_bins
FROM incidents"""))
def q_derive_time(spark, sf):
    df = FE.derive_time(A.table(spark, sf, "incidents"))
    return df.select("incident_id", "hour_of_day", "day_of_week", "is_rush_hour", "time_of_day_bins")


@register("derive_weather_category", A.with_views("""
SELECT incident_id, temperature,
  CASE WHEN temperature IS NULL THEN 'unknown' WHEN temperature < 0 THEN 'cold' WHEN temperature < 15 THEN 'cool'
       WHEN temperature < 25 THEN 'mild' ELSE 'warm' END AS weather_category FROM incidents"""))
def q_derive_weather_category(spark, sf):
    df = FE.derive_weather_category(A.table(spark, sf, "incidents"))
    return rounded(df.select("incident_id", "temperature", "weather_category"))


@register("severity_bucket", A.with_views("""
SELECT incident_id, CASE WHEN s >= 70 THEN 'high' WHEN s >= 40 THEN 'medium' ELSE 'low' END AS severity_level,
  CASE WHEN s >= 70 THEN 'red' WHEN s >= 40 THEN 'orange' ELSE 'green' END AS colour
FROM (SELECT incident_id, severity_raw AS s FROM incidents) x"""))
def q_severity_bucket(spark, sf):
    df = A.table(spark, sf, "incidents")
    s = F.col("severity_raw")
    return df.select("incident_id", FE.severity_bucket(s).alias("severity_level"), FE.severity_colour(s).alias("colour"))


def _rules_sql():
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return "'" + v.replace("'", "''") + "'"
    rows = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in DEFAULT_RULES)
    cols = ("incident_type, bucket, manpower, barricading, diversion, special_equipment, agency_sync, "
            "public_advisory, actions, communications")
    return ("rules", f"SELECT * FROM (VALUES {rows}) AS t({cols})")


RULES_CTE = _rules_sql()
PLAYBOOK_CTE = ("pb", """
SELECT i.incident_id, i.event_cause, i.sev, i.bucket, coalesce(r1.incident_type, r2.incident_type) AS matched,
  coalesce(CASE WHEN r1.bucket IS NOT NULL THEN r1.manpower ELSE r2.manpower END, '1 Traffic Constable (Monitor only)') AS manpower,
  coalesce(CASE WHEN r1.bucket IS NOT NULL THEN r1.barricading ELSE r2.barricading END, 'None required') AS barricading,
  coalesce(CASE WHEN r1.bucket IS NOT NULL THEN r1.diversion ELSE r2.diversion END, 'No diversion needed.') AS diversion,
  coalesce(CASE WHEN r1.bucket IS NOT NULL THEN r1.special_equipment ELSE r2.special_equipment END, 'No special equipment needed') AS special_equipment,
  coalesce(CASE WHEN r1.bucket IS NOT NULL THEN r1.agency_sync ELSE r2.agency_sync END, 'BTP internal handling only') AS agency_sync,
  coalesce(CASE WHEN r1.bucket IS NOT NULL THEN r1.public_advisory ELSE r2.public_advisory END, 'Standard traffic monitoring') AS public_advisory,
  coalesce(CASE WHEN r1.bucket IS NOT NULL THEN r1.actions ELSE r2.actions END, ['Dispatch response team']) AS actions,
  coalesce(CASE WHEN r1.bucket IS NOT NULL THEN r1.communications ELSE r2.communications END, ['Issue general advisory']) AS comms,
  i.dur
FROM (SELECT incident_id, event_cause, coalesce(severity_raw, 0) AS sev, duration_min AS dur,
        CASE WHEN lower(event_cause) IN (SELECT incident_type FROM rules) THEN lower(event_cause) ELSE 'generic_fallback' END AS rt,
        CASE WHEN coalesce(severity_raw, 0) >= 70 THEN 'high_severity' WHEN coalesce(severity_raw, 0) >= 40 THEN 'medium_severity'
             ELSE 'low_severity' END AS bucket FROM incidents) i
LEFT JOIN rules r1 ON r1.incident_type = i.rt AND r1.bucket = i.bucket
LEFT JOIN rules r2 ON r2.incident_type = i.rt AND r2.bucket = 'high_severity'""")


@register("playbook_lookup", A.with_views("""
SELECT incident_id, bucket AS severity_bucket, manpower, barricading, diversion, special_equipment, agency_sync,
  public_advisory, array_to_string(list_transform(actions, lambda a, i: CAST(i AS VARCHAR) || ':' || a || ':Immediate'), '|') AS actions,
  CASE WHEN len(comms) > 0 THEN comms[1] ELSE 'Expect delays due to ' || coalesce(event_cause, 'incident') || '.' END AS public_alert,
  'Incident type ' || coalesce(event_cause, 'unknown') || ' with severity ' || printf('%.1f', round(sev, 1)) ||
    ' and estimated duration ' || printf('%.1f', round(coalesce(dur, 0), 1)) || ' mins.' AS playbook_summary
FROM pb""", RULES_CTE, PLAYBOOK_CTE))
def q_playbook_lookup(spark, sf):
    df = A.table(spark, sf, "incidents").select(
        "incident_id", "event_cause", F.col("severity_raw").alias("severity_score"),
        F.col("duration_min").alias("duration_estimate"))
    pb = playbook_lookup(df, playbook_rules(spark), type_col="event_cause")
    acts = F.concat_ws("|", F.transform("actions", lambda a: F.concat(a["priority"].cast("string"), F.lit(":"),
                                                                        a["action"], F.lit(":"), a["timeline"])))
    return pb.select("incident_id", "severity_bucket", "manpower", "barricading", "diversion", "special_equipment",
                     "agency_sync", "public_advisory", acts.alias("actions"), "public_alert", "playbook_summary")


@register("src_playbook_rules", A.with_views("""
SELECT incident_type, bucket, manpower, barricading, diversion, special_equipment, agency_sync, public_advisory,
  array_to_string(actions, '|') AS actions, array_to_string(communications, '|') AS communications,
  (SELECT count(*) FROM incidents i WHERE lower(i.event_cause) = rules.incident_type AND rules.bucket =
    CASE WHEN coalesce(i.severity_raw, 0) >= 70 THEN 'high_severity' WHEN coalesce(i.severity_raw, 0) >= 40 THEN 'medium_severity'
         ELSE 'low_severity' END) AS incidents FROM rules""", RULES_CTE))
def q_src_playbook_rules(spark, sf):
    """The rules with the number of incidents that each applies to by type and severity."""
    r = playbook_rules(spark)
    inc = A.table(spark, sf, "incidents")
    hits = inc.groupBy(F.lower("event_cause").alias("incident_type"), severity_key(F.col("severity_raw")).alias("bucket")).agg(
        F.count("*").alias("incidents"))
    r = r.join(hits, ["incident_type", "bucket"], "left")
    return r.select(*[c for c in r.columns if c not in ("actions", "communications", "incidents")],
                    joined("actions").alias("actions"), joined("communications").alias("communications"),
                    F.coalesce("incidents", F.lit(0)).alias("incidents"))


@register("structured_features", A.with_views("""
SELECT incident_id, latitude AS f_lat, longitude AS f_lon,
  CASE coalesce(lower(priority), 'medium') WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.0 ELSE 0.0 END AS priority_numeric,
  CASE WHEN lower(coalesce(event_cause, incident_type, '')) = 'construction' THEN 1.0 ELSE 0.0 END AS is_construction,
  CASE WHEN lower(coalesce(event_cause, incident_type, '')) IN ('public_event','procession','protest','vip_movement','planned') THEN 1.0 ELSE 0.0 END AS is_event,
  CASE WHEN coalesce(lower(veh_type), '') IN ('heavy_vehicle','truck','bmtc_bus','ksrtc_bus') THEN 1.0 ELSE 0.0 END AS is_heavy_vehicle,
  CASE WHEN coalesce(lower(veh_type), '') IN ('lcv','private_bus') THEN 1.0 ELSE 0.0 END AS is_lcv,
  CASE WHEN regexp_matches(coalesce(lower(corridor), ''), 'orr|cbd|tumkur') THEN 1.0 ELSE 0.0 END AS is_major_corridor
FROM incidents"""))
def q_structured_features(spark, sf):
    df = FE.structured_features(A.table(spark, sf, "incidents"))
    return rounded(df.select("incident_id", *FE.STRUCTURED_COLUMNS))


@register("severity_proxy_v1", A.with_views("""
SELECT incident_id, least(greatest(
  CASE WHEN lower(priority) = 'high' THEN 40 ELSE 0 END + CASE WHEN event_cause = 'road_closure' THEN 30 ELSE 0 END +
  CASE event_cause WHEN 'accident' THEN 20 WHEN 'tree_fall' THEN 15 WHEN 'water_logging' THEN 15
    WHEN 'vehicle_breakdown' THEN 10 WHEN 'pot_holes' THEN 5 WHEN 'congestion' THEN 15 ELSE 5 END, 0), 100)::DOUBLE AS severity_score
FROM incidents"""))
def q_severity_proxy_v1(spark, sf):
    df = A.table(spark, sf, "incidents")
    s = FE.severity_proxy_v1(F.col("priority"), F.col("event_cause") == "road_closure", F.col("event_cause"))
    return df.select("incident_id", s.alias("severity_score"))


@register("severity_proxy_v2", A.with_views("""
SELECT incident_id, least(greatest(
  CASE WHEN lower(priority) = 'high' THEN 40 ELSE 0 END + CASE WHEN event_cause = 'road_closure' THEN 30 ELSE 0 END +
  CASE WHEN coalesce(lower(veh_type), 'nan') IN ('heavy_vehicle','truck','bmtc_bus','ksrtc_bus') THEN 20 ELSE 0 END +
  CASE WHEN coalesce(lower(veh_type), 'nan') IN ('lcv','private_bus') THEN 10 ELSE 0 END +
  CASE WHEN regexp_matches(lower(corridor), 'orr|cbd|tumkur') THEN 10 ELSE 0 END +
  CASE WHEN coalesce(lower(event_cause), 'nan') IN ('political_rally','water_logging','construction','accident') THEN 15 ELSE 0 END +
  CASE WHEN duration_min > 120 THEN 10 ELSE 0 END, 0), 100)::DOUBLE AS severity_score
FROM incidents"""))
def q_severity_proxy_v2(spark, sf):
    df = A.table(spark, sf, "incidents")
    s = FE.severity_proxy_v2(F.col("priority"), F.col("event_cause") == "road_closure", F.col("veh_type"),
                             F.col("corridor"), F.col("event_cause"), F.col("duration_min"))
    return df.select("incident_id", s.alias("severity_score"))


@register("survival_covariates", A.with_views("""
SELECT incident_id,
  coalesce(CASE lower(event_cause) WHEN 'accident' THEN 0.0 WHEN 'congestion' THEN 1.0 WHEN 'road_closure' THEN 2.0
    WHEN 'hazard' THEN 3.0 WHEN 'event' THEN 4.0 END, 4.0) AS cov_type,
  coalesce(CASE lower(priority) WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.0 WHEN 'low' THEN 0.0 END, 0.0) AS cov_priority,
  CAST(hour(start_datetime) AS DOUBLE) AS cov_hour FROM incidents"""))
def q_survival_covariates(spark, sf):
    df = FE.survival_covariates(A.table(spark, sf, "incidents"))
    return df.select("incident_id", "cov_type", "cov_priority", "cov_hour")


@register("fill_text_defaults", A.with_views("""
SELECT incident_id, coalesce(CASE WHEN k % 9 = 0 THEN NULL ELSE event_cause END, 'unknown') AS event_cause,
  coalesce(CASE WHEN k % 11 = 0 THEN NULL ELSE description END, '') AS description_len_src,
  length(coalesce(CASE WHEN k % 11 = 0 THEN NULL ELSE description END, '')) AS description_chars
FROM incidents_text"""))
def q_fill_text_defaults(spark, sf):
    df = A.table(spark, sf, "incidents_text").select(
        "incident_id", F.when(F.col("k") % 9 != 0, F.col("event_cause")).alias("event_cause"),
        F.when(F.col("k") % 11 != 0, F.col("description")).alias("description"))
    out = FE.fill_text_defaults(df)
    return out.select("incident_id", "event_cause", F.col("description").alias("description_len_src"),
                      F.length("description").alias("description_chars"))


@register("normalize_report", A.with_views("""
SELECT incident_id,
  CASE WHEN event_cause IN ('accident','congestion','road_closure','hazard','event') THEN event_cause ELSE 'event' END AS incident_type_norm,
  CASE WHEN length(t) < 10 THEN t || ' (padded desc)' ELSE t END AS description_norm
FROM (SELECT incident_id, event_cause,
        CASE WHEN d IS NULL OR d = '' OR d = 'NULL' THEN 'Reported ' || coalesce(event_cause, 'unknown') || ' at ' ||
             corridor || '.' ELSE d END AS t
      FROM (SELECT incident_id, event_cause, corridor, CASE WHEN k % 3 = 0 THEN 'NULL' WHEN k % 3 = 1 THEN corridor
              ELSE description END AS d FROM incidents_text) a) b"""))
def q_normalize_report(spark, sf):
    df = A.table(spark, sf, "incidents_text")
    d = (F.when(F.col("k") % 3 == 0, F.lit("NULL")).when(F.col("k") % 3 == 1, F.col("corridor"))
         .otherwise(F.col("description")))
    src = df.select("incident_id", "event_cause", d.alias("description"), F.col("corridor").alias("address"))
    out = FE.normalize_report(src)
    return out.select("incident_id", "incident_type_norm", "description_norm")


@register("end_time_coalesce", A.with_views("""
SELECT incident_id, round(CASE WHEN e IS NULL THEN NULL ELSE (epoch_us(e) - epoch_us(start_datetime)) / 60000000.0 END, 6) AS duration_minutes,
  e IS NULL AS is_censored
FROM (SELECT incident_id, start_datetime,
        coalesce(CASE WHEN k % 3 = 0 THEN start_datetime + to_microseconds(CAST(round(duration_min * 60000000) AS BIGINT)) END,
                 CASE WHEN k % 3 = 1 THEN start_datetime + to_microseconds(CAST(round(duration_min * 30000000) AS BIGINT)) END,
                 CASE WHEN event_observed THEN start_datetime + to_microseconds(CAST(round(duration_min * 90000000) AS BIGINT)) END) AS e
      FROM incidents) x"""))
def q_end_time_coalesce(spark, sf):
    df = A.table(spark, sf, "incidents")

    def plus(f):
        return F.timestamp_add("MICROSECOND", F.round(F.col("duration_min") * f).cast("long"), F.col("start_datetime"))
    src = df.select("incident_id", "start_datetime",
                    F.when(F.col("k") % 3 == 0, plus(60000000)).alias("end_datetime"),
                    F.when(F.col("k") % 3 == 1, plus(30000000)).alias("resolved_datetime"),
                    F.when(F.col("event_observed"), plus(90000000)).alias("closed_datetime"))
    out = FE.end_time_coalesce(src)
    return rounded(out.select("incident_id", "duration_minutes", "is_censored"))
