"""Validation keys: Spark builders and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens import config as C
from roadlens.operators import validate as V
from roadlens.operators.dedup import dup_detect
from roadlens.plans.registry import AS_OF, joined, register, rounded
from roadlens.session import scratch_table

WS = C.PY_WS


def reports(spark, sf):
    return A.incident_reports(spark, sf)


def _validated(spark, sf):
    """The validated reports without their texts, written once: the search for duplicates and its callers read them."""
    v = V.validate(reports(spark, sf), AS_OF)
    return scratch_table(v.select("incident_id", "arrival_seq", "incident_type", "start_datetime", "latitude", "longitude", "schema_ok",
                                  "errors", "valid"), "validated")


def _flat(errors_col):
    """Arrays rendered as '|'-joined text for engine-neutral comparison."""
    return {
        "error_count": F.size(errors_col),
        "error_fields": F.concat_ws("|", F.transform(errors_col, lambda e: e["field"])),
        "error_codes": F.concat_ws("|", F.transform(errors_col, lambda e: e["error_code"])),
        "error_values": F.concat_ws("|", F.transform(errors_col, lambda e: F.coalesce(e["value"], F.lit("")))),
    }


# ---- DuckDB oracle pieces -------------------------------------------------------------------------

def _e(field, msg, code, value="NULL"):
    return (f"CASE WHEN {{cond}} THEN {{{{'field': {field}, 'message': {msg}, 'error_code': '{code}', "
            f"'value': CAST({value} AS VARCHAR)}}}} END")


def _rule(cond, field, msg, code, value="NULL"):
    return _e(field, msg, code, value).format(cond=cond)


def _q(s):
    return "'" + s.replace("'", "''") + "'"


def _verr(field, msg):
    return (field, _q(C.MSG_VALUE_ERROR_PREFIX + msg), C.CODE_VALUE_ERROR, _q(msg[:C.CUSTOM_VALUE_CHARS]))


TS_OK = f"(start_datetime IS NOT NULL AND start_datetime <= TIMESTAMP '{AS_OF}')"
FIELD_RULES = [
    ("latitude IS NULL", "'location.latitude'", _q(C.MSG_REQUIRED), C.CODE_MISSING),
    ("latitude < -90", "'location.latitude'", _q(C.MSG_GE.format(-90)), C.CODE_GE),
    ("latitude > 90", "'location.latitude'", _q(C.MSG_LE.format(90)), C.CODE_LE),
    ("longitude IS NULL", "'location.longitude'", _q(C.MSG_REQUIRED), C.CODE_MISSING),
    ("longitude < -180", "'location.longitude'", _q(C.MSG_GE.format(-180)), C.CODE_GE),
    ("longitude > 180", "'location.longitude'", _q(C.MSG_LE.format(180)), C.CODE_LE),
    ("start_datetime IS NULL", "'timestamp'", _q(C.MSG_REQUIRED), C.CODE_MISSING),
    (f"start_datetime > TIMESTAMP '{AS_OF}'", *_verr("'timestamp'", C.MSG_TS_FUTURE)),
    ("description IS NULL", "'description'", _q(C.MSG_REQUIRED), C.CODE_MISSING),
    ("length(description) < 10", "'description'", _q(C.MSG_STR_SHORT.format(10)), C.CODE_STR_SHORT),
    ("length(description) > 5000", "'description'", _q(C.MSG_STR_LONG.format(5000)), C.CODE_STR_LONG),
    ("incident_type NOT IN ('accident','congestion','roadwork','weather','unknown')", "'incident_type'",
     _q(C.MSG_ENUM), C.CODE_ENUM),
    ("severity_initial < 0", "'severity_initial'", _q(C.MSG_GE.format(0)), C.CODE_GE),
    ("severity_initial > 100", "'severity_initial'", _q(C.MSG_LE.format(100)), C.CODE_LE),
    (f"end_datetime IS NOT NULL AND {TS_OK} AND end_datetime <= start_datetime",
     *_verr("'end_datetime'", C.MSG_END_BEFORE)),
    (f"end_datetime IS NOT NULL AND NOT ({TS_OK} AND end_datetime <= start_datetime) "
     f"AND end_datetime > TIMESTAMP '{AS_OF}'", *_verr("'end_datetime'", C.MSG_END_FUTURE)),
]
CONSISTENCY_RULES = [
    ("end_datetime IS NOT NULL AND coalesce(is_ongoing, true)", *_verr("''", C.MSG_ONGOING_WITH_END)),
    ("end_datetime IS NULL AND NOT coalesce(is_ongoing, true)", *_verr("''", C.MSG_END_REQUIRED)),
]
STRIP = f"trim(description, '{C.PY_WS_CHARS}')"
AREA = C.SERVICE_AREA
PAIR = "'(' || CAST(latitude AS VARCHAR) || ', ' || CAST(longitude AS VARCHAR) || ')'"
CHARS = "list_sort(list_filter(string_split(lower(s), ''), lambda c: c <> ' ' AND c <> ''))"
REPEAT = ("CASE WHEN length(s) > 0 AND len(cs) > 0 THEN (length(lower(s)) - length(replace(lower(s), "
          "cs[len(cs) // 2 + 1], ''))) / length(s) END")
WORDS = f"CASE WHEN length(s) = 0 THEN 0 ELSE len(regexp_split_to_array(s, '{WS}+')) END"
BUSINESS_RULES = [
    (f"NOT (latitude BETWEEN {AREA['lat_min']} AND {AREA['lat_max']} AND longitude BETWEEN {AREA['lon_min']} "
     f"AND {AREA['lon_max']})", "'location'", f"'Location ' || {PAIR} || ' is outside service area'", C.CODE_AREA, PAIR),
    (f"({REPEAT}) > {C.DESC_REPEAT_RATE}", "'description'", _q(C.MSG_NOISE), C.CODE_NOISE, "substring(s, 1, 30)"),
    (f"({WORDS}) < {C.DESC_MIN_WORDS}", "'description'", _q(C.MSG_WORDS), C.CODE_WORDS, "substring(s, 1, 30)"),
]


def _list(rules):
    return "list_filter([" + ", ".join(_rule(*r) for r in rules) + "], lambda e: e IS NOT NULL)"


VALIDATED_SQL = ("validated", f"""
SELECT *, CASE WHEN len(schema_errors) = 0 THEN {_list(BUSINESS_RULES)} ELSE schema_errors END AS errors
FROM (SELECT *, CASE WHEN len(fe) > 0 THEN fe ELSE {_list(CONSISTENCY_RULES)} END AS schema_errors
      FROM (SELECT *, {CHARS} AS cs, {_list(FIELD_RULES)} AS fe
            FROM (SELECT *, {STRIP} AS s FROM incident_reports) w) x) y""")

FLAT_SQL = """len(errors) AS error_count,
  array_to_string(list_transform(errors, lambda e: e.field), '|') AS error_fields,
  array_to_string(list_transform(errors, lambda e: e.error_code), '|') AS error_codes,
  array_to_string(list_transform(errors, lambda e: coalesce(e.value, '')), '|') AS error_values"""

DUPS_SQL = ("dups", """
SELECT p.arrival_seq, list(b.incident_id ORDER BY b.arrival_seq) AS ids, count(*) AS n
FROM cand p JOIN cand b ON p.incident_type = b.incident_type AND b.arrival_seq < p.arrival_seq
  AND abs(epoch_us(p.start_datetime) - epoch_us(b.start_datetime)) <= {w_us}
  AND sqrt(pow(abs(p.latitude - b.latitude), 2) + pow(abs(p.longitude - b.longitude), 2)) * 111.0 <= 2.0
GROUP BY p.arrival_seq""".format(w_us=int(C.DUP_WINDOW_MINUTES * 60e6)))


def _oracle(sql, *ctes):
    return A.with_views(sql, A.INCIDENT_REPORTS_SQL, *ctes)


# ---- keys -----------------------------------------------------------------------------------------

@register("val_combined", _oracle(f"""
SELECT v.incident_id, len(v.errors) = 0 AS valid, len(v.schema_errors) = 0 AS schema_ok, {FLAT_SQL},
  CASE WHEN len(v.schema_errors) = 0 THEN coalesce(d.n, 0) END AS n_duplicates,
  CASE WHEN len(v.schema_errors) = 0 THEN coalesce(array_to_string(d.ids, '|'), '') END AS duplicate_ids
FROM validated v LEFT JOIN dups d ON v.arrival_seq = d.arrival_seq""",
    VALIDATED_SQL, ("cand", "SELECT * FROM validated WHERE len(schema_errors) = 0"), DUPS_SQL))
def q_val_combined(spark, sf):
    v = V.with_duplicates(_validated(spark, sf))
    d = F.col("duplicate_incident_ids")
    return v.select("incident_id", "valid", "schema_ok", *[c.alias(k) for k, c in _flat(F.col("errors")).items()],
                    F.size(d).alias("n_duplicates").cast("long"), joined(d).alias("duplicate_ids"))


@register("val_schema", _oracle(f"SELECT incident_id, len(fe) = 0 AS fields_ok, "
                                f"{FLAT_SQL.replace('errors', 'fe')} FROM validated", VALIDATED_SQL))
def q_val_schema(spark, sf):
    df = reports(spark, sf)
    out = df.withColumn("fe", V.field_errors(df, AS_OF))
    return out.select("incident_id", (F.size("fe") == 0).alias("fields_ok"),
                      *[c.alias(k) for k, c in _flat(F.col("fe")).items()])


@register("val_temporal", _oracle(f"""
SELECT incident_id, array_to_string(list_transform(list_filter(schema_errors, lambda e: e.error_code = 'value_error'),
  lambda e: e.field || ':' || e.value), '|') AS temporal_errors FROM validated""", VALIDATED_SQL))
def q_val_temporal(spark, sf):
    out = V.with_schema_errors(reports(spark, sf), AS_OF)
    te = F.filter("schema_errors", lambda e: e["error_code"] == C.CODE_VALUE_ERROR)
    return out.select("incident_id", F.concat_ws("|", F.transform(te, lambda e: F.concat(e["field"], F.lit(":"), e["value"])))
                      .alias("temporal_errors"))


@register("val_service_area", A.with_views(f"""
SELECT incident_id, {BUSINESS_RULES[0][0]} AS out_of_area,
  CASE WHEN {BUSINESS_RULES[0][0]} THEN {PAIR} END AS error_value FROM incidents"""))
def q_val_service_area(spark, sf):
    df = A.table(spark, sf, "incidents")
    e = V.area_error(F.col("latitude"), F.col("longitude"))
    return df.select("incident_id", e.isNotNull().alias("out_of_area"), e["value"].alias("error_value"))


@register("val_desc_noise", A.with_views(f"""
SELECT incident_id, CASE WHEN rate > 0.5 THEN round(rate, 6) END AS majority_rate, coalesce(rate > 0.7, false) AS noisy,
  CASE WHEN rate > 0.7 THEN substring(s, 1, 30) END AS error_value
FROM (SELECT incident_id, s, {REPEAT} AS rate FROM (SELECT incident_id, s, {CHARS} AS cs
      FROM (SELECT incident_id, {STRIP} AS s FROM incidents_text) a) a2) b"""))
def q_val_desc_noise(spark, sf):
    df = V.with_text_stats(A.table(spark, sf, "incidents_text"))
    r = F.col("_desc_rate")
    e = V.noise_error_from(r, F.col("_desc_s"))
    return rounded(df.select("incident_id", F.when(r > 0.5, r).alias("majority_rate"),
                             F.coalesce(r > 0.7, F.lit(False)).alias("noisy"),
                             e["value"].alias("error_value")))


@register("val_desc_words", A.with_views(f"""
SELECT incident_id, {WORDS} AS word_count, ({WORDS}) < 2 AS too_few_words
FROM (SELECT incident_id, {STRIP} AS s FROM incidents_text) a"""))
def q_val_desc_words(spark, sf):
    df = V.with_text_stats(A.table(spark, sf, "incidents_text"))
    wc = F.col("_desc_words")
    return df.select("incident_id", wc.alias("word_count"), (wc < 2).alias("too_few_words"))


@register("val_ingest", A.with_views("""
SELECT incident_id FROM incidents_text
WHERE length(description) >= 10 AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"""))
def q_val_ingest(spark, sf):
    return V.ingest_gate(A.table(spark, sf, "incidents_text")).select("incident_id")


@register("val_db_check", A.with_views("""
SELECT count_if(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) AS passing,
  count_if(NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)) AS violating FROM incidents"""))
def q_val_db_check(spark, sf):
    ok = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    return A.table(spark, sf, "incidents").agg(F.count_if(ok).alias("passing"), F.count_if(~ok).alias("violating"))


@register("val_error_value", _oracle("""
SELECT v.incident_id, e.field AS field, e.error_code AS error_code, e.value AS value
FROM validated v, unnest(v.errors) AS t(e)""", VALIDATED_SQL))
def q_val_error_value(spark, sf):
    return V.each_error(V.validate(reports(spark, sf), AS_OF), "incident_id").select(
        "incident_id", F.col("e.field").alias("field"), F.col("e.error_code").alias("error_code"),
        F.col("e.value").alias("value"))


SUMMARY_SQL = """CASE WHEN len(errors) = 0 THEN 'Validation passed'
  WHEN len(errors) = 1 THEN 'Validation failed: ' || errors[1].field || ' - ' || errors[1].message
  ELSE 'Validation failed with ' || CAST(len(errors) AS VARCHAR) || ' error(s): ' ||
    array_to_string(list_transform(list_filter(list_transform(errors, lambda e: e.error_code), lambda c, i: list_position(list_transform(errors, lambda e: e.error_code), c) = i),
      lambda c: c || ' (' || CAST(len(list_filter(errors, lambda e: e.error_code = c)) AS VARCHAR) || ')'), ', ') END"""
DETAIL_SQL = """CASE WHEN len(errors) = 0 THEN 'No errors' ELSE
  'Validation failed with ' || CAST(len(errors) AS VARCHAR) || ' error(s):' || chr(10) ||
  array_to_string(list_transform(errors, lambda e, i: '  ' || CAST(i AS VARCHAR) || '. [' || e.field || '] ' || e.message ||
    CASE WHEN coalesce(e.value, '') <> '' THEN ' (value: ' || e.value || ')' ELSE '' END), chr(10)) END"""


@register("err_messages", _oracle(f"SELECT incident_id, {SUMMARY_SQL} AS summary, {DETAIL_SQL} AS detail FROM validated",
                                  VALIDATED_SQL))
def q_err_messages(spark, sf):
    v = V.validate(reports(spark, sf), AS_OF)
    return v.select("incident_id", V.summary_message(F.col("errors")).alias("summary"),
                    V.detailed_message(F.col("errors")).alias("detail"))


@register("err_payload_api", _oracle("""
SELECT incident_id, len(errors) AS error_count,
  array_to_string(list_sort(list_distinct(list_transform(errors, lambda e: e.field))), '|') AS affected_fields,
  array_to_string(list_transform(errors, lambda e: e.field || '/' || e.error_code), '|') AS details
FROM validated WHERE len(errors) > 0""", VALIDATED_SQL))
def q_err_payload_api(spark, sf):
    v = V.failing(V.validate(reports(spark, sf), AS_OF))
    p = F.from_json(V.api_payload(F.col("errors")),
                    "error string, message string, details array<struct<field:string,message:string,code:string>>, "
                    "error_count int, affected_fields array<string>")
    return v.select("incident_id", p.alias("p")).select(
        "incident_id", F.col("p.error_count").alias("error_count"),
        F.concat_ws("|", "p.affected_fields").alias("affected_fields"),
        F.concat_ws("|", F.transform("p.details", lambda d: F.concat(d["field"], F.lit("/"), d["code"]))).alias("details"))


@register("err_payload_log", _oracle("""
SELECT incident_id, len(errors) AS error_count,
  array_to_string(list_sort(list_distinct(list_transform(errors, lambda e: e.error_code))), '|') AS error_codes,
  array_to_string(list_sort(list_distinct(list_transform(errors, lambda e: e.field))), '|') AS affected_fields
FROM validated WHERE len(errors) > 0""", VALIDATED_SQL))
def q_err_payload_log(spark, sf):
    v = V.failing(V.validate(reports(spark, sf), AS_OF))
    p = F.from_json(V.log_payload(F.col("errors"), F.col("incident_id")),
                    "event string, incident_id string, error_count int, error_codes array<string>, "
                    "affected_fields array<string>")
    return v.select(F.col("incident_id"), p.alias("p")).select(
        "incident_id", F.col("p.error_count").alias("error_count"), F.concat_ws("|", "p.error_codes").alias("error_codes"),
        F.concat_ws("|", "p.affected_fields").alias("affected_fields"))


@register("err_by_field", _oracle("""
SELECT e.field AS field, count(*) AS n FROM validated, unnest(errors) AS t(e) GROUP BY e.field""", VALIDATED_SQL))
def q_err_by_field(spark, sf):
    return V.each_error(V.validate(reports(spark, sf), AS_OF)).groupBy(F.col("e.field").alias("field")).agg(F.count("*").alias("n"))


@register("err_by_code", _oracle("""
SELECT e.error_code AS error_code, count(*) AS n FROM validated, unnest(errors) AS t(e) GROUP BY e.error_code""",
                                 VALIDATED_SQL))
def q_err_by_code(spark, sf):
    return V.each_error(V.validate(reports(spark, sf), AS_OF)).groupBy(F.col("e.error_code").alias("error_code")) \
        .agg(F.count("*").alias("n"))


@register("val_stats", _oracle("""
SELECT count(*) AS total, count_if(len(v.errors) = 0) AS valid, count_if(len(v.errors) > 0) AS invalid,
  round(count_if(len(v.errors) = 0) / count(*), 6) AS pass_rate, coalesce(sum(d.n), 0)::BIGINT AS duplicate_links,
  count(d.n) AS with_duplicates,
  CASE WHEN count_if(len(v.errors) > 0) > 0 THEN 'partial' ELSE 'success' END AS status
FROM validated v LEFT JOIN dups d ON v.arrival_seq = d.arrival_seq""",
    VALIDATED_SQL, ("cand", "SELECT * FROM validated WHERE len(schema_errors) = 0"), DUPS_SQL))
def q_val_stats(spark, sf):
    v = V.with_duplicates(_validated(spark, sf))
    nd = F.size("duplicate_incident_ids")
    return rounded(v.agg(
        F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"),
        (F.count_if("valid") / F.count("*")).alias("pass_rate"),
        F.coalesce(F.sum(F.when(nd > 0, nd)), F.lit(0)).cast("long").alias("duplicate_links"),
        F.count_if(nd > 0).alias("with_duplicates"),
        F.when(F.count_if(~F.col("valid")) > 0, "partial").otherwise("success").alias("status")))


@register("dup_detect", A.with_views("""
SELECT p.incident_id, count(*) AS n_duplicates, array_to_string(list(b.incident_id ORDER BY b.arrival_seq), '|') AS duplicate_ids
FROM incidents p JOIN incidents b ON p.incident_type = b.incident_type AND b.arrival_seq < p.arrival_seq
  AND abs(epoch_us(p.start_datetime) - epoch_us(b.start_datetime)) <= 1800000000
  AND sqrt(pow(abs(p.latitude - b.latitude), 2) + pow(abs(p.longitude - b.longitude), 2)) * 111.0 <= 2.0
GROUP BY p.incident_id"""))
def q_dup_detect(spark, sf):
    inc = A.table(spark, sf, "incidents")
    inc = inc.select("incident_id", "arrival_seq", "incident_type", "start_datetime", "latitude", "longitude")
    d = dup_detect(inc, keep=["incident_id"])
    return d.select("incident_id", F.size("duplicate_incident_ids").cast("long").alias("n_duplicates"),
                    F.concat_ws("|", "duplicate_incident_ids").alias("duplicate_ids"))


@register("dup_stats", A.with_views("""
SELECT p.incident_type, count(*) AS duplicate_pairs, count(DISTINCT p.incident_id) AS reports_with_duplicates,
  30 AS time_window_minutes, 2.0 AS distance_threshold_km
FROM incidents p JOIN incidents b ON p.incident_type = b.incident_type AND b.arrival_seq < p.arrival_seq
  AND abs(epoch_us(p.start_datetime) - epoch_us(b.start_datetime)) <= 1800000000
  AND sqrt(pow(abs(p.latitude - b.latitude), 2) + pow(abs(p.longitude - b.longitude), 2)) * 111.0 <= 2.0
GROUP BY p.incident_type"""))
def q_dup_stats(spark, sf):
    from roadlens.operators.dedup import duplicate_pairs
    pairs = duplicate_pairs(A.table(spark, sf, "incidents"))
    return pairs.groupBy(F.col("typ").alias("incident_type")).agg(
        F.count("*").alias("duplicate_pairs"), F.count_distinct("id").alias("reports_with_duplicates"),
        F.lit(C.DUP_WINDOW_MINUTES).alias("time_window_minutes"), F.lit(C.DUP_DISTANCE_KM).alias("distance_threshold_km"))
