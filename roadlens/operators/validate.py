"""Report validation as column expressions: one pass, no shuffle, no Python.

Errors are ``array<struct<field,message,error_code,value>>``.  Field rules run
first; the cross-field (ongoing/end) rules only when every field rule passed,
and the business rules only when the whole schema passed (short circuit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens import config as C

ERROR_TYPE = "array<struct<field:string,message:string,error_code:string,value:string>>"


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def _err(field: str | Column, message: str | Column, code: str, value: Column | str | None = None) -> Column:
    f = F.lit(field) if isinstance(field, str) else field
    m = F.lit(message) if isinstance(message, str) else message
    v = F.lit(value) if isinstance(value, str) else (value if value is not None else F.lit(None))
    return F.struct(f.alias("field"), m.alias("message"), F.lit(code).alias("error_code"),
                    v.cast("string").alias("value"))


def _rule(cond: Column, err: Column) -> Column:
    return F.when(cond, err)


def _errors(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda e: e.isNotNull()).cast(ERROR_TYPE)


def _value_error(field: str, msg: str) -> Column:
    return _err(field, C.MSG_VALUE_ERROR_PREFIX + msg, C.CODE_VALUE_ERROR, msg[:C.CUSTOM_VALUE_CHARS])


def _num(name: str, c: Column, ge=None, le=None) -> list[Column]:
    out = []
    if ge is not None:
        out.append(_rule(c < F.lit(ge), _err(name, C.MSG_GE.format(ge), C.CODE_GE)))
    if le is not None:
        out.append(_rule(c > F.lit(le), _err(name, C.MSG_LE.format(le), C.CODE_LE)))
    return out


def field_errors(df: DataFrame, as_of: str) -> Column:
    """val_schema field rules + the per-field temporal rules, in field order."""
    lat, lon = _col(df, "latitude"), _col(df, "longitude")
    ts, desc = _col(df, "start_datetime"), _col(df, "description")
    itype, end = _col(df, "incident_type"), _col(df, "end_datetime")
    now = F.lit(as_of).cast(ts_type(df, "start_datetime"))
    ts_ok = ts.isNotNull() & (ts <= now)
    rules: list[Column] = [
        _rule(lat.isNull(), _err("location.latitude", C.MSG_REQUIRED, C.CODE_MISSING)),
        *_num("location.latitude", lat, -90, 90),
        _rule(lon.isNull(), _err("location.longitude", C.MSG_REQUIRED, C.CODE_MISSING)),
        *_num("location.longitude", lon, -180, 180),
        _rule(ts.isNull(), _err("timestamp", C.MSG_REQUIRED, C.CODE_MISSING)),
        _rule(ts > now, _value_error("timestamp", C.MSG_TS_FUTURE)),
        _rule(desc.isNull(), _err("description", C.MSG_REQUIRED, C.CODE_MISSING)),
        _rule(F.length(desc) < C.DESC_MIN_CHARS,
              _err("description", C.MSG_STR_SHORT.format(C.DESC_MIN_CHARS), C.CODE_STR_SHORT)),
        _rule(F.length(desc) > C.DESC_MAX_CHARS,
              _err("description", C.MSG_STR_LONG.format(C.DESC_MAX_CHARS), C.CODE_STR_LONG)),
        _rule(itype.isNotNull() & ~itype.isin(*C.INCIDENT_TYPES), _err("incident_type", C.MSG_ENUM, C.CODE_ENUM)),
        *_num("severity_initial", _col(df, "severity_initial"), 0, 100),
        _rule(end.isNotNull() & ts_ok & (end <= ts), _value_error("end_datetime", C.MSG_END_BEFORE)),
        _rule(end.isNotNull() & ~(ts_ok & (end <= ts)) & (end > now),
              _value_error("end_datetime", C.MSG_END_FUTURE)),
        *_num("weather.precipitation", _col(df, "precipitation"), ge=0),
        *_num("weather.wind_speed", _col(df, "wind_speed"), ge=0),
        *_num("weather.humidity", _col(df, "humidity"), 0, 100),
        *_num("weather.visibility", _col(df, "visibility"), ge=0),
        *_num("num_lanes_blocked", _col(df, "num_lanes_blocked"), ge=0),
        *_num("num_vehicles", _col(df, "num_vehicles"), ge=0),
    ]
    return _errors(*rules)


def ts_type(df: DataFrame, name: str) -> str:
    if name in df.columns:
        return df.schema[name].dataType.simpleString()
    return "timestamp"


def consistency_errors(df: DataFrame) -> Column:
    """Cross-field rules (model level); the field is empty like a model-level error."""
    end = _col(df, "end_datetime")
    ongoing = F.coalesce(_col(df, "is_ongoing").cast("boolean"), F.lit(True))
    return _errors(
        _rule(end.isNotNull() & ongoing, _value_error("", C.MSG_ONGOING_WITH_END)),
        _rule(end.isNull() & ~ongoing, _value_error("", C.MSG_END_REQUIRED)),
    )


def stripped(desc: Column) -> Column:
    return F.btrim(desc, F.lit(C.PY_WS_CHARS))


#: Two groups of letters that take under half of ordinary text each, and leave under half to all other characters.
LETTER_GROUPS = ("[eaiouy]+", "[tnshrdl]+")


def _without(low: Column, group: str) -> Column:
    return F.regexp_replace(low, group, "")


def _rate(s: Column, low: Column, left: Column, others: Column) -> Column:
    """``repeat_rate`` from the text, its lower case, that without the first group of letters and without both."""
    most = F.greatest(F.length(low) - F.length(left), F.length(left) - F.length(others), F.length(others))
    chars = F.sort_array(F.array_remove(F.array_remove(F.split(low, ""), " "), ""))
    middle = F.element_at(chars, (F.floor(F.size(chars) / 2) + 1).cast("int"))
    rate = F.when(F.size(chars) > 0, (F.length(low) - F.length(F.replace(low, middle, F.lit("")))) / F.length(s))
    return F.when(F.length(s) > 0, F.when(2 * most > F.length(s), rate).otherwise(F.lit(0.0)))


def repeat_rate(s: Column) -> Column:
    """Share of the stripped text ``s`` taken by its most frequent non-space character (lower case) wherever that is over one
    half; else a value of at most one half.

    A character above half of all non-space characters is the median of their sorted array.  Only texts are sorted in
    which some group of characters takes over half, as else no character can.
    """
    low = F.lower(s)
    left = _without(low, LETTER_GROUPS[0])
    return _rate(s, low, left, _without(left, LETTER_GROUPS[1]))


#: White space other than a space.  The range in front decides for most characters, as a class of many parts is slow.
RARE_WS = rf"[\x{{09}}-\x{{1F}}\x{{85}}-\x{{3000}}&&{C.PY_WS}]"


def plain_gaps(s: Column) -> Column:
    """The text with a space for every other white space; ``\\n`` first, which leaves nothing to look for in most texts."""
    t = F.replace(s, F.lit("\n"), F.lit(" "))
    return F.when(t.rlike("[^ -~]"), F.regexp_replace(t, RARE_WS, " ")).otherwise(t)


def word_count(s: Column) -> Column:
    """Words of a stripped text."""
    return F.length(F.regexp_replace(plain_gaps(s), "[^ ]+ *", "w"))


def with_text_stats(df: DataFrame, desc: str = "description", only_if: Column | None = None) -> DataFrame:
    """Adds _desc_s (stripped), _desc_rate (share of a character over one half, see ``repeat_rate``) and _desc_words, by built-in
    functions over whole texts.  What several expressions read is a column of its own, so it is computed once a row."""
    src = F.col(desc) if only_if is None else F.when(only_if, F.col(desc))
    out = df.withColumn("_desc_s", stripped(src)).withColumn("_desc_low", F.lower("_desc_s"))
    out = out.withColumn("_desc_left", _without(F.col("_desc_low"), LETTER_GROUPS[0]))
    out = out.withColumn("_desc_others", _without(F.col("_desc_left"), LETTER_GROUPS[1]))
    rate = _rate(*[F.col(f"_desc_{c}") for c in ("s", "low", "left", "others")])
    return out.withColumns({"_desc_rate": rate, "_desc_words": word_count(F.col("_desc_s"))}).drop("_desc_low", "_desc_left", "_desc_others")


def area_error(lat: Column, lon: Column, area: dict | None = None) -> Column:
    a = area or C.SERVICE_AREA
    inside = lat.between(a["lat_min"], a["lat_max"]) & lon.between(a["lon_min"], a["lon_max"])
    pair = F.concat(F.lit("("), lat.cast("string"), F.lit(", "), lon.cast("string"), F.lit(")"))
    msg = F.concat(F.lit("Location "), pair, F.lit(" is outside service area"))
    return _rule(~inside, _err("location", msg, C.CODE_AREA, pair))


def noise_error_from(rate: Column, s: Column) -> Column:
    return _rule(rate > C.DESC_REPEAT_RATE,
                 _err("description", C.MSG_NOISE, C.CODE_NOISE, F.substring(s, 1, C.DESC_VALUE_CHARS)))


def words_error_from(words: Column, s: Column) -> Column:
    return _rule(words < C.DESC_MIN_WORDS,
                 _err("description", C.MSG_WORDS, C.CODE_WORDS, F.substring(s, 1, C.DESC_VALUE_CHARS)))


def noise_error(desc: Column) -> Column:
    return noise_error_from(repeat_rate(desc), stripped(desc))


def words_error(desc: Column) -> Column:
    return words_error_from(word_count(desc), stripped(desc))


def business_errors(df: DataFrame, area: dict | None = None) -> Column:
    """Needs the columns of ``with_text_stats``."""
    s = F.col("_desc_s")
    return _errors(area_error(_col(df, "latitude"), _col(df, "longitude"), area),
                   noise_error_from(F.col("_desc_rate"), s), words_error_from(F.col("_desc_words"), s))


def with_schema_errors(df: DataFrame, as_of: str) -> DataFrame:
    """val_schema + val_temporal: ``schema_errors`` and ``schema_ok``."""
    fe = field_errors(df, as_of)
    out = df.withColumn("_field_errors", fe)
    out = out.withColumn(
        "schema_errors",
        F.when(F.size("_field_errors") > 0, F.col("_field_errors")).otherwise(consistency_errors(out)))
    return out.drop("_field_errors").withColumn("schema_ok", F.size("schema_errors") == 0)


def validate(df: DataFrame, as_of: str, area: dict | None = None) -> DataFrame:
    """val_combined without duplicates: ``errors``, ``valid``, ``schema_ok``."""
    out = with_schema_errors(df, as_of)
    out = with_text_stats(out, only_if=F.col("schema_ok"))
    out = out.withColumn(
        "errors",
        F.when(F.col("schema_ok"), business_errors(out, area)).otherwise(F.col("schema_errors")))
    return out.withColumn("valid", F.size("errors") == 0).drop("_desc_s", "_desc_rate", "_desc_words")


def validate_with_duplicates(df: DataFrame, as_of: str, window_minutes: float = C.DUP_WINDOW_MINUTES,
                             km: float = C.DUP_DISTANCE_KM, area: dict | None = None) -> DataFrame:
    """val_combined: validation plus the ids of earlier schema-valid reports that look like the same incident."""
    return with_duplicates(validate(df, as_of, area), window_minutes, km)


def with_duplicates(v: DataFrame, window_minutes: float = C.DUP_WINDOW_MINUTES, km: float = C.DUP_DISTANCE_KM) -> DataFrame:
    """``validate_with_duplicates`` of reports that ``validate`` has seen; reads ``v`` more than once."""
    from roadlens.operators.dedup import MATCHES, with_matches

    found = with_matches(v.filter("schema_ok"), window_minutes, km)
    found = found.withColumn(MATCHES, F.coalesce(MATCHES, F.array().cast("array<string>")))
    rest = v.filter(~F.coalesce(F.col("schema_ok"), F.lit(False))).withColumn(MATCHES, F.lit(None).cast("array<string>"))
    return found.unionByName(rest).select("arrival_seq", *[c for c in v.columns if c != "arrival_seq"], MATCHES)


def each_error(v: DataFrame, *keep: str) -> DataFrame:
    """One row per error ``e``.  A filter on what is exploded would be pushed below the validation, which would then run twice, so
    rows without errors go after it."""
    return v.select(*keep, F.explode_outer("errors").alias("e")).filter(F.col("e").isNotNull())


def failing(v: DataFrame) -> DataFrame:
    """The reports with errors; as in ``each_error``, the rules run once a report."""
    some = F.explode_outer(F.when(F.size("errors") > 0, F.array(F.lit(True))))
    return v.withColumn("_some", some).filter(F.col("_some").isNotNull()).drop("_some")


def ingest_gate(df: DataFrame, min_chars: int = C.DESC_MIN_CHARS) -> DataFrame:
    """val_ingest: door check before queueing (description length, coordinate bounds)."""
    return df.filter((F.length("description") >= min_chars)
                     & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))


def error_value(code: Column, message: Column, value: Column) -> Column:
    """val_error_value: what is stored beside an error (already carried in the struct)."""
    return F.when(code == C.CODE_VALUE_ERROR, F.substring(F.regexp_replace(message, "^Value error, ", ""), 1,
                                                           C.CUSTOM_VALUE_CHARS)).otherwise(value)


def summary_message(errors: Column) -> Column:
    """err_messages summary line: pass / single error / per-code counts in first-seen order."""
    n = F.size(errors)
    codes = F.transform(errors, lambda e: e["error_code"])
    distinct = F.array_distinct(codes)
    counted = F.transform(distinct, lambda c: F.concat(c, F.lit(" ("), F.size(F.filter(codes, lambda x: x == c)).cast("string"), F.lit(")")))
    return (F.when(n == 0, F.lit("Validation passed"))
            .when(n == 1, F.concat(F.lit("Validation failed: "), errors[0]["field"], F.lit(" - "), errors[0]["message"]))
            .otherwise(F.concat(F.lit("Validation failed with "), n.cast("string"), F.lit(" error(s): "),
                                F.concat_ws(", ", counted))))


def detailed_message(errors: Column) -> Column:
    """err_messages multi-line detail."""
    n = F.size(errors)
    lines = F.transform(errors, lambda e, i: F.concat(
        F.lit("  "), (i + 1).cast("string"), F.lit(". ["), e["field"], F.lit("] "), e["message"],
        F.when(F.coalesce(e["value"], F.lit("")) != "", F.concat(F.lit(" (value: "), e["value"], F.lit(")"))).otherwise(F.lit(""))))
    return F.when(n == 0, F.lit("No errors")).otherwise(
        F.concat_ws("\n", F.concat(F.lit("Validation failed with "), n.cast("string"), F.lit(" error(s):")), lines))


def affected_fields(errors: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(errors, lambda e: e["field"])))


def error_codes(errors: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(errors, lambda e: e["error_code"])))


def api_payload(errors: Column) -> Column:
    """err_payload_api as JSON text."""
    return F.to_json(F.struct(
        F.lit("validation_error").alias("error"), summary_message(errors).alias("message"),
        F.transform(errors, lambda e: F.struct(e["field"].alias("field"), e["message"].alias("message"),
                                                e["error_code"].alias("code"))).alias("details"),
        F.size(errors).alias("error_count"), affected_fields(errors).alias("affected_fields")))


def log_payload(errors: Column, incident_id: Column) -> Column:
    """err_payload_log as JSON text."""
    return F.to_json(F.struct(
        F.lit("validation_failed").alias("event"), incident_id.alias("incident_id"),
        F.size(errors).alias("error_count"),
        F.transform(errors, lambda e: F.struct(e["field"].alias("field"), e["error_code"].alias("code"),
                                                e["message"].alias("message"))).alias("errors"),
        affected_fields(errors).alias("affected_fields"), error_codes(errors).alias("error_codes")))
