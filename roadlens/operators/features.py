"""Row-local feature derivations: pure column expressions (whole-stage codegen, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens import config as C

# Cause / vehicle / corridor sets used by the structured features and proxies.
EVENT_CAUSES = ["public_event", "procession", "protest", "vip_movement", "planned"]
HEAVY_VEHICLES = ["heavy_vehicle", "truck", "bmtc_bus", "ksrtc_bus"]
LIGHT_VEHICLES = ["lcv", "private_bus"]
MAJOR_CORRIDOR_PATTERN = "orr|cbd|tumkur"
PRIORITY_CODES = {"high": 2, "medium": 1, "low": 0}
# Severity proxy v1 cause points (default 5).
PROXY_V1_CAUSE_POINTS = {"accident": 20, "tree_fall": 15, "water_logging": 15, "vehicle_breakdown": 10,
                         "pot_holes": 5, "congestion": 15}
PROXY_V1_DEFAULT_POINTS = 5
# Severity proxy v2 cause set.
PROXY_V2_CAUSES = ["political_rally", "water_logging", "construction", "accident"]
# Survival covariate codes (unknown type -> 4.0, unknown priority -> 0.0).
SURVIVAL_TYPE_CODES = {"accident": 0.0, "congestion": 1.0, "road_closure": 2.0, "hazard": 3.0, "event": 4.0}
SURVIVAL_PRIORITY_CODES = {"high": 2.0, "medium": 1.0, "low": 0.0}
SURVIVAL_TYPE_DEFAULT = 4.0
SURVIVAL_PRIORITY_DEFAULT = 0.0


def map_lookup(mapping: dict, key: Column, default=None) -> Column:
    """Small fixed dictionary lookup as a map literal (constant-folded by Catalyst)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    v = F.element_at(m, key) if default is None else F.coalesce(F.element_at(m, key), F.lit(default))
    return F.when(key.isNotNull(), v) if default is None else F.coalesce(F.when(key.isNotNull(), v), F.lit(default))


def grid_columns(lat: Column, lon: Column) -> dict[str, Column]:
    gx = F.floor((lon + F.lit(180.0)) / F.lit(C.GRID_STEP_DEG)).cast("long")
    gy = F.floor((lat + F.lit(90.0)) / F.lit(C.GRID_STEP_DEG)).cast("long")
    dist = F.abs(F.pmod(gx, F.lit(10)) - 5) * 0.5 + F.abs(F.pmod(gy, F.lit(10)) - 5) * 0.5
    return {
        "grid_x": gx, "grid_y": gy,
        "distance_to_highway": F.least(dist.cast("double"), F.lit(C.HIGHWAY_DISTANCE_CAP_KM)),
        "location_grid_cell": F.format_string("cell_%d_%d", F.floor(gx / 10), F.floor(gy / 10)),
    }


def derive_grid(df: DataFrame, lat="latitude", lon="longitude") -> DataFrame:
    return df.withColumns(grid_columns(F.col(lat), F.col(lon)))


def time_bin(hour: Column) -> Column:
    expr = None
    for name, lo, hi in C.TIME_BINS:
        cond = (hour >= lo) & (hour < hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(C.TIME_BIN_OTHER))


def rush_hour(hour: Column) -> Column:
    out = F.lit(False)
    for lo, hi in C.RUSH_HOURS:
        out = out | ((hour >= lo) & (hour < hi))
    return out


def weekday_name(ts: Column) -> Column:
    names = F.array(*[F.lit(d) for d in C.WEEKDAYS])
    return F.element_at(names, F.weekday(ts) + 1)


def derive_time(df: DataFrame, ts="start_datetime") -> DataFrame:
    h = F.hour(F.col(ts))
    return df.withColumns({"hour_of_day": h, "day_of_week": weekday_name(F.col(ts)),
                           "is_rush_hour": rush_hour(h), "time_of_day_bins": time_bin(h)})


def weather_category(temp: Column) -> Column:
    expr = F.when(temp.isNull(), F.lit("unknown"))
    for name, upper in C.WEATHER_CATEGORIES:
        expr = expr.when(temp < upper, F.lit(name))
    return expr.otherwise(F.lit(C.WEATHER_TOP))


def derive_weather_category(df: DataFrame, temp="temperature", weather_struct: str | None = None) -> DataFrame:
    """Category from temperature; weather struct fields are flattened without overwriting columns."""
    out = df
    if weather_struct and weather_struct in df.columns:
        for f in df.schema[weather_struct].dataType.fieldNames():
            if f not in out.columns:
                out = out.withColumn(f, F.col(f"{weather_struct}.{f}"))
    return out.withColumn("weather_category", weather_category(F.col(temp)))


def severity_bucket(score: Column) -> Column:
    return (F.when(score >= C.SEVERITY_HIGH, F.lit("high"))
            .when(score >= C.SEVERITY_MEDIUM, F.lit("medium")).otherwise(F.lit("low")))


def severity_colour(score: Column) -> Column:
    # Display colours of the buckets.
    return (F.when(score >= C.SEVERITY_HIGH, F.lit("red"))
            .when(score >= C.SEVERITY_MEDIUM, F.lit("orange")).otherwise(F.lit("green")))


def coalesce_location(meta_lat: Column, loc_lat: Column, default: float) -> Column:
    """Metadata value unless null or zero (falsy), else the location value, else the default."""
    return F.coalesce(F.nullif(meta_lat, F.lit(0.0)), loc_lat, F.lit(default))


def _lower_str(c: Column, when_null: str) -> Column:
    return F.coalesce(F.lower(c.cast("string")), F.lit(when_null))


def structured_features(df: DataFrame, lat="latitude", lon="longitude", priority="priority",
                        cause="event_cause", veh="veh_type", corridor="corridor",
                        fallback_cause="incident_type") -> DataFrame:
    """The 8 numeric model inputs."""
    pr = _lower_str(F.col(priority), "medium")
    c = F.lower(F.coalesce(F.col(cause), F.col(fallback_cause), F.lit("")))
    v = _lower_str(F.col(veh), "")
    cor = _lower_str(F.col(corridor), "")
    return df.withColumns({
        "f_lat": F.col(lat).cast("double"), "f_lon": F.col(lon).cast("double"),
        "priority_numeric": map_lookup(PRIORITY_CODES, pr, 0).cast("double"),
        "is_construction": (c == "construction").cast("double"),
        "is_event": c.isin(*EVENT_CAUSES).cast("double"),
        "is_heavy_vehicle": v.isin(*HEAVY_VEHICLES).cast("double"),
        "is_lcv": v.isin(*LIGHT_VEHICLES).cast("double"),
        "is_major_corridor": cor.rlike(MAJOR_CORRIDOR_PATTERN).cast("double"),
    })


STRUCTURED_COLUMNS = ["f_lat", "f_lon", "priority_numeric", "is_construction", "is_event",
                      "is_heavy_vehicle", "is_lcv", "is_major_corridor"]


def severity_proxy_v1(priority: Column, closure: Column, cause: Column) -> Column:
    s = (F.coalesce(F.lower(priority) == "high", F.lit(False)).cast("int") * 40
         + F.coalesce(closure.cast("boolean"), F.lit(False)).cast("int") * 30
         + map_lookup(PROXY_V1_CAUSE_POINTS, cause, PROXY_V1_DEFAULT_POINTS))
    return F.least(F.greatest(s.cast("double"), F.lit(0.0)), F.lit(100.0))


def severity_proxy_v2(priority: Column, closure: Column, veh: Column, corridor: Column, cause: Column,
                      duration_min: Column) -> Column:
    # a missing text becomes the string "nan" before matching, so null never matches
    v = _lower_str(veh, "nan")
    s = (F.coalesce(F.lower(priority) == "high", F.lit(False)).cast("int") * 40
         + F.coalesce(closure.cast("boolean"), F.lit(False)).cast("int") * 30
         + v.isin(*HEAVY_VEHICLES).cast("int") * 20
         + v.isin(*LIGHT_VEHICLES).cast("int") * 10
         + F.coalesce(F.lower(corridor).rlike(MAJOR_CORRIDOR_PATTERN), F.lit(False)).cast("int") * 10
         + _lower_str(cause, "nan").isin(*PROXY_V2_CAUSES).cast("int") * 15
         + F.coalesce(duration_min > 120, F.lit(False)).cast("int") * 10)
    return F.least(F.greatest(s.cast("double"), F.lit(0.0)), F.lit(100.0))


def end_time_coalesce(df: DataFrame, start="start_datetime", end="end_datetime", resolved="resolved_datetime",
                      closed="closed_datetime") -> DataFrame:
    cols = [F.col(c) for c in (end, resolved, closed) if c in df.columns]
    e = F.coalesce(*cols) if len(cols) > 1 else cols[0]
    dur = (F.unix_micros(e.cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / F.lit(60e6)
    return df.withColumns({"end_effective": e, "duration_minutes": dur, "is_censored": dur.isNull()})


def fill_text_defaults(df: DataFrame) -> DataFrame:
    return df.fillna({"event_cause": "unknown", "description": ""})


def survival_covariates(df: DataFrame, cause="event_cause", priority="priority", ts="start_datetime") -> DataFrame:
    return df.withColumns({
        "cov_type": map_lookup(SURVIVAL_TYPE_CODES, F.lower(F.col(cause)), SURVIVAL_TYPE_DEFAULT),
        "cov_priority": map_lookup(SURVIVAL_PRIORITY_CODES, F.lower(F.col(priority)), SURVIVAL_PRIORITY_DEFAULT),
        "cov_hour": F.hour(F.col(ts)).cast("double"),
    })


# Types a source cause keeps when normalising (anything else becomes "event").
NORMALIZE_TYPES = ["accident", "congestion", "road_closure", "hazard", "event"]


def normalize_report(df: DataFrame, cause="event_cause", description="description", address="address",
                     min_chars: int = C.DESC_MIN_CHARS) -> DataFrame:
    """Source row -> incident: cause kept as type if in the set, else "event"; empty or "NULL"
    description becomes "Reported {cause} at {address}."; short text gets " (padded desc)"."""
    c = F.col(cause)
    itype = F.when(c.isin(*NORMALIZE_TYPES), c).otherwise(F.lit("event"))
    d = F.col(description)
    blank = d.isNull() | (d == "") | (d == "NULL")
    addr = F.col(address) if address in df.columns else F.lit(None)
    rebuilt = F.concat(F.lit("Reported "), F.coalesce(c.cast("string"), F.lit("unknown")), F.lit(" at "),
                       F.coalesce(addr, F.lit("unknown location")), F.lit("."))
    text = F.when(blank, rebuilt).otherwise(d)
    padded = F.when(F.length(text) < min_chars, F.concat(text, F.lit(" (padded desc)"))).otherwise(text)
    return df.withColumns({"incident_type_norm": itype, "description_norm": padded})
