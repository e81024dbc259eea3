"""Readers: historical CSV, submitted JSON, landed RSS XML, typed incident tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Historical CSV columns as used downstream; everything is read as text and coerced.
CSV_COLUMNS = ["latitude", "longitude", "start_datetime", "end_datetime", "resolved_datetime", "closed_datetime",
               "event_cause", "priority", "requires_road_closure", "veh_type", "corridor", "description", "address"]

WEATHER = T.StructType([T.StructField(n, T.DoubleType()) for n in
                        ("temperature", "precipitation", "wind_speed", "humidity", "visibility")])
INCIDENT = T.StructType([
    T.StructField("incident_id", T.StringType()),
    T.StructField("location", T.StructType([T.StructField("latitude", T.DoubleType()),
                                            T.StructField("longitude", T.DoubleType())])),
    T.StructField("timestamp", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("incident_type", T.StringType()),
    T.StructField("severity_initial", T.DoubleType()),
    T.StructField("end_datetime", T.StringType()),
    T.StructField("weather", WEATHER),
    T.StructField("is_ongoing", T.BooleanType()),
    T.StructField("num_lanes_blocked", T.IntegerType()),
    T.StructField("num_vehicles", T.IntegerType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def read_incident_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows whose latitude/longitude parse as numbers; unparsable dates become null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])
    raw = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", multiLine=True, escape='"').csv(path)
    ts = {c: F.try_to_timestamp(F.col(c)) for c in ("start_datetime", "end_datetime", "resolved_datetime",
                                                    "closed_datetime")}
    out = raw.withColumns({"latitude": F.col("latitude").try_cast("double"),
                           "longitude": F.col("longitude").try_cast("double"),
                           "requires_road_closure": F.lower("requires_road_closure").isin("true", "1"), **ts})
    return out.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def parse_incident_json(df: DataFrame, col: str = "payload") -> DataFrame:
    """JSON text -> nested incident struct; rows that do not parse or fit keep their text in ``_corrupt``.

    Read as the only element of an array, a text with anything after its object is no JSON; read as an
    object, the corrupt-record column tells of values that don't fit their type.
    """
    alone = F.size(F.from_json(F.concat(F.lit("["), F.col(col), F.lit("]")), T.ArrayType(INCIDENT))) == 1
    told = T.StructType([*INCIDENT.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(F.col(col), told, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = df.withColumn("_p", parsed).withColumn("_ok", F.coalesce(alone & F.col("_p._bad").isNull(), F.lit(False)))
    fields = F.struct(*[F.col(f"_p.{f.name}").alias(f.name) for f in INCIDENT.fields])
    return out.withColumn("incident", F.when(F.col("_ok"), fields)).withColumn(
        "_corrupt", F.when(~F.col("_ok"), F.col(col))).drop("_p", "_ok")


def read_news_xml(spark: SparkSession, path: str) -> DataFrame:
    """RSS <item> rows with defaults "No Title", "Unknown Date", "Bing News"."""
    x = spark.read.format("xml").option("rowTag", "item").load(path)
    src = F.col("source")
    if "source" in x.columns and isinstance(x.schema["source"].dataType, T.StructType):
        src = F.col("source._VALUE")
    return x.select(F.coalesce(F.col("title").cast("string"), F.lit("No Title")).alias("title"),
                    F.coalesce(F.col("pubDate").cast("string"), F.lit("Unknown Date")).alias("pub_date"),
                    F.coalesce(src.cast("string") if "source" in x.columns else F.lit(None), F.lit("Bing News"))
                    .alias("source"))


def rfc822_age_days(pub_date, as_of: str):
    """'Tue, 02 Jan 2024 10:00:00 GMT' -> age in days at as_of (weekday stripped before parsing)."""
    core = F.regexp_replace(pub_date, r"^[A-Za-z]{3},\s*", "")
    ts = F.try_to_timestamp(core, F.lit("d MMM yyyy HH:mm:ss z"))
    return F.datediff(F.lit(as_of).cast("timestamp"), ts)
