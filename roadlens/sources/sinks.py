"""Sinks: audit JSON lines, feedback CSV, audit export, GeoJSON, splits, feature store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions.scalars import redact_details


def write_audit_jsonl(df: DataFrame, path: str) -> None:
    """Append redacted audit rows, one JSON object per line."""
    df.withColumn("details", redact_details(F.col("details"))).write.mode("append").json(path)


def write_feedback(df: DataFrame, path: str) -> None:
    """Append operator feedback as CSV with a header line per file."""
    df.select("ts", "incident_id", "approval", "manpower", "barricading").write.mode("append") \
        .option("header", True).csv(path)


def export_audit(df: DataFrame, fmt: str, path: str) -> None:
    """Write the entries: JSON, one object a line, or CSV with a header and details as JSON where ',' -> ';'."""
    if fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif fmt == "csv":
        det = F.regexp_replace(F.to_json(F.col("details")), ",", ";")
        df.withColumn("details", det).write.mode("overwrite").options(
            header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        raise ValueError(f"unsupported export format: {fmt}")


def forecast_features(points: DataFrame, group: str, min_value: float = 5.0) -> DataFrame:
    """Node forecasts worth showing: (group, lon, lat, node_id, weight = value / 100), values below min_value dropped."""
    return points.filter(F.col("value") >= min_value).select(
        group, "lon", "lat", "node_id", (F.col("value") / 100.0).alias("weight"))


def write_geojson(features: DataFrame, group: str, path: str) -> None:
    """GeoJSON features, one a line, a folder per group: a group of any size is many rows and files."""
    features.select(
        group, F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct("weight", "node_id").alias("properties"),
    ).write.mode("overwrite").partitionBy(group).json(path)


def write_splits(df: DataFrame, path: str) -> DataFrame:
    """Split rows partitioned by split, plus a metadata row per split; returns the metadata."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    meta = df.groupBy("split").agg(F.count("*").alias("samples"))
    meta.write.mode("overwrite").json(f"{path}/metadata")
    return meta


def append_features(df: DataFrame, path: str, version: str, stored_at_col) -> None:
    df.withColumn("dataset_version", F.lit(version)).withColumn("stored_at", stored_at_col) \
        .write.mode("append").partitionBy("dataset_version").parquet(path)


def read_features(spark, path: str) -> DataFrame:
    """Last write wins per (incident, version); of rows stored at one time the largest by its values."""
    df = spark.read.parquet(path)
    key = ["incident_id", "dataset_version"]
    values = [c for c in df.columns if c not in key and c != "stored_at"]
    last = df.groupBy(*key).agg(F.max(F.struct("stored_at", *values)).alias("_v"))
    return last.select(*key, "_v.stored_at", *[F.col(f"_v.{c}").alias(c) for c in values])
