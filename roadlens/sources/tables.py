"""Typed tables of the incident data model: declared columns, types and checks, written by day and read back typed.

A table's rows are cast to its declared types; a row that loses a value by the cast, lacks a required value or breaks a check
goes to the table's reject folder with the names of the broken rules, the others to the table.  Both are plain Parquet folders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    name: str
    schema: str
    required: tuple[str, ...]
    checks: tuple[tuple[str, str], ...] = ()
    day: str | None = None  # the timestamp that the table is partitioned by

    def fields(self) -> list[T.StructField]:
        return list(T.StructType.fromDDL(self.schema).fields)


# Names, types, required columns and checks of the data model.
STATUS = "status in ('pending', 'processing', 'completed', 'failed')"
TABLES = {t.name: t for t in (
    Table("incidents", """incident_id string, location_latitude decimal(10,8), location_longitude decimal(11,8), timestamp timestamp,
          start_datetime timestamp, end_datetime timestamp, description string, incident_type string, severity_initial decimal(5,2),
          status string, is_ongoing boolean, data_source string""",
          ("incident_id", "location_latitude", "location_longitude", "timestamp", "start_datetime", "description", "incident_type"),
          (("valid_location", "location_latitude between -90 and 90 and location_longitude between -180 and 180"), ("status", STATUS)),
          "start_datetime"),
    Table("predictions", """prediction_id string, incident_id string, severity_score decimal(5,2), severity_confidence_lower decimal(5,2),
          severity_confidence_upper decimal(5,2), duration_estimate_minutes decimal(8,2), latency_total_ms decimal(8,2), status string,
          created_at timestamp, module_a_model_version string, is_fallback boolean""",
          ("prediction_id", "incident_id"), (("status", STATUS),), "created_at"),
    Table("playbook_recommendations", """playbook_id string, prediction_id string, incident_id string, incident_summary string,
          driver_alert string, created_at timestamp""", ("playbook_id", "prediction_id", "incident_id"), (), "created_at"),
    Table("models", """model_name string, version string, status string, training_samples int, validation_rmse decimal(10,4),
          validation_mae decimal(10,4), validation_r2_score decimal(5,4)""", ("model_name", "version"),
          (("status", "status in ('active', 'archived', 'testing', 'deprecated')"),)),
    Table("audit_log", """entry_id bigint, incident_id string, operation string, status string, created_at timestamp""",
          ("entry_id", "operation", "created_at"), (), "created_at"),
)}


def broken_rules(table: Table):
    """The names of the rules that a row breaks, in the order of columns, then checks; ``_raw`` holds its values as texts."""
    rules = []
    for f in table.fields():
        lost = F.col(f"_raw.{f.name}").isNotNull() & F.col(f.name).isNull()
        rules.append(F.when(lost, F.lit(f"type:{f.name}")))
        if f.name in table.required:
            rules.append(F.when(F.col(f"_raw.{f.name}").isNull(), F.lit(f"required:{f.name}")))
    rules += [F.when(~F.coalesce(F.expr(sql), F.lit(True)), F.lit(f"check:{name}")) for name, sql in table.checks]
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def write_table(df: DataFrame, table: Table, path: str) -> None:
    """Write the rows to <path>/<name>, typed, and the others to <path>/<name>_rejected, as texts with ``broken``; columns
    that ``df`` lacks are null."""
    fields = table.fields()
    texts = F.struct(*[(F.col(f.name).cast("string") if f.name in df.columns else F.lit(None).cast("string")).alias(f.name) for f in fields])
    typed = df.select(texts.alias("_raw")).select("_raw", *[F.col(f"_raw.{f.name}").try_cast(f.dataType).alias(f.name) for f in fields])
    judged = typed.withColumn("broken", broken_rules(table))
    good = judged.filter(F.size("broken") == 0).select(*[f.name for f in fields])
    if table.day:
        good = good.withColumn("day", F.to_date(table.day))
    writer = good.write.mode("overwrite")
    (writer.partitionBy("day") if table.day else writer).parquet(f"{path}/{table.name}")
    judged.filter(F.size("broken") > 0).select(F.col("_raw").alias("row"), "broken").write.mode("overwrite").parquet(f"{path}/{table.name}_rejected")


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A typed table as declared (a filter on ``day`` reads only those days)."""
    table = TABLES[name]
    schema = T.StructType([*table.fields(), *([T.StructField("day", T.DateType())] if table.day else [])])
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def read_rejected(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}_rejected")
