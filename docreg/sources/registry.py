"""Registry tables, captured-field JSON, exports and the append-only audit sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreg import schemas
from docreg.functions import values as V

# --- fixed values -----------------------------------------------------------
REPORT_HEADER = (
    "Record ID", "Registry number", "Document type", "Status", "Primary value", "Created at",
    "Created by", "Submitted at", "Submitted by", "OCR model", "Fields", "Average confidence",
)
PREDICTION_HEADER = ("FILENAME", "PREDICTION", "CONFIDENCE")
# ----------------------------------------------------------------------------


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the declared schema; columns the source lacks become NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def read_registry(spark: SparkSession, root: str, fmt: str = "parquet", **options: str) -> dict[str, DataFrame]:
    """Every registry table below ``root`` (one folder or file per table), typed."""
    return {
        name: conform(spark.read.format(fmt).options(**options).load(f"{root}/{name}"), schema)
        for name, schema in schemas.TABLES.items()
    }


def read_registry_jdbc(spark: SparkSession, url: str, partition_rows: dict[str, tuple[int, int, int]] | None = None,
                       **options: str) -> dict[str, DataFrame]:
    """The same tables over JDBC; ``partition_rows`` gives (lower, upper, partitions) of id per table."""
    tables = {}
    for name, schema in schemas.TABLES.items():
        reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
        if partition_rows and name in partition_rows:
            low, high, n = partition_rows[name]
            reader = reader.options(partitionColumn="id", lowerBound=low, upperBound=high, numPartitions=n)
        tables[name] = conform(reader.load(), schema)
    return tables


def explode_fields_json(df: DataFrame, column: str = "fields_json",
                        schema: T.StructType = schemas.CAPTURED_FIELD) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): a JSON list of fields becomes one row per field.

    ``sort_order`` is the position in the list. Text that is not JSON, or JSON that
    is not a list, goes to ``rejected`` with the reason.
    """
    text = F.trim(F.col(column))
    probe = F.try_parse_json(text)
    kind = F.schema_of_variant(probe)
    reason = (
        F.when(text.isNull() | (text == ""), F.lit("the fields are missing"))
        .when(probe.isNull(), F.lit("the fields could not be read"))
        .when(~kind.startswith("ARRAY"), F.lit("the fields must be a list"))
    )
    flagged = df.withColumn("_reason", reason)
    good = flagged.where(F.col("_reason").isNull())
    rows = good.select(
        *[c for c in df.columns if c != column],
        F.posexplode(F.from_json(text, T.ArrayType(schema))).alias("sort_order", "_f"),
    ).select("*", "_f.*").drop("_f")
    rejected = flagged.where(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
    return rows, rejected


def export_report_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write report rows (see ``reports.report_rows``) with the export header."""
    rows.toDF(*REPORT_HEADER).write.mode(mode).csv(path, header=True, escape='"')


def prediction_rows(predictions: DataFrame) -> DataFrame:
    """(FILENAME, PREDICTION, CONFIDENCE); a failed row shows its error and no confidence."""
    failed = F.col("error").isNotNull()
    return predictions.select(
        F.col("filename").alias("FILENAME"),
        F.when(failed, F.concat(F.lit("ERROR: "), "error")).otherwise(F.col("text")).alias("PREDICTION"),
        F.when(failed, F.lit("")).otherwise(F.format_string("%.1f", F.col("confidence"))).alias("CONFIDENCE"),
    )


def write_predictions_csv(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    prediction_rows(predictions).write.mode(mode).csv(path, header=True, escape='"', emptyValue="")


def audit_projection(rows: DataFrame) -> DataFrame:
    """Redact secrets and store the open maps as JSON. Works on batch and streaming frames."""
    return rows.withColumns({
        "old_values": F.to_json(V.redact(F.col("old_values"))),
        "new_values": F.to_json(V.redact(F.col("new_values"))),
        "user_agent": F.coalesce(F.col("user_agent"), F.lit("")),
    })


def append_audit(rows: DataFrame, path: str) -> None:
    """Append-only: the trail is never rewritten."""
    audit_projection(rows).write.mode("append").parquet(path)
