"""The registry report: summary row and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.functions import values as V
from docreg.operators.joins import enrich_records


def title_expr() -> Column:
    """First filled value by sort order, as an aggregate."""
    position = F.struct("sort_order", "id")
    return F.min_by("verified_value", F.when(V.is_filled(F.col("verified_value")), position))


def record_title(fields: DataFrame) -> DataFrame:
    return fields.groupBy("record_id").agg(F.coalesce(title_expr(), F.lit(V.UNTITLED)).alias("title"))


def report_summary(matching: DataFrame, fields: DataFrame) -> DataFrame:
    """Totals and mean confidence over the matching records, in one row."""
    scores = fields.groupBy("record_id").agg(
        F.sum("ocr_confidence").alias("_sum"), F.count("ocr_confidence").alias("_n"))
    joined = matching.select(F.col("id").alias("record_id"), "status").join(scores, "record_id", "left")
    return joined.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "submitted").alias("submitted"),
        F.count_if(F.col("status") == "draft").alias("drafts"),
        V.one_decimal(F.try_divide(F.sum("_sum"), F.sum("_n"))).alias("average_confidence"),
    )


def report_rows(matching: DataFrame, fields: DataFrame, users: DataFrame, types: DataFrame) -> DataFrame:
    """The twelve export columns of each matching record."""
    per_record = fields.groupBy(F.col("record_id").alias("id")).agg(
        title_expr().alias("_title"), F.count("*").alias("_fields"),
        V.one_decimal(F.avg("ocr_confidence")).alias("average_confidence"),
    )
    stamp = "yyyy-MM-dd HH:mm:ss"
    return enrich_records(matching, users, types).join(per_record, "id", "left").select(
        F.col("id").alias("record_id"), "registry_number", F.col("type_label").alias("document_type"),
        V.status_label(F.col("status")).alias("status"),
        F.coalesce("_title", F.lit(V.UNTITLED)).alias("primary_value"),
        F.date_format("created_at", stamp).alias("created_at"), F.col("creator_name").alias("created_by"),
        F.date_format("submitted_at", stamp).alias("submitted_at"), F.col("submitter_name").alias("submitted_by"),
        F.col("ocr_model_key").alias("ocr_model"),
        F.coalesce("_fields", F.lit(0)).cast("long").alias("fields"), "average_confidence",
    )


def filters_used(**filters: object) -> Column:
    """Map of the filters that were set, for the trail entry of an export."""
    cells = [F.lit(x) for k, v in filters.items() for x in (k, None if v is None else str(v))]
    return V.compact_filters(F.create_map(*cells).cast("map<string,string>"))
