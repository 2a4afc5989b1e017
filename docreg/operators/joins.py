"""Joins between registry tables. Join strategy and skew splitting are left to adaptive execution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreg.functions import values as V


def enrich_records(records: DataFrame, users: DataFrame, types: DataFrame) -> DataFrame:
    """Records with creator name, submitter name and type label."""
    names = users.select("id", "name")
    creators = names.toDF("created_by", "creator_name")
    submitters = names.toDF("submitted_by", "submitter_name")
    labels = types.select(
        F.col("id").alias("document_type_id"), F.col("name").alias("_name"), F.col("short_name").alias("_short")
    )
    return (
        records.join(labels, "document_type_id", "left")
        .join(creators, "created_by", "left")
        .join(submitters, "submitted_by", "left")
        .select(
            *[records[c] for c in records.columns], "creator_name", "submitter_name",
            V.type_label(F.col("_name"), records["doc_type"]).alias("type_label"),
            V.type_short_label(F.col("_name"), F.col("_short"), records["doc_type"]).alias("type_short_label"),
        )
    )


def template_requiredness(fields: DataFrame, template_fields: DataFrame) -> DataFrame:
    """``is_required`` by field name (case and outer blanks ignored); unmatched names are required.

    ``fields`` carries document_template_id. A name listed twice takes its last definition.
    """
    key = F.lower(V.trim_ws(F.col("name")))
    rules = template_fields.groupBy("document_template_id", key.alias("_key")).agg(
        F.max_by("is_required", F.struct("sort_order", "id")).alias("_required")
    )
    kept = [c for c in fields.columns if c != "is_required"]
    return (
        fields.withColumn("_key", key).join(rules, ["document_template_id", "_key"], "left")
        .select(*kept, F.coalesce("_required", F.lit(True)).alias("is_required"))
    )


def active_template_per_type(types: DataFrame, templates: DataFrame) -> DataFrame:
    """Each type with its active template (the lowest id), or NULLs."""
    active = (
        templates.where("is_active").groupBy("document_type_id")
        .agg(F.min_by(F.struct("id", "name"), "id").alias("_t"))
        .select(F.col("document_type_id").alias("id"), F.col("_t.id").alias("template_id"),
                F.col("_t.name").alias("template_name"))
    )
    return types.join(active, "id", "left")


def known_actors(users: DataFrame, audit: DataFrame) -> DataFrame:
    """Users with at least one trail entry, by name."""
    seen = audit.where(F.col("user_id").isNotNull()).select(F.col("user_id").alias("id")).distinct()
    return users.join(seen, "id", "left_semi").select("id", "name").orderBy("name", "id")


def request_detail(items: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, orphans): changed items under their field group; items whose field is gone.

    ``members`` is the long output of the grouping operators.
    """
    places = members.select(F.col("field_id").alias("record_field_id"), "record_id", "group_id", "label", "position")
    return (
        items.join(places, "record_field_id", "inner"),
        items.join(places, "record_field_id", "left_anti"),
    )


def orphaned_items(items: DataFrame, fields: DataFrame) -> DataFrame:
    """Items whose field is gone: the orphans of ``request_detail``, without placing any field."""
    return items.join(fields.select(F.col("id").alias("record_field_id")), "record_field_id", "left_anti")


def template_matches_type(records: DataFrame, templates: DataFrame, models: DataFrame) -> DataFrame:
    """Adds ``violations``: foreign template, or a model that is unknown or gone from disk."""
    owner = templates.select(F.col("id").alias("document_template_id"), F.col("document_type_id").alias("_owner"))
    live = (
        models.where(F.col("disk_deleted_at").isNull())
        .select(F.col("key").alias("ocr_model_key")).distinct().withColumn("_live", F.lit(True))
    )
    checked = records.join(owner, "document_template_id", "left").join(live, "ocr_model_key", "left")
    same = F.coalesce(F.col("_owner") == F.col("document_type_id"), F.lit(False))
    return checked.select(
        *records.columns,
        F.array_compact(F.array(
            F.when(~same, F.lit("document_template_id: does not belong to this document type")),
            F.when(F.col("_live").isNull(), F.lit("ocr_model_key: not a registered model")),
        )).alias("violations"),
    )


def boxes_in_region(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Boxes touching the rectangle drawn on their document (shared edges count).

    ``regions``: document_id, left, top, right, bottom in pixels, overlay_width,
    overlay_height; one rectangle per document. One of at most 2 px both ways selects nothing.
    """
    drawn = regions.where((F.col("right") - F.col("left") > 2) | (F.col("bottom") - F.col("top") > 2))
    b, r = boxes.alias("b"), drawn.alias("r")
    ow, oh = F.col("r.overlay_width"), F.col("r.overlay_height")
    touches = (
        (F.col("b.document_id") == F.col("r.document_id"))
        & ((F.col("b.x") + F.col("b.width")) * ow >= F.col("r.left")) & (F.col("b.x") * ow <= F.col("r.right"))
        & ((F.col("b.y") + F.col("b.height")) * oh >= F.col("r.top")) & (F.col("b.y") * oh <= F.col("r.bottom"))
    )
    return b.join(r, touches, "left_semi")
