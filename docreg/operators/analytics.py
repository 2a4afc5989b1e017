"""Oversight dashboard and record-level aggregates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.functions import values as V
from docreg.functions.prefix import crowded
from docreg.operators.filters import submitted_in_scope
from docreg.operators.ordering import newest_first, top_k
from docreg.operators.scope import REPORTING_TZ, Scope, month_start


def headline(records: DataFrame, scope: Scope) -> DataFrame:
    """All submitted records, and those inside the scope, in one pass."""
    return records.where(F.col("status") == "submitted").agg(
        F.count("*").alias("records"),
        F.count_if(scope.contains(F.col("submitted_at"))).alias("period_records"),
    )


def records_by_type(records: DataFrame, types: DataFrame, scope: Scope) -> DataFrame:
    """Count and share of every type, empty ones included; largest first, ties in type order."""
    counts = submitted_in_scope(records, scope).groupBy("document_type_id").agg(F.count("*").alias("_n"))
    everything = F.coalesce(counts.agg(F.sum("_n")).scalar(), F.lit(0))
    total = F.coalesce(F.col("_n"), F.lit(0))
    named = types.select(F.col("id").alias("document_type_id"), "key", "name", "is_system")
    return (
        named.join(counts, "document_type_id", "left")
        .select(
            "document_type_id", "key", "name", "is_system", total.cast("long").alias("total"),
            F.when(everything > 0, V.one_decimal(total / everything * 100)).otherwise(F.lit(0.0)).alias("share"),
        )
        .orderBy(F.col("total").desc(), F.col("is_system").desc(), "document_type_id")
        .drop("is_system")
    )


def _bucket(scope: Scope) -> Column:
    return F.to_date(F.date_trunc(scope.unit, F.from_utc_timestamp(F.col("submitted_at"), scope.tz)))


def _calendar(scope: Scope) -> Column:
    first = scope.first if scope.daily else scope.first.replace(day=1)
    return F.explode(F.sequence(
        F.lit(str(first)).cast("date"), F.lit(str(scope.last)).cast("date"),
        F.expr(f"interval 1 {scope.unit}"),
    ))


def _label(scope: Scope) -> Column:
    return F.date_format("bucket", "d MMM" if scope.daily else "MMM yyyy")


def record_trend(records: DataFrame, types: DataFrame, scope: Scope) -> DataFrame:
    """Zero-filled series per type: (bucket, label, document_type_id, series, total)."""
    counts = (
        submitted_in_scope(records, scope)
        .groupBy(_bucket(scope).alias("bucket"), "document_type_id").agg(F.count("*").alias("_n"))
    )
    grid = types.select(
        F.col("id").alias("document_type_id"),
        V.type_short_label(F.col("name"), F.col("short_name"), F.lit(None)).alias("series"),
        _calendar(scope).alias("bucket"),
    )
    return grid.join(counts, ["bucket", "document_type_id"], "left").select(
        "bucket", _label(scope).alias("label"), "document_type_id", "series",
        F.coalesce("_n", F.lit(0)).cast("long").alias("total"),
    )


def trend_totals(records: DataFrame, scope: Scope) -> DataFrame:
    """Zero-filled totals per bucket; records of an unknown type count here only."""
    counts = submitted_in_scope(records, scope).groupBy(_bucket(scope).alias("bucket")).agg(F.count("*").alias("_n"))
    calendar = records.sparkSession.range(1).select(_calendar(scope).alias("bucket"))
    return calendar.join(counts, "bucket", "left").select(
        "bucket", _label(scope).alias("label"), F.coalesce("_n", F.lit(0)).cast("long").alias("total")
    )


def growth_rate(totals: DataFrame) -> DataFrame:
    """Last bucket against the one before, in percent; NULL when that one is empty."""
    last = totals.agg(F.slice(F.sort_array(F.collect_list(F.struct("bucket", "total")), False), 1, 2).alias("_b"))
    latest, previous = F.get(F.col("_b"), F.lit(0))["total"], F.get(F.col("_b"), F.lit(1))["total"]
    return last.select(
        latest.alias("latest"), F.coalesce(previous, F.lit(0)).alias("previous"),
        F.when(previous > 0, V.one_decimal((latest - previous) / previous * 100)).alias("growth_rate"),
    )


_QUALITY = ("_scored", "_sum", "_below", "_comparable", "_corrected")


def ocr_quality(fields: DataFrame, records: DataFrame, scope: Scope, threshold: float | Column,
                by: list[str] | None = None, collation: str = "binary") -> DataFrame:
    """Confidence and correction rates of the fields of in-scope records.

    Fields are reduced to five numbers per record before they meet the records, so
    texts never travel and one huge record costs one row. ``by`` names record columns.
    """
    by = by or []
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    per_record = fields.groupBy("record_id").agg(
        F.count("ocr_confidence").alias("_scored"),
        F.sum("ocr_confidence").alias("_sum"),
        F.count_if(F.col("ocr_confidence") < limit).alias("_below"),
        F.count("ocr_text").alias("_comparable"),
        F.count_if(V.differs_from_ocr(F.col("ocr_text"), F.col("verified_value"), collation)).alias("_corrected"),
    )
    chosen = submitted_in_scope(records, scope).select(F.col("id").alias("record_id"), *by)
    joined = per_record.join(chosen, "record_id", "inner" if by else "left_semi")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _QUALITY]
    n = {c: F.col(c) for c in _QUALITY}
    return joined.groupBy(*by).agg(*sums).select(
        *by,
        n["_scored"].cast("long").alias("confidence_fields"),
        F.when(n["_scored"] > 0, V.one_decimal(n["_sum"] / n["_scored"])).alias("average_confidence"),
        n["_below"].cast("long").alias("below_threshold"),
        F.when(n["_scored"] > 0, V.one_decimal((n["_scored"] - n["_below"]) / n["_scored"] * 100)).alias("threshold_pass_rate"),
        n["_comparable"].cast("long").alias("comparable_fields"),
        n["_corrected"].cast("long").alias("corrected_fields"),
        F.when(n["_comparable"] > 0, V.one_decimal(n["_corrected"] / n["_comparable"] * 100)).alias("correction_rate"),
    )


def throughput(records: DataFrame, users: DataFrame, scope: Scope, n: int = 6) -> DataFrame:
    """Busiest submitters; users (with role_slug) are looked up after the limit."""
    top = top_k(
        submitted_in_scope(records, scope).where(F.col("submitted_by").isNotNull())
        .groupBy("submitted_by").agg(F.count("*").alias("total")),
        [F.col("total").desc(), F.col("submitted_by")], n,
    )
    people = users.select(F.col("id").alias("submitted_by"), "name", "role_slug")
    return top.join(people, "submitted_by", "left").select(
        "submitted_by", F.coalesce("name", F.lit("Removed account")).alias("name"),
        F.coalesce(V.role_label(F.col("role_slug")), F.lit("Staff")).alias("role"), "total",
    ).orderBy(F.col("total").desc(), "submitted_by")


def account_health(users: DataFrame) -> DataFrame:
    return users.agg(
        F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive")
    )


def staff_counts(records: DataFrame, requests: DataFrame, user_id: int, now: datetime, tz: str = REPORTING_TZ) -> DataFrame:
    """Own submissions this local month and own pending requests, in one row."""
    mine = records.where(
        (F.col("submitted_by") == user_id) & (F.col("status") == "submitted")
        & (F.col("submitted_at") >= month_start(now, tz))
    ).agg(F.count("*").alias("submitted_this_month"))
    pending = requests.where((F.col("requested_by") == user_id) & (F.col("status") == "pending"))
    return mine.withColumn("pending_change_requests", pending.agg(F.count("*")).scalar())


def staff_recent(records: DataFrame, user_id: int, k: int = 5) -> DataFrame:
    """The user's latest submissions."""
    own = records.where((F.col("submitted_by") == user_id) & (F.col("status") == "submitted"))
    return top_k(own, newest_first("submitted_at"), k)


def status_counts(visible_requests: DataFrame) -> DataFrame:
    return visible_requests.groupBy("status").agg(F.count("*").alias("total"))


def recorded_actions(audit: DataFrame) -> DataFrame:
    return audit.select("action").distinct().orderBy("action")


def usage_counts(types: DataFrame, templates: DataFrame, records: DataFrame) -> DataFrame:
    """Templates, draft layouts and records per type, in type order."""
    t = templates.groupBy(F.col("document_type_id").alias("id")).agg(
        F.count("*").alias("templates_count"), F.count_if(~F.col("is_active")).alias("drafts_count"))
    r = records.groupBy(F.col("document_type_id").alias("id")).agg(F.count("*").alias("records_count"))
    return types.join(t, "id", "left").join(r, "id", "left").select(
        "id", "name", "is_system",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("templates_count", "drafts_count", "records_count")],
    ).orderBy(F.col("is_system").desc(), "id")


def template_usage(templates: DataFrame, template_fields: DataFrame, records: DataFrame) -> DataFrame:
    """Fields, person groups and records per template."""
    f = template_fields.groupBy(F.col("document_template_id").alias("id")).agg(
        F.count("*").alias("fields_count"), F.countDistinct("person_group").alias("person_groups"))
    r = records.groupBy(F.col("document_template_id").alias("id")).agg(F.count("*").alias("records_count"))
    return templates.join(f, "id", "left").join(r, "id", "left").select(
        "id", "name", "document_type_id", "is_active",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fields_count", "person_groups", "records_count")],
    )


def person_group_count(template_fields: DataFrame) -> DataFrame:
    return template_fields.groupBy("document_template_id").agg(
        F.countDistinct("person_group").alias("person_groups"))


def change_count(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Items of each request, plus one for a new registry number."""
    n = items.groupBy(F.col("change_request_id").alias("id")).agg(F.count("*").alias("_n"))
    return requests.join(n, "id", "left").select(
        "id", (F.coalesce("_n", F.lit(0)) + F.col("changes_registry_number").cast("int")).cast("long").alias("change_count")
    )


def last_active_admin_guard(users: DataFrame) -> DataFrame:
    """True where demoting or disabling this user would leave no active super admin."""
    admin = F.col("role_slug") == "super_admin"
    active = users.where(admin & F.col("is_active")).agg(F.count("*")).scalar()
    others = active - F.when(F.col("is_active"), 1).otherwise(0)
    return users.select("id", "name", (admin & (others == 0)).alias("is_last_active_admin"))


def _touched_fields(approved: DataFrame, items: DataFrame) -> DataFrame:
    """(id, _touched): distinct fields of the approved requests of each record.

    Fields of a record's only request are counted where they meet it. Fields of several requests, and
    those of crowded ones, go on to their record.
    """
    requests = approved.groupBy("record_id").agg(F.count("*").alias("_requests"))
    owned = approved.select("change_request_id", "record_id").join(requests, "record_id", "inner").select(
        "change_request_id", "record_id", (F.col("_requests") == 1).alias("_alone"))
    touching = items.where(F.col("record_field_id").isNotNull()).select("change_request_id", "record_field_id")
    hot = crowded(touching, "change_request_id")
    request = ["change_request_id", "record_id", "_alone"]
    here = owned.join(touching.where(~hot), "change_request_id", "inner").select(*request, "record_field_id").distinct()
    counted = here.groupBy(*request, F.when(~F.col("_alone"), F.col("record_field_id")).alias("_field")).agg(
        F.count("*").alias("_n")).select("record_id", "_field", "_n")
    one = F.lit(1).cast("long").alias("_n")
    busy = owned.join(touching.where(hot), "change_request_id", "inner").select(
        "record_id", F.col("record_field_id").alias("_field"), one)
    # A record has either one counted row without a field or rows of fields.
    fields = counted.unionByName(busy).groupBy("record_id", "_field").agg(F.sum("_n").alias("_n"))
    return fields.groupBy(F.col("record_id").alias("id")).agg(
        F.sum(F.when(F.col("_field").isNull(), F.col("_n")).otherwise(1)).alias("_touched"))


def record_detail_counts(records: DataFrame, fields: DataFrame, items: DataFrame, requests: DataFrame,
                         person_counts: DataFrame | None = None) -> DataFrame:
    """Adjusted fields and post-submission changes per record.

    ``person_counts`` (record_id, person_count) comes from the grouping operators.
    """
    adjusted = fields.groupBy(F.col("record_id").alias("id")).agg(
        F.count("*").alias("_fields"),
        F.count_if(V.was_corrected(F.col("ocr_text"), F.col("verified_value"))).alias("_adjusted"))
    approved = requests.where(F.col("status") == "approved").select(
        F.col("id").alias("change_request_id"), "record_id", "changes_registry_number")
    touched = _touched_fields(approved, items)
    renumbered = approved.groupBy(F.col("record_id").alias("id")).agg(
        F.bool_or("changes_registry_number").alias("_renumbered"))
    out = records.select("id").join(adjusted, "id", "left").join(touched, "id", "left").join(renumbered, "id", "left")
    extra = []
    if person_counts is not None:
        out = out.join(person_counts.withColumnRenamed("record_id", "id"), "id", "left")
        extra = [F.coalesce("person_count", F.lit(0)).cast("long").alias("person_count")]
    renumber = F.coalesce("_renumbered", F.lit(False))
    return out.select(
        "id", F.coalesce("_fields", F.lit(0)).cast("long").alias("field_count"),
        F.coalesce("_adjusted", F.lit(0)).cast("long").alias("ocr_adjusted_count"),
        renumber.alias("registry_was_corrected"),
        (F.coalesce("_touched", F.lit(0)) + renumber.cast("int")).cast("long").alias("post_submission_changes"),
        *extra,
    )


def review_summary(readings: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Mean normalised confidence and flagged readings; an unscored reading counts as 0."""
    c = V.normalise_confidence(F.col("ocr_confidence"))
    return readings.groupBy(*by).agg(
        F.count("*").alias("readings"), V.one_decimal(F.avg(c)).alias("average_confidence"),
        F.count_if(c < threshold).alias("flagged"),
    )


def verification_state(fields: DataFrame, by: list[str], checked: str = "verified") -> DataFrame:
    """State of the group-level check box."""
    return fields.groupBy(*by).agg(
        F.count_if(F.col(checked)).alias("verified"), F.count("*").alias("total")
    ).select(
        *by, "verified", "total", (F.col("verified") == F.col("total")).alias("checked"),
        ((F.col("verified") > 0) & (F.col("verified") < F.col("total"))).alias("indeterminate"),
    )
