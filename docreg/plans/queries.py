"""Registered queries: every operator over the whole derived registry."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docreg.functions import distance as D
from docreg.functions import values as V
from docreg.operators import (
    analytics, datasets, evaluation, filters, grouping, history, joins, models, ordering, quality, reports, trail,
    workflow,
)
from docreg.operators.scope import Scope, last_twelve_months
from docreg.plans import dashboard
from docreg.session import ship_package
from docreg.sources import files as files_source
from docreg.sources import registry as registry_source
from docreg.sources.derived import Registry, line_id
from docreg.streaming.throttle import throttle_breaches

NOW = datetime(2001, 6, 15, 4, 0, tzinfo=timezone.utc)
YEAR = last_twelve_months(NOW)
ALL_TIME = Scope(date(1995, 1, 1), date(2001, 12, 31))
QUARTER = Scope(date(2001, 1, 10), date(2001, 3, 20))
THRESHOLD = 80.0
USER = 7
STAMP = "yyyy-MM-dd HH:mm:ss"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Registry], DataFrame]) -> Callable[[Registry], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(Registry(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def stamp(c: str) -> F.Column:
    return F.date_format(c, STAMP).alias(c)


def joined(c: str, alias: str | None = None) -> F.Column:
    return F.array_join(c, "; ").alias(alias or c)


# ------------------------------------------------------------------ dashboard
@query
def ocr_quality_by_type(r: Registry) -> DataFrame:
    return dashboard.quality_by_type(r, ALL_TIME, THRESHOLD)


@query
def headline(r: Registry) -> DataFrame:
    return analytics.headline(r.records, YEAR)


@query
def records_by_type(r: Registry) -> DataFrame:
    return analytics.records_by_type(r.records, r.document_types, YEAR)


@query
def record_trend_monthly(r: Registry) -> DataFrame:
    out = analytics.record_trend(r.records, r.document_types, YEAR)
    return out.select(F.col("bucket").cast("string").alias("bucket"), "document_type_id", "series", "total")


@query
def record_trend_daily(r: Registry) -> DataFrame:
    out = analytics.record_trend(r.records, r.document_types, QUARTER)
    return out.select(F.col("bucket").cast("string").alias("bucket"), "document_type_id", "series", "total")


@query
def trend_totals(r: Registry) -> DataFrame:
    out = analytics.trend_totals(r.records, ALL_TIME)
    return out.select(F.col("bucket").cast("string").alias("bucket"), "total")


@query
def growth_rate(r: Registry) -> DataFrame:
    return analytics.growth_rate(analytics.trend_totals(r.records, YEAR))


@query
def ocr_quality(r: Registry) -> DataFrame:
    return analytics.ocr_quality(r.record_fields, r.records, ALL_TIME, THRESHOLD)


@query
def ocr_quality_stored_threshold(r: Registry) -> DataFrame:
    """The threshold comes from a settings table (here: one row per region, the first counts)."""
    settings = r.document_types.select("id", (F.col("id") * 0.5 + 70.0).alias("confidence_review_threshold"))
    limit = filters.review_threshold(settings)
    return analytics.ocr_quality(r.record_fields, r.records, ALL_TIME, limit)


@query
def throughput(r: Registry) -> DataFrame:
    return analytics.throughput(r.records, r.users, ALL_TIME)


@query
def account_health(r: Registry) -> DataFrame:
    return analytics.account_health(r.users)


@query
def staff_counts(r: Registry) -> DataFrame:
    return analytics.staff_counts(r.records, r.change_requests, USER, datetime(1999, 6, 15, 4, tzinfo=timezone.utc))


@query
def staff_recent(r: Registry) -> DataFrame:
    return analytics.staff_recent(r.records, USER).select("id", stamp("submitted_at"))


# -------------------------------------------------------------------- reports
def _matching(r: Registry) -> DataFrame:
    return filters.report_filter(r.records, r.document_types, date_from="1996-02-01", date_to="2000-11-30")


@query
def report_filter(r: Registry) -> DataFrame:
    return filters.report_filter(
        r.records, r.document_types, date_from="1996-02-01", date_to="2000-11-30", doc_type="asia", status="submitted",
    ).select("id", "status", stamp("created_at"))


@query
def report_summary(r: Registry) -> DataFrame:
    return reports.report_summary(_matching(r), r.record_fields)


@query
def report_rows(r: Registry) -> DataFrame:
    return reports.report_rows(r.records, r.record_fields, r.users, r.document_types)


@query
def record_title(r: Registry) -> DataFrame:
    return reports.record_title(r.record_fields)


@query
def enrich_records(r: Registry) -> DataFrame:
    return joins.enrich_records(r.records, r.users, r.document_types).select(
        "id", "creator_name", "submitter_name", "type_label", "type_short_label")


# --------------------------------------------------------------------- search
@query
def archive_search(r: Registry) -> DataFrame:
    return filters.archive_search(
        r.records, r.record_fields, r.document_types, q="T 12", date_from="1996-01-01", date_to="2001-06-30",
    ).select("id", "registry_number", stamp("submitted_at"))


@query
def archive_search_wildcard(r: Registry) -> DataFrame:
    return filters.archive_search(
        r.records, r.record_fields, r.document_types, q="R-1_3", doc_type="america", status="submitted", literal=False,
    ).select("id", "registry_number")


@query
def audit_filter(r: Registry) -> DataFrame:
    return filters.audit_filter(
        r.audit_logs, action="record.click", date_from="2024-01-02", date_to="2024-01-20", q="entry #1",
    ).select("id", "user_id", "description", stamp("created_at"))


@query
def audit_page(r: Registry) -> DataFrame:
    page = ordering.paginate(r.audit_logs, ordering.newest_first(), page=3, per_page=25)
    return page.rows.select("id", "action", stamp("created_at"))


@query
def audit_seek(r: Registry) -> DataFrame:
    """The page behind the trail row of number 500, newest first."""
    order = [("created_at", False), ("id", False)]
    last = r.audit_logs.where("id = 500").select("created_at", "id").first()
    return ordering.seek(r.audit_logs, order, last.asDict() if last else None).select("id", "action", stamp("created_at"))


@query
def own_recent_activity(r: Registry) -> DataFrame:
    return ordering.own_recent_activity(r.audit_logs, USER).select("id", "action", stamp("created_at"))


@query
def audit_page_info(r: Registry) -> DataFrame:
    return ordering.paginate(r.audit_logs, ordering.newest_first(), page=3, per_page=25).info


@query
def recorded_actions(r: Registry) -> DataFrame:
    return analytics.recorded_actions(r.audit_logs)


@query
def known_actors(r: Registry) -> DataFrame:
    return joins.known_actors(r.users, r.audit_logs)


@query
def user_search(r: Registry) -> DataFrame:
    return filters.user_search(r.users, r.roles, q="000012", role="staff", status="active").select("id", "name", "email")


@query
def data_entry_users(r: Registry) -> DataFrame:
    return filters.data_entry_users(r.users, r.roles)


@query
def request_search_moderator(r: Registry) -> DataFrame:
    return filters.request_search(
        r.change_requests, r.records, r.document_types, r.users, user_id=1, can_moderate=True, q="77",
    ).select("id", "record_id", "status")


@query
def request_search_own(r: Registry) -> DataFrame:
    return filters.request_search(
        r.change_requests, r.records, r.document_types, r.users, user_id=USER, can_moderate=False, q="Euro", status="pending",
    ).select("id", "record_id", "status")


@query
def request_queue_page(r: Registry) -> DataFrame:
    page = ordering.paginate(r.change_requests, ordering.queue_order(), page=2, per_page=15)
    return page.rows.select("id", "status", stamp("created_at"))


@query
def status_counts(r: Registry) -> DataFrame:
    return analytics.status_counts(filters.visible_scope(r.change_requests, 1, True))


@query
def status_counts_own(r: Registry) -> DataFrame:
    return analytics.status_counts(filters.visible_scope(r.change_requests, USER, False))


@query
def needs_review(r: Registry) -> DataFrame:
    return filters.needs_review(r.record_fields, THRESHOLD).select("id", "record_id", "ocr_confidence")


# ------------------------------------------------------------------- counting
@query
def usage_counts(r: Registry) -> DataFrame:
    return analytics.usage_counts(r.document_types, r.document_templates, r.records)


@query
def template_usage(r: Registry) -> DataFrame:
    return analytics.template_usage(r.document_templates, r.template_fields, r.records)


@query
def person_group_count(r: Registry) -> DataFrame:
    return analytics.person_group_count(r.template_fields)


@query
def change_count(r: Registry) -> DataFrame:
    return analytics.change_count(r.change_requests, r.change_request_items)


@query
def last_active_admin_guard(r: Registry) -> DataFrame:
    return analytics.last_active_admin_guard(r.users)


@query
def record_detail_counts(r: Registry) -> DataFrame:
    return analytics.record_detail_counts(r.records, r.record_fields, r.change_request_items, r.change_requests)


@query
def review_summary(r: Registry) -> DataFrame:
    return analytics.review_summary(r.record_fields, THRESHOLD, ["record_id"])


@query
def verification_state(r: Registry) -> DataFrame:
    checked = r.record_fields.withColumn("verified", V.is_filled(F.col("verified_value")))
    return analytics.verification_state(checked, ["record_id", "person_group"])


# ------------------------------------------------------------------- layouts
@query
def template_requiredness(r: Registry) -> DataFrame:
    rules = r.template_fields.select(
        "id", "document_template_id", "sort_order", "is_required",
        F.concat(F.lit(" field "), (F.col("id") % 6 + 1).cast("string")).alias("name"))
    fields = r.record_fields.join(
        r.records.select(F.col("id").alias("record_id"), "document_template_id"), "record_id", "inner")
    return joins.template_requiredness(fields, rules).select("id", "is_required")


@query
def active_template_per_type(r: Registry) -> DataFrame:
    return joins.active_template_per_type(r.document_types, r.document_templates).select(
        "id", "template_id", "template_name")


@query
def template_matches_type(r: Registry) -> DataFrame:
    return joins.template_matches_type(r.records, r.document_templates, r.ocr_models).select("id", joined("violations"))


@query
def ordered_templates(r: Registry) -> DataFrame:
    return r.document_templates.orderBy(*ordering.template_order()).select("id", "document_type_id", "is_active")


@query
def publish_templates(r: Registry) -> DataFrame:
    """The newest layout of each type goes live."""
    newest = r.document_templates.groupBy("document_type_id").agg(F.max("id").alias("id"))
    return workflow.single_active(r.document_templates, newest, ["document_type_id"]).select("id", "is_active")


@query
def active_violations(r: Registry) -> DataFrame:
    return workflow.active_violations(r.document_templates, ["document_type_id"])


@query
def canonicalize_groups(r: Registry) -> DataFrame:
    return grouping.canonicalize_groups(r.template_fields, r.document_templates).select(
        "id", "document_template_id", "person_group", "person_field_order")


@query
def group_selected(r: Registry) -> DataFrame:
    boxes = r.template_fields.withColumnsRenamed({"document_template_id": "document_id", "id": "index"})
    chosen = boxes.where(~F.col("is_required"))
    return grouping.group_selected(boxes, chosen).select("index", "document_id", "person_group", "person_field_order")


@query
def boxes_in_region(r: Registry) -> DataFrame:
    boxes = r.record_fields.withColumnRenamed("record_id", "document_id")
    k = F.col("id")
    regions = r.records.select(
        k.alias("document_id"), (k % 500).alias("left"), (k % 300).alias("top"),
        (k % 500 + k % 251).alias("right"), (k % 300 + k % 173).alias("bottom"),
        F.lit(800).alias("overlay_width"), F.lit(1100).alias("overlay_height"))
    return joins.boxes_in_region(boxes, regions).select("id", "document_id")


@query
def copy_names(r: Registry) -> DataFrame:
    fields = r.template_fields
    return grouping.copy_names(fields, fields.select(
        "document_template_id", F.col("sort_order").alias("position"), "name"))


# ------------------------------------------------------------------- grouping
@query
def field_groups_persisted(r: Registry) -> DataFrame:
    return grouping.field_groups_persisted(r.record_fields)


@query
def field_groups_inferred(r: Registry) -> DataFrame:
    return grouping.field_groups_inferred(r.sheet_fields)


@query
def field_groups_workspace(r: Registry) -> DataFrame:
    return grouping.field_groups_workspace(r.sheet_fields)


@query
def field_groups(r: Registry) -> DataFrame:
    return grouping.field_groups(r.sheet_fields)


@query
def group_summary(r: Registry) -> DataFrame:
    return grouping.group_summary(grouping.field_groups_persisted(r.record_fields), r.record_fields)


@query
def record_headings(r: Registry) -> DataFrame:
    members = grouping.field_groups_persisted(r.record_fields)
    return grouping.record_headings(r.records, r.document_types, members, r.record_fields)


@query
def person_counts(r: Registry) -> DataFrame:
    return grouping.stored_person_counts(r.record_fields)


@query
def request_detail(r: Registry) -> DataFrame:
    members = grouping.field_groups_persisted(r.record_fields)
    return joins.request_detail(r.change_request_items, members)[0].select("id", "record_id", "group_id", "position")


@query
def request_detail_orphans(r: Registry) -> DataFrame:
    return joins.orphaned_items(r.change_request_items, r.record_fields).select("id", "record_field_id")


@query
def column_labels(r: Registry) -> DataFrame:
    """Sheets of 64 record numbers, cut into rows of eleven boxes: a first row of details, then people, every second one by hand."""
    sheet, place = F.expr("record_id div 64"), F.col("place")
    boxes = r.record_fields.select("id", "name", sheet.alias("sheet"), (
        F.row_number().over(Window.partitionBy(sheet).orderBy("id")) - 1).alias("place")).withColumn("number", F.expr("place div 11"))
    size = F.count("*").over(Window.partitionBy("sheet", "number"))
    kind = F.when(F.col("number") == 0, "details").otherwise("person")
    mode = F.when(F.col("number") % 2 == 0, "auto").otherwise("manual")
    return boxes.select(F.col("id").alias("field_id"), V.column_label(kind, mode, size, place % 11, F.col("name")).alias("column_label"))


# ------------------------------------------------------------------- workflow
def _proposals(r: Registry) -> tuple[DataFrame, DataFrame]:
    """One proposal per request row, with its items as new values."""
    q = r.change_requests
    proposals = q.select(
        F.col("id").alias("proposal_id"), "record_id", "reason", "requested_by", "created_at",
        F.col("changes_registry_number").alias("registry_supplied"),
        F.col("proposed_registry_number").alias("registry_number"))
    items = r.change_request_items.select(
        F.col("change_request_id").alias("proposal_id"), "record_field_id", F.col("proposed_value").alias("value"))
    return proposals, items


def _opened(r: Registry) -> workflow.Opened:
    proposals, items = _proposals(r)
    return workflow.open_requests(r.records, r.record_fields, proposals, items, r.change_requests)


@query
def open_requests(r: Registry) -> DataFrame:
    return _opened(r).outcomes.select("proposal_id", "record_id", "outcome", "change_count")


@query
def open_requests_items(r: Registry) -> DataFrame:
    return _opened(r).items


@query
def opened_audit(r: Registry) -> DataFrame:
    return workflow.opened_audit(_opened(r)).select(
        "auditable_id", "user_id", "description", F.col("new_values")["field_count"].alias("field_count"))


def _decisions(r: Registry) -> DataFrame:
    return r.change_requests.select(
        F.col("id").alias("request_id"), F.col("requested_by").alias("reviewer_id"),
        (F.col("created_at") + F.expr("interval 3 days")).alias("reviewed_at"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("note "), F.col("id").cast("string"))).otherwise("no").alias("note"))


def _approved(r: Registry) -> workflow.Approved:
    return workflow.approve_requests(
        r.change_requests.withColumn("status", F.when(F.col("status") == "approved", "pending").otherwise(F.col("status"))),
        r.change_request_items, r.record_fields, r.records, _decisions(r))


@query
def approve_outcomes(r: Registry) -> DataFrame:
    return _approved(r).outcomes


@query
def approve_fields(r: Registry) -> DataFrame:
    return _approved(r).fields.select("id", "verified_value")


@query
def approve_records(r: Registry) -> DataFrame:
    return _approved(r).records.select("id", "registry_number")


@query
def approve_requests(r: Registry) -> DataFrame:
    return _approved(r).requests.select("id", "status", "reviewed_by", stamp("reviewed_at"), "decision_note")


@query
def approve_applied(r: Registry) -> DataFrame:
    return _approved(r).applied.select("request_id", "item_id", "name", "old_value", "new_value")


@query
def approved_audit(r: Registry) -> DataFrame:
    return workflow.approved_audit(_approved(r)).select("auditable_id", "user_id", "description", *[
        F.to_json(side).alias(side) for side in ("old_values", "new_values")])


@query
def approved_entries(r: Registry) -> DataFrame:
    return workflow.approved_entries(_approved(r))


@query
def reject_requests(r: Registry) -> DataFrame:
    moved, _ = workflow.reject_requests(r.change_requests, _decisions(r))
    return moved.select("id", "status", "reviewed_by", "decision_note")


@query
def rejected_audit(r: Registry) -> DataFrame:
    moved, outcomes = workflow.reject_requests(r.change_requests, _decisions(r))
    return workflow.closed_audit(moved, outcomes, "rejected").select("auditable_id", "user_id", "description")


@query
def withdraw_requests(r: Registry) -> DataFrame:
    asked = r.change_requests.select(
        F.col("id").alias("request_id"), (F.col("requested_by") + (F.col("id") % 3 == 0).cast("int")).alias("actor_id"))
    moved, outcomes = workflow.withdraw_requests(r.change_requests, asked)
    return moved.select("id", "status").join(outcomes.select(F.col("request_id").alias("id"), "outcome"), "id", "left")


@query
def one_pending_per_record(r: Registry) -> DataFrame:
    waiting = r.change_requests.withColumn(
        "status", F.when(F.col("status") == "withdrawn", "pending").otherwise(F.col("status")))
    return workflow.one_pending_per_record(waiting)


@query
def transition_check(r: Registry) -> DataFrame:
    mixed = r.change_requests.withColumn("reviewed_by", F.when(F.col("id") % 7 != 0, F.col("reviewed_by")))
    return workflow.transition_check(mixed).select("id", "is_open", joined("violations"))


@query
def field_change_history(r: Registry) -> DataFrame:
    return workflow.field_change_history(r.change_request_items, r.change_requests).select(
        "record_field_id", "change_request_id", "proposed_value", "newest")


@query
def submitted_audit(r: Registry) -> DataFrame:
    return workflow.submitted_audit(r.records, r.record_fields, r.document_types).drop("action", "auditable_type")


@query
def audit_diff_rows(r: Registry) -> DataFrame:
    out = trail.audit_diff_rows(trail.redacted_entries(r.audit_logs), r.users)
    return out.select("id", "actor", "key", "before", "after", "changed")


# -------------------------------------------------------------------- quality
@query
def check_fields_capture(r: Registry) -> DataFrame:
    return quality.check_fields(r.record_fields, "capture").select("id", joined("violations"))


@query
def check_fields_layout(r: Registry) -> DataFrame:
    return quality.check_fields(r.template_fields, "layout").select("id", joined("violations"))


@query
def check_unique_names(r: Registry) -> DataFrame:
    return quality.check_unique_names(r.record_fields, "record_id").select("id", joined("violations"))


@query
def check_field_count(r: Registry) -> DataFrame:
    return quality.check_field_count(r.records, r.record_fields, "record_id").select("id", "field_count", joined("violations"))


@query
def check_report_filters(r: Registry) -> DataFrame:
    k = F.col("id")
    asked = r.records.select(
        k, F.to_date("created_at").alias("date_from"), F.date_add(F.to_date("created_at"), (k % 3 - 1).cast("int")).alias("date_to"),
        F.when(k % 4 == 0, "asia").when(k % 4 == 1, "moon").alias("doc_type"),
        F.when(k % 5 == 0, "open").otherwise(F.col("status")).alias("status"),
        F.when(k % 6 == 0, -k - 1).otherwise(F.col("created_by")).alias("submitted_by"))
    return quality.check_report_filters(asked, r.document_types, r.users).select("id", joined("violations"))


@query
def check_paper(r: Registry) -> DataFrame:
    return quality.check_paper(r.document_templates).select("id", "custom_width_mm", "custom_height_mm", joined("violations"))


@query
def check_reason(r: Registry) -> DataFrame:
    short = r.change_requests.withColumn("reason", F.when(F.col("id") % 4 == 0, " no ").otherwise(F.col("reason")))
    return quality.check_reason(short).select("id", joined("violations"))


@query
def check_type_names(r: Registry) -> DataFrame:
    named = r.template_fields.select("id", F.concat(F.lit(" "), F.replace("name", F.lit(" "), F.lit("  "))).alias("name"))
    return quality.check_type_names(named).select("id", "clean_name", joined("violations"))


@query
def check_uploads(r: Registry) -> DataFrame:
    return quality.check_uploads(r.images.withColumn("length", F.col("length") * 2000)).select(
        "split", "filename", joined("violations"))


@query
def explode_fields_json(r: Registry) -> DataFrame:
    return registry_source.explode_fields_json(_captures(r))[0].select("id", "sort_order", "name", "verified_value", "x")


@query
def explode_fields_json_rejected(r: Registry) -> DataFrame:
    return registry_source.explode_fields_json(_captures(r))[1].select("id", "reason")


def _captures(r: Registry) -> DataFrame:
    """Two fields per event as a JSON list; some rows are objects, cut off, or missing."""
    e, t, v = F.col("event_id"), F.col("event_type"), F.col("value").cast("string")
    text = F.format_string('[{"name": "%s", "verified_value": "%s", "x": 0.5}, {"name": "value", "x": 0.25}]', t, v)
    return r.table("events").select(
        e.alias("id"),
        F.when(e % 11 == 0, F.col("props")).when(e % 13 == 0, "[{").when(e % 17 == 0, None).otherwise(text).alias("fields_json"))


# ---------------------------------------------------------- models, inventory
@query
def active_models(r: Registry) -> DataFrame:
    return models.active_models(r.ocr_models).select("id", "key")


@query
def selectable_models(r: Registry) -> DataFrame:
    return models.selectable_models(r.remote_models, r.ocr_models, True)


@query
def resolve_model(r: Registry) -> DataFrame:
    asked = r.records.select("id", F.when(F.col("id") % 3 != 0, F.col("ocr_model_key")).alias("requested_key"))
    return models.resolve_model(asked, models.selectable_models(r.remote_models, r.ocr_models, True), r.ocr_models)


@query
def model_overview(r: Registry) -> DataFrame:
    return models.model_overview(r.ocr_models, r.remote_models)


@query
def reconcile_models(r: Registry) -> DataFrame:
    return models.reconcile_models(r.ocr_models, r.remote_models)


@query
def reconcile_counts(r: Registry) -> DataFrame:
    return models.reconcile_counts(models.reconcile_models(r.ocr_models, r.remote_models))


@query
def missing_on_disk(r: Registry) -> DataFrame:
    return models.missing_on_disk(r.ocr_models, r.remote_models)


@query
def sync_evaluations(r: Registry) -> DataFrame:
    return models.sync_evaluations(r.ocr_models, r.remote_models).select(
        "key", F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"), "evaluation_split",
        "evaluation_sample_count", stamp("evaluated_at"), "event")


@query
def model_profiles(r: Registry) -> DataFrame:
    listed = r.remote_models.select("key", "label", F.lit(None).cast("boolean").alias("is_active"), F.col("key").alias("ord"))
    return models.model_profiles(r.ocr_models, listed)


def _model_files(r: Registry) -> DataFrame:
    """Folder listing with one to four files per supplier."""
    k = F.col("s_suppkey")
    names = F.array_compact(F.array(
        F.lit("config.json"), F.when(k % 3 != 0, "model.safetensors"), F.when(k % 4 == 0, "pytorch_model.bin"),
        F.when(k % 5 == 0, "evaluation-report.json")))
    return r.table("supplier").select(
        F.col("s_name").alias("folder"), F.explode(names).alias("filename"), (k * 1000 + 7).alias("length"))


@query
def model_inventory(r: Registry) -> DataFrame:
    return files_source.model_inventory(_model_files(r)).select("key", joined("files"))


@query
def storage_usage(r: Registry) -> DataFrame:
    return files_source.storage_usage(_model_files(r))


@query
def validate_reports(r: Registry) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_name")
    sha = F.sha2(F.concat(n, F.lit("w")), 256)
    raw = r.table("supplier").select(
        n.alias("model_folder"),
        F.when(k % 23 == 1, "2").otherwise("1").alias("schema_version"), n.alias("model_key"),
        F.when(k % 19 == 2, " ").otherwise("form-scans").alias("dataset"),
        F.when(k % 17 == 3, "xyz").otherwise(F.upper(F.sha2(n, 256))).alias("manifest_sha256"),
        F.when(k % 13 == 4, "val").otherwise("test").alias("split"),
        F.when(k % 11 == 5, "0").otherwise((k + 1).cast("string")).alias("sample_count"),
        F.struct(
            (F.col("s_acctbal") / 10000).cast("string").alias("cer"), F.lit("0.25").alias("wer"),
            F.when(k % 29 == 6, "1.5").otherwise("0.9").alias("exact_match")).alias("metrics"),
        F.when(k % 31 == 7, "2026-08-02T10:00:00").otherwise("2026-08-02T10:00:00+08:00").alias("evaluated_at"),
        F.when(k % 7 == 6, "other.bin").otherwise("ckpt/model.safetensors").alias("weights_file"),
        F.when(k % 9 == 8, F.sha2(n, 256)).otherwise(sha).alias("weights_sha256"))
    digests = _model_files(r).select(
        "folder", "filename", F.sha2(F.concat("folder", F.lit("w")), 256).alias("sha256"))
    return quality.validate_reports(raw, digests).select(
        "model_folder", "error", "sample_count", F.round("cer", 6).alias("cer"), "wer", "exact_match",
        stamp("evaluated_at"), "manifest_sha256")


@query
def has_evaluation(r: Registry) -> DataFrame:
    return r.ocr_models.select("key", quality.has_evaluation().alias("has_evaluation"))


@query
def data_file_digests(r: Registry) -> DataFrame:
    """Digest of every data file of the given folder."""
    return files_source.file_digest(r.spark, r.root, "*.parquet").select("filename", "length", "sha256")


@query
def data_file_usage(r: Registry) -> DataFrame:
    return files_source.storage_usage(files_source.list_files(r.spark, r.root))


# ------------------------------------------------------------------- datasets
@query
def usable_labels(r: Registry) -> DataFrame:
    return datasets.usable_labels(r.manifest).select("ord", "filename")


@query
def missing_images(r: Registry) -> DataFrame:
    return datasets.missing_images(r.manifest, r.images)


@query
def orphan_images(r: Registry) -> DataFrame:
    return datasets.orphan_images(r.manifest, r.images)


@query
def dataset_summary(r: Registry) -> DataFrame:
    return datasets.dataset_summary(r.manifest, r.images)


@query
def dataset_totals(r: Registry) -> DataFrame:
    return datasets.dataset_totals(r.manifest, r.images)


@query
def validate_dataset(r: Registry) -> DataFrame:
    out = datasets.validate_dataset(r.manifest, r.images)
    listed = ("unknown_splits", "missing_images", "orphan_images")
    return out.select(*[c for c in out.columns if c not in (*listed, "errors", "warnings")],
                      *[joined(c) for c in listed],
                      F.size("errors").alias("error_count"), F.size("warnings").alias("warning_count"))


@query
def unknown_splits(r: Registry) -> DataFrame:
    return datasets.unknown_splits(r.manifest)


@query
def split_scope(r: Registry) -> DataFrame:
    return datasets.split_scope(r.manifest, r.images, "test").select("filename", F.length("label").alias("label_length"))


@query
def split_scope_fallback(r: Registry) -> DataFrame:
    """No row is marked 'val' here, so every row with an image in val counts."""
    moved = r.manifest.withColumn("split", F.lit("train"))
    return datasets.split_scope(moved, r.images, "val").select("filename", F.length("label").alias("label_length"))


# ----------------------------------------------------------------- evaluation
def _pairs(r: Registry) -> DataFrame:
    read = r.predictions.select("filename", F.col("text").alias("hypothesis"))
    conv = r.table("conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".png"))
        .alias("filename"), "role", F.col("text").alias("reference"))
    return conv.join(read, "filename")


def _tasks(r: Registry) -> int:
    return 4 * r.spark.sparkContext.defaultParallelism


def _field_pairs(r: Registry) -> DataFrame:
    return r.record_fields.select(
        "record_id", F.col("verified_value").alias("reference"), F.coalesce("ocr_text", F.lit("")).alias("hypothesis"))


def _rounded(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, *[F.round(c, 9).alias(c) for c in ("cer", "wer", "accuracy")], "exact", "total",
                     "char_errors", "chars", "word_errors", "words")


@query
def corpus_metrics(r: Registry) -> DataFrame:
    return _rounded(evaluation.corpus_metrics(_pairs(r), spread=_tasks(r)))


@query
def corpus_metrics_by_role(r: Registry) -> DataFrame:
    return _rounded(evaluation.corpus_metrics(_pairs(r), ["role"], spread=_tasks(r)), "role")


@query
def corpus_metrics_fields(r: Registry) -> DataFrame:
    return _rounded(evaluation.corpus_metrics(_field_pairs(r)))


@query
def pair_distances(r: Registry) -> DataFrame:
    out = evaluation.pair_distances(_pairs(r), spread=_tasks(r))
    return out.select("filename", *[F.col(c).cast("long").alias(c) for c in ("char_errors", "chars", "words")], "exact")


@query
def word_distances(r: Registry) -> DataFrame:
    return _pairs(r).select("filename", D.word_distance(F.col("reference"), F.col("hypothesis")).cast("long").alias("word_errors"))


@query
def evaluate_predictions(r: Registry) -> DataFrame:
    return evaluation.evaluate_predictions(r.manifest, r.images, r.predictions, "test", spread=_tasks(r))[0]


@query
def evaluate_predictions_rows(r: Registry) -> DataFrame:
    return evaluation.evaluate_predictions(r.manifest, r.images, r.predictions, "test")[1]


@query
def compare_models(r: Registry) -> DataFrame:
    """Readings of one half of the corpus against the fields of the registry."""
    out = evaluation.compare_models(
        evaluation.corpus_metrics(_pairs(r), spread=_tasks(r)), evaluation.corpus_metrics(_field_pairs(r)))
    return out.select("metric", F.round("base", 9).alias("base"), F.round("tuned", 9).alias("tuned"), "verdict")


@query
def evaluation_report(r: Registry) -> DataFrame:
    report = evaluation.build_evaluation_report(
        evaluation.corpus_metrics(_field_pairs(r)), model_key="fields", dataset="form-scans", manifest_sha256="0" * 64,
        weights_file="model.safetensors", weights_sha256="1" * 64, evaluated_at="2026-08-02T10:00:00+00:00")
    return report.select(
        F.get_json_object("value", "$.sample_count").cast("long").alias("sample_count"),
        F.round(F.get_json_object("value", "$.metrics.cer").cast("double"), 9).alias("cer"),
        F.get_json_object("value", "$.split").alias("split"))


@query
def prediction_summary(r: Registry) -> DataFrame:
    return evaluation.prediction_summary(r.predictions, THRESHOLD)


@query
def prediction_rows(r: Registry) -> DataFrame:
    return registry_source.prediction_rows(r.predictions)


@query
def sequence_confidence(r: Registry) -> DataFrame:
    return evaluation.sequence_confidence(r.token_scores, "purchase")


@query
def batch_predict(r: Registry) -> DataFrame:
    """A stand-in reader that fails on batches holding a system turn."""
    def load():
        def predict(batch: pd.DataFrame) -> list[tuple[str, float]]:
            if (batch["role"] == "system").any():
                raise ValueError("cannot read system turns")
            return [(text.lower(), 50.0 + len(text) % 50) for text in batch["text_in"]]

        return predict

    turns = r.table("conversations").select("conv_id", "turn", "role", F.col("text").alias("text_in"))
    out = evaluation.batch_predict(turns, load, batch_size=16)
    return out.select("conv_id", "turn", F.length("text").cast("long").alias("text_length"), "confidence", "error")


# -------------------------------------------------------------------- history
def _history(r: Registry) -> DataFrame:
    from docreg.functions.prefix import ranked

    return ranked(r.training_epochs, ["run_id"], [F.col("ts")], F.date_trunc("day", "ts"), "epoch")


@query
def best_epoch(r: Registry) -> DataFrame:
    return history.best_epoch(_history(r))


@query
def checkpoints(r: Registry) -> DataFrame:
    return history.checkpoints(_history(r))


@query
def early_stop(r: Registry) -> DataFrame:
    return history.early_stop(_history(r), 5)


@query
def training_eta(r: Registry) -> DataFrame:
    out = history.eta(_history(r), 200)
    return out.select("run_id", "epoch", F.round("elapsed", 3).alias("elapsed"), F.round("eta_seconds", 3).alias("eta_seconds"))


@query
def throttle_breaches_daily(r: Registry) -> DataFrame:
    out = throttle_breaches(r.sign_in_attempts, decay=86_400.0)
    return out.select("id", "key", "refused")


# --------------------------------------------------------------------- values
@query
def corrections(r: Registry) -> DataFrame:
    ocr, verified = F.col("ocr_text"), F.col("verified_value")
    return r.record_fields.select(
        "id", V.normalise_value(verified).alias("normalised"), V.was_corrected(ocr, verified).alias("was_corrected"),
        V.differs_from_ocr(ocr, verified).alias("rate_corrected"),
        V.normalise_confidence(F.col("ocr_confidence")).alias("confidence"))


@query
def dirty_diff(r: Registry) -> DataFrame:
    """Line items before and after a price change, as diff maps."""
    line = r.table("lineitem").select(
        line_id().alias("id"),
        F.struct("l_returnflag", "l_linestatus", "l_linenumber").alias("old"),
        F.struct(F.lit("R").alias("l_returnflag"), "l_linestatus",
                 F.when(F.col("l_linenumber") > 3, None).otherwise(F.col("l_linenumber")).alias("l_linenumber")).alias("new"))
    before, after = V.dirty_diff("old", "new", ["l_returnflag", "l_linestatus", "l_linenumber"])
    return line.select(
        "id", F.size(before).alias("moved"), F.try_element_at(before, F.lit("l_returnflag")).alias("flag_before"),
        F.try_element_at(after, F.lit("l_returnflag")).alias("flag_after"),
        F.try_element_at(before, F.lit("l_linenumber")).alias("line_before"),
        F.try_element_at(after, F.lit("l_linenumber")).alias("line_after"))


@query
def filters_used(r: Registry) -> DataFrame:
    """The filter map of each record's own key values, empty entries dropped."""
    kept = V.compact_filters(F.create_map(
        F.lit("registry_number"), F.col("registry_number"), F.lit("status"), F.col("status"),
        F.lit("submitted_by"), F.col("submitted_by").cast("string")))
    return r.records.select("id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("filters"))


@query
def model_scores(r: Registry) -> DataFrame:
    return r.ocr_models.select(
        "key", V.percentage(1 - F.col("cer")).alias("characters"), V.percentage(F.col("wer") * 2 - 0.5).alias("clamped"),
        V.model_label(F.concat(F.lit("my_"), F.lower("label"), F.lit("-v2"))).alias("pretty"),
        V.evidence(F.col("evaluation_dataset"), F.col("evaluation_sample_count"), F.col("evaluated_at")).alias("evidence"))


@query
def person_metadata(r: Registry) -> DataFrame:
    raw = F.element_at(F.array(F.lit("2"), F.lit("  "), F.lit("0"), F.lit("x1"), F.lit("1.5")), (F.col("id") % 5 + 1).cast("int"))
    group, order = V.person_metadata(raw, F.col("person_field_order"))
    return r.template_fields.select("id", group.alias("person_group"), order.alias("person_field_order"))


@query
def paper_dimensions(r: Registry) -> DataFrame:
    args = [F.col(c) for c in ("paper_size", "orientation", "custom_width_mm", "custom_height_mm")]
    w, h = V.paper_dimensions(*args)
    k = F.col("id")
    return r.document_templates.select(
        "id", w.alias("width_mm"), h.alias("height_mm"), F.round(w / h, 6).alias("aspect"),
        V.paper_label(args[0], args[2], args[3]).alias("size_label"),
        V.paper_mismatch(k * 100.0, F.lit(1300.0), w, h, args[1]).alias("mismatch"))


@query
def safe_names(r: Registry) -> DataFrame:
    raw = F.concat(F.lit(" ../"), F.col("name"), F.lit("  (v1)?."))
    return r.template_fields.select(
        "id", V.sanitise_name(raw).alias("safe_name"),
        V.storage_path(F.col("document_template_id"), F.concat(F.col("name"), F.lit(" & Co_x")), F.col("id"), F.lit("##"), F.lit("pdf"))
        .alias("path"))


@query
def labels(r: Registry) -> DataFrame:
    return r.users.select(
        "id", V.role_label(F.col("role_slug")).alias("role"), V.initials(F.replace("name", F.lit("#"), F.lit(" "))).alias("initials"))


@query
def action_titles(r: Registry) -> DataFrame:
    return r.audit_logs.select("id", V.action_title(F.col("action")).alias("title"))


@query
def decoded_images(r: Registry) -> DataFrame:
    """Round trip of whole texts through data URLs."""
    url = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("text", "UTF-8")))
    return r.table("conversations").select(
        "conv_id", "turn", F.length(V.decode_data_url(url)).cast("long").alias("bytes"),
        (F.decode(V.decode_data_url(url), "UTF-8") == F.col("text")).alias("same"))
