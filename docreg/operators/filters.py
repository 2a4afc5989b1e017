"""Search and filter operators. A missing argument adds no predicate."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.functions import values as V
from docreg.operators.scope import REPORTING_TZ, Scope, date_bounds


def keep(df: DataFrame, conjuncts: list[Column]) -> DataFrame:
    return reduce(lambda frame, c: frame.where(c), conjuncts, df)


def of_type(df: DataFrame, types: DataFrame, key: str) -> DataFrame:
    """Rows whose document type has this key."""
    wanted = types.where(F.col("key") == key).select(F.col("id").alias("document_type_id"))
    return df.join(wanted, "document_type_id", "left_semi").select(*df.columns)


def report_filter(records: DataFrame, types: DataFrame, *, date_from: date | str | None = None,
                  date_to: date | str | None = None, doc_type: str | None = None, status: str | None = None,
                  submitted_by: int | None = None, tz: str = REPORTING_TZ) -> DataFrame:
    """Report rows: creation day in the reporting zone, type, status, submitter."""
    if status is not None and status not in V.RECORD_STATUSES:
        raise ValueError(f"unknown status {status!r}")
    conjuncts = date_bounds(F.col("created_at"), date_from, date_to, tz)
    if status is not None:
        conjuncts.append(F.col("status") == status)
    if submitted_by is not None:
        conjuncts.append(F.col("submitted_by") == submitted_by)
    out = keep(records, conjuncts)
    return of_type(out, types, doc_type) if doc_type is not None else out


def archive_search(records: DataFrame, fields: DataFrame, types: DataFrame, *, q: str | None = None,
                   doc_type: str | None = None, status: str | None = None, date_from: date | str | None = None,
                   date_to: date | str | None = None, literal: bool = True) -> DataFrame:
    """Substring of the registry number or of any verified value; UTC submission days."""
    out = keep(records, date_bounds(F.col("submitted_at"), date_from, date_to, "UTC"))
    if status:
        out = out.where(F.col("status") == status)
    if doc_type:
        out = of_type(out, types, doc_type)
    if q:
        # One id per matching record, deduplicated before it meets the records.
        hits = (
            fields.where(V.contains_text(F.col("verified_value"), q, literal))
            .groupBy(F.col("record_id").alias("id")).agg(F.lit(True).alias("_hit"))
        )
        number = F.coalesce(V.contains_text(F.col("registry_number"), q, literal), F.lit(False))
        out = out.join(hits, "id", "left").where(number | F.col("_hit").isNotNull()).select(*records.columns)
    return out


def audit_filter(audit: DataFrame, *, actor: int | None = None, action: str | None = None,
                 date_from: date | str | None = None, date_to: date | str | None = None,
                 q: str | None = None, literal: bool = True) -> DataFrame:
    """Trail entries; UTC days, term in the description or the actor's name."""
    conjuncts = date_bounds(F.col("created_at"), date_from, date_to, "UTC")
    if actor is not None:
        conjuncts.append(F.col("user_id") == actor)
    if action:
        conjuncts.append(F.col("action") == action)
    if q:
        conjuncts.append(V.contains_text(F.col("description"), q, literal)
                         | V.contains_text(F.col("actor_name"), q, literal))
    return keep(audit, conjuncts)


def user_search(users: DataFrame, roles: DataFrame, *, q: str | None = None, role: str | None = None,
                status: str | None = None, literal: bool = True) -> DataFrame:
    out = users
    if q:
        out = out.where(V.contains_text(F.col("name"), q, literal) | V.contains_text(F.col("email"), q, literal))
    if status:
        out = out.where(F.col("is_active") == F.lit(status == "active"))
    if role:
        wanted = roles.where(F.col("slug") == role).select(F.col("id").alias("role_id"))
        out = out.join(wanted, "role_id", "left_semi").select(*users.columns)
    return out


def visible_scope(requests: DataFrame, user_id: int, can_moderate: bool) -> DataFrame:
    """Moderators see every request, everybody else their own."""
    return requests if can_moderate else requests.where(F.col("requested_by") == user_id)


def request_search(requests: DataFrame, records: DataFrame, types: DataFrame, users: DataFrame, *,
                   user_id: int, can_moderate: bool, q: str | None = None, status: str | None = None,
                   literal: bool = True) -> DataFrame:
    """Queue search over reason, registry number, type names and, for digits, ids.

    Only moderators search requester names. An unknown status is ignored.
    """
    out = visible_scope(requests, user_id, can_moderate)
    if status in V.REQUEST_STATUSES:
        out = out.where(F.col("status") == status)
    term = (q or "").strip()
    if not term:
        return out

    def has(c: str) -> Column:
        return F.coalesce(V.contains_text(F.col(c), term, literal), F.lit(False))

    named = types.select(F.col("id").alias("document_type_id"), F.col("name").alias("_type"), "short_name")
    about = records.join(named, "document_type_id", "left").select(
        F.col("id").alias("record_id"), "registry_number", "_type", "short_name"
    )
    wide = out.alias("q").join(about.withColumn("_record", F.lit(True)), "record_id", "left")
    match = has("reason") | has("registry_number") | has("_type") | has("short_name")
    if term.isascii() and term.isdigit():
        number = F.lit(int(term))
        match = match | (F.col("q.id") == number) | (F.col("_record").isNotNull() & (F.col("record_id") == number))
    if can_moderate:
        people = users.select(F.col("id").alias("requested_by"), F.col("name").alias("_requester"))
        wide = wide.join(people, "requested_by", "left")
        match = match | has("_requester")
    return wide.where(match).select(*requests.columns)


def submitted_in_scope(records: DataFrame, scope: Scope) -> DataFrame:
    return records.where((F.col("status") == "submitted") & scope.contains(F.col("submitted_at")))


def needs_review(fields: DataFrame, threshold: float | Column) -> DataFrame:
    """Scored fields strictly below the threshold; unscored fields are never flagged."""
    return fields.where(F.col("ocr_confidence") < threshold)


def review_threshold(settings: DataFrame, default: float = 80.0) -> Column:
    """Stored threshold or the default, as a scalar subquery (safe on an empty table)."""
    stored = settings.agg(F.min_by("confidence_review_threshold", "id"))
    return F.coalesce(stored.scalar(), F.lit(default))


def data_entry_users(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Accounts that can appear as a submitter, by name."""
    wanted = roles.where(F.col("slug").isin("staff", "super_admin")).select(F.col("id").alias("role_id"))
    return users.join(wanted, "role_id", "left_semi").select("id", "name", "role_id").orderBy("name", "id")
