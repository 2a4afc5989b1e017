"""Correction workflow over whole tables: open, approve, reject, withdraw, submit."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.functions import values as V
from docreg.functions.prefix import crowded, ranked, running

# --- fixed values -----------------------------------------------------------
NOTE_MIN, NOTE_MAX = 5, 2000
REQUESTED = "Requested %d change(s) on record #%s."
APPROVED = "Approved change request #%s and applied %d value(s)."
CLOSING_VERBS = {"rejected": "Rejected", "withdrawn": "Withdrew"}
REGISTRY_NUMBER = "Registry Number"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Opened:
    #: One row per proposal: proposal_id, record_id, outcome, detail, change_count.
    outcomes: DataFrame
    requests: DataFrame
    items: DataFrame


def registry_number_change(supplied: Column, proposed: Column, current: Column) -> tuple[Column, Column]:
    """(changes, new value): only a supplied value that differs after trimming is a change."""
    changes = F.coalesce(supplied, F.lit(False)) & ~V.normalise_value(proposed).eqNullSafe(V.normalise_value(current))
    return changes, F.when(changes, V.normalise_value(proposed))


def open_requests(records: DataFrame, fields: DataFrame, proposals: DataFrame, proposal_items: DataFrame,
                  requests: DataFrame) -> Opened:
    """Turn proposals into pending requests.

    proposals: proposal_id, record_id, reason, requested_by, created_at, registry_supplied, registry_number.
    proposal_items: proposal_id, record_field_id, value (unique per proposal and field).
    The record must be locked and free of pending requests; within the batch the first
    valid proposal of a record (created_at, proposal_id) wins.
    """
    state = records.select(
        F.col("id").alias("record_id"), F.col("status").alias("_status"), F.col("registry_number").alias("_current"))
    pending = requests.where(F.col("status") == "pending").select("record_id").distinct().withColumn("_pending", F.lit(True))
    current = fields.select(
        F.col("id").alias("record_field_id"), "record_id", F.col("name").alias("_name"),
        F.col("verified_value").alias("current_value"), "is_required", "sort_order")
    wanted = proposal_items.withColumn("proposed_value", V.normalise_value(F.col("value"))).drop("value")
    differs = ~F.col("proposed_value").eqNullSafe(V.normalise_value(F.col("current_value")))
    blank = F.coalesce(F.col("is_required") & F.col("proposed_value").isNull(), F.lit(False))

    def settle(asked: DataFrame, compared: DataFrame) -> DataFrame:
        # The record of a compared item is that of its field; items of other records fall away here.
        verdict = compared.groupBy("proposal_id", "record_id").agg(
            F.count_if(differs).alias("_changes"),
            F.min_by("_name", F.when(blank, F.struct("sort_order", "record_field_id"))).alias("_blank_field"),
            F.bool_or(blank).alias("_blank"),
        )
        changes, new_number = registry_number_change(
            F.col("registry_supplied"), F.col("registry_number"), F.col("_current"))
        judged = (
            asked.join(verdict, ["proposal_id", "record_id"], "left")
            .join(state, "record_id", "left").join(pending, "record_id", "left")
            .withColumn("_renumber", changes).withColumn("_number", new_number)
            .withColumn("_changes", F.coalesce("_changes", F.lit(0)))
        )
        outcome = (
            F.when(F.col("_status").isNull(), "unknown_record")
            .when(F.col("_status") != "submitted", "not_locked")
            .when(F.col("_pending"), "already_pending")
            .when(F.col("_blank"), "required_blank")
            .when((F.col("_changes") == 0) & ~F.col("_renumber"), "no_change")
            .otherwise("opened")
        )
        turn = F.struct("created_at", "proposal_id")
        judged = judged.withColumn("_outcome", outcome)
        winners = judged.where(F.col("_outcome") == "opened").groupBy("record_id").agg(F.min(turn).alias("_winner"))
        return judged.join(winners, "record_id", "left").withColumn(
            "outcome",
            F.when(F.col("_outcome").isin("unknown_record", "not_locked"), F.col("_outcome"))
            .when(turn > F.col("_winner"), F.lit("already_pending"))
            .otherwise(F.col("_outcome")),
        ).withColumn("change_count", (F.col("_changes") + F.col("_renumber").cast("int")).cast("long"))

    outcomes = settle(proposals, wanted.join(current, "record_field_id", "inner")).select(
        "proposal_id", "record_id", "outcome", F.col("_blank_field").alias("detail"), "change_count")

    # Only proposals on a locked record without a pending request can open; the items of the others stay behind.
    locked = state.where(F.col("_status") == "submitted").select("record_id").join(pending, "record_id", "left_anti")
    hopeful = proposals.join(locked, "record_id", "left_semi")
    compared = wanted.join(hopeful.select("proposal_id", "record_id"), "proposal_id", "inner").join(
        current, ["record_field_id", "record_id"], "inner")
    opened = settle(hopeful, compared).where(F.col("outcome") == "opened")
    new_requests = opened.select(
        "proposal_id", "record_id", F.lit("pending").alias("status"), "reason", "requested_by", "created_at",
        F.col("_renumber").alias("changes_registry_number"),
        F.when(F.col("_renumber"), F.col("_current")).alias("current_registry_number"),
        F.col("_number").alias("proposed_registry_number"), "change_count",
    )
    # An opened proposal has no blank item; asking again lets both readers of ``compared`` share one shuffle.
    new_items = (
        compared.where(differs & ~blank).join(opened.select("proposal_id"), "proposal_id", "left_semi")
        .select("proposal_id", "record_field_id", "current_value", "proposed_value")
    )
    return Opened(outcomes, new_requests, new_items)


@dataclass(frozen=True)
class Approved:
    #: One row per decision: request_id, outcome (approved / not_pending / required_blank / unknown_request).
    outcomes: DataFrame
    requests: DataFrame
    fields: DataFrame
    records: DataFrame
    #: One row per applied value: request_id, record_id, item_id, name, old_value, new_value.
    applied: DataFrame


def _first_decisions(decisions: DataFrame) -> DataFrame:
    """Only the first decision on a request counts; later ones find it closed."""
    rest = [c for c in decisions.columns if c != "request_id"]
    first = decisions.groupBy("request_id").agg(
        F.min_by(F.struct(*rest), F.struct("reviewed_at", "reviewer_id")).alias("_d"))
    return first.select("request_id", "_d.*")


def approve_requests(requests: DataFrame, items: DataFrame, fields: DataFrame, records: DataFrame,
                     decisions: DataFrame) -> Approved:
    """Apply approved requests. All of a request's values apply, or none.

    decisions: request_id, reviewer_id, reviewed_at, note. Where several approved
    requests move the same value, the last one (reviewed_at, request_id) stands.
    NULL is a legal new value.
    """
    first = _first_decisions(decisions)
    target = requests.select(
        F.col("id").alias("request_id"), "record_id", F.col("status").alias("_status"),
        "changes_registry_number", "proposed_registry_number")
    wanted = first.join(target, "request_id", "left")

    proposed = items.select(
        F.col("change_request_id").alias("request_id"), F.col("id").alias("item_id"), "record_field_id",
        V.normalise_value(F.col("proposed_value")).alias("new_value"))
    # Only an emptied value can block, so the other items wait until their request is settled.
    required = fields.where("is_required").select(F.col("id").alias("record_field_id"))
    blocked = proposed.where(F.col("new_value").isNull()).select("request_id", "record_field_id").join(
        required, "record_field_id", "inner").select("request_id").distinct()

    judged = wanted.join(blocked.withColumn("_blocked", F.lit(True)), "request_id", "left").withColumn(
        "outcome",
        F.when(F.col("_status").isNull(), "unknown_request")
        .when(F.col("_status") != "pending", "not_pending")
        .when(F.col("_blocked"), "required_blank")
        .otherwise("approved"),
    )
    approved = judged.where(F.col("outcome") == "approved")
    granted = approved.select("request_id", "record_id", "reviewed_at")

    moment = F.struct("reviewed_at", "request_id")
    final_values = proposed.join(granted, "request_id", "inner").groupBy(F.col("record_field_id").alias("id")).agg(
        F.max_by(F.struct("new_value"), moment).alias("_final"))
    new_fields = fields.join(final_values, "id", "left").select(*[
        F.when(F.col("_final").isNotNull(), F.col("_final.new_value")).otherwise(F.col(c)).alias(c)
        if c == "verified_value" else F.col(c) for c in fields.columns
    ])

    renumbering = approved.where("changes_registry_number")
    final_numbers = renumbering.groupBy(F.col("record_id").alias("id")).agg(
        F.max_by(F.struct("proposed_registry_number"), moment).alias("_final"))
    new_records = records.join(final_numbers, "id", "left").select(*[
        F.when(F.col("_final").isNotNull(), F.col("_final.proposed_registry_number")).otherwise(F.col(c)).alias(c)
        if c == "registry_number" else F.col(c) for c in records.columns
    ])

    verdicts = approved.select(
        F.col("request_id").alias("id"), F.struct("reviewer_id", "reviewed_at", "note").alias("_d"))
    new_requests = _decide(requests, verdicts, "approved")

    # The value an approval replaced: the one before it in the same batch, else the stored one.
    live = fields.select(F.col("id").alias("record_field_id"), "name", F.col("verified_value").alias("_now"))
    busy = crowded(items, "record_field_id")

    def step(chosen: Column, bucket: Column | None) -> DataFrame:
        applying = proposed.where(chosen).join(granted, "request_id", "inner").join(
            live.where(chosen), "record_field_id", "inner").withColumn("_step", F.struct("new_value"))
        return running(applying, ["record_field_id"], [F.col("reviewed_at"), F.col("request_id")],
                       bucket, {"_before": ("last", "_step")}, inclusive=False)

    # Only the fields with very many changes are followed day by day; the others are followed where they meet their field.
    stepped = step(~busy, None).unionByName(step(busy, F.date_trunc("day", "reviewed_at")))
    field_changes = stepped.select(
        "request_id", "record_id", "item_id", "name",
        F.when(F.col("_before").isNull(), F.col("_now")).otherwise(F.col("_before.new_value")).alias("old_value"),
        "new_value")
    stored = records.select(F.col("id").alias("record_id"), F.col("registry_number").alias("_now"))
    numbered = running(
        renumbering.withColumn("_step", F.struct("proposed_registry_number")), ["record_id"],
        [F.col("reviewed_at"), F.col("request_id")], F.date_trunc("day", "reviewed_at"),
        {"_before": ("last", "_step")}, inclusive=False).join(stored, "record_id", "left")
    number_changes = numbered.select(
        "request_id", "record_id", F.lit(None).cast(items.schema["id"].dataType).alias("item_id"),
        F.lit(REGISTRY_NUMBER).alias("name"),
        F.when(F.col("_before").isNull(), F.col("_now")).otherwise(F.col("_before.proposed_registry_number"))
        .alias("old_value"),
        F.col("proposed_registry_number").alias("new_value"))
    applied = field_changes.unionByName(number_changes)
    return Approved(judged.select("request_id", "outcome"), new_requests, new_fields, new_records, applied)


def _decide(requests: DataFrame, verdicts: DataFrame, status: str) -> DataFrame:
    """Requests with the verdict struct ``_d`` (reviewer_id, reviewed_at, note) written in."""
    hit = F.col("_d").isNotNull()
    written = {
        "status": F.lit(status), "reviewed_by": F.col("_d.reviewer_id"),
        "reviewed_at": F.col("_d.reviewed_at"), "decision_note": F.col("_d.note"),
    }
    base = requests if "decision_note" in requests.columns else requests.withColumn(
        "decision_note", F.lit(None).cast("string"))
    return base.join(verdicts, "id", "left").select(*[
        F.when(hit, written[c]).otherwise(F.col(c)).alias(c) if c in written else F.col(c) for c in base.columns
    ])


def reject_requests(requests: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, outcomes). A rejection needs a note of 5 to 2000 characters."""
    first = _first_decisions(decisions)
    target = requests.select(F.col("id").alias("request_id"), F.col("status").alias("_status"))
    judged = first.join(target, "request_id", "left").withColumn(
        "outcome",
        F.when(F.col("_status").isNull(), "unknown_request")
        .when(~F.coalesce(F.length(V.trim_ws(F.col("note"))).between(NOTE_MIN, NOTE_MAX), F.lit(False)), "note_length")
        .when(F.col("_status") != "pending", "not_pending")
        .otherwise("rejected"),
    )
    verdicts = judged.where(F.col("outcome") == "rejected").select(
        F.col("request_id").alias("id"), F.struct("reviewer_id", "reviewed_at", "note").alias("_d"))
    return _decide(requests, verdicts, "rejected"), judged.select("request_id", "outcome")


def withdraw_requests(requests: DataFrame, withdrawals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, outcomes). withdrawals: request_id, actor_id; only the requester may withdraw."""
    actors = withdrawals.groupBy("request_id", "actor_id").agg(F.lit(1).alias("_one"))
    target = requests.select(F.col("id").alias("request_id"), F.col("status").alias("_status"), "requested_by")
    judged = actors.join(target, "request_id", "left").withColumn(
        "outcome",
        F.when(F.col("_status").isNull(), "unknown_request")
        .when(~F.col("requested_by").eqNullSafe(F.col("actor_id")), "not_requester")
        .when(F.col("_status") != "pending", "not_pending")
        .otherwise("withdrawn"),
    )
    gone = judged.where(F.col("outcome") == "withdrawn").select(
        F.col("request_id").alias("id"), F.lit(True).alias("_gone"))
    moved = requests.join(gone, "id", "left").select(*[
        F.when(F.col("_gone"), F.lit("withdrawn")).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c)
        for c in requests.columns
    ])
    return moved, judged.select("request_id", "actor_id", "outcome")


def single_active(df: DataFrame, targets: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Publish the target ids: each becomes the only active row of its partition.

    Partitions without a target stay as they are. Without ``partition`` the whole table is one.
    """
    chosen = df.join(targets.select("id").distinct(), "id", "left_semi")
    if partition:
        touched = chosen.groupBy(*partition).agg(F.max("id").alias("_target"))
        marked = df.join(touched, partition, "left")
        target = F.col("_target")
    else:
        marked, target = df, chosen.agg(F.max("id")).scalar()
    return marked.select(*[
        F.when(target.isNotNull(), F.col("id") == target).otherwise(F.col(c)).alias(c) if c == "is_active" else F.col(c)
        for c in df.columns
    ])


def active_violations(df: DataFrame, partition: list[str]) -> DataFrame:
    """Partitions with more than one active row."""
    return df.where("is_active").groupBy(*partition).agg(F.count("*").alias("active_rows")).where("active_rows > 1")


def one_pending_per_record(requests: DataFrame) -> DataFrame:
    """Records with more than one pending request, and the one that came first."""
    return (
        requests.where(F.col("status") == "pending").groupBy("record_id")
        .agg(F.count("*").alias("pending"), F.min_by("id", F.struct("created_at", "id")).alias("first_request_id"))
        .where("pending > 1")
    )


def transition_check(requests: DataFrame) -> DataFrame:
    """Adds ``violations``: unknown status, decided without reviewer, or open with one."""
    status = F.col("status")
    decided, reviewed = status.isin("approved", "rejected"), F.col("reviewed_by").isNotNull()
    return requests.withColumn("violations", F.array_compact(F.array(
        F.when(~status.isin(*V.REQUEST_STATUSES), F.lit("status: unknown")),
        F.when(decided & ~reviewed, F.lit("reviewed_by: a decision needs a reviewer")),
        F.when(~decided & reviewed, F.lit("reviewed_by: not decided")),
    ))).withColumn("is_open", status == "pending")


def field_change_history(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Approved changes of each field, ranked newest first."""
    approved = requests.where(F.col("status") == "approved").select(
        F.col("id").alias("change_request_id"), "created_at", "requested_by", "reviewed_by", "reviewed_at")
    busy = crowded(items, "record_field_id")
    age = F.col("_age")

    def rank(part: DataFrame, bucket: Column | None) -> DataFrame:
        joined = part.select("change_request_id", "record_field_id", "current_value", "proposed_value").join(
            approved, "change_request_id", "inner").withColumn("_age", -F.unix_micros("created_at"))
        return ranked(joined, ["record_field_id"], [age, -F.col("change_request_id")], bucket, "newest").drop("_age")

    # Only the fields with very many changes are ranked day by day; the others are ranked where their rows are.
    return rank(items.where(~busy), None).unionByName(rank(items.where(busy), F.floor(age / 86_400_000_000)))


# ------------------------------------------------------------------ trail rows
def opened_audit(opened: Opened) -> DataFrame:
    n = F.col("change_count")
    return opened.requests.select(
        F.lit("change_request.opened").alias("action"), F.lit("ChangeRequest").alias("auditable_type"),
        F.col("proposal_id").alias("auditable_id"), F.col("requested_by").alias("user_id"),
        F.format_string(REQUESTED, n, F.col("record_id").cast("string")).alias("description"),
        F.lit(None).cast("map<string,string>").alias("old_values"),
        F.create_map(
            F.lit("record_id"), F.col("record_id").cast("string"),
            F.lit("field_count"), (n - F.col("changes_registry_number").cast("int")).cast("string"),
            F.lit("registry_number_changed"), F.col("changes_registry_number").cast("string"),
        ).alias("new_values"),
    )


def approved_entries(approved: Approved) -> DataFrame:
    """Applied values in long form: one row per request and name.

    Of two fields with one name the last item counts; the registry number comes last of all.
    """
    turn = F.struct(F.col("item_id").isNull(), F.col("item_id"))
    return approved.applied.groupBy("request_id", "record_id", "name").agg(
        F.max_by(F.struct("old_value", "new_value"), turn).alias("_v")
    ).select("request_id", "record_id", "name", "_v.*")


def approved_audit(approved: Approved) -> DataFrame:
    """One row per approval with before/after maps by field name, whatever its size.

    ``approved_entries`` holds the same values in long form. A map has no null key: fields without a name share the empty one.
    """
    # A request's values end in one row, so they go to its task at once: one shuffle for the entries, their list and the join.
    named = approved.applied.withColumn("name", F.coalesce("name", F.lit(""))).repartition("request_id")
    entries = approved_entries(replace(approved, applied=named))
    listed = entries.groupBy("request_id").agg(
        F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("name", "old_value", "new_value"))).alias("_e"))
    maps = listed.select("request_id", "_n", *[
        F.map_from_arrays("_e.name", f"_e.{side}").alias(side + "s") for side in ("old_value", "new_value")])
    # A request whose fields are all gone is approved too, with nothing applied.
    done = approved.outcomes.where(F.col("outcome") == "approved").select("request_id")
    who = approved.requests.select(
        F.col("id").alias("request_id"), F.col("record_id").alias("auditable_id"), F.col("reviewed_by").alias("user_id"))
    return (
        done.join(who, "request_id", "inner").join(maps, "request_id", "left").select(
            F.lit("change_request.approved").alias("action"), F.lit("Record").alias("auditable_type"),
            "auditable_id", "user_id",
            F.format_string(APPROVED,
                            F.col("request_id").cast("string"), F.coalesce("_n", F.lit(0))).alias("description"),
            "old_values", "new_values",
        )
    )


def closed_audit(requests: DataFrame, outcomes: DataFrame, kind: str) -> DataFrame:
    """Trail rows of rejected or withdrawn requests (``requests`` after the decision)."""
    verb = CLOSING_VERBS[kind]
    done = outcomes.where(F.col("outcome") == kind).select(F.col("request_id").alias("id")).distinct()
    note = F.col("decision_note") if kind == "rejected" else F.lit(None).cast("string")
    actor = F.col("reviewed_by") if kind == "rejected" else F.col("requested_by")
    return requests.join(done, "id", "left_semi").select(
        F.lit(f"change_request.{kind}").alias("action"), F.lit("ChangeRequest").alias("auditable_type"),
        F.col("id").alias("auditable_id"), actor.alias("user_id"),
        F.concat(
            F.lit(f"{verb} change request #"), F.col("id").cast("string"), F.lit("."),
            F.coalesce(F.concat(F.lit(" Reason: "), F.nullif(note, F.lit(""))), F.lit("")),
        ).alias("description"),
        F.lit(None).cast("map<string,string>").alias("old_values"),
        F.lit(None).cast("map<string,string>").alias("new_values"),
    )


def submitted_audit(records: DataFrame, fields: DataFrame, types: DataFrame) -> DataFrame:
    """Trail rows of submitted records with their field and correction counts."""
    n = fields.groupBy(F.col("record_id").alias("id")).agg(
        F.count("*").alias("_n"),
        F.count_if(V.was_corrected(F.col("ocr_text"), F.col("verified_value"))).alias("_c"))
    labels = types.select(F.col("id").alias("document_type_id"), "key", "name", "short_name")
    rows = (
        records.where(F.col("status") == "submitted").join(n, "id", "left").join(labels, "document_type_id", "left")
    )
    return rows.select(
        F.lit("record.submitted").alias("action"), F.lit("Record").alias("auditable_type"),
        F.col("id").alias("auditable_id"), F.col("submitted_by").alias("user_id"),
        F.concat(F.lit("Submitted and locked a "),
                 V.type_short_label(F.col("name"), F.col("short_name"), F.col("doc_type")), F.lit(" record."))
        .alias("description"),
        F.coalesce("key", "doc_type").alias("document_type"), "registry_number",
        F.coalesce("_n", F.lit(0)).cast("long").alias("field_count"),
        F.coalesce("_c", F.lit(0)).cast("long").alias("corrected_fields"),
        F.col("ocr_model_key").alias("ocr_model"),
    )
