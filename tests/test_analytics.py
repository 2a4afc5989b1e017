from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from docreg.operators import analytics as A
from docreg.operators import filters, ordering, reports, trail
from docreg.operators.scope import Scope, date_bounds, last_twelve_months

NOW = datetime(2026, 8, 11, 4, 0, tzinfo=timezone.utc)
YEAR = last_twelve_months(NOW)


def ts(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def types(rows):
    return rows("id long, key string, name string, short_name string, is_system boolean",
                (1, "birth", "Birth Certificate", "Birth", True), (2, "death", "Death Certificate", "Death", True),
                (3, "permit", "Permit", None, False))


@pytest.fixture(scope="module")
def records(rows):
    schema = ("id long, doc_type string, document_type_id long, registry_number string, status string, ocr_model_key string, "
              "created_by long, submitted_by long, submitted_at timestamp, created_at timestamp")
    return rows(schema,
                (1, "birth", 1, "R-1", "submitted", "m", 1, 1, ts("2026-08-05 02:00:00"), ts("2026-08-05 01:00:00")),
                (2, "death", 2, "R-2", "submitted", "m", 1, 9, ts("2025-08-20 02:00:00"), ts("2025-08-20 01:00:00")),
                (3, "birth", 1, None, "draft", "m", 2, None, None, ts("2026-08-09 16:30:00")))


@pytest.fixture(scope="module")
def fields(rows):
    return rows("id long, record_id long, sort_order int, ocr_text string, verified_value string, ocr_confidence double",
                (1, 1, 0, "Ana Cruz", "Ana Cruz", 90.0), (2, 1, 1, "1 Jan 2001", "1 January 2001", 70.0),
                (3, 2, 1, None, "Ben", None), (4, 2, 0, None, "   ", None))


@pytest.fixture(scope="module")
def users(rows):
    return rows("id long, name string, email string, role_slug string, role_id long, is_active boolean",
                (1, "Nina", "nina@x", "staff", 1, True), (2, "Otto", "otto@x", "super_admin", 3, True),
                (3, "Lea", "lea@x", "super_admin", 3, False))


def test_scope_is_twelve_calendar_months():
    assert (YEAR.first, YEAR.last, YEAR.unit) == (date(2025, 9, 1), date(2026, 8, 11), "month")
    assert Scope(date(2026, 1, 1), date(2026, 3, 31)).daily
    assert not Scope(date(2026, 1, 1), date(2026, 4, 1)).daily


def test_headline_and_trend(records, types):
    assert tuple(A.headline(records, YEAR).first()) == (2, 1)
    totals = A.trend_totals(records, YEAR).orderBy("bucket").collect()
    assert (len(totals), totals[0].label, totals[-1].label) == (12, "Sep 2025", "Aug 2026")
    assert sum(t.total for t in totals) == 1
    series = A.record_trend(records, types, YEAR).collect()
    assert len(series) == 36 and sum(t.total for t in series) == 1
    assert {t.series for t in series} == {"Birth", "Death", "Permit"}
    assert A.growth_rate(A.trend_totals(records, YEAR)).first().growth_rate is None


def test_day_edge_follows_the_reporting_zone(rows, types):
    late = rows("id long, document_type_id long, status string, submitted_at timestamp",
                (1, 1, "submitted", ts("2026-07-31 16:00:00")), (2, 1, "submitted", ts("2026-07-31 15:59:59")))
    totals = {t.label: t.total for t in A.trend_totals(late, YEAR).collect()}
    assert (totals["Jul 2026"], totals["Aug 2026"]) == (1, 1)


def test_shares_list_every_type(records, types):
    got = A.records_by_type(records, types, YEAR).collect()
    assert [(r.key, r.total, r.share) for r in got] == [("birth", 1, 100.0), ("death", 0, 0.0), ("permit", 0, 0.0)]
    empty = A.records_by_type(records.where("false"), types, YEAR).collect()
    assert [r.share for r in empty] == [0.0, 0.0, 0.0]


def test_quality_golden(records, fields):
    q = A.ocr_quality(fields, records, YEAR, 80.0).first()
    assert (q.average_confidence, q.below_threshold, q.threshold_pass_rate, q.correction_rate) == (80.0, 1, 50.0, 50.0)
    none = A.ocr_quality(fields, records.where("false"), YEAR, 80.0).first()
    assert (none.confidence_fields, none.average_confidence, none.correction_rate) == (0, None, None)


def test_threshold_falls_back(rows, fields):
    settings = rows("id long, confidence_review_threshold double", (1, 95.0))
    assert filters.needs_review(fields, filters.review_threshold(settings)).count() == 2
    assert filters.needs_review(fields, filters.review_threshold(settings.where("false"))).count() == 1


def test_throughput_names_removed_accounts(records, users):
    got = A.throughput(records, users, Scope(date(2025, 1, 1), date(2026, 12, 31))).collect()
    assert [(r.name, r.role, r.total) for r in got] == [("Nina", "Staff", 1), ("Removed account", "Staff", 1)]


def test_report(records, fields, users, types):
    births = filters.report_filter(records, types, doc_type="birth", date_from="2026-08-05", date_to="2026-08-05")
    s = reports.report_summary(births, fields).first()
    assert tuple(s) == (1, 1, 0, 80.0)
    row = reports.report_rows(births, fields, users, types).first()
    assert (row.primary_value, row.fields, row.average_confidence, row.document_type) == ("Ana Cruz", 2, 80.0, "Birth Certificate")
    titles = {r.record_id: r.title for r in reports.record_title(fields).collect()}
    assert titles == {1: "Ana Cruz", 2: "Ben"}
    # 16:30 UTC is the next day in the reporting zone.
    assert filters.report_filter(records, types, date_from="2026-08-10").count() == 1


def test_bad_filters_are_refused(records, types):
    with pytest.raises(ValueError):
        filters.report_filter(records, types, date_from="2026-02-02", date_to="2026-02-01")
    with pytest.raises(ValueError):
        filters.report_filter(records, types, status="open")
    assert date_bounds(F.col("x"), None, None, "UTC") == []


def test_archive_search_looks_at_number_and_values(records, fields, types):
    def search(**kw):
        return sorted(r.id for r in filters.archive_search(records, fields, types, **kw).collect())

    assert search(q="ana cruz") == [1]
    assert search(q="r-2") == [2]
    assert search(q="BEN", status="submitted", doc_type="death") == [2]
    assert search(date_from="2026-08-05", date_to="2026-08-05") == [1]
    assert search() == [1, 2, 3]


def test_audit_pages_and_filters(rows):
    at = ts("2026-05-01 00:00:00")
    log = rows("id long, user_id long, actor_name string, action string, description string, created_at timestamp",
               *[(i, i % 2, "Nina" if i % 2 else "Otto", "a" if i else "b", "surname" if i == 7 else "x", at) for i in range(30)])
    first = ordering.paginate(log, ordering.newest_first(), 1, 25)
    second = ordering.paginate(log, ordering.newest_first(), 2, 25)
    assert [r.id for r in first.rows.collect()] == list(range(29, 4, -1))
    assert (second.rows.count(), tuple(first.info.first()), tuple(second.info.first())) == (5, (30, True), (30, False))
    assert filters.audit_filter(log, q="surname").count() == 1
    assert filters.audit_filter(log, q="nina").count() == 15
    assert filters.audit_filter(log, action="b").count() == 1
    assert filters.audit_filter(log, date_from="2026-05-02").count() == 0


def test_request_queue(rows, records, types, users):
    at = ts("2026-05-01 00:00:00")
    queue = rows("id long, record_id long, status string, reason string, requested_by long, created_at timestamp",
                 (10, 1, "approved", "Fix spelling", 1, at), (11, 2, "pending", "Wrong date", 2, at))

    def search(q, moderator=True, user=1):
        return [r.id for r in filters.request_search(queue, records, types, users, user_id=user, can_moderate=moderator, q=q).collect()]

    assert search("wrong") == [11] and search("death") == [11] and search("10") == [10] and search("2") == [11]
    assert search("otto") == [11] and search("otto", moderator=False, user=2) == []
    assert sorted(search("", moderator=False, user=1)) == [10]
    counts = {r.status: r.total for r in A.status_counts(filters.visible_scope(queue, 1, True)).collect()}
    assert counts == {"approved": 1, "pending": 1}
    assert [r.id for r in queue.orderBy(*ordering.queue_order()).collect()] == [11, 10]


def test_guard_and_states(users, rows):
    assert [r.is_last_active_admin for r in A.last_active_admin_guard(users).orderBy("id").collect()] == [False, True, False]
    boxes = rows("g string, verified boolean", ("a", True), ("a", False), ("b", True), ("c", False))
    got = {r.g: (r.checked, r.indeterminate) for r in A.verification_state(boxes, ["g"]).collect()}
    assert got == {"a": (False, True), "b": (True, False), "c": (False, False)}
    readings = rows("d int, ocr_confidence double", (1, None), (1, 90.0))
    assert tuple(A.review_summary(readings, 80.0, ["d"]).first()) == (1, 2, 45.0, 1)


def test_trail_rows(rows, users):
    log = rows("id long, user_id long, actor_name string, action string, created_at timestamp, old_values map<string,string>, new_values map<string,string>",
               (1, 1, None, "x", None, {"a": "1", "b": "2"}, {"a": "1", "c": "3"}), (2, None, None, "x", None, None, {"password": "p"}))
    got = trail.audit_diff_rows(trail.redacted_entries(log), users).collect()
    assert {(r.id, r.actor, r.key, r.before, r.after, r.changed) for r in got} == {
        (1, "Nina", "a", "1", "1", False), (1, "Nina", "b", "2", None, True), (1, "Nina", "c", None, "3", True),
        (2, "System", "password", None, "[redacted]", True)}


def test_seeking_page_by_page_equals_the_order(rows):
    log = rows("id int, a int, b string", *[(i, None if i % 5 == 0 else i % 3, None if i % 7 == 0 else "xyz"[i % 3]) for i in range(60)])
    for order in ([("a", False), ("id", False)], [("a", True), ("b", False), ("id", True)]):
        whole = [r.id for r in ordering.seek(log, order, None, 60).collect()]
        paged, last = [], None
        while page := ordering.seek(log, order, last, 17).collect():
            paged += [r.id for r in page]
            last = page[-1].asDict()
        assert paged == whole and sorted(whole) == list(range(60))


def test_own_recent_activity(rows):
    log = rows("id int, user_id int, created_at timestamp", *[(i, i % 2, datetime(2024, 1, 1 + i // 2)) for i in range(20)])
    assert [r.id for r in ordering.own_recent_activity(log, 1).collect()] == [19, 17, 15, 13, 11, 9]


def test_fields_of_an_only_request_are_counted_there(rows, monkeypatch):
    import random

    from docreg.functions import prefix
    rng = random.Random(4)
    requests = [(n, rng.choice([None, *range(8)]), rng.choice(["approved", "approved", "pending"]), rng.random() < .2) for n in range(25)]
    items = [(rng.choice([None, *range(28)]), rng.choice([None, *(f"f{i}" for i in range(9))])) for _ in range(400)]
    fields = [(n % 6, None, "v") for n in range(20)]
    want = {}
    for record in range(9):
        mine = {q[0]: q[3] for q in requests if q[1] == record and q[2] == "approved"}
        want[record] = len({f for q, f in items if q in mine and f is not None}) + any(mine.values())
    only = [r for r in range(9) if sum(q[1] == r and q[2] == "approved" for q in requests) == 1]
    assert only and len(set(want.values())) > 2
    tables = (rows("id long", *[(r,) for r in range(9)]), rows("record_id long, ocr_text string, verified_value string", *fields),
              rows("change_request_id long, record_field_id string", *items),
              rows("id long, record_id long, status string, changes_registry_number boolean", *requests))
    for crowd in (100_000, 15, -100):
        monkeypatch.setattr(prefix, "_CROWD", crowd)
        df = A.record_detail_counts(*tables)
        assert {r.id: r.post_submission_changes for r in df.collect()} == want
    import re
    plan = A.record_detail_counts(*tables)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(record_id#\d+L, record_field_id#", plan)
