from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from docreg.functions import prefix
from docreg.operators import workflow as W
from docreg.plans.oracle import ORACLE
from docreg.plans.queries import QUERIES

T0 = datetime(2026, 5, 1)
REQUEST = ("id long, record_id long, status string, changes_registry_number boolean, proposed_registry_number string, "
           "requested_by long, reviewed_by long, reviewed_at timestamp, created_at timestamp")


@pytest.fixture(scope="module")
def records(rows):
    return rows("id long, status string, registry_number string", (1, "submitted", "R-1"), (2, "draft", None), (3, "submitted", "R-3"))


@pytest.fixture(scope="module")
def fields(rows):
    return rows("id long, record_id long, name string, verified_value string, is_required boolean, sort_order int",
                (11, 1, "Wife Full Name", "Mana Santos", True, 0), (12, 1, "Remarks", "none", False, 1),
                (31, 3, "Name", "Ben", True, 0))


@pytest.fixture(scope="module")
def nothing(rows):
    return rows(REQUEST, (99, 77, "rejected", False, None, 1, 1, T0, T0))


def opened(rows, records, fields, requests, proposal, items):
    proposals = rows("proposal_id long, record_id long, reason string, requested_by long, created_at timestamp, "
                     "registry_supplied boolean, registry_number string", *proposal)
    values = rows("proposal_id long, record_field_id long, value string", *items)
    return W.open_requests(records, fields, proposals, values, requests)


def outcomes(o):
    return {r.proposal_id: r.outcome for r in o.outcomes.collect()}


def test_open_rules(rows, records, fields, nothing):
    o = opened(rows, records, fields, nothing, [
        (1, 1, "reason long", 5, T0, False, None), (2, 2, "r", 5, T0, True, "X"), (3, 3, "r", 5, T0, True, " R-3 "),
        (4, 3, "r", 5, datetime(2026, 5, 2), False, None), (5, 404, "r", 5, T0, False, None)],
        [(1, 11, " Maria Santos "), (1, 12, "none "), (1, 999, "ignored"), (1, 31, "not of this record"), (2, 11, "x"), (4, 31, "  ")])
    assert outcomes(o) == {1: "opened", 2: "not_locked", 3: "no_change", 4: "required_blank", 5: "unknown_record"}
    assert [tuple(r) for r in o.items.collect()] == [(1, 11, "Mana Santos", "Maria Santos")]
    assert o.requests.first().change_count == 1
    assert {r.proposal_id: r.detail for r in o.outcomes.collect()}[4] == "Name"
    log = W.opened_audit(o).first()
    assert log.description == "Requested 1 change(s) on record #1."
    assert log.new_values == {"record_id": "1", "field_count": "1", "registry_number_changed": "false"}


def test_optional_value_may_be_cleared_and_number_may_change(rows, records, fields, nothing):
    o = opened(rows, records, fields, nothing, [(1, 1, "r", 5, T0, True, "")], [(1, 12, " ")])
    assert [r.proposed_value for r in o.items.collect()] == [None]
    r = o.requests.first()
    assert (r.changes_registry_number, r.current_registry_number, r.proposed_registry_number, r.change_count) == (True, "R-1", None, 2)


def test_only_one_pending_request(rows, records, fields):
    waiting = rows(REQUEST, (50, 1, "pending", False, None, 1, None, None, T0))
    later = datetime(2026, 5, 2)
    o = opened(rows, records, fields, waiting, [(1, 1, "r", 5, T0, True, "Z"), (2, 3, "r", 5, later, True, "A"), (3, 3, "r", 5, T0, True, "B")], [(1, 12, "x")])
    assert outcomes(o) == {1: "already_pending", 2: "already_pending", 3: "opened"}


def approve(rows, records, fields, requests, items, *decisions):
    q = rows(REQUEST, *requests)
    i = rows("id long, change_request_id long, record_field_id long, current_value string, proposed_value string", *items)
    d = rows("request_id long, reviewer_id long, reviewed_at timestamp, note string", *decisions)
    return W.approve_requests(q, i, fields, records, d)


def test_approval_applies_all_or_nothing(rows, records, fields):
    a = approve(rows, records, fields,
                [(1, 1, "pending", True, "N-1", 5, None, None, T0), (2, 3, "pending", False, None, 5, None, None, T0),
                 (3, 1, "rejected", False, None, 5, None, None, T0)],
                [(1, 1, 11, "", " Maria "), (2, 1, 12, "", None), (3, 1, 404, "", "gone"), (4, 2, 31, "", "  "), (5, 3, 11, "", "no")],
                (1, 7, T0, "ok"), (2, 7, T0, None), (3, 7, T0, None), (4, 7, T0, None))
    assert {r.request_id: r.outcome for r in a.outcomes.collect()} == {
        1: "approved", 2: "required_blank", 3: "not_pending", 4: "unknown_request"}
    assert {r.id: r.verified_value for r in a.fields.collect()} == {11: "Maria", 12: None, 31: "Ben"}
    assert {r.id: r.registry_number for r in a.records.collect()} == {1: "N-1", 2: None, 3: "R-3"}
    done = {r.id: (r.status, r.reviewed_by, r.decision_note) for r in a.requests.collect()}
    assert done == {1: ("approved", 7, "ok"), 2: ("pending", None, None), 3: ("rejected", None, None)}
    log = W.approved_audit(a).first()
    assert log.description == "Approved change request #1 and applied 3 value(s)."
    assert log.old_values == {"Wife Full Name": "Mana Santos", "Remarks": "none", "Registry Number": "R-1"}
    assert log.new_values == {"Wife Full Name": "Maria", "Remarks": None, "Registry Number": "N-1"}


def test_approval_of_many_fields_keeps_its_values(rows, records, fields):
    fresh = [(1000 + i, 1, f"field {i}") for i in range(500)]
    wide = fields.unionByName(rows("id long, record_id long, name string", *fresh), allowMissingColumns=True)
    a = approve(rows, records, wide, [(1, 1, "pending", False, None, 5, None, None, T0)],
                [(i, 1, n[0], "", f"v{i}") for i, n in enumerate(fresh)], (1, 7, T0, None))
    log = W.approved_audit(a).first()
    assert log.description == "Approved change request #1 and applied 500 value(s)."
    assert log.old_values == {n[2]: None for n in fresh}
    assert log.new_values == {n[2]: f"v{i}" for i, n in enumerate(fresh)}
    assert W.approved_entries(a).count() == 500


def test_last_approval_stands_and_null_is_a_value(rows, records, fields):
    a = approve(rows, records, fields,
                [(1, 1, "pending", False, None, 5, None, None, T0), (2, 1, "pending", False, None, 5, None, None, T0)],
                [(1, 1, 12, "", "first"), (2, 2, 12, "", " ")],
                (1, 7, T0, None), (2, 7, datetime(2026, 5, 3), None), (1, 8, datetime(2026, 5, 9), "too late"))
    assert {r.id: r.verified_value for r in a.fields.collect()}[12] is None
    steps = {r.request_id: (r.old_value, r.new_value) for r in a.applied.collect()}
    assert steps == {1: ("none", "first"), 2: ("first", None)}


def test_reject_and_withdraw(rows):
    q = rows(REQUEST, *[(i, i, s, False, None, 5, None, None, T0) for i, s in enumerate(["pending", "pending", "approved", "pending"])])
    d = rows("request_id long, reviewer_id long, reviewed_at timestamp, note string",
             (0, 7, T0, "wrong person"), (1, 7, T0, " no "), (2, 7, T0, "wrong person"))
    moved, result = W.reject_requests(q, d)
    assert {r.request_id: r.outcome for r in result.collect()} == {0: "rejected", 1: "note_length", 2: "not_pending"}
    assert {r.id: r.status for r in moved.collect()} == {0: "rejected", 1: "pending", 2: "approved", 3: "pending"}
    assert W.closed_audit(moved, result, "rejected").first().description == "Rejected change request #0. Reason: wrong person"
    w = rows("request_id long, actor_id long", (0, 5), (1, 6), (2, 5))
    moved, result = W.withdraw_requests(q, w)
    assert {r.request_id: r.outcome for r in result.collect()} == {0: "withdrawn", 1: "not_requester", 2: "not_pending"}
    assert W.closed_audit(moved, result, "withdrawn").first().description == "Withdrew change request #0."


def test_single_active(rows):
    t = rows("id long, document_type_id long, is_active boolean", (1, 1, True), (2, 1, False), (3, 2, True), (4, 2, True))
    target = rows("id long", (2,))
    assert {r.id: r.is_active for r in W.single_active(t, target, ["document_type_id"]).collect()} == {1: False, 2: True, 3: True, 4: True}
    assert {r.id: r.is_active for r in W.single_active(t, target).collect()} == {1: False, 2: True, 3: False, 4: False}
    assert [tuple(r) for r in W.active_violations(t, ["document_type_id"]).collect()] == [(2, 2)]


def test_pending_twice_and_transitions(rows):
    q = rows(REQUEST, (1, 1, "pending", False, None, 5, None, None, T0), (2, 1, "pending", False, None, 5, None, None, T0),
             (3, 2, "approved", False, None, 5, None, None, T0), (4, 2, "odd", False, None, 5, None, None, T0))
    assert [tuple(r) for r in W.one_pending_per_record(q).collect()] == [(1, 2, 1)]
    got = {r.id: (r.is_open, len(r.violations)) for r in W.transition_check(q).collect()}
    assert got == {1: (True, 0), 2: (True, 0), 3: (False, 1), 4: (False, 1)}


def test_submitted_row(rows, records):
    r = rows("id long, status string, document_type_id long, doc_type string, submitted_by long, registry_number string, ocr_model_key string",
             (1, "submitted", None, "birth", 5, "R", "m"), (2, "draft", None, "birth", 5, "R", "m"))
    f = rows("record_id long, ocr_text string, verified_value string", (1, None, "x"), (1, "a", "a "))
    types = rows("id long, key string, name string, short_name string", (1, "death", "Death", None))
    row = W.submitted_audit(r, f, types).collect()
    assert [(x.description, x.field_count, x.corrected_fields) for x in row] == [("Submitted and locked a Birth record.", 2, 1)]


def test_history_of_a_hot_field_and_of_others(rows, monkeypatch):
    monkeypatch.setattr(prefix, "_CROWD", 20)
    q = rows(REQUEST, *[(i, 1, "approved", False, None, 5, 7, T0, T0 + timedelta(hours=i // 2)) for i in range(100)])
    i = rows("id long, change_request_id long, record_field_id long, current_value string, proposed_value string",
             *[(k, k, 11, "", f"v{k}") for k in range(100)], *[(200 + k, k, 12 + k % 5, "", "w") for k in range(30)])
    got = {(r.record_field_id, r.change_request_id): r.newest for r in W.field_change_history(i, q).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 11} == {k: 100 - k for k in range(100)}
    assert {k[1]: v for k, v in got.items() if k[0] == 12} == {25: 1, 20: 2, 15: 3, 10: 4, 5: 5, 0: 6}
    assert len(got) == 130


def test_approvals_of_a_hot_field_follow_each_other(rows, records, fields, monkeypatch):
    monkeypatch.setattr(prefix, "_CROWD", 5)
    n = 12
    a = approve(rows, records, fields,
                [(k, 1, "pending", False, None, 5, None, None, T0) for k in range(n)],
                [*[(k, k, 12, "", f"v{k}") for k in range(n)], (100, 3, 11, "", "Maria")],
                *[(k, 7, T0 + timedelta(hours=9 * k), None) for k in range(n)])
    steps = {r.item_id: (r.old_value, r.new_value) for r in a.applied.collect()}
    assert steps == {**{k: (f"v{k - 1}" if k else "none", f"v{k}") for k in range(n)}, 100: ("Mana Santos", "Maria")}
    assert {r.id: r.verified_value for r in a.fields.collect()} == {11: "Maria", 12: "v11", 31: "Ben"}


def test_items_that_cannot_open_stay_behind(rows, records, fields, nothing):
    """The items are read once and meet only proposals that may open; nothing is compared for drafts."""
    o = opened(rows, records, fields, nothing, [(1, 1, "r", 5, T0, False, None), (2, 2, "r", 5, T0, True, "X")],
               [(1, 11, "Maria"), (1, 12, "none"), (2, 12, "x")])
    assert [tuple(r) for r in o.items.collect()] == [(1, 11, "Mana Santos", "Maria")]
    plan = o.items._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan


def test_nameless_fields_share_the_empty_key(rows, records):
    fields = rows("id long, record_id long, name string, verified_value string, is_required boolean, sort_order int",
                  (11, 1, None, "one", False, 0), (12, 1, "", "two", False, 1), (13, 1, None, "three", False, 2))
    a = approve(rows, records, fields, [(1, 1, "pending", False, None, 5, None, None, T0)],
                [(1, 1, 11, "", "1"), (2, 1, 12, "", "2"), (3, 1, 13, "", None)], (1, 7, T0, None))
    log = W.approved_audit(a).first()
    assert log.description == "Approved change request #1 and applied 1 value(s)."
    assert (log.old_values, log.new_values) == ({"": "three"}, {"": None})


def test_registered_audit_carries_the_values(spark, rows, tmp_path):
    orders = rows("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz",
                  (12, 7, "F", T0), (4, 8, "F", T0))
    # Of record 12 the second field may be emptied and the third has no name; the only field of record 4 is gone.
    lines = rows("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string",
                 (12, 20, 2, 1, 5.0, "A"), (12, 22, 8, 2, 6.0, "R"), (12, 23, 3, None, 7.0, "A"), (4, 34, 3, 1, 5.0, "A"))
    con = duckdb.connect()
    for name, df in (("orders", orders), ("lineitem", lines)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    log = QUERIES["approved_audit"](spark, str(tmp_path))
    said = {r.description: (r.auditable_id, r.user_id, r.old_values, r.new_values) for r in log.collect()}
    assert said == {
        "Approved change request #24 and applied 4 value(s).": (
            12, 7, '{"":"part 23","Field 1":"part 20","Field 2":"part 22","Registry Number":"R-12"}',
            '{"":"part 23","Field 1":"part 20","Field 2":"part 22","Registry Number":null}'),
        "Approved change request #25 and applied 4 value(s).": (
            12, 7, '{"":"part 23","Field 1":"part 20","Field 2":"part 22","Registry Number":null}',
            '{"":"part 24","Field 1":"part 21","Field 2":null,"Registry Number":null}'),
        "Approved change request #8 and applied 0 value(s).": (4, 8, None, None),
        "Approved change request #9 and applied 0 value(s).": (4, 8, None, None),
    }
    sql = con.execute(f"SELECT auditable_id, user_id, old_values, new_values FROM ({ORACLE['approved_audit']})").fetchall()
    assert sorted(sql, key=repr) == sorted(said.values(), key=repr)
