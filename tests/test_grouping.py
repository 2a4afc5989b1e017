import pytest
from pyspark.sql import functions as F

from docreg.operators import grouping as G
from docreg.operators import joins, quality

FIELD = ("id long, record_id long, name string, ocr_text string, verified_value string, person_group int, person_field_order int, "
         "x double, y double, width double, height double, sort_order int")


def register(record, ys, columns=((.05, .08), (.18, .45), (.68, .08)), height=.05, start=0, first=0):
    out = []
    for r, y in enumerate(ys):
        for c, (x, w) in enumerate(columns):
            n = start + len(out)
            value = str(r + 1) if c == 0 else (f"Legacy Person {r + 1}" if c == 1 else "F")
            out.append((record * 1000 + n, record, f"f{n}", None, value, None, None, x, y, w, height, first + len(out)))
    return out


def groups(df, record=1):
    found = {}
    for r in df.where(F.col("record_id") == record).orderBy("number", "position").collect():
        found.setdefault((r.group_id, r.label), []).append(r.field_id - record * 1000)
    return found


def test_three_rows_make_three_people(rows):
    f = rows(FIELD, *register(1, [.20, .35, .50]))
    want = {("person-1", "Person 01"): [0, 1, 2], ("person-2", "Person 02"): [3, 4, 5], ("person-3", "Person 03"): [6, 7, 8]}
    assert groups(G.field_groups(f)) == want
    assert groups(G.field_groups_workspace(f)) == want
    names = {r.number: r.identity for r in G.group_summary(G.field_groups(f), f).collect()}
    assert names == {1: "Legacy Person 1", 2: "Legacy Person 2", 3: "Legacy Person 3"}


def test_two_short_rows_are_no_register_but_two_wide_ones_are(rows):
    wide = [(.02 + .15 * i, .1) for i in range(6)]
    f = rows(FIELD, *register(1, [.2, .4]), *register(2, [.2, .4], wide))
    got = G.field_groups_inferred(f)
    assert groups(got) == {("record-details", "Record details"): list(range(6))}
    assert {k[0]: len(v) for k, v in groups(got, 2).items()} == {"person-1": 6, "person-2": 6}


def test_heading_and_loose_box_go_to_details(rows):
    data = register(1, [.30, .45, .60], first=2)
    title = (1900, 1, "title", None, "Register", None, None, .3, .05, .4, .05, 0)
    unplaced = (1901, 1, "note", None, "x", None, None, None, None, None, None, 1)
    f = rows(FIELD, title, unplaced, *data)
    got = groups(G.field_groups_inferred(f))
    assert got[("document-details", "Document details")] == [900, 901]
    assert len(got) == 4


def test_row_tolerance_follows_median_height(rows):
    # 0.58 of the height 0.05 is 0.029: boxes 0.028 apart share a row, 0.06 apart do not.
    tilted = [(1000 + i, 1, "n", None, "v", None, None, .1 + .3 * (i % 3), y + .028 * (i % 2), .2, .05, i)
              for i, y in enumerate([.1] * 3 + [.3] * 3 + [.5] * 3)]
    assert len(groups(G.field_groups_inferred(rows(FIELD, *tilted)))) == 3
    apart = [(1000 + i, 1, "n", None, "v", None, None, .1 + .3 * (i % 3), y + .06 * (i % 2), .2, .05, i)
             for i, y in enumerate([.1] * 3 + [.3] * 3 + [.5] * 3)]
    assert groups(G.field_groups_inferred(rows(FIELD, *apart))) == {("record-details", "Record details"): list(range(9))}


def test_workspace_keeps_the_longest_run(rows):
    # Three rows, a wide gap, then four rows: the archive rule takes all, the workspace rule the longer run.
    f = rows(FIELD, *register(1, [.02, .08, .14, .50, .56, .62, .68]))
    assert sum(k[0].startswith("person") for k in groups(G.field_groups_inferred(f))) == 7
    ws = groups(G.field_groups_workspace(f))
    assert sum(k[0].startswith("person") for k in ws) == 4
    assert ws[("document-details", "Document details")] == list(range(9))
    assert ws[("person-1", "Person 01")] == [9, 10, 11]


def test_stray_columns_need_three_quarters_aligned(rows):
    shifted = [(.05, .08), (.40, .05), (.90, .05)]
    f = rows(FIELD, *register(1, [.1, .2, .3]), *register(1, [.5], shifted, start=9, first=9))
    got = groups(G.field_groups_inferred(f))
    assert got[("document-details", "Document details")] == [9, 10, 11]


def test_small_documents_agree_with_the_python_path(rows, spark):
    """The shortcut below nine boxes gives what the geometry step would give."""
    data = register(1, [.5, .2]) + register(2, [.1])
    f = rows(FIELD, *data)
    for workspace in (False, True):
        quick = {(r.field_id, r.label, r.position) for r in G.field_groups_inferred(f, workspace).collect()}
        slow = set()
        import numpy as np
        for rec in (1, 2):
            mine = sorted([d for d in data if d[1] == rec], key=lambda d: d[11])
            number, position, found = G._place(np.array([d[7:11] for d in mine]), workspace)
            assert not found and not number.any()
            slow |= {(d[0], "Record details", int(p)) for d, p in zip(mine, position)}
        assert quick == slow


def test_register_above_the_limit_keeps_its_people(rows):
    f = rows(FIELD, *register(1, [i * .1 for i in range(200)]), *register(2, [.2, .35, .5]))
    for got in (G.field_groups(f), G.field_groups_workspace(f)):
        people = groups(got)
        assert len(people) == 200 and people[("person-200", "Person 200")] == [597, 598, 599]
        assert len(groups(got, 2)) == 3


def test_a_document_cut_by_batch_edges_is_put_together():
    import pandas as pd
    data = pd.DataFrame([(d[1], d[0], d[11], *d[7:11]) for rec, ys in ((1, [.2, .3, .4]), (2, [.1 * i for i in range(20)]), (3, [.2, .5, .8]))
                         for d in register(rec, ys)], columns=["record_id", "field_id", "sort_order", "x", "y", "width", "height"])
    whole = pd.concat(G._infer(False)(iter([data])), ignore_index=True)
    assert whole.groupby("record_id").number.max().to_dict() == {1: 3, 2: 20, 3: 3}
    for size in (1, 4, 7, 9, 30):
        parts = (data.iloc[i:i + size].reset_index(drop=True) for i in range(0, len(data), size))
        assert pd.concat(G._infer(False)(parts), ignore_index=True).equals(whole)


def test_registered_grouping_queries_return_people(spark):
    import os
    import __spark_entry__ as entry
    root = os.environ.get("DOCREG_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(root):
        pytest.skip("no test data")
    for name in ("field_groups", "field_groups_inferred", "field_groups_workspace"):
        df = entry.queries()[name](spark, root)
        kinds = {r.kind: r["count"] for r in df.groupBy("kind").count().collect()}
        assert kinds["person"] > 100, (name, kinds)
        assert df.count() == spark.read.parquet(f"{root}/lineitem.parquet").count()
        print(name, kinds, df.groupBy("record_id").count().agg(F.max("count")).first())


def test_documents_above_the_limit_keep_every_field(rows):
    f = rows(FIELD, *register(1, [i / 200 for i in range(152)]), *register(2, [.2, .35, .5]))
    got = G.field_groups(f)
    assert got.count() == 456 + 9
    people = groups(got)
    assert sorted(i for places in people.values() for i in places) == list(range(456))
    assert len(people) > 1 and all(kind.startswith("person-") for kind, _ in people)
    assert len(groups(got, 2)) == 3


def test_many_documents_across_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        f = rows(FIELD, *[x for rec in range(1, 30) for x in register(rec, [.2, .35, .5])])
        got = G.field_groups(f).groupBy("record_id").agg(F.countDistinct("group_id").alias("n"), F.count("*").alias("m")).collect()
        assert len(got) == 29 and all((r.n, r.m) == (3, 9) for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture(scope="module")
def stored(rows):
    return rows(FIELD,
                (1001, 1, "b", None, "1", 1, 1, 0., 0., .5, .1, 0), (1002, 1, "a", None, "Ana Cruz", 1, 0, 0., 0., .2, .1, 1),
                (1003, 1, "c", "x", "2", 2, None, 0., 0., .5, .1, 2), (1004, 1, "d", None, "p. 7", None, None, 0., 0., .5, .1, 3),
                (2001, 2, "e", None, "1", 1, 0, 0., 0., .5, .1, 0), (2002, 2, "e", None, "2", 2, 0, 0., 0., .5, .1, 1),
                (3001, 3, "e", None, "x", None, None, 0., 0., .5, .1, 0))


def test_stored_groups(stored):
    assert groups(G.field_groups(stored)) == {
        ("document-details", "Document details"): [4], ("person-1", "Person 01"): [2, 1], ("person-2", "Person 02"): [3]}
    s = {(r.record_id, r.number): (r.identity, r.corrected_count) for r in G.group_summary(G.field_groups(stored), stored).collect()}
    assert s[1, 1] == ("Ana Cruz", 2) and s[1, 2] == ("1 verified fields", 1) and s[1, 0] == (None, 1)
    assert {r.record_id: r.person_count for r in G.person_counts(G.field_groups(stored)).collect()} == {1: 2, 2: 2}


def test_headings(rows, stored):
    r = rows("id long, document_type_id long, doc_type string, registry_number string",
             (1, None, "death", "R"), (2, None, "birth", "R"), (3, None, "custom", None), (4, None, "custom", "R-4"))
    types = rows("id long, name string, short_name string", (1, "n", None))
    got = {x.id: x.heading for x in G.record_headings(r, types, G.field_groups(stored), stored).collect()}
    assert got == {1: "Death · 2 people", 2: "Birth · Entries 1–2", 3: "Custom record #3", 4: "R-4"}


def test_eleven_field_identity(rows):
    f = rows(FIELD, *[(1000 + i, 1, "n", None, "Third" if i == 2 else "Widest value here", 1, i, 0., 0., .9 if i == 5 else .1, .1, i) for i in range(11)])
    assert G.group_summary(G.field_groups(f), f).first().identity == "Third"


def test_canonical_groups(rows):
    t = rows("id long, grouping_mode string", (1, "custom"), (2, "auto"))
    f = rows("id long, document_template_id long, person_group int, person_field_order int, sort_order int",
             (1, 1, 7, 9, 0), (2, 1, 7, 2, 1), (3, 1, 3, None, 2), (4, 1, None, 4, 3), (5, 2, 1, 1, 0))
    got = {r.id: (r.person_group, r.person_field_order) for r in G.canonicalize_groups(f, t).collect()}
    assert got == {1: (2, 1), 2: (2, 0), 3: (1, 0), 4: (None, 4), 5: (None, None)}


def test_group_selected(rows):
    b = rows("document_id long, index int, x double, y double, person_group int, person_field_order int",
             (1, 0, .5, .1, 3, 0), (1, 1, .4, .9, None, None), (1, 2, .4, .1, None, None), (2, 0, .1, .1, None, None))
    got = {(r.document_id, r["index"]): (r.person_group, r.person_field_order)
           for r in G.group_selected(b, rows("document_id long, index int", (1, 1), (1, 2), (2, 0))).collect()}
    assert got == {(1, 0): (3, 0), (1, 1): (4, 1), (1, 2): (4, 0), (2, 0): (1, 0)}


def test_copy_names(rows):
    existing = rows("document_template_id long, name string", (1, "Name"), (1, "name COPY"), (2, "x"), *[(3, f"n{i}") for i in range(450)])
    copies = rows("document_template_id long, position int, name string", (1, 0, "Name"), (1, 1, "Name"), (1, 2, "  "), (2, 0, "a" * 500), (3, 0, "n0"))
    got = {(r.document_template_id, r.position): r.copy_name for r in G.copy_names(existing, copies).collect()}
    assert got == {(1, 0): "Name copy 2", (1, 1): "Name copy 3", (1, 2): "Field copy", (2, 0): "a" * 495 + " copy", (3, 0): "n0 copy"}


def test_copy_names_against_counting_up(rows):
    taken = ["N copy", "n copy 3", "N COPY 4", "N copy 04", "n copy 9", "N copy copy", "M copy 2"]
    names = ["N"] * 6 + ["n", " N ", "M", "M", "N copy", "M copy"]
    got = {r.position: r.copy_name for r in G.copy_names(
        rows("document_template_id long, name string", *[(1, n) for n in taken]),
        rows("document_template_id long, position int, name string", *[(1, i, n) for i, n in enumerate(names)])).collect()}
    seen = {n.lower() for n in taken}
    for i, name in enumerate(names):
        k = 1
        while (text := name.strip() + (" copy" if k == 1 else f" copy {k}")).lower() in seen:
            k += 1
        seen.add(text.lower())
        assert got[i] == text


def test_request_detail_and_regions(rows, stored):
    items = rows("id long, record_field_id long", (1, 1003), (2, 9))
    placed, orphans = joins.request_detail(items, G.field_groups(stored))
    assert [(r.id, r.group_id) for r in placed.collect()] == [(1, "person-2")] and [r.id for r in orphans.collect()] == [2]
    boxes = rows("document_id long, n int, x double, y double, width double, height double", (1, 0, .1, .1, .1, .1), (1, 1, .5, .5, .1, .1), (2, 0, .1, .1, .1, .1))
    region = rows("document_id long, left double, top double, right double, bottom double, overlay_width double, overlay_height double",
                  (1, 20., 20., 30., 30., 100., 100.), (2, 10., 10., 12., 12., 100., 100.))
    assert [(r.document_id, r.n) for r in joins.boxes_in_region(boxes, region).collect()] == [(1, 0)]


def test_field_rules(rows):
    f = rows(FIELD + ", ocr_confidence double",
             (1, 1, "Name", None, "v", None, None, .1, .1, .2, .2, 0, 50.), (2, 1, "name ", None, " ", 1, None, .9, .1, .2, .005, 1, 101.))
    assert [len(r.violations) for r in quality.check_fields(f).orderBy("id").collect()] == [0, 4]
    layout = {r.id: r.violations for r in quality.check_fields(f, "layout").collect()}
    assert "height: between 0.01 and 1" in layout[2]
    assert all(r.violations for r in quality.check_unique_names(f, "record_id").collect())
    parents = rows("id long", (1,), (2,))
    assert {r.id: r.violations for r in quality.check_field_count(parents, f, "record_id").collect()} == {1: [], 2: ["fields: at least 1"]}
    many = rows(FIELD, *register(1, [i / 200 for i in range(151)]))
    assert quality.check_field_count(parents, many, "record_id").where("id = 1").first().violations == ["fields: at most 450"]


def test_other_rules(rows):
    types = rows("id long, name string", (1, "Birth  Form "), (2, "birth form"), (3, " "))
    assert [len(r.violations) for r in quality.check_type_names(types).orderBy("id").collect()] == [1, 1, 1]
    paper = rows("id long, paper_size string, orientation string, custom_width_mm double, custom_height_mm double",
                 (1, "a4", "portrait", 10., 10.), (2, "custom", "portrait", 100., None))
    got = {r.id: (r.custom_width_mm, r.violations) for r in quality.check_paper(paper).collect()}
    assert got == {1: (None, []), 2: (100., ["custom_height_mm: between 50 and 2000"])}
    files = rows("filename string, length long", ("a.PDF", 10), ("b.exe", 10), ("c.png", 30_000_000), ("d.tif", 1))
    assert [len(r.violations) for r in quality.check_uploads(files).orderBy("filename").collect()] == [0, 1, 1, 1]
    assert quality.check_uploads(files, "sample").where("filename = 'd.tif'").first().violations == []


def test_people_are_counted_and_orphans_found_without_placing_fields(stored, rows):
    placed = G.field_groups_persisted(stored)
    counts = G.stored_person_counts(stored)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, G.person_counts(placed).collect())) != []
    known = stored.first().id
    items = rows("id long, record_field_id long", (1, known), (2, 987654321))
    assert [r.id for r in joins.orphaned_items(items, stored).collect()] == [2]
    for df in (counts, joins.orphaned_items(items, stored)):
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_travel_once_and_crowded_records_keep_their_groups(rows, monkeypatch):
    from docreg.functions import prefix
    held = [(5000 + i, 5, "n", None, "v", [None, 2, 1][i % 3], [None, 3, 1, 2][i % 4], .1, .1, .1, .05, [None, 1, 0][i % 3 - 1]) for i in range(12)]
    f = rows(FIELD, *register(1, [.2, .35, .5]), *register(2, [.1, .5]), *held, (9, None, "n", None, "v", 1, 0, .1, .1, .1, .05, 0))
    for df in (G.field_groups_inferred(f), G.field_groups_workspace(f)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("REPARTITION_BY_COL") == 1
    want = None
    for crowd in (100_000, -100):
        monkeypatch.setattr(prefix, "_CROWD", crowd)
        got = [sorted((r.record_id, r.field_id, r.group_id, r.position) for r in df.collect()) for df in (G.field_groups(f), G.field_groups_persisted(f))]
        assert want in (None, got)
        want = got
    places, persisted = want
    assert [p for p in places if p[0] == 5] == [p for p in persisted if p[0] == 5]
    # The row without a record is left out; places are ascending, nulls first.
    assert len(places) == 9 + 6 + 12 and [p[3] for p in places if p[0] == 2] == list(range(6))
    order = sorted((d for d in held if d[5] == 1), key=lambda d: (d[6] if d[6] is not None else d[11] if d[11] is not None else -1, d[11] if d[11] is not None else -1, d[0]))
    assert [p[1] for p in sorted(places, key=lambda p: p[3]) if p[0] == 5 and p[2] == "person-1"] == [d[0] for d in order]
