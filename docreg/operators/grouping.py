"""Fields of a document grouped into people.

Output is long: one row per field with record_id, field_id, kind, number, group_id,
label, position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreg.functions import values as V
from docreg.functions.prefix import crowded, ranked, running

_OUT = ["record_id", "field_id", "kind", "number", "group_id", "label", "position"]


def _named(number: Column, details_id: str, details_label: str) -> list[Column]:
    """kind, group_id and label of a person number (0 is the details group)."""
    person = number > 0
    return [
        F.when(person, "person").otherwise("details").alias("kind"),
        F.when(person, F.concat(F.lit("person-"), number.cast("string"))).otherwise(details_id).alias("group_id"),
        F.when(person, F.concat(F.lit("Person "), F.when(number < 10, "0").otherwise(""), number.cast("string")))
        .otherwise(details_label).alias("label"),
    ]


def _stored_place(fields: DataFrame) -> tuple[Column, Column]:
    """The stored person number of a field and its place among the fields of that number."""
    place = F.when(F.col("person_group").isNull(), F.col("sort_order")).otherwise(
        F.coalesce("person_field_order", "sort_order"))
    return F.coalesce("person_group", F.lit(0)).cast("int").alias("number"), place.cast("long").alias("_place")


def _persisted(fields: DataFrame, crowd: bool) -> DataFrame:
    """Stored groups. Records of a ``crowd`` are ranked piece by piece, others by a plain window."""
    work = fields.select("record_id", F.col("id").alias("field_id"), *_stored_place(fields), "sort_order")
    keys, order = ["record_id", "number"], ["_place", "sort_order", "field_id"]
    is_text = isinstance(work.schema["field_id"].dataType, T.StringType)
    piece = F.substring("field_id", 1, 8) if is_text else F.floor(F.col("field_id") / 1024)
    placed = ranked(work, keys, [F.col(c) for c in order], F.struct(*order[:-1], piece) if crowd else None, "_rank")
    kind, group_id, label = _named(F.col("number"), "document-details", "Document details")
    return placed.select("record_id", "field_id", kind, "number", group_id, label,
                         (F.col("_rank") - 1).cast("int").alias("position"))


def field_groups_persisted(fields: DataFrame) -> DataFrame:
    """Stored person groups; fields without one form the document details."""
    known = fields.where(F.col("record_id").isNotNull())
    hot = crowded(known, "record_id")
    return _persisted(known.where(~hot), crowd=False).unionByName(_persisted(known.where(hot), crowd=True))


# ---------------------------------------------------------------- geometry
# Fixed values of the row and column tolerances.
ROW_FLOOR, ROW_SHARE = 0.004, 0.58
COLUMN_FLOOR, WIDTH_SHARE, SPACING_SHARE = 0.006, 0.48, 0.36
MIN_COLUMN_SHARE, MATCH_SHARE, EXTRA_COLUMNS = 0.6, 0.75, 2
SMALLEST_SIDE, RUN_BREAK = 0.00001, 2.2


def _median(values) -> float:
    return float(np.median(values)) if len(values) else 0.0


def _rows_by_height(cy: np.ndarray, x: np.ndarray, height: np.ndarray) -> list[np.ndarray]:
    """Row clusters (index arrays ordered by x) from top to bottom; input is sorted by (cy, x)."""
    reach = max(ROW_FLOOR, _median(height) * ROW_SHARE)
    # Centres ascend, so the nearest cluster is always the latest one, and the means ascend too.
    starts, total, count = [], 0.0, 0
    for i, centre in enumerate(cy):
        if count == 0 or abs(total / count - centre) > reach:
            starts.append(i)
            total, count = 0.0, 0
        total += centre
        count += 1
    return [part[np.argsort(x[part], kind="stable")] for part in np.split(np.arange(len(cy)), starts[1:])]


def _column_reach(width: np.ndarray, centres: np.ndarray) -> float:
    typical = _median(width)
    return max(COLUMN_FLOOR, min(typical * WIDTH_SHARE, (_median(np.diff(centres)) or typical) * SPACING_SHARE))


def _aligned(centres: np.ndarray, prototype: np.ndarray, reach: float) -> int:
    """How many centres find a free prototype column within reach, left to right."""
    free, hits = np.ones(len(prototype), dtype=bool), 0
    for c in centres:
        gap = np.where(free, np.abs(prototype - c), np.inf)
        if free.any() and gap.min() <= reach:
            free[gap.argmin()] = False
            hits += 1
    return hits


def _person_rows(rows: list[np.ndarray], cy, x, width, workspace: bool) -> list[np.ndarray]:
    """The rows that repeat one column pattern; empty when the page has no register."""
    sizes = np.array([len(r) for r in rows])
    repeated = sizes[sizes >= 3]
    if len(repeated) < 2:
        return []
    columns, freq = np.unique(repeated, return_counts=True)
    preference = (columns, freq, columns * freq) if workspace else (columns, columns * freq)
    dominant = int(columns[np.lexsort(preference)[-1]])
    alike = [r for r in rows if len(r) == dominant]
    centres = [x[r] + width[r] / 2 for r in alike]
    reaches = [_column_reach(width[r], c) for r, c in zip(alike, centres)]
    pick = 0
    if workspace:
        stacked = np.vstack(centres)
        peers = [int((np.abs(stacked - c) <= reach).all(axis=1).sum()) for c, reach in zip(centres, reaches)]
        pick = int(np.argmax(peers))
    prototype, reach = centres[pick], reaches[pick]

    fewest, most = max(3, int(np.ceil(dominant * MIN_COLUMN_SHARE))), dominant + EXTRA_COLUMNS

    def fits(row: np.ndarray) -> bool:
        need = max(3, int(np.ceil(min(len(row), dominant) * MATCH_SHARE)))
        return fewest <= len(row) <= most and _aligned(x[row] + width[row] / 2, prototype, reach) >= need

    people = [r for r in rows if fits(r)]
    least = 2 if dominant >= 6 else 3
    if len(people) < least:
        return []
    if not workspace:
        return people
    level = np.array([cy[np.sort(r)].sum() / len(r) for r in people])
    gaps = np.diff(level)
    typical = _median(gaps[gaps > 0])
    breaks = np.flatnonzero(gaps > typical * RUN_BREAK) + 1 if typical > 0 else []
    runs = [run for run in np.split(np.arange(len(people)), breaks) if len(run) >= least]
    return [people[i] for i in max(runs, key=len)] if runs else []


def _place(box: np.ndarray, workspace: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(number, position, found) of one document's boxes (x, y, width, height) in sort order."""
    usable = np.ones(len(box), dtype=bool) if workspace else ~np.isnan(box).any(axis=1)
    x_all, y_all, w_all, h_all = np.nan_to_num(box).T
    h_all = np.maximum(SMALLEST_SIDE, h_all)
    cy_all = y_all + h_all / 2
    order = np.flatnonzero(usable)
    order = order[np.lexsort((x_all[order], cy_all[order]))]
    cy, x, w = cy_all[order], x_all[order], w_all[order]
    rows = _rows_by_height(cy, x, h_all[order]) if len(order) else []
    people = _person_rows(rows, cy, x, w, workspace) if rows else []

    number, position = np.zeros(len(box), dtype=np.int32), np.empty(len(box), dtype=np.int32)
    for n, row in enumerate(people, start=1):
        number[order[row]] = n
        position[order[row]] = np.arange(len(row))
    rest = np.flatnonzero(number == 0)
    if workspace:
        # Details follow the page: row by row when people were found, else by height.
        walk = order[np.concatenate(rows)] if people else order
        rest = walk[number[walk] == 0]
    position[rest] = np.arange(len(rest))
    return number, position, bool(people)


# Three rows of three, or a row of six and one of four: fewer boxes never form a register.
FEWEST_BOXES = 9


def _within(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of ``keys``, and the position of each among those that agree in all keys but the last."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys[:-1]], axis=0)
    at = np.arange(len(order))
    return order, at - np.maximum.accumulate(np.where(new, at, 0))


def _infer(workspace: bool):
    """Batch function over rows sorted by document; a document cut by a batch edge is carried over.

    Documents with stored groups (``grouped``, ``number``, ``place``) keep them and count as found. They and
    documents too small for a register are placed together; only the others are walked one by one.
    """
    def complete(frame: pd.DataFrame) -> pd.DataFrame:
        boxes = frame[["x", "y", "width", "height"]].to_numpy(dtype=float)
        ids = frame["record_id"].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
        size = np.diff(np.append(starts, len(frame)))
        document = np.repeat(np.arange(len(starts)), size)
        number, position = np.zeros(len(frame), dtype=np.int32), np.empty(len(frame), dtype=np.int32)
        stored = np.zeros(len(starts), dtype=bool)
        if "grouped" in frame:
            stored = np.logical_or.reduceat(frame["grouped"].to_numpy(dtype=bool), starts)
            kept = np.flatnonzero(stored[document])
            number[kept] = frame["number"].to_numpy()[kept]
            order, at = _within(document[kept], number[kept], frame["place"].to_numpy()[kept])
            position[kept[order]] = at
        found = stored[document]
        small = np.flatnonzero(((size < FEWEST_BOXES) & ~stored)[document])
        if workspace:
            x, y, _, height = np.nan_to_num(boxes[small]).T
            centre = y + np.maximum(SMALLEST_SIDE, height) / 2
            walk = np.lexsort((x, centre, document[small]))
            small = small[walk]
        position[small] = np.arange(len(small)) - np.searchsorted(document[small], document[small])
        for i in np.flatnonzero((size >= FEWEST_BOXES) & ~stored):
            part = slice(starts[i], starts[i] + size[i])
            number[part], position[part], found[part] = _place(boxes[part], workspace)
        return frame[["record_id", "field_id"]].assign(number=number, position=position, found=found)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for frame in frames:
            ids = frame["record_id"].to_numpy()
            if not len(ids):
                continue
            last = np.flatnonzero(ids != ids[-1])
            start = int(last[-1]) + 1 if len(last) else 0
            if held and (start or held[-1]["record_id"].iloc[-1] != ids[-1]):
                yield complete(pd.concat([*held, frame.iloc[:start]], ignore_index=True))
                held = []
            elif start:
                yield complete(frame.iloc[:start])
            held.append(frame.iloc[start:])
        if held:
            yield complete(pd.concat(held, ignore_index=True))

    return run


def _inferred(fields: DataFrame, workspace: bool, stored: bool = False) -> DataFrame:
    """Every field travels once, to the task of its document, which places it."""
    columns = ["person_group", "person_field_order"] if stored else []
    boxes = fields.where(F.col("record_id").isNotNull()).select(
        "record_id", F.col("id").alias("field_id"), "sort_order", "x", "y", "width", "height", *columns)
    out = T.StructType([
        boxes.schema["record_id"], boxes.schema["field_id"], T.StructField("number", T.IntegerType()),
        T.StructField("position", T.IntegerType()), T.StructField("found", T.BooleanType()),
    ])
    ordered = boxes.repartition("record_id").sortWithinPartitions("record_id", "sort_order", "field_id")
    kept = []
    if stored:
        of_person, place = _stored_place(boxes)
        first = F.lit(-2**63)
        kept = [F.col("person_group").isNotNull().alias("grouped"), of_person, F.coalesce(place, first).alias("place")]
    placed = ordered.select("record_id", "field_id", "x", "y", "width", "height", *kept).mapInPandas(_infer(workspace), out)
    number = F.col("number")
    person = number > 0
    kind, group_id, label = _named(number, "document-details", "Document details")
    whole = ~F.col("found")
    return placed.select(
        "record_id", "field_id", kind, "number",
        F.when(whole, "record-details").otherwise(group_id).alias("group_id"),
        F.when(whole & ~person, "Record details").otherwise(label).alias("label"), "position",
    )


def field_groups_inferred(fields: DataFrame, workspace: bool = False) -> DataFrame:
    """People inferred from box coordinates.

    ``workspace=False`` is the archive rule, ``True`` the rule of the validation
    workspace (other tie-breaks, best-aligned prototype row, longest unbroken run).
    A document of any size is inferred; ``check_field_count`` reports those above 450 fields.
    """
    return _inferred(fields, workspace)


def field_groups_workspace(fields: DataFrame) -> DataFrame:
    return field_groups_inferred(fields, workspace=True)


def field_groups(fields: DataFrame) -> DataFrame:
    """Stored groups where the record has any, inferred ones elsewhere.

    Only stored groups of crowded records are placed apart, piece by piece.
    """
    known = fields.where(F.col("record_id").isNotNull())
    hot = crowded(known, "record_id")
    busy = known.where(hot)
    marked = busy.where(F.col("person_group").isNotNull()).select("record_id").distinct()
    apart = _persisted(busy.join(marked, "record_id", "left_semi"), crowd=True)
    rest = known.where(~hot).unionByName(busy.join(marked, "record_id", "left_anti"))
    return apart.select(*_OUT).unionByName(_inferred(rest, workspace=False, stored=True).select(*_OUT))


# ---------------------------------------------------------------- summaries
def _member_values(members: DataFrame, fields: DataFrame) -> DataFrame:
    values = fields.select("record_id", F.col("id").alias("field_id"), "ocr_text", "verified_value", "width")
    return members.join(values, ["record_id", "field_id"], "inner").withColumn(
        "_text", V.trim_ws(F.coalesce("verified_value", F.lit(""))))


def group_summary(members: DataFrame, fields: DataFrame) -> DataFrame:
    """Per group: field and correction counts, and the identity of a person.

    The identity is the third value of an eleven-field row, else the widest value of at
    least three characters with a letter, else a field count.
    """
    text = F.col("_text")
    candidate = (F.length(text) >= 3) & text.rlike(r"\p{L}")
    width = F.coalesce("width", F.lit(0.0))
    grouped = _member_values(members, fields).groupBy("record_id", "kind", "number", "group_id", "label").agg(
        F.count("*").alias("field_count"),
        F.count_if(V.was_corrected(F.col("ocr_text"), F.col("verified_value"))).alias("corrected_count"),
        F.max(F.when(F.col("position") == 2, F.nullif(text, F.lit("")))).alias("_third"),
        F.max_by(text, F.when(candidate, F.struct(width, -F.col("position")))).alias("_widest"),
    )
    n = F.col("field_count")
    identity = F.coalesce(F.when(n == 11, F.col("_third")), F.col("_widest"),
                          F.concat(n.cast("string"), F.lit(" verified fields")))
    return grouped.select(
        "record_id", "kind", "number", "group_id", "label", "field_count", "corrected_count",
        F.when(F.col("kind") == "person", identity).alias("identity"))


def person_counts(members: DataFrame) -> DataFrame:
    return members.where(F.col("kind") == "person").groupBy("record_id").agg(
        F.countDistinct("number").alias("person_count"))


def stored_person_counts(fields: DataFrame) -> DataFrame:
    """``person_counts`` of the stored groups, straight from the fields: no field is placed.

    Rows travel narrow and uncounted, so that no scan task holds a table of all records.
    """
    number = F.coalesce("person_group", F.lit(0)).cast("int").alias("number")
    people = fields.select("record_id", number).where("number > 0")
    return people.repartition("record_id").groupBy("record_id").agg(F.countDistinct("number").alias("person_count"))


def record_headings(records: DataFrame, types: DataFrame, members: DataFrame, fields: DataFrame) -> DataFrame:
    """Heading of each record: its entries, its number of people, or its registry number."""
    leads = _member_values(members.where((F.col("kind") == "person") & (F.col("position") == 0)), fields)
    text = F.col("_text")
    entry = F.when((text != "") & (F.length(text) <= 20) & text.rlike("[0-9]"), text)
    people = leads.groupBy(F.col("record_id").alias("id")).agg(
        F.count("*").alias("_people"), F.bool_and(entry.isNotNull()).alias("_numbered"),
        F.min_by(entry, "number").alias("_first"), F.max_by(entry, "number").alias("_last"))
    names = types.select(F.col("id").alias("document_type_id"), F.col("name").alias("_name"), F.col("short_name").alias("_short"))
    kind = V.type_short_label(F.col("_name"), F.col("_short"), F.col("doc_type"))
    number = F.when(~F.coalesce(F.col("registry_number"), F.lit("")).isin("", "0"), F.col("registry_number"))
    heading = (
        F.when(F.col("_people").isNull(),
               F.coalesce(number, F.concat(kind, F.lit(" record #"), F.col("id").cast("string"))))
        .when(F.col("_numbered") & (F.col("_first") == F.col("_last")), F.concat(kind, F.lit(" · Entry "), F.col("_first")))
        .when(F.col("_numbered"), F.concat(kind, F.lit(" · Entries "), F.col("_first"), F.lit("–"), F.col("_last")))
        .otherwise(F.concat(kind, F.lit(" · "), F.col("_people").cast("string"), F.lit(" people")))
    )
    return records.join(people, "id", "left").join(names, "document_type_id", "left").select("id", heading.alias("heading"))


# ---------------------------------------------------------------- layouts
def canonicalize_groups(template_fields: DataFrame, templates: DataFrame) -> DataFrame:
    """Person groups renumbered 1..n and orders 0..m without gaps; 'auto' layouts lose both."""
    modes = templates.select(F.col("id").alias("document_template_id"), F.col("grouping_mode").alias("_mode"))
    joined = template_fields.join(modes, "document_template_id", "left")
    grouped = (F.col("_mode") == "custom") & F.col("person_group").isNotNull()
    custom = joined.where(grouped)
    # At most one row per group number of a layout reaches this window.
    numbers = custom.select("document_template_id", "person_group").distinct().withColumn(
        "_group", F.row_number().over(Window.partitionBy("document_template_id").orderBy("person_group")))
    wanted = F.coalesce("person_field_order", F.lit(0))
    placed = ranked(
        custom.withColumn("_wanted", wanted.cast("long")), ["document_template_id", "person_group"],
        [F.col("_wanted"), F.col("sort_order"), F.col("id")], F.floor(F.col("_wanted") / 64), "_rank",
    ).join(numbers, ["document_template_id", "person_group"], "inner")
    columns = template_fields.columns

    def put(df: DataFrame, group: Column, order: Column) -> DataFrame:
        new = {"person_group": group.cast("int"), "person_field_order": order.cast("int")}
        return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])

    plain = joined.where(~F.coalesce(grouped, F.lit(False)))
    nothing = F.lit(None)
    return put(placed, F.col("_group"), F.col("_rank") - 1).unionByName(
        put(plain, nothing, F.when(F.col("_mode") == "custom", F.col("person_field_order"))))


def group_selected(boxes: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected boxes become the next person group of their document, ordered by x, y, index."""
    following = boxes.groupBy("document_id").agg(
        (F.coalesce(F.max(V.positive_int(F.col("person_group"))), F.lit(0)) + 1).alias("_next"))
    chosen = boxes.join(selection.select("document_id", "index").distinct(), ["document_id", "index"], "left_semi")
    placed = ranked(chosen.select("document_id", "index", "x", "y"), ["document_id"],
                    [F.col("x"), F.col("y"), F.col("index")], F.floor(F.col("x") * 64), "_rank")
    new = placed.join(following, "document_id", "inner").select("document_id", "index", "_next", "_rank")
    hit = F.col("_next").isNotNull()
    put = {
        "person_group": F.when(hit, F.col("_next")).otherwise(F.col("person_group")).cast("int"),
        "person_field_order": F.when(hit, F.col("_rank") - 1).otherwise(F.col("person_field_order")).cast("int"),
    }
    return boxes.join(new, ["document_id", "index"], "left").select(*[
        put[c].alias(c) if c in put else F.col(c) for c in boxes.columns])


def copy_names(existing: DataFrame, copies: DataFrame, max_length: int = 500) -> DataFrame:
    """Names for pasted fields: 'X copy', 'X copy 2', ... unique in the layout ignoring case.

    existing: document_template_id, name. copies: document_template_id, position, name.
    The n-th copy of a name gets the n-th number that no existing name uses: a used number u
    that is the i-th in order has u - i free numbers before it, so the copy moves up by the
    used numbers with u - i < n. Names that agree in all but their last 16 characters of the
    greatest length are numbered together, so that cutting them never makes two equal.
    """
    keys = ["document_template_id", "_key"]
    room = max_length - 16
    pattern = r"(?s)^(.*) copy(?: ([2-9]|[1-9][0-9]+))?$"
    lowered = F.lower("name")
    used = existing.where(lowered.rlike(pattern)).select(
        "document_template_id", F.left(F.regexp_extract(lowered, pattern, 1), F.lit(room)).alias("_key"),
        F.when(F.regexp_extract(lowered, pattern, 2) == "", F.lit(1)).otherwise(
            F.regexp_extract(lowered, pattern, 2).try_cast("long")).cast("long").alias("_used")).where("_used is not null").distinct()
    used = ranked(used, keys, [F.col("_used")], F.floor(F.col("_used") / 1000), "_i")
    base = V.strip_unicode(F.coalesce("name", F.lit("")))
    new = copies.select("document_template_id", F.col("position").cast("int").alias("position"), "name",
                        F.when(base == "", F.lit("Field")).otherwise(base).alias("_base"))
    new = ranked(new.withColumn("_key", F.left(F.lower("_base"), F.lit(room))), keys, [F.col("position"), F.col("name")],
                 F.floor(F.col("position") / 1000), "_n")
    none = F.lit(None)
    moves = used.select(*keys, (F.col("_used") - F.col("_i") + 1).alias("_at"), F.lit(0).alias("_copy"), F.lit(1).cast("long").alias("_step"),
                        none.cast("int").alias("position"), none.cast("string").alias("name"), none.cast("string").alias("_base"))
    asks = new.select(*keys, F.col("_n").alias("_at"), F.lit(1).alias("_copy"), F.lit(0).cast("long").alias("_step"), "position", "name", "_base")
    passed = running(moves.unionByName(asks), keys, [F.col("_at"), F.col("_copy")], F.floor(F.col("_at") / 1000), {"_up": ("sum", "_step")})
    number = F.col("_at") + F.col("_up")
    tail = F.when(number == 1, F.lit(" copy")).otherwise(F.concat(F.lit(" copy "), number.cast("string")))
    return passed.where("_copy = 1").select(
        "document_template_id", "position", "name",
        F.concat(F.left("_base", F.lit(max_length) - F.length(tail)), tail).alias("copy_name"))
