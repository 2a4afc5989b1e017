"""Scalar value rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
TRIM_CHARS = " \t\n\r\0\x0b"
SECRET_KEYS = ("password", "password_confirmation", "remember_token", "temporary_password")
REDACTED = "[redacted]"
UNREADABLE = "UNREADABLE"
UNTITLED = "Untitled record"
DOC_TYPE_LABELS = {
    "birth": "Birth Certificate",
    "death": "Death Certificate",
    "marriage": "Marriage Certificate",
    "custom": "Custom Document",
}
DOC_TYPE_SHORT_LABELS = {"birth": "Birth", "death": "Death", "marriage": "Marriage", "custom": "Custom"}
ROLE_LABELS = {"staff": "Staff", "admin": "Admin", "super_admin": "Super Admin"}
RECORD_STATUSES = ("draft", "submitted")
REQUEST_STATUSES = ("pending", "approved", "rejected", "withdrawn")
PAPER_LABELS = {"letter": "Short / Letter", "long_bond": "Long bond", "a4": "A4", "custom": "Custom size"}
PAPER_DIMENSION_LABELS = {"letter": "8.5 × 11 in", "long_bond": "8.5 × 13 in", "a4": "210 × 297 mm"}
PAPER_WIDTH_MM = {"letter": 215.9, "long_bond": 215.9, "a4": 210.0}
PAPER_HEIGHT_MM = {"letter": 279.4, "long_bond": 330.2, "a4": 297.0}
CUSTOM_WIDTH_MM, CUSTOM_HEIGHT_MM = 210.0, 297.0
REGISTER_COLUMNS = (
    "Entry no.", "Date registered", "Child's name", "Sex", "Date of birth", "Place of birth",
    "Father's name", "Mother's name", "Nationality", "Informant", "Remarks",
)
NO_BENCHMARK = "No benchmark"
NO_BENCHMARK_EVIDENCE = (
    "Upload a model ZIP containing a valid evaluation-report.json from the locked test set."
)
# ----------------------------------------------------------------------------


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Small constant map as an expression; unknown keys give ``default``."""
    entries = [F.lit(item) for pair in table.items() for item in pair]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, default)


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM_CHARS))


def strip_unicode(c: Column) -> Column:
    """Strip every Unicode white-space character (and \\x1c-\\x1f) from both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalise_value(c: Column) -> Column:
    """Trimmed value; blank becomes NULL."""
    return F.nullif(trim_ws(c.cast("string")), F.lit(""))


def is_filled(c: Column) -> Column:
    return F.coalesce(trim_ws(c) != "", F.lit(False))


def was_corrected(ocr: Column, verified: Column) -> Column:
    """Row rule: a value typed where OCR read nothing counts as a correction."""
    return trim_ws(F.coalesce(ocr, F.lit(""))) != trim_ws(F.coalesce(verified, F.lit("")))


def differs_from_ocr(ocr: Column, verified: Column, collation: str = "binary") -> Column:
    """Rate rule: OCR must have read something; only spaces are trimmed.

    ``collation="ci"`` ignores case and accents.
    """
    left, right = F.trim(ocr), F.trim(F.coalesce(verified, F.lit("")))
    if collation == "ci":
        left, right = F.collate(left, "UNICODE_CI_AI"), F.collate(right, "UNICODE_CI_AI")
    elif collation != "binary":
        raise ValueError(f"unknown collation {collation!r}")
    return ocr.isNotNull() & (left != right)


def contains_text(c: Column, term: str, literal: bool = True, accents: bool = True) -> Column:
    """Case-insensitive substring search.

    ``literal=False`` lets ``%`` and ``_`` in the term act as wildcards;
    ``accents=False`` ignores accents as well.
    """
    if not literal:
        return F.lower(c).like(f"%{term.lower()}%")
    if not accents:
        return F.contains(F.collate(c, "UNICODE_CI_AI"), F.collate(F.lit(term), "UNICODE_CI_AI"))
    return F.contains(F.lower(c), F.lit(term.lower()))


def is_usable_label(label: Column) -> Column:
    text = strip_unicode(F.coalesce(label, F.lit("")))
    return (text != "") & (F.upper(text) != UNREADABLE)


def one_decimal(c: Column) -> Column:
    """Half away from zero after scaling, so that 62.949999999999996 (computed from 0.3705) reads 63.0, as in SQL."""
    return F.round(c * 10) / 10


def percentage(rate: Column) -> Column:
    """A 0..1 rate as a percentage with one decimal."""
    return one_decimal(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)) * 100)


def normalise_confidence(c: Column) -> Column:
    """Missing or non-finite readings count as 0; the rest is clamped to 0..100."""
    value = c.cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))).otherwise(F.lit(0.0))


def _integer(c: Column) -> Column:
    number = F.btrim(c.cast("string"), F.lit(TRIM_CHARS)).try_cast("double")
    return F.when(number == F.floor(number), number.cast("long"))


def positive_int(c: Column) -> Column:
    value = _integer(c)
    return F.when(value > 0, value)


def non_negative_int(c: Column) -> Column:
    value = _integer(c)
    return F.when(value >= 0, value)


def person_metadata(group: Column, order: Column) -> tuple[Column, Column]:
    """(group, order): an order without a group is dropped, a group alone is kept."""
    g = positive_int(group)
    return g, F.when(g.isNotNull(), non_negative_int(order))


def sanitise_name(c: Column) -> Column:
    """Safe single path segment, or NULL when nothing is left of it."""
    kept = F.regexp_replace(strip_unicode(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s._-]", "")
    return F.nullif(F.regexp_replace(F.btrim(kept, F.lit(". ")), r"(?U)\s+", " "), F.lit(""))


def slug(c: Column, fallback: str) -> Column:
    """Lower-case words joined by hyphens; accents are folded to plain letters."""
    plain = F.translate(
        F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    )
    words = F.regexp_replace(F.regexp_replace(plain, "_", "-"), r"(?U)[^\p{L}\p{N}\s-]+", "")
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(words, r"[-\s]+", "-"), F.lit("-")), F.lit("")), F.lit(fallback))


def storage_path(type_id: Column, type_name: Column, layout_id: Column, layout_name: Column,
                 extension: Column, root: str = "template-samples") -> Column:
    type_slug, layout_slug = slug(type_name, "document-type"), slug(layout_name, "layout")
    return F.concat_ws(
        "/", F.lit(root),
        F.format_string("%03d-%s", F.coalesce(type_id, F.lit(0)).cast("long"), type_slug),
        F.format_string("%05d-%s", layout_id.cast("long"), layout_slug),
        F.concat(type_slug, F.lit("--"), layout_slug, F.lit("--sample."), extension),
    )


def type_label(name: Column, doc_type: Column) -> Column:
    return F.coalesce(name, lookup(doc_type, DOC_TYPE_LABELS))


def type_short_label(name: Column, short_name: Column, doc_type: Column) -> Column:
    return F.coalesce(F.nullif(short_name, F.lit("")), name, lookup(doc_type, DOC_TYPE_SHORT_LABELS))


def role_label(slug_: Column) -> Column:
    return lookup(slug_, ROLE_LABELS)


def status_label(status: Column) -> Column:
    return F.initcap(status)


def action_title(action: Column) -> Column:
    """``change_request.opened`` -> ``Change Request Opened``."""
    return F.initcap(F.translate(action, "._-", "   "))


def prettify(key: Column) -> Column:
    return strip_unicode(F.translate(key, "-_", "  "))


def model_label(key: Column, base_label: str = "Base model", known: dict | None = None) -> Column:
    labels = {"base": base_label, **(known or {})}
    return lookup(key, labels, prettify(key))


def evidence(dataset: Column, samples: Column, evaluated_at: Column) -> Column:
    return F.concat(
        dataset, F.lit(" · test · "), F.format_number(samples, 0), F.lit(" samples"),
        F.coalesce(F.concat(F.lit(" · evaluated "), F.date_format(evaluated_at, "MMM d, yyyy")), F.lit("")),
    )


def decode_data_url(c: Column) -> Column:
    """Bytes of a base64 string, with or without a ``data:...,`` prefix; NULL where it is not base64."""
    return F.try_to_binary(F.regexp_replace(c, "^[^,]*,", ""), F.lit("base64"))


def initials(name: Column) -> Column:
    words = F.filter(F.split(trim_ws(name), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")


def column_label(kind: Column, mode: Column, group_size: Column, position: Column, fallback: Column) -> Column:
    """Header of the ``position``-th (0-based) field of a group.

    Only a person that was found automatically (``mode`` auto) and has a box for every register
    column gets the fixed names; all other fields keep their own name, or a number.
    """
    names = F.array(*[F.lit(n) for n in REGISTER_COLUMNS])
    plain = F.coalesce(
        F.nullif(fallback, F.lit("")), F.concat(F.lit("Field "), (position + 1).cast("string"))
    )
    register = (kind == "person") & (mode == "auto") & (group_size == len(REGISTER_COLUMNS))
    return F.when(register, F.get(names, position.cast("int"))).otherwise(plain)


# ------------------------------------------------------------------ paper
def paper_dimensions(size: Column, orientation: Column, custom_w: Column, custom_h: Column) -> tuple[Column, Column]:
    """(width, height) in millimetres after orientation."""
    w = lookup(size, PAPER_WIDTH_MM, F.coalesce(custom_w, F.lit(CUSTOM_WIDTH_MM)))
    h = lookup(size, PAPER_HEIGHT_MM, F.coalesce(custom_h, F.lit(CUSTOM_HEIGHT_MM)))
    upright = orientation == "portrait"
    return F.when(upright, w).otherwise(h), F.when(upright, h).otherwise(w)


def _millimetres(c: Column) -> Column:
    return F.regexp_replace(F.format_string("%.2f", c.cast("double")), r"\.?0+$", "")


def paper_label(size: Column, custom_w: Column, custom_h: Column) -> Column:
    own = F.concat(
        _millimetres(F.coalesce(custom_w, F.lit(CUSTOM_WIDTH_MM))), F.lit(" × "),
        _millimetres(F.coalesce(custom_h, F.lit(CUSTOM_HEIGHT_MM))), F.lit(" mm"),
    )
    return lookup(size, PAPER_DIMENSION_LABELS, own)


def paper_mismatch(scan_w: Column, scan_h: Column, paper_w: Column, paper_h: Column, orientation: Column) -> Column:
    """Scan lies the other way, or its proportions are more than 10 % off."""
    ratio, expected = scan_w / scan_h, paper_w / paper_h
    lies = F.when(ratio >= 1, F.lit("landscape")).otherwise(F.lit("portrait"))
    return (lies != orientation) | (F.abs(ratio - expected) / expected > 0.1)


# ------------------------------------------------------------------ maps
def redact(values: Column) -> Column:
    return F.transform_values(values, lambda k, v: F.when(k.isin(*SECRET_KEYS), F.lit(REDACTED)).otherwise(v))


def compact_filters(values: Column) -> Column:
    return F.map_filter(values, lambda _, v: v.isNotNull())


def dirty_diff(old: str, new: str, columns: list[str]) -> tuple[Column, Column]:
    """(before, after) maps holding only the columns that moved between two structs."""
    names = [c for c in columns if c != "updated_at"]

    def pick(side: str) -> Column:
        cells = [
            F.struct(
                F.lit(c).alias("key"), F.col(f"{side}.{c}").cast("string").alias("value"),
                (~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}"))).alias("moved"),
            )
            for c in names
        ]
        moved = F.filter(F.array(*cells), lambda cell: cell["moved"])
        return F.map_from_entries(F.transform(moved, lambda cell: F.struct(cell["key"], cell["value"])))

    return pick(old), pick(new)
