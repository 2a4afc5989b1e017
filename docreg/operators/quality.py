"""Data-quality rules. ``check_*`` keeps every row and adds ``violations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.functions import values as V
from docreg.schemas import MAX_FIELDS

# --- fixed values -----------------------------------------------------------
EDGE = 1.00001
MIN_SIDE = {"capture": 0.00001, "layout": 0.01}
NAME_MAX, VALUE_MAX = 500, 2000
PAPER_MIN_MM, PAPER_MAX_MM = 50, 2000
SCAN_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "webp", "bmp", "tiff")
SAMPLE_EXTENSIONS = (*SCAN_EXTENSIONS, "tif")
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
WEIGHT_FILES = ("model.safetensors", "pytorch_model.bin")
REPORT_ERRORS = {
    "schema_version": "schema_version must be 1",
    "test_split": "split must be 'test'",
    "samples": "sample_count must be positive",
    "dataset": "dataset is required",
    "manifest_digest": "manifest_sha256 must be a SHA-256 digest",
    "weights_name": "weights_file must name the model weights",
    "weights_digest": "weights_sha256 must be a SHA-256 digest",
    "weights_missing": " is missing",
    "weights_differ": "weights_sha256 does not match the uploaded checkpoint",
    "time_format": "evaluated_at must be an ISO time",
    "time_zone": "evaluated_at must include a timezone",
    "metrics": "metrics is required",
    "rates": "CER and WER must be finite non-negative rates",
    "exact": "exact_match must be between 0 and 1",
}
# ----------------------------------------------------------------------------


def violations(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in rules]))


def _outside(c: str, low: float, high: float) -> Column:
    """A missing value breaks a range rule too."""
    return ~F.coalesce(F.col(c).between(low, high), F.lit(False))


def geometry_rules(mode: str) -> list[tuple[Column, str]]:
    side = MIN_SIDE[mode]
    return [
        (_outside("x", 0, 1), "x: between 0 and 1"),
        (_outside("y", 0, 1), "y: between 0 and 1"),
        (_outside("width", side, 1), f"width: between {side:g} and 1"),
        (_outside("height", side, 1), f"height: between {side:g} and 1"),
        (F.col("x") + F.col("width") > EDGE, "width: beyond the document width"),
        (F.col("y") + F.col("height") > EDGE, "height: beyond the document height"),
    ]


def group_rule() -> tuple[Column, str]:
    return (
        F.col("person_group").isNull() != F.col("person_field_order").isNull(),
        "person_group: group and order belong together",
    )


def check_fields(fields: DataFrame, mode: str = "capture") -> DataFrame:
    """Row rules of a captured field or a layout marker."""
    name = V.trim_ws(F.col("name"))
    rules = [
        (~F.coalesce((name != "") & (F.length("name") <= NAME_MAX), F.lit(False)), "name: 1 to 500 characters"),
        *geometry_rules(mode), group_rule(),
    ]
    if mode == "capture":
        value = F.col("verified_value")
        rules += [
            (~V.is_filled(value), "verified_value: required"),
            (F.length(value) > VALUE_MAX, "verified_value: at most 2000 characters"),
            (F.length("ocr_text") > VALUE_MAX, "ocr_text: at most 2000 characters"),
            (~F.coalesce(F.col("ocr_confidence").between(0, 100), F.lit(True)), "ocr_confidence: between 0 and 100"),
        ]
    return fields.withColumn("violations", violations(*rules))


def check_unique_names(fields: DataFrame, parent: str) -> DataFrame:
    """Flags every field whose name occurs twice in its parent, ignoring case.

    Counted with map-side partial sums, so a huge parent costs one row per name.
    """
    key = F.lower(V.trim_ws(F.col("name")))
    repeated = (
        fields.groupBy(F.col(parent).alias("_parent"), key.alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1")
    )
    same = (F.col(parent) == F.col("_parent")) & (key == F.col("_key"))
    return fields.join(repeated, same, "left").select(
        *fields.columns,
        violations((F.col("_n").isNotNull(), "name: occurs more than once")).alias("violations"))


def check_field_count(parents: DataFrame, fields: DataFrame, parent: str) -> DataFrame:
    """1 to 450 fields per document or layout."""
    n = fields.groupBy(F.col(parent).alias("id")).agg(F.count("*").alias("_n"))
    return parents.join(n, "id", "left").withColumn(
        "field_count", F.coalesce("_n", F.lit(0)).cast("long")
    ).drop("_n").withColumn("violations", violations(
        (F.col("field_count") == 0, "fields: at least 1"),
        (F.col("field_count") > MAX_FIELDS, "fields: at most 450"),
    ))


def check_report_filters(filters: DataFrame, types: DataFrame, users: DataFrame) -> DataFrame:
    """Filter sets (date_from, date_to, doc_type, status, submitted_by) against the rules."""
    known_types = types.select(F.col("key").alias("doc_type")).distinct().withColumn("_type", F.lit(True))
    known_users = users.select(F.col("id").alias("submitted_by")).withColumn("_user", F.lit(True))
    joined = filters.join(known_types, "doc_type", "left").join(known_users, "submitted_by", "left")
    return joined.select(*filters.columns, violations(
        (F.col("date_to") < F.col("date_from"), "to: before from"),
        (F.col("doc_type").isNotNull() & F.col("_type").isNull(), "doc_type: unknown"),
        (F.col("status").isNotNull() & ~F.col("status").isin(*V.RECORD_STATUSES), "status: unknown"),
        (F.col("submitted_by").isNotNull() & F.col("_user").isNull(), "submitted_by: unknown"),
    ).alias("violations"))


def check_paper(templates: DataFrame) -> DataFrame:
    """Custom sizes need both sides (50 to 2000 mm); other sizes drop theirs."""
    custom = F.col("paper_size") == "custom"
    kept = templates.withColumns({c: F.when(custom, F.col(c)) for c in ("custom_width_mm", "custom_height_mm")})
    return kept.withColumn("violations", violations(
        (~F.col("paper_size").isin(*V.PAPER_LABELS), "paper_size: unknown"),
        (~F.col("orientation").isin("portrait", "landscape"), "orientation: unknown"),
        *[(custom & _outside(c, PAPER_MIN_MM, PAPER_MAX_MM), f"{c}: between 50 and 2000")
          for c in ("custom_width_mm", "custom_height_mm")],
    ))


def check_reason(requests: DataFrame) -> DataFrame:
    size = F.length(V.trim_ws(F.coalesce("reason", F.lit(""))))
    return requests.withColumn("violations", violations((~size.between(10, 2000), "reason: 10 to 2000 characters")))


def check_type_names(types: DataFrame) -> DataFrame:
    """Names unique ignoring case once white space is collapsed; adds ``clean_name``."""
    clean = F.regexp_replace(V.trim_ws(F.coalesce("name", F.lit(""))), r"\s+", " ")
    named = types.withColumn("clean_name", clean)
    key = F.lower("clean_name")
    repeated = named.groupBy(key.alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1")
    return named.join(repeated, key == F.col("_key"), "left").select(
        *named.columns, violations(
            (F.col("clean_name") == "", "name: required"),
            (F.length("clean_name") > 120, "name: at most 120 characters"),
            (F.col("_n").isNotNull(), "name: already exists"),
        ).alias("violations"))


def check_uploads(files: DataFrame, kind: str = "scan") -> DataFrame:
    """Extension and size of uploaded scans or layout samples."""
    allowed = SCAN_EXTENSIONS if kind == "scan" else SAMPLE_EXTENSIONS
    extension = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    return files.withColumn("violations", violations(
        (~extension.isin(*allowed), "file: type not allowed"), (F.col("length") > MAX_UPLOAD_BYTES, "file: above 20 MB")))


def has_evaluation() -> Column:
    """Complete, artifact-bound test-set evaluation."""
    present = [F.col(c).isNotNull() for c in (
        "cer", "wer", "exact_match", "evaluation_dataset", "evaluation_manifest_sha256", "evaluation_weights_sha256")]
    out = (F.col("evaluation_split") == "test") & (F.col("evaluation_sample_count") > 0)
    for p in present:
        out = out & p
    return F.coalesce(out, F.lit(False))


def _rate(c: str) -> Column:
    value = F.col(f"metrics.{c}").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def validate_reports(reports: DataFrame, digests: DataFrame) -> DataFrame:
    """Benchmark reports with their first failing check, and the normalised columns.

    digests: folder, filename, sha256 of the weights on disk.
    """
    hex64 = r"^[0-9a-f]{64}$"
    weights = F.element_at(F.split(F.coalesce("weights_file", F.lit("")), "/"), -1)
    lower = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("manifest_sha256", "weights_sha256")}
    stamp = F.trim(F.coalesce("evaluated_at", F.lit("")))
    on_disk = digests.select(
        F.col("folder").alias("model_folder"), F.col("filename").alias("_weights"), F.col("sha256").alias("_sha"))
    joined = reports.withColumn("_weights", weights).join(on_disk, ["model_folder", "_weights"], "left")
    samples = F.col("sample_count").try_cast("long")
    cer, wer, exact = _rate("cer"), _rate("wer"), _rate("exact_match")
    moment = stamp.try_cast("timestamp")

    def unless(holds: Column, text: str | Column) -> Column:
        return F.when(~F.coalesce(holds, F.lit(False)), text if isinstance(text, Column) else F.lit(text))

    error = F.coalesce(
        F.col("read_error") if "read_error" in reports.columns else F.lit(None).cast("string"),
        unless(F.col("schema_version") == "1", REPORT_ERRORS["schema_version"]),
        unless(F.col("split") == "test", REPORT_ERRORS["test_split"]),
        unless(samples >= 1, REPORT_ERRORS["samples"]),
        unless(F.trim("dataset") != "", REPORT_ERRORS["dataset"]),
        unless(lower["manifest_sha256"].rlike(hex64), REPORT_ERRORS["manifest_digest"]),
        unless(F.col("_weights").isin(*WEIGHT_FILES), REPORT_ERRORS["weights_name"]),
        unless(lower["weights_sha256"].rlike(hex64), REPORT_ERRORS["weights_digest"]),
        unless(F.col("_sha").isNotNull(), F.concat("_weights", F.lit(REPORT_ERRORS["weights_missing"]))),
        unless(F.col("_sha") == lower["weights_sha256"], REPORT_ERRORS["weights_differ"]),
        unless(moment.isNotNull(), REPORT_ERRORS["time_format"]),
        unless(stamp.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), REPORT_ERRORS["time_zone"]),
        unless(F.col("metrics").isNotNull(), REPORT_ERRORS["metrics"]),
        unless((cer >= 0) & (wer >= 0), REPORT_ERRORS["rates"]),
        unless(exact.between(0, 1), REPORT_ERRORS["exact"]),
    )
    ok = error.isNull()
    return joined.select(
        "model_folder", error.alias("error"),
        F.when(ok, F.trim(F.coalesce("model_key", F.lit("")))).alias("model_key"),
        F.when(ok, F.trim("dataset")).alias("dataset"),
        F.when(ok, samples).alias("sample_count"),
        F.when(ok, cer).alias("cer"), F.when(ok, wer).alias("wer"), F.when(ok, exact).alias("exact_match"),
        F.when(ok, moment).alias("evaluated_at"),
        F.when(ok, F.col("_weights")).alias("weights_file"),
        F.when(ok, lower["manifest_sha256"]).alias("manifest_sha256"),
        F.when(ok, lower["weights_sha256"]).alias("weights_sha256"),
    )
