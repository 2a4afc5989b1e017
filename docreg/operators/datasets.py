"""Dataset manifests against the files on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.functions import values as V
from docreg.operators.ordering import sample_array
from docreg.sources.files import is_image

# --- fixed values -----------------------------------------------------------
SPLITS = ("train", "val", "test")
MAX_REPORTED = 25
NO_ROWS = "Manifest has no rows."
MISSING_FILES = " manifest row(s) point at an image that is not on disk."
NO_TRAINING_ROWS = "No usable training rows (every label is empty or UNREADABLE)."
NO_VALIDATION_ROWS = "No usable validation rows. Training will run but cannot pick a best epoch."
UNLISTED_FILES = " image(s) have no manifest row and will be ignored."
EMPTY_LABELS, UNREADABLE_LABELS = " empty and ", " UNREADABLE label(s) will be skipped."
UNKNOWN_SPLITS = "Rows with an unrecognised split were ignored: "
# ----------------------------------------------------------------------------


def _split() -> Column:
    return F.lower(V.strip_unicode(F.coalesce("split", F.lit(""))))


def usable_labels(manifest: DataFrame) -> DataFrame:
    """Rows training can use: neither blank nor UNREADABLE."""
    return manifest.where(V.is_usable_label(F.col("label")))


def split_scope(manifest: DataFrame, images: DataFrame, split: str) -> DataFrame:
    """(filename, label): usable rows of the split that have an image in its folder.

    A file listed twice takes its last row. If no row of the split matches although
    other splits exist, every manifest row counts.
    """
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    files = images.where((F.col("split") == split) & is_image(F.col("filename"))).select("filename").distinct()

    def labelled(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("filename").agg(F.max_by("label", "ord").alias("label"))
        return usable_labels(last).join(files, "filename", "left_semi")

    inside = _split() == split
    scoped = labelled(manifest.where(inside))
    found = scoped.limit(1).agg(F.count("*")).scalar()
    others = manifest.where(~inside).limit(1).agg(F.count("*")).scalar()
    return scoped.unionByName(labelled(manifest).where((found == 0) & (others > 0)))


def _rows(manifest: DataFrame) -> DataFrame:
    return manifest.select(
        V.strip_unicode(F.coalesce("filename", F.lit(""))).alias("filename"), _split().alias("split"), "label", "ord")


def missing_images(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Manifest rows of a known split whose file is not there, blank file names included."""
    rows = _rows(manifest).where(F.col("split").isin(*SPLITS))
    return rows.join(images.select("split", "filename"), ["split", "filename"], "left_anti").select(
        "split", "filename", "ord")


def orphan_images(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Image files of a known split without a manifest row."""
    files = images.where(F.col("split").isin(*SPLITS) & is_image(F.col("filename")))
    return files.join(_rows(manifest).select("split", "filename"), ["split", "filename"], "left_anti")


def dataset_summary(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Per split: image files, bytes and usable rows; every split appears."""
    files = images.where(is_image(F.col("filename"))).groupBy("split").agg(
        F.count("*").alias("images"), F.sum("length").alias("bytes"))
    usable = usable_labels(manifest).groupBy(_split().alias("split")).agg(F.count("*").alias("usable"))
    splits = manifest.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in SPLITS])).alias("split"))
    return splits.join(files, "split", "left").join(usable, "split", "left").select(
        "split", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("images", "bytes", "usable")])


def dataset_totals(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Manifest rows, image files of the known splits and bytes of all files, in one row."""
    image = F.col("split").isin(*SPLITS) & is_image(F.col("filename"))
    files = images.agg(F.count_if(image).alias("total_images"), F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
    return files.withColumn("manifest_rows", manifest.agg(F.count("*")).scalar())


def unknown_splits(manifest: DataFrame) -> DataFrame:
    """Distinct split names that are none of the known ones."""
    odd = _rows(manifest).where(~F.col("split").isin(*SPLITS))
    return odd.select(F.when(F.col("split") == "", "(blank)").otherwise(F.col("split")).alias("name")).distinct()


def validate_dataset(manifest: DataFrame, images: DataFrame, samples: int = MAX_REPORTED) -> DataFrame:
    """One-row report: counts, errors, warnings, ok, all unknown splits, and the first ``samples``
    missing and orphan paths. The full lists are ``missing_images``, ``orphan_images`` and
    ``unknown_splits``.
    """
    rows = _rows(manifest)
    known = F.col("split").isin(*SPLITS)
    text = V.strip_unicode(F.coalesce("label", F.lit("")))
    blank, unreadable = text == "", F.upper(text) == V.UNREADABLE
    usable = known & ~blank & ~unreadable
    counts = rows.agg(
        F.count("*").alias("manifest_rows"),
        *[F.count_if(F.col("split") == s).alias(f"rows_{s}") for s in SPLITS],
        *[F.count_if(usable & (F.col("split") == s)).alias(f"usable_{s}") for s in SPLITS],
        F.count_if(known & blank).alias("empty_labels"),
        F.count_if(known & unreadable).alias("unreadable_labels"),
    )
    unknown = unknown_splits(manifest)
    lost, orphans = missing_images(manifest, images), orphan_images(manifest, images)
    path = F.concat_ws("/", "split", "filename")
    position = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))
    report = counts.withColumns({
        "missing_image_count": lost.agg(F.count("*")).scalar(),
        "orphan_image_count": orphans.agg(F.count("*")).scalar(),
        "missing_images": sample_array(lost.where("filename <> ''"), path, [F.col("ord")], samples),
        "unknown_split_count": unknown.agg(F.count("*")).scalar(),
        "unknown_splits": F.coalesce(unknown.agg(F.sort_array(F.collect_set("name"))).scalar(), F.array().cast("array<string>")),
        "orphan_images": sample_array(orphans, path, [position, F.col("filename")], samples),
    })
    n = F.col

    def say(count: str, tail: str) -> Column:
        return F.concat(n(count).cast("string"), F.lit(tail))

    empty = n("manifest_rows") == 0
    errors = F.when(empty, F.array(F.lit(NO_ROWS))).otherwise(F.array_compact(F.array(
        F.when(n("missing_image_count") > 0, say("missing_image_count", MISSING_FILES)),
        F.when(n("usable_train") == 0, F.lit(NO_TRAINING_ROWS)),
    )))
    warnings = F.when(empty, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(
        F.when(n("usable_val") == 0, F.lit(NO_VALIDATION_ROWS)),
        F.when(n("orphan_image_count") > 0, say("orphan_image_count", UNLISTED_FILES)),
        F.when(n("empty_labels") + n("unreadable_labels") > 0, F.concat(
            say("empty_labels", EMPTY_LABELS), say("unreadable_labels", UNREADABLE_LABELS))),
        F.when(F.size("unknown_splits") > 0, F.concat(
            F.lit(UNKNOWN_SPLITS), F.array_join("unknown_splits", ", "))),
    )))
    return report.withColumns({"errors": errors, "warnings": warnings}).withColumn("ok", F.size("errors") == 0)
