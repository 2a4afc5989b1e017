"""Manifests, image listings, model folders and evaluation reports on disk."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreg import schemas
from docreg.functions.resumable import Sha256
from docreg.session import ship_package

# --- fixed values -----------------------------------------------------------
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tiff", "tif")
WEIGHT_FILES = ("model.safetensors", "pytorch_model.bin")
CONFIG_FILE = "config.json"
REPORT_FILE = "evaluation-report.json"
MAX_REPORT_BYTES = 1024 * 1024
# A larger file is hashed split by split; so many of them at a time.
LARGE_FILE, LARGE_AT_ONCE = 256 * 1024 * 1024, 4
# ----------------------------------------------------------------------------


def read_manifest(spark: SparkSession, path: str, columns: tuple[str, ...] = schemas.MANIFEST_COLUMNS) -> DataFrame:
    """Header-driven manifest CSV; every column a string, blanks kept as ''.

    ``ord`` follows the input order: the file name, then the position in the file.
    Columns the header lacks read as NULL.
    """
    present = spark.read.csv(path, header=True, escape='"').columns
    header = [c.lstrip("﻿") for c in present]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    # Multi-line records stay whole; one file is one split, so position is file order.
    raw = (
        spark.read.schema(schema)
        .csv(path, header=True, escape='"', multiLine=True, enforceSchema=True)
        .withColumn("ord", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")))
    )
    return raw.select(*[
        F.coalesce(F.col(c), F.lit("")).alias(c) if c in header else F.lit(None).cast("string").alias(c)
        for c in columns
    ], "ord")


def _binary_files(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(folder, filename, length, path, modificationTime): every file below ``root``; contents are not read."""
    files = _binary_files(spark, root, glob).select("path", "length", "modificationTime")
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("filename"),
        "length", "path", "modificationTime",
    )


def is_image(filename) -> F.Column:
    return F.lower(filename).rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS) + ")$")


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """(split, filename, length) of the image files below the split folders of ``root``."""
    files = list_files(spark, root).where(is_image(F.col("filename")))
    return files.select(F.col("folder").alias("split"), "filename", "length")


def storage_usage(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_bytes")
    )


def model_inventory(files: DataFrame, base_key: str = "base") -> DataFrame:
    """Folders holding a config and a weights file, with their sorted file names."""
    custom = files.where(F.col("folder") != base_key)
    # Settled from two flags per folder; only the files of real model folders are gathered.
    usable = custom.groupBy("folder").agg(
        F.bool_or(F.col("filename") == CONFIG_FILE).alias("_config"),
        F.bool_or(F.col("filename").isin(*WEIGHT_FILES)).alias("_weights"),
    ).where("_config and _weights").select("folder")
    return custom.join(usable, "folder", "left_semi").groupBy(F.col("folder").alias("key")).agg(
        F.sort_array(F.collect_set("filename")).alias("files"))


def read_evaluation_reports(
    spark: SparkSession, root: str, glob: str = f"*/{REPORT_FILE}", max_bytes: int | None = None,
) -> DataFrame:
    """One row per report: (model_folder, size, <report columns>).

    A report that is not a JSON object keeps its row with an error. So does one above
    ``max_bytes`` (none by default; ``MAX_REPORT_BYTES`` is the usual limit), which is not parsed.
    """
    too_large = F.lit(False) if max_bytes is None else F.col("size") > max_bytes
    raw = (
        spark.read.text(f"{root}/{glob}", wholetext=True)
        .select(
            F.element_at(F.split("_metadata.file_path", "/"), -2).alias("model_folder"),
            F.col("_metadata.file_size").alias("size"), "value",
        )
    )
    parsed = raw.withColumn(
        "report", F.when(~too_large, F.from_json("value", schemas.EVALUATION_REPORT))
    )
    return parsed.select(
        "model_folder", "size",
        F.when(too_large, F.lit(f"the report is larger than {(max_bytes or 0) / MAX_REPORT_BYTES:g} MB")).alias("read_error"),
        "report.*",
    )


def file_digest(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, folder, filename, length, modificationTime, sha256) of each file, of any size.

    A file up to ``LARGE_FILE`` is one row. A larger one is hashed here, split by split: see ``_chained``.
    """
    return _digested(spark, path, glob, lambda files: files)


def _digested(spark: SparkSession, root: str, glob: str | None, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    length = F.col("length")
    parts = F.split("path", "/")
    small = wanted(_binary_files(spark, root, glob).where(length <= LARGE_FILE)).select(
        "path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("filename"),
        "length", "modificationTime", F.sha2("content", 256).alias("sha256"),
    )
    large = wanted(list_files(spark, root, glob).where(length > LARGE_FILE)).select(
        "path", "folder", "filename", "length", F.unix_micros("modificationTime").alias("_at")).collect()
    if not large:
        return small
    ship_package(spark)
    with ThreadPoolExecutor(LARGE_AT_ONCE) as pool:
        digests = list(pool.map(lambda file: _chained(spark, file.path, file.length), large))
    hashed = spark.createDataFrame(
        [(*file, digest) for file, digest in zip(large, digests)],
        "path string, folder string, filename string, length long, _at long, sha256 string")
    return small.unionByName(hashed.withColumn("modificationTime", F.timestamp_micros("_at")).drop("_at"))


def _chained(spark: SparkSession, path: str, length: int) -> str:
    """SHA-256 of one file, each split hashed by a task of its own from where the split before it ended.

    The splits are those of Spark's text reader, cut at line feeds; a stretch without one is read whole. Only the
    state of the hash passes through the driver. The reader drops a byte order mark and does not tell whether the
    last line is ended; both follow from the length, which is checked.
    """
    literal = re.sub(r"([\\\[\]{}*?])", r"\\\1", path)
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(literal).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("start"))
    splits = lines.rdd.getNumPartitions()
    for mark in (b"", codecs.BOM_UTF8):
        begun = Sha256()
        begun.update(mark)
        state, done, start = begun.state, len(mark), -1
        for split in range(splits):
            step = lines.mapInArrow(_go_on(state, done, start), "state binary, done long, start long")
            (state, done, start), = spark.sparkContext.runJob(step.rdd, list, [split])
        sha = Sha256(bytes(state))
        if done == length - 1:
            sha.update(b"\n")
        if done in (length, length - 1):
            return sha.hexdigest()
    raise ValueError(f"{path}: {done} bytes read of {length}; files that Spark's text reader unpacks "
                     "or that change meanwhile cannot be hashed in pieces")


def _go_on(state: bytes, done: int, start: int):
    """Batch function over the lines of one split: hashes them behind ``done`` bytes of the file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, length, at = Sha256(bytes(state)), done, start
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = batch.column("start")[0].as_py()
            if begin <= start or at not in (start, begin):
                raise ValueError("the splits of the file are out of order")
            data = b"\n".join(batch.column("line").to_pylist())
            if at >= 0:
                data = b"\n" + data
            at = begin
            sha.update(data)
            length += len(data)
        yield pa.RecordBatch.from_pydict({"state": [sha.state], "done": [length], "start": [at]})

    return run


def refresh_digests(spark: SparkSession, root: str, known: DataFrame, glob: str | None = None) -> DataFrame:
    """Digest only files whose (path, length, modificationTime) is not in ``known`` yet; returns the full table.

    A rewritten file of equal length is digested again. Known files are dropped before the digest.
    """
    version = ["path", "length", "modificationTime"]
    fresh = _digested(spark, root, glob, lambda files: files.join(known.select(*version), version, "left_anti"))
    kept = known.join(list_files(spark, root, glob).select(*version), version, "left_semi")
    return kept.unionByName(fresh.select(*kept.columns))
