"""Exact dedup by an extendible-hash index on shared files.

Texts are equal when they are identical without white space. A 64-bit hash of the remaining
bytes is the key of a text; the leading bits of the key address a directory, whose entries
point at buckets. Buckets with more than ``capacity`` bytes are split by one bit more, which
doubles the directory where the bucket already used all its bits, until every bucket fits or
holds a single key. Buckets are key ranges and files of the shared folder: the task that owns
a bucket reads its arriving texts in key order, compares bytes and chains the different texts
of one key as links 0, 1, ....

Copies do not pile up: each batch of a scan hands over a text once, and rows are summed up per
text before anything is grouped, so a text held by a third of all rows reaches its owner once
per batch. ``insert`` takes further documents into an index that exists; only buckets that
receive texts are read and written anew.

Defined cases: null counts as empty, and all texts without a visible character are equal; rows
that repeat both doc_id and text cannot be told apart and are judged alike, all kept or all
dropped; a null doc_id comes after all others; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docreg.llm.common import BROADCAST_ROWS, settle, shared_folder
from docreg.session import ship_package

BITS = 64
CAPACITY = 16 << 20
_GAPS = b" \t\n\x0b\x0c\r"
_ROW = "doc_id bigint, chars bigint, size bigint, key bigint, digest binary"
_LINK = "bucket string, key bigint, link int, digest binary, size bigint, text binary"


def key_of(text: bytes) -> int:
    """Signed 64-bit key of a normalised text."""
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _GAPS)


def _arrow(df: DataFrame, each: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """``mapInArrow`` over slices of a few hundred rows; ``each`` turns rows into rows."""
    ship_package(df.sparkSession)
    fields = [part.split() for part in schema.split(",")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                rows = each(list(zip(*(c.to_pylist() for c in part.columns))))
                columns = zip(*rows) if rows else [()] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])

    return df.mapInArrow(run, schema)


def rows_of(documents: DataFrame, key: Callable[[bytes], int] = key_of) -> DataFrame:
    """(doc_id, chars, size, key, digest) of every row: light, without texts."""
    def each(rows: list) -> list[tuple]:
        out = []
        for doc_id, text in rows:
            plain = normalised(text)
            out.append((doc_id, len(text or ""), len(plain), key(plain), hashlib.sha256(plain).digest()))
        return out

    return _arrow(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), each, _ROW)


def arrivals(documents: DataFrame, key: Callable[[bytes], int] = key_of) -> DataFrame:
    """(key, digest, text): every text once per slice of a scan."""
    def each(rows: list) -> list[tuple]:
        texts = dict.fromkeys(normalised(text) for text, in rows)
        return [(key(t), hashlib.sha256(t).digest(), t) for t in texts]

    return _arrow(documents.select(F.col("text").cast("string")), each, "key bigint, digest binary, text binary")


def _prefix(key: Column, depth: Column) -> Column:
    """The leading ``depth`` bits of a key, as a string of 0 and 1."""
    return F.substring(F.lpad(F.conv(F.hex(key), 16, 2), BITS, "0"), F.lit(1), depth)


def empty_directory(spark: SparkSession, depth: int) -> DataFrame:
    """(bucket, depth) with every bucket of ``depth`` bits."""
    bits = F.substring(F.lpad(F.conv(F.col("id").cast("string"), 10, 2), BITS, "0"), BITS - depth + 1, depth)
    return spark.range(1 << depth).select(bits.alias("bucket"), F.lit(depth).alias("depth"))


def grow_directory(slots: DataFrame, buckets: DataFrame | None, capacity: int) -> DataFrame:
    """(bucket, depth) with ``slots`` (key, size) taken in; a bucket is named by its bits.

    Without ``buckets`` the doublings that evenly spread keys need in any case are taken at
    once. Then each round gives every overfull bucket of several keys one bit more.
    """
    if buckets is None:
        total = slots.agg(F.sum("size")).first()[0] or 0
        buckets = empty_directory(slots.sparkSession, max(0, (total // capacity).bit_length() - 1))
    directory = settle(buckets.select("bucket", "depth"))
    held = settle(addressed(slots.select("key", "size"), directory))
    while True:
        sizes = held.groupBy("bucket", "depth").agg(F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        full = settle(sizes.where((F.col("size") > capacity) & (F.col("lo") < F.col("hi")) & (F.col("depth") < BITS)).select("bucket"))
        if full.isEmpty():
            return directory
        halves = full.select(F.explode(F.array(F.concat("bucket", F.lit("0")), F.concat("bucket", F.lit("1")))).alias("bucket"))
        directory = settle(directory.join(full, "bucket", "left_anti").union(halves.select("bucket", F.length("bucket").alias("depth"))))
        held = settle(held.join(full, "bucket", "left_semi").select(
            "key", "size", _prefix(F.col("key"), F.col("depth") + 1).alias("bucket"), (F.col("depth") + 1).alias("depth")))


def addressed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` (with key) and the (bucket, depth) each key leads to.

    Rows and buckets meet in the bits that all buckets have; of the few buckets below them one
    begins the key. A directory of more than 400,000 buckets is not broadcast.
    """
    least, count = buckets.agg(F.min("depth"), F.count("*")).first()
    base = F.substring(F.col("bucket"), F.lit(1), F.lit(least))
    directory = buckets.select("bucket", "depth", base.alias("base"))
    directory = F.broadcast(directory) if count <= BROADCAST_ROWS else directory
    bits = rows.withColumn("bits", _prefix(F.col("key"), F.lit(BITS))).withColumn("base", F.substring(F.col("bits"), F.lit(1), F.lit(least)))
    return bits.join(directory, "base").where(F.col("bits").startswith(F.col("bucket"))).drop("base", "bits")


@dataclass
class HashIndex:
    """Directory (bucket, depth, folder) and the links its bucket files hold."""

    spark: SparkSession
    directory: DataFrame

    def links(self) -> DataFrame:
        """(bucket, key, link, digest, size, text) of every text in the index."""
        folders = [r.folder for r in self.directory.where("folder is not null").select("folder").distinct().collect()]  # one per insert
        parts = [self.spark.read.schema(_LINK).parquet(f).withColumn("folder", F.lit(f)) for f in folders]
        if not parts:
            return self.spark.createDataFrame([], _LINK)
        if len(parts) == 1:
            return parts[0].drop("folder")
        held = parts[0]
        for part in parts[1:]:
            held = held.union(part)
        return held.join(self.directory.select("bucket", "folder"), ["bucket", "folder"], "left_semi").drop("folder")


def owned(arriving: DataFrame) -> DataFrame:
    """Links (bucket, key, link, digest, size, text) of arriving rows (bucket, key, digest, text).

    All rows of a bucket meet in the task that owns it, in key order, so that only the chain of
    the present key is held. Digests order a chain; bytes decide what is equal.
    """
    ship_package(arriving.sparkSession)
    ordered = arriving.select("bucket", "key", "digest", "text").repartition("bucket").sortWithinPartitions("bucket", "key", "digest")
    names = ["bucket", "key", "link", "digest", "size", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain = None, []
        for batch in batches:
            fresh = []
            for bucket, key, digest, text in zip(*(c for c in batch.columns)):
                place = (bucket.as_py(), key.as_py())
                if place != at:
                    at, chain = place, []
                value = text.as_py()
                if value in chain:
                    continue
                fresh.append((*place, len(chain), digest.as_py(), len(value), value))
                chain.append(value)
            if fresh:
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*fresh), kinds)], names)

    return ordered.mapInArrow(run, _LINK)


def insert(index: HashIndex | None, documents: DataFrame, folder: str, capacity: int = CAPACITY,
           key: Callable[[bytes], int] = key_of, rows: DataFrame | None = None) -> HashIndex:
    """The index with the texts of ``documents`` taken in; bucket files go to ``folder``.

    Buckets that receive nothing keep their file.
    """
    spark = documents.sparkSession
    rows = rows if rows is not None else rows_of(documents, key)
    slots = rows.groupBy("key", "digest").agg(F.max("size").alias("size"))
    old = index.directory if index else None
    if index:
        slots = slots.union(index.links().select("key", "digest", "size")).groupBy("key", "digest").agg(F.max("size").alias("size"))
    buckets = grow_directory(slots.select("key", "size"), old.select("bucket", "depth") if index else None, capacity)
    incoming = addressed(arrivals(documents, key), buckets)
    if index:
        touched = settle(addressed(rows.select("key").distinct(), buckets).select("bucket").distinct().union(
            buckets.join(old, "bucket", "left_anti").select("bucket")).distinct())
        stored = addressed(index.links().select("key", "digest", "text"), buckets).join(touched, "bucket", "left_semi")
        incoming = incoming.select("bucket", "key", "digest", "text").unionByName(stored.select("bucket", "key", "digest", "text"))
    owned(incoming).write.option("compression", "zstd").parquet(folder)
    if index:
        kept = buckets.join(touched, "bucket", "left_anti").join(old.select("bucket", "folder"), "bucket")
        moved = buckets.join(touched, "bucket", "left_semi").withColumn("folder", F.lit(folder))
        directory = kept.unionByName(moved.select("bucket", "depth", "folder"))
    else:
        directory = buckets.withColumn("folder", F.lit(folder))
    return HashIndex(spark, settle(directory.select("bucket", "depth", "folder")))


def groups(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(key, digest, keep_id, chars, group_size): the row that stays of every text."""
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id")))
    summed = rows.groupBy("key", "digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    named = summed.join(links.select("key", "digest", "link"), ["key", "digest"])
    return named.select("key", "link", "digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("chars"), "group_size")


def report(documents: DataFrame, capacity: int = CAPACITY, key: Callable[[bytes], int] = key_of) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too."""
    rows = settle(rows_of(documents, key))
    folder = f"{shared_folder(documents.sparkSession)}/buckets-{uuid.uuid4().hex}"
    index = insert(None, documents, folder, capacity, key, rows)
    # Settled, so that the join below is one of two plain exchanges, which Spark splits where a text is frequent.
    found = settle(groups(rows, index.links()))
    joined = rows.alias("r").join(found.alias("g"), ["key", "digest"])
    same = F.col("r.doc_id").eqNullSafe(F.col("g.keep_id")) & (F.col("r.chars") == F.col("g.chars"))
    return joined.select(F.col("r.doc_id").alias("doc_id"), "keep_id", "group_size", same.alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``documents`` that stay, with all their columns; rows without doc_id stay."""
    kept = report(documents, capacity).where("kept").select("doc_id").distinct()
    return documents.join(kept, "doc_id", "left_semi").unionByName(documents.where("doc_id is null"))
