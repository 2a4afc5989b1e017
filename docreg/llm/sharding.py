"""Sharding by sampled splitters.

Records are ordered by (crc32 of the text, hash of the id, row number), so that equal texts
lie together and yet any run of them can be cut. A size-weighted sample of these keys gives
quantile boundaries of many small ranges; ranges that turn out overfull are subdivided with a
sample of their own. Counts and bytes per range give each range its place, running sums inside
a range give each record its own, and a record belongs to the shard its middle byte falls in:
the law is ``bytes``, shards differ by about one record.

Defined cases: a null text has size 1; repeated rows are told apart by their row number; a
null doc_id is allowed; an empty table gives no rows; one record may be larger than a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docreg.llm.common import settle
from docreg.session import ship_package


def light_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, row): all that placing needs, settled once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    spread = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30))
    return settle(rows.withColumn("key", F.shiftleft("text_crc32", 30) + spread).withColumn("row", F.monotonically_increasing_id()))


def splitters(rows: DataFrame, total: int, ranges: int, per_range: int = 20) -> list[tuple[int, int]]:
    """At most ``ranges - 1`` boundaries (key, row) from a sample weighted by size.

    A record is drawn with a chance in proportion to its size, by a hash of its key, so a
    retry draws the same; about ``ranges * per_range`` records reach the driver.
    """
    if ranges < 2 or not total:
        return []
    unit = 1 << 40
    chance = F.least(F.col("size") * F.lit(ranges * per_range * unit / total), F.lit(float(unit)))
    drawn = sorted(tuple(r) for r in rows.where(
        F.pmod(F.xxhash64("key", "row"), F.lit(unit)) < chance).select("key", "row").collect())
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def with_range(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Add ``range``: how many boundaries lie at or below (key, row)."""
    ship_package(rows.sparkSession)
    keys = np.array([k for k, _ in bounds], np.int64)
    numbers = np.array([r for _, r in bounds], np.int64)

    def place(key: pd.Series, row: pd.Series) -> pd.Series:
        k, r = key.to_numpy(), row.to_numpy()
        # Boundaries come first among equals, so the rank of a record counts them.
        order = np.lexsort((np.r_[np.zeros(len(keys)), np.ones(len(k))], np.r_[numbers, r], np.r_[keys, k]))
        below = np.cumsum(order < len(keys))
        out = np.empty(len(order), np.int64)
        out[order] = below
        return pd.Series(out[len(keys):])

    place.__annotations__ = {"key": pd.Series, "row": pd.Series, "return": pd.Series}
    return rows.withColumn("range", F.pandas_udf(place, "bigint")("key", "row"))


def shard_documents(documents: DataFrame, shards: int = 16, ranges: int = 256) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    rows = light_rows(documents)
    totals = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total = totals["bytes"] or 0
    bounds = splitters(rows, total, ranges)
    sized = with_range(rows, bounds).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    full = {r["range"]: r["bytes"] for r in sized if r["rows"] > 1 and r["bytes"] > 2 * total / ranges}
    if full:
        inside = with_range(rows, bounds).where(F.col("range").isin(list(full)))
        more = [b for k, size in full.items() for b in splitters(inside.where(F.col("range") == k), size, -(-size * ranges // total))]
        bounds = sorted({*bounds, *more})
    ranged = settle(with_range(rows, bounds))
    sums = sorted((r["range"], r["bytes"], r["n"]) for r in ranged.groupBy("range").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
    starts, bytes_before, rows_before = [], 0, 0
    for number, size, count in sums:
        starts.append((number, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + size, rows_before + count
    # One row per range: a few hundred.
    offsets = documents.sparkSession.createDataFrame(starts, "range bigint, bytes0 bigint, rows0 bigint")
    inside = Window.partitionBy("range").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("run", F.sum("size").over(inside)).withColumn("at", F.count("*").over(inside)).join(
        F.broadcast(offsets), "range")
    middle = F.col("bytes0") + F.col("run") - F.col("size") / 2
    placed = settle(placed.select(
        "doc_id", "size", "text_crc32", (F.col("rows0") + F.col("at") - 1).alias("index"),
        F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard")))
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"))


def report(documents: DataFrame, shards: int = 16) -> DataFrame:
    placed = shard_documents(documents, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def write_shards(documents: DataFrame, path: str, shards: int = 16) -> None:
    """Write ``documents`` (unique doc_id) as Parquet, one folder per shard, in slot order inside each file."""
    placed = shard_documents(documents, shards).select("doc_id", "shard", "slot")
    documents.join(placed, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot") \
        .write.partitionBy("shard").parquet(path)
