"""Shared pieces: reading tables, checkpoints, word columns and span columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docreg.session import CHECKPOINT_CONF, cut_lineage

WORD_GAP = r"[\x20\x09-\x0D]+"
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that later jobs neither recompute nor disagree."""
    return cut_lineage(df, eager=True)


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder every executor reaches, from ``spark.checkpoint.dir``."""
    cut_lineage(spark.range(0))  # names a folder where the session has none
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    return base if ":/" in base else f"file://{base}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back.

    For loops of many steps: a checkpoint hands the constraints of its plan on to the next
    one, which planning then spends more and more time on; a table read back has none.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_held: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by a Python worker from task to task; a worker keeps one such thing at a time.

    Workers outlive the job they kept it for, and Spark takes idle ones in turn, so steps
    that follow in the same application call ``forget``.
    """
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Drop what this worker keeps of an earlier step."""
    if _held:
        _held.clear()
        pa.default_memory_pool().release_unused()


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.array_remove(F.split(text, WORD_GAP), "")


def held_out(doc_id: Column) -> Column:
    """Every fifth document by crc32 of its id as text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of ``key`` alone, so that a retry draws the same ones."""
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * 1_000_000)
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1_000_000)) < share)


def only_ids(df: DataFrame, key: str, ids: DataFrame, count: int) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (one column named ``key``, ``count`` rows).

    A short list is broadcast, so that only matching rows leave the scan; a longer one
    takes an ordinary shuffled semi-join.
    """
    return df.join(F.broadcast(ids) if count <= BROADCAST_ROWS else ids, key, "left_semi")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A projected column would be substituted at every place where a later filter or
    projection uses it; a lambda variable is not. The fold runs over no elements: only its
    start value and its finish count.
    """
    return F.aggregate(F.array(), value, lambda acc, _: acc, body)


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value, before, after>>.

    Positions are code points, the end is exclusive. ``before`` and ``after`` are the
    texts between this match and its neighbours. Spark has no function for positions:
    the pieces between the matches and the matches themselves add up to them.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string,before:string,after:string>>)")
    pairs = F.transform(hits, lambda hit, i: F.struct(
        hit.alias("value"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after")))

    def step(acc: Column, pair: Column) -> Column:
        start = (acc["at"] + F.length(pair["before"])).cast("int")
        end = (start + F.length(pair["value"])).cast("int")
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), pair["value"].alias("value"),
            pair["before"].alias("before"), pair["after"].alias("after")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(empty)
