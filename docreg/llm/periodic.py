"""Periodic runs of words, found on tiles of each period octave and stitched by document and period.

A run is a maximal stretch of words with smallest period q and a length of at least
``max(24, 3 * q)``. Octave P (8, 16, 32, ...) covers the periods above P up to 2 P; the octave
``0`` covers 1 to 8 with P = 8. Each document is exploded into tiles of 5 P words, one around
every multiple of P, so neighbouring tiles overlap by 4 P. In its tile, a run of the octave
repeats the P words behind the boundary one period later. Tiles where hashes of P words agree
are solved on their own: the Z-functions forwards and backwards from the boundary tell how far
each period reaches inside the tile, and leave out periods with a smaller one inside. The
interval fragments are shuffled by document and period and stitched where they overlap by at
least a period.

The first boundary behind a run's start lies less than P words behind it and the last one with
a full repetition less than 4 P words before its end, so the fragments of a run add up to the
whole of it, whatever its length.

Defined cases: null and empty texts have no words and no runs; rows that repeat a doc_id are
told apart and reported once each; a null doc_id has the crc of the empty string. Texts of any length
are read whole; hashes choose tiles only, words decide.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreg.llm.common import shared_folder
from docreg.session import ship_package

LEAST = 24
REPEATS = 3
BASE = 8
BATCH_WORDS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document by crc32 of its id repeats itself from some word on."""
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[:n - a]


def z_function(s: list) -> list[int]:
    """For every place, the length of the longest common prefix of ``s`` and what starts there."""
    n = len(s)
    z, left, right = [n] + [0] * (n - 1) if n else [], 0, 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(words: list, start: int, boundary: int, stop: int, scale: int, periods: list[int]) -> Iterator[tuple[int, int, int]]:
    """(period, start, stop) of the fragments around ``boundary`` inside ``words[start:stop]``.

    Of ``periods`` only those count that repeat ``scale`` words behind the boundary and have no
    proper divisor that is a period of the same words.
    """
    ahead = z_function(words[boundary:stop])
    behind = words[start:boundary][::-1]
    back = z_function([*behind, None, *words[start:min(stop, boundary + max(periods))][::-1]])
    for p in periods:
        need = p + scale
        if ahead[p] < scale or any(p % q == 0 and ahead[q] >= need - q for q in range(1, p // 2 + 1)):
            continue
        # Common suffix of the words before the boundary and those before boundary + p.
        at = len(behind) + 1 + min(stop, boundary + max(periods)) - (boundary + p)
        yield p, boundary - min(back[at], len(behind)), boundary + p + ahead[p]


def octaves(words: int) -> Iterator[tuple[int, int, int]]:
    """(scale, first period, last period) of every octave in which a run fits into so many words."""
    if words >= LEAST:
        yield BASE, 1, BASE
    scale = BASE
    while REPEATS * (scale + 1) <= words:
        yield scale, scale + 1, 2 * scale
        scale *= 2


def matching_tiles(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(document, scale, boundary, periods) of the tiles worth solving.

    ``ids`` are the word hashes of several documents in a row, document i at begins[i]:ends[i].
    Boundaries are counted from the start of a document.
    """
    lengths = ends - begins
    grams, width = ids, 1
    for scale, first, last in octaves(int(lengths.max(initial=0))):
        while width < scale:  # hashes of twice as many words from two neighbours
            grams = (grams[:-width] * _MIX ^ (grams[:-width] >> np.uint64(29))) + grams[width:] if len(grams) > width else grams[:0]
            width *= 2
        counts = np.maximum(0, (lengths - scale - first) // scale + 1)
        owner = np.repeat(np.arange(len(lengths)), counts)
        if not len(owner):
            continue
        order = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        places = begins[owner] + order * scale
        steps = np.arange(first, last + 1)
        rows = max(1, 500_000 // len(steps))
        for cut in range(0, len(places), rows):
            at = places[cut:cut + rows]
            seen = at[:, None] + steps
            inside = seen + scale <= ends[owner[cut:cut + rows]][:, None]
            same = (grams[np.minimum(seen, len(grams) - 1)] == grams[at][:, None]) & inside
            for i in np.flatnonzero(same.any(axis=1)).tolist():
                yield int(owner[cut + i]), scale, int(order[cut + i]) * scale, steps[same[i]]


def fragments(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Fragments (period, start, stop) of each of several documents, tile by tile."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begins = ends - [len(t) for t in texts]
    ids = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, int(ends[-1]) if len(ends) else 0).view(np.uint64)
    for doc, scale, boundary, periods in matching_tiles(ids, begins, ends):
        words = texts[doc]
        start, stop = max(0, boundary - scale), min(len(words), boundary + 4 * scale)
        out[doc] += solve_tile(words, start, boundary, stop, scale, periods.tolist())
    return out


def tiled(documents: DataFrame, whole: bool = False) -> DataFrame:
    """(row, doc_id, words, digest, fragments) of every row.

    ``words`` (joined by one blank) are kept only where there are fragments, so that only texts with a
    repetition travel; the other rows carry their digest. With ``whole`` every row keeps its words.
    """
    ship_package(documents.sparkSession)

    def flush(rows: list[tuple], texts: list[list[bytes]]) -> pa.RecordBatch:
        found = fragments(texts)
        words = [b" ".join(t) for t in texts]
        flat = [f for fs in found for f in fs]
        parts = pa.StructArray.from_arrays([pa.array([f[i] for f in flat], pa.int32()) for i in range(3)], ["period", "start", "stop"])
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([w if f or whole else None for w, f in zip(words, found)], pa.binary()),
            pa.array([None if f or whole else hashlib.sha256(w).hexdigest() for w, f in zip(words, found)], pa.string()),
            pa.ListArray.from_arrays(pa.array(offsets), parts)], ["row", "doc_id", "words", "digest", "fragments"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, held = [], [], 0
            for i in range(batch.num_rows):
                doc_id = batch.column(1)[i].as_py()
                words = rewritten((batch.column(2)[i].as_py() or "").encode().split(), doc_id)
                rows.append((batch.column(0)[i].as_py(), doc_id))
                texts.append(words)
                held += len(words)
                if held >= BATCH_WORDS:
                    yield flush(rows, texts)
                    rows, texts, held = [], [], 0
            if rows:
                yield flush(rows, texts)

    numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                                F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(run, "row bigint, doc_id bigint, words binary, digest string, "
                                    "fragments array<struct<period:int, start:int, stop:int>>")


def stitch(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments (keys, period, start, stop) to runs (keys, period, start, length).

    Two fragments of one period that overlap by at least a period are parts of one run.
    """
    by = Window.partitionBy(*keys, "period").orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = pieces.withColumn("opens", F.coalesce((F.col("start") + F.col("period") > before).cast("long"), F.lit(1)))
    islands = opens.withColumn("island", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    length: Column = F.col("stop") - F.col("start")
    return islands.groupBy(*keys, "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select(
        *keys, "period", "start", length.alias("length")).where(length >= F.greatest(F.lit(LEAST), F.lit(REPEATS) * F.col("period")))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that any run (start, length, period) holds behind its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Run (start, length, period) of greatest length / period; ties go to the smallest start, then period."""
    best = runs[0]
    for run in runs[1:]:
        more = run[1] * best[2] - best[1] * run[2]
        if more > 0 or more == 0 and (run[0], run[2]) < (best[0], best[2]):
            best = run
    return best


def runs_of(documents: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): the settled rows of ``tiled`` and (row, runs) with the sorted runs (start, length, period) of a row."""
    path = f"{shared_folder(documents.sparkSession)}/tiles-{uuid.uuid4().hex}"
    tiled(documents, whole).write.parquet(path)
    rows = documents.sparkSession.read.parquet(path)
    pieces = rows.where(F.size("fragments") > 0).select("row", F.inline("fragments"))
    return rows, stitch(pieces, ["row"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))


def finish(rows: DataFrame, each: Callable[[list[bytes], list[tuple[int, int, int]]], dict], schema: str) -> DataFrame:
    """``each(words, runs)`` for rows (doc_id, words, runs)."""
    ship_package(rows.sparkSession)
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    columns = [part.split() for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = []
                for words, runs in zip(part.column(1), part.column(2)):
                    listed = [(r["start"], r["length"], r["period"]) for r in runs.as_py() or []]
                    found.append(each((words.as_py() or b"").split(), listed))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[name] for f in found], kinds[kind]) for name, kind in columns)],
                                                 ["doc_id", *(name for name, _ in columns)])

    return rows.mapInArrow(run, f"doc_id bigint, {schema}")


def _digests(words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
    start, length, period = strongest(runs) if runs else (None, None, None)
    return {"n_runs": len(runs), "start": start, "length": length, "period": period,
            "exponent_milli": 1000 * length // period if runs else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()}


def report(documents: DataFrame) -> DataFrame:
    """Runs and collapsed text of every row: counts, the strongest run, digests."""
    rows, runs = runs_of(documents)
    schema = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
              "runs_sha256 string, collapsed_sha256 string")
    repeating = rows.where("words is not null").select("row", "doc_id", "words").join(runs, "row", "left").select("doc_id", "words", "runs")
    plain = rows.where("words is null").select(
        "doc_id", F.lit(0).cast("bigint").alias("n_runs"), *(F.lit(None).cast("bigint").alias(c) for c in ("start", "length", "period", "exponent_milli")),
        F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"), F.col("digest").alias("collapsed_sha256"))
    return finish(repeating, _digests, schema).unionByName(plain)


def collapse(documents: DataFrame) -> DataFrame:
    """(doc_id, text): every row's words without the repetitions of its runs."""
    rows, runs = runs_of(documents, whole=True)
    joined = rows.select("row", "doc_id", "words").join(runs, "row", "left").select("doc_id", "words", "runs")
    return finish(joined, lambda words, found: {"text": b" ".join(collapsed(words, found)).decode()}, "text string")
