"""Benchmark decontamination by pigeonhole edit matching.

An item occurs in a text if some stretch of the text is within an edit budget of it. The
budget is a share of the item's length. An item cut into budget + 1 pieces keeps one piece
unharmed, so exact hits of the pieces (one automaton over all of them) give every place
worth a look; Myers' bit-parallel distance decides there.

Texts and items are compared lower-cased, with white space runs as one space. Items are
read in blocks of bounded size, each matched against all documents in one pass.

Defined cases: null and empty texts match nothing; null and blank items are skipped; items
that are equal after normalisation are all reported; repeated rows report once per
(doc_id, item_id); whole texts are searched; overlapping hits keep the smallest distance,
then the first place.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreg.llm.common import forget
from docreg.session import ship_package

Item = tuple[int, str]


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``budget + 1`` parts of nearly equal length."""
    edges = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:]) if b > a]


def closest(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the stretch of ``text`` nearest to ``item``, if within ``budget``; Myers' bit vectors."""
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, ch in enumerate(item):
        places[ch] = places.get(ch, 0) | 1 << i
    plus, minus, score = mask, 0, m
    best: tuple[int, int] | None = None
    for end, ch in enumerate(text, 1):
        eq = places.get(ch, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & mask
        up = minus | ~(diagonal | plus) & mask
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & mask, down << 1 & mask
        plus = (down | ~(diagonal | up)) & mask
        minus = up & diagonal
        if score <= budget and (best is None or score < best[0]):
            best = (score, end)
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[Item], rate: float):
        self.texts: list[tuple[str, int]] = []
        self.ids: list[list[int]] = []
        by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            by_text.setdefault(text, []).append(item_id)
        parts: dict[str, list[tuple[int, int]]] = {}
        for text, ids in by_text.items():
            budget = int(len(text) * rate)
            for offset, piece in pieces(text, budget):
                parts.setdefault(piece, []).append((len(self.texts), offset))
            self.texts.append((text, budget))
            self.ids.append(ids)
        self.automaton = ahocorasick.Automaton()
        for piece, where in parts.items():
            self.automaton.add_word(piece, (len(piece), where))
        if parts:
            self.automaton.make_automaton()

    def find(self, raw: str | None) -> Iterator[tuple[int, int, int]]:
        """(index of the item text, distance, end) of every item that occurs, with its best place."""
        text = normalised(raw)
        if not text or not self.texts:
            return
        starts: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for index, offset in where:
                starts.setdefault(index, []).append(end + 1 - size - offset)
        for index, found in starts.items():
            item, budget = self.texts[index]
            best: tuple[int, int] | None = None
            found.sort()
            i = 0
            while i < len(found):
                first = last = found[i]
                while i < len(found) and found[i] - last <= 2 * budget:
                    last = found[i]
                    i += 1
                if text.startswith(item, max(first, 0)):
                    place: tuple[int, int] | None = (0, max(first, 0) + len(item))
                else:
                    begin = max(first - budget, 0)
                    place = closest(item, text[begin:last + len(item) + budget], budget)
                    place = place and (place[0], place[1] + begin)
                if place and (best is None or place < best):
                    best = place
                if best and best[0] == 0:
                    break
            if best:
                yield index, best[0], best[1]


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[Item]]:
    """Normalised items in blocks of about ``block_chars`` characters."""
    rows = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    block: list[Item] = []
    size = 0
    for item_id, text in rows.toLocalIterator():
        item = normalised(text)
        if not item:
            continue
        if block and size + len(item) > block_chars:
            yield block
            block, size = [], 0
        block.append((item_id, item))
        size += len(item)
    if block:
        yield block


def find_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, distance, budget, end_at): items that occur in documents, each pair once.

    ``end_at`` is the end of the best place in the normalised text.
    """
    ship_package(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, distance int, budget int, end_at int"
    found = None
    for block in blocks(benchmark, block_chars):
        def search(batches: Iterator[pa.RecordBatch], block: list[Item] = block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for batch in batches:
                rows = [(doc_id.as_py(), item_id, distance, matcher.texts[index][1], end)
                        for doc_id, text in zip(batch.column(0), batch.column(1))
                        for index, distance, end in matcher.find(text.as_py()) for item_id in matcher.ids[index]]
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 ["doc_id", "item_id", "distance", "budget", "end_at"])

        hits = texts.mapInArrow(search, schema)
        found = hits if found is None else found.union(hits)
    if found is None:
        return documents.sparkSession.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end_at", "budget")).alias("m")).select(
        "doc_id", "item_id", "m.distance", "m.budget", "m.end_at")


def _leaks_of(block: list[Item], rate: float):
    def leaks(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        matcher = Matcher(block, rate)
        for texts in parts:
            yield pa.array([next(matcher.find(t.as_py()), None) is not None for t in texts], pa.bool_())

    # The annotations of this module are strings; Spark reads the types.
    leaks.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return leaks


def keep_clean(documents: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of ``documents`` in which no item occurs, with their own columns."""
    ship_package(documents.sparkSession)
    out = documents
    for block in blocks(benchmark, block_chars):
        out = out.where(~F.arrow_udf(_leaks_of(block, rate), "boolean")(F.col("text").cast("string")))
    return out
