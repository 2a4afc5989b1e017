"""Byte-level BPE: Spark higher-order functions fold ranked merges over byte arrays of words.

A text is cut by the tokenizer's pattern. Each word becomes the array of its bytes, each
packed with its id and the rank of the pair it begins, and a fold merges the adjacent pair
of lowest rank (leftmost first) until no pair has a rank. The rank map is a table of (pair of ids, rank) packed
in longs, addressed by a collision-free hash, since Spark's own map type is searched from end to
end. It comes as a scalar subquery: a literal would be spelt out in every description of a plan.

The fold costs far more than a lookup, so each text folds only distinct words: the frequent
words of a bounded sample are folded once and kept in a memory of bounded size, a task cuts
its texts and looks their words up, and what is left goes to the fold as one array of distinct
words per text. The memory steers the work only; results never depend on it. Decoding looks
up the bytes of each id and concatenates them.

Defined cases: null and empty texts have no tokens; the digest of no ids is that of the empty
string; repeated rows get equal results.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.ipc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docreg.llm.common import bounded_sample, forget, held, let
from docreg.session import ship_package

_HOMES = 49_999
_AWAYS = 200_003
_BITS = 17
_ID = 1 << 16
_MASK = (1 << _BITS) - 1
_RANK = 46
_EDGE = (_ID << _RANK) | (1 << 45) | _MASK
LONGEST_KNOWN = 64
ROWS = 500


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Rank file of lines ``base64 rank``; a vocabulary of at most 65,536 pieces."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    if max(ranks.values()) >= _ID:
        raise ValueError("ranks must be below 65536")
    return ranks


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """(shifts, slots) with every pair of ids that merges, as ``key * 2^17 + rank``, in slot ``key mod _AWAYS + shifts[key mod _HOMES]``.

    The key of a pair is ``a * 2^17 + b``; no two pairs have one slot.
    """
    groups: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                key = (a << _BITS) + b
                groups.setdefault(key % _HOMES, []).append((key, rank))
    shifts, slots = [0] * _HOMES, [-1] * (2 * _AWAYS)
    for home, pairs in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
        away = [key % _AWAYS for key, _ in pairs]
        if len(set(away)) < len(away):
            raise ValueError("two pairs share both hashes")
        shifts[home] = shift = next(k for k in range(_AWAYS) if all(slots[x + k] < 0 for x in away))
        for x, (key, rank) in zip(away, pairs):
            slots[x + shift] = (key << _BITS) + rank
    return shifts, slots[:_AWAYS + max(shifts)]


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _lists(parts: list[bytes]) -> pa.Array:
    """array<int> column of little-endian 32-bit numbers."""
    offsets = np.fromiter(accumulate((len(p) // 4 for p in parts), initial=0), np.int32, len(parts) + 1)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _arrow(df: DataFrame, each: Callable[[pa.RecordBatch], list[pa.Array]], schema: str) -> DataFrame:
    """``mapInArrow`` with ``each(batch) -> columns`` over slices of few rows."""
    ship_package(df.sparkSession)
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                yield pa.RecordBatch.from_arrays(each(batch.slice(start, ROWS)), names)

    return df.mapInArrow(run, schema)


def _inner(cells: pa.ListArray) -> pa.Array:
    """Ids of each word's cells, without the edges, as little-endian 32-bit numbers."""
    sizes = cells.value_lengths().to_numpy()
    flat = (cells.flatten().to_numpy() & _MASK).astype("<i4")
    ends = np.cumsum(sizes)
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = inside[ends - sizes] = False
    offsets = np.concatenate([[0], np.cumsum(4 * (sizes - 2))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside].tobytes())])


def _memory(shared: Broadcast, key: str) -> dict[str, bytes]:
    """Ids of the known words, unpacked once per worker process and tokenizer (``key``)."""
    def unpacked() -> dict[str, bytes]:
        words, ids = pa.ipc.open_stream(shared.value).read_all().columns if shared.value else ([], [])
        return dict(zip(*(c.to_numpy().tolist() if len(c) else [] for c in (words, ids))))

    return held(key, unpacked)


class ByteBpe:
    """Encodes and decodes with one rank map."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.words = b""  # an Arrow stream of (word, ids): the driver never unpacks it
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self._bytes = np.array([ranks[bytes([value])] for value in range(256)], np.int64)
        self._pairs = np.array([ranks.get(bytes([a, b]), _ID) for a in range(256) for b in range(256)], np.int64)
        shifts, slots = pair_table(ranks)
        self._tables = pa.table({"shifts": pa.array([shifts], pa.list_(pa.int32())), "slots": pa.array([slots], pa.list_(pa.int64()))})
        self._shared: Broadcast | None = None

    def with_tables(self, df: DataFrame) -> DataFrame:
        """Adds ``tables``, for one call of ``fold``. Only there can Spark put the subquery in place, without copying it into rows."""
        return df.withColumn("tables", df.sparkSession.createDataFrame(self._tables).select(F.struct("shifts", "slots")).scalar())

    def fold(self, words: Column) -> Column:
        """Cells (array<bigint>) of each of several words, given as arrays of the cells of their bytes.

        A cell holds the rank of the pair it begins (2^16 if that does not merge), its place in
        the array and its id, from the highest bits down; so the least cell is the leftmost
        pair of lowest rank. An edge without rank stands at both ends.
        """
        return let(F.col("tables"), lambda lits: F.transform(words, lambda word: self._fold(word, lits)))

    def _fold(self, word: Column, lits: Column) -> Column:
        none, ids, rest = _long(_ID << _RANK), _long(_MASK), _long((1 << _RANK) - 1)
        one, most, width = F.lit(1), _long(2**63 - 1), _long(1 << _BITS)

        def rank(key: Column) -> Column:
            """Rank of the pair in its place of a cell. Another pair's slot differs by more than any rank, or is below."""
            slot = F.get(lits["slots"], (key % _long(_AWAYS) + F.get(lits["shifts"], (key % _long(_HOMES)).cast("int"))).cast("int"))
            return F.shiftleft(F.least((slot - F.shiftleft(key, _BITS)).bitwiseAND(most), _long(_ID)), _RANK)

        def step(cells: Column, _: Column) -> Column:
            def merge(found: Column) -> Column:
                best, at, new = found["best"], found["at"], found["new"]
                before = F.get(cells, at - one)
                left = let(F.shiftleft(before.bitwiseAND(ids), _BITS) + new, rank) + before.bitwiseAND(rest)
                right = let(F.shiftleft(new, _BITS) + F.get(cells, at + F.lit(2)).bitwiseAND(ids), rank)
                merged = right + F.shiftleft(at.cast("bigint"), _BITS) + new
                tail = F.transform(F.slice(cells, at + F.lit(3), F.size(cells)), lambda cell: cell - width)
                return F.concat(F.slice(cells, one, at - one), F.array(left, merged), tail)

            return let(F.array_min(cells), lambda best: F.when(best >= none, cells).otherwise(let(F.struct(
                best.alias("best"), F.shiftright(best.bitwiseAND(rest), _BITS).cast("int").alias("at"),
                F.shiftright(best, _RANK).alias("new")), merge)))

        return F.aggregate(F.slice(word, one, F.greatest(F.size(word) - F.lit(3), F.lit(0))), word, step)

    def _parts_maker(self) -> Callable[[list[str]], pa.Array]:
        """A function from words to the cells of their bytes, free of this object."""
        ids, pairs = self._bytes, self._pairs

        def cells(words: list[str]) -> pa.Array:
            data = [w.encode() for w in words]
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            ends = np.cumsum(sizes)
            values = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
            ranks = np.full(len(values), _ID, np.int64)
            ranks[:-1] = pairs[values[:-1] * 256 + values[1:]]
            ranks[ends - 1] = _ID
            word = np.repeat(np.arange(len(data)), sizes)
            at = np.arange(len(values))
            out = np.full(len(values) + 2 * len(data), _EDGE, np.int64)
            out[at + 2 * word + 1] = (ranks << _RANK) + ((at - (ends - sizes)[word] + 1) << _BITS) + ids[values]
            offsets = np.concatenate([[0], ends + 2 * np.arange(1, len(data) + 1)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))

        return cells

    def with_words(self, texts: DataFrame, sample_rows: int, keep: int) -> ByteBpe:
        """Remember the ids of the ``keep`` most frequent words, of 64 characters at most, of a sample of about ``sample_rows`` texts."""
        ship_package(texts.sparkSession)
        pattern, parts_of = self.pattern, self._parts_maker()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            find, seen = regex.compile(pattern).findall, Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    seen.update(find(text or ""))
            rows = [(w, n) for w, n in seen.items() if len(w) <= LONGEST_KNOWN]
            for start in range(0, len(rows), 50_000):
                words, counts = zip(*rows[start:start + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

        sample = bounded_sample(texts.select("doc_id", "text"), "doc_id", sample_rows).select(F.col("text").cast("string"))
        top = sample.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
        top = top.orderBy(F.desc("n"), "word").limit(keep).select("word").repartition("word")
        parts = _arrow(top, lambda b: [b.column(0), parts_of(b.column(0).to_pylist())], "word string, parts array<bigint>")
        cells = self.with_tables(parts).select("word", self.fold(F.array("parts"))[0].alias("cells"))
        rows = _arrow(cells, lambda b: [b.column(0), _inner(b.column(1))], "word string, ids binary").toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        self.words = sink.getvalue().to_pybytes()
        self._shared = None
        return self

    def cut(self, documents: DataFrame) -> DataFrame:
        """(doc_id, ids, fresh): ids of known words, and -k for the k-th of the text's distinct words that are not."""
        if self._shared is None:
            self._shared = documents.sparkSession.sparkContext.broadcast(self.words)
            self._key = uuid.uuid4().hex
        shared, key, pattern, parts_of = self._shared, self._key, self.pattern, self._parts_maker()

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            find, known = regex.compile(pattern).findall, _memory(shared, key)
            ids, fresh, counts = [], [], []
            for text in batch.column(1).to_pylist():
                words = find(text or "")
                new = dict.fromkeys(w for w in words if w not in known)
                for k, w in enumerate(new, 1):
                    new[w] = (-k).to_bytes(4, "little", signed=True)
                ids.append(b"".join([known.get(w) or new[w] for w in words]))
                fresh.extend(new)
                counts.append(len(new))
            ends = np.fromiter(accumulate(counts, initial=0), np.int32, len(counts) + 1)
            return [batch.column(0), _lists(ids), pa.ListArray.from_arrays(pa.array(ends), parts_of(fresh))]

        kind = documents.schema["doc_id"].dataType.simpleString()
        return _arrow(documents.select("doc_id", F.col("text").cast("string")), each,
                      f"doc_id {kind}, ids array<int>, fresh array<array<bigint>>")

    def encoded(self, documents: DataFrame, each: Callable[[np.ndarray], tuple], columns: str) -> DataFrame:
        """(doc_id, columns) with ``each(ids)`` giving the columns of one text from all its ids."""
        cut = self.cut(documents)
        kind = documents.schema["doc_id"].dataType.simpleString()
        folded = self.with_tables(cut).select("doc_id", "ids", F.when(F.size("fresh") > 0, self.fold(F.col("fresh"))).alias("folded"))

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [each(ids) for ids in _filled(batch.column(1), batch.column(2))]
            return [batch.column(0), *(pa.array(list(c)) for c in zip(*rows))]

        return _arrow(folded, run, f"doc_id {kind}, {columns}")


def _filled(ids: pa.ListArray, folded: pa.ListArray) -> list[np.ndarray]:
    """``ids`` of each text with -k replaced by the ids of its k-th folded word, all texts at once."""
    flat, counts = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
    ends = np.cumsum(counts)
    words = folded.flatten()
    cells = (words.flatten().to_numpy() & _MASK).astype(np.int32)
    sizes = np.diff(words.offsets.to_numpy())
    begins = np.cumsum(sizes) - sizes + 1
    held = folded.value_lengths().fill_null(0).to_numpy()
    gaps = np.flatnonzero(flat < 0)
    text = np.searchsorted(ends, gaps, side="right")
    word = (np.cumsum(held) - held)[text] - flat[gaps] - 1
    wide = sizes[word] - 2
    lengths = np.ones(len(flat), np.int64)
    lengths[gaps] = wide
    out = np.repeat(flat, lengths)
    at = np.cumsum(wide) - wide
    out[out < 0] = cells[np.arange(wide.sum()) + np.repeat(begins[word] - at, wide)]
    bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], ends])]
    return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def encode_documents(documents: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(doc_id, ids, decoded): ids as array<int>, decoded as binary."""
    piece = bpe.pieces.__getitem__
    return bpe.encoded(documents, lambda ids: (ids, b"".join(map(piece, ids.tolist()))), "ids array<int>, decoded binary")


def report(documents: DataFrame, bpe: ByteBpe) -> DataFrame:
    """Token counts and digests of every row."""
    pieces, names = bpe.pieces, [str(i) for i in range(len(bpe.pieces))]

    def each(ids: np.ndarray) -> tuple[int, str, str]:
        numbers = ids.tolist()
        text, decoded = ",".join([names[i] for i in numbers]), b"".join([pieces[i] for i in numbers])
        return len(numbers), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return bpe.encoded(documents, each, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
