"""Token ids in wavelet-matrix files, one per shard.

Documents are range-partitioned by doc_id and encoded; each shard file holds the ids of its
documents in ascending doc_id order as a wavelet matrix: one bit-plane per bit of an id, most
significant first, each plane stably sorted by the bit above it. Ranks on the planes give
access to single tokens, counts of a token and its occurrences without unpacking the rest.

File layout, little-endian: magic ``WVM1``; uint32 length of the header; header as JSON
(bits, tokens, documents, sizes of the compressed blocks); zstd blocks of doc ids, document
ends and each bit-plane. Blocks are independent, so a reader touches only what it needs.

Defined cases: a null or empty text is a document of the end id alone; a null doc_id sorts
first and is stored as the smallest long; repeated rows are stored once each; an empty table
writes no file. A retried task writes the same bytes again under the same name.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docreg.llm.common import bounded_sample, held, settle, shared_folder
from docreg.session import ship_package

MAGIC = b"WVM1"
NO_ID = -(1 << 63)
END = 2
LONGEST_KNOWN = 64
PIECE = 1 << 21
WORDS = 64


class WaveletMatrix:
    """Access, count and lookup over bit-planes (most significant first)."""

    def __init__(self, planes: list[np.ndarray]):
        self.planes = planes
        self.size = len(planes[0]) if planes else 0
        self.zeros = [self.size - int(np.count_nonzero(p)) for p in planes]

    @cached_property
    def ones(self) -> list[np.ndarray]:
        """Ranks of the one bits, built when first asked for."""
        return [np.concatenate([[0], np.cumsum(p, dtype=np.int64)]) for p in self.planes]

    def rank(self, level: int, bit: int, i: int) -> int:
        """Bits equal to ``bit`` among the first ``i`` of a plane."""
        ones = int(self.ones[level][i])
        return ones if bit else i - ones

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit equal to ``bit``."""
        counts = self.ones[level] if bit else np.arange(self.size + 1) - self.ones[level]
        return int(np.searchsorted(counts, k + 1, side="left")) - 1

    def access(self, i: int) -> int:
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i])
            value = value << 1 | bit
            i = self.zeros[level] + self.rank(level, 1, i) if bit else self.rank(level, 0, i)
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Stretch of the last order that holds ``token`` among the first ``end`` ids."""
        a, b = 0, end
        for level in range(len(self.planes)):
            bit = token >> (len(self.planes) - 1 - level) & 1
            a, b = (self.rank(level, bit, x) + (self.zeros[level] if bit else 0) for x in (a, b))
        return a, b

    def count(self, token: int, end: int | None = None) -> int:
        a, b = self._range(token, self.size if end is None else end)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) ``token``; -1 if there are fewer."""
        a, b = self._range(token, self.size)
        if k >= b - a:
            return -1
        i = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            i = self.select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids, undoing the stable sorts from the last plane up."""
        out = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            plane, zeros = self.planes[level].view(bool), self.zeros[level]
            out[zeros:] |= out.dtype.type(1 << (len(self.planes) - 1 - level))
            above = np.empty_like(out)
            above[np.flatnonzero(~plane)] = out[:zeros]
            above[np.flatnonzero(plane)] = out[zeros:]
            out = above
        return out.astype(np.uint32)


def planes_of(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bit-planes of a wavelet matrix as 0/1 arrays."""
    current = ids
    for shift in range(bits - 1, -1, -1):
        ones = (current & current.dtype.type(1 << shift)) != 0
        yield ones
        if shift:
            # Arrow filters by a bitmap faster than NumPy by a mask.
            mask = pa.BooleanArray.from_buffers(pa.bool_(), len(ones), [None, pa.py_buffer(np.packbits(ones, bitorder="little"))])
            cells = pa.array(current)
            current = np.concatenate([cells.filter(pc.invert(mask)).to_numpy(), cells.filter(mask).to_numpy()])


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    press = zstandard.ZstdCompressor(level=1).compress
    names = np.array([NO_ID if d is None else d for d in doc_ids], np.int64)
    narrow = ids.astype(np.uint16) if bits <= 16 else ids
    blocks = [press(names.tobytes()), press(np.cumsum(lengths, dtype=np.int64).tobytes()),
              *(press(np.packbits(p).tobytes()) for p in planes_of(narrow, bits))]
    head = json.dumps({"bits": bits, "tokens": len(ids), "documents": len(names), "blocks": [len(b) for b in blocks]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *blocks])


class ShardFile:
    """One file image; blocks are unpacked when asked for."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        size = struct.unpack_from("<I", image, 4)[0]
        self.head = json.loads(image[8:8 + size])
        edges = np.cumsum([8 + size, *self.head["blocks"]])
        self._block = lambda i: zstandard.ZstdDecompressor().decompress(image[edges[i]:edges[i + 1]])

    def doc_ids(self) -> list[int | None]:
        return [None if d == NO_ID else int(d) for d in np.frombuffer(self._block(0), np.int64)]

    def ends(self) -> np.ndarray:
        return np.frombuffer(self._block(1), np.int64)

    def matrix(self) -> WaveletMatrix:
        n = self.head["tokens"]
        return WaveletMatrix([np.unpackbits(np.frombuffer(self._block(2 + i), np.uint8), count=n) for i in range(self.head["bits"])])


@cache
def _tokenizers(path: str):
    """The tokenizer of a file and the same without its normalizer; both set the words of a list apart by LF."""
    # Worker processes share the cores already; threads of the library only add to their work.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    whole, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    plain.normalizer = None
    for tokenizer in (whole, plain):
        tokenizer.add_special_tokens(["\n"])
    return whole, plain


# Such a word is in normal form (NFC) and holds no white space, so a normalizer can only lower it.
_PLAIN = re.compile(r"[!-~\xA1-\xFF]+").fullmatch


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words of each text, number of each word, distinct words by number), cut at ASCII white space."""
    cut = pc.ascii_split_whitespace(texts.fill_null(""))
    named = cut.flatten().cast(pa.binary()).dictionary_encode()
    words = named.dictionary.to_numpy(zero_copy_only=False).tolist()
    return cut.value_lengths().to_numpy().astype(np.int64), named.indices.to_numpy(), words


def pieces_of(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of about PIECE bytes of text or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:]):
        yield batch.slice(start, stop - start)


class WordEncoder:
    """Encodes texts word by word.

    For tokenizers that normalize by NFC, white space and lower case, drop white space and never
    join what it separates, a text's ids are the ids of its words in order. ``known`` are words
    encoded beforehand; further words are remembered until ``room`` of them are held, then those
    are forgotten.
    """

    def __init__(self, path: str, known: dict[bytes, bytes] | None = None, room: int = 200_000):
        self.whole, self.plain = _tokenizers(path)
        self.gap = self.whole.token_to_id("\n")
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values() if t.content != "\n"]
        self.added = re.compile("|".join(added) or r"(?!)", re.IGNORECASE).search
        self.room = room
        self.known = dict(known or {})
        self.further: list[bytes] = []

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word; plain words that only differ in case are encoded once."""
        names = [w.decode() for w in words]
        # Added tokens are looked for before case is folded, so words that hold one in any case keep theirs.
        special = {n for n in names if self.added(n)} if self.added("\n".join(names)) else ()
        folded = [n.lower() if _PLAIN(n) and n not in special else "" for n in names]
        plain = self._lists(self.plain, list(dict.fromkeys(filter(None, folded))))
        other = self._lists(self.whole, [n for n, low in zip(names, folded) if not low])
        return [plain[low] if low else other[n] for n, low in zip(names, folded)]

    def _lists(self, tokenizer, names: list[str]) -> dict[str, bytes]:
        """Ids of each word, encoded WORDS at a time."""
        found: list[bytes] = []
        lists = ["\n".join(names[start:start + WORDS]) for start in range(0, len(names), WORDS)]
        # Few at a time, so that what the library returns stays in the cache.
        groups = (tokenizer.encode_batch_fast(lists[start:start + 16], add_special_tokens=False) for start in range(0, len(lists), 16))
        for encoded in chain.from_iterable(groups):
            ids = np.array(encoded.ids, "<u4")
            raw, begin = ids.tobytes(), 0
            for stop in [*np.flatnonzero(ids == self.gap).tolist(), len(ids)]:
                found.append(raw[4 * begin:4 * stop])
                begin = stop + 1
        return dict(zip(names, found, strict=True))

    def encode(self, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
        """Ids of each text and ``end``; the unknown words of all of them are encoded in one go."""
        counts, numbers, words = split_words(texts)
        found = [*map(self.known.get, words)]
        gaps = [i for i, ids in enumerate(found) if ids is None]
        new = [words[i] for i in gaps]
        if len(self.further) + len(new) > self.room:
            for word in self.further:
                del self.known[word]
            self.further = []
        for i, ids in zip(gaps, self.ids_of(new)):
            found[i] = self.known[words[i]] = ids
        self.further += new
        cells = pa.array([*found, struct.pack("<I", end)], pa.large_binary())
        # The end stands behind each text's words like one more word.
        order = cells.take(pa.array(np.insert(numbers, np.cumsum(counts), len(words))))
        offsets = np.frombuffer(order.buffers()[1], np.int64, len(order) + 1)
        ids = np.frombuffer(order.buffers()[2] or b"", "<u4")
        stops = (offsets[np.cumsum(counts + 1)] // 4).tolist()
        for a, b in zip([0, *stops], stops):
            yield ids[a:b]


def _encoder(path: str, shared: Broadcast, key: str) -> WordEncoder:
    """One encoder per worker process and job (``key``), kept from task to task."""
    return held(key, lambda: WordEncoder(path, shared.value))


def frequent_words(documents: DataFrame, tokenizer: str, sample_rows: int, keep: int) -> dict[bytes, bytes]:
    """Ids of the ``keep`` most frequent words, of 64 bytes at most, of a sample of about ``sample_rows`` texts."""
    ship_package(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for piece in pieces_of(batch, 0):
                _, numbers, found = split_words(piece.column(0))
                seen.update(dict(zip(found, np.bincount(numbers, minlength=len(found)).tolist())))
        rows = [(w, n) for w, n in seen.items() if len(w) <= LONGEST_KNOWN]
        for start in range(0, len(rows), 50_000):
            words, counts = zip(*rows[start:start + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            ids = encoder.ids_of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["word", "ids"])

    sample = bounded_sample(documents.select("doc_id", "text"), "doc_id", sample_rows).select(F.col("text").cast("string"))
    top = sample.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    top = top.orderBy(F.desc("n"), "word").limit(keep).select("word").repartition("word")
    rows = top.mapInArrow(learn, "word binary, ids binary").toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("ids").to_pylist()))


def write_shards(documents: DataFrame, folder: str, tokenizer: str, max_tokens: int = 4_000_000,
                 sample_rows: int = 20_000, keep: int = 300_000) -> DataFrame:
    """Encode ``documents`` into files under ``folder``; returns the (settled) list (file, tokens, documents).

    A shard is a range of doc_id; one of more than ``max_tokens`` ids goes on in further
    files, so a task never holds more. File names sort in doc_id order. Frequent words of a
    bounded sample are encoded once and broadcast; they save work and never change an id.
    """
    ship_package(documents.sparkSession)
    ordered = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "file string, tokens bigint, documents bigint"
    words = documents.sparkSession.sparkContext.broadcast(frequent_words(ordered, tokenizer, sample_rows, keep))
    # Rows that repeat a doc_id are ordered by their texts, so that a retried task writes the same file.
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    job = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        encoder, part = _encoder(tokenizer, words, job), TaskContext.get().partitionId()
        number = 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, names, held, number
            flat = np.concatenate(ids)
            image = pack(names, [len(i) for i in ids], flat)
            name = f"shard-{part:06d}-{number:06d}.wm"
            draft = f"{place}/.{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(draft) as out:
                out.write(image)
            files.move(draft, f"{place}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "tokens": [len(flat)], "documents": [len(names)]})
            ids, names, held, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for piece in pieces_of(batch, 1):
                for doc_id, found in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1), END)):
                    if held and held + len(found) > max_tokens:
                        yield flush()
                    ids.append(found)
                    names.append(doc_id)
                    held += len(found)
        if names:
            yield flush()

    return settle(ordered.mapInArrow(write, schema))


def read_shards(documents: DataFrame, folder: str, written: DataFrame,
                each: Callable[[ShardFile], dict[str, list]], schema: str) -> DataFrame:
    """One call of ``each`` per listed file; adds ``first``, the ids of all files before it.

    The list (one row per file) is summed by a window; file contents are read by Spark.
    """
    spark = documents.sparkSession
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(written.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first")))
    images = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wm").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    names = ["first", *[part.strip().split(" ")[0] for part in schema.split(",")]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = each(ShardFile(batch.column(1)[i].as_py()))
                rows = len(next(iter(columns.values())))
                yield pa.RecordBatch.from_pydict({"first": pa.array([batch.column(0)[i].as_py()] * rows, pa.int64()), **columns}).select(names)

    listed = images.join(F.broadcast(starts) if starts.count() <= 100_000 else starts, "file").select("first", "content")
    return listed.mapInArrow(read, f"first bigint, {schema}")


def _digests(shard: ShardFile) -> dict[str, list]:
    ends, ids = shard.ends(), shard.matrix().tokens().astype("<u4")
    begins = np.concatenate([[0], ends[:-1]])
    return {"doc_id": pa.array(shard.doc_ids(), pa.int64()), "begin": pa.array(begins, pa.int64()), "n_tokens": pa.array(ends - begins, pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)], pa.int64())}


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Write shard files and report every document from what they hold."""
    folder = f"{shared_folder(documents.sparkSession)}/wavelet-{uuid.uuid4().hex}"
    written = write_shards(documents, folder, tokenizer)
    if written.isEmpty():
        return documents.sparkSession.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    rows = read_shards(documents, folder, written, _digests, "doc_id bigint, begin bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
