"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Features of a text are its words (lower-cased, hashed), a few statistics of its structure and
its stored length, each cut into bins that are hashed too. Every feature has a weight and a
short vector; all pairs of features interact through the product of their vectors, summed in
linear time as half of (square of the sum - sum of the squares). The model is trained on a
bounded sample of labelled rows in parallel shards whose parameters are averaged after each
round; labels, language, source and id are never inputs.

Defined cases: null and empty texts have only their bins as features and are scored; without
labels of both kinds every score is the share of label 1 (or one half); repeated rows get
equal scores; words are whole texts' words, at most a share of 1/n each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.llm.common import bounded_sample, held_out, only_ids, settle, text_of, words_of
from docreg.session import ship_package

BUCKETS = 1 << 15
RANK = 8
BINS = 16
STRUCTURE = 10


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, flat: np.ndarray, begins: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each text; its features are ``flat[begins[i]:begins[i + 1]]`` with their values."""
        raw = self.bias + np.add.reduceat(self.weights[flat] * values, begins[:-1])
        for k in range(RANK):
            part = self.vectors[flat, k] * values
            raw += 0.5 * (np.add.reduceat(part, begins[:-1]) ** 2 - np.add.reduceat(part * part, begins[:-1]))
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))


def features(text: Column, n_chars: Column) -> tuple[Column, Column]:
    """(hashed words, hashed bins of structure and length)."""
    words = F.transform(words_of(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    length = F.greatest(F.length(text), F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    shares = [count(p) / length for p in (r"[#*$%&|<>]", r"\|", r"[A-Z]", r"[0-9]", r"[!?]", r"[\x20\x09-\x0D]", r"\n")]
    binned = [F.least(F.floor(F.sqrt(s) * BINS), F.lit(BINS - 1)) for s in shares]
    binned += [F.least(F.floor(F.log2(length.cast("double"))), F.lit(BINS - 1)),
               F.least(F.floor(F.log2(F.greatest(F.coalesce(n_chars, F.lit(1)), F.lit(1)).cast("double"))), F.lit(BINS - 1)),
               F.least(F.floor(length / F.greatest(count(r"\n"), F.lit(1)) / 100), F.lit(BINS - 1))]
    return words, F.array(*[(F.lit(BUCKETS + i * BINS) + b).cast("int") for i, b in enumerate(binned)])


SIZE = BUCKETS + STRUCTURE * BINS


def featured(documents: DataFrame) -> DataFrame:
    """(doc_id, words, bins) of every row."""
    length = F.col("n_chars").cast("long") if "n_chars" in documents.columns else F.lit(None).cast("long")
    words, bins = features(text_of(), length)
    return documents.select("doc_id", words.alias("words"), bins.alias("bins"))


def _flat(words: pa.ListArray, bins: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of a batch side by side: indices, begins (one more than rows), values."""
    counts = np.diff(words.offsets.to_numpy())
    begins = np.concatenate([[0], np.cumsum(counts + STRUCTURE)])
    flat = np.empty(begins[-1], np.int64)
    values = np.empty(begins[-1])
    fixed = (begins[1:, None] - STRUCTURE + np.arange(STRUCTURE)).ravel()
    free = np.ones(begins[-1], bool)
    free[fixed] = False
    flat[fixed], values[fixed] = bins.flatten().to_numpy(), 1.0 / np.sqrt(STRUCTURE)
    flat[free], values[free] = words.flatten().to_numpy(), np.repeat(1.0 / np.maximum(counts, 1), counts)
    return flat, begins, values


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = 20_000, shards: int = 4, rounds: int = 6,
          rate: float = 0.2) -> Machine:
    """Fit on at most about ``sample_rows`` labelled rows that are not held out."""
    ship_package(documents.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("quality").cast("double").alias("y"))
    known = settle(bounded_sample(known, "doc_id", sample_rows))
    stats = known.agg(F.count("*").alias("n"), F.avg("y").alias("mean")).first()
    share = stats["mean"] if stats["n"] else 0.5
    rng = np.random.default_rng(5)
    machine = Machine(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK)))
    if not stats["n"] or not 0 < share < 1:
        return machine
    texts = only_ids(documents, "doc_id", known.select("doc_id"), sample_rows)
    # A shard is a partition of the settled sample: rounds move parameters, not rows.
    rows = settle(featured(texts).join(known, "doc_id").select("words", "bins", "y").repartition(shards))
    for number in range(rounds):
        fit = _fitting(machine, rate / (1 + number), number)
        parts = rows.mapInArrow(fit, "bias double, weights binary, vectors binary").collect()
        machine = Machine(float(np.mean([p["bias"] for p in parts])),
                          np.mean([np.frombuffer(p["weights"]) for p in parts], axis=0),
                          np.mean([np.frombuffer(p["vectors"]).reshape(SIZE, RANK) for p in parts], axis=0))
    return machine


def _fitting(machine: Machine, rate: float, seed: int):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            words, bins, y = (pa.concat_arrays([b.column(i) for b in parts]) for i in range(3))
            out = descend(machine, *_flat(words, bins), y.to_numpy(), rate, seed)
            yield pa.RecordBatch.from_pydict({
                "bias": [out.bias], "weights": [out.weights.tobytes()], "vectors": [out.vectors.tobytes()]})

    return fit


def descend(machine: Machine, flat: np.ndarray, begins: np.ndarray, values: np.ndarray, y: np.ndarray, rate: float,
            seed: int, batch: int = 64) -> Machine:
    """One pass of mini-batch gradient steps with per-parameter scaling."""
    bias, weights, vectors = machine.bias, machine.weights.copy(), machine.vectors.copy()
    seen_w, seen_v = np.full(len(weights), 1e-3), np.full(vectors.shape, 1e-3)
    order = np.random.default_rng(seed).permutation(len(y))
    for start in range(0, len(y), batch):
        rows = order[start:start + batch]
        take = np.concatenate([np.arange(begins[r], begins[r + 1]) for r in rows])
        own = np.repeat(np.arange(len(rows)), [begins[r + 1] - begins[r] for r in rows])
        edges = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(rows)))])
        index, x = flat[take], values[take]
        error = Machine(bias, weights, vectors).scores(index, edges, x) - y[rows]
        sums = np.add.reduceat(vectors[index] * x[:, None], edges[:-1])
        near, place = np.unique(index, return_inverse=True)
        step = error[own] * x
        grad_w = np.bincount(place, step, len(near))
        grad_v = np.zeros((len(near), RANK))
        np.add.at(grad_v, place, step[:, None] * (sums[own] - vectors[index] * x[:, None]))
        seen_w[near] += grad_w ** 2
        seen_v[near] += grad_v ** 2
        weights[near] -= rate * grad_w / np.sqrt(seen_w[near])
        vectors[near] -= rate * grad_v / np.sqrt(seen_v[near])
        bias -= rate * 0.1 * float(error.mean())
    return Machine(bias, weights, vectors)


def score(documents: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the model has a fixed size and is broadcast."""
    ship_package(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                flat, begins, values = _flat(pa.concat_arrays([part.column(1)]), pa.concat_arrays([part.column(2)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.scores(flat, begins, values))], ["doc_id", "score"])

    scored = featured(documents).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
