"""Periodic runs against a search of every period, plus the defined cases."""

import hashlib
import random
import zlib
from fractions import Fraction

from docreg.llm import periodic as P


def brute_runs(words):
    found = {}
    n = len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(24, 3 * p):
                found.setdefault((s, i + p), p)  # periods ascend: the first one is the smallest
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_words(text, doc_id):
    words = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_row(text, doc_id):
    words = brute_words(text, doc_id)
    runs = brute_runs(words)
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def samples(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(0, 4)):
            cycle = [rng.choice("abcdef") + str(rng.randint(0, 3)) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 9, 16, 17, 30, 33, 64]))]
            parts += (cycle * 12)[:rng.randint(1, 5 * len(cycle) + 30)]
            parts += [rng.choice("xyz") for _ in range(rng.randint(0, 12))]
        yield " ".join(parts)


def test_fragments_of_tiles_stitch_to_every_run(spark):
    texts = [*samples(400, 5), " ".join("ab" * 300), " ".join("a" * 2000), " ".join(["q"] * 23), " ".join(["q"] * 24)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in P.report(df).collect()}
    want = {i: brute_row(t, i) for i, t in enumerate(texts)}
    assert got == want
    assert sum(w[0] for w in want.values()) > 200


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (None, "a " * 40), (3, "b c " * 20), (3, "b c " * 20), (3, "other"), (10, "\x0b\t \n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as words", "'x' as row", "2 as runs")
    got = sorted([tuple(r) for r in P.report(df).collect()], key=str)
    assert got == sorted([(i, *brute_row(t, i)) for i, t in rows], key=str)
    assert P.report(df.where("false")).count() == 0


def test_a_very_long_text_of_one_word_is_linear_work(spark):
    n = 300_000
    df = spark.createDataFrame([(1, "w " * n), (2, "long" * 400_000)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in P.report(df).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period) == (1, 0, n, 1)
    assert got[1].collapsed_sha256 == hashlib.sha256(b"w").hexdigest()
    assert got[2].n_runs == 0


def test_collapse_keeps_every_row(spark):
    rows = [(1, "u v " * 20 + "end"), (2, "plain  text"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in P.collapse(df).collect()} == {1: "u v end", 2: "plain text", 3: ""}


def test_z_function_and_divisors():
    assert P.z_function(list("aabaab")) == [6, 1, 0, 3, 1, 0]
    assert list(P.solve_tile(list("abababababababababababababab"), 0, 8, 28, 8, [2, 4, 6, 8])) == [(2, 0, 28)]
