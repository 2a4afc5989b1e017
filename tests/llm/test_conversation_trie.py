"""Conversation trie against a dictionary of prefixes, plus the search and the defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from docreg.llm import conversation_trie as T


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(),
                              role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, ts in full.items():
        ends[ts].append(c)
        for d in range(len(ts) + 1):
            members[ts[:d]].add(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    saved, leaves = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0
        leaves[p] += not children[p]
        if p:
            saved[p[:-1]] += saved[p]
            leaves[p[:-1]] += leaves[p]
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as d", "'x' as words", "2 as size")


def sample(seed, convs, longest):
    rng = random.Random(seed)
    for c in rng.sample(range(400), convs):
        for t in range(rng.choice([1, 2, 3, 5, longest])):
            yield c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b b", ""]) if rng.random() < .9 else f"own {c} words"


def test_every_prefix(spark):
    rows = list(sample(3, 120, 24))
    df = frame(spark, rows).repartition(4)
    want = brute(rows)
    assert got(T.trie(df)) == want
    assert got(T.trie(df, shares=(0.1, 0.3, 0.6, 1.0))) == want


def test_long_chains_of_prefixes(spark):
    rows = [(c, t, "u", f"turn {t}" if t < 30 + c % 3 else f"other {c % 5}") for c in range(0, 90, 3) for t in range(c)]
    rows += [(c, 0, "u", "turn 0") for c in (1, 2, 4)]
    assert got(T.trie(frame(spark, rows), shares=(0.3, 0.7, 1.0))) == brute(rows)


def test_defined_cases(spark):
    rows = [(20, None, None, None), (20, 1, "u", "x"), (20, 1, "u", "x"), (None, 1, "u", "lost"), (21, 5, "u", "x y"), (41, 1, "a", "gone"), (42, 1, "a", "gone"),
            (43, 1, "u", "w " * 50_000)]
    df = frame(spark, rows)
    assert got(T.trie(df)) == brute(rows)
    assert T.trie(df.where("false")).count() == 0


def test_two_fattest(spark):
    pairs = [(low, high) for high in range(1, 70) for low in range(high)]
    rows = spark.createDataFrame(pairs, "low bigint, high bigint").withColumn("f", T.two_fattest(F.col("low"), F.col("high"))).collect()
    for r in rows:
        assert r.f == max(range(r.low + 1, r.high + 1), key=lambda x: x & -x)
