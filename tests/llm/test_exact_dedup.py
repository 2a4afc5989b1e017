"""Extendible-hash dedup against grouping in plain Python, plus the index itself."""

import hashlib
import random
from collections import defaultdict

from docreg.llm import exact_dedup as E

GAPS = " \t\n\x0b\x0c\r"


def plain(text):
    return (text or "").translate({ord(c): None for c in GAPS})


def brute(rows):
    sets = defaultdict(list)
    for doc_id, text in rows:
        sets[plain(text)].append((-len(text or ""), doc_id is None, doc_id if doc_id is not None else 0))
    out = []
    for doc_id, text in rows:
        less, nameless, best = min(sets[plain(text)])
        keep = None if nameless else best
        out.append((doc_id, keep, len(sets[plain(text)]), doc_id == keep and len(text or "") == -less,
                    hashlib.sha256(plain(text).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=str)


def sample(seed, count=300):
    rng = random.Random(seed)
    texts = ["", " ", None, " ", "a b", "ab", "a\tb\n", "Ab", "hot text " * 40]
    for i in range(count):
        yield i, rng.choice(texts) if rng.random() < .6 else "".join(rng.choice("xyz \n") for _ in range(rng.randint(0, 60)))


def test_every_row_and_group(spark):
    rows = [*sample(1), (None, "only nameless"), (None, "a b"), (7, "a  b"), (7, "a  b"), (500, "né"), (501, "n é")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'x' as key", "1 as bucket", "2 as digest").repartition(5)
    assert got(E.report(df, capacity=300)) == brute(rows)
    assert E.report(df.where("false")).count() == 0


def test_texts_of_one_key_are_chained_by_their_bytes(spark):
    rows = list(sample(2, 120))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(E.report(df, capacity=50, key=lambda text: -5)) == brute(rows)
    assert got(E.report(df, capacity=50, key=lambda text: len(text) - 20)) == brute(rows)


def test_long_text(spark):
    rows = [(1, "z" * 3_000_000), (2, "z " * 3_000_000), (3, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(E.report(df)) == brute(rows)


def directory_of(index):
    return {r.bucket: r.folder for r in index.directory.collect()}


def test_buckets_split_until_they_fit_and_cover_all_keys(spark, tmp_path):
    rows = [(i, f"text number {i * 7919}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = E.insert(None, df, f"file://{tmp_path}/a", capacity=500)
    sizes = defaultdict(int)
    for r in index.links().collect():
        sizes[r.bucket] += r.size
        assert format(r.key % (1 << 64), "064b").startswith(r.bucket)
    names = sorted(directory_of(index))
    assert max(sizes.values()) <= 500 and sum(2.0 ** -len(n) for n in names) == 1.0
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_inserting_twice_equals_inserting_once(spark, tmp_path):
    first, second = [(i, f"first {i % 60} of many") for i in range(90)], [(i, f"first {i} of many") for i in range(50, 75)]
    one = spark.createDataFrame(first, "doc_id bigint, text string")
    two = spark.createDataFrame(second, "doc_id bigint, text string")
    index = E.insert(None, one, f"file://{tmp_path}/a", capacity=100)
    before = directory_of(index)
    grown = E.insert(index, two, f"file://{tmp_path}/b", capacity=100)
    texts = sorted(r.text.decode() for r in grown.links().collect())
    assert texts == sorted({plain(t) for _, t in first + second})
    assert any(grown_folder == before.get(b) for b, grown_folder in directory_of(grown).items())  # untouched files stay


def test_keep_first(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "c"), (None, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in E.keep_first(df).collect() if r.doc_id) == [2, 3]
