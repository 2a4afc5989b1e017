"""N-gram Jaccard join with a token-group matrix.

Two texts link when their sets of five-word shingles have a Jaccard similarity of at least
80 %. The join is exact and reports components of linked documents:

1. Texts with the same shingle set become one class, named by its smallest doc_id.
2. Similar classes are partitioned into groups: classes that share a minimum hash are
   compared with the most ordinary one of their bucket, and verified links are closed to groups.
3. Any link between different groups must share a token of both prefixes (the rarest fifth
   of a set). Prefix tokens, reduced to (token, group), give candidate pairs of groups.
4. The token-group matrix holds, per candidate group and size, the union of its members'
   tokens as a bitmap of four to eight bits a token. A bit of a document that the row of the
   other group lacks is a token of its own; it needs 80 % of its tokens in that row. Only
   groups that such documents reach are opened, and their documents are compared exactly.
   Bitmaps are made with the signatures, so no text moves for the bound.

The order of rarity comes from counts in every fifth document, at every size of the table;
at most ``common_rows`` counts are broadcast. It steers the amount of work only: the prefix
argument holds for any order that all documents share.

Defined cases: a null text or one without words has an empty set, links with nothing and is
its own component; fewer than five words make one shingle; rows that repeat a doc_id are one
node, reported per row; a null doc_id is reported with a null component and links with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.llm.common import BROADCAST_ROWS, forget, only_ids, settle
from docreg.llm.components import components
from docreg.session import ship_package

SHINGLE = 5
PERCENT = 80
HASHES = 3
BITS = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_TURNS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text.

    ASCII letters are lower-cased and words are cut at ASCII white space, both of which
    the methods of ``bytes`` do by definition.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = total * _ODD + hashed[i:len(words) - width + 1 + i]
    return np.unique(_mixed(total))


def least_overlap(size: int) -> int:
    """Tokens a set of this size must share with any set it links with."""
    return -(-PERCENT * size // 100)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _arrow(df: DataFrame, each, schema: str) -> DataFrame:
    """``mapInArrow`` with ``each(batch) -> dict of columns``."""
    ship_package(df.sparkSession)
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                out = each(batch.slice(start, 1000))
                yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    return df.mapInArrow(run, schema)


def _lists(parts: list[np.ndarray], dtype) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(dtype)))


def presence(tokens: np.ndarray) -> np.ndarray:
    """Bitmap of a set as 64-bit words: bit ``token mod size``, the size a power of two of four to eight bits a token."""
    if not len(tokens):
        return np.empty(0, np.int64)
    size = 1 << max(6, (len(tokens) - 1).bit_length() + BITS)
    row = np.zeros(size, np.uint8)
    row[tokens & np.uint64(size - 1)] = 1
    return np.packbits(row, bitorder="little").view(np.int64)


def common_tokens(documents: DataFrame, share: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts), sorted by token: those in several of every ``share``-th document, the ``keep`` most frequent at most."""
    sample = documents.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(share)) == 0)
    tokens = _arrow(sample.select("text"), lambda b: {
        "tokens": _lists([_signed(shingle_set(t)) for t in b.column(0).to_pylist()], np.int64)}, "tokens array<bigint>")
    counts = tokens.select(F.explode("tokens").alias("token")).groupBy("token").count().where("count >= 3")
    rows = counts.orderBy(F.desc("count"), "token").limit(keep).toArrow()
    tokens = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("count").to_numpy().astype(np.int32)[order]


def signatures(documents: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(doc_id, n, often, fingerprint, minima, prefix, bits) of every row; ``often`` counts common tokens.

    The prefix takes tokens that are not common first, then common ones from the rarest on.
    """
    def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        sizes, commons, prints, minima, prefixes, bits = [], [], [], [], [], []
        for text in batch.column(1).to_pylist():
            tokens = shingle_set(text)
            sizes.append(len(tokens))
            bits.append(presence(tokens))
            prints.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
            minima.append(_signed(np.array([(tokens * t ^ (tokens * t >> np.uint64(32))).min() for t in _TURNS[:HASHES]], np.uint64))
                          if len(tokens) else np.empty(0, np.int64))
            seen = np.zeros(len(tokens), np.int32)
            if len(common) and len(tokens):
                at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                seen = np.where(common[at] == tokens, counts[at], 0)
            commons.append(int(np.count_nonzero(seen)))
            ordered = tokens[np.argsort(seen, kind="stable")]
            prefixes.append(_signed(ordered[:len(tokens) - least_overlap(len(tokens)) + 1] if len(tokens) else ordered))
        return {"doc_id": batch.column(0), "n": pa.array(sizes, pa.int64()), "often": pa.array(commons, pa.int64()), "fingerprint": pa.array(prints, pa.binary()),
                "minima": _lists(minima, np.int64), "prefix": _lists(prefixes, np.int64), "bits": _lists(bits, np.int64)}

    return _arrow(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), each,
                  "doc_id bigint, n bigint, often bigint, fingerprint binary, minima array<bigint>, prefix array<bigint>, bits array<bigint>")


def _texts(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the listed documents (column ``id``)."""
    ids = settle(ids.select(F.col("id").alias("doc_id")).distinct())
    found = only_ids(documents.select("doc_id", "text"), "doc_id", ids, ids.count())
    return found.select(F.col("doc_id").alias("id"), "text")


def verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts link."""
    pairs = settle(pairs.select("a", "b").distinct())
    texts = _texts(documents, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
        sets: dict[str, np.ndarray] = {}
        good = []
        for x, y in zip(ta, tb):
            for t in (x, y):
                if t not in sets:
                    sets[t] = shingle_set(t)
            good.append(linked(sets[x], sets[y]))
        keep = [i for i, g in enumerate(good) if g]
        return {"a": pa.array([a[i] for i in keep], pa.int64()), "b": pa.array([b[i] for i in keep], pa.int64())}

    return settle(_arrow(both.select("a", "b", "ta", "tb"), each, "a bigint, b bigint").distinct())


def _star_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of every class with the most ordinary class of its bucket: the one with the most common tokens.

    Of many copies of one text the least edited one is nearest to all others. Pairs whose sizes
    rule a link out are left out before any text moves. Centres are settled first, so that the
    join with a large bucket is one that Spark splits.
    """
    members = classes.select("id", "n", "often", F.posexplode("minima").alias("turn", "value"))
    rank = F.struct((F.col("often") / F.col("n")).alias("share"), (-F.col("id")).alias("order"), F.col("id").alias("id"), "n")
    tops = settle(members.groupBy("turn", "value").agg(F.max(rank).alias("top"), F.count("*").alias("size")).where("size > 1").select(
        "turn", "value", F.col("top.id").alias("top"), F.col("top.n").alias("m")))
    fits = 100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")
    return members.select("id", "n", "turn", "value").join(tops, ["turn", "value"]).where((F.col("id") != F.col("top")) & fits).select(
        F.col("id").alias("a"), F.col("top").alias("b"))


def _candidate_groups(classes: DataFrame) -> DataFrame:
    """Pairs of groups (g, h), g < h, that share a prefix token between sets of like size.

    The smaller set of a link shares 8/9 of its tokens, so the token may be sought in the
    first ninth of its order only (its core). Near copies of one text that do not link with
    each other have rare tokens there, and meet no partner through those they all share.
    """
    both = 100 + PERCENT
    core = F.col("pos") < F.col("n") - F.ceil(F.lit(2 * PERCENT) * F.col("n") / both - 1e-9) + 1
    tokens = classes.select("group", "n", F.posexplode("prefix").alias("pos", "token")).select("group", "n", "token", core.alias("core"))
    met = settle(tokens.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("rows"),
                                             F.bool_or("core").alias("core")).where("lo < hi and core"))
    two = met.where("rows = 2").select(F.col("lo").alias("g"), F.col("hi").alias("h"))
    often = met.where("rows > 2").select("token")
    more = settle(only_ids(tokens, "token", often, often.count()).groupBy("token", "group", _shelf().alias("bin")).agg(
        F.min(F.when(F.col("core"), F.col("n"))).alias("least"), F.max("n").alias("most")))
    left = more.where("least is not null").select(
        "token", F.col("group").alias("x"), "least", F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = left.join(more.select("token", "bin", "group", F.col("most").alias("reach")), ["token", "bin"]).where(
        "x != group and least <= reach").select(F.least("x", "group").alias("g"), F.greatest("x", "group").alias("h"))
    return settle(two.union(near).distinct())


def _shelf() -> Column:
    """Size on a log scale; sizes of linked sets differ by a quarter at most, so they lie on the same or neighbouring shelves."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 + (100 - PERCENT) / PERCENT)) + 1e-9).cast("int")


def _matrix(members: DataFrame, moved: DataFrame) -> DataFrame:
    """(group, shelf, row, least): the union of the bitmaps of a group's members of like size, and the least size.

    A group of one class is its own row. Of others, words of the bitmaps are united one by
    one, partly before they move, so that a large group is no large task.
    """
    wide = settle(moved.select(F.col("component").alias("group")).distinct())
    count = wide.count()
    single = members.join(F.broadcast(wide) if count <= BROADCAST_ROWS else wide, "group", "left_anti")
    words = only_ids(members, "group", wide, count).select(
        "group", "shelf", "n", F.size("bits").alias("width"), F.posexplode("bits").alias("at", "word"))
    united = words.groupBy("group", "shelf", "width", "at").agg(F.bit_or("word").alias("word"), F.min("n").alias("least"))
    rows = united.groupBy("group", "shelf", "width").agg(
        F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"), F.min("least").alias("least"))
    return single.select("group", "shelf", F.col("bits").alias("row"), F.col("n").alias("least")).union(
        rows.select("group", "shelf", F.col("words.word").alias("row"), "least"))


def _lacking(bits: Column, row: Column) -> Column:
    """Bits set in ``bits`` alone. The wider of two bitmaps (twice as wide at most) is folded to the width of the other."""
    def folded(wide: Column, other: Column) -> Column:
        width = F.size(other)
        return F.when(F.size(wide) > width, F.zip_with(
            F.slice(wide, F.lit(1), width), F.slice(wide, width + 1, width), lambda x, y: x.bitwiseOR(y))).otherwise(wide)

    alone = F.zip_with(folded(bits, row), folded(row, bits), lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(alone, F.lit(0), lambda total, count: total + count)


def _reaching(classes: DataFrame, moved: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g, h, side, id, n): documents of a candidate pair with enough tokens in the other group's rows."""
    wanted = settle(pairs.select(F.col("g").alias("group")).union(pairs.select("h")).distinct())
    members = settle(only_ids(classes.select("group", "id", "n", "bits", _shelf().alias("shelf")), "group", wanted, wanted.count()))
    matrix = settle(_matrix(members, moved))
    sizes = members.groupBy("group").count()
    sized = pairs.join(sizes.select(F.col("group").alias("g"), F.col("count").alias("gs")), "g").join(
        sizes.select(F.col("group").alias("h"), F.col("count").alias("hs")), "h")
    first = F.when(F.col("gs") <= F.col("hs"), 0).otherwise(1)
    sides = settle(sized.select("g", "h", first.alias("side")))

    def asked(sides: DataFrame, members: DataFrame, matrix: DataFrame) -> DataFrame:
        """Documents of the given side of each pair that share enough tokens with a row of the other side."""
        own = F.when(F.col("side") == 0, F.col("g")).otherwise(F.col("h"))
        other = F.when(F.col("side") == 0, F.col("h")).otherwise(F.col("g"))
        met = sides.select("g", "h", "side", own.alias("own"), other.alias("other")).join(
            matrix.select(F.col("group").alias("other"), F.col("shelf").alias("there"), "row", "least"), "other").join(
            members.withColumnRenamed("group", "own"), "own").where(F.abs(F.col("shelf") - F.col("there")) <= 1)
        shared = F.col("n") - _lacking(F.col("bits"), F.col("row"))
        # 80 % of the own tokens, and 4/9 of both sizes, the other at its least.
        needed = F.greatest(F.lit(PERCENT * (100 + PERCENT)) * F.col("n"), F.lit(100 * PERCENT) * (F.col("n") + F.col("least")))
        return settle(met.where(F.lit(100 * (100 + PERCENT)) * shared >= needed).select("g", "h", "side", "id", "n").distinct())

    # The smaller group asks first; the larger one only where that left a document.
    small = asked(sides, members, matrix)
    alive = settle(small.select("g", "h", (1 - F.col("side")).cast("int").alias("side")).distinct())
    left = settle(alive.select(F.col("g").alias("group")).union(alive.select("h")).distinct())
    count = left.count()
    return settle(small.union(asked(alive, only_ids(members, "group", left, count), only_ids(matrix, "group", left, count))))


def _opened(documents: DataFrame, reaching: DataFrame) -> DataFrame:
    """Links between the groups of each opened pair.

    A group is connected within itself, so one link joins two groups. First every reaching
    document meets the other side's first one; only pairs of groups still apart are
    compared document by document.
    """
    def against(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.select("g", "h", F.col("side").alias("s2"), F.col("id").alias("b"), F.col("n").alias("m"))
        fits = (100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")) & (F.col("side") != F.col("s2"))
        return left.join(r, ["g", "h"]).where(fits).select("g", "h", F.col("id").alias("a"), "b")

    firsts = reaching.groupBy("g", "h", "side").agg(F.min(F.struct("id", "n")).alias("f")).select(
        "g", "h", "side", "f.id", "f.n")
    first = settle(against(reaching, firsts))
    links = verified(documents, first)
    met = first.join(links, ["a", "b"]).select("g", "h").distinct()
    apart = reaching.join(met, ["g", "h"], "left_anti")
    rest = settle(against(apart.where("side = 0"), apart.where("side = 1")).join(first, ["a", "b"], "left_anti"))
    return links if rest.isEmpty() else links.union(verified(documents, rest))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if counted to be short."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_duplicates(documents: DataFrame, sample_share: int = 5, common_rows: int = 400_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``documents`` (doc_id, text)."""
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(signatures(documents, *common_tokens(documents, sample_share, common_rows)))
    named = signed.where("doc_id is not null and n > 0")
    classes = settle(named.groupBy("fingerprint").agg(F.min("doc_id").alias("id")))
    # Copies of a class are few or many; the heavy prefix column moves only in the second case.
    copies = settle(named.select("doc_id", "fingerprint").join(classes, "fingerprint").where("doc_id != id").select("doc_id", "fingerprint"))
    full = named.join(_small(copies), ["doc_id", "fingerprint"], "left_anti").select(F.col("doc_id").alias("id"), "n", "often", "minima", "prefix", "bits")
    stars = verified(documents, _star_pairs(full))
    groups = settle(components(stars).where("node != component"))
    grouped = full.join(_small(groups.withColumnRenamed("node", "id")), "id", "left").select(
        "id", "n", "prefix", "bits", F.coalesce("component", "id").alias("group"))
    pairs = _candidate_groups(grouped)
    links = stars
    if not pairs.isEmpty():
        links = links.union(_opened(documents, _reaching(grouped, groups, pairs)))
    # Two texts under one id are one node: its classes link through it.
    same = named.join(classes.withColumnRenamed("id", "class"), "fingerprint").where("doc_id != class").select(
        F.col("doc_id").alias("id"), "class").distinct()
    twice = named.groupBy("doc_id").agg(F.min("fingerprint").alias("x"), F.max("fingerprint").alias("y")).where("x != y")
    links = links.union(same.join(twice, F.col("id") == F.col("doc_id")).select(F.col("id").alias("a"), F.col("class").alias("b")))
    found = components(links)
    owner = settle(classes.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "fingerprint", F.coalesce("component", "id").alias("component_id")))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "fingerprint").join(owner, "fingerprint", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id"))
                      .otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_representatives(documents: DataFrame, components_of: DataFrame) -> DataFrame:
    """One row of each component stays, with its own columns; a row without doc_id stays."""
    first = components_of.where("doc_id = component_id").groupBy("doc_id").count()
    kept = documents.join(first.select("doc_id"), "doc_id", "left_semi")
    repeated = settle(first.where("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once)
    return kept.unionByName(documents.where("doc_id is null")).select(*documents.columns)
