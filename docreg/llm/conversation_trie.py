"""Prefix trie of conversations, built as a Z-fast trie.

A prefix of d turns is named by (d, a, b): sums of two 64-bit hashes of every turn with its
place, so all prefix names of a conversation are running sums. The compacted trie has a node
where conversations end or part. A node of depth d below a node of depth ``low`` is filed in a
hash table under its handle: the prefix whose depth is the two-fattest number of (low, d], the
one with the most trailing zero bits. A fat binary search then finds the node at which a
conversation leaves the trie in about log(turns) lookups, each one join for all conversations
of a batch. What lies behind that point is new: the batch's new suffixes alone are grouped,
edges are split, and the next batch searches the larger trie. At last members, leaves and saved
words are summed up the compacted trie by pointer doubling, and edges are expanded to one row
per turn.

Defined cases: turns are ordered by number (null first), then by a digest of role and text;
null role or text is empty; rows without conv_id belong to no conversation and are left out;
repeated rows are turns of their own; a table without conversations gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreg.functions.prefix import ranked, running
from docreg.llm.common import stored, text_of, words_of
from docreg.session import ship_package

GROUP = 20
LENT = 4
SHARES = (0.125, 1.0)
_NAME = ["d", "a", "b"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words): every turn and its place, from 1, in its conversation."""
    role, text = text_of("role"), text_of("text")
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.size(words_of(text)).cast("bigint").alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    return ranked(turns, ["conv_id"], order, F.shiftright("turn", 10), "place").select("conv_id", "place", "digest", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, turns) after each conversation took over the first turns of the head of its group.

    ids: (conv_id, size) of every conversation, turnless ones too. turns: (conv_id, d, digest, words).
    """
    sizes = stored(turns.groupBy("conv_id").agg(F.max("place").alias("own")))
    asked = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(LENT))
    head = F.col("conv_id") - F.col("conv_id") % GROUP
    ids = sizes.select("conv_id", "own", asked.alias("h"), head.alias("head")).join(
        sizes.select(F.col("conv_id").alias("head"), F.col("own").alias("there")), "head", "left")
    lent = F.least("h", F.coalesce("there", F.lit(0)))
    ids = stored(ids.select("conv_id", "head", "h", lent.alias("lent"), (lent + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")))
    given = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < LENT)).withColumnRenamed("conv_id", "head")
    taken = ids.select("conv_id", "head", "lent").join(given, "head").where("place <= lent").select(
        "conv_id", F.col("place").alias("d"), "digest", "words")
    kept = turns.join(ids.select("conv_id", "h", "lent"), "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("d"), "digest", "words")
    return ids.select("conv_id", "size"), taken.unionByName(kept)


def prefixes_of(turns: DataFrame) -> DataFrame:
    """(conv_id, d, a, b, pa, pb, w, words): name of each prefix and of the one before it, words so far."""
    def term(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), F.col("d"), F.col("digest")).cast("decimal(20,0)")

    named = turns.select("conv_id", "d", "words", term(1).alias("ta"), term(2).alias("tb"))
    summed = running(named, ["conv_id"], [F.col("d")], F.shiftright("d", 10), {
        "sa": ("sum", "ta"), "sb": ("sum", "tb"), "w": ("sum", "words")})

    def name(total: Column) -> Column:
        return F.pmod(total, F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("bigint")

    first = F.col("d") == 1
    return summed.select("conv_id", "d", name(F.col("sa")).alias("a"), name(F.col("sb")).alias("b"),
                         F.when(first, 0).otherwise(name(F.col("sa") - F.col("ta"))).cast("bigint").alias("pa"),
                         F.when(first, 0).otherwise(name(F.col("sb") - F.col("tb"))).cast("bigint").alias("pb"),
                         F.col("w").cast("bigint").alias("w"), "words")


def two_fattest(low: Column, high: Column) -> Column:
    """The number of (low, high] with the most trailing zero bits."""
    shift = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, shift), shift)


def _at(prefixes: DataFrame, conv: str, depth: str, a: str, b: str) -> DataFrame:
    """Names by conversation and depth, under the given column names."""
    return prefixes.select(F.col("conv_id").alias(conv), F.col("d").alias(depth), F.col("a").alias(a), F.col("b").alias(b))


def filed(nodes: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(handles, branches) of all nodes but the root: filed by handle, and by the first turn of their edge."""
    below = nodes.where("d > 0").withColumn("f", two_fattest(F.col("low"), F.col("d"))).withColumn("e", F.col("low") + 1)
    node = [F.col("d").alias("node_d"), F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.col("low").alias("node_low")]
    handles = below.join(_at(prefixes, "rep", "f", "fa", "fb"), ["rep", "f"]).select("f", "fa", "fb", *node)
    branches = below.join(_at(prefixes, "rep", "e", "ea", "eb"), ["rep", "e"]).select("e", "ea", "eb", "rep", *node)
    return stored(handles), stored(branches)


def located(strings: DataFrame, nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(conv_id, size, lo, l, ...): where each string leaves the trie.

    ``lo`` is the depth of the last node it passes, ``l`` the turns it shares with the trie; if
    it leaves inside an edge, ``node_*`` and ``rep`` name the node below that edge.
    """
    handles, branches = filed(nodes, prefixes)
    at = stored(strings.select("conv_id", "size", F.lit(0).cast("bigint").alias("lo"), F.col("size").alias("hi")))
    while not handles.isEmpty():
        open_ = at.where("lo < hi").withColumn("f", two_fattest(F.col("lo"), F.col("hi")))
        if open_.isEmpty():
            break
        asked = open_.join(_at(prefixes, "conv_id", "f", "fa", "fb"), ["conv_id", "f"]).join(handles, ["f", "fa", "fb"], "left")
        # A found node is passed if the string also agrees with it at its full depth.
        met = asked.join(_at(prefixes, "conv_id", "node_d", "xa", "xb"), ["conv_id", "node_d"], "left")
        passed = (F.col("xa") == F.col("node_a")) & (F.col("xb") == F.col("node_b"))
        missed = F.col("node_low").isNull()
        lo = F.when(missed, F.col("lo")).when(F.coalesce(passed, F.lit(False)), F.col("node_d")).otherwise(F.col("node_low"))
        hi = F.when(missed, F.col("f") - 1).when(F.coalesce(passed, F.lit(False)), F.col("hi")).otherwise(F.col("node_low"))
        at = stored(met.select("conv_id", "size", lo.alias("lo"), hi.alias("hi")).union(at.where("lo >= hi")))
    ahead = at.withColumn("e", F.col("lo") + 1).join(_at(prefixes, "conv_id", "e", "ea", "eb"), ["conv_id", "e"], "left")
    edges = stored(ahead.join(branches, ["e", "ea", "eb"], "left").select(
        "conv_id", "size", "lo", "rep", "node_d", "node_a", "node_b"))
    # Turns shared along the edge: names agree up to the point of parting.
    own = edges.where("node_d is not null").join(prefixes.select("conv_id", "d", "a", "b"), "conv_id").where("d > lo and d < node_d")
    same = own.select("conv_id", "rep", "d", "a", "b").join(
        prefixes.select(F.col("conv_id").alias("rep"), "d", "a", "b"), ["rep", "d", "a", "b"]).groupBy("conv_id").agg(F.max("d").alias("met"))
    return stored(edges.join(same, "conv_id", "left").withColumn("l", F.coalesce("met", "lo")).drop("met"))


def insert(nodes: DataFrame, strings: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Nodes (d, a, b, low, rep) of the trie with ``strings`` (conv_id, size; all different) taken in."""
    found = located(strings, nodes, prefixes)
    rows = stored(prefixes.join(found.select("conv_id", "size", "lo", "l"), "conv_id").where("d >= l").select(
        "conv_id", "d", "a", "b", "pa", "pb", "size", "lo", "l"))
    parted = found.where("node_d is not null and l > lo").select("conv_id", "l", "lo", "rep", "node_d", "node_a", "node_b")
    cuts = stored(parted.join(_at(prefixes, "conv_id", "l", "a", "b"), ["conv_id", "l"]).groupBy(
        F.col("l").alias("d"), "a", "b").agg(*(F.first(c).alias(c) for c in ("lo", "rep", "node_d", "node_a", "node_b"))))
    edge = Window.partitionBy("node_d", "node_a", "node_b").orderBy("d")
    splits = cuts.select(*_NAME, F.coalesce(F.lag("d").over(edge), "lo").alias("low"), "rep")
    lifted = cuts.groupBy("node_d", "node_a", "node_b").agg(F.max("d").alias("raised"))
    differ = (F.min("a") < F.max("a")) | (F.min("b") < F.max("b"))
    forks = rows.where("d - 1 > l").groupBy((F.col("d") - 1).alias("d0"), "pa", "pb").agg(differ.alias("fork")).where("fork").select(
        F.col("d0").alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    ends = rows.where("d = size and d > l").select(*_NAME)
    fresh = stored(forks.union(ends).distinct())
    marks = rows.join(fresh.withColumn("new", F.lit(True)), _NAME).select("conv_id", *_NAME, "l")
    path = Window.partitionBy("conv_id").orderBy("d")
    # The node above the first new one is where the string left the trie.
    grown = marks.withColumn("low", F.coalesce(F.lag("d").over(path), "l")).groupBy(*_NAME).agg(
        F.max("low").alias("low"), F.min("conv_id").alias("rep"))
    raised = nodes.join(lifted.select(F.col("node_d").alias("d"), F.col("node_a").alias("a"), F.col("node_b").alias("b"), "raised"), _NAME, "left").select(
        *_NAME, F.coalesce("raised", "low").alias("low"), "rep")
    return stored(raised.unionByName(splits.select(*_NAME, "low", "rep")).unionByName(grown.select(*_NAME, "low", "rep")))


def build(strings: DataFrame, prefixes: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """Compacted trie (d, a, b, low, rep) of ``strings``, inserted in batches up to the given shares of them.

    ``rep`` is a conversation that passes the node, ``low`` the depth of the node above.
    """
    spark = strings.sparkSession
    nodes = stored(spark.createDataFrame([(0, 0, 0, 0, None)], "d bigint, a bigint, b bigint, low bigint, rep bigint"))
    draw = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20))
    done = 0
    for share in shares:
        upto = round(share * (1 << 20))
        batch = stored(strings.where((draw >= done) & (draw < upto)))
        if not batch.isEmpty():
            nodes = insert(nodes, batch, prefixes)
        done = upto
    return nodes


def subtree_sums(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(id, each value combined over the subtree of a node) for nodes (id, parent, inputs).

    After k rounds a node holds the values of descendants fewer than 2^k levels below it and
    points at its ancestor 2^k levels up.
    """
    at = stored(nodes.select("id", F.col("parent").alias("up"), *(c.alias(n) for n, c in values.items())))
    while not at.where("up is not null").isEmpty():
        risen = at.where("up is not null").groupBy(F.col("up").alias("id")).agg(
            *(F.min(n).alias(f"more_{n}") if n.startswith("least") else F.sum(n).alias(f"more_{n}") for n in values))
        above = at.select(F.col("id").alias("up"), F.col("up").alias("next"))
        at = stored(at.join(risen, "id", "left").join(above, "up", "left").select(
            "id", F.col("next").alias("up"),
            *((F.least(n, f"more_{n}") if n.startswith("least") else F.col(n) + F.coalesce(f"more_{n}", F.lit(0))).cast("bigint").alias(n)
              for n in values)))
    return at.drop("up")


def end_digests(members: DataFrame) -> DataFrame:
    """(d, a, b, ends_sha256) of members (d, a, b, conv_id): digest of the sorted ids.

    Ids are joined in pieces of 4,096 numbers first; the pieces of a group then stream through one digest.
    """
    ship_package(members.sparkSession)
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = members.groupBy(*_NAME, F.shiftright("conv_id", 12).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))
    ordered = pieces.repartition(*_NAME).sortWithinPartitions(*_NAME, "piece").select(*_NAME, "ids")
    names = [*_NAME, "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            out = []
            for d, a, b, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, a, b) == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = (d, a, b), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], kinds)
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*at, digest.hexdigest())))], kinds)

    kinds = pa.schema([*((n, pa.int64()) for n in _NAME), ("ends_sha256", pa.string())])
    return ordered.mapInArrow(run, "d bigint, a bigint, b bigint, ends_sha256 string")


def trie(conversations: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    """
    turns = stored(turns_of(conversations))
    ids, again = rebuilt(turns)
    prefixes = stored(prefixes_of(again))
    last = prefixes.select("conv_id", F.col("d").alias("size"), "a", "b")
    members = stored(ids.join(last, ["conv_id", "size"], "left").select(
        "conv_id", F.col("size").alias("d"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")))
    ends = stored(members.groupBy(*_NAME).agg(F.count("*").alias("here"), F.min("conv_id").alias("first")))
    strings = ends.where("d > 0").select(F.col("first").alias("conv_id"), F.col("d").alias("size"))
    nodes = build(strings, prefixes, shares)
    # Each node meets its end counts, the words along its edge and the name of the node above.
    words = prefixes.select(F.col("conv_id").alias("rep"), F.col("d"), F.col("w").alias("w"))
    above = prefixes.select(F.col("conv_id").alias("rep"), F.col("d").alias("low"), F.col("w").alias("w0"), F.col("a").alias("ua"), F.col("b").alias("ub"))
    numbered = stored(nodes.join(ends, _NAME, "left").join(words, ["rep", "d"], "left").join(above, ["rep", "low"], "left").select(
        F.monotonically_increasing_id().alias("id"), *_NAME, "low", "rep", "here", "first",
        F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("w0", F.lit(0)).alias("w0"),
        F.coalesce("ua", F.lit(0)).alias("ua"), F.coalesce("ub", F.lit(0)).alias("ub")))
    parents = numbered.select(F.col("id").alias("parent"), F.col("d").alias("low"), F.col("a").alias("ua"), F.col("b").alias("ub"))
    tree = stored(numbered.join(parents.withColumn("under", F.lit(True)), ["low", "ua", "ub"], "left").withColumn(
        "parent", F.when(F.col("d") > 0, F.col("parent"))).drop("ua", "ub", "under"))
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    tree = stored(tree.join(children, "id", "left").withColumn("children", F.coalesce("children", F.lit(0)).cast("bigint")))
    counts = subtree_sums(tree, {"n": F.coalesce("here", F.lit(0)).cast("bigint"), "leaves": (F.col("children") == 0).cast("bigint"),
                                 "least_conv": F.col("first")})
    weighed = stored(tree.join(counts, "id").withColumn("weight", (F.col("n") - 1) * (F.col("w") - F.col("w0"))))
    saved = subtree_sums(weighed, {"saved": F.col("weight")})
    full = stored(weighed.join(saved, "id"))
    up = full.select(F.col("id").alias("parent"), F.col("least_conv").alias("up_conv"))
    digests = end_digests(members)
    edges = full.join(up, "parent", "left").join(digests, _NAME, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    root = edges.where("d = 0 and n > 0").select(
        F.col("least_conv").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    expanded = edges.where("d > 0").withColumn("depth", F.explode(F.sequence(F.col("low") + 1, F.col("d"))))
    step = prefixes.select(F.col("conv_id").alias("rep"), F.col("d").alias("depth"), (F.col("w") - F.col("words")).alias("before"))
    own, bottom = F.col("least_conv"), F.col("depth") == F.col("d")
    inner = expanded.join(step, ["rep", "depth"]).select(
        own.alias("conv_id"), "depth", F.when(F.col("depth") - 1 > F.col("low"), own).otherwise(F.col("up_conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("children")).otherwise(1).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - F.col("weight") + (F.col("n") - 1) * (F.col("w") - F.col("before"))).alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends_sha256", none)).otherwise(none).alias("ends_sha256"))
    return root.unionByName(inner)
