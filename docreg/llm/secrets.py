"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans (assign, access, hex) are regular expressions with a least length. Beside them the
scan collects weak parts that mean little alone: secret-like words, account identifiers and
endpoints. Parts are joined within scopes of one text: parts are put in the buckets, as wide as
the scope, that they touch, each bucket is summed per role and kind of evidence first, and a
part joins the sums of the buckets its scope touches. A weak secret or identifier is reported only if parts of both other
kinds of evidence, or a base span and one of them, lie within its scope.

Defined cases: a null text counts as empty; positions are code points; spans of equal start
follow the order of the kinds; repeated rows get equal results; rows without doc_id take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.llm.common import let, settle, spans_of, text_of

KINDS = ("assign", "access", "hex")
WEAK = ("weak_secret", "weak_identifier")
# The base patterns; a least length in hex and access saves listing short runs.
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
GATES = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{32}"}
PARTS = {
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+",
    "identifier": r"""(?i:(user|username|login|account|client_?id|access_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "endpoint": r"(?i:(?:https?|jdbc:[a-z]+|postgres|mysql|redis|amqp|ftp)://[^\x20\x09-\x0D\"'<>]+)|(?i:\b(?:host|endpoint|server)\x20*[:=]\x20*[a-z0-9.-]+)",
}


def _spans(text: Column, kind: str) -> Column:
    found = spans_of(text, PATTERNS[kind])
    if kind == "assign":
        found = F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], PATTERNS["assign"], 2)) >= 8)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Struct with one array of (start, end) per kind."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return F.struct(*[F.when(text.rlike(GATES[k]), _spans(text, k)).otherwise(none).alias(k) for k in KINDS])


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", text_of().alias("text")).withColumn("mark", F.xxhash64("text"))


def _parts(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, role, start, end, base): base spans and weak parts of texts that have two roles at least."""
    any_gate = "|".join([*GATES.values(), r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20}", r"(?i:user|login|account|client_?id|access_?id)"])
    texts = _rows(documents).where(F.col("text").rlike(any_gate))

    def part(t: Column, role: str, pattern: str) -> Column:
        return F.transform(spans_of(t, pattern), lambda s: F.struct(
            F.lit(role).alias("role"), s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("base")))

    def based(spans: Column, kind: str) -> Column:
        role = "identifier" if kind == "access" else "secret"
        return F.transform(spans, lambda s: F.struct(
            F.lit(role).alias("role"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("base")))

    def collected(t: Column) -> Column:
        weak = F.concat(*[part(t, role, pattern) for role, pattern in PARTS.items()])
        return let(F.struct(let(base_spans(t), lambda b: F.concat(*[based(b[k], k) for k in KINDS])).alias("base"), weak.alias("weak")),
                   lambda p: F.concat(p["base"], F.filter(p["weak"], lambda w: ~F.exists(
                       p["base"], lambda b: (b["start"] < w["end"]) & (b["end"] > w["start"])))))

    parts = texts.select("doc_id", "mark", let(F.col("text"), collected).alias("parts"))
    several = F.size(F.array_distinct(F.transform("parts", lambda p: p["role"]))) > 1
    return parts.where(several).select("doc_id", "mark", F.inline("parts"))


def linked_parts(documents: DataFrame, scope: int = 300) -> DataFrame:
    """(doc_id, mark, role, start, end) of weak secrets and identifiers with complementary parts within ``scope`` characters.

    The distance of two parts is the number of characters between them.
    """
    parts = settle(_parts(documents).distinct())
    # One row per bucket, role and kind of evidence: a part needs some other part only, not every pair. A part
    # counts in each bucket it touches with the piece that lies there.
    pieces = parts.select("doc_id", "mark", "role", "base", "start", "end", F.explode(F.sequence(
        F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("bucket"))
    near = pieces.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("bucket").alias("b"),
                          F.col("role").alias("other"), F.col("base").alias("firm")).agg(
        F.min(F.greatest("start", F.col("bucket") * scope)).alias("lo"),
        F.max(F.least("end", (F.col("bucket") + 1) * scope - 1)).alias("hi"))
    weak = parts.where(~F.col("base") & F.col("role").isin("secret", "identifier")).select(
        "doc_id", "mark", "role", "start", "end", (F.col("start") - scope).alias("from"), (F.col("end") + scope).alias("to"))
    weak = weak.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from") / scope), F.floor(F.col("to") / scope))))
    met = weak.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")) & (F.col("bucket") == F.col("b"))
                    & (F.col("other") != F.col("role")) & (F.col("lo") <= F.col("to")) & (F.col("hi") >= F.col("from")))
    linked = met.groupBy("doc_id", "mark", "role", "start", "end").agg(
        F.count_distinct("other").alias("roles"), F.bool_or("firm").alias("firm"))
    return settle(linked.where((F.col("roles") == 2) | F.col("firm")).select("doc_id", "mark", "role", "start", "end"))


def report(documents: DataFrame, scope: int = 300) -> DataFrame:
    """Counts, digest and span list of every row."""
    found = linked_parts(documents, scope).groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(
        F.collect_set(F.struct("start", F.when(F.col("role") == "secret", 3).otherwise(4).alias("order"), "end")).alias("more"))
    rows = _rows(documents).select("doc_id", "mark", base_spans(F.col("text")).alias("base"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    base = F.concat(*[F.transform(f"base.{k}", _ordered(i)) for i, k in enumerate(KINDS)])
    names = F.array(*map(F.lit, (*KINDS, *WEAK)))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
            ":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    none = F.expr("cast(array() as array<struct<start:int,order:int,end:int>>)")
    return rows.select(
        "doc_id", *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(base, F.coalesce("more", none))).alias("spans"))


def _ordered(number: int):
    def ordered(span: Column) -> Column:
        return F.struct(span["start"].alias("start"), F.lit(number).alias("order"), span["end"].alias("end"))

    return ordered
