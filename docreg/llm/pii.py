"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base entities (email, ip, card, phone) are found by regular expressions with their checks.
They seed a bootstrap: words around an entity are lexical patterns, identifier-like words
(with a digit or an at sign) or groups of such words are instances, and the graph of patterns
and instances is scored in rounds until nothing changes. A pattern is as good as the share of its places whose instance is trusted; an
instance as its best pattern. Patterns that are good enough, and seen with enough different
trusted instances, report the identifiers the base patterns missed, as kind ``id``.

Defined cases: a null text counts as empty; empty texts have no spans; positions are code
points; ties of patterns change nothing, since only maxima are used; repeated rows get equal
results; documents without doc_id take part and are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.llm.common import let, settle, spans_of, text_of

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
# The base patterns. Possessive repeats and the look-behinds only save time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IDENTIFIER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*"
CONTEXT = 60


def _luhn(digits: Column) -> Column:
    def doubled(d: Column, i: Column) -> Column:
        twice = d * 2
        return F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    return F.aggregate(F.transform(values, doubled), F.lit(0), lambda a, b: a + b) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.length(F.ltrim(F.lit("0"), part)).between(0, 3)
                        & (F.coalesce(part.try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _of_kind(text: Column, kind: str) -> Column:
    return F.transform(F.filter(spans_of(text, PATTERNS[kind]), lambda s: _valid(kind, s)),
                       lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Struct with one array of (start, end) per kind, in order of the text."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    gate = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
    return F.struct(*[F.when(text.rlike(gate[k]), _of_kind(text, k)).otherwise(none).alias(k) for k in KINDS])


def digest(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _row_key(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", text_of().alias("text")).withColumn("mark", F.xxhash64("text"))


def _instances(words: Column, base: Column) -> Column:
    """Array of (start, end, value, near, after, seed): identifier words of one text put together.

    Words that one base span touches are one instance, and so are neighbouring words outside
    the base spans with only blanks between, unless punctuation parts them.
    """
    def touched(start: Column, end: Column) -> Column:
        return F.exists(base, lambda s: (s["start"] < end) & (s["end"] > start))

    def marked(w: Column, i: Column) -> Column:
        return F.struct(
            w["start"].alias("start"), w["end"].alias("end"), w["value"].alias("value"), w["before"].alias("before"),
            w["after"].alias("after"), i.alias("at"), touched(w["start"], w["end"]).alias("seed"))

    def joins(ws: Column, w: Column) -> Column:
        def joined(last: Column) -> Column:
            inside = F.exists(base, lambda s: (s["start"] < last["end"]) & (s["end"] > w["start"]))
            apart = last["seed"] | w["seed"] | ~w["before"].rlike(r"^\x20+$")
            return F.when(last["seed"] & w["seed"] & inside, True).when(apart, False).otherwise(
                last["value"].rlike(r"[\p{L}\p{N})-]$") & w["value"].rlike(r"^[\p{L}\p{N}(]"))

        return F.when(w["at"] > 0, let(F.get(ws, w["at"] - 1), joined)).otherwise(F.lit(False))

    def text_at(ws: Column, at: Column, part: str) -> Column:
        return F.coalesce(F.get(ws, at)[part], F.lit(""))

    def built(ws: Column, first: Column, stop: Column) -> Column:
        run = F.slice(ws, first + 1, stop - first)
        value = F.array_join(F.transform(run, lambda w: F.concat(
            F.when(w["at"] == first, "").otherwise(w["before"]), w["value"])), "")
        # The two words before are the neighbours or lie in the gaps between them.
        near = F.concat(text_at(ws, first - 2, "value"), F.right(text_at(ws, first - 1, "before"), F.lit(CONTEXT)),
                        text_at(ws, first - 1, "value"), F.right(text_at(ws, first, "before"), F.lit(CONTEXT)))
        after = F.concat(F.left(text_at(ws, stop - 1, "after"), F.lit(CONTEXT)), text_at(ws, stop, "value"))
        return F.struct(
            F.get(ws, first)["start"].alias("start"), F.get(ws, stop - 1)["end"].alias("end"), value.alias("value"),
            F.right(near, F.lit(CONTEXT)).alias("near"), F.left(after, F.lit(CONTEXT)).alias("after"),
            F.get(ws, first)["seed"].alias("seed"))

    def grouped(ws: Column) -> Column:
        heads = F.transform(F.filter(ws, lambda w: ~joins(ws, w)), lambda w: w["at"])
        return let(heads, lambda h: F.transform(h, lambda first, k: built(
            ws, first, F.coalesce(F.get(h, k + 1), F.size(ws)))))

    return let(F.transform(words, marked), grouped)


def _mentions(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, start, end, value, patterns, seed) of every identifier, be it one word or a group of words."""
    def found(t: Column) -> Column:
        return let(F.struct(let(base_spans(t), lambda b: F.concat(*[b[k] for k in KINDS])).alias("base"),
                            spans_of(t, IDENTIFIER).alias("words")), lambda m: _instances(m["words"], m["base"]))

    words = _row_key(documents).where(F.col("text").rlike("[0-9@]")).select(
        "doc_id", "mark", F.explode(let(F.col("text"), found)).alias("w"))
    letters = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}]", "")
    # A number beside an instance stands for any number.
    clean = lambda c: F.when((letters(c) == "") & c.rlike("[0-9]"), "#").otherwise(letters(c))
    near, after = F.col("w.near"), F.col("w.after")
    left = F.regexp_extract(near, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", 2)
    earlier = F.regexp_extract(near, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+$", 1)
    right = F.regexp_extract(after, r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1)
    # Punctuation around an instance is no part of it.
    core = F.regexp_extract(F.col("w.value"), r"^[^\p{L}\p{N}+]*(.*?)[^\p{L}\p{N}]*$", 1)
    lead = F.length(F.regexp_extract(F.col("w.value"), r"^([^\p{L}\p{N}+]*)", 1))
    out = words.select(
        "doc_id", "mark", F.col("w.seed").alias("seed"), (F.col("w.start") + lead).alias("start"),
        (F.col("w.start") + lead + F.length(core)).alias("end"), F.lower(core).alias("value"),
        clean(left).alias("l"), clean(earlier).alias("e"), clean(right).alias("r")).where(F.length("value") >= 5)
    patterns = F.filter(F.array(
        F.when((F.col("l") != "") & (F.col("e") != ""), F.concat_ws(" ", F.col("e"), F.col("l"), F.lit("_"))),
        F.when((F.col("l") != "") & (F.col("r") != ""), F.concat_ws(" ", F.col("l"), F.lit("_"), F.col("r")))),
        lambda p: p.isNotNull())
    return out.select("doc_id", "mark", "start", "end", "value", "seed", patterns.alias("patterns"))


def bootstrap(documents: DataFrame, min_confidence: float = 0.8, min_instances: int = 3) -> DataFrame:
    """(doc_id, mark, start, end) of identifiers that trusted patterns discover beside the base entities.

    Rounds go on until no score changes. Scores only rise and are kept to six decimals, so
    that the rounds end.
    """
    mentions = settle(_mentions(documents))
    # One row per edge of the graph, so that a frequent pattern or value is one sum.
    edges = settle(mentions.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(
        F.count("*").alias("n"), F.bool_or("seed").alias("seed")))
    # A pattern with too few instances can never be good, whatever their scores.
    able = edges.groupBy("pattern").agg(F.count("*").alias("instances")).where(F.col("instances") >= min_instances)
    able_edges = settle(edges.join(able.select("pattern"), "pattern"))
    values = settle(edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score")).join(
        able_edges.select("value").distinct(), "value"))
    while True:
        scored = able_edges.join(values, "value")
        patterns = settle(scored.groupBy("pattern").agg(
            F.round(F.sum(F.col("n") * F.col("score")) / F.sum("n"), 6).alias("confidence"),
            F.count_if(F.col("score") >= min_confidence).alias("trusted")))
        good = patterns.where((F.col("confidence") >= min_confidence) & (F.col("trusted") >= min_instances))
        reached = able_edges.join(good, "pattern").groupBy("value").agg(F.max("confidence").alias("reached"))
        risen = settle(values.join(reached, "value", "left").select(
            "value", F.greatest("score", F.coalesce("reached", F.lit(0.0))).alias("score"),
            (F.coalesce("reached", F.lit(0.0)) > F.col("score")).alias("rose")))
        if risen.where("rose").isEmpty():
            break
        values = risen.drop("rose")
    places = mentions.where(~F.col("seed")).select("doc_id", "mark", "start", "end", F.explode("patterns").alias("pattern"))
    return settle(places.join(good.select("pattern"), "pattern").select("doc_id", "mark", "start", "end").distinct())


def _with_found(documents: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``documents`` (columns, mark) with an array ``found`` of discovered spans."""
    lists = found.groupBy(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark")).agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__found"))
    return documents.join(lists, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark")), "left").select(
        *columns, F.coalesce("__found", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("found"))


def find_personal_data(documents: DataFrame, **bootstrapping) -> DataFrame:
    """(doc_id, base, found): base spans per kind and discovered spans of every row."""
    found = bootstrap(documents, **bootstrapping)
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    base = F.when(F.col("text").rlike("[0-9@]"), base_spans(F.col("text"))).otherwise(
        F.struct(*[none.alias(k) for k in KINDS]))
    rows = _row_key(documents).select("doc_id", "mark", base.alias("base"))
    return _with_found(rows, found, ["doc_id", "base"])


def report(documents: DataFrame, **bootstrapping) -> DataFrame:
    """Counts, digest and span list of every row."""
    rows = find_personal_data(documents, **bootstrapping)
    base = F.concat(*[digest(F.col(f"base.{k}"), k) for k in KINDS])
    return rows.select(
        "doc_id", *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, digest(F.col("found"), FOUND)), ",").alias("spans"))


def redact(documents: DataFrame, **bootstrapping) -> DataFrame:
    """``documents`` with every span replaced by its kind in angle brackets; overlapping spans become one.

    A column ``n_chars`` follows the new text; all other columns stay.
    """
    columns = documents.columns
    found = bootstrap(documents, **bootstrapping)
    kept = documents.select(F.col("doc_id"), text_of().alias("text"), F.struct(*columns).alias("__row")).withColumn(
        "mark", F.xxhash64("text"))
    rows = _with_found(kept, found, ["text", "__row"])

    def tagged(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("tag")))

    def cut(spans: Column, text: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            ahead = s["start"] >= acc["at"]
            piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["tag"])
            return F.struct(F.when(ahead, piece).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        return F.aggregate(spans, start, step, lambda acc: F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    def clean(text: Column, more: Column) -> Column:
        spans = let(base_spans(text), lambda b: F.sort_array(F.concat(
            *[tagged(b[k], k) for k in KINDS], tagged(more, FOUND))))
        return let(spans, lambda s: F.when(F.size(s) > 0, cut(s, text)).otherwise(text))

    text = F.when(F.col("text").rlike("[0-9@]"), clean(F.col("text"), F.col("found"))).otherwise(F.col("text"))
    out = rows.select("__row", text.alias("__text"))
    return out.select(*[
        F.when(F.col("__row")["text"].isNull(), None).otherwise(F.col("__text")).alias(c) if c == "text"
        else F.length("__text").cast("long").alias(c) if c == "n_chars" else F.col("__row")[c].alias(c) for c in columns])
