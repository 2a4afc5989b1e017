"""Quality rules learned as a decision list.

Statistics of a text are DataFrame expressions. Sequential covering learns, from labelled
statistics, an ordered list of threshold conjunctions that name low quality; the list is
emitted as Spark conditional expressions. Learning reads small grouped counts only: every
step is one aggregation of (statistic, bin, label) counts. No Python runs on executors.

Defined cases: null and empty texts have no words and fail the base rule; without labels of
both kinds the list is empty and the base rule alone decides; repeated rows are judged one by
one; other columns are carried along untouched by ``keep_documents``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.llm.common import bounded_sample, let, only_ids, settle, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
STATISTICS = ("words", "mean_word", "symbol_share", "upper_share", "mark_share", "digit_share",
              "dup_line_share", "repeat_share", "distinct_share")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Test:
    """One threshold on one statistic."""

    statistic: str
    above: bool
    cut: float

    def holds(self, statistics: Column) -> Column:
        value = statistics[self.statistic]
        return value > self.cut if self.above else value <= self.cut


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a text is rejected by the first whose tests all hold."""

    rules: tuple[tuple[Test, ...], ...] = ()

    def verdict(self, statistics: Column) -> Column:
        """Number of the first rule that holds (from 1), null if none does."""
        chain = None
        for number, rule in enumerate(self.rules, 1):
            held = _all(rule, statistics)
            chain = F.when(held, number) if chain is None else chain.when(held, number)
        return F.lit(None).cast("int") if chain is None else chain.cast("int")


def _all(rule: tuple[Test, ...], statistics: Column) -> Column:
    out = F.lit(True)
    for test in rule:
        out = out & test.holds(statistics)
    return out


def statistics(text: Column) -> Column:
    """Struct of the base counts and of the shares the rules look at.

    Repeated windows are found by 64-bit hashes of their five words; only a text with an
    equal pair of windows is sorted.
    """
    def split(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(t.alias("text"), words_of(t).alias("words"), lines.alias("lines"))

    def hashed(a: Column) -> Column:
        return F.struct(a.alias("a"), F.transform(a["words"], lambda w: F.xxhash64(w)).alias("h"))

    def windowed(b: Column) -> Column:
        h = b["h"]
        windows = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
        return F.struct(b.alias("b"), F.slice(windows, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))).alias("win"))

    def counted(c: Column) -> Column:
        a, h, win = c["b"]["a"], c["b"]["h"], c["win"]
        count = lambda pattern: F.regexp_count(a["text"], F.lit(pattern)).cast("long")
        repeated = F.when(F.size(F.array_distinct(win)) < F.size(win), _covered(win)).otherwise(F.lit(0))
        return F.struct(
            F.size(h).cast("long").alias("n_words"), F.length(F.array_join(a["words"], "")).cast("long").alias("word_chars"),
            count(SYMBOLS).alias("n_symbols"),
            (F.size(a["lines"]) - F.size(F.array_distinct(a["lines"]))).cast("long").alias("n_dup_lines"),
            repeated.cast("long").alias("n_repeat_words"), F.size(a["lines"]).alias("lines"),
            F.size(F.array_distinct(h)).alias("distinct"), count("[A-Z]").alias("upper"),
            count("[!?]").alias("marks"), count("[0-9]").alias("digits"))

    def shared(d: Column) -> Column:
        def share(part: str, whole: str) -> Column:
            return F.when(d[whole] > 0, d[part] / d[whole]).otherwise(F.lit(0.0))

        return F.struct(
            *[d[name].alias(name) for name in BASE],
            d["n_words"].cast("double").alias("words"), share("word_chars", "n_words").alias("mean_word"),
            share("n_symbols", "word_chars").alias("symbol_share"), share("upper", "word_chars").alias("upper_share"),
            share("marks", "word_chars").alias("mark_share"), share("digits", "word_chars").alias("digit_share"),
            share("n_dup_lines", "lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
            share("distinct", "n_words").alias("distinct_share"))

    return let(split(text), lambda a: let(hashed(a), lambda b: let(windowed(b), lambda c: let(counted(c), shared))))


def _covered(windows: Column) -> Column:
    """Words under windows that occur twice or more."""
    def positions(ordered: Column) -> Column:
        return F.sort_array(F.filter(F.transform(ordered, lambda x, i: F.when(
            (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]), x["p"])),
            lambda p: p.isNotNull()))

    def total(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(
            F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda x, y: x + y)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return let(ordered, lambda o: let(positions(o), total))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = 20_000, bins: int = 32, max_rules: int = 8,
          max_tests: int = 4, min_precision: float = 0.95, min_cover: int = 5) -> DecisionList:
    """Sequential covering over a sample of at most about ``sample_rows`` labelled documents.

    Two thirds grow each rule test by test (information gain), one third prunes it and must
    confirm ``min_precision``; ``min_cover`` texts at least must fall under an accepted rule.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = bounded_sample(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", sample_rows)
    texts = only_ids(documents.select("doc_id", "text"), "doc_id", known.select("doc_id"), sample_rows)
    rows = settle(texts.select("doc_id", statistics(text_of()).alias("s")).join(known, "doc_id").select(
        "s", (F.col("quality") == 0).alias("bad"),
        (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("prune"))).where(~base_failed(F.col("s")))
    edges = rows.agg(*[F.percentile_approx(f"s.{s}", [i / bins for i in range(1, bins)], 2000).alias(s)
                       for s in STATISTICS]).first()
    cuts = {s: sorted({0.0, *(edges[s] or [])}) for s in STATISTICS}
    binned = settle(rows.withColumn("bins", F.array(*[_bin(F.col(f"s.{s}"), cuts[s]) for s in STATISTICS])))

    rules: list[tuple[Test, ...]] = []
    left, refused = binned, set()
    while len(rules) < max_rules:
        grown = _grow(left.where(~F.col("prune")), cuts, max_tests, refused)
        if not grown:
            break
        rule = _prune(left.where("prune"), grown, min_precision, min_cover)
        if not rule:
            # The pruning rows contradict it: look for a rule that starts elsewhere.
            refused.add(grown[0].statistic)
            continue
        rules.append(rule)
        left = left.where(~_all(rule, F.col("s")))
    return DecisionList(tuple(rules))


def _bin(value: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < value))


def _grow(rows: DataFrame, cuts: dict[str, list[float]], max_tests: int, refused: set[str]) -> tuple[Test, ...]:
    rule: list[Test] = []
    while len(rule) < max_tests:
        counts = (rows.where(_all(tuple(rule), F.col("s"))).select("bad", F.posexplode("bins").alias("stat", "bin"))
                  .groupBy("stat", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect())
        found = _best_test(counts, cuts, refused if not rule else set())
        if found is None:
            break
        rule.append(found)
    return tuple(rule)


def _best_test(counts: list, cuts: dict[str, list[float]], refused: set[str]) -> Test | None:
    """The test with the highest information gain; ties go to the earlier statistic and lower cut."""
    best, gain = None, 1e-9
    for s, name in enumerate(STATISTICS):
        cells = {r["bin"]: (r["p"], r["n"]) for r in counts if r["stat"] == s}
        total_p, total_n = (sum(c[i] for c in cells.values()) for i in (0, 1))
        if not total_p or not total_n:
            return None
        if name in refused:
            continue
        before = math.log2(total_p / (total_p + total_n))
        p = n = 0
        for i, cut in enumerate(cuts[name]):
            p, n = p + cells.get(i, (0, 0))[0], n + cells.get(i, (0, 0))[1]
            for above, (a, b) in ((False, (p, n)), (True, (total_p - p, total_n - n))):
                value = a * (math.log2(a / (a + b)) - before) if a else 0.0
                if value > gain:
                    best, gain = Test(name, above, float(cut)), value
    return best


def _prune(rows: DataFrame, rule: tuple[Test, ...], min_precision: float, min_cover: int) -> tuple[Test, ...]:
    """The prefix of the rule that is best on the pruning rows, or nothing."""
    if not rule:
        return ()
    prefixes = [rule[:i] for i in range(1, len(rule) + 1)]
    row = rows.agg(*[F.count_if(_all(r, F.col("s")) & F.col("bad")).alias(f"p{i}") for i, r in enumerate(prefixes)],
                   *[F.count_if(_all(r, F.col("s")) & ~F.col("bad")).alias(f"n{i}") for i, r in enumerate(prefixes)]).first()
    scored = [((row[f"p{i}"] - row[f"n{i}"]) / max(row[f"p{i}"] + row[f"n{i}"], 1), -i) for i in range(len(prefixes))]
    i = -max(scored)[1]
    p, n = row[f"p{i}"], row[f"n{i}"]
    return prefixes[i] if p + n >= min_cover and p >= min_precision * (p + n) else ()


def judged(text: Column, rules: DecisionList) -> Column:
    """Struct of the base counts, ``base_failed``, ``kept`` and the number of the rule that rejects."""
    def verdict(s: Column) -> Column:
        return let(rules.verdict(s), lambda rule: F.struct(
            *[s[name].alias(name) for name in BASE], base_failed(s).alias("base_failed"),
            (~base_failed(s) & rule.isNull()).alias("kept"), rule.alias("rule")))

    return let(statistics(text), verdict)


def judge(documents: DataFrame, rules: DecisionList) -> DataFrame:
    """Base counts and verdict of every row."""
    return documents.select("doc_id", judged(text_of(), rules).alias("j")).select("doc_id", "j.*")


def keep_documents(documents: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of ``documents`` that no rule rejects, with their own columns."""
    return documents.where(judged(text_of(), rules)["kept"])
