"""OCR evaluation: error rates, confidence, comparison, reports, batch prediction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreg.functions import distance as D
from docreg.functions import values as V
from docreg.operators.datasets import split_scope
from docreg.operators.ordering import top_k


def pair_distances(pairs: DataFrame, spread: int | None = None) -> DataFrame:
    """Adds char_errors, chars, word_errors, words, exact to (reference, hypothesis).

    The distance is quadratic in the text length, so a few hundred kilobytes already keep
    a core busy for seconds. ``spread`` deals the pairs over that many tasks first; leave
    it out when the input has enough splits.
    """
    if spread:
        pairs = pairs.repartition(spread)
    ref, hyp = F.col("reference"), F.col("hypothesis")
    same = ref == hyp
    return pairs.withColumns({
        "char_errors": F.when(same, 0).otherwise(D.char_distance(ref, hyp)),
        "chars": F.length(ref),
        "word_errors": F.when(same, 0).otherwise(D.word_distance(ref, hyp)),
        "words": F.size(D.words(ref)),
        "exact": same,
    })


def corpus_metrics(pairs: DataFrame, by: list[str] | None = None, spread: int | None = None) -> DataFrame:
    """Corpus CER, WER and exact-match rate: ratios of sums, 0.0 without reference units."""
    by = by or []
    sums = pair_distances(pairs, spread).groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("char_errors", "chars", "word_errors", "words")],
        F.count_if("exact").alias("exact"), F.count("*").alias("total"))

    def rate(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))

    return sums.select(
        *by, rate("char_errors", "chars").alias("cer"), rate("word_errors", "words").alias("wer"),
        rate("exact", "total").alias("accuracy"), "exact", "total",
        "char_errors", "chars", "word_errors", "words")


def sequence_confidence(token_scores: DataFrame, eos: str, bucket_size: int = 4096) -> DataFrame:
    """Geometric mean of token probabilities up to the first end token, in percent.

    Tokens without a finite score are skipped, so they cannot end a sequence either.
    Long sequences are worked on in pieces of ``bucket_size`` positions.
    """
    lp = F.col("log_prob")
    finite = lp.isNotNull() & ~F.isnan(lp) & (F.abs(lp) != float("inf"))
    marked = token_scores.select(
        "seq_id", "pos", F.floor(F.col("pos") / bucket_size).alias("_piece"),
        F.when(finite, lp).alias("_lp"), (finite & (F.col("token") == eos)).alias("_end"))
    inside = Window.partitionBy("seq_id", "_piece").orderBy("pos")
    earlier = F.coalesce(F.max("_end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    pieces = marked.withColumn("_over", earlier).groupBy("seq_id", "_piece").agg(
        F.sum(F.when(~F.col("_over"), F.col("_lp"))).alias("_sum"),
        F.count(F.when(~F.col("_over"), F.col("_lp"))).alias("_n"), F.bool_or("_end").alias("_ends"))
    before = Window.partitionBy("seq_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    live = pieces.withColumn("_dead", F.coalesce(F.max("_ends").over(before), F.lit(False))).where(~F.col("_dead"))
    return live.groupBy("seq_id").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("tokens")).select(
        "seq_id", "tokens",
        F.when(F.col("tokens") > 0, F.bround(F.exp(F.col("_sum") / F.col("tokens")) * 100, 1))
        .otherwise(F.lit(0.0)).alias("confidence"))


def prediction_summary(predictions: DataFrame, threshold: float) -> DataFrame:
    """Rows, mean confidence and low readings; failed rows carry no confidence."""
    scored = F.when(F.col("error").isNull(), F.col("confidence"))
    return predictions.agg(
        F.count("*").alias("count"),
        F.coalesce(F.bround(F.avg(scored), 1), F.lit(0.0)).alias("average_confidence"),
        F.count_if(scored < threshold).alias("low_confidence"))


def scored_rows(manifest: DataFrame, images: DataFrame, predictions: DataFrame, split: str) -> DataFrame:
    """(filename, reference, prediction, match) of the images that were read."""
    read = predictions.where(F.col("error").isNull()).select(
        "filename", V.strip_unicode(F.col("text")).alias("prediction"))
    labelled = split_scope(manifest, images, split).select(
        "filename", V.strip_unicode(F.col("label")).alias("reference"))
    return labelled.join(read, "filename", "inner").withColumn("match", F.col("reference") == F.col("prediction"))


def evaluate_predictions(manifest: DataFrame, images: DataFrame, predictions: DataFrame, split: str,
                         max_rows: int | None = None, spread: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics, rows): rates with four decimals, and the rows; the first ``max_rows`` by file name if a report wants so many."""
    rows = scored_rows(manifest, images, predictions, split)
    m = corpus_metrics(rows.withColumnRenamed("prediction", "hypothesis"), spread=spread)
    metrics = m.select(
        F.bround("cer", 4).alias("cer"), F.bround("wer", 4).alias("wer"),
        F.bround("accuracy", 4).alias("exact_match"), "exact", "total")
    return metrics, rows if max_rows is None else top_k(rows, [F.col("filename")], max_rows)


_METRICS = {"CER": "cer", "WER": "wer", "Accuracy": "accuracy"}


def compare_models(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Per metric: base, tuned and verdict. Lower is better for the error rates."""
    def tall(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.expr(
            f"stack({len(_METRICS)}, " + ", ".join(f"'{k}', cast({c} as double)" for k, c in _METRICS.items())
            + f") as (metric, {name})"))

    gain = F.when(F.col("metric") == "Accuracy", F.col("tuned") - F.col("base")).otherwise(F.col("base") - F.col("tuned"))
    return tall(base, "base").join(tall(tuned, "tuned"), "metric").withColumn(
        "verdict", F.when(gain > 0, "better").when(gain == 0, "same").otherwise("worse"))


def build_evaluation_report(metrics: DataFrame, *, model_key: str, dataset: str, manifest_sha256: str,
                            weights_file: str, weights_sha256: str, evaluated_at: str) -> DataFrame:
    """One JSON report bound to the weights and the manifest by digest."""
    return metrics.select(F.to_json(F.struct(
        F.lit(1).alias("schema_version"), F.lit(model_key).alias("model_key"), F.lit(dataset).alias("dataset"),
        F.lit(manifest_sha256).alias("manifest_sha256"), F.lit("test").alias("split"),
        F.col("total").alias("sample_count"),
        F.struct("cer", "wer", F.col("accuracy").alias("exact_match")).alias("metrics"),
        F.lit(evaluated_at).alias("evaluated_at"), F.lit(weights_file).alias("weights_file"),
        F.lit(weights_sha256).alias("weights_sha256"),
    )).alias("value"))


Predictor = Callable[[pd.DataFrame], list[tuple[str, float]]]


def batch_predict(df: DataFrame, load: Callable[[], Predictor], batch_size: int = 8) -> DataFrame:
    """Adds text, confidence and error.

    ``load`` runs once per task and returns a function from a batch of rows to
    (text, confidence) pairs. A failing batch is retried row by row; a failing row
    carries its error instead of failing the job.
    """
    if batch_size < 1:
        raise ValueError("batch_size starts at 1")
    out = T.StructType([
        *df.schema.fields, T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()

        def attempt(part: pd.DataFrame) -> list[tuple]:
            try:
                answers = [(str(text), float(score), None) for text, score in predict(part)]
                if len(answers) != len(part):
                    raise ValueError(f"{len(answers)} answers for {len(part)} rows")
                return answers
            except Exception as problem:  # noqa: BLE001 - any model failure becomes row data
                if len(part) == 1:
                    return [("", 0.0, str(problem))]
                return [a for i in range(len(part)) for a in attempt(part.iloc[i:i + 1])]

        for frame in frames:
            answers = [a for i in range(0, len(frame), batch_size) for a in attempt(frame.iloc[i:i + batch_size])]
            yield frame.assign(**{
                name: [a[k] for a in answers] for k, name in enumerate(("text", "confidence", "error"))})

    return df.mapInPandas(run, out)
