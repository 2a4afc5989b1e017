"""Training histories: (run_id, epoch, train_loss, val_loss, seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreg.functions.prefix import running

_PIECE = 1024


def best_epoch(history: DataFrame) -> DataFrame:
    """First epoch with the lowest selection loss: validation, or training where a run has none."""
    def lowest(c: str) -> F.Column:
        return F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("loss"), "epoch")))

    return history.groupBy("run_id").agg(
        F.coalesce(lowest("val_loss"), lowest("train_loss")).alias("_b"), F.count("*").alias("epochs")
    ).select("run_id", F.col("_b.epoch").alias("best_epoch"), F.col("_b.loss").alias("best_loss"), "epochs")


def _improvements(history: DataFrame) -> DataFrame:
    """Adds _nth (1-based) and, per loss, whether the epoch beats every earlier one.

    Both losses are followed side by side; which of them counts is a property of the
    whole run and is settled when the run is summed up, so no row waits for a join.
    """
    numbered = history.withColumn("_one", F.lit(1).cast("long"))
    before = running(
        numbered, ["run_id"], [F.col("epoch")], F.floor(F.col("epoch") / _PIECE),
        {"_best_val": ("min", "val_loss"), "_best_train": ("min", "train_loss"), "_prior": ("sum", "_one")}, inclusive=False)

    def better(loss: str, best: str) -> F.Column:
        value, low = F.col(loss), F.col(best)
        return F.coalesce(value.isNotNull() & (low.isNull() | (value < low)), F.lit(False))

    return before.select(
        *history.columns, (F.coalesce("_prior", F.lit(0)) + 1).alias("_nth"),
        better("val_loss", "_best_val").alias("_val_better"), better("train_loss", "_best_train").alias("_train_better"))


def checkpoints(history: DataFrame) -> DataFrame:
    """Epochs at which a checkpoint is written: each strict improvement of the selection loss."""
    kinds = history.groupBy("run_id").agg((F.count("val_loss") > 0).alias("_validated"))
    moved = _improvements(history).where("_val_better or _train_better").join(kinds, "run_id", "inner")
    return moved.where(F.when(F.col("_validated"), F.col("_val_better")).otherwise(F.col("_train_better"))).select(
        "run_id", "epoch", F.when(F.col("_validated"), F.col("val_loss")).otherwise(F.col("train_loss")).alias("selection_loss"))


def early_stop(history: DataFrame, patience: int) -> DataFrame:
    """Epoch at which the streak without improvement reaches ``patience``; NULL if it never does."""
    marked = _improvements(history).withColumns({
        "_val_hit": F.when(F.col("_val_better"), F.col("_nth")), "_train_hit": F.when(F.col("_train_better"), F.col("_nth"))})
    streaks = running(
        marked, ["run_id"], [F.col("epoch")], F.floor(F.col("epoch") / _PIECE),
        {"_val_last": ("max", "_val_hit"), "_train_last": ("max", "_train_hit")})

    def stop(last: str) -> F.Column:
        streak = F.col("_nth") - F.coalesce(last, F.lit(0))
        return F.min(F.when(streak >= patience, F.col("epoch")))

    return streaks.groupBy("run_id").agg(
        F.when(F.count("val_loss") > 0, stop("_val_last")).otherwise(stop("_train_last")).alias("stop_epoch"),
        F.count("*").alias("epochs"))


def eta(history: DataFrame, total_epochs: int) -> DataFrame:
    """Estimated seconds left after each epoch: mean epoch time so far times epochs to go."""
    elapsed = running(history, ["run_id"], [F.col("epoch")], F.floor(F.col("epoch") / _PIECE), {"elapsed": ("sum", "seconds")})
    return elapsed.select(
        "run_id", "epoch", "elapsed",
        (F.col("elapsed") / F.col("epoch") * (total_epochs - F.col("epoch"))).alias("eta_seconds"))
