"""OCR model registry against the inventory on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.functions import values as V
from docreg.operators.quality import has_evaluation

BASE = "base"
EVALUATION_COLUMNS = (
    "cer", "wer", "exact_match", "evaluation_dataset", "evaluation_split", "evaluation_sample_count",
    "evaluation_manifest_sha256", "evaluation_weights_sha256", "evaluated_at",
)


def active_models(models: DataFrame) -> DataFrame:
    return models.where(F.col("is_active") & F.col("disk_deleted_at").isNull())


def active_key(models: DataFrame) -> Column:
    """Key of the active model (lowest id), as a scalar subquery; NULL when there is none."""
    return active_models(models).agg(F.min_by("key", "id")).scalar()


def selectable_models(remote: DataFrame, models: DataFrame, allow: bool | Column) -> DataFrame:
    """What staff may pick from: nothing unless allowed, the active model first."""
    allowed = allow if isinstance(allow, Column) else F.lit(allow)
    return remote.where(allowed).select(
        "key", F.coalesce("label", "key").alias("label"),
        F.coalesce(F.col("key") == active_key(models), F.lit(False)).alias("is_active"),
    ).orderBy(F.col("is_active").desc(), "key")


def resolve_model(requested: DataFrame, selectable: DataFrame, models: DataFrame) -> DataFrame:
    """The requested key where it may be used, the active model otherwise."""
    offered = selectable.select(F.col("key").alias("requested_key")).distinct().withColumn("_ok", F.lit(True))
    return requested.join(offered, "requested_key", "left").select(
        *requested.columns,
        F.when(F.col("_ok"), F.col("requested_key")).otherwise(active_key(models)).alias("model_key"))


def missing_on_disk(models: DataFrame, remote: DataFrame) -> DataFrame:
    """Registry keys the inventory does not list."""
    return models.select("key").join(remote.select("key"), "key", "left_anti")


def _sides(models: DataFrame, remote: DataFrame) -> DataFrame:
    m = models.withColumn("_local", F.lit(True)).alias("m")
    r = remote.withColumn("_remote", F.lit(True)).alias("r")
    return m.join(r, F.col("m.key") == F.col("r.key"), "full_outer")


def model_overview(models: DataFrame, remote: DataFrame) -> DataFrame:
    """Registry and inventory side by side, tombstoned rows hidden, active first."""
    key = F.coalesce("m.key", "r.key")
    return (
        _sides(models, remote).where(F.col("m.disk_deleted_at").isNull())
        .select(
            key.alias("key"), F.coalesce("m.label", "r.label", key).alias("label"), (key == BASE).alias("is_base"),
            F.coalesce("r._remote", F.lit(False)).alias("on_disk"), F.coalesce("r.loaded", F.lit(False)).alias("loaded"),
            F.coalesce("m.is_active", F.lit(False)).alias("is_active"),
            F.coalesce("m._local", F.lit(False)).alias("registered"),
        )
        .orderBy(F.col("is_active").desc(), F.col("on_disk").desc(), "key")
    )


def reconcile_models(models: DataFrame, remote: DataFrame) -> DataFrame:
    """Per key: registered, restored, tombstoned or unchanged, with the state that follows.

    The base model is never tombstoned; an invalid tombstone on it is cleared.
    """
    local, on_disk = F.col("m._local"), F.col("r._remote")
    buried = F.col("m.disk_deleted_at").isNotNull()
    key = F.coalesce("m.key", "r.key")
    action = (
        F.when(local.isNull(), "registered")
        .when(on_disk & buried, "restored")
        .when(on_disk.isNull() & (key == BASE) & buried, "restored")
        .when(on_disk.isNull() & (key != BASE) & ~buried, "tombstoned")
        .otherwise("unchanged")
    )
    label = F.when(local.isNull() | (on_disk & buried), F.coalesce("r.label", "m.label", key)).otherwise(F.col("m.label"))
    return _sides(models, remote).select(
        key.alias("key"), action.alias("action"), label.alias("label"),
        F.coalesce(F.col("m.is_active") & (action != "tombstoned"), F.lit(False)).alias("is_active"),
        ((action == "tombstoned") | ((action == "unchanged") & buried)).alias("is_tombstoned"),
        on_disk.isNotNull().alias("on_disk"),
    )


def reconcile_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.agg(
        F.count_if("on_disk").alias("remote"),
        *[F.count_if(F.col("action") == a).alias(a) for a in ("registered", "restored", "tombstoned")])


def sync_evaluations(models: DataFrame, remote: DataFrame) -> DataFrame:
    """Copy complete test-set reports, clear the rest; ``event`` says what moved.

    ``remote.evaluation`` is a struct; models the inventory does not list stay as they are.
    """
    e = "r.evaluation"
    complete = F.col(f"{e}.split") == "test"
    for c in ("cer", "wer", "exact_match", "dataset", "manifest_sha256", "weights_sha256", "evaluated_at"):
        complete = complete & F.col(f"{e}.{c}").isNotNull()
    complete = F.coalesce(complete & (F.col(f"{e}.sample_count") > 0), F.lit(False))
    listed = F.col("r._remote").isNotNull()
    r = remote.select("key", "evaluation").withColumn("_remote", F.lit(True)).alias("r")
    m = models.alias("m")
    joined = m.join(r, F.col("m.key") == F.col("r.key"), "left").withColumn("_complete", complete)
    ok = F.col("_complete")
    new = {c: F.when(listed, F.when(ok, F.col(f"{e}.{c.removeprefix('evaluation_')}"))).otherwise(F.col(f"m.{c}"))
           for c in EVALUATION_COLUMNS}
    moved = F.lit(False)
    for c in EVALUATION_COLUMNS:
        moved = moved | ~new[c].eqNullSafe(F.col(f"m.{c}"))
    event = F.when(moved, F.when(ok, "evaluation_imported").otherwise("evaluation_cleared"))
    return joined.select(
        *[new[c].alias(c) if c in new else F.col(f"m.{c}").alias(c) for c in models.columns], event.alias("event"))


def inventory_union(models: DataFrame, inventory: DataFrame) -> DataFrame:
    """Inventory rows, then registry-only models; the first of a key wins, blank keys are skipped.

    inventory: key, label, is_active, ord. Output adds ``place``, the listing order.
    """
    live = models.where(F.col("disk_deleted_at").isNull())
    key = V.trim_ws(F.col("key"))
    first = (
        inventory.where(V.is_filled(F.col("key"))).groupBy(key.alias("key"))
        .agg(F.min_by(F.struct("label", "is_active"), "ord").alias("_i"), F.min("ord").alias("_ord"))
    )
    i, m = first.alias("i"), live.alias("m")
    joined = i.join(m, F.col("i.key") == F.col("m.key"), "full_outer")
    name = F.coalesce("i.key", "m.key")
    active = F.coalesce(F.col("i._i.is_active"), F.col("m.is_active"), F.lit(False))
    label = F.when(F.col("i.key").isNotNull(), F.coalesce("i._i.label", "m.label")).otherwise(F.col("m.label"))
    return joined.select(
        name.alias("key"), F.coalesce(F.nullif(label, F.lit("")), name).alias("label"), active.alias("is_active"),
        *[F.col(f"m.{c}").alias(c) for c in EVALUATION_COLUMNS],
        F.struct(F.col("i.key").isNull(), F.col("i._ord"), ~F.coalesce("m.is_active", F.lit(False)), name).alias("place"))


def model_profiles(models: DataFrame, inventory: DataFrame) -> DataFrame:
    """Scores of every listed model; ``selected`` marks the active, else first evaluated, else first."""
    listed = inventory_union(models, inventory).withColumn("has_data", has_evaluation())
    ok, nothing = F.col("has_data"), F.lit(None).cast("double")
    rank = F.struct(~F.col("is_active"), F.when(F.col("is_active"), False).otherwise(~ok), "place")
    chosen = listed.agg(F.min_by("key", rank)).scalar()
    return listed.select(
        "key", "label", "is_active", "has_data",
        F.when(ok, "Locked test set").otherwise(V.NO_BENCHMARK).alias("source_label"),
        F.when(ok, V.evidence(F.col("evaluation_dataset"), F.col("evaluation_sample_count"), F.col("evaluated_at")))
        .otherwise(V.NO_BENCHMARK_EVIDENCE).alias("evidence"),
        F.when(ok, F.col("evaluation_sample_count")).otherwise(0).cast("long").alias("field_count"),
        F.when(ok, V.percentage(1 - F.col("cer"))).otherwise(nothing).alias("character_accuracy"),
        F.when(ok, V.percentage(1 - F.col("wer"))).otherwise(nothing).alias("word_accuracy"),
        F.when(ok, V.percentage(F.col("exact_match"))).otherwise(nothing).alias("exact_match"),
        (F.col("key") == chosen).alias("selected"), "place",
    ).orderBy("place").drop("place")
