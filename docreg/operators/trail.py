"""Reading the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.functions import values as V


def audit_diff_rows(audit: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """One row per key of the old and new maps: before, after, changed, actor.

    The actor is the stored snapshot, else the account's name, else 'System'.
    """
    name: Column = F.col("actor_name")
    joined = audit
    if users is not None:
        people = users.select(F.col("id").alias("user_id"), F.col("name").alias("_user"))
        joined = audit.join(people, "user_id", "left")
        name = F.coalesce("actor_name", "_user")
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("old_values", empty), F.coalesce("new_values", empty)
    keyed = joined.select(
        "id", "action", "created_at", F.coalesce(name, F.lit("System")).alias("actor"),
        old.alias("_old"), new.alias("_new"),
        F.explode(F.array_union(F.map_keys(old), F.map_keys(new))).alias("key"))
    before, after = F.try_element_at("_old", F.col("key")), F.try_element_at("_new", F.col("key"))
    return keyed.select(
        "id", "action", "created_at", "actor", "key", before.alias("before"), after.alias("after"),
        (~before.eqNullSafe(after)).alias("changed"))


def redacted_entries(audit: DataFrame) -> DataFrame:
    """The trail with secret values masked in both maps."""
    return audit.withColumns({c: V.redact(F.col(c)) for c in ("old_values", "new_values")})
