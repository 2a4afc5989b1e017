"""Ranks and running values that survive a hot key.

A plain window sends one key to one task. Here each key is first cut into buckets
that follow the order, the window runs inside (key, bucket), and only one small
summary row per bucket is combined along the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"


# Slots in which the keys of a table are counted, and the rows from which one is crowded in any table.
_SLOTS, _CROWD = 65_536, 100_000


def crowded(source: DataFrame, key: str) -> Column:
    """Whether the column ``key`` may hold one of the hot keys of ``source``.

    Keys are counted by the slot of their hash, at most 65,536 small rows a task, and the few slots far above the
    mean become a scalar. A key that merely shares such a slot takes the bucketed way too, with the same result.
    """
    slot = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(_SLOTS)).cast("int")
    seen = source.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_n")).agg(
        F.collect_list(F.struct("_slot", "_n")).alias("_all"), F.sum("_n").alias("_total"))
    limit = _CROWD + 4 * F.col("_total") / _SLOTS
    hot = seen.select(F.transform(F.filter("_all", lambda s: s["_n"] > limit), lambda s: s["_slot"])).scalar()
    return F.coalesce(F.array_contains(hot, slot), F.lit(False))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | None,
           name: str = "rank") -> DataFrame:
    """``row_number`` per key (1-based).

    ``bucket`` must not decrease along ``order`` and should bound the rows that
    share one value (a day of a timestamp, a thousand of a counter). Without one
    a plain window does, for rows that ``crowded`` left out.
    """
    one = df.withColumn("__one", F.lit(1).cast("long"))
    return running(one, keys, order, bucket, {name: ("sum", "__one")}).drop("__one")


_COMBINE: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | None,
            values: dict[str, tuple[str, str]], inclusive: bool = True) -> DataFrame:
    """Running sum / min / max / last-non-null per key.

    ``values`` maps an output name to (function, input column); ``order`` is ascending.
    With ``inclusive=False`` the current row is left out of its own value.
    """
    keys = list(keys)
    if bucket is None:
        plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return df.select(*df.columns, *[
            _COMBINE[fn](F.col(source)).over(plain).alias(name) for name, (fn, source) in values.items()])
    work = df.withColumn(_BUCKET, bucket)
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    local = work
    for name, (fn, source) in values.items():
        local = local.withColumn(f"__in_{name}", _COMBINE[fn](F.col(source)).over(frame))

    def summary(fn: str, source: str) -> Column:
        if fn == "last":
            present = F.col(source).isNotNull()
            return F.max_by(F.col(source), F.when(present, F.struct(*order)))
        return _COMBINE[fn](F.col(source))

    totals = work.groupBy(*keys, _BUCKET).agg(*[
        summary(fn, source).alias(f"__all_{name}") for name, (fn, source) in values.items()
    ])
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, _BUCKET, *[
        _COMBINE[fn](F.col(f"__all_{name}")).over(before).alias(f"__pre_{name}")
        for name, (fn, _) in values.items()
    ])

    left, right = local.alias("l"), offsets.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, _BUCKET]]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    joined = left.join(right, condition, "left")

    def combined(name: str, fn: str) -> Column:
        inner, outer = F.col(f"l.__in_{name}"), F.col(f"r.__pre_{name}")
        if fn == "sum":
            return F.when(inner.isNull() & outer.isNull(), None).otherwise(
                F.coalesce(inner, F.lit(0)) + F.coalesce(outer, F.lit(0)))
        if fn == "last":
            return F.coalesce(inner, outer)
        return F.least(inner, outer) if fn == "min" else F.greatest(inner, outer)

    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[combined(name, fn).alias(name) for name, (fn, _) in values.items()],
    )
