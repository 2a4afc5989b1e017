"""Pages, queues and top-k. Every order ends in the id, so a page is stable."""

from __future__ import annotations

from dataclasses import dataclass

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    #: One row: total, has_more.
    info: DataFrame


def paginate(df: DataFrame, order: list[Column], page: int = 1, per_page: int = 25) -> Page:
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    rows = df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    info = df.agg(F.count("*").alias("total")).withColumn("has_more", F.col("total") > page * per_page)
    return Page(rows, info)


def seek(df: DataFrame, order: Sequence[tuple[str, bool]], after: Mapping[str, object] | None, per_page: int = 25) -> DataFrame:
    """The page behind a row, by the values of its order columns instead of an offset.

    ``order`` lists (column, ascending); nulls come first ascending and last descending. It must
    end in a unique column. ``after`` holds the last row's values, None asks for the first page.
    Cost does not depend on how far the page is: a filter that reaches the scan and a top-k.
    """
    if per_page < 1:
        raise ValueError("per_page starts at 1")
    if after is not None:
        behind, same = F.lit(False), F.lit(True)
        for name, ascending in order:
            value, column = after[name], F.col(name)
            if ascending:
                later = column.isNotNull() if value is None else column > F.lit(value)
            else:
                later = F.lit(False) if value is None else (column < F.lit(value)) | column.isNull()
            behind = behind | (same & later)
            same = same & column.eqNullSafe(F.lit(value))
        df = df.where(behind)
    return top_k(df, [F.col(n).asc_nulls_first() if ascending else F.col(n).desc_nulls_last() for n, ascending in order], per_page)


def own_recent_activity(audit_logs: DataFrame, user_id: int, k: int = 6) -> DataFrame:
    """The latest trail rows of one user."""
    return top_k(audit_logs.where(F.col("user_id") == user_id), newest_first(), k)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def queue_order() -> list[Column]:
    """Pending first, then the newest."""
    return [(F.col("status") == "pending").desc(), F.col("created_at").desc(), F.col("id").desc()]


def newest_first(column: str = "created_at") -> list[Column]:
    return [F.col(column).desc_nulls_last(), F.col("id").desc()]


def type_order() -> list[Column]:
    return [F.col("is_system").desc(), F.col("id")]


def template_order() -> list[Column]:
    return [F.col("document_type_id"), F.col("is_active").desc(), F.col("id")]


def model_order() -> list[Column]:
    return [F.col("is_active").desc(), F.col("key")]


def sample_array(df: DataFrame, value: Column, order: list[Column], k: int) -> Column:
    """The first k values as an array, as a scalar subquery: only k rows are ever collected."""
    first = df.orderBy(*order).limit(k).select(F.struct(*order).alias("_o"), value.alias("_v"))
    return F.coalesce(
        first.agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda s: s["_v"])).scalar(),
        F.array().cast("array<string>"),
    )
