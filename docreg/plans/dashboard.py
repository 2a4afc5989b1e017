"""The oversight dashboard."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreg.operators import analytics as A
from docreg.operators.scope import REPORTING_TZ, Scope, last_twelve_months
from docreg.sources.derived import Registry


@dataclass(frozen=True)
class Oversight:
    scope: Scope
    headline: DataFrame
    trend: DataFrame
    trend_totals: DataFrame
    growth: DataFrame
    by_document_type: DataFrame
    ocr_quality: DataFrame
    throughput: DataFrame
    accounts: DataFrame


def oversight(registry: Registry, now: datetime, threshold: float = 80.0, tz: str = REPORTING_TZ) -> Oversight:
    """Every panel, lazily; each is its own query and can be run on its own."""
    r, scope = registry, last_twelve_months(now, tz)
    totals = A.trend_totals(r.records, scope)
    return Oversight(
        scope=scope,
        headline=A.headline(r.records, scope),
        trend=A.record_trend(r.records, r.document_types, scope),
        trend_totals=totals,
        growth=A.growth_rate(totals),
        by_document_type=A.records_by_type(r.records, r.document_types, scope),
        ocr_quality=A.ocr_quality(r.record_fields, r.records, scope, threshold),
        throughput=A.throughput(r.records, r.users, scope),
        accounts=A.account_health(r.users),
    )


def quality_by_type(registry: Registry, scope: Scope, threshold: float = 80.0) -> DataFrame:
    """Flagship: share of each document type next to its OCR quality."""
    r = registry
    quality = A.ocr_quality(r.record_fields, r.records, scope, threshold, by=["document_type_id"])
    shares = A.records_by_type(r.records, r.document_types, scope)
    return shares.join(quality, "document_type_id", "left").select(
        "document_type_id", "key", "name", "total", "share",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
          for c in ("confidence_fields", "below_threshold", "comparable_fields", "corrected_fields")],
        "average_confidence", "threshold_pass_rate", "correction_rate",
    )
