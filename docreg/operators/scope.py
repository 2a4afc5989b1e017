"""Date bounds and reporting scopes. Scalars only; ``now`` and ``tz`` are arguments."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

REPORTING_TZ = "Asia/Manila"


def instant(moment: datetime) -> Column:
    """UTC literal that does not depend on the session or driver time zone."""
    utc = moment.astimezone(ZoneInfo("UTC"))
    return F.lit(utc.strftime("%Y-%m-%d %H:%M:%S.%f") + "+00:00").cast("timestamp")


def local_midnight(day: date | str, tz: str) -> datetime:
    if isinstance(day, str):
        day = date.fromisoformat(day)
    return datetime.combine(day, time(), ZoneInfo(tz))


def date_bounds(column: Column, date_from: date | str | None, date_to: date | str | None, tz: str) -> list[Column]:
    """Conjuncts for an inclusive local-day range; a missing end gives no conjunct."""
    if date_from is not None and date_to is not None and str(date_to) < str(date_from):
        raise ValueError("the end date lies before the start date")
    bounds = []
    if date_from is not None:
        bounds.append(column >= instant(local_midnight(date_from, tz)))
    if date_to is not None:
        bounds.append(column < instant(local_midnight(date_to, tz) + timedelta(days=1)))
    return bounds


@dataclass(frozen=True)
class Scope:
    """Inclusive range of local days in the reporting time zone."""

    first: date
    last: date
    tz: str = REPORTING_TZ

    def contains(self, column: Column) -> Column:
        low, high = date_bounds(column, self.first, self.last, self.tz)
        return low & high

    @property
    def daily(self) -> bool:
        """Short ranges are charted per day (90 whole days or fewer), others per month."""
        return (self.last - self.first).days + 1 <= 90

    @property
    def unit(self) -> str:
        return "day" if self.daily else "month"


def last_twelve_months(now: datetime, tz: str = REPORTING_TZ) -> Scope:
    """The current local month up to ``now``'s day, and the eleven before it."""
    today = now.astimezone(ZoneInfo(tz)).date()
    months = today.year * 12 + today.month - 1 - 11
    return Scope(date(months // 12, months % 12 + 1, 1), today, tz)


def month_start(now: datetime, tz: str = REPORTING_TZ) -> Column:
    today = now.astimezone(ZoneInfo(tz)).date()
    return instant(local_midnight(today.replace(day=1), tz))
