"""URL filters as a temporal list join.

A list is a log of dated entries: at a time a host suffix is added to or removed from it. A
capture (url, fetch time) is judged by the entries in force when it was fetched: entries become
validity intervals, and an as-of join takes, for every host suffix of the capture, the last
entry at or before the fetch time. The capture is blocked if any suffix is listed then.

The as-of join is a running last value over captures and entries together, cut into days, so
that a host with a third of all captures or entries is not one task.

Defined cases: a null or unreadable url has no host and is never blocked; a null fetch time
sees no entry; entries without host, action or time are ignored; of several entries of one
host at one time the one with the largest entry id holds; an entry counts at its own time;
repeated captures are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreg.functions.prefix import running

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without trailing dot; null if there is none."""
    host = F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def suffixes_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more, longest first."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))),
                       lambda i: F.array_join(F.slice(labels, i, size), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(host, listed, entry_id, valid_from, valid_to) of entries (entry_id, host, action, at); open ends are null."""
    known = _clean(entries)
    ordered = Window.partitionBy("host", F.to_date("at")).orderBy("at")
    # The next entry of the same day, else the first of the host's next day with entries.
    days = known.groupBy("host", F.to_date("at").alias("day")).agg(F.min("at").alias("opens"))
    days = days.withColumn("next_day", F.lead("opens").over(Window.partitionBy("host").orderBy("day")))
    joined = known.withColumn("next_at", F.lead("at").over(ordered)).withColumn("day", F.to_date("at")).join(days, ["host", "day"])
    return joined.select("host", "listed", "entry_id", F.col("at").alias("valid_from"),
                         F.coalesce("next_at", "next_day").alias("valid_to"))


def _clean(entries: DataFrame) -> DataFrame:
    """One entry per host and time."""
    rows = entries.where("host is not null and at is not null and action in ('add', 'remove')")
    return rows.groupBy(F.lower("host").alias("host"), "at").agg(F.max(F.struct("entry_id", (F.col("action") == "add").alias("listed"))).alias("e")).select(
        "host", "at", "e.entry_id", "e.listed")


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(capture_id, url, fetched_at, host, blocked, matched, entry_id) of captures (capture_id, url, fetched_at).

    ``matched`` is the longest listed suffix at fetch time and ``entry_id`` the entry that listed it.
    """
    rows = captures.select("capture_id", "url", "fetched_at", host_of(F.col("url")).alias("host"))
    # Equal captures are judged once, by their host and time.
    asked = rows.where("host is not null and fetched_at is not null").select("host", "fetched_at").distinct().select(
        F.col("host").alias("asker"), F.col("fetched_at").alias("at"), F.explode(suffixes_of(F.col("host"))).alias("host"))
    state = intervals(entries).select("host", F.col("valid_from").alias("at"), F.struct("listed", "entry_id").alias("state"))
    log = state.withColumn("asker", F.lit(None).cast("string")).unionByName(
        asked.withColumn("state", F.lit(None).cast("struct<listed:boolean,entry_id:bigint>")))
    order = [F.col("at"), F.col("asker").isNotNull(), F.col("asker")]
    seen = running(log, ["host"], order, F.to_date("at"), {"active": ("last", "state")})
    hits = seen.where("asker is not null and active.listed").groupBy("asker", F.col("at").alias("seen_at")).agg(
        F.max(F.struct(F.length("host").alias("size"), "host", F.col("active.entry_id").alias("entry_id"))).alias("m"))
    return rows.join(hits, (F.col("host") == F.col("asker")) & (F.col("fetched_at") == F.col("seen_at")), "left").select(
        "capture_id", "url", "fetched_at", "host", F.col("m").isNotNull().alias("blocked"),
        F.col("m.host").alias("matched"), F.col("m.entry_id").alias("entry_id"))
