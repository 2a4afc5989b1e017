"""Temporal list join against a scan of the log per capture, plus the defined cases."""

import random
from datetime import datetime, timedelta

from docreg.llm import url_filter as U

DAY = datetime(2024, 1, 1)
CAPTURE, ENTRY = "capture_id bigint, url string, fetched_at timestamp", "entry_id bigint, host string, at timestamp, action string"


def brute(captures, entries):
    out = []
    for cid, url, at in captures:
        host = (url or "").partition("://")[2].split("/")[0].split("@")[-1].split(":")[0].lower().rstrip(".") or None
        best = (False, None, None)
        if host and at:
            labels = host.split(".")
            for i in range(max(len(labels) - 1, 1)):
                name = ".".join(labels[i:])
                log = [(t, e, a) for e, h, t, a in entries if h and t and a in ("add", "remove") and h.lower() == name and t <= at]
                if log and max(log)[2] == "add":
                    best = (True, name, max(log)[1])
                    break
        out.append((cid, host, *best))
    return sorted(out, key=str)


def judged(spark, captures, entries):
    got = U.judge_captures(spark.createDataFrame(captures, CAPTURE).selectExpr("*", "1 as host", "2 as at"),
                           spark.createDataFrame(entries, ENTRY).selectExpr("*", "'x' as url"))
    return sorted([(r.capture_id, r.host, r.blocked, r.matched, r.entry_id) for r in got.collect()], key=str)


def test_every_capture_sees_the_entries_of_its_time(spark):
    rng = random.Random(8)
    hosts = ["a.org", "b.a.org", "c.b.a.org", "d.net", "e"]
    when = lambda: DAY + timedelta(hours=rng.randint(0, 90))
    entries = [(i, rng.choice(hosts), when(), rng.choice(["add", "remove"])) for i in range(60)]
    captures = [(i, f"https://{rng.choice(hosts)}/p{i}", when()) for i in range(120)]
    got = judged(spark, captures, entries)
    assert got == brute(captures, entries)
    assert {m for _, h, b, m, _ in got if b and m != h}  # parent domains occur


def test_defined_cases(spark):
    entries = [(1, "A.org", DAY, "add"), (2, "a.org", DAY, "remove"), (3, "a.org", DAY, "add"), (4, None, DAY, "add"),
               (5, "b.org", None, "add"), (6, "c.org", DAY, None), (7, "d.org", DAY + timedelta(days=400), "add")]
    captures = [(1, "http://u@A.ORG.:80/x", DAY), (2, "http://a.org", None), (3, None, DAY), (4, "no url", DAY), (5, "http://b.org", DAY),
                (6, "http://c.org", DAY), (7, "http://d.org", DAY + timedelta(days=399)), (8, "http://x.a.org/" + "y" * 100_000, DAY),
                (1, "http://u@A.ORG.:80/x", DAY)]
    got = judged(spark, captures, entries)
    assert [g for g in got if g[2]] == [(1, "a.org", True, "a.org", 3), (1, "a.org", True, "a.org", 3), (8, "x.a.org", True, "a.org", 3)]
    assert len(got) == len(captures)


def test_empty_tables(spark):
    captures = [(1, "http://a.org", DAY)]
    assert judged(spark, captures, []) == [(1, "a.org", False, None, None)]
    assert judged(spark, [], [(1, "a.org", DAY, "add")]) == []
