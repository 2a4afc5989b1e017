import hashlib
import json
import random
from datetime import datetime, timedelta

from docreg import schemas
from docreg.session import cut_lineage
from docreg.sources import files as FS
from docreg.sources import registry as R
from docreg.streaming.audit import audit_sink
from docreg.streaming.throttle import throttle_breaches, throttle_stream


def test_manifest_keeps_strings_blanks_and_order(spark, tmp_path):
    path = tmp_path / "manifest.csv"
    path.write_bytes('﻿filename,label,split\na.png,None,train\nb.png,,test\nc.png,"say ""hi"", then\nbye",test\n007.png,1.50,val\n'.encode())
    got = FS.read_manifest(spark, str(path)).orderBy("ord").collect()
    assert [(r.filename, r.label, r.split, r.source) for r in got] == [
        ("a.png", "None", "train", None), ("b.png", "", "test", None), ("c.png", 'say "hi", then\nbye', "test", None), ("007.png", "1.50", "val", None)]


def test_image_listing_does_not_read_contents(spark, tmp_path):
    for name in ("train/a.PNG", "train/b.txt", "test/c.tif"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    images = FS.list_images(spark, str(tmp_path))
    assert sorted((r.split, r.filename, r.length) for r in images.collect()) == [("test", "c.tif", 5), ("train", "a.PNG", 5)]
    assert "content" not in images._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_digests_of_files_larger_than_a_row(spark, tmp_path, monkeypatch):
    noise = random.Random(3).randbytes
    data = {"noise [1].bin": noise(90_000), "ended.bin": noise(40_000) + b"\n", "blank.bin": b"\n" * 9_000, "mark.bin": b"\xef\xbb\xbf" + noise(30_000) + b"\n\n",
            "dos.txt": b"a\r\n\r" * 4_000, "one-line.bin": b"\0" * 20_000, "small.bin": b"x\n"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    want = {name: (len(content), hashlib.sha256(content).hexdigest()) for name, content in data.items()}
    monkeypatch.setattr(FS, "LARGE_FILE", 5_000, raising=False)
    # The row limit, 2 GB by default, and splits small enough that every file has several.
    limits = {"spark.sql.sources.binaryFile.maxLength": "5000", "spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        digests = FS.file_digest(spark, str(tmp_path))
        assert {r.filename: (r.length, r.sha256) for r in digests.collect()} == want
        known = digests.where("filename not in ('noise [1].bin', 'small.bin')")
        again = FS.refresh_digests(spark, str(tmp_path), known)
        assert {r.filename: (r.length, r.sha256) for r in again.collect()} == want
    finally:
        for key in limits:
            spark.conf.unset(key)


def test_registry_tables_are_typed(spark, rows, tmp_path):
    for name in schemas.TABLES:
        rows("id int, name string", (1, "x")).write.parquet(str(tmp_path / name))
    tables = R.read_registry(spark, str(tmp_path))
    assert {n: t.schema.names for n, t in tables.items()} == {n: s.names for n, s in schemas.TABLES.items()}
    assert tables["record_fields"].schema["ocr_confidence"].dataType.typeName() == "double"


def test_field_lists(rows):
    good = json.dumps([{"name": "a", "x": 0.5, "verified": True}, {"name": "b"}])
    df = rows("id int, fields_json string", (1, good), (2, '{"name": "a"}'), (3, "[{"), (4, None), (5, "[]"))
    fields, rejected = R.explode_fields_json(df)
    assert sorted((r.id, r.sort_order, r.name, r.x) for r in fields.collect()) == [(1, 0, "a", 0.5), (1, 1, "b", None)]
    assert sorted(r.id for r in rejected.collect()) == [2, 3, 4]


def test_exports(spark, rows, tmp_path):
    report = rows("a int, b string, c string, d string, e string, f string, g string, h string, i string, j string, k int, l double",
                  (1, None, "Birth", "Draft", 'He said "x", ok', None, None, None, None, None, 0, None))
    R.export_report_csv(report, str(tmp_path / "report"))
    back = spark.read.csv(str(tmp_path / "report"), header=True, escape='"')
    assert tuple(back.columns) == R.REPORT_HEADER and back.first()["Primary value"] == 'He said "x", ok'
    preds = rows("filename string, text string, confidence double, error string", ("a", "Ana", 91.25, None), ("b", "", 0.0, "broken"))
    R.write_predictions_csv(preds, str(tmp_path / "preds"))
    got = sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "preds"), header=True).collect())
    assert got == [("a", "Ana", "91.3", ), ("b", "ERROR: broken", None)] or got == [("a", "Ana", "91.2"), ("b", "ERROR: broken", None)]


AUDIT = "id long, action string, old_values map<string,string>, new_values map<string,string>, user_agent string"


def test_audit_sink_batch_and_stream(spark, rows, tmp_path):
    log = rows(AUDIT, (1, "x", None, {"password": "p", "n": "1"}, "u" * 2000))
    target, source = str(tmp_path / "trail"), str(tmp_path / "in")
    R.append_audit(log, target)
    R.append_audit(log, target)
    got = spark.read.parquet(target).collect()
    assert len(got) == 2 and json.loads(got[0].new_values) == {"password": "[redacted]", "n": "1"} and len(got[0].user_agent) == 2000
    log.write.parquet(source)
    stream = spark.readStream.schema(log.schema).parquet(source)
    query = audit_sink(stream, str(tmp_path / "trail2"), str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert json.loads(spark.read.parquet(str(tmp_path / "trail2")).first().new_values)["password"] == "[redacted]"


ATTEMPTS = "email string, ip string, ts timestamp, succeeded boolean, id long"


def attempts(rows, *seconds, start=0, email="A@x"):
    t0 = datetime(2026, 1, 1)
    return [(email, "1", t0 + timedelta(seconds=abs(s)), s < 0, start + i) for i, s in enumerate(seconds)]


def refused(df):
    return [r.id for r in df.where("refused").orderBy("id").collect()]


def test_throttle_rules(rows):
    df = rows(ATTEMPTS,
              *attempts(rows, 0, 1, 2, 3, 4, 5, -59, 60, 61),            # sixth and the early success refused; expiry at 60
              *attempts(rows, 0, 1, 2, 3, -4, 5, 6, 7, 8, 9, 10, start=100, email="b@x"),  # success clears
              *attempts(rows, 0, 1, 2, 3, 50, 59, 61, start=200, email="a@X2"))
    assert refused(throttle_breaches(df)) == [5, 6, 110, 205]


def brute(data, limit, decay):
    state, out = {}, []
    for email, ip, ts, ok, i in sorted(data, key=lambda d: (d[2], d[4])):
        key, t = (email.lower(), ip), ts.timestamp()
        hits = [h for h in state.get(key, [])]
        if hits and t >= hits[0] + decay:
            hits = []
        if len(hits) >= limit:
            out.append(i)
        else:
            hits = [] if ok else hits + [t]
        state[key] = hits
    return sorted(out)


def test_throttle_batch_equals_stream_and_brute_force_with_a_hot_key(spark, rows, tmp_path):
    import random

    random.seed(5)
    data = []
    for n in range(900):
        email = "hot@x" if random.random() < .34 else f"u{random.randint(0, 30)}@x"
        when = datetime(2026, 1, 1) + timedelta(seconds=random.randint(0, 40_000))
        data.append((email, "1", when, random.random() < .2, n))
    df = rows(ATTEMPTS, *data)
    want = brute(data, 3, 600.0)
    assert want and refused(throttle_breaches(df, 3, 600.0)) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = throttle_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 3, 600.0)
    query = (stream.writeStream.format("memory").queryName("throttled").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    try:
        assert query.awaitTermination(90)
    finally:
        query.stop()
    assert refused(spark.table("throttled")) == want


def test_lineage_is_cut_with_a_reliable_checkpoint(spark, rows):
    cut = cut_lineage(rows("a int", (1,), (2,)))
    assert sorted(r.a for r in cut.collect()) == [1, 2]
    assert spark.sparkContext.getCheckpointDir()


