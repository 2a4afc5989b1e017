import json
import math

import pytest
from pyspark.sql import functions as F

from docreg.operators import datasets as DS
from docreg.operators import evaluation as E
from docreg.operators import history as H
from docreg.operators import models as M
from docreg.operators import quality


def test_corpus_rates_are_ratios_of_sums(rows):
    p = rows("reference string, hypothesis string", ("kitten", "sitting"), ("the cat sat on mat", "the cat sit mat"), ("", ""))
    m = E.corpus_metrics(p).first()
    assert (m.char_errors, m.chars, m.word_errors, m.words, m.exact, m.total) == (7, 24, 3, 6, 1, 3)
    assert (m.cer, m.wer, m.accuracy) == (7 / 24, 0.5, 1 / 3)
    assert tuple(E.corpus_metrics(p.where("false")).first())[:5] == (0.0, 0.0, 0.0, 0, 0)
    assert tuple(E.corpus_metrics(p, spread=3).first()) == tuple(m)


def test_sequence_confidence_with_a_hot_sequence(rows):
    ninf = float("-inf")
    data = [(1, 0, "a", -0.1), (1, 1, "eos", ninf), (1, 2, "b", -0.3), (1, 3, "eos", -0.2), (1, 4, "c", -9.0),
            (2, 0, "a", ninf), (3, 0, "a", None), (3, 1, "b", -1.0)]
    data += [(9, i, "eos" if i == 9000 else "t", -0.001 * (i % 7)) for i in range(10_000)]
    got = {r.seq_id: (r.tokens, r.confidence) for r in E.sequence_confidence(rows("seq_id int, pos int, token string, log_prob double", *data), "eos").collect()}
    hot = [-0.001 * (i % 7) for i in range(9001)]
    assert got == {1: (3, round(math.exp(-0.2) * 100, 1)), 2: (0, 0.0), 3: (1, round(math.exp(-1) * 100, 1)),
                   9: (9001, round(math.exp(sum(hot) / 9001) * 100, 1))}


def test_prediction_summary_and_comparison(rows):
    p = rows("confidence double, error string", (90.0, None), (70.5, None), (0.0, "bad"))
    assert tuple(E.prediction_summary(p, 80.0).first()) == (3, 80.2, 1)
    assert tuple(E.prediction_summary(p.where("false"), 80.0).first()) == (0, 0.0, 0)
    a = rows("cer double, wer double, accuracy double", (0.2, 0.1, 0.5))
    b = rows("cer double, wer double, accuracy double", (0.1, 0.1, 0.4))
    assert {r.metric: r.verdict for r in E.compare_models(a, b).collect()} == {"CER": "better", "WER": "same", "Accuracy": "worse"}


MANIFEST = "filename string, label string, split string, ord long"


def test_manifest_validation(rows):
    m = rows(MANIFEST, ("a.png", "None", "train", 0), ("b.png", "", " Test ", 1), ("c.png", "unreadable", "test", 2),
             ("d.png", "Ana", "dev", 3), ("e.png", "x", "", 4), ("", "x", "val", 5), ("f.png", "x", "train", 6))
    i = rows("split string, filename string, length long", ("train", "a.png", 1), ("test", "b.png", 2), ("test", "c.PNG", 3), ("val", "z.txt", 9))
    v = DS.validate_dataset(m, i).first()
    assert (v.manifest_rows, v.rows_train, v.rows_val, v.rows_test) == (7, 2, 1, 2)
    assert (v.usable_train, v.usable_val, v.usable_test, v.empty_labels, v.unreadable_labels) == (2, 1, 0, 1, 1)
    assert (v.unknown_splits, v.missing_image_count, v.missing_images) == (["(blank)", "dev"], 3, ["test/c.png", "train/f.png"])
    assert (v.orphan_image_count, v.orphan_images, v.ok, len(v.errors), len(v.warnings)) == (1, ["test/c.PNG"], False, 1, 3)
    empty = DS.validate_dataset(m.where("false"), i).first()
    assert (empty.ok, empty.errors, empty.warnings) == (False, ["Manifest has no rows."], [])
    s = {r.split: (r.images, r.bytes, r.usable) for r in DS.dataset_summary(m, i).collect()}
    assert s == {"train": (1, 1, 2), "val": (0, 0, 1), "test": (2, 5, 0)}
    assert tuple(DS.dataset_totals(m, i).first()) == (3, 15, 7)


def test_split_scope_last_row_wins_and_falls_back(rows):
    m = rows(MANIFEST, ("a.png", "old", "test", 0), ("a.png", "new", "test", 1), ("b.png", "b", "train", 2), ("c.png", "ok", "test", 3), ("c.png", " ", "test", 4))
    i = rows("split string, filename string, length long", ("test", "a.png", 1), ("test", "b.png", 1), ("test", "c.png", 1), ("val", "b.png", 1))
    assert [tuple(r) for r in DS.split_scope(m, i, "test").collect()] == [("a.png", "new")]
    assert [tuple(r) for r in DS.split_scope(m, i, "val").collect()] == [("b.png", "b")]
    only = m.where("split = 'train'").withColumn("split", F.lit("val"))
    assert DS.split_scope(only, i.where("split = 'test'"), "val").count() == 0
    with pytest.raises(ValueError):
        DS.split_scope(m, i, "dev")
    preds = rows("filename string, text string, confidence double, error string", ("a.png", " new ", 1.0, None), ("b.png", "b", 1.0, None))
    metrics, listed = E.evaluate_predictions(m, i, preds, "test")
    assert tuple(metrics.first()) == (0.0, 0.0, 1.0, 1, 1) and listed.count() == 1


def test_batch_predict_isolates_failures(spark):
    def load():
        def predict(batch):
            if (batch["id"] % 5 == 3).any():
                raise ValueError("bad row")
            return [(f"t{i}", float(i)) for i in batch["id"]]

        return predict

    got = {r.id: (r.text, r.confidence, r.error) for r in E.batch_predict(spark.range(20), load, 4).collect()}
    assert len(got) == 20
    assert all(got[i] == (("", 0.0, "bad row") if i % 5 == 3 else (f"t{i}", float(i), None)) for i in range(20))


# ------------------------------------------------------------------- history
HISTORY = "run_id int, epoch int, train_loss double, val_loss double, seconds double"


def test_history(rows):
    h = rows(HISTORY, *[(1, e, 9.0 - e, v, 10.0) for e, v in enumerate([.5, .4, .4, .6, .7, .3], 1)],
             *[(2, e, v, None, 5.0) for e, v in enumerate([.5, .6, .2], 1)])
    assert {r.run_id: (r.best_epoch, r.best_loss) for r in H.best_epoch(h).collect()} == {1: (6, .3), 2: (3, .2)}
    assert sorted((r.run_id, r.epoch) for r in H.checkpoints(h).collect()) == [(1, 1), (1, 2), (1, 6), (2, 1), (2, 3)]
    assert {r.run_id: r.stop_epoch for r in H.early_stop(h, 3).collect()} == {1: 5, 2: None}
    assert {(r.run_id, r.epoch): r.eta_seconds for r in H.eta(h, 10).collect()}[(1, 2)] == 80.0


# -------------------------------------------------------------------- models
MODEL = ("id long, key string, label string, is_active boolean, cer double, wer double, exact_match double, evaluation_dataset string, "
         "evaluation_split string, evaluation_sample_count long, evaluation_manifest_sha256 string, evaluation_weights_sha256 string, "
         "evaluated_at timestamp, disk_deleted_at timestamp")


@pytest.fixture(scope="module")
def registry(rows):
    from datetime import datetime

    t = datetime(2026, 8, 2)
    return rows(MODEL, (1, "base", "Base", False, None, None, None, None, None, None, None, None, None, t),
                (2, "a", "Alpha", True, .1234, .25, .876, "civil", "test", 5000, "m", "w", t, None),
                (3, "b", "Beta", False, .1, .1, .9, None, "test", 1, "m", "w", t, None),
                (4, "c", "Gamma", False, None, None, None, None, None, None, None, None, None, t))


REMOTE = ("key string, label string, loaded boolean, evaluation struct<cer:double,wer:double,exact_match:double,dataset:string,split:string,"
          "sample_count:long,manifest_sha256:string,weights_sha256:string,evaluated_at:timestamp>")


def test_profiles(rows, registry):
    inv = rows("key string, label string, is_active boolean, ord int", ("b", "Bee", False, 0), (" ", "blank", False, 1), ("b", "later", True, 2), ("new", None, None, 3))
    got = M.model_profiles(registry, inv).collect()
    assert [(r.key, r.label, r.has_data, r.selected) for r in got] == [
        ("b", "Bee", False, False), ("new", "new", False, False), ("a", "Alpha", True, True)]
    a = got[2]
    assert (a.character_accuracy, a.word_accuracy, a.exact_match) == (87.7, 75.0, 87.6)
    assert a.evidence == "civil · test · 5,000 samples · evaluated Aug 2, 2026"
    assert got[0].source_label == "No benchmark" and got[0].character_accuracy is None


def test_reconcile(rows, registry):
    from datetime import datetime

    report = (.2, .3, .5, "civil", "test", 10, "m", "w", datetime(2026, 9, 1))
    remote = rows(REMOTE, ("c", "Disk C", True, report), ("new", None, False, None), ("a", None, False, None))
    plan = M.reconcile_models(registry, remote)
    assert {r.key: (r.action, r.label, r.is_active, r.is_tombstoned) for r in plan.collect()} == {
        "base": ("restored", "Base", False, False), "a": ("unchanged", "Alpha", True, False), "b": ("tombstoned", "Beta", False, True),
        "c": ("restored", "Disk C", False, False), "new": ("registered", "new", False, False)}
    assert tuple(M.reconcile_counts(plan).first()) == (3, 1, 2, 1)
    assert sorted(r.key for r in M.missing_on_disk(registry, remote).collect()) == ["b", "base"]
    synced = {r.key: (r.cer, r.event) for r in M.sync_evaluations(registry, remote).collect()}
    assert synced == {"base": (None, None), "a": (None, "evaluation_cleared"), "b": (.1, None), "c": (.2, "evaluation_imported")}
    seen = M.model_overview(registry, remote).collect()
    assert [(r.key, r.on_disk, r.registered) for r in seen] == [("a", True, True), ("new", True, False), ("b", False, True)]
    pick = M.selectable_models(remote, registry, True)
    assert pick.first().key == "a" and M.selectable_models(remote, registry, False).count() == 0
    asked = rows("id int, requested_key string", (1, "c"), (2, "zzz"), (3, None))
    assert {r.id: r.model_key for r in M.resolve_model(asked, pick, registry).collect()} == {1: "c", 2: "a", 3: "a"}


def test_report_checks(spark, rows, tmp_path):
    import hashlib

    from docreg.sources import files as FS

    def put(folder, weights=b"w", **change):
        d = tmp_path / folder
        d.mkdir()
        (d / "model.safetensors").write_bytes(weights)
        (d / "config.json").write_text("{}")
        report = {"schema_version": 1, "model_key": folder, "dataset": "civil", "manifest_sha256": "A" * 64, "split": "test",
                  "sample_count": 5, "metrics": {"cer": 0.1, "wer": 0.2, "exact_match": 0.9}, "evaluated_at": "2026-08-02T10:00:00Z",
                  "weights_file": "x/model.safetensors", "weights_sha256": hashlib.sha256(b"w").hexdigest(), **change}
        (d / "evaluation-report.json").write_text(json.dumps(report, indent=2))

    put("good")
    put("other", weights=b"v")
    put("old", schema_version=2)
    put("naive", evaluated_at="2026-08-02T10:00:00")
    put("high", metrics={"cer": 0.1, "wer": 0.2, "exact_match": 1.5})
    put("cut")
    (tmp_path / "cut" / "evaluation-report.json").write_text("{")
    put("big", model_key="x" * (1024 * 1024))
    (tmp_path / "base").mkdir()
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "config.json").write_text("{}")
    root = str(tmp_path)
    reports = FS.read_evaluation_reports(spark, root, max_bytes=FS.MAX_REPORT_BYTES)
    whole = {r.model_folder: r for r in FS.read_evaluation_reports(spark, root).collect()}
    assert whole["big"].read_error is None and len(whole["big"].model_key) == 1024 * 1024
    digests = FS.file_digest(spark, root, "model.safetensors")
    got = {r.model_folder: r for r in quality.validate_reports(reports, digests).collect()}
    errors = {k: r.error for k, r in got.items()}
    assert errors["good"] is None and got["good"].manifest_sha256 == "a" * 64 and got["good"].weights_file == "model.safetensors"
    assert "does not match" in errors["other"] and "schema_version" in errors["old"] and "timezone" in errors["naive"]
    assert "between 0 and 1" in errors["high"] and errors["cut"] and "1 MB" in errors["big"]
    listed = FS.list_files(spark, root)
    assert sorted(r.key for r in FS.model_inventory(listed).collect()) == ["big", "cut", "good", "high", "naive", "old", "other"]
    assert FS.storage_usage(listed).first().file_count == 7 * 3 + 1
    first = FS.file_digest(spark, root, "model.safetensors")
    assert FS.refresh_digests(spark, root, first, "model.safetensors").count() == 7
    stale = first.withColumn("modificationTime", F.col("modificationTime") - F.expr("interval 1 hour")).withColumn("sha256", F.lit("old"))
    again = FS.refresh_digests(spark, root, stale, "model.safetensors").collect()
    assert len(again) == 7 and all(len(r.sha256) == 64 for r in again)
    table = E.build_evaluation_report(rows("cer double, wer double, accuracy double, total long", (.1, .2, .9, 5)), model_key="m", dataset="d",
                                      manifest_sha256="0", weights_file="w", weights_sha256="1", evaluated_at="t")
    assert json.loads(table.first().value)["metrics"] == {"cer": .1, "wer": .2, "exact_match": .9}
