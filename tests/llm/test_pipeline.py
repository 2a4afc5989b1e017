"""The pipeline's stages on a small table: each stage's decision takes effect on what its predecessor kept."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    copy, item = prose(60), prose(30)
    texts = {i: prose(60) for i in range(40)}
    texts |= {40: copy, 41: copy, 42: copy + " more", 43: "too short", 44: prose(40) + " " + item + " " + prose(20),
              45: prose(30) + " write to anna.b@example.org now " + prose(20), 46: None, 47: "same five words again now " * 30}
    root = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in texts.items()],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_decisions_of_the_stages_take_effect(spark, folder):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(range(41)) <= set(rows)  # clean documents and one of the copies
    assert not {41, 42, 43, 44, 46, 47} & set(rows)
    assert 45 in rows and all(r.n_tokens > 0 for r in rows.values())


def test_personal_data_does_not_reach_the_tokens(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 45")
    cleaned = corpus_pipeline.personal_data(spark, docs, folder).first()
    assert "example.org" not in cleaned.text and cleaned.lang == "en"


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert sorted(out.columns) == sorted(docs.columns) and out.count() == 0, name
