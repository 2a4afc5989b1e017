"""Bucketed ranks and running values against pandas, with one key holding a third of the rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docreg.functions import prefix
from docreg.functions.prefix import crowded, ranked, running


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 60, n))
    return pd.DataFrame({"k": key, "t": rng.permutation(n), "v": rng.integers(-50, 50, n).astype(float),
                         "label": np.where(rng.random(n) < 0.4, None, rng.integers(0, 9, n).astype(str))})


def test_ranked_equals_row_number(spark, skewed):
    got = ranked(spark.createDataFrame(skewed), ["k"], [F.col("t")], F.floor(F.col("t") / 100), "rank").toPandas()
    want = skewed.sort_values("t").assign(rank=lambda d: d.groupby("k").cumcount() + 1)
    pd.testing.assert_frame_equal(got.sort_values("t")[["t", "rank"]].reset_index(drop=True),
                                  want[["t", "rank"]].reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values(spark, skewed, inclusive):
    got = running(spark.createDataFrame(skewed), ["k"], [F.col("t")], F.floor(F.col("t") / 100),
                  {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "seen": ("last", "label")}, inclusive)
    got = got.toPandas().sort_values("t").reset_index(drop=True)
    frame = skewed.sort_values("t")
    by = frame.groupby("k")
    want = pd.DataFrame({"s": by["v"].cumsum(), "lo": by["v"].cummin(), "hi": by["v"].cummax(), "seen": by["label"].ffill()})
    if not inclusive:
        want = want.groupby(frame["k"]).shift(1)
    for c in ("s", "lo", "hi"):
        np.testing.assert_allclose(got[c].to_numpy(dtype=float), want[c].to_numpy(dtype=float))
    assert [x if isinstance(x, str) else None for x in got["seen"]] == [x if isinstance(x, str) else None for x in want["seen"]]


def test_null_keys_form_their_own_group(rows):
    df = rows("k int, t int", (None, 1), (None, 2), (1, 3))
    got = ranked(df, ["k"], [F.col("t")], F.floor(F.col("t") / 2), "rank").collect()
    assert sorted((r.t, r.rank) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_crowded_finds_hot_keys_only(spark, skewed, monkeypatch):
    monkeypatch.setattr(prefix, "_CROWD", 200)
    df = spark.createDataFrame(skewed)
    hot = {r.k for r in df.where(crowded(df, "k")).select("k").distinct().collect()}
    assert hot == {0}
    assert df.where(~crowded(df, "k")).count() == (skewed["k"] != 0).sum()
    got = ranked(df.where(~crowded(df, "k")), ["k"], [F.col("t")], None, "rank").toPandas().sort_values("t")
    want = skewed[skewed["k"] != 0].sort_values("t").groupby("k").cumcount() + 1
    assert got["rank"].tolist() == want.tolist()
