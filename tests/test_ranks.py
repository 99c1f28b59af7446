import numpy as np
import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F

from strandloom.functions import ranks as rk
from strandloom.functions.joins import salted_join
from strandloom.operators import inference as nf


@pytest.fixture(autouse=True, params=[0, 10**6], ids=["buckets", "small"])
def size_limit(request, monkeypatch):
    """Run every test through the bucketed and the plain path."""
    monkeypatch.setattr(rk, "SMALL_ROWS", request.param)


@pytest.fixture
def skewed(spark):
    """One group holds most rows; many ties."""
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(3000), "g": np.where(rng.random(3000) < 0.7, "hot", rng.integers(0, 20, 3000).astype(str)), "v": np.round(rng.normal(size=3000), 1)})
    return spark.createDataFrame(pdf), pdf


def test_average_rank(skewed):
    df, pdf = skewed
    got = {r["id"]: r["rank"] for r in rk.average_rank(df, ["g"], "v").collect()}
    want = pdf.groupby("g")["v"].rank()
    assert all(got[i] == want[i] for i in pdf["id"])


def test_positions_are_a_permutation(skewed):
    df, pdf = skewed
    got = rk.positions(df, ["g"], ["id"], seed=4).toPandas()
    for g, part in got.groupby("g"):
        assert sorted(part["pos"]) == list(range(len(part))) and (part["n"] == len(part)).all()
    again = rk.positions(df.repartition(5), ["g"], ["id"], seed=4)
    assert rows(again, "id", "pos") == sorted(map(tuple, got[["id", "pos"]].to_numpy().tolist()))


def test_ordered_positions(skewed):
    df, pdf = skewed
    got = {r["id"]: r["pos"] for r in rk.ordered_positions(df, ["g"], ["id"]).collect()}
    want = pdf.groupby("g").cumcount()
    assert all(got[i] == want[i] for i in pdf["id"])


def test_bh(spark):
    p = np.random.default_rng(1).random(500).round(2)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(500), "p": p}))
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * 500 / np.arange(1, 501))[::-1])[::-1]
    want = np.empty(500)
    want[order] = np.minimum(q, 1)
    # equal p-values share the value at the last of them
    want = pd.Series(want).groupby(p).transform("min").to_numpy()
    got = {r["id"]: r["qval"] for r in rk.bh_fdr(df, "p").collect()}
    assert np.allclose([got[i] for i in range(500)], want)


def test_quantiles(skewed):
    df, pdf = skewed
    got = rk.exact_quantiles(df, "v", [0, 0.1, 0.5, 0.77, 1]).first()
    assert np.allclose(list(got), np.quantile(pdf["v"], [0, 0.1, 0.5, 0.77, 1]))
    edges = [r["edge"] for r in nf.quantile_edges(df, "v", 37).orderBy("i").collect()]
    assert np.allclose(edges, np.quantile(pdf["v"], np.arange(38) / 37))
    bins = {r["id"]: r["bin"] for r in nf.qcut(df, "v", 12).collect()}
    want = pd.qcut(pdf["v"], 12, labels=False, duplicates="drop")
    assert [bins[i] for i in pdf["id"]] == want.tolist()


def test_empirical_quantile(spark):
    rng = np.random.default_rng(2)
    bg, fg = rng.random(400).round(2), rng.random(50).round(2)
    b = spark.createDataFrame(pd.DataFrame({"v": bg}))
    f = spark.createDataFrame(pd.DataFrame({"i": np.arange(50), "v": fg}))
    for side in ("left", "right"):
        got = {r["i"]: r["quantile"] for r in nf.empirical_quantile(f, b, "v", side).collect()}
        assert np.allclose([got[i] for i in range(50)], np.searchsorted(np.sort(bg), fg, side) / 400)


def test_salted_join_keeps_every_pair(spark):
    left = spark.range(500).select(F.col("id").alias("i"), F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 5).alias("k"))
    right = spark.range(60).select(F.col("id").alias("j"), (F.col("id") % 6).alias("k"))
    assert rows(salted_join(left, right, ["k"], ["i"], hot_rows=30), "i", "j") == rows(left.join(right, "k"), "i", "j")
