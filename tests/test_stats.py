import numpy as np
import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_embed import cells_of, long_of

from strandloom.operators import aggregate as ag
from strandloom.operators import cohort as co
from strandloom.operators import cis_sampling as cs
from strandloom.operators import inference as nf
from strandloom.operators import labels as lb
from strandloom.operators import matrix as mt
from strandloom.operators import metrics as me
from strandloom.operators import regression as rg
from strandloom.operators import runs as rn
from strandloom.operators import skeleton as sk
from strandloom.sources import sinks


def test_self_correlation_is_one(spark):
    x = np.random.default_rng(0).integers(0, 4, size=(50, 6)).astype(float)
    m, c = long_of(spark, x), cells_of(spark, x).select("cell")
    for fn in (mt.col_pcc, mt.col_spr):
        assert all(abs(v - 1) < 1e-9 for _, v in rows(fn(m, m, c)))


def test_spearman_with_negative_values(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(-3, 4, size=(60, 3)).astype(float), rng.integers(-2, 3, size=(60, 3)).astype(float)
    got = dict(rows(mt.col_spr(long_of(spark, x), long_of(spark, y), cells_of(spark, x).select("cell"))))
    for j in range(3):
        want = np.corrcoef(pd.Series(x[:, j]).rank(), pd.Series(y[:, j]).rank())[0, 1]
        assert abs(got[f"f{j:03d}"] - want) < 1e-9


def test_skeleton_corr_leaves_nan_out(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, size=(40, 4)).astype(float)
    m = long_of(spark, x)
    nan = spark.createDataFrame([("c0003", "f000"), ("c0007", "f001"), ("c0009", "f000")], "cell string, feature string").withColumn("value", F.lit(float("nan")))
    m = m.join(nan, ["cell", "feature"], "left_anti").unionByName(nan)
    x[3, 0] = x[7, 1] = x[9, 0] = np.nan
    edges = spark.createDataFrame([("f000", "f001"), ("f002", "f001"), ("f003", "f003")], "source string, target string")
    for method in ("pcc", "spr"):
        r = pd.DataFrame(x).rank().to_numpy() if method == "spr" else x
        got = {(s, t): c for s, t, c in rows(sk.skeleton_corr([m], edges, cells_of(spark, np.zeros((40, 1))).select("cell"), method))}
        for s, t in ((0, 1), (2, 1), (3, 3)):
            mean = np.nanmean(r, axis=0)
            std = np.sqrt(np.nanmean(r**2, axis=0) - mean**2)
            want = (np.nanmean(r[:, s] * r[:, t]) - mean[s] * mean[t]) / (std[s] * std[t])
            assert abs(got[f"f{s:03d}", f"f{t:03d}"] - want) < 1e-9


def test_overlapping_features_are_an_error(spark):
    m = long_of(spark, np.ones((4, 2)))
    with pytest.raises(ValueError):
        mt.concat_features(m, m)
    with pytest.raises(ValueError):
        sk.skeleton_corr([m, m], spark.createDataFrame([("f000", "f001")], "source string, target string"), m.select("cell").distinct())


def test_coordinate_descent_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    x, alpha = rng.normal(size=(80, 6)), 0.1
    x[:, 5] = x[:, 4]
    y = x @ np.array([1, 0, -2, 0, 0, 0.5]) + rng.normal(size=80) * 0.1
    w = rg.descend(x.T @ x / 80, x.T @ y / 80, alpha, 0.0, np.zeros(6), 10_000, 1e-10)
    g = x.T @ (y - x @ w) / 80
    assert np.all(np.abs(g) <= alpha + 1e-8) and np.allclose(g[w != 0], alpha * np.sign(w[w != 0]))
    with pytest.raises(ArithmeticError):
        rg.descend(x.T @ x / 80, x.T @ y / 80, alpha, 0.0, np.zeros(6), 1, 1e-14)


@pytest.mark.parametrize("model", ["Lasso", "ElasticNet", "Ridge", "LinearRegression"])
def test_regression_of_hub_and_small_targets(spark, model):
    """Blocks of two predecessors: several rounds of the active set, K in parts; more predecessors than metacells."""
    rng = np.random.default_rng(11)
    x = np.round(rng.random((24, 40)) * 50)
    x[:, 39] = np.round(x[:, 0] * 0.5 + x[:, 1] + 2 * x[:, 2] + rng.random(24) * 5)
    m, c = long_of(spark, x), cells_of(spark, x).select("cell")
    edges = [(f"f{i:03d}", "f039") for i in range(39)] + [("f999", "f039"), ("f001", "f000"), ("f002", "f000"), ("f003", "f998")]
    df = spark.createDataFrame(edges, "source string, target string")
    got = {(s, t): r for s, t, r in rows(sk.skeleton_regr([m], df, c, model, alpha=0.02, block=2), "source", "target", "regr")}
    assert set(got) == set(edges)
    z = np.log1p(x * np.median(x.sum(axis=1)) / x.sum(axis=1, keepdims=True))
    z = np.column_stack([z - z.mean(axis=0), np.zeros(24)])
    at = lambda f: min(int(f[1:]), 40)
    for target in ("f039", "f000", "f998"):
        names = [s for s, t in edges if t == target]
        a, y, w = z[:, [at(s) for s in names]], z[:, at(target)], np.array([got[s, target] for s in names])
        if model == "LinearRegression":
            assert np.allclose(w, np.linalg.pinv(a) @ y, atol=1e-6)
        elif model == "Ridge":
            assert np.allclose(w, np.linalg.solve(a.T @ a + 0.02 * np.eye(len(names)), a.T @ y))
        else:
            l1, l2 = (0.02, 0.0) if model == "Lasso" else (0.01, 0.01)
            g = a.T @ (y - a @ w) / 24 - l2 * w
            assert np.all(np.abs(g) <= l1 + 1e-7) and np.allclose(g[w != 0], l1 * np.sign(w[w != 0]), atol=1e-7)
            assert target != "f039" or 2 < (w != 0).sum() < 24


def test_feature_r2_of_several_layers(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random((60, 3)), rng.random((60, 3))
    y = 2 * a - b + rng.normal(size=(60, 3)) * 0.2
    got = dict(rows(sk.feature_r2(long_of(spark, y), {"a": long_of(spark, a), "b": long_of(spark, b)}, cells_of(spark, a).select("cell"))))
    for j in range(3):
        d = np.column_stack([np.ones(60), a[:, j], b[:, j]])
        r = y[:, j] - d @ np.linalg.lstsq(d, y[:, j], rcond=None)[0]
        assert abs(got[f"f{j:03d}"] - (1 - r.var() / y[:, j].var())) < 1e-9


def test_label_transfer_onto_itself(spark):
    x = np.random.default_rng(5).normal(size=(40, 3))
    c = cells_of(spark, x, ct=[f"t{i % 4}" for i in range(40)])
    assert rows(lb.transfer_labels(c, c, "ct", n_neighbors=1), "cell", "ct") == rows(c, "cell", "ct")


def test_rank_sum_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.poisson(1.0, size=(60, 5)).astype(float)
    c = cells_of(spark, x, g=[f"g{i % 3}" for i in range(60)])
    got = {(g, n): s for g, n, s in rows(lb.rank_features_groups(long_of(spark, x), c, "g"), "group", "names", "scores")}
    r = pd.DataFrame(x).rank().to_numpy()
    for k in range(3):
        mask = np.arange(60) % 3 == k
        for j in range(5):
            want = (r[mask, j].sum() - 20 * 61 / 2) / np.sqrt(20 * 40 * 61 / 12)
            assert abs(got[f"g{k}", f"f{j:03d}"] - want) < 1e-9


def test_balancing_weight_errors_and_mean(spark):
    x = np.random.default_rng(7).normal(size=(40, 3))
    c = cells_of(spark, x, k=[f"k{i % 4}" for i in range(40)], b=["0"] * 20 + ["1"] * 20)
    for out in lb.balancing_weight(c, c, c, cluster="k", cutoff=0.0):
        assert abs(out.agg(F.avg("balancing")).first()[0] - 1) < 1e-9
    with pytest.raises(ValueError):
        lb.balancing_weight(c, c.where("b = '0'"), cluster="k", use_batch="b")


def test_counts_go_to_partitions_not_to_blocks(spark, monkeypatch):
    """Many blocks of pairs and samples, as many copies of the counts as the session has cores; wide counts and places without any."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    numbers, place = [], Classic.repartitionById
    monkeypatch.setattr(Classic, "repartitionById", lambda df, n, c: numbers.append(n) or place(df, n, c))
    monkeypatch.setattr(cs, "TABLE_CELLS", 40)
    g2r = spark.createDataFrame([(f"g{i}", f"r{i * j % 50}") for i in range(30) for j in range(5)], "source string, target string")
    r2t = spark.createDataFrame([(f"r{i}", f"t{i % 3}") for i in range(0, 50, 2)] + [("r0", "t0")] * 300, "source string, target string")
    regions = spark.createDataFrame([(f"r{i}",) for i in range(50)], "region string")
    small = rows(nf.cis_regulatory_enrichment(g2r, r2t, regions, 20, seed=3), "gene", "tf", "observed", "enrich")
    assert numbers == [spark.sparkContext.defaultParallelism]
    monkeypatch.setattr(cs, "TABLE_CELLS", 10**6)
    assert small == rows(nf.cis_regulatory_enrichment(g2r, r2t, regions, 20, seed=3), "gene", "tf", "observed", "enrich") and len(small) > 30


def test_closed_forms_do_not_square_the_metacells(spark, monkeypatch):
    """Few predecessors, and a hub in pairs of blocks, over more metacells than a Gram matrix takes at once."""
    rng = np.random.default_rng(13)
    x = np.round(rng.random((60, 9)) * 50)
    m, c = long_of(spark, x), cells_of(spark, x).select("cell")
    edges = [(f"f{i:03d}", "f008") for i in range(7)] + [("f001", "f000"), (None, "f000")]
    z = np.log1p(x * np.median(x.sum(axis=1)) / x.sum(axis=1, keepdims=True))
    z -= z.mean(axis=0)
    e = z[:, [1]], z[:, :7]
    monkeypatch.setattr(rg, "CELLS_AT_ONCE", 7)
    p, i = rg._gram(pd.Series([np.array([2, 0, 9]), None]), pd.Series([np.array([1.0, 2, 5]), None]), 20), np.array([2.0, 0, 1, 0, 0, 0, 0, 0, 0, 5] + [0] * 10)
    assert np.allclose(p, [[((i - i.mean()) ** 2).sum(), 0], [0, 0]])
    for model, penalty in (("LinearRegression", 0.0), ("Ridge", 0.5)):
        out = sk.skeleton_regr([m], spark.createDataFrame(edges, "source string, target string"), c, model, alpha=0.5, block=2)
        assert "kernel(" not in out._jdf.queryExecution().toString()  # no products over pairs of metacells
        got = {(s, t): r for s, t, r in map(tuple, out.select("source", "target", "regr").collect())}
        assert set(got) == set(edges) and got[None, "f000"] == 0.0
        for target, a in zip(("f000", "f008"), e):
            w = [r for (s, t), r in sorted((k, v) for k, v in got.items() if k[0]) if t == target]
            assert np.allclose(w, np.linalg.solve(a.T @ a + penalty * np.eye(a.shape[1]), a.T @ z[:, int(target[1:])]))


def test_regulatory_inference(spark):
    rng = np.random.default_rng(8)
    e = spark.createDataFrame(pd.DataFrame({"node": [f"n{i}" for i in range(30)], "rep": rng.normal(size=(30, 4)).tolist()}))
    sk_ = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + 1) % 30}") for i in range(30)], "source string, target string")
    both = nf.regulatory_inference([e, e], sk_, seed=2)
    got = rows(both, "source", "target", "score", "pval", "qval")
    assert len(got) == 30 and all(0 <= p <= q <= 1 for *_, p, q in got)
    assert got == rows(nf.regulatory_inference([e.repartition(3), e], sk_.repartition(2), seed=2), "source", "target", "score", "pval", "qval")
    perm = nf.permute_rows(e, e.select("node"), 5)
    assert sorted(map(tuple, perm.toPandas()["rep"])) == sorted(map(tuple, e.toPandas()["rep"]))
    with pytest.raises(ValueError):
        nf.regulatory_inference([e], sk_, alternative="x")
    with pytest.raises(ValueError):
        nf.regulatory_inference([e, e.limit(3)], sk_)


def test_cis_ranking(spark):
    g2r = spark.createDataFrame([("g1", "r1"), ("g1", "r2"), ("g2", "r3")], "source string, target string")
    r2t = spark.createDataFrame([("r1", "t1"), ("r2", "t1"), ("r3", "t2")], "source string, target string")
    genes = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "gene string")
    tfs = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "tf string")
    regions = spark.createDataFrame([(f"r{i}", 100 + i % 2) for i in range(1, 9)], "region string, length long")
    want = [("g1", "t1", 1.0), ("g1", "t2", 2.5), ("g1", "t3", 2.0), ("g2", "t1", 2.5), ("g2", "t2", 1.0), ("g2", "t3", 2.0),
            ("g3", "t1", 2.5), ("g3", "t2", 2.5), ("g3", "t3", 2.0)]
    for n in (0, 40):
        assert rows(nf.cis_regulatory_ranking(g2r, r2t, genes, regions, tfs, n_samples=n)) == want
    e = nf.cis_regulatory_enrichment(g2r, r2t, regions, n_samples=40, seed=1)
    assert e.where("enrich < 0 OR enrich > 40").count() == 0


@pytest.mark.parametrize("cells", [16_000_000, 500])
def test_cis_samples_in_blocks(spark, monkeypatch, cells):
    """Against sampling by hand; small limits cut slices, draws and ranges of samples."""
    import hashlib

    monkeypatch.setattr(cs, "TABLE_CELLS", cells)
    if cells == 500:
        for name, value in (("TASK_DRAWS", 300), ("TERMS_AT_ONCE", 90)):
            monkeypatch.setattr(cs, name, value)
    rng, n = np.random.default_rng(4), 60
    g2r = [(f"g{a}", f"r{b}") for a, b in zip(rng.integers(0, 9, 120), rng.integers(0, 40, 120))] + [("g0", f"r{b}") for b in range(40)]
    r2t = [(f"r{a}", f"t{b}") for a, b in zip(rng.integers(0, 40, 150), rng.integers(0, 6, 150))]
    lens = {f"r{i}": i % 3 for i in range(45)}
    frame = lambda x, c: spark.createDataFrame(x, c)
    got = nf.cis_regulatory_enrichment(frame(g2r, "source string, target string"), frame(r2t, "source string, target string"), frame(list(lens.items()), "region string, length long"), n, seed=7)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    bins = {b: sorted((r for r in lens if lens[r] == b), key=lambda r: (int(md5(f"7|{r}")[:15], 16), r)) for b in range(3)}
    tfs = {}
    for r, t in r2t:
        tfs.setdefault(r, []).append(t)
    above, observed = {}, {}
    for g, r in g2r:
        for t in tfs.get(r, []):
            observed[g, t] = observed.get((g, t), 0) + 1
    for k in range(n):
        paths = {}
        for g, r in g2r:
            s = [int(md5(f"8|{g}|{r}")[8 * i:8 * i + 8], 16) % cs.P for i in range(4)]
            u = (s[0] + s[1] * k + s[2] * k * k + s[3] * k ** 3) % cs.P
            for t in tfs.get(bins[lens[r]][u * len(bins[lens[r]]) // cs.P], []):
                paths[g, t] = paths.get((g, t), 0) + 1
        for pair, o in observed.items():
            above[pair] = above.get(pair, 0) + (paths.get(pair, 0) > o)
    assert rows(got, "gene", "tf", "observed", "enrich") == sorted((g, t, float(o), float(n - above[g, t])) for (g, t), o in observed.items())


def test_fisher(spark):
    assert abs(nf._fisher_two_sided(3, 1, 1, 3) - 0.48571428571) < 1e-9
    assert abs(nf._fisher_two_sided(8, 2, 1, 5) - 0.03496503496) < 1e-9


def test_curves(spark):
    rng = np.random.default_rng(9)
    y, s = rng.integers(0, 2, 200), rng.random(200).round(1)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(nf.auroc(df, "y", "s").first()[0] - want) < 1e-12
    assert nf.roc(df, "y", "s", max_points=4).count() <= 6


def test_metacells(spark):
    x = np.random.default_rng(10).normal(size=(60, 2))
    c = cells_of(spark, x)
    m = long_of(spark, np.ones((60, 3)))
    out = ag.metacells((m, c), (m, c), use_rep="rep", n_meta=5)
    assert rows(out[0][0]) == rows(out[1][0])
    assert out[0][0].agg(F.sum("value")).first()[0] == 180
    with pytest.raises(ValueError):
        ag.metacells((m, c), use_rep="rep", n_meta=5, agg_kws=[{}, {}])
    with pytest.raises(ValueError):
        sk.metacell_regr((m.withColumn("value", F.lit(0.5)), c), use_rep="rep", n_meta=3, skeleton=None)


def test_pairing(spark):
    a = spark.createDataFrame([(f"s{i}",) for i in range(5)] + [(f"a{i}",) for i in range(4)], "cell string")
    b = spark.createDataFrame([(f"s{i}",) for i in range(5)] + [(f"b{i}",) for i in range(9)], "cell string")
    for fill in (False, True):
        v = co.paired_view(a, b, random_fill=fill).collect()
        assert len(v) == 18 and sum(r["has_0"] and r["has_1"] for r in v) == 5
        assert all(r["src_0"] == r["cell"] for r in v if r["has_0"]) and all(r["src_1"][0] in "sb" for r in v)
    with pytest.raises(ValueError):
        co.paired_view(a.unionByName(a), b)


def test_splits(spark):
    df = spark.range(101)
    with pytest.raises(ValueError):
        co.random_split(df, [0.5, 0.4], ["id"])
    with pytest.raises(ValueError):
        co.random_split(df, [1.2, -0.2], ["id"])
    assert rows(co.random_split(df, [0.25, 0.75], ["id"]).groupBy("split").count()) == [(0, 25), (1, 76)]
    with pytest.raises(ValueError):
        co.subsample([df], size=3, frac=0.1)


def test_dataset_view_errors(spark):
    c = cells_of(spark, np.zeros((3, 2)))
    m = long_of(spark, np.ones((3, 2)))
    f = m.select("feature").distinct()
    for kw in ({"use_layer": "x"}, {"use_rep": "x"}, {"use_batch": "x"}, {"use_highly_variable": True}, {"use_rep": "rep", "rep_dim": 5}):
        with pytest.raises(ValueError):
            co.dataset_view(m, c, f, **kw)


def test_run_summaries(spark):
    r = spark.createDataFrame([("d", "a", 0, 1.0), ("d", "a", 1, 3.0), ("e", "b", 0, 5.0)], "dataset string, method string, seed int, m double")
    s = {(d, k): (m, sd, n) for d, k, m, sd, n in rows(rn.summarise_runs(r, ["dataset", "method"], ["m"]))}
    assert s["e", "b"] == (5.0, None, 1) and s["d", "a"][0] == 2.0
    assert rows(rn.complete_grid(r, ("dataset", "method")).where("annotation IS NOT NULL"), "dataset", "method") == [("d", "b"), ("e", "a")]


def test_grid_in_chunks_is_not_shuffled(spark, monkeypatch):
    """Several chunks and tasks, null keys and repeated rows; the combinations meet no join."""
    monkeypatch.setattr(rn, "GRID_ITEMS", 3)
    monkeypatch.setattr(rn, "GRID_KEYS", 2)
    data = [(i % 7 if i % 11 else None, f"m{i % 10}" if i % 13 else None, float(i)) for i in range(60)]
    out = rn.complete_grid(spark.createDataFrame(data, "dataset long, method string, m double"), ("dataset", "method"))
    held = {(d, k) for d, k, _ in data if d is not None and k is not None}
    want = [(d, k) for d in [None, *range(7)] for k in [None, *(f"m{i}" for i in range(10))] if (d, k) not in held]
    got = out.where("annotation = 'N.A.'").select("dataset", "method").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert out.where("annotation IS NULL").count() == len(data)
    assert "LeftAnti" not in out._jdf.queryExecution().toString()


def test_rank_table_by_blocks(spark, tmp_path, monkeypatch):
    """More TFs than a file and more genes than a block hold; absent ranks, fractions and ranks above 16 bits."""
    monkeypatch.setattr(sinks, "FILE_TFS", 4)
    monkeypatch.setattr(sinks, "BLOCK_GENES", 7)
    pairs = [(f"g{g:03d}", f"t{t:02d}", float(g * 10 + t) + 0.5) for g in range(40) for t in range(11) if (g + t) % 9]
    for version, high in ((2, 0.0), (1, 40_000.0)):
        ranks = spark.createDataFrame([*pairs, ("g000", "t01", 1.0 + high)], "gene string, tf string, rank double").repartition(5)
        path = str(tmp_path / f"v{version}") + sinks.RANK_SUFFIX
        sinks.write_rank_table(ranks, path, version)
        got = spark.read.parquet(path)
        key = "tracks" if version == 2 else "features"
        names = [f"g{g:03d}" for g in range(40)]
        assert got.columns == ([*names, key] if version == 2 else [key, *names])
        assert dict(got.dtypes)["g005"] == ("smallint" if version == 2 else "int")
        want = {(g, t): int(r) for g, t, r in pairs} | {("g000", "t01"): int(1 + high)}
        found = got.toPandas().set_index(key)
        assert sorted(found.index) == [f"t{t:02d}" for t in range(11)]
        assert all((pd.isna(found.at[t, g]) and (g, t) not in want) or found.at[t, g] == want[g, t] for g in names for t in found.index)
    with pytest.raises(ValueError):
        sinks.write_rank_table(ranks, str(tmp_path / "x"), 2)
    with pytest.raises(ValueError):
        sinks.write_rank_table(ranks, str(tmp_path / "x"), 3)


def test_correlation_of_a_feature_without_numbers(spark):
    m = spark.createDataFrame([(f"c{i}", f, float("nan") if f == "a" else float(i * (3 if f == "b" else i))) for i in range(6) for f in "abd"], "cell string, feature string, value double")
    e = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "a")], "source string, target string")
    for method in ("pcc", "spr"):
        got = {(s, t): c for s, t, c in rows(sk.skeleton_corr([m], e, m.select("cell").distinct(), method), "source", "target", "corr")}
        assert got["a", "b"] is None and got["a", "a"] is None and got["b", "d"] > 0.9


def test_silhouettes_with_columns_of_any_name(spark):
    x = np.random.default_rng(2).normal(size=(30, 3))
    c = cells_of(spark, x, label=[str(i % 2) for i in range(30)], n=[str(i % 3) for i in range(30)])
    assert 0 <= me.avg_silhouette_width_batch(c, "n", "label").first()[0] <= 1
    assert 0 <= me.avg_silhouette_width_batch(c, "label", "n").first()[0] <= 1
    assert 0 <= me.avg_silhouette_width(c, "label").first()[0] <= 1


def test_fisher_tails_against_all_terms():
    from math import comb

    rng = np.random.default_rng(1)
    for a, b, c, d in rng.integers(0, 40, (200, 4)).tolist():
        row, col, n = a + b, a + c, a + b + c + d
        p = {k: comb(row, k) * comb(n - row, col - k) / comb(n, col) for k in range(max(0, row + col - n), min(row, col) + 1)}
        assert abs(nf._fisher_two_sided(a, b, c, d) - min(1.0, sum(x for x in p.values() if x <= p[a] * (1 + 1e-7)))) < 1e-9
    assert nf._fisher_two_sided(3_000_000, 2_000_000, 2_000_000, 900_000_000) < 1e-300


def test_loess_in_tiles(spark):
    """Tiles of five points against one tile of all; a line is reproduced."""
    from strandloom.functions.loess import loess

    rng = np.random.default_rng(3)
    xs = np.sort(rng.random(60)).tolist()
    data = [("a", f"f{i}", x, float(np.sin(5 * x))) for i, x in enumerate(xs)] + [("b", f"f{i}", float(i), 2.0 * i + 1) for i in range(12)] + [("c", "f0", 1.0, 3.0), ("c", "f1", 1.0, 5.0)]
    df = spark.createDataFrame(data, "g string, feature string, x double, y double")
    small, large = (rows(loess(df, "g", "x", "y", tile=t), "g", "feature", "fit") for t in (5, 4096))
    assert len(small) == len(large) == 74 and np.allclose([r[2] for r in small], [r[2] for r in large])
    fit = {(g, f): v for g, f, v in small}
    assert all(abs(fit["b", f"f{i}"] - (2 * i + 1)) < 1e-6 for i in range(12)) and fit["c", "f0"] == 4.0
    assert max(abs(fit["a", f"f{i}"] - np.sin(5 * x)) for i, x in enumerate(xs)) < 0.1


def test_inference_scores_edges_in_one_pass(spark, monkeypatch):
    """Own and shuffled vectors of both models meet the skeleton once; parallel edges and repeated nodes give a row each."""
    from strandloom.functions.runtime import cut_lineage
    from strandloom.operators import inference

    cut = []
    monkeypatch.setattr(inference, "cut_lineage", lambda df: cut.append(df.columns) or cut_lineage(df))
    a = [("s", [1.0, 0.0]), ("s", [0.0, 2.0]), ("t", [1.0, 1.0]), ("u", [0.0, 0.0])]
    b = [("s", [3.0, 4.0]), ("t", [4.0, 3.0]), ("u", [1.0, 0.0]), ("v", [0.0, 1.0])]
    one, two = (spark.createDataFrame(x, "node string, rep array<double>") for x in (a, b))
    skeleton = spark.createDataFrame([("s", "t", 1), ("s", "t", 2), ("t", "u", 3)], "source string, target string, dist int")
    out = inference.regulatory_inference([one, two], skeleton).collect()
    half = 0.5 ** 0.5
    want = sorted([("s", "t", d, round((half + 0.96) / 2, 9)) for d in (1, 2) for _ in range(2)] + [("t", "u", 3, 0.4)])
    assert sorted((r.source, r.target, r.dist, round(r.score, 9)) for r in out) == want
    assert all(0 <= r.pval <= 1 and 0 <= r.qval <= 1 for r in out)
    assert sum("_bg" in c for c in cut) == 1


def test_draws_are_those_of_whole_numbers():
    """Samples in rows, links in columns; sample numbers whose polynomial does and does not fit 63 bits."""
    rng = np.random.default_rng(3)
    seeds, n = np.concatenate([rng.integers(0, cs.P, (40, 4)), np.full((2, 4), cs.P - 1), np.zeros((1, 4), int)]), rng.integers(1, 1 << 31, 43)
    for k in (np.arange(0, 1600, 37), np.array([1624, 1625, 5000, 10**6])):
        want = [[sum(int(c) * int(j) ** i for i, c in enumerate(s)) % cs.P * int(m) // cs.P for s, m in zip(seeds, n)] for j in k]
        assert cs.draws(seeds, n, k).tolist() == want


def test_links_are_sent_once_however_many_pairs_and_samples(spark, monkeypatch):
    """No table of pairs and samples is held, so only very many draws cut a block into ranges of samples."""
    seen = []
    monkeypatch.setattr(cs, "TABLE_CELLS", 1)
    g2r = spark.createDataFrame([(f"g{i}", f"r{j}") for i in range(3) for j in range(4)], "source string, target string")
    r2t = spark.createDataFrame([(f"r{i}", f"t{i % 3}") for i in range(8)], "source string, target string")
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    place = Classic.repartitionById
    monkeypatch.setattr(Classic, "repartitionById", lambda df, n, c: seen.append(df.where("tag = 2").count()) or place(df, n, c))
    nf.cis_regulatory_enrichment(g2r, r2t, spark.createDataFrame([(f"r{i}",) for i in range(8)], "region string"), 50).collect()
    assert seen == [12]
