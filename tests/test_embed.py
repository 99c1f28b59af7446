import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import rows
from pyspark.sql import functions as F

from strandloom.functions import blocks as bl
from strandloom.functions import krylov as kr
from strandloom.operators import embed as em
from strandloom.operators import ivf
from strandloom.operators import matrix as mt
from strandloom.operators import metrics as me
from strandloom.operators import neighbors as nb


def cells_of(spark, x, **extra):
    pdf = pd.DataFrame({"cell": [f"c{i:04d}" for i in range(len(x))], "rep": x.tolist(), **extra})
    return spark.createDataFrame(pdf)


def long_of(spark, x):
    i, j = np.nonzero(x)
    return spark.createDataFrame(pd.DataFrame({"cell": [f"c{k:04d}" for k in i], "feature": [f"f{k:03d}" if x.shape[1] <= 1000 else f"f{k:04d}" for k in j], "value": x[i, j].astype(float)}))


@pytest.fixture
def sparse(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(0.6, size=(120, 30)) * rng.integers(1, 4, size=30)
    x[:, 0] += 1
    x[0] += 1
    return x.astype(float)


def test_knn_is_exact_with_and_without_pruning(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(200, 4)), rng.normal(size=(150, 4)) * 0.1 + 6, np.tile([[1.0, 2, 3, 4]], (80, 1))])
    c = cells_of(spark, x)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    want = sorted((f"c{i:04d}", f"c{j:04d}", r + 1) for i in range(len(x)) for r, j in enumerate(sorted(range(len(x)), key=lambda j: (d[i, j], j))[:6]))
    for prune in (1, 10**9):
        assert rows(nb.knn(c, c, 6, prune_from=prune), "query", "ref", "rank") == want


def test_pruned_search_sends_rows_once_per_tile(spark, monkeypatch):
    """Copies of the reference rows grow with the tiles, not with the pivots; one cell larger than a tile is cut."""
    x = np.random.default_rng(6).normal(size=(6000, 6))
    x[:300] = x[0]
    c = cells_of(spark, x).select(F.col("cell").alias("id"), "rep")
    sent = nb._pruned_rows(c, c, 5, 6000, 6000, 1e-9).where("tag = 1").count()
    assert sent <= 8 * 6000, sent  # 38 pivots in seven tiles
    monkeypatch.setattr(nb, "PRUNED_TILE", 100)
    cut = nb._pruned_rows(c, c, 5, 6000, 6000, 1e-9)
    assert cut.where("tag = 0").groupBy("blk", "slc").count().agg(F.max("count")).first()[0] < 400
    assert nb._pivot_tiles(np.abs(np.subtract.outer(np.arange(4.0), np.arange(4.0))), {0: 5, 1: 9, 3: 2, 2: 1}, 10) == {0: 0, 1: 1, 2: 1, 3: 2}


def test_knn_without_self_and_unknown_metric(spark):
    c = cells_of(spark, np.zeros((12, 2)))
    out = nb.knn(c, c, 3, exclude_self=True)
    assert out.where("query = ref").count() == 0 and out.count() == 36
    with pytest.raises(ValueError):
        nb.knn(c, c, 3, "what")


def test_knn_approx_with_full_reach_is_exact(spark):
    x = np.random.default_rng(4).normal(size=(300, 3))
    x[200:260] = x[0]
    c = cells_of(spark, x)
    assert rows(nb.knn_approx(c, c, 5, reach=1.0, list_rows=8), "query", "ref", "rank") == rows(nb.knn(c, c, 5), "query", "ref", "rank")
    assert rows(nb.knn_approx(c, c, 5, "cosine", reach=1.0, list_rows=20), "query", "ref", "rank") == rows(nb.knn(c, c, 5, "cosine"), "query", "ref", "rank")
    with pytest.raises(ValueError):
        nb.knn_approx(c, c, 5, "ip")


def test_knn_approx_recall_and_work(spark):
    """Recall of at least 0.9 at three sizes; the rows a query is measured against grow more slowly than the table."""
    share = []
    for n in (500, 4000, 32_000):
        c = cells_of(spark, np.random.default_rng(n).normal(size=(n, 8)))
        some = c.where("cell < 'c0200'")
        want, got = (set(rows(f(some, c, 10), "query", "ref")) for f in (nb.knn, nb.knn_approx))
        assert len(got) == len(want) == 10 * some.count() and len(got & want) >= 0.9 * len(want), (n, len(got & want) / len(want))
        ref = c.select(F.col("cell").alias("id"), "rep").cache()
        index, near = ivf.InvertedFile(ref), nb.knn(some, c, 10)
        u = near.groupBy(F.col("query").alias("id")).agg(F.max("dist").alias("u"))
        lists = index.lists_within(ref.join(u, "id"), index.fit_reach(ref.join(u, "id"), near, 0.95))
        share.append(lists.join(index.centres, ["top", "sub"]).agg(F.sum("rows")).first()[0] / some.count() / n)
    assert share[0] > 1.3 * share[1] > 1.6 * share[2], share


def test_knn_approx_widens_until_k_rows(spark):
    x = np.repeat(np.arange(20.0) * 100, 3)[:, None] + np.random.default_rng(2).normal(size=(60, 2))
    c = cells_of(spark, x)
    assert nb.knn_approx(c, c, 30, list_rows=3, reach=0.0).count() == 60 * 30


def test_components(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20) if i not in (6, 13)]
    e = spark.createDataFrame(edges + [(b, a) for a, b in edges], "source string, target string")
    n = spark.createDataFrame([(f"n{i:02d}",) for i in range(22)], "node string")
    want = {i: 0 if i <= 6 else 7 if i <= 13 else 14 if i <= 20 else 21 for i in range(22)}
    assert rows(nb.connected_components(n, e)) == sorted((f"n{i:02d}", f"n{c:02d}") for i, c in want.items())


def check_svd(out, x, k):
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    got = np.stack(out.u.orderBy("cell").toPandas()["rep"].to_list())
    v = np.stack(out.v.orderBy("feature").toPandas()["vec"].to_list())
    assert np.allclose(out.s, s[:k], rtol=1e-10, atol=1e-7 * s[0])
    assert np.allclose(got * out.s @ v.T, (u[:, :k] * s[:k]) @ vt[:k], atol=1e-6 * s[0])


@pytest.mark.parametrize("center", [False, True])
def test_svd_matches_numpy(spark, sparse, center):
    m, c = long_of(spark, sparse), cells_of(spark, sparse).select("cell")
    x = sparse - sparse.mean(axis=0) if center else sparse
    for k in (1, 5, 30):
        check_svd(em.svd(m, k, c, center=center), x, k)


@pytest.mark.parametrize("center", [False, True])
def test_svd_of_many_features_in_pieces(spark, monkeypatch, center):
    """Several feature blocks, ranges of columns, runs of rows and rounds; a flat spectrum."""
    for name, value in (("FEATURES", 64), ("TASK_BYTES", 64 * 40 * 8 * 7), ("TASK_ENTRIES", 2000)):
        monkeypatch.setattr(kr, name, value)
    rng = np.random.default_rng(5)
    x = rng.poisson(0.2, size=(150, 2300)).astype(float)
    x[3] = 0
    x[:, 7] = x[:, 8]
    x[0] += 1
    m, c = long_of(spark, x), cells_of(spark, x).select("cell")
    check_svd(em.svd(m, 6, c, center=center), x - x.mean(axis=0) if center else x, 6)


def test_svd_raises_where_it_does_not_converge(spark):
    x = np.random.default_rng(6).random((120, 100))
    m, c = long_of(spark, x), cells_of(spark, x).select("cell")
    with pytest.raises(ArithmeticError):
        kr.leading_vectors(kr.SparseRows(m, 120, False), 3, rounds=1)


def test_svd_of_low_rank(spark):
    x = np.outer(np.arange(1.0, 13), np.arange(1.0, 41)) + np.outer(np.arange(12) % 2, np.ones(40))
    m, c = long_of(spark, x), cells_of(spark, x).select("cell")
    out = em.svd(m, 5, c)
    assert np.allclose(out.s[2:], 0) and len(out.s) == 5
    check_svd(out, x, 5)


def test_lsi_matches_numpy(spark, sparse):
    m, c = long_of(spark, sparse), cells_of(spark, sparse).select("cell")
    got = np.stack(em.lsi(m, c, 4).orderBy("cell").toPandas()["rep"].to_list())
    x = sparse / sparse.sum(axis=1, keepdims=True) * (len(sparse) / sparse.sum(axis=0))
    x = np.log1p(x / x.sum(axis=1, keepdims=True) * 1e4)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    u = u[:, :4] * np.where(vt[np.arange(4), np.abs(vt[:4]).argmax(axis=1)] < 0, -1, 1)
    u = (u - u.mean(axis=1, keepdims=True)) / u.std(axis=1, ddof=1, keepdims=True)
    assert np.allclose(got, u, atol=1e-6)


def test_lsi_keeps_cells_without_entries(spark, sparse):
    m, c = long_of(spark, sparse), cells_of(spark, sparse).select("cell")
    more = c.union(spark.createDataFrame([("bare1",), ("bare2",)], "cell string"))
    model = em.AllCoolsLsi(4).fit(m, more)
    for out, odd in ((em.lsi(m, more, 4), np.isnan), (em.lsi_project(m, more, 4, c), np.isnan), (model.transform(m, cells=more), lambda v: np.array(v) == 0)):
        got = {r["cell"]: r["rep"] for r in out.collect()}
        assert len(got) == len(sparse) + 2
        assert all((cell.startswith("bare")) == bool(np.all(odd(rep))) for cell, rep in got.items())


def test_pca_matches_dense(spark, sparse):
    m, c = long_of(spark, sparse), cells_of(spark, sparse).select("cell")
    _, var = em.pca(m, c, 3)
    z = np.clip((sparse - sparse.mean(axis=0)) / sparse.std(axis=0, ddof=1), -10, 10)
    want = np.linalg.svd(z - z.mean(axis=0), compute_uv=False)[:3] ** 2 / (len(sparse) - 1)
    assert np.allclose(var, want)


def test_allcools_transform_of_fit_data_is_u(spark, sparse):
    m, c = long_of(spark, sparse), cells_of(spark, sparse).select("cell")
    model = em.AllCoolsLsi(4).fit(m, c)
    got = np.stack(model.transform(m).orderBy("cell").toPandas()["rep"].to_list())
    assert np.allclose((got**2).sum(axis=0), 1)
    with pytest.raises(ValueError):
        em.AllCoolsLsi(4).transform(m)


@pytest.mark.parametrize("prune_from", [20_000, 10])
def test_outlier_leaves_other_neighbours_alone(spark, prune_from):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.random((60, 9)), np.full((1, 9), 1e7), rng.random((1, 9)) - 3e6])
    x[5] = x[4]
    c = cells_of(spark, x, ct=[str(i % 2) for i in range(62)]).cache()
    full = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    names = [r.cell for r in c.orderBy("cell").collect()]
    got = {(r["query"], r["rank"]): r["ref"] for r in nb.knn(c, c, 4, exclude_self=True, prune_from=prune_from).collect()}
    for i in range(62):
        order = [j for j in np.argsort(full[i], kind="stable") if j != i][:4]
        assert [got[names[i], k + 1] for k in range(4)] == [names[j] for j in order]
    ip = {(r["query"], r["rank"]): r["ref"] for r in nb.knn(c, c, 3, "ip").collect()}
    assert all(ip[names[i], 1] == names[np.argmax(x[i] @ x.T)] for i in range(60))
    y = c.withColumn("rep", F.transform("rep", lambda v: v + 0.05))
    diff = ((x[:, None] - (x + 0.05)[None]) ** 2).sum(axis=2)
    want = {names[i]: ((diff[i] < diff[i, i]) & (np.arange(62) != i)).mean() for i in range(60) if i not in (4, 5)}
    far = {r["cell"]: r["foscttm_x"] for r in me.foscttm(c.select("cell", "rep"), y.select("cell", "rep")).collect()}
    assert all(np.isclose(far[k], v) for k, v in want.items())


def test_gram_blocks(spark, sparse):
    got = {(a, b): s for a, b, s in rows(mt.gram(long_of(spark, sparse), block=7, splits=3))}
    want = sparse.T @ sparse
    assert len(got) == 900 and all(np.isclose(got[f"f{i:03d}", f"f{j:03d}"], want[i, j]) for i in range(30) for j in range(30))


def test_metric_identities(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 5))
    c = cells_of(spark, x, ct=[str(i % 3) for i in range(90)], b=[str(i % 2) for i in range(90)]).withColumn("rep2", F.col("rep"))
    assert me.neighbor_conservation(c, "rep", "rep2", "b", 0.1).first()[0] == 1
    f = me.foscttm(c.select("cell", "rep"), c.select("cell", "rep"))
    assert rows(f.agg(F.max("foscttm_x"), F.max("foscttm_y"))) == [(0.0, 0.0)]
    with pytest.raises(ValueError):
        me.foscttm(c, c.limit(10))
    for value in (me.mean_average_precision(c, "ct", 0.1), me.avg_silhouette_width(c, "ct"), me.graph_connectivity(c, "ct"),
                  me.seurat_alignment_score(c, "b", 0.1), me.avg_silhouette_width_batch(c, "b", "ct"), me.normalized_mutual_info(c, "ct", ["b", "ct"])):
        assert 0 <= value.first()[0] <= 1 + 1e-9
    one = c.withColumn("b", F.lit("x"))
    assert me.avg_silhouette_width_batch(one, "b", "ct").first()[0] == 1


def test_search_of_a_whole_table_is_exact(spark, monkeypatch):
    """Copies, a far row that blurs the product form, and more candidates than are held at once."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(700, 5)), np.tile(rng.normal(size=(1, 5)), (300, 1)), np.full((1, 5), 1e7)])
    table = bl.Table()
    table.n, table.dim, table.x = *x.shape, x
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = np.argsort(np.round(d, 9), axis=1, kind="stable")
    for held in (bl.CANDIDATES, 100):
        monkeypatch.setattr(bl, "CANDIDATES", held)
        for k in (1, 40, 350, 2000):
            got = np.concatenate([bl.Search(table).nearest(x[at:at + 200], k) for at in range(0, 1000, 200)])
            assert np.array_equal(got, want[:1000, :k])
    few = bl.Search(table).nearest(x[:9], 40, np.zeros(9))
    assert few.shape == (9, 40)


def test_neighbor_hits_send_a_row_once_per_core(spark):
    """Rows leave the shuffle once per tile, whatever the number of neighbours; results are those of brute force."""
    rng = np.random.default_rng(13)
    x, label = rng.normal(size=(900, 4)), rng.integers(0, 3, size=900)
    x[:90] = x[0]
    c = cells_of(spark, x, l=label.tolist())
    d = np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 9)
    np.fill_diagonal(d, np.inf)
    for k in (3, 400):
        got = {r["cell"]: r for r in me.neighbor_hits(c, "l", k).collect()}
        for i in range(900):
            hit = label[np.argsort(d[i], kind="stable")[:k]] == label[i]
            ap = (np.cumsum(hit) / np.arange(1, k + 1))[hit].mean() if hit.any() else 0.0
            assert got[f"c{i:04d}"]["n_hits"] == hit.sum() and abs(got[f"c{i:04d}"]["ap"] - ap) < 1e-9
    base = c.select(F.col("cell").alias("id"), "rep", F.col("l").cast("string").alias("aux"))
    held, tiles = bl.spool(base, base, lambda table, left, x: iter([{"n": [table.n]}]), "n long", pa.schema([("n", pa.int64())])).agg(F.sum("n"), F.count("n")).first()
    assert tiles <= spark.sparkContext.defaultParallelism and held == 900 * tiles


def test_neighbor_conservation_writes_no_neighbours(spark, monkeypatch):
    """Brute force, with copies of a vector; single cells are compared inside the search."""
    rng = np.random.default_rng(14)
    x, y, b = rng.normal(size=(300, 3)), rng.normal(size=(300, 3)), np.arange(300) % 3
    x[:30] = x[0]
    c = cells_of(spark, x, rep2=y.tolist(), b=b.tolist())
    scores = []
    for v in range(3):
        at = np.flatnonzero(b == v)
        near = []
        for z in (x[at], y[at]):
            d = np.round(((z[:, None] - z[None]) ** 2).sum(axis=2), 9)
            np.fill_diagonal(d, np.inf)
            near.append([set(r) for r in np.argsort(d, axis=1, kind="stable")[:, :30]])
        scores.append(np.mean([len(p & q) / len(p | q) for p, q in zip(*near)]))
    twice = c.unionByName(c.where("cell < 'c0010'"))
    want = me.neighbor_conservation(twice, "rep", "rep2", "b", 0.1).first()[0]
    assert 0 < want < 1
    monkeypatch.setattr(me, "knn", None)
    assert abs(me.neighbor_conservation(c, "rep", "rep2", "b", 0.1).first()[0] - np.mean(scores)) < 1e-9


def test_knn_approx_copies_no_query_to_lists(spark, monkeypatch):
    """Queries meet the lists in the tasks, also with copies of a row and k beyond a list; rows of one ID count once."""
    x = np.random.default_rng(15).normal(size=(400, 3))
    x[100:180] = x[0]
    c = cells_of(spark, x)
    want = rows(nb.knn(c, c, 9), "query", "ref", "rank")
    monkeypatch.setattr(ivf.InvertedFile, "lists_within", None)
    monkeypatch.setattr(ivf.InvertedFile, "first_lists", None)
    monkeypatch.setattr(ivf, "QUERIES", 30)
    monkeypatch.setattr(ivf, "HELD", 500)
    assert rows(nb.knn_approx(c, c, 9, reach=1.0, list_rows=6), "query", "ref", "rank") == want


def test_a_block_of_distances_is_held_twice_at_most():
    """Distances and their error bounds, no further copies of a block."""
    rng = np.random.default_rng(16)
    q, r = rng.normal(size=(512, 8)), rng.normal(size=(4096, 8))
    r[:300] = q[:300] + 1e-9
    tracemalloc.start()
    got = bl.squared_distances(q, r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * got.nbytes, peak / got.nbytes
    assert np.allclose(got, ((q[:, None] - r[None]) ** 2).sum(axis=2), rtol=1e-9, atol=0)


def test_svd_of_few_cells_sends_no_vectors(spark, monkeypatch):
    """A few cells with many features: from the cells' products, with and without centring, a cell without entries among them."""
    monkeypatch.setattr(em, "leading_vectors", None)
    x = np.random.default_rng(8).normal(size=(7, 300)) * (np.random.default_rng(9).random((7, 300)) < 0.6)
    x[0], x[3] = np.arange(300) % 7 - 3.5, 0.0  # every feature has an entry, cell 3 has none
    m = spark.createDataFrame([(f"c{i}", f"f{j:03d}", float(x[i, j])) for i in range(7) for j in range(300) if x[i, j]], "cell string, feature string, value double")
    cells = spark.createDataFrame([(f"c{i}",) for i in range(7)], "cell string")
    check_svd(em.svd(m, 4, cells), x, 4)
    check_svd(em.svd(m, 4, cells, center=True), x - x.mean(axis=0), 4)


def test_feature_consistency_forms_no_pairs(spark, monkeypatch):
    from strandloom.operators import metrics as me

    monkeypatch.setattr(me, "block_rows", None)
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(90, 4)), rng.normal(size=(90, 6))
    b[:, :2] += a[:, :2]
    x, y = (spark.createDataFrame([(f"f{i}", v.tolist()) for i, v in enumerate(t)], "feature string, rep array<double>") for t in (a, b))
    u, v = (t / np.linalg.norm(t, axis=1)[:, None] for t in (a, b))
    want = np.corrcoef((u @ u.T).ravel(), (v @ v.T).ravel())[0, 1]
    assert abs(me.feature_consistency(x, y, n_features=90, n_repeats=2).first()[0] - want) < 1e-10


def test_copies_of_reference_rows_do_not_grow_with_tables_or_partitions(spark, monkeypatch):
    """A pruned search has a tile per core or two, whatever the number of shuffle partitions; left rows are folded tile by tile."""
    x = np.random.default_rng(17).normal(size=(12_000, 3))
    c = cells_of(spark, x).select(F.col("cell").alias("id"), "rep")
    monkeypatch.setattr(nb, "LEFT_BLOCK", 64)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows_ = nb._pruned_rows(c, c, 5, 12_000, 12_000, 1e-9, True)
        assert rows_.where("tag = 0").select("blk").distinct().count() <= 2 * spark.sparkContext.defaultParallelism + 1
        assert rows_.where("tag = 0").count() == 12_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    base = c.where("id < 'c00300'").select("id", "rep")
    fold = lambda table, left, x: iter([{"n": [len(x)]}])
    one = bl.spool(base, base, fold, "n long", pa.schema([("n", pa.int64())])).collect()
    assert sum(r[0] for r in one) == base.count()


def test_left_rows_are_folded_in_tiles(monkeypatch):
    """The right rows are read once; rows that share an ID stay together."""
    monkeypatch.setattr(bl, "TILE", 4)
    row = lambda tag, i: {"grp": "", "blk": 0, "tag": tag, "id": i, "rep": [1.0, 2.0], "aux": None, "num": 0.0}
    schema = pa.schema([("grp", pa.string()), ("blk", pa.int32()), ("tag", pa.int32()), ("id", pa.string()), ("rep", pa.list_(pa.float64())), ("aux", pa.string()), ("num", pa.float64())])
    table = pa.Table.from_pylist([row(0, f"r{i}") for i in range(5)] + [row(1, i) for i in "aabbbcddee"], schema=schema)
    fold = lambda table, left, x: iter([{"n": [table.n], "ids": ["".join(left.column("id").to_pylist())]}])
    out = list(bl._spooled(fold, pa.schema([("n", pa.int64()), ("ids", pa.string())]))(iter(table.to_batches(max_chunksize=2))))
    assert [b.to_pylist()[0] for b in out] == [{"n": 5, "ids": "aabbb"}, {"n": 5, "ids": "cddee"}]
