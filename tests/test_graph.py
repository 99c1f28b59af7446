import math

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from strandloom.operators import graph as gr
from strandloom.plans.guidance import anchored_guidance_graph, rna_anchored_guidance_graph


@pytest.fixture
def triplet(spark):
    return spark.createDataFrame([("0", "0", 1.0, 1), ("1", "1", .4, 1), ("2", "2", .7, 1), ("1", "2", .1, 1)], "source string, target string, weight double, sign int")


def near(got, want):
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert all(math.isclose(g[-1], w[-1], abs_tol=1e-9) for g, w in zip(got, want))


def test_degrees(triplet):
    for direction, want in (("in", [1, .4, .8]), ("out", [1, .5, .7]), ("both", [1, .5, .8])):
        near(rows(gr.vertex_degrees(triplet, direction)), [(str(i), w) for i, w in enumerate(want)])
    with pytest.raises(ValueError):
        gr.vertex_degrees(triplet, "up")


def test_normalize(triplet):
    din, dout = {"0": 1, "1": .4, "2": .8}, {"0": 1, "1": .5, "2": .7}
    fns = {"in": lambda s, t, w: w / din[t], "out": lambda s, t, w: w / dout[s],
           "sym": lambda s, t, w: w / math.sqrt(din[t] * dout[s]), "keepvar": lambda s, t, w: w / math.sqrt(din[t])}
    for m, fn in fns.items():
        want = sorted((s, t, fn(s, t, w)) for s, t, w, _ in rows(triplet))
        near(rows(gr.normalize_edges(triplet, m), "source", "target", "enorm"), want)


def test_compose_and_collapse(spark):
    base = spark.createDataFrame([("a", "b", 11, 1 / 11), ("b", "a", 11, 1 / 11), ("a", "a", 0, 1.0)], "source string, target string, dist long, weight double")
    extra = spark.createDataFrame([("f", "g", 5, .2), ("a", "b", 2, .5)], "source string, target string, dist long, weight double")
    out = gr.compose(base, extra, directed=[True, False])
    assert out.count() == 7
    assert rows(out.where("source = 'b' AND target = 'a'"), "dist") == [(2,), (11,)]
    col = {(s, t): (d, w) for s, t, d, w in rows(gr.collapse(out, {"dist": "min", "weight": "prob_or"}, ["dist"]), "source", "target", "dist", "weight")}
    assert col["a", "b"][0] == 2 and math.isclose(col["a", "b"][1], 1 - (10 / 11) * .5)


def test_collapse_drops_edges_without_a_merged_value(spark):
    e = spark.createDataFrame([("a", "b", None, 1), ("a", "c", 2.0, 1)], "source string, target string, w double, o int")
    assert rows(gr.collapse(e, {"w": "max"}, ["o"]), "target") == [("c",)]


def test_reachable_chain_and_cycle(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(7)] + [("n7", "n3"), ("x", "n0")], "source string, target string")
    src = spark.createDataFrame([("n2",), ("absent",)], "node string")
    assert rows(gr.reachable(e, src)) == sorted([("absent",), *[(f"n{i}",) for i in range(2, 8)]])


def test_check_graph(spark, triplet):
    feats = spark.createDataFrame([("0",), ("9",)], "feature string")
    assert tuple(gr.graph_report(triplet, feats).first()) == (1, 0, 0, 1)
    with pytest.raises(ValueError, match="covered"):
        gr.check_graph(triplet, feats)
    with pytest.raises(ValueError, match="attr"):
        gr.check_graph(triplet, feats, attr="what")
    assert gr.check_graph(triplet, feats, cov="ignore", sym="warn") is False
    assert gr.check_graph(triplet.where("source = target"), feats.where("feature = '0'"))


def test_sampling_is_valid_and_deterministic(spark):
    e = spark.createDataFrame([(f"s{i}", f"t{j}", 0.5 if j % 2 else 1.0, 1) for i in range(30) for j in range(i % 7 + 1)] + [(f"s{i}", f"s{i}", 1.0, 1) for i in range(30)],
                              "source string, target string, weight double, sign int")
    n = round(e.agg(F.sum("weight")).first()[0])
    out = gr.sample_edges(e, neg_samples=2, seed=3)
    got = rows(out)
    assert len(got) == 3 * n and got == rows(gr.sample_edges(e.repartition(3), neg_samples=2, seed=3))
    known = {(s, t) for s, t, *_ in rows(e)}
    assert all(((s, t) in known) == (w == 1.0) for _, _, s, t, w, _ in got)


def test_hop_tables_double(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1000)] + [(7, 7)], "source long, target long")
    assert len(gr.hop_tables(chain)) == 10
    got = gr.reachable(chain, spark.createDataFrame([(990,), (2000,)], "node long"))
    assert rows(got) == [(i,) for i in range(990, 1001)] + [(2000,)]
    assert gr.reachable(chain, spark.createDataFrame([(0,)], "node long")).count() == 1001
    hub = [(0, i) for i in range(1, 300)] + [(i, 300) for i in range(1, 300)] + [(300, i) for i in range(301, 600)] + [(599, 0), (600, 601), (601, 600)]
    assert gr.reachable(spark.createDataFrame(hub, "source long, target long"), spark.createDataFrame([(5,)], "node long")).count() == 600


def test_sampling_draws_by_weight_and_degree(spark):
    """Shares of positives and of negatives close to what they should be; a source without a free target has no negative."""
    e = spark.createDataFrame([("a", "x", 3000.0, 1), ("a", "y", 1000.0, 1), ("b", "x", 2000.0, 1), ("b", "x", 2000.0, -1)] + [("c", t, 100.0, 1) for t in "abcxy"],
                              "source string, target string, weight double, sign int")
    out = gr.sample_edges(e, neg_samples=1, deemphasize_loops=False, seed=5)
    pos = {(r.source, r.target, r.sign): r["count"] for r in out.where("copy = -1").groupBy("source", "target", "sign").count().collect()}
    assert sum(pos.values()) == 8500 and abs(pos["a", "x", 1] - 3000) < 200 and abs(pos["c", "x", 1] - 100) < 50
    neg = {(r.source, r.target, r.sign): r["count"] for r in out.where("copy = 0").groupBy("source", "target", "sign").count().collect()}
    assert not any(s == "c" for s, *_ in neg) and sum(neg.values()) == 8500 - sum(n for (s, *_), n in pos.items() if s == "c")
    degree = {"a": 4100, "b": 4100, "c": 500}  # both ends count; x and y are taken
    n = sum(c for (s, *_), c in neg.items() if s == "a")
    assert all(abs(neg["a", t, 1] / n - d / 8700) < 0.03 for t, d in degree.items())


def test_sampling_writes_few_rows(spark, monkeypatch):
    """Between its steps only the edges and the positives are written; copies and ranges of edges cross the shuffles in blocks (F21, F24)."""
    e = spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 80).alias("source"), F.concat(F.lit("t"), F.col("id") * 7 % 150).alias("target"), F.lit(1.0).alias("weight"), F.lit(1).alias("sign"))
    cut, written = gr.cut_lineage, []

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(gr, "cut_lineage", counted)
    out = gr.sample_edges(e, neg_samples=2, seed=3)
    assert out.count() == 12_000 and sum(written) < 2.2 * 4000


def test_sampling_in_blocks(spark, monkeypatch):
    """Many small tasks and blocks, nulls and parallel edges: as with a hub's ranges split by value."""
    from strandloom.functions import packed

    e = spark.range(3000).selectExpr("id % 37 as source", "if(id % 61 = 3, null, id * 7 % 41) as target", "cast(id % 5 as double) / 2 as weight",
                                     "case when id % 3 = 0 then -1 when id % 50 = 1 then null else 1 end as sign")
    whole = rows(gr.sample_edges(e, neg_samples=3, seed=5))
    monkeypatch.setattr(packed, "TASK_ROWS", 300)
    monkeypatch.setattr(packed, "CHUNK_ROWS", 200)
    assert rows(gr.sample_edges(e, neg_samples=3, seed=5)) == whole
    monkeypatch.setattr(gr, "DRAWN_HUB", 80)
    assert rows(gr.sample_edges(e.repartition(5), neg_samples=3, seed=5)) == whole
    known = {(s, t, g) for s, t, _, g in rows(e)}
    assert all((((s, t, g) in known) == (c == -1)) for _, c, s, t, _, g in whole)
    assert gr.sample_edges(e.where("weight < 0")).count() == 0


def test_sampling_counts_find_faults(spark):
    from checks.graph_queries import _sampled

    e = spark.createDataFrame([("a", "x", 1.0, 1), ("b", "y", 1.0, -1), (None, "y", 1.0, 1)], "source string, target string, weight double, sign int")
    out = spark.createDataFrame([(0, -1, "a", "x", 1.0, 1), (0, 0, "a", "y", 0.0, 1), (0, 1, "b", "y", 0.0, -1), (1, -1, "b", "x", 1.0, -1), (1, 0, "b", "y", 0.0, -1), (1, 1, "b", "z", 1.0, -1),
                                 (2, -1, None, "y", 1.0, 1), (2, 0, None, "x", 0.0, 1), (2, 0, None, "x", 0.0, -1)], "draw long, copy int, source string, target string, weight double, sign int")
    assert tuple(_sampled(e, out).first()) == (3, 6, 2, 2, 3)


def test_corrupt_keeps_size_and_avoids_edges(spark):
    e = spark.createDataFrame([(f"s{i}", f"t{i * 7 % 40}", float(i)) for i in range(50)], "source string, target string, w double")
    src, tgt = e.select(F.col("source").alias("node")), e.select(F.col("target").alias("node"))
    out = gr.corrupt_edges(e, 0.2, src, tgt, seed=1)
    assert out.count() == 50 and rows(out, "w") == rows(e, "w")
    assert out.join(e, ["source", "target"], "left_anti").count() == 10


def test_product_counts_parallel_edges(spark):
    a = spark.createDataFrame([("g", "r"), ("g", "r"), ("g", "q")], "source string, target string")
    b = spark.createDataFrame([("r", "t"), ("r", "t"), ("q", "t"), ("q", "u")], "source string, target string")
    assert rows(gr.edge_product(a, b)) == [("g", "t", 5.0), ("g", "u", 1.0)]
    assert rows(gr.edge_product(a, b, binarize=True)) == [("g", "t", 1.0), ("g", "u", 1.0)]


def test_suffix_and_drop(spark):
    f = spark.createDataFrame([("g_mCH",), ("h_mCG",)], "feature string")
    assert rows(gr.suffix_edges(f, ["_mCH", "_mCG"]), "source", "target", "sign") == [("g", "g_mCH", -1), ("h", "h_mCG", -1)]
    with pytest.raises(Exception, match="unexpected"):
        gr.suffix_edges(f.withColumn("feature", F.lit("zz")), ["_mCH"]).collect()
    e = spark.createDataFrame([("a", "b", "dist"), ("b", "a", "eqtl"), ("a", "c", "eqtl")], "source string, target string, type string")
    bad = spark.createDataFrame([("a", "b")], "source string, target string")
    assert rows(gr.drop_edges(e, bad)) == [("a", "c", "eqtl")]
    assert rows(gr.drop_edges(e, bad, ["dist"])) == [("a", "b", "dist"), ("a", "c", "eqtl")]


def test_guidance_graph_errors_and_shape(spark, bed):
    rna = bed.withColumnRenamed("name", "feature").withColumn("highly_variable", F.col("feature").isin("a", "c"))
    atac = bed.withColumn("feature", F.concat(F.lit("p"), "name")).drop("name")
    edges, (flagged,) = rna_anchored_guidance_graph(rna, atac, promoter_len=2, extend_range=15)
    assert gr.check_graph(edges, rna.select("feature").unionByName(atac.select("feature")))
    assert rows(flagged.where("highly_variable"), "feature") == [("pa",), ("pb",), ("pc",)]
    for kw in ({"signs": [1, 1]}, {"signs": [2]}, {"gene_region": "x"}):
        with pytest.raises(ValueError):
            rna_anchored_guidance_graph(rna, atac, **kw)
    corrupted, _ = anchored_guidance_graph(rna, atac, extend_range=15, corrupt_rate=0.3, propagate_highly_variable=False)
    assert corrupted.count() == anchored_guidance_graph(rna, atac, extend_range=15, propagate_highly_variable=False)[0].count()


def test_edge_product_sends_no_path(spark, monkeypatch):
    """Packed targets, middle nodes with several packs, hubs in several tasks, nulls and parallel edges: as many shuffled rows as edges, not as paths."""
    monkeypatch.setattr(gr, "PACKED", 7)
    monkeypatch.setattr(gr, "HUB_ROWS", 10)
    monkeypatch.setattr(gr, "PATHS_AT_ONCE", 50)
    a = [("hub", f"m{i % 30}", 1.0 + i) for i in range(40)] + [(f"s{i % 9}", f"m{i % 5}", 0.5) for i in range(60)] + [(None, "m1", 2.0), ("s1", None, 1.0), ("s2", "m2", None)]
    b = [(f"m{i % 30}", f"t{i % 41}é", 1.0) for i in range(900)] + [("m1", None, 3.0), ("m1", "", 1.0), (None, "t1é", 1.0), ("m3", "t9", None)]
    x, y = (spark.createDataFrame(rows, "source string, target string, w double") for rows in (a, b))
    want = {}
    for s, m, v in a:
        for q, t, w in b:
            if m is not None and m == q and v is not None and w is not None:
                want[s, t] = want.get((s, t), 0.0) + v * w
    out = gr.edge_product(x, y, "w")
    got = {(r.source, r.target): r.weight for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "_body" in plan  # rows of a source carry packed targets
    assert {r.weight for r in gr.edge_product(x, y, binarize=True).collect()} == {1.0}


def test_lists_of_targets_are_packed_as_they_come(monkeypatch):
    """Lists over several batches, beyond a pack, with null names; short lists are not compressed."""
    import pyarrow as pa

    monkeypatch.setattr(gr, "PACKED", 3)
    rows_ = [(m, None if i == 1 else f"t{m}.{i}" * (1 + i), float(i)) for m, n in enumerate((1, 700, 2, 3, 4)) for i in range(n)]
    table = pa.table(dict(zip(("_mid", "target", "_w"), map(list, zip(*rows_)))))
    out = pa.Table.from_batches(list(gr._pack(iter(table.to_batches(max_chunksize=50)))))
    n = out.column("_n").to_numpy()
    assert n.max() == 3 and (out.column("_body")[0].as_py()[0] == 0)
    target, w = gr._unpack(out.column("_body").to_pylist(), n.astype(np.int64))
    assert list(zip(np.repeat(out.column("_mid").to_numpy(), n).tolist(), target.to_pylist(), w.tolist())) == rows_
