"""GRF-* and GUI-* queries."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from checks.interval_queries import DIST
from checks.registry import query, rounded
from checks.views import load
from strandloom.functions.packed import dealt, packed, task_count
from strandloom.functions.runtime import hash_key
from strandloom.operators import graph as gr
from strandloom.plans.guidance import anchored_guidance_graph, rna_anchored_guidance_graph

DEG = """(SELECT node, sum(w) AS degree FROM (SELECT target AS node, weight AS w FROM ed UNION ALL
    SELECT source, weight FROM ed WHERE source <> target) GROUP BY node)"""
# co-purchase hops: consecutive parts of one supplier's shipments
HOPS = """SELECT DISTINCT concat('n', p_size, '_', p_brand) AS source, concat('n', CAST(floor(l_quantity) AS INTEGER), '_', p_brand) AS target
    FROM lineitem JOIN part ON l_partkey = p_partkey"""


def hops(spark, sf):
    li, part = load(spark, sf, "lineitem"), load(spark, sf, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.concat(F.lit("n"), "p_size", F.lit("_"), "p_brand").alias("source"),
        F.concat(F.lit("n"), F.floor("l_quantity").cast("int").cast("string"), F.lit("_"), "p_brand").alias("target"))


def reps(spark, sf):
    """Vector per supplier and part node, from their own columns."""
    s = load(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"),
        F.array(F.col("s_acctbal") / 10000, F.col("s_nationkey") / 25.0, F.lit(1.0)).alias("rep"))
    p = load(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"),
        F.array(F.col("p_retailprice") / 2000, F.col("p_size") / 50.0, F.lit(-0.5)).alias("rep"))
    return s.unionByName(p)


REPS = """reps AS (SELECT concat('s', s_suppkey) AS node, [s_acctbal / 10000, s_nationkey / 25.0, 1.0] AS rep FROM supplier
    UNION ALL SELECT concat('p', p_partkey), [p_retailprice / 2000, p_size / 50.0, -0.5] FROM part)"""


@query("grf01_compose", """SELECT source, target, weight, CAST(NULL AS VARCHAR) AS type FROM ed UNION ALL
    SELECT source, target, CAST(NULL AS DOUBLE), 'buy' FROM ed2 UNION ALL SELECT target, source, CAST(NULL AS DOUBLE), 'buy' FROM ed2""")
def _(spark, sf):
    return gr.compose(load(spark, sf, "ed").select("source", "target", "weight"),
                      load(spark, sf, "ed2").withColumn("type", F.lit("buy")), directed=[True, False])


@query("grf02_collapse", """SELECT source, target, round(1 - product(1 - weight), 6) AS weight, min(dist) AS dist, max(sign) AS sign,
    arg_max(type, type) AS type FROM ed GROUP BY source, target""")
def _(spark, sf):
    return rounded(gr.collapse(load(spark, sf, "ed"), {"weight": "prob_or", "dist": "min", "sign": "max"}, ["type"]))


@query("grf03_prob_or", "SELECT source, round(1 - product(1 - weight), 6) AS p FROM (SELECT source, weight / 20 AS weight FROM ed) GROUP BY source")
def _(spark, sf):
    return rounded(load(spark, sf, "ed").groupBy("source").agg(gr.prob_or(F.col("weight") / 20).alias("p")))



@query("grf04_reachable", f"""WITH RECURSIVE hop AS ({HOPS}), r AS ((SELECT DISTINCT concat('n', p_size, '_', p_brand) AS node FROM part WHERE p_retailprice < 905
    UNION SELECT 'absent') UNION SELECT hop.target FROM r JOIN hop ON r.node = hop.source) SELECT node FROM r""")
def _(spark, sf):
    start = load(spark, sf, "part").where("p_retailprice < 905").select(F.concat(F.lit("n"), "p_size", F.lit("_"), "p_brand").alias("node"))
    return gr.reachable(hops(spark, sf), start.unionByName(spark.sql("SELECT 'absent' AS node")))


@query("grf05_propagate_flag", """SELECT concat('p', p_partkey) AS feature, coalesce(bool_or(s_acctbal > 9000), false) AS highly_variable
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_partkey""")
def _(spark, sf):
    anchors = load(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("feature"), (F.col("s_acctbal") > 9000).alias("highly_variable"))
    others = load(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("feature"))
    return gr.propagate_flag(load(spark, sf, "ed"), anchors, others)


@query("grf06_check_graph", """WITH n AS (SELECT DISTINCT node FROM (SELECT source AS node FROM ed UNION ALL SELECT target FROM ed)),
    pr AS (SELECT DISTINCT source, target FROM ed)
    SELECT (SELECT count(*) FROM part WHERE concat('p', p_partkey) NOT IN (SELECT node FROM n)) AS uncovered_features,
    (SELECT count(*) FROM ed WHERE weight IS NULL OR sign IS NULL) AS edges_without_attributes,
    (SELECT count(*) FROM n WHERE node NOT IN (SELECT source FROM ed WHERE source = target)) AS nodes_without_loop,
    (SELECT count(*) FROM pr WHERE NOT EXISTS (SELECT 1 FROM pr q WHERE q.source = pr.target AND q.target = pr.source)) AS asymmetric_edges""")
def _(spark, sf):
    return gr.graph_report(load(spark, sf, "ed"), load(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("feature")))


@query("grf07_reverse", "SELECT target AS source, source AS target, weight, sign, type, dist FROM ed")
def _(spark, sf):
    return gr.reverse(load(spark, sf, "ed"))


@query("grf08_add_loops", """SELECT source, target, weight, sign, type FROM ed UNION ALL SELECT concat('p', p_partkey), concat('p', p_partkey), 1.0, 1, 'loop' FROM part""")
def _(spark, sf):
    return gr.add_loops(load(spark, sf, "ed").drop("dist"), load(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("feature")))


@query("grf09_subgraph", """WITH n AS (SELECT concat('p', p_partkey) AS node FROM part WHERE p_size > 20 UNION ALL SELECT concat('s', s_suppkey) FROM supplier WHERE s_acctbal > 0)
    SELECT source, target, weight FROM ed WHERE source IN (SELECT node FROM n) AND target IN (SELECT node FROM n)""")
def _(spark, sf):
    nodes = load(spark, sf, "part").where("p_size > 20").select(F.concat(F.lit("p"), "p_partkey").alias("node")).unionByName(
        load(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))
    return gr.subgraph(load(spark, sf, "ed").select("source", "target", "weight"), nodes)


@query("grf10_vertex_degrees", f"""SELECT node, round(degree, 6) AS degree, round(coalesce((SELECT sum(weight) FROM ed WHERE target = node), 0), 6) AS d_in FROM {DEG}""")
def _(spark, sf):
    ed = load(spark, sf, "ed")
    return rounded(gr.vertex_degrees(ed).join(gr.vertex_degrees(ed, "in").withColumnRenamed("degree", "d_in"), "node"))


@query("grf11_normalize_edges", """WITH i AS (SELECT target, sum(weight) AS d FROM ed GROUP BY target), o AS (SELECT source, sum(weight) AS d FROM ed GROUP BY source)
    SELECT ed.source, ed.target, ed.dist, round(weight / i.d, 6) AS n_in, round(weight / o.d, 6) AS n_out, round(weight / sqrt(i.d * o.d), 6) AS n_sym,
    round(weight / sqrt(i.d), 6) AS n_keepvar FROM ed JOIN i ON ed.target = i.target JOIN o ON ed.source = o.source""")
def _(spark, sf):
    df = load(spark, sf, "ed").select("source", "target", "weight", "dist")
    for m in ("in", "out", "sym", "keepvar"):
        df = gr.normalize_edges(df, m, out=f"n_{m}")
    return rounded(df.drop("weight"))


@query("grf12_propagate", f"""WITH {REPS}, i AS (SELECT target, sum(weight) AS d FROM ed GROUP BY target)
    SELECT ed.target AS node, round(sum(sign * weight / sqrt(d) * rep[1]), 6) AS v0, round(sum(sign * weight / sqrt(d) * rep[2]), 6) AS v1,
    round(sum(sign * weight / sqrt(d) * rep[3]), 6) AS v2 FROM ed JOIN i ON ed.target = i.target JOIN reps ON reps.node = ed.source GROUP BY ed.target""")
def _(spark, sf):
    out = gr.propagate(load(spark, sf, "ed"), reps(spark, sf), dim=3)
    return rounded(out.select("node", *[F.col("rep")[i].alias(f"v{i}") for i in range(3)]))


@query("grf13_edge_score", f"""WITH {REPS} SELECT source, target, sign, round(1 / (1 + exp(-sign * (a.rep[1] * b.rep[1] + a.rep[2] * b.rep[2] + a.rep[3] * b.rep[3]))), 6) AS likelihood
    FROM ed JOIN reps a ON a.node = source JOIN reps b ON b.node = target""")
def _(spark, sf):
    return rounded(gr.edge_score(load(spark, sf, "ed").select("source", "target", "sign"), reps(spark, sf)))


@query("grf14_sample_edges")
def _(spark, sf):
    return gr.sample_edges(load(spark, sf, "ed"), neg_samples=2, seed=7)


@query("grf14_invariants", """WITH n AS (SELECT CAST(round_even(sum(weight), 0) AS BIGINT) AS n FROM ed) SELECT n AS positives, 2 * n AS negatives, CAST(0 AS BIGINT) AS unknown_positives,
    CAST(0 AS BIGINT) AS known_negatives, CAST(0 AS BIGINT) AS broken_copies FROM n""")
def _(spark, sf):
    ed = load(spark, sf, "ed")
    return _sampled(ed, gr.sample_edges(ed, neg_samples=2, seed=7))


DENSE = "SELECT concat('n', a.p_size) AS source, concat('n', b.p_size) AS target, CAST(a.p_size AS DOUBLE) / 50 AS weight, 1 AS sign FROM {0} a CROSS JOIN {0} b WHERE (a.p_size * 7 + b.p_size * 3) % 20 <> 0"


@query("grf14_dense_graph", f"WITH s AS (SELECT DISTINCT p_size FROM part), e AS ({DENSE.format('s')}), " + """n AS (SELECT CAST(round_even(sum(weight), 0) AS BIGINT) AS n FROM e)
    SELECT n AS positives, 3 * n AS negatives, CAST(0 AS BIGINT) AS unknown_positives, CAST(0 AS BIGINT) AS known_negatives, CAST(0 AS BIGINT) AS broken_copies FROM n""")
def _(spark, sf):
    """Edges between 95 of 100 pairs of nodes."""
    load(spark, sf, "part").select("p_size").distinct().createOrReplaceTempView("dense_sizes")
    dense = spark.sql(DENSE.format("dense_sizes"))
    return _sampled(dense, gr.sample_edges(dense, neg_samples=3, seed=1))


SAMPLED = ["positives", "negatives", "unknown_positives", "known_negatives", "broken_copies"]


def _sampled(edges, out):
    """Counts that hold whatever was drawn. Rows go in packed blocks to a task of their (source, target, sign), with the known edges, and to one of their draw."""
    positive, key = F.col("copy") == -1, ["source", "target", "sign"]
    known = edges.select(*key).dropna()
    tasks = task_count(edges.sparkSession, 4 * edges.count())
    link, nothing = F.pmod(hash_key(*key, seed=23), F.lit(tasks)).cast("int").alias("_task"), F.lit(None).cast("string").alias("target")
    off = F.when(positive, 1).otherwise(2), F.when(positive, 3).otherwise(5) + F.coalesce(F.col("weight") != positive.cast("double"), F.lit(False)).cast("int")
    twice = F.array(F.struct(link, *key, F.lit(0).cast("long").alias("draw"), off[0].alias("kind")),
                    F.struct((F.pmod("draw", F.lit(tasks)).cast("int") + tasks).alias("_task"), "source", nothing, "sign", "draw", off[1].alias("kind")))
    seen = out.select(F.inline(twice)).unionByName(known.select(link, *key, F.lit(0).cast("long").alias("draw"), F.lit(0).alias("kind")))

    def count(blocks):
        """The counts of one task, by links (known edges: kind 0, positives: 1, negatives: 2) or by draws (positives: 3, negatives: 5, one more for a wrong weight)."""
        held, task = [], 0
        for task, _, t in blocks:
            held.append(t)
        if not held:
            return
        t, counts = pa.concat_tables(held), [0] * len(SAMPLED)
        kind, n = t.column("kind").to_numpy(), t.column("_n").to_numpy()
        if task < tasks:
            t = t.select(key)
            for k, c in enumerate("kpn"):
                t = t.append_column(c, pa.array(np.where(kind == k, n, 0)))
            sums = t.group_by(key, use_threads=False).aggregate([("k", "sum"), ("p", "sum"), ("n", "sum")])
            k, p, q = (sums.column(f"{c}_sum").to_numpy() for c in "kpn")
            counts[:4] = p.sum(), q.sum(), p[k == 0].sum(), q[k > 0].sum()
        else:
            own = t.filter(pa.array(kind < 5)).select(["draw", "source", "sign"]).rename_columns(["draw", "s0", "g0"])
            rows = t.select(["draw", "source", "sign", "_n"]).append_column("off", pa.array(kind % 2 == 0)).join(own, "draw", join_type="left outer", use_threads=False)
            moved = pc.or_kleene(pc.not_equal(rows.column("source"), rows.column("s0")), pc.not_equal(rows.column("sign"), rows.column("g0")))
            broken = pc.fill_null(pc.or_kleene(moved, rows.column("off")), False)
            counts[4] = rows.column("_n").to_numpy()[broken.to_numpy()].sum()
        yield pa.RecordBatch.from_arrays([pa.array([int(c)]) for c in counts], names=SAMPLED)

    parts = dealt(packed(seen, ["draw", "source", "target", "sign"], tally=True), 2 * tasks, count, ", ".join(f"{c} long" for c in SAMPLED))
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SAMPLED])


@query("grf15_validate_edges", """SELECT count(*) FILTER (WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
    OR l_partkey NOT IN (SELECT p_partkey FROM part)) AS missing_vertices, count(*) FILTER (WHERE l_tax <= 0 OR l_tax > 1) AS invalid_weights,
    count(*) FILTER (WHERE l_linenumber NOT IN (1, -1)) AS invalid_signs, count(*) AS n_edges FROM lineitem""")
def _(spark, sf):
    e = load(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"),
                                           F.col("l_tax").alias("weight"), F.col("l_linenumber").alias("sign"))
    v = load(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node")).unionByName(
        load(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node")))
    return gr.validate_edges(e, v)


@query("grf16_edge_product", """SELECT ed.source, ed2.target, CAST(count(*) AS DOUBLE) AS weight FROM ed JOIN ed2 ON ed.target = ed2.source GROUP BY 1, 2""")
def _(spark, sf):
    return gr.edge_product(load(spark, sf, "ed"), load(spark, sf, "ed2"))


@query("grf17_convert_features", """WITH m AS (SELECT CAST(l_orderkey AS VARCHAR) AS cell, concat('s', l_suppkey) AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
    c AS (SELECT concat('s', l_suppkey) AS source, l_returnflag AS target, sum(1 - l_discount) * sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS w FROM lineitem GROUP BY 1, 2)
    SELECT cell, target AS feature, round(sum(value * w), 4) AS value FROM m JOIN c ON m.feature = c.source GROUP BY 1, 2""")
def _(spark, sf):
    li = load(spark, sf, "lineitem")
    m = li.groupBy(F.col("l_orderkey").cast("string").alias("cell"), F.concat(F.lit("s"), "l_suppkey").alias("feature")).agg(F.sum("l_quantity").alias("value"))
    e = li.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.col("l_returnflag").alias("target"), (1 - F.col("l_discount")).alias("weight"),
                  F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("sign"))
    return rounded(gr.convert_features(m, e), 4)


@query("grf18_match_graph", """SELECT p_name AS source, concat('id', p_partkey) AS target, 1.0 AS weight, 1 AS sign, 'rev' AS type FROM part
    UNION ALL SELECT concat('id', p_partkey), p_name, 1.0, 1, 'fwd' FROM part UNION ALL SELECT f, f, 1.0, 1, 'loop' FROM
    (SELECT p_name AS f FROM part UNION SELECT concat('id', p_partkey) FROM part)""".replace("1.0", "CAST(1.0 AS DOUBLE)"))
def _(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_name").alias("key"), F.concat(F.lit("id"), "p_partkey").alias("value"))
    return gr.match_graph(p, p.select(F.col("key").alias("feature")), p.select(F.col("value").alias("feature")))


@query("grf19_suffix_edges", """SELECT s AS source, concat(s, x) AS target, CAST(1 AS DOUBLE) AS weight, -1 AS sign FROM
    (SELECT concat('g', p_partkey) AS s, CASE WHEN p_size > 25 THEN '_mCH' ELSE '_mCG' END AS x FROM part)""")
def _(spark, sf):
    f = load(spark, sf, "part").select(F.concat(F.lit("g"), "p_partkey", F.when(F.col("p_size") > 25, "_mCH").otherwise("_mCG")).alias("feature"))
    return gr.suffix_edges(f, ["_mCH", "_mCG"])


@query("grf20_evidence_graph", """WITH g AS (SELECT source, target, weight, type FROM ed UNION ALL SELECT concat('s', l_suppkey), concat('p', l_partkey), 1 - l_tax, 'tax' FROM lineitem),
    r AS (SELECT concat('s', s_suppkey) AS node FROM supplier WHERE s_acctbal > 5000 UNION
    SELECT target FROM g JOIN supplier ON source = concat('s', s_suppkey) WHERE s_acctbal > 5000),
    a AS (SELECT source, target, weight, type, 1 AS sign FROM g UNION ALL SELECT target, source, weight, type, 1 FROM g
    UNION ALL SELECT concat('p', p_partkey), concat('p', p_partkey), 1.0, 'loop', 1 FROM part UNION ALL SELECT concat('s', s_suppkey), concat('s', s_suppkey), 1.0, 'loop', 1 FROM supplier)
    SELECT * FROM a WHERE source IN (SELECT node FROM r) AND target IN (SELECT node FROM r)""")
def _(spark, sf):
    ed = load(spark, sf, "ed").select("source", "target", "weight", "type")
    tax = load(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"),
                                             (1 - F.col("l_tax")).alias("weight"), F.lit("tax").alias("type"))
    sup = load(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("feature"), "s_acctbal")
    feats = sup.select("feature").unionByName(load(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("feature")))
    return gr.evidence_graph([ed, tax], sup.where("s_acctbal > 5000"), feats)


@query("grf21_edge_intersection", """SELECT source, target FROM ed WHERE weight > 0.95 INTERSECT SELECT source, target FROM ed WHERE sign = -1
    INTERSECT SELECT source, target FROM ed WHERE dist > 10""")
def _(spark, sf):
    ed = load(spark, sf, "ed")
    return gr.edge_intersection(ed.where("weight > 0.95"), ed.where("sign = -1"), ed.where("dist > 10"))


@query("grf22_drop_edges", """WITH b AS (SELECT DISTINCT source, target FROM ed WHERE sign = -1)
    SELECT source, target, type, weight FROM ed WHERE type = 'O' OR NOT EXISTS (SELECT 1 FROM b WHERE b.source = ed.source AND b.target = ed.target)""")
def _(spark, sf):
    ed = load(spark, sf, "ed").select("source", "target", "type", "weight", "sign")
    return gr.drop_edges(ed, gr.reverse(ed.where("sign = -1")), ["O"]).drop("sign")


@query("grf23_invariants", """WITH n AS (SELECT count(*) AS n, CAST(round_even(0.1 * count(*), 0) AS BIGINT) AS b FROM ed) SELECT n AS edges, b AS new_edges,
    (SELECT round(sum(weight), 4) FROM ed) AS weights FROM n""")
def _(spark, sf):
    """Size and attributes stay; so many pairs are new."""
    ed = load(spark, sf, "ed")
    out = gr.corrupt_edges(ed, 0.1, ed.select(F.col("source").alias("node")), ed.select(F.col("target").alias("node")), seed=3)
    new = out.join(ed.select("source", "target").distinct().withColumn("known", F.lit(True)), ["source", "target"], "left")
    return new.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("known").isNull()).alias("new_edges"), F.round(F.sum("weight"), 4).alias("weights"))


@query("grf04_chain", "SELECT concat('n', k) AS node FROM (SELECT p_partkey % 1000 AS k FROM part UNION SELECT 5) WHERE k >= 5")
def _(spark, sf):
    """Nodes behind the fifth of a chain of a thousand, one part a link."""
    links = load(spark, sf, "part").select((F.col("p_partkey") % 1000).alias("k")).distinct().where("k > 0")
    chain = links.select(F.concat(F.lit("n"), F.col("k") - 1).alias("source"), F.concat(F.lit("n"), "k").alias("target"))
    return gr.reachable(chain, spark.sql("SELECT 'n5' AS node"))


@query("grf23_corrupt_edges")
def _(spark, sf):
    ed = load(spark, sf, "ed")
    return gr.corrupt_edges(ed, 0.1, ed.select(F.col("source").alias("node")), ed.select(F.col("target").alias("node")), seed=3)


def features(spark, sf, view, hv):
    return load(spark, sf, view).select(F.col("name").alias("feature"), "chrom", "chromStart", "chromEnd", "score", "strand", hv.alias("highly_variable"))


GUI = """WITH pk AS (SELECT *, {sign} AS sign FROM peaks_u),
    a AS (SELECT name, chrom, {bounds} FROM anchors), f AS (SELECT a.name AS source, p.name AS target, abs({dist}) AS dist, sign FROM a JOIN pk p
    ON a.chrom = p.chrom AND a.chromStart - {w} < p.chromEnd AND p.chromStart < a.chromEnd + {w}),
    g AS (SELECT source, target, dist, round(power((dist + 1000.0) / 1000.0, -0.75), 6) AS weight, sign FROM f)
    SELECT source, target, dist, weight, sign, 'fwd' AS type FROM g UNION ALL SELECT target, source, dist, weight, sign, 'rev' FROM g
    UNION ALL SELECT name, name, CAST(NULL AS BIGINT), CAST(1 AS DOUBLE), 1, 'loop' FROM a UNION ALL SELECT name, name, NULL, 1, 1, 'loop' FROM pk"""
COMBINED = """CASE WHEN strand = '+' THEN greatest(chromStart - 200, 0) ELSE greatest(chromStart, 0) END AS chromStart,
    CASE WHEN strand = '+' THEN chromEnd ELSE chromEnd + 200 END AS chromEnd"""
PROMOTER = """CASE WHEN strand = '+' THEN greatest(chromStart - 200, 0) ELSE greatest(chromEnd - 1, 0) END AS chromStart,
    CASE WHEN strand = '+' THEN chromStart + 1 ELSE chromEnd + 200 END AS chromEnd"""
BY_LENGTH = "CASE WHEN chromEnd - chromStart <= 30 THEN 1 ELSE -1 END"


@query("gui01_rna_anchored_graph", GUI.format(bounds=COMBINED, dist=DIST, w=50, sign=-1))
def _(spark, sf):
    rna = features(spark, sf, "anchors", F.col("chromStart") > 0)
    return rounded(rna_anchored_guidance_graph(rna, features(spark, sf, "peaks_u", F.lit(True)), promoter_len=200, extend_range=50, signs=[-1],
                                               propagate_highly_variable=False)[0])


def _two_datasets(spark, sf, **kw):
    """Short and long peaks as two datasets with different signs."""
    peaks, length = features(spark, sf, "peaks_u", F.lit(False)), F.col("chromEnd") - F.col("chromStart")
    return rna_anchored_guidance_graph(features(spark, sf, "anchors", F.col("strand") == "+"), peaks.where(length <= 30), peaks.where(length > 30), signs=[1, -1], **kw)


@query("gui01_promoter_two_datasets", GUI.format(bounds=PROMOTER, dist=DIST, w=25, sign=BY_LENGTH))
def _(spark, sf):
    return rounded(_two_datasets(spark, sf, gene_region="promoter", promoter_len=200, extend_range=25, propagate_highly_variable=False)[0])


@query("gui01_gene_body_two_datasets", GUI.format(bounds="chromStart, chromEnd", dist=DIST, w=0, sign=BY_LENGTH))
def _(spark, sf):
    return rounded(_two_datasets(spark, sf, gene_region="gene_body")[0])


@query("gui01_propagated_flags", f"""WITH a AS (SELECT name, chrom, {COMBINED} FROM anchors WHERE strand = '+'),
    h AS (SELECT DISTINCT p.name FROM peaks_u p JOIN a ON a.chrom = p.chrom AND a.chromStart < p.chromEnd AND p.chromStart < a.chromEnd)
    SELECT p.name AS feature, h.name IS NOT NULL AS highly_variable FROM peaks_u p LEFT JOIN h ON h.name = p.name""")
def _(spark, sf):
    short, long = _two_datasets(spark, sf, promoter_len=200)[1]
    return short.unionByName(long).select("feature", "highly_variable")


@query("gui02_anchored_graph", GUI.format(bounds="chromStart, chromEnd", dist=DIST, w=40, sign=1))
def _(spark, sf):
    anchor = features(spark, sf, "anchors", F.lit(True))
    return rounded(anchored_guidance_graph(anchor, features(spark, sf, "peaks_u", F.lit(True)), extend_range=40, propagate_highly_variable=False)[0])
