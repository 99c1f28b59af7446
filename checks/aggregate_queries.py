"""AGG-* and SKL-* queries."""

from pyspark.sql import functions as F

from checks.matrix_queries import GRID, RANKED, cells, my
from checks.registry import query, rounded
from checks.views import load
from strandloom.functions.runtime import cut_lineage
from strandloom.operators import aggregate as ag
from strandloom.operators import matrix as mt
from strandloom.operators import skeleton as sk


def tagged(spark, sf):
    """Customers with a multi-valued group: segment, and nation for the rich ones."""
    return load(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("cell"), "c_acctbal", "c_nationkey",
        F.when(F.col("c_acctbal") < 0, None).when(F.col("c_acctbal") > 8000, F.concat_ws(",", "c_mktsegment", F.concat(F.lit("n"), "c_nationkey"), "c_mktsegment"))
        .otherwise(F.col("c_mktsegment")).alias("grp"))


TAG = """t AS (SELECT CAST(c_custkey AS VARCHAR) AS cell, c_acctbal, c_nationkey, g FROM (SELECT *, unnest(CASE WHEN c_acctbal > 8000 THEN [c_mktsegment, concat('n', c_nationkey)]
    ELSE [c_mktsegment] END) AS g FROM customer WHERE c_acctbal >= 0))"""


@query("agg01_aggregate_obs_sum", f"WITH {TAG} SELECT g AS cell, feature, sum(value) AS value FROM mx JOIN t ON mx.cell = t.cell GROUP BY g, feature")
def _(spark, sf):
    return ag.aggregate_obs(load(spark, sf, "mx"), tagged(spark, sf), "grp")[0]


@query("agg01_aggregate_obs_mean", f"""WITH {TAG}, n AS (SELECT g, count(*) AS n FROM t GROUP BY g) SELECT t.g AS cell, feature, round(sum(value) / any_value(n), 6) AS value,
    round(avg(value), 6) AS stored FROM mx JOIN t ON mx.cell = t.cell JOIN n ON n.g = t.g GROUP BY t.g, feature""")
def _(spark, sf):
    m, c = load(spark, sf, "mx"), tagged(spark, sf)
    stored = ag.aggregate_obs(m, c, "grp", X_agg="mean", nan_sparse=True)[0].withColumnRenamed("value", "stored")
    return rounded(ag.aggregate_obs(m, c, "grp", X_agg="mean")[0].join(stored, ["cell", "feature"]))


@query("agg01_aggregate_obs_cells", """SELECT CAST(label AS VARCHAR) AS cell, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS r0, round(avg(CAST(embedding[64] AS DOUBLE)), 6) AS r63, CAST(sum(vec_id % 3) AS BIGINT) AS batch_sum,
    (SELECT CAST(b AS VARCHAR) FROM (SELECT vec_id % 3 AS b, count(*) AS n FROM embeddings e WHERE e.label = o.label GROUP BY 1 ORDER BY n DESC, b LIMIT 1)) AS batch FROM embeddings o GROUP BY label""")
def _(spark, sf):
    c = load(spark, sf, "cells").withColumn("batch_sum", F.col("batch").cast("long"))
    out = ag.aggregate_obs(None, c, "cell_type", obs_agg={"batch_sum": "sum", "batch": "majority"}, obsm_agg={"rep": "mean"})[1]
    return rounded(out.select("cell", F.col("rep")[0].alias("r0"), F.col("rep")[63].alias("r63"), "batch_sum", "batch"))


@query("agg02_majority", """SELECT c_nationkey, c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r
    FROM customer GROUP BY 1, 2) WHERE r = 1""")
def _(spark, sf):
    return ag.majority(load(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


@query("agg03_aggregate_var", """WITH f AS (SELECT DISTINCT p_brand AS feature, substr(p_brand, 1, 7) AS g FROM part), n AS (SELECT g, count(*) AS n FROM f GROUP BY g)
    SELECT cell, f.g AS feature, round(sum(value) / any_value(n), 6) AS value FROM mx JOIN f ON mx.feature = f.feature JOIN n ON n.g = f.g GROUP BY cell, f.g""")
def _(spark, sf):
    f = load(spark, sf, "part").select(F.col("p_brand").alias("feature"), F.substring("p_brand", 1, 7).alias("g")).distinct()
    return rounded(ag.aggregate_var(load(spark, sf, "mx"), f, "g", X_agg="mean")[0])


def two(spark, sf):
    """Two modalities over the embedded cells: counts per token length class of conversations are
    too thin, so lineitem quantities by brand and by type play the features."""
    c = load(spark, sf, "cells").select("cell", "rep", "cell_type")
    li, p = load(spark, sf, "lineitem"), load(spark, sf, "part")
    j = li.join(p, li.l_partkey == p.p_partkey).withColumn("cell", F.pmod("l_orderkey", F.lit(c.count())).cast("string"))
    a = j.groupBy("cell", F.concat(F.lit("g"), "p_brand").alias("feature")).agg(F.sum("l_quantity").alias("value"))
    b = j.groupBy("cell", F.concat(F.lit("t"), "p_type").alias("feature")).agg(F.sum("l_quantity").alias("value"))
    return (a, c), (b, c)


def skeleton(spark, sf):
    return load(spark, sf, "part").groupBy(F.concat(F.lit("g"), "p_brand").alias("source"), F.concat(F.lit("t"), "p_type").alias("target")).agg(
        F.min(F.col("p_size") / 50).alias("weight")).withColumn("sign", F.lit(1))


@query("agg04_metacells")
def _(spark, sf):
    out = ag.metacells(*two(spark, sf), use_rep="rep", n_meta=20)
    return out[0][0].unionByName(out[1][0])


@query("agg04_metacell_totals", """SELECT sum(l_quantity) AS total_a, sum(l_quantity) AS total_b FROM lineitem""")
def _(spark, sf):
    out = ag.metacells(*two(spark, sf), use_rep="rep", n_meta=20, common=False)
    return out[0][0].agg(F.sum("value").alias("total_a")).withColumn("total_b", out[1][0].agg(F.sum("value")).scalar())


@query("agg05_metacells_paired")
def _(spark, sf):
    a, b = two(spark, sf)
    out = ag.metacells_paired(a, b, "rep", 15)
    return out[0][0].unionByName(out[1][0])


MAJ = """(SELECT {g} AS cell, v AS cell_type FROM (SELECT {g}, {v} AS v, row_number() OVER (PARTITION BY {g} ORDER BY count(*) DESC, {v}) AS r FROM {t} GROUP BY 1, 2) WHERE r = 1)"""


@query("agg06_consistent_groups", f"""SELECT x.cell, x.cell_type FROM {MAJ.format(g='l_suppkey', v='l_returnflag', t='lineitem')} x
    JOIN {MAJ.format(g='l_suppkey', v="l_returnflag", t="(SELECT * FROM lineitem WHERE l_linestatus = 'O')")} y ON x.cell = y.cell AND x.cell_type = y.cell_type""")
def _(spark, sf):
    li = load(spark, sf, "lineitem")
    t = [ag.majority(x, "l_suppkey", "l_returnflag").toDF("cell", "cell_type") for x in (li, li.where("l_linestatus = 'O'"))]
    return ag.consistent_groups(*t)


@query("agg07_group_fractions", """WITH a AS (SELECT c_mktsegment AS k, count(*) * 1.0 / (SELECT count(*) FROM customer WHERE c_nationkey < 12) AS f FROM customer WHERE c_nationkey < 12 GROUP BY 1),
    b AS (SELECT c_mktsegment AS k, count(*) * 1.0 / (SELECT count(*) FROM customer WHERE c_nationkey >= 12 AND c_mktsegment <> 'BUILDING') AS f FROM customer WHERE c_nationkey >= 12 AND c_mktsegment <> 'BUILDING' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS c_mktsegment, round(coalesce(a.f, 0), 6) AS frac_a, round(coalesce(b.f, 0), 6) AS frac_b FROM a FULL JOIN b ON a.k = b.k""")
def _(spark, sf):
    c = load(spark, sf, "customer")
    return rounded(ag.group_fractions(c.where("c_nationkey < 12"), c.where("c_nationkey >= 12 AND c_mktsegment <> 'BUILDING'"), "c_mktsegment"))


@query("agg08_crosstab_long", """WITH t AS (SELECT CAST(p_size AS VARCHAR) AS l, concat(p_brand, p_type) AS r FROM part) SELECT l.l AS "left", r.r AS "right", count(t.l) AS value FROM (SELECT DISTINCT l FROM t) l CROSS JOIN (SELECT DISTINCT r FROM t) r
    LEFT JOIN t ON t.l = l.l AND t.r = r.r GROUP BY 1, 2""")
def _(spark, sf):
    return ag.crosstab_long(load(spark, sf, "part").withColumn("bt", F.concat("p_brand", "p_type")), "p_size", "bt")




@query("skl01_skeleton_corr_spr", f"""{RANKED}, b AS (SELECT c_custkey, concat('y_', feature) AS feature, y FROM r), sk AS (SELECT DISTINCT p_brand AS source, concat('y_', 'Brand#', 10 + p_size) AS target FROM part)
    SELECT sk.source, sk.target, round(corr(r.x, b.y), 6) AS corr FROM sk JOIN r ON r.feature = sk.source JOIN b ON b.feature = sk.target AND b.c_custkey = r.c_custkey GROUP BY 1, 2""")
def _(spark, sf):
    return _corr(spark, sf, "spr")


@query("skl01_skeleton_corr_pcc", f"""WITH {GRID}, b AS (SELECT c_custkey, concat('y_', feature) AS feature, y FROM g), sk AS (SELECT DISTINCT p_brand AS source, concat('y_', 'Brand#', 10 + p_size) AS target FROM part)
    SELECT sk.source, sk.target, round(corr(g.x, b.y), 6) AS corr FROM sk JOIN g ON g.feature = sk.source JOIN b ON b.feature = sk.target AND b.c_custkey = g.c_custkey GROUP BY 1, 2""")
def _(spark, sf):
    return _corr(spark, sf, "pcc")


def _corr(spark, sf, method):
    b = my(spark, sf).withColumn("feature", F.concat(F.lit("y_"), "feature"))
    known = b.select(F.col("feature").alias("target")).distinct()
    skel = load(spark, sf, "part").select(F.col("p_brand").alias("source"), F.concat(F.lit("y_Brand#"), (F.col("p_size") + 10).cast("string")).alias("target")).distinct()
    return rounded(sk.skeleton_corr([load(spark, sf, "mx"), b], skel.join(known, "target", "left_semi"), cells(spark, sf), method))


@query("skl02_metacell_corr")
def _(spark, sf):
    return sk.metacell_corr(*two(spark, sf), skeleton=skeleton(spark, sf), use_rep="rep", n_meta=30, agg_fns=["sum", "sum"], prep_fns=[mt.count_prep, mt.count_prep])


@query("skl03_skeleton_regr_linear", """WITH ta AS (SELECT cell, sum(value) AS t FROM mxs GROUP BY cell), tb AS (SELECT cell, sum(value) AS t FROM mxt GROUP BY cell),
    a AS (SELECT mxs.cell, feature, ln(1 + value * (SELECT median(t) FROM ta) / t) AS v FROM mxs JOIN ta ON ta.cell = mxs.cell),
    b AS (SELECT mxt.cell, feature, ln(1 + value * (SELECT median(t) FROM tb) / t) AS v FROM mxt JOIN tb ON tb.cell = mxt.cell),
    one AS (SELECT feature AS target, max(source) AS source FROM (SELECT a2.feature AS source, b2.feature FROM (SELECT DISTINCT feature FROM a) a2 CROSS JOIN (SELECT DISTINCT feature FROM b) b2) GROUP BY feature)
    SELECT one.source, one.target, round(regr_slope(b.v, a.v), 6) AS regr FROM one JOIN a ON a.feature = one.source JOIN b ON b.feature = one.target AND b.cell = a.cell GROUP BY 1, 2""")
def _(spark, sf):
    a, b = load(spark, sf, "mxs").select("cell", "feature", "value"), load(spark, sf, "mxt")
    skel = b.select(F.col("feature").alias("target")).distinct().withColumn("source", a.agg(F.max("feature")).scalar())
    return rounded(sk.skeleton_regr([a, b], skel, a.select("cell").distinct(), "LinearRegression"))


@query("skl03_skeleton_regr_lasso")
def _(spark, sf):
    a, b = load(spark, sf, "mxs").select("cell", "feature", "value"), load(spark, sf, "mxt")
    skel = load(spark, sf, "part").select(F.col("p_brand").alias("source"), F.concat(F.lit("t_"), "p_type").alias("target")).distinct()
    return sk.skeleton_regr([a, b], skel, a.select("cell").distinct(), "Lasso", alpha=0.01)


SINGLE = """WITH ta AS (SELECT cell, sum(value) AS t FROM mxs GROUP BY cell), tb AS (SELECT cell, sum(value) AS t FROM mxt GROUP BY cell),
    a AS (SELECT mxs.cell, feature, ln(1 + value * (SELECT median(t) FROM ta) / t) AS v FROM mxs JOIN ta ON ta.cell = mxs.cell),
    b AS (SELECT mxt.cell, feature, ln(1 + value * (SELECT median(t) FROM tb) / t) AS v FROM mxt JOIN tb ON tb.cell = mxt.cell),
    ce AS (SELECT DISTINCT cell FROM mxs), one AS (SELECT max(feature) AS source FROM a), fe AS (SELECT DISTINCT feature AS target FROM b),
    g AS (SELECT source, target, ce.cell, coalesce(a.v, 0) AS x, coalesce(b.v, 0) AS y FROM one CROSS JOIN fe CROSS JOIN ce LEFT JOIN a ON a.cell = ce.cell AND a.feature = source LEFT JOIN b ON b.cell = ce.cell AND b.feature = target),
    m AS (SELECT source, target, covar_pop(y, x) AS c, var_pop(x) AS q FROM g GROUP BY source, target)
    SELECT source, target, round(sign(c) * greatest(abs(c) - {l1}, 0) / (q + {l2}), 6) AS regr FROM m"""


def _single(spark, sf, model, **kw):
    a, b = load(spark, sf, "mxs").select("cell", "feature", "value"), load(spark, sf, "mxt")
    skel = b.select(F.col("feature").alias("target")).distinct().withColumn("source", a.agg(F.max("feature")).scalar())
    return rounded(sk.skeleton_regr([a, b], skel, a.select("cell").distinct(), model, **kw))


@query("skl03_lasso_single", SINGLE.format(l1="0.001", l2="0"))
def _(spark, sf):
    return _single(spark, sf, "Lasso", alpha=0.001)


@query("skl03_elastic_net_single", SINGLE.format(l1="0.0008", l2="0.0012"))
def _(spark, sf):
    return _single(spark, sf, "ElasticNet", alpha=0.002, l1_ratio=0.4)


def optimal(x, edges, cells, alpha):
    """(target, n_edges, optimal): whether each target's coefficients meet the Lasso's optimality conditions, by joins and sums over the data."""
    n = cells.count()
    named = x.select("cell", F.col("feature").alias("source"), "value")
    fit = edges.join(named, "source").groupBy("target", "cell").agg(F.sum(F.col("regr") * F.col("value")).alias("f"))
    grid = edges.select("target").distinct().crossJoin(cells.select("cell")).join(x.select("cell", F.col("feature").alias("target"), F.col("value").alias("y")), ["target", "cell"], "left")
    rest = grid.join(fit, ["target", "cell"], "left").select("target", "cell", (F.coalesce("y", F.lit(0.0)) - F.coalesce("f", F.lit(0.0))).alias("r"))
    rest = rest.join(rest.groupBy("target").agg(F.avg("r").alias("m")), "target").select("target", "cell", (F.col("r") - F.col("m")).alias("r"))
    slope = edges.join(named, "source").join(rest, ["target", "cell"]).groupBy("source", "target").agg((F.sum(F.col("value") * F.col("r")) / n).alias("g"))
    both = edges.join(slope, ["source", "target"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    ok = (F.abs("g") <= alpha + 1e-7) & ((F.col("regr") == 0) | (F.abs(F.col("g") - alpha * F.signum("regr")) <= 1e-7))
    return both.groupBy("target").agg(F.count(F.lit(1)).alias("n_edges"), F.bool_and(ok).alias("optimal"))


@query("skl03_lasso_optimality", "SELECT concat('t_', p_type) AS target, count(DISTINCT p_brand) AS n_edges, true AS optimal FROM part GROUP BY p_type")
def _(spark, sf):
    a, b = load(spark, sf, "mxs").select("cell", "feature", "value"), load(spark, sf, "mxt")
    skel = load(spark, sf, "part").select(F.col("p_brand").alias("source"), F.concat(F.lit("t_"), "p_type").alias("target")).distinct()
    c = a.select("cell").distinct()
    w = cut_lineage(sk.skeleton_regr([a, b], skel, c, "Lasso", alpha=0.001))
    return optimal(mt.count_prep(a).unionByName(mt.count_prep(b)), w, c, 0.001)


@query("skl04_optimality", "SELECT concat('t', p_type) AS target, count(DISTINCT p_brand) AS n_edges, true AS optimal FROM part GROUP BY p_type")
def _(spark, sf):
    data, skel = two(spark, sf), skeleton(spark, sf)
    w = cut_lineage(sk.metacell_regr(*data, use_rep="rep", n_meta=40, skeleton=skel, alpha=0.001))
    meta = ag.metacells(*data, use_rep="rep", n_meta=40, common=True)
    x = mt.count_prep(meta[0][0]).unionByName(mt.count_prep(meta[1][0]))
    return optimal(cut_lineage(x.select("cell", "feature", "value")), w, meta[0][1], 0.001)


@query("skl04_metacell_regr")
def _(spark, sf):
    return sk.metacell_regr(*two(spark, sf), use_rep="rep", n_meta=40, skeleton=skeleton(spark, sf), alpha=0.01)


@query("skl05_feature_spearman", f"{RANKED} SELECT feature, round(corr(x, y), 6) AS corr FROM r GROUP BY feature")
def _(spark, sf):
    return rounded(sk.feature_spearman(load(spark, sf, "mx"), my(spark, sf), cells(spark, sf)))


@query("skl06_feature_r2", f"WITH {GRID} SELECT feature, round(regr_r2(y, x), 6) AS r2 FROM g GROUP BY feature")
def _(spark, sf):
    return rounded(sk.feature_r2(my(spark, sf), {"x": load(spark, sf, "mx")}, cells(spark, sf)))


@query("skl06_feature_r2_groups")
def _(spark, sf):
    mx = load(spark, sf, "mx")
    return sk.feature_r2(my(spark, sf), {"x": mx, "xx": mx.withColumn("value", F.col("value") * F.col("value"))}, cells(spark, sf), groups="cell_type", size=10)


@query("skl07_integration_consistency")
def _(spark, sf):
    return sk.integration_consistency(two(spark, sf), skeleton(spark, sf), "rep")
