"""MAT-* queries."""

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.views import load
from strandloom.operators import matrix as mt

N = "(SELECT count(*) FROM customer)"
# y: a second matrix over the same cells and features as mx
MY = """(SELECT CAST(o_custkey AS VARCHAR) AS cell, p_brand AS feature, sum(l_extendedprice) / 1000 AS value FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand)"""
GRID = f"""g AS (SELECT c.c_custkey, f.feature, coalesce(mx.value, 0) AS x, coalesce(y.value, 0) AS y FROM customer c CROSS JOIN (SELECT DISTINCT feature FROM mx) f
    LEFT JOIN mx ON mx.cell = CAST(c_custkey AS VARCHAR) AND mx.feature = f.feature LEFT JOIN {MY} y ON y.cell = CAST(c_custkey AS VARCHAR) AND y.feature = f.feature)"""
RANKED = f"""WITH {GRID}, r AS (SELECT c_custkey, feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS y FROM g)"""


def my(spark, sf):
    li, o, p = load(spark, sf, "lineitem"), load(spark, sf, "orders"), load(spark, sf, "part")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.groupBy(F.col("o_custkey").cast("string").alias("cell"), F.col("p_brand").alias("feature")).agg((F.sum("l_extendedprice") / 1000).alias("value"))


def cells(spark, sf):
    return load(spark, sf, "mx_cells")


@query("mat01_count_prep", """WITH t AS (SELECT cell, sum(value) AS t FROM mx GROUP BY cell) SELECT mx.cell, feature, round(ln(1 + value * (SELECT median(t) FROM t) / t), 6) AS value
    FROM mx JOIN t ON mx.cell = t.cell""")
def _(spark, sf):
    return rounded(mt.count_prep(load(spark, sf, "mx")))


@query("mat02_lognorm", """SELECT cell, feature, round(ln(1 + value * 10000 / sum(value) OVER (PARTITION BY cell)), 6) AS value FROM mx""")
def _(spark, sf):
    return rounded(mt.lognorm(load(spark, sf, "mx")))


@query("mat03_all_counts", """SELECT bool_and(value >= 0 AND value = floor(value)) AS all_counts FROM mx UNION ALL
    SELECT bool_and(value >= 0 AND value = floor(value)) FROM mxt""")
def _(spark, sf):
    return mt.all_counts(load(spark, sf, "mx")).unionByName(mt.all_counts(load(spark, sf, "mxt")))


@query("mat04_col_var", f"""WITH {GRID} SELECT feature, round(var_samp(x), 5) AS var, round(covar_samp(x, y), 5) AS cov, round(var_pop(x), 5) AS var_b FROM g GROUP BY feature""")
def _(spark, sf):
    m, c = load(spark, sf, "mx"), cells(spark, sf)
    out = mt.col_var(m, cells=c).join(mt.col_var(m, my(spark, sf), cells=c).withColumnRenamed("var", "cov"), "feature").join(
        mt.col_var(m, cells=c, bias=True).withColumnRenamed("var", "var_b"), "feature")
    return rounded(out, 5)


@query("mat05_col_pcc", f"WITH {GRID} SELECT feature, round(corr(x, y), 6) AS corr FROM g GROUP BY feature")
def _(spark, sf):
    return rounded(mt.col_pcc(load(spark, sf, "mx"), my(spark, sf), cells(spark, sf)))


@query("mat06_col_spr", f"{RANKED} SELECT feature, round(corr(x, y), 6) AS corr FROM r GROUP BY feature")
def _(spark, sf):
    return rounded(mt.col_spr(load(spark, sf, "mx"), my(spark, sf), cells(spark, sf)))


@query("mat07_cov_mat", f"WITH {GRID} SELECT a.feature AS f1, b.feature AS f2, round(covar_samp(a.x, b.x), 5) AS cov FROM g a JOIN g b ON a.c_custkey = b.c_custkey GROUP BY 1, 2")
def _(spark, sf):
    return rounded(mt.cov_mat(load(spark, sf, "mx"), cells=cells(spark, sf)), 5)


@query("mat08_pcc_mat", f"""WITH {GRID} SELECT a.feature AS f1, b.feature AS f2, round(CASE WHEN a.feature = b.feature THEN 1.0 ELSE corr(a.x, b.x) END, 6) AS corr
    FROM g a JOIN g b ON a.c_custkey = b.c_custkey GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(mt.pcc_mat(load(spark, sf, "mx"), cells=cells(spark, sf)))


@query("mat08_pcc_cross", "SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS corr FROM mxs a JOIN mxt b ON a.cell = b.cell GROUP BY 1, 2")
def _(spark, sf):
    return rounded(mt.pcc_mat(load(spark, sf, "mxs"), load(spark, sf, "mxt")))


@query("mat09_spr_mat", f"{RANKED} SELECT a.feature AS f1, b.feature AS f2, round(CASE WHEN a.feature = b.feature THEN 1.0 ELSE corr(a.x, b.x) END, 6) AS corr FROM r a JOIN r b ON a.c_custkey = b.c_custkey GROUP BY 1, 2")
def _(spark, sf):
    return rounded(mt.spr_mat(load(spark, sf, "mx"), cells=cells(spark, sf)))


SEURAT = f"SELECT cell, feature, value / sum(value) OVER (PARTITION BY cell) * ({N} / sum(value) OVER (PARTITION BY feature)) AS v FROM mx"
ALLCOOLS = f"SELECT cell, feature, ln(1 + value / (sum(value) OVER (PARTITION BY cell) + 1e-5) * 1e5) * ln(1 + {N} / (sum(value) OVER (PARTITION BY feature) + 1e-5)) AS v FROM mx"


@query("mat10_tfidf", f"SELECT cell, feature, round(v, 6) AS value, 'seurat' AS flavor FROM ({SEURAT}) UNION ALL SELECT cell, feature, round(v, 6), 'allcools' FROM ({ALLCOOLS})")
def _(spark, sf):
    parts = [mt.tfidf(load(spark, sf, "mx"), f, cells=cells(spark, sf)).withColumn("flavor", F.lit(f)) for f in ("seurat", "allcools")]
    return rounded(parts[0].unionByName(parts[1]))


@query("mat11_tfidf_seurat", f"SELECT cell, feature, round(v, 6) AS value FROM ({SEURAT})")
def _(spark, sf):
    return rounded(mt.tfidf_seurat(load(spark, sf, "mx"), cells(spark, sf)))


@query("mat12_tfidf_allcools", f"SELECT feature, round(ln(1 + {N} / (sum(value) + 1e-5)), 6) AS idf FROM mx GROUP BY feature")
def _(spark, sf):
    return rounded(mt.tfidf_allcools(load(spark, sf, "mx"), cells=cells(spark, sf))[1])


@query("mat13_hypo_score", "SELECT cell, feature, round(1 - least(greatest(3 * mc / cov, 0), 1), 6) AS value FROM mxs WHERE cov <> 0")
def _(spark, sf):
    m = load(spark, sf, "mxs").withColumn("mc", 3 * F.col("mc"))
    return rounded(mt.hypo_score(m).select("cell", "feature", "value"))


@query("mat14_merge_mc_cov", "SELECT cell, feature, round(mc, 4) AS mc, cov FROM mxs")
def _(spark, sf):
    return mt.merge_mc_cov(load(spark, sf, "mxs")).select("cell", "feature", F.round("value.mc", 4).alias("mc"), F.col("value.cov").alias("cov"))


@query("mat15_methylation_rates", """SELECT cell, feature, round(mc / cov, 6) AS rate, round(sum(mc) OVER w / sum(cov) OVER w, 6) AS global_rate,
    round((mc / cov) / (sum(mc) OVER w / sum(cov) OVER w), 6) AS norm_rate FROM mxs WINDOW w AS (PARTITION BY cell)""")
def _(spark, sf):
    return rounded(mt.methylation_rates(load(spark, sf, "mxs")))


@query("mat16_scale", f"""WITH {GRID}, s AS (SELECT feature, avg(x) AS m, stddev_samp(x) AS sd FROM g JOIN customer USING (c_custkey) WHERE c_mktsegment = 'BUILDING' GROUP BY feature)
    SELECT CAST(c_custkey AS VARCHAR) AS cell, g.feature, round(least(greatest((x - m) / sd, -4), 4), 6) AS value FROM g JOIN s ON g.feature = s.feature""")
def _(spark, sf):
    c = cells(spark, sf)
    return rounded(mt.scale(load(spark, sf, "mx"), c, 4, mask=c.where("cell_type = 'BUILDING'")))


@query("mat17_filter_features", "SELECT cell, feature, value FROM mx WHERE feature IN (SELECT feature FROM mx GROUP BY feature HAVING sum(value) >= 60000)")
def _(spark, sf):
    return mt.filter_features(load(spark, sf, "mx"), 60000)


@query("mat18_filter_by_group_detection", """WITH d AS (SELECT feature, count(DISTINCT c_nationkey) AS h FROM (SELECT CAST(o_custkey AS VARCHAR) AS cell, concat(p_brand, p_type, p_size) AS feature FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) m JOIN customer ON cell = CAST(c_custkey AS VARCHAR) GROUP BY feature)
    SELECT feature, h FROM d WHERE h / (SELECT count(DISTINCT c_nationkey) FROM customer) > 0.5""")
def _(spark, sf):
    li, o, p = load(spark, sf, "lineitem"), load(spark, sf, "orders"), load(spark, sf, "part")
    m = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).groupBy(
        F.col("o_custkey").cast("string").alias("cell"), F.concat("p_brand", "p_type", "p_size").alias("feature")).agg(F.sum("l_quantity").alias("value"))
    c = cells(spark, sf)
    kept = mt.filter_by_group_detection(m, c, "batch", 0.5)
    return kept.join(c, "cell").groupBy("feature").agg(F.count_distinct("batch").alias("h"))


SV = """e AS (SELECT m.feature, m.value AS v, c.{grp} AS g FROM {mat} m JOIN {cells} c ON m.cell = c.cell), z AS (SELECT {grp} AS g, count(*) AS n FROM {cells} GROUP BY {grp}),
    st AS (SELECT e.g, feature, any_value(n) AS n, sum(v) / any_value(n) AS mean, (sum(v * v) / any_value(n) - (sum(v) / any_value(n)) ** 2) * any_value(n) / (any_value(n) - 1) AS var FROM e JOIN z ON e.g = z.g GROUP BY e.g, feature),
    ok AS (SELECT *, log10(mean) AS x, log10(var) AS y FROM st WHERE mean > 0 AND var > 1e-12),
    pr AS (SELECT a.g, a.feature, b.x - a.x AS d, b.y, row_number() OVER (PARTITION BY a.g, a.feature ORDER BY abs(b.x - a.x)) AS r, greatest(floor(count(*) OVER (PARTITION BY a.g, a.feature) * 0.3 + 1e-5), 3) AS q
        FROM ok a JOIN ok b ON a.g = b.g),
    bw AS (SELECT g, feature, max(abs(d)) AS h FROM pr WHERE r <= q GROUP BY g, feature),
    wt AS (SELECT pr.g, pr.feature, d / h AS d, y, (1 - (abs(d) / h) ** 3) ** 3 AS w FROM pr JOIN bw ON pr.g = bw.g AND pr.feature = bw.feature WHERE abs(d) < h),
    mo AS (SELECT g, feature, sum(w) AS s0, sum(w * d) AS s1, sum(w * d ** 2) AS s2, sum(w * d ** 3) AS s3, sum(w * d ** 4) AS s4, sum(w * y) AS t0, sum(w * d * y) AS t1, sum(w * d ** 2 * y) AS t2 FROM wt GROUP BY g, feature),
    lo AS (SELECT g, feature, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)) AS trend FROM mo),
    ft AS (SELECT ok.*, sqrt(10 ** trend) AS sd FROM ok JOIN lo ON ok.g = lo.g AND ok.feature = lo.feature),
    sc AS (SELECT ft.g, ft.feature, (any_value(ft.n) * any_value(mean) ** 2 + sum(least(v, sd * sqrt(ft.n) + mean) ** 2) - 2 * any_value(mean) * sum(least(v, sd * sqrt(ft.n) + mean)))
        / ((any_value(ft.n) - 1) * any_value(sd) ** 2) AS score FROM ft JOIN e ON ft.g = e.g AND ft.feature = e.feature GROUP BY ft.g, ft.feature),
    pk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, feature) AS r FROM sc),
    mg AS (SELECT feature, count(*) AS n_batches, median(r - 1) AS median_rank FROM pk WHERE r <= {n} GROUP BY feature)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY n_batches DESC, median_rank, feature) AS INTEGER) AS rank FROM mg) WHERE rank <= {n}"""


@query("mat19_highly_variable", "WITH " + SV.format(mat="mx", cells="mx_cells", grp="batch", n=8))
def _(spark, sf):
    return mt.highly_variable(load(spark, sf, "mx"), cells(spark, sf), 8, "batch")


@query("mat20_align_features", """SELECT p_brand AS feature, p_brand IN (SELECT feature FROM mx WHERE value > 130) AS present FROM (SELECT DISTINCT p_brand FROM part)""")
def _(spark, sf):
    feats = load(spark, sf, "part").select(F.col("p_brand").alias("feature")).distinct()
    return mt.align_features(load(spark, sf, "mx").where("value > 130"), feats)[1]


@query("mat21_concat_features", """SELECT cell, feature, value FROM mxs WHERE cell IN (SELECT cell FROM mxt) UNION ALL SELECT cell, feature, value FROM mxt WHERE cell IN (SELECT cell FROM mxs)""")
def _(spark, sf):
    return mt.concat_features(load(spark, sf, "mxs").select("cell", "feature", "value"), load(spark, sf, "mxt"))


@query("mat22_feature_stats", f"WITH {GRID} SELECT feature, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std FROM g GROUP BY feature HAVING avg(x) > 38 AND stddev_pop(x) > 39")
def _(spark, sf):
    return rounded(mt.feature_stats(load(spark, sf, "mx"), cells(spark, sf), 38, 39), 5)


@query("mat23_common_features", "SELECT feature FROM mx WHERE value > 180 INTERSECT SELECT feature FROM mxs WHERE value > 1000")
def _(spark, sf):
    return mt.common_features(load(spark, sf, "mx").where("value > 180"), load(spark, sf, "mxs").where("value > 1000"))


@query("mat24_split_by_suffix", """SELECT CAST(o_custkey AS VARCHAR) AS cell, p_brand AS feature, sum(l_quantity) AS value, CASE WHEN l_linestatus = 'O' THEN '_mCH' ELSE '_mCG' END AS layer
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def _(spark, sf):
    li, o, p = load(spark, sf, "lineitem"), load(spark, sf, "orders"), load(spark, sf, "part")
    tag = F.when(F.col("l_linestatus") == "O", "_mCH").otherwise("_mCG")
    m = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).groupBy(
        F.col("o_custkey").cast("string").alias("cell"), F.concat("p_brand", tag).alias("feature")).agg(F.sum("l_quantity").alias("value"))
    parts = mt.split_by_suffix(m, ["_mCH", "_mCG"])
    return mt.concat_cells(*[x.withColumn("layer", F.lit(s)) for s, x in parts.items()])
