"""COH-* and BEN-* queries."""

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.views import load
from strandloom.operators import cohort as co
from strandloom.operators import runs as rn


def cust(spark, sf):
    return load(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("cell"), "c_nationkey", "c_acctbal", "c_mktsegment")


def buyers(spark, sf):
    return load(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("cell")).distinct()


@query("coh01_dataset_view_cells", """SELECT CAST(vec_id AS VARCHAR) AS cell, CAST(dense_rank() OVER (ORDER BY vec_id % 3) - 1 AS INTEGER) AS batch_code, CASE WHEN label IN (1, 4, 7) THEN CAST((label - 1) / 3 AS INTEGER) ELSE -1 END AS cell_type_code,
    round((vec_id + 1) / avg(vec_id + 1) OVER (), 6) AS weight FROM embeddings""")
def _(spark, sf):
    c = load(spark, sf, "cells").withColumn("w", F.col("cell").cast("double") + 1)
    feats = load(spark, sf, "part").select(F.col("p_brand").alias("feature")).distinct()
    out = co.dataset_view(load(spark, sf, "mx"), c, feats, use_rep="rep", rep_dim=64, use_batch="batch", use_cell_type="cell_type", cell_types=["1", "4", "7"], use_weight="w")[1]
    return rounded(out.drop("rep"))


@query("coh01_dataset_view_matrix", """SELECT cell, feature, value FROM (SELECT CAST(l_suppkey AS VARCHAR) AS cell, p_brand AS feature, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    WHERE feature IN (SELECT p_brand FROM part GROUP BY p_brand HAVING avg(p_size) > 25)""")
def _(spark, sf):
    feats = load(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg((F.avg("p_size") > 25).alias("highly_variable"))
    return co.dataset_view(load(spark, sf, "mxs"), load(spark, sf, "cells"), feats, use_highly_variable=True, use_layer="cov")[0]


@query("coh02_paired_view_masks", """SELECT coalesce(a.cell, b.cell) AS cell, a.cell IS NOT NULL AS has_0, b.cell IS NOT NULL AS has_1 FROM (SELECT concat('c', c_custkey) AS cell FROM customer WHERE c_acctbal > 0) a
    FULL JOIN (SELECT DISTINCT concat('c', o_custkey) AS cell FROM orders) b ON a.cell = b.cell""")
def _(spark, sf):
    return co.paired_view(cust(spark, sf).where("c_acctbal > 0"), buyers(spark, sf)).select("cell", "has_0", "has_1")


@query("coh02_paired_view")
def _(spark, sf):
    return co.paired_view(cust(spark, sf).where("c_acctbal > 0"), buyers(spark, sf))


@query("coh03_random_split_sizes", """WITH n AS (SELECT count(*) AS n FROM orders) SELECT 0 AS split, CAST(round_even(n * 0.7, 0) AS BIGINT) AS rows FROM n UNION ALL SELECT 1, CAST(round_even(n * 0.9, 0) - round_even(n * 0.7, 0) AS BIGINT) FROM n
    UNION ALL SELECT 2, CAST(n - round_even(n * 0.9, 0) AS BIGINT) FROM n""")
def _(spark, sf):
    return co.random_split(load(spark, sf, "orders"), [0.7, 0.2, 0.1], ["o_orderkey"]).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("coh04_recycle_join_counts", """SELECT o_orderkey, 1 AS uses FROM orders""".replace("1 AS", "CAST(1 AS BIGINT) AS"))
def _(spark, sf):
    o, c = load(spark, sf, "orders").select("o_orderkey"), load(spark, sf, "customer").select("c_custkey")
    return co.recycle_join(c, o, ["c_custkey"], ["o_orderkey"]).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("uses"))


@query("coh05_subsample_sizes", """SELECT CAST(round_even(count(*) * 0.35, 0) AS BIGINT) AS n, CAST(round_even(count(*) * 0.35, 0) AS BIGINT) AS shared FROM customer""")
def _(spark, sf):
    c = cust(spark, sf)
    a, b = co.subsample([c.select("cell", "c_acctbal"), c.select("cell", "c_nationkey")], frac=0.35, paired=True)
    return a.agg(F.count(F.lit(1)).alias("n")).withColumn("shared", a.join(b, "cell").agg(F.count(F.lit(1))).scalar())


@query("coh06_annotate_cells", """SELECT concat('c', c_custkey) AS cell, CASE WHEN n_name IS NULL THEN NULL ELSE CASE c_mktsegment WHEN 'BUILDING' THEN 'house' ELSE c_mktsegment END END AS c_mktsegment, n_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 AND c_mktsegment NOT IN ('MACHINERY')""")
def _(spark, sf):
    c = cust(spark, sf).select("cell", "c_nationkey", "c_mktsegment")
    meta = load(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return co.annotate_cells(c, meta, {"c_mktsegment": ["MACHINERY"]}, {"c_mktsegment": {"BUILDING": "house"}}, on="c_nationkey").drop("c_nationkey")


@query("coh07_drop_doublets", """SELECT concat('c', c_custkey) AS cell FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 9000)""")
def _(spark, sf):
    calls = load(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey", F.lit("-1")).alias("barcode"), (F.col("o_totalprice") / 180000).alias("p"))
    return co.drop_doublets(cust(spark, sf).select("cell"), calls, pval="p", barcode_pattern="-1$")


@query("coh08_map_barcodes", """SELECT c_custkey, concat('bc.', c_custkey, '.', CASE WHEN n_regionkey = 0 THEN NULL ELSE n_name END) AS cell FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0
    UNION ALL SELECT c_custkey, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0""")
def _(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", F.concat_ws(".", F.lit("bc"), "c_custkey", "c_nationkey").alias("cell"))
    return co.map_barcodes(c, load(spark, sf, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value")))


@query("coh08_pair_partially_counts", "SELECT CAST(floor(count(*) / 4) AS BIGINT) AS paired, count(*) - CAST(floor(count(*) / 4) AS BIGINT) AS unpaired FROM customer")
def _(spark, sf):
    c = cust(spark, sf).select("cell")
    a, b = co.pair_partially(c.withColumn("cell", F.concat("cell", F.lit("_RNA"))), c.withColumn("cell", F.concat("cell", F.lit("_ATAC"))), 4, 5, c.count() // 4)
    both = a.join(b, "cell").agg(F.count(F.lit(1)).alias("paired"))
    return both.withColumn("unpaired", a.where(F.col("cell").endswith("_RNA")).agg(F.count(F.lit(1))).scalar())


M = ["m1", "m2", "m3", "m4", "m5", "m6"]
SCORED = """s AS (SELECT *, (""" + " + ".join(f"({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ())" for m in M[:3]) + """) / 3 AS bio, (""" + " + ".join(
    f"({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ())" for m in M[3:]) + """) / 3 AS int_ FROM runs)"""


@query("ben01_overall_score", f"""WITH {SCORED} SELECT run, round(bio, 6) AS bio, round(int_, 6) AS "int", round(0.6 * bio + 0.4 * int_, 6) AS overall FROM s""")
def _(spark, sf):
    return rounded(rn.overall_score(load(spark, sf, "runs"), bio=M[:3], integration=M[3:]).select("run", "bio", "int", "overall"))


@query("ben02_summarise_runs", "SELECT dataset, method, round(avg(m1), 4) AS m1, round(avg(m3), 6) AS m3, round(stddev_samp(m1), 4) AS m1_sd, round(stddev_samp(m3), 6) AS m3_sd, count(*) AS n_seeds FROM runs GROUP BY 1, 2")
def _(spark, sf):
    out = rn.summarise_runs(load(spark, sf, "runs"), ["dataset", "method"], ["m1", "m3"])
    return rounded(out.withColumns({"m1": F.round("m1", 4), "m1_sd": F.round("m1_sd", 4)}))


@query("ben03_complete_grid", """WITH r AS (SELECT l_suppkey AS dataset, l_partkey AS method, max(l_quantity) AS m FROM lineitem GROUP BY 1, 2)
    SELECT d.dataset, k.method, r.m, CASE WHEN r.m IS NULL THEN 'N.A.' END AS annotation FROM (SELECT DISTINCT dataset FROM r) d CROSS JOIN (SELECT DISTINCT method FROM r) k LEFT JOIN r ON r.dataset = d.dataset AND r.method = k.method""")
def _(spark, sf):
    r = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("dataset"), F.col("l_partkey").alias("method")).agg(F.max("l_quantity").alias("m"))
    return rn.complete_grid(r, ("dataset", "method"))


@query("ben04_delta_to_baseline", """WITH r AS (SELECT dataset, method, seed, avg(m1) AS m1, avg(m3) AS m3 FROM runs GROUP BY 1, 2, 3) SELECT r.dataset, r.method, r.seed, round(r.m1 - b.m1, 4) AS m1, round(r.m3 - b.m3, 4) AS m3
    FROM r LEFT JOIN r b ON r.dataset = b.dataset AND r.method = b.method AND b.seed = 0""")
def _(spark, sf):
    r = load(spark, sf, "runs").groupBy("dataset", "method", "seed").agg(F.avg("m1").alias("m1"), F.avg("m3").alias("m3"))
    return rounded(rn.delta_to_baseline(r, ["dataset", "method"], "seed", 0, ["m1", "m3"]), 4)


@query("ben05_sweep_table", """SELECT 'method' AS param, method AS value, run, m1 FROM runs WHERE seed = 3 AND dataset = '1-URGENT' UNION ALL SELECT 'seed', CAST(seed AS VARCHAR), run, m1 FROM runs WHERE method = 'F' AND dataset = '1-URGENT'
    UNION ALL SELECT 'dataset', dataset, run, m1 FROM runs WHERE method = 'F' AND seed = 3""")
def _(spark, sf):
    return rn.sweep_table(load(spark, sf, "runs"), {"method": "F", "seed": 3, "dataset": "1-URGENT"}, ["run", "m1"])


@query("ben06_best_run", """WITH s AS (SELECT *, round((m1 - min(m1) OVER ()) / (max(m1) OVER () - min(m1) OVER ()) + (m2 - min(m2) OVER ()) / (max(m2) OVER () - min(m2) OVER ()), 12) AS t FROM runs)
    SELECT dataset, method, run FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY t DESC, run) AS k FROM s) WHERE k = 1""")
def _(spark, sf):
    return rn.best_run(load(spark, sf, "runs"), ["dataset", "method"], ["m1", "m2"], ["run"]).select("dataset", "method", "run")


@query("ben07_scaling_slope", "SELECT method, round(regr_slope(log10(m1), log10(m2)), 6) AS slope FROM runs WHERE m2 > 0 AND m1 > 0 GROUP BY method")
def _(spark, sf):
    return rounded(rn.scaling_slope(load(spark, sf, "runs").where("m2 > 0 AND m1 > 0"), "method", "m2", "m1"))


@query("ben08_melt", "SELECT run, 'm1' AS variable, m1 AS value FROM runs UNION ALL SELECT run, 'm2', m2 FROM runs UNION ALL SELECT run, 'm3', m3 FROM runs")
def _(spark, sf):
    return rn.melt(load(spark, sf, "runs").select("run", "m1", "m2", "m3"), ["run"])
