"""EMB-* and MET-* queries."""

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.views import load
from strandloom.functions.runtime import cut_lineage
from strandloom.functions.vectors import cosine, dot, l2_normalize
from strandloom.operators import embed as em
from strandloom.operators import metrics as me
from strandloom.operators import neighbors as nb


def before(c):
    """A second, distorted embedding: every other component scaled."""
    return c.withColumn("rep0", F.transform("rep", lambda x, i: F.when(i % 2 == 0, x * 0.3).otherwise(x)))


DIST = "list_distance(a.rep, b.rep)"
NN = """(SELECT a.cell AS query, b.cell AS ref, a.cell_type AS lq, b.cell_type AS lr, list_distance(a.rep, b.rep) AS dist,
    row_number() OVER (PARTITION BY a.cell ORDER BY round(list_distance(a.rep, b.rep), 7), b.cell) AS rank FROM cells a JOIN cells b ON {on})"""


@query("emb01_lsi")
def _(spark, sf):
    return em.lsi(load(spark, sf, "mx"), load(spark, sf, "mx_cells"), 10)


@query("emb01_lsi_row_norms", """WITH t AS (SELECT cell, value / sum(value) OVER (PARTITION BY feature) AS t FROM mx), x AS (SELECT cell, ln(1 + t / sum(t) OVER (PARTITION BY cell) * 10000) AS x FROM t)
    SELECT cell, round(sqrt(sum(x * x)), 5) AS row_norm FROM x GROUP BY cell""")
def _(spark, sf):
    # with every component kept, U * s has the row norms of the decomposed matrix
    x = em._lsi_input(load(spark, sf, "mx"), load(spark, sf, "mx_cells"))
    out = em.svd(x, 25, x.select("cell").distinct())
    scaled = F.aggregate(F.zip_with("rep", F.array(*[F.lit(s) for s in out.s]), lambda u, s: u * s * u * s), F.lit(0.0), lambda a, b: a + b)
    return rounded(out.u.select("cell", F.sqrt(scaled).alias("row_norm")), 5)


@query("emb02_lsi_fit_transform")
def _(spark, sf):
    m, c = load(spark, sf, "mx"), load(spark, sf, "mx_cells")
    return em.AllCoolsLsi(8).fit(m, c).transform(m, cells=c)


@query("emb02_lsi_downsampled_fit")
def _(spark, sf):
    m, c = load(spark, sf, "mx"), load(spark, sf, "mx_cells")
    return em.AllCoolsLsi(8).fit(m, c, downsample=500).transform(m, cells=c)


@query("emb03_pca_variances", f"""WITH g AS (SELECT c.c_custkey, f.feature, coalesce(mx.value, 0) AS x FROM customer c CROSS JOIN (SELECT DISTINCT feature FROM mx) f
    LEFT JOIN mx ON mx.cell = CAST(c_custkey AS VARCHAR) AND mx.feature = f.feature), s AS (SELECT feature, avg(x) AS m, stddev_samp(x) AS sd FROM g GROUP BY feature)
    SELECT round(sum(v), 4) AS total_variance FROM (SELECT var_samp(least((x - m) / sd, 10)) AS v FROM g JOIN s ON g.feature = s.feature GROUP BY g.feature)""")
def _(spark, sf):
    _, var = em.pca(load(spark, sf, "mx"), load(spark, sf, "mx_cells"), 25)
    scores, _ = em.pca(load(spark, sf, "mx"), load(spark, sf, "mx_cells"), 25)
    return rounded(scores.agg(*[F.var_samp(F.col("rep")[i]).alias(f"v{i}") for i in range(25)]).select(sum(F.col(f"v{i}") for i in range(25)).alias("total_variance")), 4)


@query("emb03_pca")
def _(spark, sf):
    c = load(spark, sf, "mx_cells")
    return em.pca(load(spark, sf, "mx"), c, 10, mask=c.where("cell_type = 'BUILDING'"))[0]


@query("emb04_lsi_project")
def _(spark, sf):
    c = load(spark, sf, "mx_cells")
    return em.lsi_project(load(spark, sf, "mx"), c, 10, c.where("cell_type <> 'BUILDING'"))


#: Thirteen cells over all parts; each part belongs to one cell, so the singular vectors are known: one cell each, by falling row norm.
WIDE = """w AS (SELECT concat('c', least(CAST(floor(sqrt(p_partkey)) AS INTEGER), 12)) AS cell, concat('p', p_partkey) AS feature, sum(l_quantity) AS value
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
SEURAT = "x AS (SELECT cell, feature, ln(1 + 10000 * (value / r * (13 / c)) / sum(value / r * (13 / c)) OVER (PARTITION BY cell)) AS x FROM (SELECT *, sum(value) OVER (PARTITION BY cell) AS r, sum(value) OVER (PARTITION BY feature) AS c FROM w))"
ALLCOOLS = "x AS (SELECT cell, feature, ln(1 + 100000 * value / (r + 1e-5)) * ln(1 + 13 / (c + 1e-5)) AS x FROM (SELECT *, sum(value) OVER (PARTITION BY cell) AS r, sum(value) OVER (PARTITION BY feature) AS c FROM w))"
UNIT = "n AS (SELECT cell, row_number() OVER (ORDER BY sum(x * x) DESC) AS r FROM x {where} GROUP BY cell), k AS (SELECT unnest(range(1, {k} + 1)) AS i)"


def wide(spark, sf):
    li, p = load(spark, sf, "lineitem"), load(spark, sf, "part")
    cell = F.concat(F.lit("c"), F.least(F.floor(F.sqrt("p_partkey")).cast("int"), F.lit(12)))
    m = li.join(p, li.l_partkey == p.p_partkey).groupBy(cell.alias("cell"), F.concat(F.lit("p"), "p_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value"))
    return m, m.select("cell").distinct()


def by_component(reps):
    return reps.select("cell", F.posexplode("rep").alias("i", "v")).select("cell", (F.col("i") + 1).cast("long").alias("component"), F.round("v", 6).alias("v"))


@query("emb01_lsi_wide", f"WITH {WIDE}, {SEURAT}, {UNIT.format(where='', k=13)} SELECT cell, i AS component, round((CASE WHEN r = i THEN 1 ELSE 0 END - 1 / 13) / sqrt(1 / 13), 6) AS v FROM n CROSS JOIN k")
def _(spark, sf):
    return by_component(em.lsi(*wide(spark, sf), 13))


@query("emb01_svd_rebuilt", """WITH m AS (SELECT concat('n', s_nationkey) AS cell, concat('p', l_partkey) AS feature, sum(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
    SELECT cell, feature, round(value, 4) AS value FROM m""")
def _(spark, sf):
    """U S V' with as many components as nations, at the entries of a matrix of nations by parts."""
    li, s = load(spark, sf, "lineitem"), load(spark, sf, "supplier")
    m = li.join(s, li.l_suppkey == s.s_suppkey).groupBy(F.concat(F.lit("n"), "s_nationkey").alias("cell"), F.concat(F.lit("p"), "l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value"))
    m = cut_lineage(m)
    c = m.select("cell").distinct()
    out = em.svd(m, c.count(), c)
    scaled = out.u.select("cell", F.zip_with("rep", F.array(*[F.lit(x) for x in out.s]), lambda u, x: u * x).alias("us"))
    return m.select("cell", "feature").join(out.v, "feature").join(scaled, "cell").select("cell", "feature", F.round(dot("us", "vec"), 4).alias("value"))


@query("emb02_fit_transform_wide", f"WITH {WIDE}, {ALLCOOLS}, {UNIT.format(where='', k=12)} SELECT cell, i AS component, CAST(CASE WHEN r = i THEN 1 ELSE 0 END AS DOUBLE) AS v FROM n CROSS JOIN k")
def _(spark, sf):
    m, c = wide(spark, sf)
    return by_component(em.AllCoolsLsi(13).fit(m, c).transform(m, cells=c))


@query("emb03_pca_products", f"""WITH {WIDE}, ce AS (SELECT DISTINCT cell FROM w), fe AS (SELECT DISTINCT feature FROM w), g AS (SELECT ce.cell, fe.feature, coalesce(value, 0) AS x FROM ce CROSS JOIN fe LEFT JOIN w ON w.cell = ce.cell AND w.feature = fe.feature),
    z AS (SELECT cell, feature, least((x - avg(x) OVER f) / stddev_samp(x) OVER f, 10) AS z FROM g WINDOW f AS (PARTITION BY feature)), y AS (SELECT cell, feature, z - avg(z) OVER (PARTITION BY feature) AS y FROM z)
    SELECT a.cell, b.cell AS other, round(sum(a.y * b.y), 4) AS product FROM y a JOIN y b ON a.feature = b.feature GROUP BY 1, 2""")
def _(spark, sf):
    scores, _ = em.pca(*wide(spark, sf), 13)
    other = scores.select(F.col("cell").alias("other"), F.col("rep").alias("r"))
    return scores.crossJoin(other).select("cell", "other", F.round(dot("rep", "r"), 4).alias("product"))


@query("emb04_project_wide", f"WITH {WIDE}, {SEURAT}, {UNIT.format(where=' WHERE cell <> ' + chr(39) + 'c7' + chr(39), k=12)} SELECT cell, i AS component, round((CASE WHEN r = i THEN 1 ELSE 0 END - 1 / 12) / sqrt(1 / 12), 6) AS v FROM n CROSS JOIN k")
def _(spark, sf):
    """Fitted without one of the cells, which shares no feature with the others and so has no direction of its own."""
    m, c = wide(spark, sf)
    mask = c.where("cell <> 'c7'")
    return by_component(em.lsi_project(m, c, 12, mask).join(mask, "cell", "left_semi"))


@query("emb05_normalize_cosine", """SELECT a.cell, b.cell AS other, round(list_cosine_similarity(a.rep, b.rep), 6) AS cos, round(a.rep[1] / sqrt(list_dot_product(a.rep, a.rep)), 6) AS first
    FROM cells a JOIN cells b ON a.cell = b.batch""")
def _(spark, sf):
    c = load(spark, sf, "cells")
    o = c.select(F.col("cell").alias("other"), F.col("rep").alias("r"), F.col("batch").alias("k"))
    return rounded(c.join(o, c["cell"] == o["k"]).select("cell", "other", cosine("rep", "r").alias("cos"), l2_normalize("rep")[0].alias("first")))


@query("emb06_knn_euclidean", f"SELECT query, ref, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM {NN.format(on='true')} WHERE rank <= 10")
def _(spark, sf):
    c = load(spark, sf, "cells")
    return rounded(nb.knn(c, c, 10))


@query("emb06_knn_pruned", f"SELECT query, ref, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM {NN.format(on='a.cell <> b.cell')} WHERE rank <= 5")
def _(spark, sf):
    c = load(spark, sf, "cells")
    return rounded(nb.knn(c, c, 5, exclude_self=True, prune_from=1))


@query("emb06_knn_cosine", """SELECT query, ref, CAST(rank AS INTEGER) AS rank, round(d, 6) AS dist FROM (SELECT a.cell AS query, b.cell AS ref, 1 - list_cosine_similarity(a.rep, b.rep) AS d,
    row_number() OVER (PARTITION BY a.cell ORDER BY round(1 - list_cosine_similarity(a.rep, b.rep), 9), b.cell) AS rank FROM cells a JOIN cells b ON a.domain = '0' AND b.domain = '1') WHERE rank <= 7""")
def _(spark, sf):
    c = load(spark, sf, "cells")
    return rounded(nb.knn(c.where("domain = '0'"), c.where("domain = '1'"), 7, "cosine"))


@query("emb06_knn_inner_product", """SELECT query, ref, CAST(rank AS INTEGER) AS rank, round(d, 6) AS dist FROM (SELECT a.cell AS query, b.cell AS ref, -list_dot_product(a.rep, b.rep) AS d,
    row_number() OVER (PARTITION BY a.cell ORDER BY round(-list_dot_product(a.rep, b.rep), 9), b.cell) AS rank FROM cells a JOIN cells b ON a.domain = '0' AND b.domain = '1') WHERE rank <= 7""")
def _(spark, sf):
    c = load(spark, sf, "cells")
    return rounded(nb.knn(c.where("domain = '0'"), c.where("domain = '1'"), 7, "ip"))


@query("emb07_knn_approx")
def _(spark, sf):
    c = load(spark, sf, "cells")
    return nb.knn_approx(c, c, 10)


@query("emb07_recall", "SELECT count(*) * 10 AS found, true AS enough FROM cells")
def _(spark, sf):
    """Ten neighbours for every cell, nine tenths of the true ones at least."""
    c = load(spark, sf, "cells")
    got, want = nb.knn_approx(c, c, 10).select("query", "ref"), nb.knn(c, c, 10).select("query", "ref").withColumn("true", F.lit(1))
    return got.join(want, ["query", "ref"], "left").agg(F.count(F.lit(1)).alias("found"), (F.sum("true") >= 0.9 * F.count(F.lit(1))).alias("enough"))


GRAPH = f"(SELECT query AS source, ref AS target FROM {NN.format(on='a.cell <> b.cell')} WHERE rank <= 14 UNION SELECT ref, query FROM {NN.format(on='a.cell <> b.cell')} WHERE rank <= 14)"


@query("emb08_neighbor_graph", f"SELECT source, target FROM {GRAPH}")
def _(spark, sf):
    return nb.neighbor_graph(load(spark, sf, "cells"))


@query("emb09_kmeans")
def _(spark, sf):
    c = load(spark, sf, "cells")
    return em.kmeans(c, 10, mask=c.where("domain = '0'")).select("cell", "cluster")


@query("emb10_drop_missing", "SELECT CAST(count(*) FILTER (WHERE label <> 3) AS BIGINT) AS kept, round(100.0 * count(*) FILTER (WHERE label = 3) / count(*), 6) AS percent_missing FROM embeddings")
def _(spark, sf):
    c = load(spark, sf, "cells").withColumn("rep", F.when(F.col("cell_type") == "3", F.transform("rep", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("rep")))
    kept, share = em.drop_missing(c)
    return rounded(kept.agg(F.count(F.lit(1)).alias("kept")).withColumn("percent_missing", share.scalar()))


@query("met01_mean_average_precision", f"""WITH k AS (SELECT greatest(CAST(round_even(count(*) * 0.01, 0) AS BIGINT), 1) AS k FROM cells), n AS (SELECT * FROM {NN.format(on='a.cell <> b.cell')}, k WHERE rank <= k),
    p AS (SELECT query, CASE WHEN lq = lr THEN sum(CASE WHEN lq = lr THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY rank) / rank END AS p FROM n)
    SELECT round(avg(ap), 6) AS mean_average_precision FROM (SELECT coalesce(avg(p), 0) AS ap FROM p GROUP BY query)""")
def _(spark, sf):
    return rounded(me.mean_average_precision(load(spark, sf, "cells"), "cell_type"))




@query("met02_normalized_mutual_info", """WITH j AS (SELECT o_orderpriority AS l, o_orderstatus AS c, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2),
    r AS (SELECT l, sum(n) AS a FROM j GROUP BY l), k AS (SELECT c, sum(n) AS b FROM j GROUP BY c), t AS (SELECT sum(n) AS t FROM j)
    SELECT round((SELECT sum(n / t * ln(n * t / (a * b))) FROM j JOIN r ON j.l = r.l JOIN k ON j.c = k.c, t)
    / (((SELECT -sum(a / t * ln(a / t)) FROM r, t) + (SELECT -sum(b / t * ln(b / t)) FROM k, t)) / 2), 6) AS nmi""")
def _(spark, sf):
    return rounded(me.normalized_mutual_info(load(spark, sf, "orders"), "o_orderpriority", ["o_orderstatus"]))


SIL = """sz AS (SELECT {g} AS g, {l} AS l, count(*) AS n FROM cells GROUP BY 1, 2), ds AS (SELECT a.cell, {ag} AS g, a.{l} AS la, b.{l} AS lb, sum(list_distance(a.rep, b.rep)) AS t
    FROM cells a JOIN cells b ON {on} GROUP BY 1, 2, 3, 4), ab AS (SELECT cell, ds.g, la, max(CASE WHEN la = lb THEN n END) AS n, max(CASE WHEN la = lb THEN t / nullif(n - 1, 0) END) AS a,
    min(CASE WHEN la <> lb THEN t / n END) AS b FROM ds JOIN sz ON ds.lb = sz.l AND ds.g = sz.g GROUP BY 1, 2, 3), si AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


@query("met03_avg_silhouette_width", f"WITH {SIL.format(g='0', ag='0', l='cell_type', on='true')} SELECT round((avg(s) + 1) / 2, 6) AS avg_silhouette_width FROM si")
def _(spark, sf):
    return rounded(me.avg_silhouette_width(load(spark, sf, "cells"), "cell_type"))


@query("met04_graph_connectivity", f"""WITH RECURSIVE ge AS (SELECT source, target FROM {GRAPH} e JOIN cells x ON x.cell = source JOIN cells y ON y.cell = target WHERE x.cell_type = y.cell_type),
    cc AS (SELECT cell AS node, cell AS root FROM cells UNION SELECT ge.target, cc.root FROM cc JOIN ge ON cc.node = ge.source),
    cp AS (SELECT node, min(root) AS component FROM cc GROUP BY node), n AS (SELECT cell_type, component, count(*) AS n FROM cp JOIN cells ON cell = node GROUP BY 1, 2)
    SELECT round(avg(s), 6) AS graph_connectivity FROM (SELECT max(n) / sum(n) AS s FROM n GROUP BY cell_type)""")
def _(spark, sf):
    return rounded(me.graph_connectivity(load(spark, sf, "cells"), "cell_type"))


@query("met05_equal_batches", f"""WITH e AS (SELECT count(*) AS n, greatest(CAST(round_even(count(*) * 0.02, 0) AS BIGINT), 1) AS k FROM cells),
    b AS (SELECT q.domain = r.domain AS same FROM {NN.format(on='a.cell <> b.cell')} x JOIN cells q ON q.cell = x.query JOIN cells r ON r.cell = x.ref, e WHERE x.rank <= e.k)
    SELECT round(least((any_value(k) - count(*) FILTER (WHERE same) / any_value(n)) * 2 / any_value(k), 1), 6) AS seurat_alignment_score FROM b, e""")
def _(spark, sf):
    """Two batches of equal size: every subsample is the whole table."""
    return rounded(me.seurat_alignment_score(load(spark, sf, "cells"), "domain", 0.02))


@query("met05_seurat_alignment_score")
def _(spark, sf):
    return me.seurat_alignment_score(load(spark, sf, "cells"), "batch")


@query("met06_avg_silhouette_width_batch", f"WITH {SIL.format(g='cell_type', ag='a.cell_type', l='batch', on='a.cell_type = b.cell_type')} SELECT round(avg(v), 6) AS avg_silhouette_width_batch FROM (SELECT avg(1 - abs(s)) AS v FROM si GROUP BY g)")
def _(spark, sf):
    return rounded(me.avg_silhouette_width_batch(load(spark, sf, "cells"), "batch", "cell_type"))


NC = """(SELECT a.cell AS query, b.cell AS ref, a.batch, row_number() OVER (PARTITION BY a.cell ORDER BY round(list_distance(a.{r}, b.{r}), 7), b.cell) AS rank FROM c2 a JOIN c2 b ON a.cell <> b.cell AND a.batch = b.batch)"""


@query("met07_neighbor_conservation", f"""WITH c2 AS (SELECT cell, batch, rep, list_transform(rep, lambda x, i: CASE WHEN i % 2 = 1 THEN x * 0.3 ELSE x END) AS rep0 FROM cells),
    k AS (SELECT greatest(CAST(round_even(count(*) * 0.01, 0) AS BIGINT), 1) AS k FROM cells), x AS (SELECT query, ref, batch FROM {NC.format(r='rep')}, k WHERE rank <= k), y AS (SELECT query, ref FROM {NC.format(r='rep0')}, k WHERE rank <= k),
    j AS (SELECT x.query, any_value(batch) AS batch, count(y.ref) AS i, count(*) AS n FROM x LEFT JOIN y ON x.query = y.query AND x.ref = y.ref GROUP BY x.query)
    SELECT round(avg(v), 6) AS neighbor_conservation FROM (SELECT batch, avg(i / (2 * n - i)) AS v FROM j GROUP BY batch)""")
def _(spark, sf):
    return rounded(me.neighbor_conservation(before(load(spark, sf, "cells")), "rep", "rep0", "batch"))


@query("met08_foscttm", """WITH c2 AS (SELECT cell, rep, list_transform(rep, lambda x, i: CASE WHEN i % 2 = 1 THEN x * 0.3 ELSE x END) AS rep0 FROM cells), t AS (SELECT cell, list_distance(rep, rep0) AS d FROM c2)
    SELECT x.cell, round(fx, 6) AS foscttm_x, round(fy, 6) AS foscttm_y FROM (SELECT a.cell, avg(CASE WHEN a.cell <> b.cell AND list_distance(a.rep, b.rep0) < t.d THEN 1.0 ELSE 0 END) AS fx FROM c2 a JOIN t ON a.cell = t.cell, c2 b GROUP BY a.cell) x
    JOIN (SELECT b.cell, avg(CASE WHEN a.cell <> b.cell AND list_distance(a.rep, b.rep0) < t.d THEN 1.0 ELSE 0 END) AS fy FROM c2 b JOIN t ON b.cell = t.cell, c2 a GROUP BY b.cell) y ON x.cell = y.cell""")
def _(spark, sf):
    c = before(load(spark, sf, "cells"))
    return rounded(me.foscttm(c.select("cell", "rep"), c.select("cell", F.col("rep0").alias("rep"))))


@query("met09_feature_consistency", """WITH c2 AS (SELECT cell, rep, list_transform(rep, lambda x, i: CASE WHEN i % 2 = 1 THEN x * 0.3 ELSE x END) AS rep0 FROM cells)
    SELECT round(corr(list_cosine_similarity(a.rep, b.rep), list_cosine_similarity(a.rep0, b.rep0)), 6) AS feature_consistency FROM c2 a, c2 b""")
def _(spark, sf):
    c = before(load(spark, sf, "cells")).withColumnRenamed("cell", "feature")
    n = c.count()
    return rounded(me.feature_consistency(c.select("feature", "rep"), c.select("feature", F.col("rep0").alias("rep")), n_features=n))


@query("met10_evaluate")
def _(spark, sf):
    c = before(load(spark, sf, "cells"))
    pair = (c.select("cell", "rep"), c.select("cell", F.col("rep0").alias("rep")))
    return me.evaluate(c, "cell_type", "batch", ["domain"], rep_before="rep0", paired=pair)
