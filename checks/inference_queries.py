"""LAB-* and INF-* queries."""

from pyspark.sql import functions as F

from checks.graph_queries import REPS, reps
from checks.registry import query, rounded
from checks.views import load
from strandloom.functions import ranks as rk
from strandloom.functions.runtime import cut_lineage
from strandloom.operators import inference as nf
from strandloom.operators import labels as lb
from strandloom.operators import matrix as mt
from strandloom.operators.intervals import tf_binding, window_graph
from strandloom.plans.regulation import tf_target_ranks


def halves(spark, sf):
    c = load(spark, sf, "cells")
    return c.where("domain = '0'"), c.where("domain = '1'")


NN = """{n} AS (SELECT * FROM (SELECT a.cell AS q, b.cell AS r, row_number() OVER (PARTITION BY a.cell ORDER BY round(list_distance(a.rep, b.rep), 7), b.cell) AS k FROM {a} a, {b} b) WHERE k <= 12)"""


@query("lab01_transfer_labels", f"""WITH rf AS (SELECT * FROM cells WHERE domain = '0'), qr AS (SELECT * FROM cells WHERE domain = '1'),
    {NN.format(n='xx', a='rf', b='rf')}, {NN.format(n='xy', a='rf', b='qr')}, {NN.format(n='yx', a='qr', b='rf')}, {NN.format(n='yy', a='qr', b='qr')},
    s AS (SELECT r, q, sum(s) AS s FROM (SELECT xx.q AS r, yx.q AS q, count(*) AS s FROM xx JOIN yx ON xx.r = yx.r GROUP BY 1, 2 UNION ALL SELECT xy.q, yy.q, count(*) FROM xy JOIN yy ON xy.r = yy.r GROUP BY 1, 2) GROUP BY 1, 2),
    v AS (SELECT q, cell_type, sum(s / (48 - s)) AS w FROM s JOIN rf ON rf.cell = s.r GROUP BY 1, 2), t AS (SELECT q, sum(w) AS t FROM v GROUP BY q),
    b AS (SELECT v.q, cell_type, w / t AS w, row_number() OVER (PARTITION BY v.q ORDER BY round(w / t, 12) DESC, cell_type) AS n FROM v JOIN t ON v.q = t.q)
    SELECT q AS cell, cell_type, round(w, 6) AS cell_type_confidence FROM b WHERE n = 1""")
def _(spark, sf):
    ref, qry = halves(spark, sf)
    return rounded(lb.transfer_labels(ref, qry, "cell_type", n_neighbors=12))


@query("lab02_vote_labels", """WITH n AS (SELECT a.cell AS q, b.cell_type AS l, row_number() OVER (PARTITION BY a.cell ORDER BY round(-list_cosine_similarity(a.rep, b.rep), 9), b.cell) AS k FROM cells a, cells b WHERE a.domain = '1' AND b.domain = '0')
    SELECT q AS cell, l AS cell_type FROM (SELECT q, l, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, l) AS r FROM n WHERE k <= 50 GROUP BY q, l) WHERE r = 1""")
def _(spark, sf):
    ref, qry = halves(spark, sf)
    return lb.vote_labels(ref, qry, "cell_type")


@query("lab02_vote_labels_approx")
def _(spark, sf):
    ref, qry = halves(spark, sf)
    return lb.vote_labels(ref, qry, "cell_type", approx=True)


PRED = """SELECT CASE WHEN p_size % 5 = 0 THEN concat(p_type, '?') WHEN p_size % 5 = 1 THEN concat(p_type, '/', p_brand) WHEN p_size % 5 = 2 THEN 'Unknown.1' ELSE p_type END AS t,
    CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS p FROM part"""


@query("lab03_transfer_accuracy", f"""SELECT round(avg(CASE WHEN t = p THEN 1.0 ELSE 0 END), 6) AS exact_accuracy,
    round(avg(CASE WHEN t = p OR (contains(t, '?') AND p = replace(t, '?', '')) OR (contains(t, '/') AND list_contains(string_split(t, '/'), p)) OR (t = 'SMALL' AND p = 'Brand#11') THEN 1.0 ELSE 0 END)
    FILTER (WHERE NOT contains(lower(t), 'unknown')), 6) AS relaxed_accuracy FROM ({PRED})""")
def _(spark, sf):
    from checks.views import sql
    return rounded(lb.transfer_accuracy(sql(spark, sf, PRED), "t", "p", spark.sql("SELECT 'SMALL' AS true, 'Brand#11' AS pred")))


BAL = """u AS (SELECT domain AS d, cell_type AS k, count(*) AS n, list(rep) AS reps FROM cells GROUP BY 1, 2),
    p AS (SELECT d, k, n, i, avg(x) AS x FROM (SELECT domain AS d, cell_type AS k, unnest(rep) AS x, unnest(range(1, 65)) AS i FROM cells) JOIN (SELECT domain AS d, cell_type AS k, count(*) AS n FROM cells GROUP BY 1, 2) USING (d, k) GROUP BY d, k, n, i),
    v AS (SELECT d, k, n, list(x ORDER BY i) AS v FROM p GROUP BY d, k, n),
    c AS (SELECT a.k AS ka, b.k AS kb, list_cosine_similarity(a.v, b.v) AS c FROM v a, v b WHERE a.d = '0' AND b.d = '1'), g AS (SELECT * FROM c WHERE c >= 0.2),
    w AS (SELECT '0' AS d, ka AS k, sum(c ** 4) AS s FROM g GROUP BY ka UNION ALL SELECT '1', kb, sum(c ** 4) FROM g GROUP BY kb),
    r AS (SELECT cells.cell, cells.domain, coalesce(s, 0) / n AS raw FROM cells JOIN v ON v.d = domain AND v.k = cell_type LEFT JOIN w ON w.d = domain AND w.k = cell_type)"""


@query("lab04_balancing_weight", f"WITH {BAL.replace('list(rep) AS reps', '1 AS one')} SELECT cell, domain, round(raw / avg(raw) OVER (PARTITION BY domain), 5) AS balancing FROM r")
def _(spark, sf):
    a, b = lb.balancing_weight(*halves(spark, sf), cluster="cell_type", cutoff=0.2)
    return rounded(a.unionByName(b).select("cell", "domain", "balancing"), 5)


@query("lab04_balancing_weight_batches")
def _(spark, sf):
    c = load(spark, sf, "cells")
    third = F.floor(F.xxhash64("cell") / F.lit(2.0**62))  # -2..1: three datasets that cover all cells
    parts = [c.where(third < -1), c.where((third >= -1) & (third < 1)), c.where(third >= 1)]
    out = lb.balancing_weight(*parts, use_batch="batch", cluster="cell_type", cutoff=0.1)
    return out[0].unionByName(out[1]).unionByName(out[2]).select("cell", "batch", "balancing")


@query("lab05_balancing_weight_by_size", f"""WITH {BAL.replace('list(rep) AS reps', '1 AS one')}, sz AS (SELECT domain AS d, cell_type AS k, sum(CAST(cell AS BIGINT) % 7 + 1) AS z FROM cells GROUP BY 1, 2),
    r2 AS (SELECT cells.cell, cells.domain, coalesce(s, 0) / z AS raw FROM cells JOIN sz ON sz.d = domain AND sz.k = cell_type LEFT JOIN w ON w.d = domain AND w.k = cell_type)
    SELECT cell, round(raw / avg(raw) OVER (PARTITION BY domain), 5) AS nc_balancing FROM r2""")
def _(spark, sf):
    a, b = [c.withColumn("n_cells", F.col("cell").cast("long") % 7 + 1) for c in halves(spark, sf)]
    out = lb.balancing_weight(a, b, cluster="cell_type", cutoff=0.2, size_col="n_cells", key_added="nc_balancing")
    return rounded(out[0].unionByName(out[1]).select("cell", "nc_balancing"), 5)


@query("lab06_balance_by_group", """WITH a AS (SELECT c_mktsegment AS k, count(*) AS n FROM customer WHERE c_nationkey < 10 GROUP BY 1), b AS (SELECT c_mktsegment AS k, count(*) AS n FROM customer WHERE c_nationkey >= 10 GROUP BY 1),
    f AS (SELECT a.k, a.n / (SELECT sum(n) FROM a) AS fa, b.n / (SELECT sum(n) FROM b) AS fb, (SELECT CAST(sum(n) AS BIGINT) FROM a) AS na, (SELECT CAST(sum(n) AS BIGINT) FROM b) AS nb FROM a JOIN b ON a.k = b.k)
    SELECT 'a' AS side, k AS c_mktsegment, CAST(round_even(least(fa, fb) * na, 0) AS BIGINT) AS kept, round(sqrt(fb / fa), 6) AS w FROM f
    UNION ALL SELECT 'b', k, CAST(round_even(least(fa, fb) * nb, 0) AS BIGINT), round(sqrt(fa / fb), 6) FROM f""")
def _(spark, sf):
    c = load(spark, sf, "customer").withColumn("cell", F.col("c_custkey").cast("string"))
    parts = lb.balance_by_group(c.where("c_nationkey < 10"), c.where("c_nationkey >= 10"), "c_mktsegment")
    out = [p.groupBy("c_mktsegment").agg(F.count_if("mask").alias("kept"), F.first("group_balancing").alias("w")).withColumn("side", F.lit(s)) for s, p in zip("ab", parts)]
    return rounded(out[0].unionByName(out[1]))


RANKS = """nm AS (SELECT cell, feature, ln(1 + value * 10000 / sum(value) OVER (PARTITION BY cell)) AS v FROM mx), gd AS (SELECT c.cell, c.cell_type AS g, f.feature, coalesce(v, 0) AS v FROM mx_cells c
    CROSS JOIN (SELECT DISTINCT feature FROM mx) f LEFT JOIN nm ON nm.cell = c.cell AND nm.feature = f.feature),
    rr AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY round(v, 12)) + (count(*) OVER (PARTITION BY feature, round(v, 12)) - 1) / 2.0 AS r FROM gd), nt AS (SELECT count(*) AS nt FROM mx_cells),
    st AS (SELECT feature, sum(v) AS st FROM gd GROUP BY feature), gs AS (SELECT rr.feature, g, count(*) AS n, sum(r) AS sr, sum(v) AS s FROM rr GROUP BY 1, 2),
    fin AS (SELECT g AS "group", gs.feature AS names, (sr - n * (nt + 1) / 2) / sqrt(n * (nt - n) * (nt + 1) / 12) AS scores, log2((exp(s / n) - 1 + 1e-9) / (exp((st - s) / (nt - n)) - 1 + 1e-9)) AS logfoldchanges FROM gs JOIN st ON gs.feature = st.feature, nt)"""


def ranked(spark, sf, cells=None):
    m = mt.lognorm(load(spark, sf, "mx")).withColumn("value", F.round("value", 12))
    return lb.rank_features_groups(m, load(spark, sf, "mx_cells") if cells is None else cells, "cell_type")


@query("lab07_rank_features_groups", f"""WITH {RANKS} SELECT "group", names, round(scores, 5) AS scores, round(logfoldchanges, 5) AS logfoldchanges FROM fin""")
def _(spark, sf):
    return rounded(ranked(spark, sf).select("group", "names", "scores", "logfoldchanges"), 5)


@query("lab08_extract_markers", f"""WITH {RANKS} SELECT "group", names, round(scores, 5) AS scores FROM (SELECT *, row_number() OVER (PARTITION BY names ORDER BY scores DESC, "group") AS k FROM fin) WHERE k = 1 AND logfoldchanges > 0""")
def _(spark, sf):
    return rounded(lb.extract_markers(ranked(spark, sf), filter_by="logfoldchanges > 0").select("group", "names", "scores"), 5)


MARK = """mk AS (SELECT DISTINCT p_name AS names, p_brand AS "group", CASE WHEN p_size <= 25 THEN 'a' ELSE 'b' END AS domain, p_retailprice / 1000 AS scores, p_size / 25.0 AS logfoldchanges FROM part)"""


def markers(spark, sf):
    return load(spark, sf, "part").select(F.col("p_name").alias("names"), F.col("p_brand").alias("group"), F.when(F.col("p_size") <= 25, "a").otherwise("b").alias("domain"),
                                          (F.col("p_retailprice") / 1000).alias("scores"), (F.col("p_size") / 25.0).alias("logfoldchanges")).distinct()


@query("lab09_marker_intersections", f"""WITH {MARK}, s AS (SELECT "group", domain, count(DISTINCT names) AS n FROM mk GROUP BY 1, 2), u AS (SELECT count(DISTINCT p_name) AS u FROM part),
    h AS (SELECT a."group" AS g1, b."group" AS g2, count(DISTINCT a.names) AS o FROM mk a JOIN mk b ON a.names = b.names AND a.domain = 'a' AND b.domain = 'b' GROUP BY 1, 2)
    SELECT x."group" AS group_1, y."group" AS group_2, x.n AS n_1, y.n AS n_2, coalesce(o, 0) AS observed, round(1.0 * x.n * y.n / u, 6) AS expected, round(coalesce(o, 0) / (1.0 * x.n * y.n / u), 6) AS fold
    FROM s x JOIN s y ON x.domain = 'a' AND y.domain = 'b' LEFT JOIN h ON h.g1 = x."group" AND h.g2 = y."group", u""")
def _(spark, sf):
    return rounded(lb.marker_intersections(markers(spark, sf), load(spark, sf, "part").select(F.col("p_name").alias("feature"))))


@query("lab10_consensus_markers", f"""WITH {MARK}, f AS (SELECT names, "group", avg(abs(scores)) AS scores, avg(abs(logfoldchanges)) AS logfoldchanges FROM mk GROUP BY 1, 2 HAVING count(DISTINCT domain) = 2)
    SELECT names, "group", round(scores, 6) AS scores, round(logfoldchanges, 6) AS logfoldchanges, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(logfoldchanges, 9) DESC, names) AS rank FROM f) WHERE rank <= 5""")
def _(spark, sf):
    return rounded(lb.consensus_markers(markers(spark, sf)))


# ---------------------------------------------------------------- inference

@query("inf01_regulatory_inference_scores", f"""WITH {REPS} SELECT ed.source, ed.target, ed.dist, round((list_cosine_similarity(a.rep, b.rep) + list_cosine_similarity([a.rep[1], a.rep[2] * 2, a.rep[3]], [b.rep[1], b.rep[2] * 2, b.rep[3]])) / 2, 6) AS score
    FROM ed JOIN reps a ON a.node = source JOIN reps b ON b.node = target""")
def _(spark, sf):
    return rounded(_inference(spark, sf).select("source", "target", "dist", "score"))


def _inference(spark, sf):
    r = reps(spark, sf)
    two = r.withColumn("rep", F.transform("rep", lambda x, i: F.when(i == 1, x * 2).otherwise(x)))
    return nf.regulatory_inference([r, two], load(spark, sf, "ed").select("source", "target", "dist", "sign"), seed=1)


@query("inf01_regulatory_inference")
def _(spark, sf):
    return _inference(spark, sf)


@query("inf02_empirical_quantile", """WITH bg AS (SELECT o_totalprice / 2 AS v FROM orders), n AS (SELECT count(*) AS n FROM bg), c AS (SELECT v, sum(count(*)) OVER (ORDER BY v) AS c FROM bg GROUP BY v)
    SELECT l_orderkey, l_partkey, l_extendedprice AS v, round(coalesce((c.c), 0) / n, 9) AS quantile FROM lineitem ASOF LEFT JOIN c ON l_extendedprice > c.v, n""")
def _(spark, sf):
    fg = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").alias("v"))
    return rounded(nf.empirical_quantile(fg, load(spark, sf, "orders").select((F.col("o_totalprice") / 2).alias("v")), "v"), 9)


@query("inf03_bh_fdr", """WITH p AS (SELECT l_orderkey, l_partkey, l_extendedprice / 200000 AS p FROM lineitem), r AS (SELECT *, p * count(*) OVER () / (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS raw FROM p)
    SELECT l_orderkey, l_partkey, round(p, 9) AS p, round(least(min(raw) OVER (ORDER BY p DESC), 1), 6) AS qval FROM r""")
def _(spark, sf):
    p = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_extendedprice") / 200000).alias("p"))
    return rk.bh_fdr(p, "p").select("l_orderkey", "l_partkey", F.round("p", 9).alias("p"), F.round("qval", 6).alias("qval"))


def peaks(spark, sf):
    """Peaks are made once, and read by all parts of a query."""
    return cut_lineage(load(spark, sf, "peaks_u"))


def binding(spark, sf, bed):
    motifs = load(spark, sf, "motifs")
    tfs = motifs.select(F.col("name").alias("tf")).distinct()
    return tf_binding(bed, motifs, tfs), tfs


def gene2peak(spark, sf, bed):
    return window_graph(load(spark, sf, "anchors"), bed, 0).select("source", "target")


def genes(spark, sf):
    return load(spark, sf, "anchors").select(F.col("name").alias("gene"))


def regions(bed):
    return bed.select(F.col("name").alias("region"), (F.col("chromEnd") - F.col("chromStart")).alias("length"))


OBS = """gp AS (SELECT a.name AS gene, p.name AS peak FROM anchors a JOIN peaks_u p ON a.chrom = p.chrom AND a.chromStart < p.chromEnd AND p.chromStart < a.chromEnd),
    pt AS (SELECT p.name AS peak, m.name AS tf FROM peaks_u p JOIN motifs m ON p.chrom = m.chrom AND p.chromStart < m.chromEnd AND m.chromStart < p.chromEnd),
    gn AS (SELECT gene, peak, count(*) AS d FROM gp GROUP BY 1, 2), pn AS (SELECT peak, tf, count(*) AS c FROM pt GROUP BY 1, 2),
    ob AS (SELECT gene, tf, sum(1.0 * d * c) AS o FROM gn JOIN pn ON gn.peak = pn.peak GROUP BY 1, 2), tf AS (SELECT DISTINCT name AS tf FROM motifs)"""
#: Peaks have seven lengths, so there are seven bins. Samples are drawn as the library states it.
SAMPLED = """qe AS (SELECT list_sort(list_distinct(quantile_cont(CAST(chromEnd - chromStart AS DOUBLE), [0, 1/7, 2/7, 3/7, 4/7, 5/7, 6/7, 1]))) AS e FROM peaks_u),
    rb AS (SELECT name AS peak, CAST('0x' || substr(md5('0|' || name), 1, 15) AS BIGINT) AS pk, greatest(len(list_filter(e, lambda x: x < chromEnd - chromStart)), 1) AS bin FROM peaks_u, qe),
    pl AS (SELECT peak, bin, row_number() OVER (PARTITION BY bin ORDER BY pk, peak) - 1 AS pos, count(*) OVER (PARTITION BY bin) AS n FROM rb),
    ls0 AS (SELECT gene, gn.peak, d, bin, n, md5('1|' || gene || '|' || gn.peak) AS h FROM gn JOIN pl ON gn.peak = pl.peak),
    ls1 AS (SELECT gene, d, bin, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 2147483647 AS s0, CAST('0x' || substr(h, 9, 8) AS BIGINT) % 2147483647 AS s1,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) % 2147483647 AS s2, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 2147483647 AS s3 FROM ls0),
    dr AS (SELECT gene, d, bin, k, ((((s3 * k + s2) % 2147483647 * k + s1) % 2147483647 * k + s0) % 2147483647) * n // 2147483647 AS pos FROM ls1, (SELECT unnest(range(0, 1000)) AS k)),
    sm AS (SELECT dr.gene, pn.tf, k, sum(d * c) AS p FROM dr JOIN pl ON dr.bin = pl.bin AND dr.pos = pl.pos JOIN pn ON pl.peak = pn.peak GROUP BY 1, 2, 3),
    en AS (SELECT ob.gene, ob.tf, 1000.0 - count(sm.p) AS o FROM ob LEFT JOIN sm ON ob.gene = sm.gene AND ob.tf = sm.tf AND sm.p > ob.o GROUP BY 1, 2)"""


def all_ranks(table: str, more: str = "") -> str:
    return f"""SELECT gene, tf, {more}CAST(rank() OVER (PARTITION BY tf ORDER BY o DESC) + (count(*) OVER (PARTITION BY tf, o) - 1) / 2.0 AS DOUBLE) AS rank
        FROM (SELECT a.name AS gene, tf.tf, coalesce(o, 0) AS o FROM anchors a CROSS JOIN tf LEFT JOIN {table} t ON t.gene = a.name AND t.tf = tf.tf)"""


@query("inf04_cis_ranking_observed", f"WITH {OBS} {all_ranks('ob')}")
def _(spark, sf):
    bed = peaks(spark, sf)
    r2t, tfs = binding(spark, sf, bed)
    return nf.cis_regulatory_ranking(gene2peak(spark, sf, bed), r2t, genes(spark, sf), regions(bed), tfs, n_samples=0)


@query("inf04_cis_regulatory_ranking", f"WITH {OBS}, {SAMPLED} {all_ranks('en')}")
def _(spark, sf):
    bed = peaks(spark, sf)
    r2t, tfs = binding(spark, sf, bed)
    return nf.cis_regulatory_ranking(gene2peak(spark, sf, bed), r2t, genes(spark, sf), regions(bed), tfs)


@query("inf04_one_region_per_bin", """WITH ob AS (SELECT DISTINCT concat('s', l_suppkey) AS gene, b.p_type AS tf FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON a.p_brand = b.p_brand),
    g AS (SELECT concat('s', s_suppkey) AS gene FROM supplier), t AS (SELECT DISTINCT p_type AS tf FROM part), f AS (SELECT g.gene, t.tf, CASE WHEN ob.gene IS NULL THEN 0 ELSE 1000 END AS o FROM g CROSS JOIN t LEFT JOIN ob ON ob.gene = g.gene AND ob.tf = t.tf)
    SELECT gene, tf, CAST(rank() OVER (PARTITION BY tf ORDER BY o DESC) + (count(*) OVER (PARTITION BY tf, o) - 1) / 2.0 AS DOUBLE) AS rank FROM f""")
def _(spark, sf):
    """Each brand is a region of a length of its own: every sample draws what is observed."""
    part, brand = load(spark, sf, "part"), F.col("p_brand").alias("source")
    g2r = load(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.col("p_brand").alias("target"))
    lens = part.select(F.col("p_brand").alias("region"), F.substring("p_brand", 7, 9).cast("int").alias("length")).distinct()
    all_genes, tfs = load(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("gene")), part.select(F.col("p_type").alias("tf")).distinct()
    return nf.cis_regulatory_ranking(g2r, part.select(brand, F.col("p_type").alias("target")), all_genes, lens, tfs)


@query("inf05_qcut", """WITH q AS (SELECT list_sort(list_distinct(quantile_cont(CAST(p_size AS DOUBLE), [i / 40.0 for i in range(0, 41)]))) AS e FROM part)
    SELECT p_partkey, CAST(greatest(len(list_filter(e, lambda x: x < p_size)), 1) - 1 AS INTEGER) AS bin,
    CASE WHEN p_size <= 10 THEN '0-10' WHEN p_size <= 20 THEN '10-20' WHEN p_size <= 45 THEN '20-45' END AS label FROM part, q""")
def _(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_size")
    return nf.cut(nf.qcut(p, "p_size", 40), "p_size", [0, 10, 20, 45], ["0-10", "10-20", "20-45"], out="label").select("p_partkey", "bin", "label")


@query("inf05_quantile_edges", "SELECT CAST(unnest(range(0, 101)) AS INTEGER) AS i, round(unnest(quantile_cont(o_totalprice, [i / 100.0 for i in range(0, 101)])), 5) AS edge FROM orders")
def _(spark, sf):
    return rounded(nf.quantile_edges(load(spark, sf, "orders"), "o_totalprice", 100), 5)


@query("inf06_cis_enrichment_fraction", f"WITH {OBS}, {SAMPLED} {all_ranks('en', 'CAST(o / 1000 AS DOUBLE) AS fraction, ')}")
def _(spark, sf):
    bed = peaks(spark, sf)
    r2t, tfs = binding(spark, sf, bed)
    return nf.cis_regulatory_ranking(gene2peak(spark, sf, bed), r2t, genes(spark, sf), regions(bed), tfs, normalize=True)


FLANKS = """fl AS (SELECT name AS gene, chrom, greatest(CASE WHEN strand = '+' THEN chromStart ELSE chromEnd - 1 END - 500, 0) AS f0, CASE WHEN strand = '+' THEN chromStart ELSE chromEnd - 1 END + 501 AS f1 FROM anchors),
    fo AS (SELECT gene, m.name AS tf, count(*) AS o FROM fl JOIN motifs m ON fl.chrom = m.chrom AND f0 < m.chromEnd AND m.chromStart < f1 GROUP BY 1, 2)"""


@query("inf07_tf_target_ranks", f"""WITH {OBS}, {SAMPLED}, {FLANKS}, a AS ({all_ranks('en')}), b AS ({all_ranks('fo')})
    SELECT gene, tf || '_peak' AS tf, rank FROM a UNION ALL SELECT gene, tf || '_flank' AS tf, rank FROM b""")
def _(spark, sf):
    motifs, bed = load(spark, sf, "motifs"), peaks(spark, sf)
    tfs = motifs.select(F.col("name").alias("tf")).distinct()
    return tf_target_ranks(load(spark, sf, "anchors"), bed, gene2peak(spark, sf, bed), tfs, motifs)


@query("inf08_evidence_table", """WITH sk AS (SELECT DISTINCT source, target FROM ed), f AS (SELECT source, target, bool_or(sign = -1) AS ret, coalesce(max(weight) FILTER (WHERE type = 'O'), 0) AS open_w, min(dist) AS dist FROM ed GROUP BY 1, 2)
    SELECT sk.source, sk.target, dist, ret, round(open_w, 6) AS open_w, CASE WHEN dist <= 10 THEN '0-10' WHEN dist <= 30 THEN '10-30' ELSE '30-50' END AS dist_bin FROM sk JOIN f ON sk.source = f.source AND sk.target = f.target""")
def _(spark, sf):
    ed = load(spark, sf, "ed")
    skel = ed.groupBy("source", "target").agg(F.min("dist").alias("dist"))
    return rounded(nf.evidence_table(skel, {"ret": ed.where("sign = -1"), "open_w": ed.where("type = 'O'").select("source", "target", F.col("weight").alias("value"))},
                                     bins=([0, 10, 30, 50], ["0-10", "10-30", "30-50"])))


@query("inf09_quantile_filter_top_n", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.8) AS e FROM orders), f AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders, q WHERE o_totalprice >= e)
    SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM f) WHERE r <= 2""")
def _(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return nf.top_n(nf.quantile_filter(o, "o_totalprice", 0.2), "o_custkey", "o_totalprice", 2, ["o_orderkey"])


@query("inf10_coaccess_links", """WITH h AS (SELECT DISTINCT a.name AS gene, p.name AS peak1 FROM anchors a JOIN peaks p ON a.chrom = p.chrom AND a.chromStart < p.chromEnd AND p.chromStart < a.chromEnd),
    c AS (SELECT concat('o', l_orderkey) AS peak1, concat('o', l_partkey) AS peak2, l_discount AS coaccess FROM lineitem)
    SELECT gene, peak2 AS peak, max(coaccess) AS coaccess FROM c JOIN h ON c.peak1 = h.peak1 GROUP BY 1, 2""")
def _(spark, sf):
    conns = load(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("peak1"), F.concat(F.lit("o"), "l_partkey").alias("peak2"), F.col("l_discount").alias("coaccess"))
    return nf.coaccess_links(conns, load(spark, sf, "peaks"), load(spark, sf, "anchors"))


CURVE = """t AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM ls GROUP BY score), c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM t)"""


@query("inf11_auroc", f"WITH {CURVE} SELECT round(sum(n * (cp - p / 2)) / (max(tp) * max(tn)), 6) AS auroc FROM c")
def _(spark, sf):
    return rounded(nf.auroc(load(spark, sf, "ls"), "label", "score"))


@query("inf11_roc", f"WITH {CURVE} SELECT round(cn / tn, 6) AS fpr, round(cp / tp, 6) AS tpr, score AS threshold FROM c")
def _(spark, sf):
    return rounded(nf.roc(load(spark, sf, "ls"), "label", "score", max_points=10**9))


THINNED = """, p AS (SELECT *, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS cnt FROM c), th AS (SELECT * FROM p WHERE cnt <= 100 OR r = 1 OR floor((r - 2) * 100 / cnt) <> floor((r - 1) * 100 / cnt))"""


@query("inf11_roc_thinned", f"WITH {CURVE}{THINNED} SELECT round(cn / tn, 6) AS fpr, round(cp / tp, 6) AS tpr, score AS threshold FROM th")
def _(spark, sf):
    return rounded(nf.roc(load(spark, sf, "ls"), "label", "score", max_points=100))


@query("inf12_prc_thinned", f"WITH {CURVE}{THINNED} SELECT round(cp / tp, 6) AS recall, round(cp / (cp + cn), 6) AS precision, score AS threshold FROM th")
def _(spark, sf):
    return rounded(nf.prc(load(spark, sf, "ls"), "label", "score", max_points=100))


@query("inf12_average_precision", f"WITH {CURVE} SELECT round(sum(p * cp / (cp + cn)) / max(tp), 6) AS average_precision FROM c")
def _(spark, sf):
    return rounded(nf.average_precision(load(spark, sf, "ls"), "label", "score"))


@query("inf12_prc", f"WITH {CURVE} SELECT round(cp / tp, 6) AS recall, round(cp / (cp + cn), 6) AS precision, score AS threshold FROM c")
def _(spark, sf):
    return rounded(nf.prc(load(spark, sf, "ls"), "label", "score", max_points=10**9))


@query("inf13_fisher_counts", """WITH a AS (SELECT DISTINCT source, target FROM ed WHERE sign = -1), b AS (SELECT DISTINCT source, target FROM ed WHERE type = 'O'), j AS (SELECT a.source AS x, b.source AS y FROM a FULL JOIN b ON a.source = b.source AND a.target = b.target)
    SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS "both", count(*) FILTER (WHERE y IS NULL) AS only_a, count(*) FILTER (WHERE x IS NULL) AS only_b,
    (SELECT count(*) FROM supplier) * (SELECT count(*) FROM part) - count(*) AS neither FROM j""")
def _(spark, sf):
    return _fisher(spark, sf).drop("pval")


@query("inf13_fisher_edges", """WITH a AS (SELECT DISTINCT source, target FROM ed WHERE sign = -1), b AS (SELECT DISTINCT source, target FROM ed WHERE type = 'O'), j AS (SELECT a.source AS x, b.source AS y FROM a FULL JOIN b ON a.source = b.source AND a.target = b.target),
    t AS (SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS k, count(*) FILTER (WHERE x IS NOT NULL) AS r, count(*) FILTER (WHERE y IS NOT NULL) AS c, (SELECT count(*) FROM supplier) * (SELECT count(*) FROM part) AS n FROM j),
    l AS (SELECT *, lgamma(r + 1) - lgamma(i + 1) - lgamma(r - i + 1) + lgamma(n - r + 1) - lgamma(c - i + 1) - lgamma(n - r - c + i + 1) - lgamma(n + 1) + lgamma(c + 1) + lgamma(n - c + 1) AS lp
        FROM (SELECT *, unnest(range(greatest(0, r + c - n), least(r, c) + 1)) AS i FROM t))
    SELECT k AS "both", r - k AS only_a, c - k AS only_b, n - r - c + k AS neither, round(least(1, sum(exp(lp)) FILTER (WHERE lp <= own + 1e-7)), 6) AS pval FROM (SELECT *, max(lp) FILTER (WHERE i = k) OVER () AS own FROM l) GROUP BY k, r, c, n""")
def _(spark, sf):
    return rounded(_fisher(spark, sf))


def _fisher(spark, sf):
    ed = load(spark, sf, "ed")
    return nf.fisher_edges(ed.where("sign = -1"), ed.where("type = 'O'"), load(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source")),
                           load(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("target")))


@query("inf14_discovery_rate", """SELECT round(avg(CASE WHEN weight < 0.93 THEN 1.0 ELSE 0 END), 6) AS rate_all, round(avg(CASE WHEN weight < 0.93 THEN 1.0 ELSE 0 END) FILTER (WHERE (source, target) IN (SELECT (source, target) FROM ed WHERE sign = -1)), 6) AS rate_subset FROM ed""")
def _(spark, sf):
    ed = load(spark, sf, "ed")
    return rounded(nf.discovery_rate(ed.withColumn("qval", F.col("weight")), ed.where("sign = -1"), 0.93))


@query("inf15_targets_per_tf", "SELECT source AS tf, count(DISTINCT target) AS n_targets FROM ed GROUP BY source")
def _(spark, sf):
    return nf.targets_per_tf(load(spark, sf, "ed"))
