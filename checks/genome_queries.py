"""GEN-* queries."""

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.views import load
from strandloom.functions import genome as g

BED = "chrom, chromStart, chromEnd, name, strand"
B5 = ["chrom", "chromStart", "chromEnd", "name", "strand"]


@query("gen01_split_attribute", """SELECT seqname, regexp_extract(attribute, 'gene_id "([^"]+)"', 1) AS gene_id,
    regexp_extract(attribute, 'gene_name "([^"]+)"', 1) AS gene_name,
    regexp_extract(attribute, 'source "([^"]+)"', 1) AS source, CAST(NULL AS VARCHAR) AS level, 3 AS n_keys FROM gtf""")
def _(spark, sf):
    gtf = g.rectify_gtf(load(spark, sf, "gtf"))
    mapped = g.split_attribute(gtf).withColumn("n_keys", F.size("attributes"))
    return g.split_attribute(mapped, ["gene_id", "gene_name", "source", "level"]).select(
        "seqname", "gene_id", "gene_name", "source", "level", "n_keys")


@query("gen02_gtf_to_bed", """SELECT seqname AS chrom, "start" - 1 AS chromStart, "end" AS chromEnd, feature AS name, strand FROM gtf""")
def _(spark, sf):
    return g.gtf_to_bed(load(spark, sf, "gtf"), "feature").select(*B5)


@query("gen03_start_site", """SELECT chrom, CASE WHEN strand = '+' THEN chromStart ELSE chromEnd - 1 END AS chromStart,
    CASE WHEN strand = '+' THEN chromStart + 1 ELSE chromEnd END AS chromEnd, name, strand FROM anchors""")
def _(spark, sf):
    return g.start_site(load(spark, sf, "anchors")).select(*B5)


@query("gen04_end_site", """SELECT chrom, CASE WHEN strand = '+' THEN chromEnd - 1 ELSE chromStart END AS chromStart,
    CASE WHEN strand = '+' THEN chromEnd ELSE chromStart + 1 END AS chromEnd, name, strand FROM anchors""")
def _(spark, sf):
    return g.end_site(load(spark, sf, "anchors")).select(*B5)


@query("gen05_expand", """WITH lens AS (SELECT chrom, max(chromEnd) AS len FROM anchors GROUP BY chrom)
    SELECT a.chrom, greatest(CASE WHEN strand = '+' THEN chromStart - 300 ELSE chromStart - 70 END, 0) AS chromStart,
    least(CASE WHEN strand = '+' THEN chromEnd + 70 ELSE chromEnd + 300 END, len) AS chromEnd, name, strand
    FROM anchors a JOIN lens ON a.chrom = lens.chrom""")
def _(spark, sf):
    bed = load(spark, sf, "anchors")
    lens = bed.groupBy("chrom").agg(F.max("chromEnd").alias("length"))
    return g.expand(bed, 300, 70, lens).select(*B5)


@query("gen06_interval_dist", """SELECT l_orderkey, l_linenumber, CASE WHEN xs >= ye THEN xs - ye + 1
    WHEN xe <= ys THEN xe - ys - 1 ELSE 0 END AS dist FROM (SELECT l_orderkey, l_linenumber, l_partkey AS xs,
    l_partkey + CAST(l_quantity AS BIGINT) AS xe, l_suppkey * 15 AS ys, l_suppkey * 15 + 40 AS ye FROM lineitem)""")
def _(spark, sf):
    xs, q, ys = F.col("l_partkey"), F.col("l_quantity").cast("long"), F.col("l_suppkey") * 15
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                              g.interval_dist(xs, xs + q, ys, ys + 40).alias("dist"))


@query("gen07_dist_power_decay", "SELECT l_orderkey, l_partkey, round(power((l_partkey + 1000.0) / 1000.0, -0.75), 6) AS weight FROM lineitem")
def _(spark, sf):
    return rounded(load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", g.dist_power_decay("l_partkey").alias("weight")))


@query("gen08_ens_trim_version", """SELECT c_custkey, concat('ENSG', c_custkey) AS gene FROM customer""")
def _(spark, sf):
    name = F.concat(F.lit("ENSG"), "c_custkey", F.lit("."), F.col("c_nationkey").cast("string"))
    return load(spark, sf, "customer").select("c_custkey", g.ens_trim_version(name).alias("gene"))


@query("gen09_parse_region", f"SELECT chrom, chromStart, chromEnd, concat(chrom, ':', chromStart, '-', chromEnd) AS region FROM anchors")
def _(spark, sf):
    named = load(spark, sf, "anchors").select(F.concat_ws("-", "chrom", "chromStart", "chromEnd").alias("id"))
    return named.select(g.parse_region("id").alias("r")).select("r.*").withColumn("region", g.region_name())


@query("gen10_nucleotide_content", """WITH reg AS (SELECT CAST(d.doc_id AS VARCHAR) AS chrom, CAST(k * 40 AS BIGINT) AS chromStart,
    CAST(k * 40 + 100 AS BIGINT) AS chromEnd, concat('r', doc_id, '_', k) AS name, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand,
    substring(text, CAST(k * 40 + 1 AS INTEGER), 100) AS s FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text), 1) - 1) // 40 + 1)) AS k FROM documents) d),
    c AS (SELECT *, length(s) AS n, length(s) - length(translate(s, 'Aa', '')) AS a, length(s) - length(translate(s, 'Cc', '')) AS c,
    length(s) - length(translate(s, 'Gg', '')) AS g, length(s) - length(translate(s, 'Tt', '')) AS t,
    length(s) - length(translate(s, 'Nn', '')) AS nn FROM reg)
    SELECT chrom, chromStart, chromEnd, name, strand, CASE WHEN n = 0 THEN NULL ELSE round((a + t) / n, 6) END AS pct_at,
    CASE WHEN n = 0 THEN NULL ELSE round((c + g) / n, 6) END AS pct_gc,
    CAST(CASE WHEN strand = '-' THEN t ELSE a END AS BIGINT) AS num_a, CAST(CASE WHEN strand = '-' THEN g ELSE c END AS BIGINT) AS num_c,
    CAST(CASE WHEN strand = '-' THEN c ELSE g END AS BIGINT) AS num_g, CAST(CASE WHEN strand = '-' THEN a ELSE t END AS BIGINT) AS num_t,
    CAST(nn AS BIGINT) AS num_n, CAST(n - a - c - g - t - nn AS BIGINT) AS num_oth, CAST(n AS BIGINT) AS length FROM c""")
def _(spark, sf):
    docs = load(spark, sf, "documents")
    size = 64
    pieces = F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / size))
    chunks = docs.select(F.col("doc_id").cast("string").alias("chrom"), "text", F.explode(pieces).alias("chunk")).select(
        "chrom", "chunk", F.substring("text", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("seq"))
    k = F.col("k")
    tiles = F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / 40))
    bed = docs.select("doc_id", F.explode(tiles).alias("k")).select(
        F.col("doc_id").cast("string").alias("chrom"), (k * 40).cast("long").alias("chromStart"),
        (k * 40 + 100).cast("long").alias("chromEnd"), F.concat(F.lit("r"), "doc_id", F.lit("_"), "k").alias("name"),
        F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))
    out = g.nucleotide_content(bed, chunks, size)
    empty = F.col("length") == 0
    return rounded(out.withColumns({c: F.when(~empty, F.col(c)) for c in ("pct_at", "pct_gc")}))


@query("gen11_genes_with_promoters", """SELECT seqname AS chrom, CASE WHEN strand = '+' THEN greatest("start" - 1 - 2000, 0) ELSE "start" - 1 END AS chromStart,
    CASE WHEN strand = '+' THEN "end" ELSE "end" + 2000 END AS chromEnd, min(regexp_extract(attribute, 'gene_id "([^"]+)"', 1)) AS name
    FROM gtf WHERE feature = 'gene' GROUP BY 1, 2, 3""")
def _(spark, sf):
    return g.genes_with_promoters(g.rectify_gtf(load(spark, sf, "gtf"))).select("chrom", "chromStart", "chromEnd", "name")


@query("gen12_annotate_genes", """WITH g AS (SELECT seqname, "start" - 1 AS s, "end" AS e, strand,
    regexp_extract(attribute, 'gene_name "([^"]+)"', 1) AS k FROM gtf WHERE feature = 'gene'),
    b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seqname DESC, s) AS rn FROM g)
    SELECT p_partkey, p_name AS feature, b.seqname AS chrom, b.s AS chromStart, b.e AS chromEnd, b.strand AS strand
    FROM part LEFT JOIN b ON p_name = k AND rn = 1""")
def _(spark, sf):
    feats = load(spark, sf, "part").select("p_partkey", F.col("p_name").alias("feature"))
    return g.annotate_genes(feats, g.rectify_gtf(load(spark, sf, "gtf")), "gene_name")


@query("gen13_map_unique", """WITH m AS (SELECT o_custkey AS k, min(o_orderpriority) AS v FROM orders GROUP BY o_custkey
    HAVING count(DISTINCT o_orderpriority) = 1) SELECT c_name, m.v AS c_custkey FROM customer LEFT JOIN m ON c_custkey = k""")
def _(spark, sf):
    mapping = load(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))
    c = load(spark, sf, "customer").select("c_name", F.col("c_custkey").cast("string").alias("c_custkey"))
    return g.map_unique(c, "c_custkey", mapping)


@query("gen14_prefer", """WITH r AS (SELECT *, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#23' THEN 2 WHEN 'Brand#35' THEN 3 END AS k FROM part),
    b AS (SELECT p_type, min(k) AS k FROM r GROUP BY p_type)
    SELECT r.p_partkey, r.p_type, r.p_brand FROM r JOIN b ON r.p_type = b.p_type AND r.k = b.k""")
def _(spark, sf):
    part = load(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    return g.prefer(part, "p_type", "p_brand", ["Brand#11", "Brand#23", "Brand#35"])


@query("gen15_make_unique", """SELECT p_partkey, CASE WHEN rn = 1 THEN p_brand ELSE concat(p_brand, '-', rn - 1) END AS p_brand
    FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)""")
def _(spark, sf):
    return g.make_unique(load(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"])
