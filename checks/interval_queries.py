"""IVL-* queries."""

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.views import load
from strandloom.functions.genome import dist_power_decay
from strandloom.operators import intervals as iv

DIST = """CASE WHEN a.chromStart >= p.chromEnd THEN a.chromStart - p.chromEnd + 1
    WHEN a.chromEnd <= p.chromStart THEN a.chromEnd - p.chromStart - 1 ELSE 0 END"""
MERGED = """SELECT {by}chrom, min(chromStart) AS chromStart, max(chromEnd) AS chromEnd FROM (
    SELECT *, sum(f) OVER (PARTITION BY {by}chrom ORDER BY chromStart, chromEnd ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN chromStart <= max(chromEnd) OVER (PARTITION BY {by}chrom ORDER BY chromStart, chromEnd
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f
    FROM (SELECT DISTINCT {by}chrom, chromStart, chromEnd FROM {src}))) GROUP BY {by}chrom, g"""


@query("ivl01_window_graph", f"""SELECT a.name AS source, p.name AS target, {DIST} AS dist,
    round(power((abs({DIST}) + 1000.0) / 1000.0, -0.75), 6) AS weight FROM anchors a JOIN peaks p ON a.chrom = p.chrom
    AND a.chromStart - 300 < p.chromEnd AND p.chromStart < a.chromEnd + 300""")
def _(spark, sf):
    return rounded(iv.window_graph(load(spark, sf, "anchors"), load(spark, sf, "peaks"), 300,
                                   lambda l, r, d: {"weight": dist_power_decay(F.abs(d))}))


@query("ivl02_drop_overlapping", """SELECT chrom, chromStart, chromEnd, name FROM anchors a WHERE NOT EXISTS (
    SELECT 1 FROM motifs p WHERE a.chrom = p.chrom AND a.chromStart < p.chromEnd AND p.chromStart < a.chromEnd)""")
def _(spark, sf):
    return iv.drop_overlapping(load(spark, sf, "anchors"), load(spark, sf, "motifs"), ids=["name"]).select(
        "chrom", "chromStart", "chromEnd", "name")


@query("ivl03_merge_intervals", MERGED.format(by="", src="peaks"))
def _(spark, sf):
    return iv.merge_intervals(load(spark, sf, "peaks"))


@query("ivl03_merge_time_spans", MERGED.format(by="", src="ev_iv"))
def _(spark, sf):
    return iv.merge_intervals(load(spark, sf, "ev_iv"))


@query("ivl04_merge_per_name", MERGED.format(by="name, ", src="motifs"))
def _(spark, sf):
    return iv.merge_intervals(load(spark, sf, "motifs"), by=["name"])


@query("ivl05_count_fragments", """SELECT p.name AS cell, a.name AS feature, CAST(count(*) AS DOUBLE) AS value FROM anchors a JOIN peaks p
    ON a.chrom = p.chrom AND a.chromStart < p.chromEnd AND p.chromStart < a.chromEnd GROUP BY 1, 2""")
def _(spark, sf):
    frags = load(spark, sf, "peaks").withColumnRenamed("name", "cell")
    return iv.count_fragments(frags, load(spark, sf, "anchors"))


@query("ivl06_remap_features", f"""WITH mg AS (SELECT *, concat(chrom, ':', chromStart) AS name FROM ({MERGED.format(by="", src="motifs")})),
    m AS (SELECT CAST(l_suppkey AS VARCHAR) AS cell, concat('g', l_partkey) AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)
    SELECT m.cell, p.name AS feature, sum(m.value) AS value FROM m JOIN anchors a ON m.feature = a.name JOIN mg p
    ON a.chrom = p.chrom AND a.chromStart < p.chromEnd AND p.chromStart < a.chromEnd GROUP BY 1, 2""")
def _(spark, sf):
    merged = iv.merge_intervals(load(spark, sf, "motifs")).withColumn("name", F.concat_ws(":", "chrom", "chromStart"))
    m = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("cell"),
                                            F.concat(F.lit("g"), "l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value"))
    return iv.remap_features(m, load(spark, sf, "anchors"), merged)


@query("ivl07_tf_binding", """SELECT a.name AS source, p.name AS target FROM anchors a JOIN motifs p ON a.chrom = p.chrom
    AND a.chromStart < p.chromEnd AND p.chromStart < a.chromEnd WHERE p.name IN ('tf1', 'tf2', 'tf3', 'tf5', 'tf8', 'tf13')""")
def _(spark, sf):
    tfs = load(spark, sf, "motifs").where(F.col("name").isin("tf1", "tf2", "tf3", "tf5", "tf8", "tf13")).select(F.col("name").alias("tf"))
    return iv.tf_binding(load(spark, sf, "anchors"), load(spark, sf, "motifs"), tfs)


@query("ivl08_region_slice", """SELECT chrom, chromStart, chromEnd, name FROM peaks WHERE chrom = 'chr2' AND chromStart >= 20000 AND chromEnd <= 60000""")
def _(spark, sf):
    return iv.region_slice(load(spark, sf, "peaks"), "chr2", 20000, 60000).select("chrom", "chromStart", "chromEnd", "name")
