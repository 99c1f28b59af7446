"""SRC-* and SNK-* queries: files are written from the given tables, then read back."""

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.views import load
from strandloom.functions.genome import BED_COLUMNS, rectify_bed, rectify_gtf
from strandloom.functions.runtime import scratch_path
from strandloom.sources import sinks as sk
from strandloom.sources import text as tx


def put_text(spark, df, name):
    """Write one string column as text lines."""
    path = scratch_path(spark, name)
    df.write.text(path)
    return path


def put_ordered(spark, df, name):
    """Write lines whose order (column ``o``) matters as files in the order of their names; equal ``o`` may come in any order."""
    path = scratch_path(spark, name)
    df.repartitionByRange("o", F.xxhash64("value")).sortWithinPartitions("o").select("value").write.text(path)
    return path


@query("src01_read_bed", "SELECT chrom, chromStart, chromEnd, name, score, '.' AS strand, '.' AS blockStarts FROM peaks")
def _(spark, sf):
    path = scratch_path(spark, "bed")
    sk.write_bed(load(spark, sf, "peaks"), path, ncols=5)
    return tx.read_bed(spark, path).select("chrom", "chromStart", "chromEnd", "name", "score", "strand", "blockStarts")


@query("src02_rectify_bed", "SELECT chrom, chromStart, chromEnd, name, '.' AS score, strand, " + ", ".join(f"'.' AS {c}" for c in BED_COLUMNS[6:]) + " FROM anchors")
def _(spark, sf):
    return rectify_bed(load(spark, sf, "anchors").drop("score").withColumn("extra", F.lit(1)))


@query("src03_read_gtf", """SELECT seqname, source, feature, "start", "end", strand, attribute FROM gtf""")
def _(spark, sf):
    gtf = load(spark, sf, "gtf")
    head = spark.sql("SELECT '# comment line' AS value")
    lines = gtf.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attribute")]).alias("value"))
    return tx.read_gtf(spark, put_text(spark, head.unionByName(lines), "gtf")).select("seqname", "source", "feature", "start", "end", "strand", "attribute")


@query("src04_rectify_gtf", """SELECT seqname, '.' AS source, feature, "start", "end", '.' AS score, strand, '.' AS frame, '.' AS attribute, 1 AS extra FROM gtf""")
def _(spark, sf):
    return rectify_gtf(load(spark, sf, "gtf").select(F.lit(1).alias("extra"), "strand", "end", "start", "feature", "seqname"))


@query("src05_read_fai", "SELECT concat('chr', p_partkey) AS chrom, CAST(p_size AS BIGINT) AS length FROM part")
def _(spark, sf):
    lines = load(spark, sf, "part").select(F.concat_ws("\t", F.concat(F.lit("chr"), "p_partkey"), "p_size", F.lit(6), F.lit(60), F.lit(61)).alias("value"))
    return tx.read_fai(spark, put_text(spark, lines, "fai"))


@query("src06_read_bedmap", """SELECT CAST(l_suppkey AS VARCHAR) AS cell, concat('r', l_partkey) AS feature, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("c"))
    lines = li.select(F.concat_ws("\t", F.lit("chr1"), F.col("l_partkey"), F.col("l_partkey") + 9, F.concat(F.lit("r"), "l_partkey"), F.lit("."), F.lit("+"), F.concat_ws(";", "c")).alias("value"))
    return tx.read_bedmap(spark, put_text(spark, lines, "bedmap"))[0]


@query("src07_read_ctx_grn", "SELECT DISTINCT concat('TF', l_suppkey) AS source, concat('G', l_partkey) AS target FROM lineitem")
def _(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.collect_set(F.concat(F.lit("('G"), "l_partkey", F.lit("', 1.0)"))).alias("t"))
    lines = li.select(F.concat(F.lit("TF"), "l_suppkey", F.lit(',m,0,0,0,0,0,0,"['), F.concat_ws(", ", "t"), F.lit(']",0')).alias("value"))
    head = spark.createDataFrame([(",,Enrichment,,,,,,,",), (",,AUC,NES,,,,,TargetGenes,",), ("TF,MotifID,,,,,,,,",)], "value string")
    return tx.read_ctx_grn(spark, put_text(spark, head.unionByName(lines), "ctx"))[0]


@query("src08_read_mtx", """SELECT concat('cell', l_suppkey) AS cell, concat('gene', l_partkey) AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    li = load(spark, sf, "lineitem")
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    low = {"s": s.agg(F.min("k")).first()[0], "p": p.agg(F.min("k")).first()[0]}
    sizes = (p.count(), s.count(), li.select("l_partkey", "l_suppkey").distinct().count())
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general", 0), ("%", 1), (f"{sizes[0]} {sizes[1]} {sizes[2]}", 2)], "value string, o int")
    body = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q")).select(
        F.concat_ws(" ", F.col("l_partkey") - low["p"] + 1, F.col("l_suppkey") - low["s"] + 1, "q").alias("value"), F.lit(3).alias("o"))
    mtx = put_ordered(spark, head.union(body), "mtx")
    barcodes = put_ordered(spark, s.select(F.concat(F.lit("cell"), "k").alias("value"), F.col("k").alias("o")), "barcodes")
    feats = put_ordered(spark, p.select(F.concat(F.lit("gene"), "k", F.lit("\tx")).alias("value"), F.col("k").alias("o")), "features")
    return tx.read_mtx(spark, mtx, barcodes, feats)


@query("src09_from_long", "SELECT CAST(l_suppkey AS VARCHAR) AS cell, CAST(l_partkey AS VARCHAR) AS feature, sum(l_quantity) AS value FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2")
def _(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("q", F.when(F.col("l_quantity") > 5, F.col("l_quantity")))
    return tx.from_long(li, "l_suppkey", "l_partkey", "q")


@query("src10_read_eqtl", """SELECT concat('chr', l_suppkey) AS chrom, l_partkey - 1 AS chromStart, l_partkey - 1 + l_linenumber AS chromEnd, concat('ENSG', l_orderkey) AS name, CAST(l_linenumber AS VARCHAR) AS score, '.' AS strand FROM lineitem""")
def _(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        F.concat_ws("_", F.concat(F.lit("chr"), "l_suppkey"), "l_partkey", F.expr("repeat('A', l_linenumber)"), F.lit("G"), F.lit("b38")).alias("variant_id"),
        F.concat(F.lit("ENSG"), "l_orderkey").alias("gene_id"), F.col("l_linenumber").cast("string").alias("pval_beta"))
    path = scratch_path(spark, "eqtl")
    rows.write.csv(path, sep="\t", header=True)
    return tx.read_eqtl(spark, path)


@query("src11_read_pchic", """SELECT CAST(l_suppkey AS VARCHAR) AS source, CAST(l_partkey AS VARCHAR) AS target, greatest(l_quantity / 6, l_linenumber * 1.5) AS score FROM lineitem
    WHERE greatest(l_quantity / 6, l_linenumber * 1.5) > 5 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def _(spark, sf):
    part = load(spark, sf, "part").where("p_size > 10")
    rmap = put_text(spark, part.select(F.concat_ws("\t", F.lit("1"), F.col("p_partkey") * 100 + 1, F.col("p_partkey") * 100 + 100, "p_partkey").alias("value")), "rmap")
    bait = put_text(spark, load(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat_ws("\t", F.lit("1"), F.lit(1), F.lit(9), "s_suppkey", F.lit("A;B")).alias("value")), "baitmap")
    path = scratch_path(spark, "pchic")
    load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("baitID"), F.col("l_partkey").alias("oeID"), (F.col("l_quantity") / 6).alias("Mon"), (F.col("l_linenumber") * 1.5).alias("nB"),
                                       F.lit(99.0).alias("other")).write.csv(path, sep="\t", header=True)
    return tx.read_pchic(spark, rmap, bait, path, ["Mon", "nB"])[2]


@query("src12_read_embedding", "SELECT concat(vec_id, '-x') AS cell, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM embeddings")
def _(spark, sf):
    c = load(spark, sf, "cells")
    path = scratch_path(spark, "emb")
    c.select("cell", *[F.col("rep")[i] for i in range(64)]).write.csv(path)
    return rounded(tx.read_embedding(spark, path, 64, "-x").select("cell", F.col("rep")[0].alias("first"), F.col("rep")[63].alias("last")))


@query("src13_read_runs", "SELECT o_orderpriority AS dataset, o_orderstatus AS method, CAST(o_orderkey % 8 AS VARCHAR) AS seed, round(avg(o_totalprice), 4) AS map, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    runs = load(spark, sf, "runs").groupBy("dataset", "method", "seed").agg(F.avg("m1").alias("map"), F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "runs")
    lines = runs.select("dataset", "method", "seed", F.concat(F.lit("cmd: python run.py\nmap: "), F.round("map", 8), F.lit("\nn: "), "n", F.lit("\nargs: {}")).alias("value"))
    lines.repartition("dataset", "method", "seed").write.partitionBy("dataset", "method", "seed").text(path)
    return rounded(tx.read_runs(spark, path, "dataset={dataset}/method={method}/seed={seed}", ["map", "n"]), 4)


@query("snk01_write_bed", "SELECT chrom, chromStart, chromEnd, name, '.' AS strand FROM anchors")
def _(spark, sf):
    path = scratch_path(spark, "bed")
    sk.write_bed(load(spark, sf, "anchors"), path, ncols=4)
    return tx.read_bed(spark, path).select("chrom", "chromStart", "chromEnd", "name", "strand")


LINKS = """FROM (SELECT concat('g', l_partkey) AS source, concat('g', l_suppkey) AS target, 1 - l_discount AS weight FROM lineitem) e LEFT JOIN anchors a ON a.name = e.source LEFT JOIN anchors b ON b.name = e.target"""


def link_edges(spark, sf):
    return load(spark, sf, "lineitem").select(F.concat(F.lit("g"), "l_partkey").alias("source"), F.concat(F.lit("g"), "l_suppkey").alias("target"), (1 - F.col("l_discount")).alias("weight"))


@query("snk02_write_links", f"""SELECT a.chrom AS chrom_x, CAST(a.chromStart AS VARCHAR) AS chromStart_x, CAST(b.chromEnd AS VARCHAR) AS chromEnd_y, round(weight, 4) AS weight {LINKS}""")
def _(spark, sf):
    path, bed = scratch_path(spark, "links"), load(spark, sf, "anchors")
    sk.write_links(link_edges(spark, sf), bed, bed, path, ["weight"])
    raw = spark.read.csv(path, sep="\t", schema="chrom_x STRING, chromStart_x STRING, chromEnd_x STRING, chrom_y STRING, chromStart_y STRING, chromEnd_y STRING, weight DOUBLE")
    return raw.select("chrom_x", "chromStart_x", "chromEnd_y", F.round("weight", 4).alias("weight"))


@query("snk03_annotated_links", f"""SELECT a.chrom AS chrom_x, a.chromStart AS chromStart_x, a.chromEnd AS chromEnd_x, b.chrom AS chrom_y, b.chromStart AS chromStart_y, b.chromEnd AS chromEnd_y, round(weight, 6) AS score, source AS gene {LINKS} WHERE a.chrom = b.chrom""")
def _(spark, sf):
    bed = load(spark, sf, "anchors")
    return rounded(sk.annotated_links(link_edges(spark, sf), bed, bed, "weight"))


@query("snk04_rank_table", """SELECT p_brand AS tracks, CAST(max(CASE WHEN p_type = 'LARGE' THEN p_size END) AS SMALLINT) AS "LARGE", CAST(max(CASE WHEN p_type = 'ECONOMY' THEN p_size END) AS SMALLINT) AS "ECONOMY",
    CAST(max(CASE WHEN p_type = 'MEDIUM' THEN p_size END) AS SMALLINT) AS "MEDIUM" FROM part GROUP BY p_brand""")
def _(spark, sf):
    p = load(spark, sf, "part").groupBy(F.col("p_type").alias("gene"), F.col("p_brand").alias("tf")).agg(F.max("p_size").alias("rank"))
    path = scratch_path(spark, "ranks") + sk.RANK_SUFFIX
    sk.write_rank_table(p, path)
    return sk.load(spark, path).select("tracks", "LARGE", "ECONOMY", "MEDIUM")


@query("snk05_save_load", "SELECT cell, feature, value FROM mx")
def _(spark, sf):
    path = scratch_path(spark, "mx")
    sk.save(load(spark, sf, "mx"), path)
    return sk.load(spark, path)
