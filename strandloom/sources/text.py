"""Readers for the text formats of the workflow. All of them are splittable scans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.genome import BED_COLUMNS, GTF_COLUMNS, rectify_bed, rectify_gtf
from strandloom.functions.runtime import cut_lineage, scalar


def _tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    return spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="", mode="PERMISSIVE",
                          enforceSchema=True)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED with 3 to 12 columns; absent ones become "."."""
    return rectify_bed(_tsv(spark, path, BED_COLUMNS))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return rectify_gtf(_tsv(spark, path, GTF_COLUMNS))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) from a FASTA index."""
    fai = _tsv(spark, path, ["chrom", "length", "offset", "linebases", "linewidth"])
    return fai.select("chrom", F.col("length").cast("long").alias("length"))


def read_fasta_chunks(spark: SparkSession, path: str, chunk_size: int = 65536) -> DataFrame:
    """(chrom, chunk, seq): every sequence cut into pieces of one size.

    The scan is split like that of any text, so a chromosome is read by many tasks. Within a split, running sums give each line its place
    behind the last name line; what lies before a split's first name line continues the record of the splits before it, whose lengths are added
    up over the small table of splits. Lines before the first name are left out, blanks inside lines removed; a record without letters has no piece.
    """
    where = ["file", "split"]
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                                       F.monotonically_increasing_id().alias("line"), "value")
    named = F.startswith("value", F.lit(">"))
    seq = F.when(named, F.lit("")).otherwise(F.regexp_replace("value", r"\s", ""))
    lines = cut_lineage(raw.select(*where, "line", F.when(named, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"), seq.alias("seq"), F.length(seq).cast("long").alias("n")))
    upto = Window.partitionBy(*where).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("end", F.sum("n").over(upto))
    placed = placed.withColumns({"begin": F.last(F.when(F.col("name").isNotNull(), F.col("end")), True).over(upto), "own": F.last("name", True).over(upto)})
    last = F.max(F.when(F.col("name").isNotNull(), F.struct("line", "end", "name")))
    splits = placed.groupBy(*where).agg(F.sum("n").alias("total"), last.alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # over splits, not lines
    splits = splits.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).withColumn("at", F.col("base") + F.col("last.end"))
    splits = splits.select(*where, "base", F.last("at", True).over(before).alias("from_at"), F.last("last.name", True).over(before).alias("from_name"))
    whole = placed.where("n > 0").join(splits, where).select(
        "file", F.coalesce(F.col("base") + F.col("begin"), "from_at").alias("record"), F.coalesce("own", "from_name").alias("chrom"), "seq", "n",
        (F.col("base") + F.col("end") - F.col("n")).alias("at")).where(F.col("record").isNotNull()).withColumn("off", F.col("at") - F.col("record"))
    size = F.lit(chunk_size).cast("long")
    cut = whole.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("off") / size), F.floor((F.col("off") + F.col("n") - 1) / size))))
    first, end = F.greatest(F.col("chunk") * size, "off"), F.least((F.col("chunk") + 1) * size, F.col("off") + F.col("n"))
    part = F.substring("seq", (first - F.col("off") + 1).cast("int"), (end - first).cast("int"))
    pieces = F.array_sort(F.collect_list(F.struct("off", part.alias("part"))))  # chunk_size letters in all
    return (cut.groupBy("file", "record", "chrom", "chunk").agg(F.array_join(F.transform(pieces, lambda x: x["part"]), "").alias("seq"))
               .select("chrom", "chunk", "seq"))


def read_bedmap(spark: SparkSession, path: str, var_col: int = 3, obs_col: int = 6,
                sep: str = ";") -> tuple[DataFrame, DataFrame]:
    """MATRIX of listed cells per feature, and the FEATURES table with every feature.

    A cell listed twice on one line counts 2; a feature with an empty list stays in FEATURES.
    """
    columns = [f"_c{i}" for i in range(max(var_col, obs_col) + 1)]
    raw = _tsv(spark, path, columns)
    features = raw.select(F.col(f"_c{var_col}").alias("feature")).distinct()
    listed = raw.select(F.explode(F.split(f"_c{obs_col}", sep)).alias("cell"), F.col(f"_c{var_col}").alias("feature"))
    matrix = listed.where(F.col("cell") != "").groupBy("cell", "feature").agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    return matrix, features


def read_ctx_grn(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """EDGES TF -> target from a pruned regulon CSV, and (node, type) with TF / target.

    Header rows hold no list of pairs in column 8, so they yield nothing.
    """
    schema = ", ".join(f"_c{i} STRING" for i in range(9))
    raw = spark.read.csv(path, schema=schema, quote='"', escape='"', enforceSchema=True)
    names = F.regexp_extract_all("_c8", F.lit(r"""\(\s*(?:'([^']*)'|"[^"]*")\s*,"""), 1)
    rows = raw.where(F.ltrim("_c8").startswith("["))
    edges = rows.select(F.col("_c0").alias("source"), F.explode(names).alias("target")).distinct()
    tfs = rows.select(F.col("_c0").alias("node")).distinct()
    nodes = tfs.withColumn("type", F.lit("TF")).unionByName(
        edges.select(F.col("target").alias("node")).distinct().join(tfs, "node", "left_anti").withColumn("type", F.lit("target")))
    return edges, nodes


def _with_split(df: DataFrame) -> DataFrame:
    """Mark each line with the file split it came from, (file, start), and its order inside the partition."""
    return df.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("_split"),
                     F.monotonically_increasing_id().alias("_order"), "value")


def read_lines_indexed(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): 1-based line numbers of one text file, or of a folder of files in the order of their names. Windows run per file split."""
    lines = _with_split(spark.read.text(path))
    sizes = lines.groupBy("_split").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_split", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_split").orderBy("_order")
    return lines.join(offsets, "_split").select(
        (F.row_number().over(inside) + F.col("_off")).alias("pos"), "value")


def read_mtx(spark: SparkSession, mtx: str, barcodes: str, features: str) -> DataFrame:
    """MATRIX from MatrixMarket triplets (feature row, cell column, value) and two name files; each may be a folder of files in the order of their names."""
    lines = _with_split(spark.read.text(mtx)).where(~F.col("value").startswith("%"))
    size_line = scalar(lines, F.min(F.struct("_split", "_order")))
    parts = F.split(F.trim("value"), r"\s+")
    entries = lines.where(F.struct("_split", "_order") != size_line).select(
        parts[0].cast("long").alias("_i"), parts[1].cast("long").alias("_j"), parts[2].cast("double").alias("value"))
    name = F.split("value", "\t")[0]
    f = read_lines_indexed(spark, features).select(F.col("pos").alias("_i"), name.alias("feature"))
    c = read_lines_indexed(spark, barcodes).select(F.col("pos").alias("_j"), name.alias("cell"))
    return entries.join(f, "_i").join(c, "_j").select("cell", "feature", "value")


def from_long(df: DataFrame, cell: str, feature: str, value: str) -> DataFrame:
    """MATRIX from a melted table: rows with a null are dropped, repeated pairs add up."""
    clean = df.select(F.col(cell).cast("string").alias("cell"), F.col(feature).cast("string").alias("feature"),
                      F.col(value).cast("double").alias("value")).dropna()
    return clean.where(~F.isnan("value")).groupBy("cell", "feature").agg(F.sum("value").alias("value"))


def parse_eqtl(df: DataFrame) -> DataFrame:
    """BED6-like rows from (variant_id, gene_id, pval_beta): ``chr_pos_ref_alt_build`` IDs."""
    v = F.split("variant_id", "_")
    start = v[1].cast("long") - 1
    return df.select(v[0].alias("chrom"), start.alias("chromStart"), (start + F.length(v[2])).alias("chromEnd"),
                     F.col("gene_id").alias("name"), F.col("pval_beta").cast("string").alias("score"), F.lit(".").alias("strand"))


def read_eqtl(spark: SparkSession, path: str) -> DataFrame:
    return parse_eqtl(spark.read.csv(path, sep="\t", header=True))


def read_pchic(spark: SparkSession, rmap: str, baitmap: str, matrix: str, cell_types: Sequence[str],
               cutoff: float = 5.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Capture Hi-C tables: fragments BED, baits (fragment name, gene), bait -> other-end EDGES.

    A contact is kept when its best score over ``cell_types`` exceeds ``cutoff``.
    """
    frag = _tsv(spark, rmap, ["chrom", "start", "end", "name"])
    fragments = rectify_bed(frag.select("chrom", (F.col("start").cast("long") - 1).alias("chromStart"),
                                        F.col("end").alias("chromEnd"), "name"))
    baits = _tsv(spark, baitmap, ["chrom", "start", "end", "name", "genes"]).select(
        "name", F.explode(F.split("genes", ";")).alias("gene"))
    wide = spark.read.csv(matrix, sep="\t", header=True)
    scores = [F.col(c).cast("double") for c in cell_types]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    contacts = wide.where(best > cutoff).select(F.col("baitID").alias("source"), F.col("oeID").alias("target"),
                                                best.alias("score"))
    known = contacts.join(baits.select(F.col("name").alias("source")).distinct(), "source", "left_semi")
    return fragments, baits, known.join(fragments.select(F.col("name").alias("target")), "target", "left_semi")


def read_embedding(spark: SparkSession, path: str, dim: int, suffix: str = "") -> DataFrame:
    """CELLS(cell, rep) from a header-less CSV: ID, then ``dim`` numbers. ``suffix`` keeps the
    IDs of several inputs apart."""
    schema = "cell STRING, " + ", ".join(f"x{i} DOUBLE" for i in range(dim))
    raw = spark.read.csv(path, schema=schema, enforceSchema=True)
    return raw.select(F.concat("cell", F.lit(suffix)).alias("cell"), F.array(*[f"x{i}" for i in range(dim)]).alias("rep"))


def read_runs(spark: SparkSession, path: str, pattern: str, metrics: Sequence[str]) -> DataFrame:
    """One row per ``key: value`` record file; run parameters come from the file's path.

    ``pattern`` is a path tail such as ``{dataset}/{method}/seed:{seed}``. Only the keys in
    ``metrics`` are read, so command lines and argument dumps stay out.
    """
    names = re.findall(r"\{(\w+)\}", pattern)
    regex = re.sub(r"\\\{\w+\\\}", "([^/]+)", re.escape(pattern))
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    where = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    params = [F.regexp_extract(where, regex, i + 1).alias(n) for i, n in enumerate(names)]
    value = {m: F.regexp_extract("value", rf"(?m)^{re.escape(m)}:\s*(\S+)\s*$", 1) for m in metrics}
    return files.select(*params, *[v.try_cast("double").alias(m) for m, v in value.items()])
