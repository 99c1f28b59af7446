"""Writers of BED, link and rank tables, and Parquet persistence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.genome import rectify_bed
from strandloom.functions.runtime import cut_lineage, scratch_path


def write_bed(df: DataFrame, path: str, ncols: int | None = None) -> None:
    """Tab-separated BED without a header, cut to the first ``ncols`` columns."""
    bed = rectify_bed(df)
    if ncols is not None and ncols < 3:
        raise ValueError("at least the three coordinate columns must be written")
    bed.select(*bed.columns[:ncols]).write.csv(path, sep="\t", quote="", escapeQuotes=False)


def _ends(edges: DataFrame, source_bed: DataFrame, target_bed: DataFrame, extra: Sequence[str]) -> DataFrame:
    def side(bed: DataFrame, key: str, tag: str) -> DataFrame:
        return bed.select(F.col("name").alias(key), *[F.col(c).alias(f"{c}_{tag}") for c in ("chrom", "chromStart", "chromEnd")])

    joined = edges.join(side(source_bed, "source", "x"), "source", "left").join(side(target_bed, "target", "y"), "target", "left")
    return joined.select("chrom_x", "chromStart_x", "chromEnd_x", "chrom_y", "chromStart_y", "chromEnd_y", *extra)


def links(edges: DataFrame, source_bed: DataFrame, target_bed: DataFrame, keep_attrs: Sequence[str] = ()) -> DataFrame:
    """Coordinates of both ends of every edge plus the kept attributes."""
    return _ends(edges, source_bed, target_bed, list(keep_attrs))


def write_links(edges: DataFrame, source_bed: DataFrame, target_bed: DataFrame, path: str,
                keep_attrs: Sequence[str] = ()) -> None:
    links(edges, source_bed, target_bed, keep_attrs).write.csv(path, sep="\t")


def annotated_links(edges: DataFrame, bed1: DataFrame, bed2: DataFrame, score: str, gene: str = "source") -> DataFrame:
    """Links on one chromosome with their score and gene name."""
    named = edges.withColumn("gene", F.col(gene)).withColumn("score", F.col(score))
    return _ends(named, bed1, bed2, ["score", "gene"]).where(F.col("chrom_x") == F.col("chrom_y"))


RANK_SUFFIX = ".genes_vs_tracks.rankings.feather"
#: TFs of a part file; genes of a block.
FILE_TFS, BLOCK_GENES = 64, 1024


def write_rank_table(ranks: DataFrame, path: str, version: int = 2) -> None:
    """Wide TF x gene table of ranks from (gene, tf, rank) as a folder of Parquet files, TFs and genes sorted by name.

    Ranks are 16-bit whole numbers, or 32-bit ones in every column if one of them is above 32,767; fractions are cut off, absent ranks are null.
    Version 1 has the key column ``features`` in front, version 2 ``tracks`` at the end and a fixed file suffix.

    Two stages: each TF's ranks are packed per block of genes, and the task that writes a file of ``FILE_TFS`` TFs lays the blocks side by
    side, next to the blocks of gene names, which every file gets. Neither the driver nor the plan knows the genes.
    """
    if version not in (1, 2):
        raise ValueError("unknown rank table version")
    if version == 2 and not path.endswith(RANK_SUFFIX):
        raise ValueError(f"file name must end with {RANK_SUFFIX}")
    key = "features" if version == 1 else "tracks"
    given = cut_lineage(ranks.groupBy("gene", "tf").agg(F.max("rank").cast("long").alias("rank")))
    shape = given.agg(F.max("rank").alias("top"), F.count_distinct("gene").alias("genes"), F.count_distinct("tf").alias("tfs")).first()
    kind = pa.int32() if (shape["top"] or 0) > 32_767 else pa.int16()
    n_blocks, n_files = -(-shape["genes"] // BLOCK_GENES) or 1, -(-shape["tfs"] // FILE_TFS) or 1
    block = F.pmod(F.xxhash64("gene"), F.lit(n_blocks)).cast("int")
    number = F.floor((F.row_number().over(Window.orderBy("tf")) - 1) / FILE_TFS).cast("int")  # over the TF names only
    files = cut_lineage(given.select("tf").distinct().select("tf", number.alias("file")))
    names = (given.select("gene").distinct().groupBy(block.alias("blk")).agg(F.collect_list("gene").alias("genes"))
                  .select(F.explode(F.sequence(F.lit(0), F.lit(n_files - 1))).alias("file"), F.lit("").alias("tf"), F.lit(0).alias("tag"), "genes", F.lit(None).cast("array<bigint>").alias("ranks")))
    packed = given.join(files, "tf").groupBy("file", "tf", block.alias("blk")).agg(F.collect_list(F.struct("gene", "rank")).alias("e"))
    packed = packed.select("file", "tf", F.lit(1).alias("tag"), F.col("e.gene").alias("genes"), F.col("e.rank").alias("ranks"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        now, genes, rows, at = None, [], {}, {}

        def flush() -> pa.RecordBatch:
            tfs = sorted(rows)
            stacked = np.stack([rows[t] for t in tfs])
            cols = {g: pa.array(stacked[:, at[g]], kind, mask=stacked[:, at[g]] == np.iinfo(np.int64).min) for g in sorted(at)}
            table = pa.table({key: pa.array(tfs), **cols} if version == 1 else {**cols, key: pa.array(tfs)})
            with fs.open_output_stream(f"{root}/part-{now:05d}.parquet") as out:  # the same name and content whichever attempt writes it
                pq.write_table(table, out)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(tfs)], pa.int64())], names=["file", "n"])

        fs.create_dir(root, recursive=True)
        for b in batches:
            for file, tf, tag, some, ranked in zip(*(b.column(c).to_pylist() for c in ("file", "tf", "tag", "genes", "ranks"))):
                if file != now:
                    if now is not None:
                        yield flush()
                    now, genes, rows, at = file, [], {}, {}
                if tag == 0:
                    genes += some
                    continue
                at = at or {g: i for i, g in enumerate(genes)}
                row = rows.setdefault(tf, np.full(len(genes), np.iinfo(np.int64).min))
                row[[at[g] for g in some]] = ranked
        if now is not None:
            yield flush()

    rows = names.unionByName(packed).repartition(min(n_files, 200), "file").sortWithinPartitions("file", "tag", "tf")
    rows.mapInArrow(write, "file int, n long").agg(F.sum("n")).collect()


def rank_table(ranks: DataFrame, version: int = 2) -> DataFrame:
    """The table of :func:`write_rank_table`, written to the shared folder and read back."""
    path = scratch_path(ranks.sparkSession, "ranks") + (RANK_SUFFIX if version == 2 else "")
    write_rank_table(ranks, path, version)
    return load(ranks.sparkSession, path)


def save(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Persist a table as Parquet."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_bucketed(matrix: DataFrame, table: str, buckets: int, key: str = "cell") -> None:
    """Persist a MATRIX as a table bucketed and sorted by cell, so that joins on cells need no shuffle."""
    matrix.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
