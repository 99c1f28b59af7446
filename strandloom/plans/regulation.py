"""TF-target candidate ranking from peaks and from promoter flanks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.genome import expand, start_site
from strandloom.functions.runtime import cut_lineage
from strandloom.operators.inference import cis_regulatory_ranking
from strandloom.operators.intervals import tf_binding


def tf_target_ranks(gene_bed: DataFrame, peak_bed: DataFrame, gene2peak: DataFrame, tfs: DataFrame, motif_bed: DataFrame,
                    flank: int = 500, n_samples: int = 1000, seed: int = 0, suffixes: tuple[str, str] = ("_peak", "_flank")) -> DataFrame:
    """(gene, tf, rank): TF names with the first suffix are ranked by gene -> peak -> motif paths
    against random peaks of similar length, those with the second by motif hits around the gene's
    start."""
    genes = gene_bed.select(F.col("name").alias("gene")).distinct()
    peaks = peak_bed.select(F.col("name").alias("region"), (F.col("chromEnd") - F.col("chromStart")).alias("length"))
    by_peak = cis_regulatory_ranking(gene2peak, cut_lineage(tf_binding(peak_bed, motif_bed, tfs)), genes, peaks, tfs, n_samples, seed)
    flanks = expand(start_site(gene_bed), flank, flank)
    loops = genes.select(F.col("gene").alias("source"), F.col("gene").alias("target"))
    by_flank = cis_regulatory_ranking(loops, cut_lineage(tf_binding(flanks, motif_bed, tfs)), genes, genes.select(F.col("gene").alias("region")), tfs, 0)
    return by_peak.withColumn("tf", F.concat("tf", F.lit(suffixes[0]))).unionByName(by_flank.withColumn("tf", F.concat("tf", F.lit(suffixes[1]))))
