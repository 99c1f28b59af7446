"""Range joins and merges on BED-like tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.genome import interval_dist
from strandloom.functions.joins import HOT_ROWS, salted_join
from strandloom.functions.ranks import is_small, with_value_bucket
from strandloom.functions.runtime import cut_lineage, scalar

BASE_BIN = 64
LEVEL_FACTOR = 4
MAX_LEVEL = 14


def _level(start: Column, end: Column) -> Column:
    """Smallest level whose bin is at least as long as the interval."""
    length = F.greatest(end - start, F.lit(1))
    level = F.ceil(F.log(length / BASE_BIN) / F.log(F.lit(float(LEVEL_FACTOR))))
    return F.least(F.greatest(level, F.lit(0)), F.lit(MAX_LEVEL)).cast("int")


def _binned(df: DataFrame, other_levels: Column) -> DataFrame:
    """One row per (level, bin) touched, at the interval's own level and at every coarser level
    that some interval of the other side owns: at most about two bins per level."""
    df = df.withColumn("_own", _level(F.col("_s"), F.col("_e"))).withColumn("_others", F.coalesce(other_levels, F.array()))
    levels = F.array_distinct(F.concat(F.array("_own"), F.filter("_others", lambda x: x > F.col("_own"))))
    df = df.withColumn("_level", F.explode(levels)).drop("_others")
    width = F.lit(BASE_BIN) * F.pow(F.lit(LEVEL_FACTOR), F.col("_level")).cast("long")
    first = F.floor(F.col("_s") / width)
    last = F.greatest(first, F.floor((F.col("_e") - 1) / width))
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_pairs(left: DataFrame, right: DataFrame, window: int = 0,
                  left_cols: Sequence[str] | None = None, right_cols: Sequence[str] | None = None,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """All (left, right) pairs on one chromosome with |distance| <= ``window``.

    The result has columns ``l_<col>`` and ``r_<col>``. Each interval is filed under the bins of
    its own length level; two intervals meet at the coarser of their levels and are reported
    only in the first bin they share, so no pair is lost or repeated and parallel rows survive.
    """
    left_cols, right_cols = list(left_cols or left.columns), list(right_cols or right.columns)
    keep_l = [F.col(c).alias(f"l_{c}") for c in left_cols]
    keep_r = [F.col(c).alias(f"r_{c}") for c in right_cols]
    l = left.select(F.col("chrom").alias("_chrom"), (F.col("chromStart") - window).alias("_s"),
                    (F.col("chromEnd") + window).alias("_e"), *keep_l)
    r = right.select(F.col("chrom").alias("_chrom"), F.col("chromStart").alias("_s"),
                     F.col("chromEnd").alias("_e"), *keep_r)
    l_levels = scalar(l, F.collect_set(_level(F.col("_s"), F.col("_e"))))
    r_levels = scalar(r, F.collect_set(_level(F.col("_s"), F.col("_e"))))
    lb = _binned(l, r_levels)
    rb = _binned(r, l_levels).withColumnsRenamed({"_s": "_rs", "_e": "_re", "_own": "_rown", "_first": "_rfirst"})
    joined = salted_join(lb, rb, ["_chrom", "_level", "_bin"], ["_s", "_e", *[f"l_{c}" for c in left_cols]], hot_rows)
    return joined.where(
        (F.col("_s") < F.col("_re")) & (F.col("_rs") < F.col("_e"))
        & (F.greatest("_own", "_rown") == F.col("_level"))
        & (F.greatest("_first", "_rfirst") == F.col("_bin"))
    ).select(*[f"l_{c}" for c in left_cols], *[f"r_{c}" for c in right_cols])


AttrFn = Callable[[Callable[[str], Column], Callable[[str], Column], Column], Mapping[str, Column]]


def window_graph(left: DataFrame, right: DataFrame, window: int, attrs: AttrFn | None = None,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges (source, target, dist, ...) between features at most ``window`` bases apart.

    ``attrs(l, r, d)`` maps column getters of both sides and the signed distance to extra
    edge attributes, all as Column expressions.
    """
    pairs = overlap_pairs(left, right, window, hot_rows=hot_rows)
    d = interval_dist(F.col("l_chromStart"), F.col("l_chromEnd"), F.col("r_chromStart"), F.col("r_chromEnd"))
    extra = attrs(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}"), F.col("dist")) if attrs else {}
    return pairs.withColumn("dist", d).select(
        F.col("l_name").alias("source"), F.col("r_name").alias("target"),
        *([] if "dist" in extra else ["dist"]), *[v.alias(k) for k, v in extra.items()])


def drop_overlapping(bed: DataFrame, blacklist: DataFrame, ids: Sequence[str] = ("chrom", "chromStart", "chromEnd")) -> DataFrame:
    """Features that share no base with any blacklisted interval."""
    hits = overlap_pairs(bed.select(*dict.fromkeys(["chrom", "chromStart", "chromEnd", *ids])),
                         merge_intervals(blacklist), 0, left_cols=list(ids), right_cols=["chrom"])
    bad = hits.select(*[F.col(f"l_{c}").alias(c) for c in ids]).distinct()
    return bed.join(bad, list(ids), "left_anti")


def merge_intervals(bed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Union of overlapping or touching intervals per chromosome (and per ``by`` columns).

    Distinct intervals are cut into start-ordered buckets; each bucket learns the furthest end
    of the earlier ones, so a single chromosome is swept by many tasks.
    """
    group = [*by, "chrom"]
    spans = cut_lineage(bed.groupBy(*group, "chromStart").agg(F.max("chromEnd").alias("chromEnd")))
    if is_small(spans):
        w = Window.partitionBy(*group).orderBy("chromStart")
        opens = F.when(F.col("chromStart") <= F.max("chromEnd").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
        runs = spans.withColumn("_new", opens).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return runs.groupBy(*group, "_run").agg(F.min("chromStart").alias("chromStart"), F.max("chromEnd").alias("chromEnd")).drop("_run")
    split = with_value_bucket(spans, spans, "chromStart")
    reach = split.groupBy(*group, "_bucket").agg(F.max("chromEnd").alias("_hi"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.select(*group, "_bucket", F.max("_hi").over(earlier).alias("_prior"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("chromStart")
    before = F.greatest(F.max("chromEnd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_prior"))
    flagged = split.join(reach, [*group, "_bucket"]).withColumn("_before", before).withColumn(
        "_new", F.when(F.col("_before").isNull() | (F.col("chromStart") > F.col("_before")), 1).otherwise(0))
    # number the runs: in-bucket running sum plus the runs opened by earlier buckets
    opened = flagged.groupBy(*group, "_bucket").agg(F.sum("_new").alias("_opened"))
    opened = opened.select(*group, "_bucket", F.coalesce(F.sum("_opened").over(earlier), F.lit(0)).alias("_off"))
    run = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_off")
    return (flagged.join(opened, [*group, "_bucket"]).withColumn("_run", run)
            .groupBy(*group, "_run").agg(F.min("chromStart").alias("chromStart"), F.max("chromEnd").alias("chromEnd"))
            .drop("_run"))


def count_fragments(fragments: DataFrame, regions: DataFrame) -> DataFrame:
    """MATRIX of fragments per (cell, region): fragments are (chrom, chromStart, chromEnd, cell)."""
    hits = overlap_pairs(fragments.select("chrom", "chromStart", "chromEnd", "cell"), regions, 0,
                         left_cols=["cell"], right_cols=["name"])
    return (hits.groupBy(F.col("l_cell").alias("cell"), F.col("r_name").alias("feature"))
                .agg(F.count(F.lit(1)).cast("double").alias("value")))


def remap_features(matrix: DataFrame, bed: DataFrame, merged: DataFrame) -> DataFrame:
    """MATRIX over merged regions: sum of the overlapping features of each."""
    links = overlap_pairs(bed, merged, 0, left_cols=["name"], right_cols=["name"]).select(
        F.col("l_name").alias("feature"), F.col("r_name").alias("merged"))
    joined = salted_join(matrix, links, ["feature"], ["cell"])
    return joined.groupBy("cell", F.col("merged").alias("feature")).agg(F.sum("value").alias("value"))


def tf_binding(regions: DataFrame, motif_bed: DataFrame, tfs: DataFrame) -> DataFrame:
    """EDGES region -> TF for each motif hit (of a listed TF) that overlaps the region."""
    hits = motif_bed.join(tfs.select(F.col("tf").alias("name")).distinct(), "name", "left_semi")
    return window_graph(regions, hits, 0).select("source", "target")


def region_slice(bed: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Features that lie inside the range; a plain filter, so it reaches the Parquet scan."""
    return bed.where((F.col("chrom") == chrom) & (F.col("chromStart") >= start) & (F.col("chromEnd") <= end))
