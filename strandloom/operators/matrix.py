"""Statistics and normalisation of long cell x feature matrices: MATRIX(cell, feature, value).

A row that is not stored is a zero. ``n`` is the number of cells; it counts cells without any
stored entry and comes from a CELLS table, or from the matrix if every cell has an entry.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.joins import pair_grid
from strandloom.functions.loess import loess
from strandloom.functions.ranks import exact_quantiles, positions, top_per_group, value_ranks
from strandloom.functions.runtime import cut_lineage, scalar


def n_cells(m: DataFrame, cells: DataFrame | None = None) -> Column:
    """Number of cells as a scalar subquery."""
    return scalar(cells, F.count(F.lit(1))) if cells is not None else scalar(m, F.count_distinct("cell"))


# ---------------------------------------------------------------- normalisation

def _scaled(m: DataFrame, target: Column) -> DataFrame:
    totals = m.groupBy("cell").agg(F.sum("value").alias("_total"))
    return m.join(totals, "cell").withColumn("_target", target).withColumn(
        "value", F.log1p(F.coalesce(F.try_divide(F.col("value") * F.col("_target"), F.col("_total")), F.lit(0.0)))).drop("_total", "_target")


def count_prep(m: DataFrame, target: float | None = None) -> DataFrame:
    """log1p of counts scaled to one total per cell, by default the median cell total."""
    if target is not None:
        return _scaled(m, F.lit(float(target)))
    totals = m.groupBy("cell").agg(F.sum("value").alias("t")).where("t > 0")
    return _scaled(m, exact_quantiles(totals, "t", [0.5]).select("q0").scalar())


def lognorm(m: DataFrame, total: float = 1e4) -> DataFrame:
    """log1p(value * total / cell sum)."""
    return _scaled(m, F.lit(float(total)))


def all_counts(m: DataFrame) -> DataFrame:
    """One row: are all values non-negative integers (within rounding)."""
    v = F.col("value")
    near = F.abs(v - F.rint(v)) <= 1e-8 + 1e-5 * F.abs(F.rint(v))
    return m.agg(F.coalesce(F.bool_and((v >= 0) & near), F.lit(True)).alias("all_counts"))


# ---------------------------------------------------------------- moments and correlation

def _sums(m: DataFrame, tag: str) -> DataFrame:
    v = F.col("value")
    return m.groupBy("feature").agg(F.sum(v).alias(f"_s{tag}"), F.sum(v * v).alias(f"_q{tag}"))


def col_var(m: DataFrame, m2: DataFrame | None = None, cells: DataFrame | None = None, bias: bool = False) -> DataFrame:
    """(feature, var): variance of each column, or covariance with the same column of ``m2``."""
    if m2 is None:
        sums = _sums(m, "x").select("feature", F.col("_sx").alias("_a"), F.col("_sx").alias("_b"), F.col("_qx").alias("_c"))
    else:
        stacked = m.select("cell", "feature", F.col("value").alias("x"), F.lit(0.0).alias("y")).unionByName(
            m2.select("cell", "feature", F.lit(0.0).alias("x"), F.col("value").alias("y")))
        both = stacked.groupBy("cell", "feature").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        sums = both.groupBy("feature").agg(F.sum("x").alias("_a"), F.sum("y").alias("_b"), F.sum(F.col("x") * F.col("y")).alias("_c"))
    n = n_cells(m, cells)
    out = sums.withColumn("_n", n)
    cov = F.col("_c") / F.col("_n") - F.col("_a") / F.col("_n") * (F.col("_b") / F.col("_n"))
    return out.select("feature", (cov if bias else cov * F.col("_n") / (F.col("_n") - 1)).alias("var"))


def col_pcc(m: DataFrame, m2: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(feature, corr): Pearson correlation of equally named columns. A constant column gives null."""
    stacked = m.select("cell", "feature", F.col("value").alias("x"), F.lit(0.0).alias("y")).unionByName(
        m2.select("cell", "feature", F.lit(0.0).alias("x"), F.col("value").alias("y")))
    both = stacked.groupBy("cell", "feature").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = both.groupBy("feature").agg(F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("xx"),
                                       F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy")).withColumn("n", n_cells(m, cells))
    vx, vy = F.expr("xx / n - (sx / n) * (sx / n)"), F.expr("yy / n - (sy / n) * (sy / n)")
    ok = (vx > 1e-12 * F.col("xx") / F.col("n")) & (vy > 1e-12 * F.col("yy") / F.col("n"))
    return sums.select("feature", F.when(ok, F.expr("xy / n - (sx / n) * (sy / n)") / F.sqrt(vx * vy)).alias("corr"))


def rank_parts(m: DataFrame, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Average-tie ranks per feature as a sparse MATRIX plus (feature, zero_rank).

    The z missing entries of a column form one tie block; its rank is subtracted from the stored
    ranks, so that a missing entry stands for ``zero_rank`` and the matrix stays as sparse.
    """
    stored = cut_lineage(m.where(F.col("value") != 0).select("cell", "feature", "value"))
    ranks = value_ranks(stored, ["feature"], "value")
    neg = stored.groupBy("feature").agg(F.count_if(F.col("value") < 0).alias("_neg"), F.count(F.lit(1)).alias("_nnz")).withColumn(
        "_zeros", n_cells(m, cells) - F.col("_nnz"))
    level = neg.select("feature", "_zeros", F.when(F.col("_zeros") > 0, F.col("_neg") + (F.col("_zeros") + 1) / 2).otherwise(0.0).alias("zero_rank"))
    full = ranks.join(level, "feature")
    rank = F.col("rank") + F.when(F.col("value") > 0, F.col("_zeros")).otherwise(0) - F.col("zero_rank")
    table = full.select("feature", "value", rank.cast("double").alias("_rank"))
    out = stored.join(table, ["feature", "value"]).select("cell", "feature", F.col("_rank").alias("value"))
    return out, level.select("feature", "zero_rank")


def rank_matrix(m: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Ranks shifted by each column's zero rank: correlations are the same as of full ranks."""
    return rank_parts(m, cells)[0]


def col_spr(m: DataFrame, m2: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(feature, corr): Spearman correlation of equally named columns over all cells."""
    n = cells if cells is not None else m.select("cell").distinct()
    return col_pcc(rank_matrix(m, n), rank_matrix(m2, n), n)


BLOCK = 512


def _gram_kernel(block: int, p1: int, p2: int):
    """Adds up X_i' X_j for one pair of feature blocks while the cells stream by."""

    def add(g: np.ndarray, rows: pd.DataFrame) -> None:
        codes, uniques = pd.factorize(rows["cell"], sort=False)
        for lo in range(0, len(uniques), 2048):
            part = (codes >= lo) & (codes < lo + 2048)
            c, slot, v, side = codes[part] - lo, rows["slot"].to_numpy()[part], rows["value"].to_numpy()[part], rows["side"].to_numpy()[part]
            n = min(2048, len(uniques) - lo)
            left, right = np.zeros((n, block)), np.zeros((n, block))
            l, r = side != 1, side != 0
            np.add.at(left, (c[l], slot[l]), v[l])
            np.add.at(right, (c[r], slot[r]), v[r])
            g += left.T @ right

    def emit(key: tuple, g: np.ndarray) -> pd.DataFrame:
        n1, n2 = min(block, p1 - key[0] * block), min(block, p2 - key[1] * block)
        i, j = np.divmod(np.arange(n1 * n2), n2)
        return pd.DataFrame({"i": key[0] * block + i, "j": key[1] * block + j, "s": g[i, j]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, g, held = None, None, []
        for pdf in batches:
            keys = pdf[["bi", "bj", "split"]].to_numpy()
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for part in np.split(np.arange(len(pdf)), change):
                if len(part) == 0:
                    continue
                rows, k = pdf.iloc[part], tuple(int(x) for x in keys[part[0]])
                if k != key:
                    if key is not None:
                        if held:
                            add(g, pd.concat(held))
                        yield emit(key, g)
                    key, g, held = k, np.zeros((block, block)), []
                held.append(rows)
                merged = pd.concat(held) if len(held) > 1 else rows
                last = merged["cell"].iloc[-1]
                done = (merged["cell"] != last).to_numpy()
                if done.any():
                    add(g, merged[done])
                held = [merged[~done]]
        if key is not None:
            if held:
                add(g, pd.concat(held))
            yield emit(key, g)

    return run


def gram(m: DataFrame, m2: DataFrame | None = None, block: int = BLOCK, splits: int | None = None) -> DataFrame:
    """(f1, f2, s): sums over cells of x[f1] * y[f2] for all feature pairs.

    Features are cut into blocks; one task streams the cells of one block pair and keeps a
    block x block sum, so no pair of entries is ever materialised. With ``m2`` absent only
    pairs of blocks with i <= j are computed and the result is mirrored.
    """
    spark = m.sparkSession
    m = cut_lineage(m.select("cell", "feature", "value"))
    pos1 = positions(m.select("feature").distinct(), [], ["feature"])
    p1 = pos1.count()
    nb1 = max(1, -(-p1 // block))
    pos2 = pos1 if m2 is None else positions(m2.select("feature").distinct(), [], ["feature"])
    p2 = p1 if m2 is None else pos2.count()
    nb2 = max(1, -(-p2 // block))
    ways = splits or max(1, spark.sparkContext.defaultParallelism // (nb1 * nb2))

    def entries(x: DataFrame, pos: DataFrame) -> DataFrame:
        return x.join(pos.select("feature", (F.col("pos") % block).cast("int").alias("slot"),
                                 F.floor(F.col("pos") / block).cast("int").alias("b")), "feature").select("cell", "slot", "b", "value")

    e1 = entries(m, pos1)
    if m2 is None:
        # side 2 serves as left and right of the diagonal block
        diag = e1.select("cell", "slot", "value", F.col("b").alias("bi"), F.col("b").alias("bj"), F.lit(2).alias("side"))
        parts = [diag]
        if nb1 > 1:
            parts.append(e1.where(F.col("b") < nb1 - 1).select("cell", "slot", "value", F.col("b").alias("bi"),
                                                               F.explode(F.sequence(F.col("b") + 1, F.lit(nb1 - 1))).alias("bj"), F.lit(0).alias("side")))
            parts.append(e1.where(F.col("b") > 0).select("cell", "slot", "value", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("bi"),
                                                         F.col("b").alias("bj"), F.lit(1).alias("side")))
    else:
        e2 = entries(m2, pos2)
        parts = [e1.select("cell", "slot", "value", F.col("b").alias("bi"), F.explode(F.sequence(F.lit(0), F.lit(nb2 - 1))).alias("bj"), F.lit(0).alias("side")),
                 e2.select("cell", "slot", "value", F.explode(F.sequence(F.lit(0), F.lit(nb1 - 1))).alias("bi"), F.col("b").alias("bj"), F.lit(1).alias("side"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    keyed = rows.withColumn("split", F.pmod(F.xxhash64("cell"), F.lit(ways)).cast("int"))
    streamed = keyed.repartition("bi", "bj", "split").sortWithinPartitions("bi", "bj", "split", "cell")
    sums = streamed.mapInPandas(_gram_kernel(block, p1, p2), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    if m2 is None and nb1 > 1:
        off = sums.where(F.floor(F.col("i") / block) != F.floor(F.col("j") / block))
        sums = sums.unionByName(off.select(F.col("j").alias("i"), F.col("i").alias("j"), "s"))
    n1 = pos1.select(F.col("pos").alias("i"), F.col("feature").alias("f1"))
    n2 = pos2.select(F.col("pos").alias("j"), F.col("feature").alias("f2"))
    return sums.join(n1, "i").join(n2, "j").select("f1", "f2", "s")


def _pair_table(m: DataFrame, m2: DataFrame | None) -> DataFrame:
    """(f1, f2) table with sums, squares and cross sums of every feature pair."""
    s1 = _sums(m, "x").select(F.col("feature").alias("f1"), F.col("_sx").alias("sx"), F.col("_qx").alias("xx"))
    other = m if m2 is None else m2
    s2 = _sums(other, "y").select(F.col("feature").alias("f2"), F.col("_sy").alias("sy"), F.col("_qy").alias("yy"))
    return gram(m, m2).join(s1, "f1").join(s2, "f2")


def cov_mat(m: DataFrame, m2: DataFrame | None = None, cells: DataFrame | None = None, bias: bool = False) -> DataFrame:
    """(f1, f2, cov) of all feature pairs."""
    t = _pair_table(m, m2).withColumn("n", n_cells(m, cells))
    cov = F.expr("s / n - (sx / n) * (sy / n)")
    return t.select("f1", "f2", (cov if bias else cov * F.col("n") / (F.col("n") - 1)).alias("cov"))


def pcc_mat(m: DataFrame, m2: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """(f1, f2, corr) of all feature pairs; diagonal exactly 1, never above 1."""
    t = _pair_table(m, m2).withColumn("n", n_cells(m, cells))
    vx, vy = F.expr("xx / n - (sx / n) * (sx / n)"), F.expr("yy / n - (sy / n) * (sy / n)")
    corr = F.expr("s / n - (sx / n) * (sy / n)") / F.sqrt(vx * vy)
    corr = F.when((vx > 0) & (vy > 0), F.least(corr, F.lit(1.0)))
    if m2 is None:
        corr = F.when(F.col("f1") == F.col("f2"), F.lit(1.0)).otherwise(corr)
    return t.select("f1", "f2", corr.alias("corr"))


def spr_mat(m: DataFrame, m2: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Spearman version of :func:`pcc_mat`."""
    n = cells if cells is not None else m.select("cell").distinct()
    return pcc_mat(rank_matrix(m, n), None if m2 is None else rank_matrix(m2, n), n)


# ---------------------------------------------------------------- TF-IDF

def tfidf_seurat(m: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(value / cell sum) * (number of cells / feature sum); NaN where a sum of stored entries is 0."""
    rows = m.groupBy("cell").agg(F.sum("value").alias("_r"))
    cols = m.groupBy("feature").agg(F.sum("value").alias("_c"))
    out = m.join(cols, "feature").join(rows, "cell").withColumn("_n", n_cells(m, cells))
    tf, idf = F.try_divide(F.col("value"), F.col("_r")), F.try_divide(F.col("_n"), F.col("_c"))
    return out.select("cell", "feature", F.coalesce(tf * idf, F.lit(float("nan"))).alias("value"))


def fit_idf(m: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(feature, idf) = ln(1 + n / (feature sum + 1e-5))."""
    cols = m.groupBy("feature").agg(F.sum("value").alias("_c")).withColumn("_n", n_cells(m, cells))
    return cols.select("feature", F.log(1 + F.col("_n") / (F.col("_c") + 1e-5)).alias("idf"))


def tfidf_allcools(m: DataFrame, scale_factor: float = 1e5, idf: DataFrame | None = None,
                   cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """log1p(scale * value / (cell sum + 1e-5)) * idf, and the idf used."""
    idf = fit_idf(m, cells) if idf is None else idf
    rows = m.groupBy("cell").agg(F.sum("value").alias("_r"))
    tf = F.log1p(F.col("value") / (F.col("_r") + 1e-5) * scale_factor)
    out = m.join(idf, "feature").join(rows, "cell").select("cell", "feature", (tf * F.col("idf")).alias("value"))
    return out, idf


def tfidf(m: DataFrame, flavor: str = "seurat", **kwargs) -> DataFrame:
    if flavor == "seurat":
        return tfidf_seurat(m, **kwargs)
    if flavor == "allcools":
        return tfidf_allcools(m, **kwargs)[0]
    raise ValueError(f"unknown TF-IDF flavor: {flavor}")


# ---------------------------------------------------------------- methylation layers

def hypo_score(m: DataFrame) -> DataFrame:
    """value = 1 - clip(mc / cov, 0, 1) on covered entries."""
    ratio = F.col("mc") / F.col("cov")
    return m.where(F.col("cov") != 0).withColumn("value", 1 - F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))


def overshoot_count(m: DataFrame) -> DataFrame:
    """One row: covered entries whose mc exceeds cov by more than rounding."""
    return m.agg(F.count_if((F.col("cov") != 0) & (F.col("mc") / F.col("cov") > 1.001)).alias("overshoot"))


def merge_mc_cov(m: DataFrame) -> DataFrame:
    """Both layers as one STRUCT value."""
    return m.select("cell", "feature", F.struct("mc", "cov").alias("value"))


def methylation_rates(m: DataFrame) -> DataFrame:
    """rate = mc / cov (0 if uncovered), the cell's global rate, and rate / global rate."""
    totals = m.groupBy("cell").agg(F.try_divide(F.sum("mc"), F.sum("cov")).alias("global_rate"))
    rate = F.when(F.col("cov") == 0, F.lit(0.0)).otherwise(F.coalesce(F.col("mc") / F.col("cov"), F.lit(0.0)))
    out = m.join(totals, "cell").withColumn("rate", rate)
    norm = F.when(F.col("global_rate") == 0, F.lit(0.0)).otherwise(F.coalesce(F.col("rate") / F.col("global_rate"), F.lit(0.0)))
    return out.withColumn("norm_rate", norm).select("cell", "feature", "rate", "global_rate", "norm_rate")


# ---------------------------------------------------------------- scaling and selection

def feature_moments(m: DataFrame, cells: DataFrame | None = None, ddof: int = 1) -> DataFrame:
    """(feature, mean, std) over all cells, zeros included."""
    t = _sums(m, "x").withColumn("_n", n_cells(m, cells))
    mean = F.col("_sx") / F.col("_n")
    var = F.greatest(F.col("_qx") / F.col("_n") - mean * mean, F.lit(0.0)) * F.col("_n") / (F.col("_n") - ddof)
    return t.select("feature", mean.alias("mean"), F.sqrt(var).alias("std"))


def scale_sparse(m: DataFrame, cells: DataFrame, max_value: float | None = 10, mask: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Standardised matrix as (MATRIX of differences from the zero level, zero level per feature).

    z(x) = clip((x - mean) / std); a stored entry holds z(x) - z(0), a missing one stands for
    z(0), so the dense matrix need not be written out. ``mask`` picks the cells the moments use.
    """
    base, used = (m, cells) if mask is None else (m.join(mask.select("cell"), "cell", "left_semi"), mask)
    stats = feature_moments(base, used).withColumn("_std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))

    def z(x: Column) -> Column:
        v = (x - F.col("mean")) / F.col("_std")
        return v if max_value is None else F.least(F.greatest(v, F.lit(-float(max_value))), F.lit(float(max_value)))

    level = stats.select("feature", z(F.lit(0.0)).alias("zero"))
    out = m.join(stats, "feature").select("cell", "feature", (z(F.col("value")) - z(F.lit(0.0))).alias("value"))
    return out, level


def scale(m: DataFrame, cells: DataFrame, max_value: float | None = 10, mask: DataFrame | None = None) -> DataFrame:
    """Dense standardised MATRIX: one row per (cell, feature). Select features first."""
    diff, level = scale_sparse(m, cells, max_value, mask)
    grid = pair_grid(cells.select("cell"), level)
    return grid.join(diff, ["cell", "feature"], "left").select(
        "cell", "feature", (F.col("zero") + F.coalesce("value", F.lit(0.0))).alias("value"))


def filter_features(m: DataFrame, min_counts: float = 1) -> DataFrame:
    keep = m.groupBy("feature").agg(F.sum("value").alias("_t")).where(F.col("_t") >= min_counts)
    return m.join(keep, "feature", "left_semi")


def filter_by_group_detection(m: DataFrame, cells: DataFrame, by: str, min_frac: float) -> DataFrame:
    """Features with a positive sum in every group (min_frac = 1) or in more than that share."""
    groups = scalar(cells.where(F.col(by).isNotNull()), F.count_distinct(by))
    sums = m.join(cells.select("cell", by), "cell").groupBy("feature", by).agg(F.sum("value").alias("_t")).where("_t > 0")
    hits = sums.groupBy("feature").agg(F.count(F.lit(1)).alias("_h")).withColumn("_g", groups)
    ok = F.col("_h") == F.col("_g") if min_frac >= 1 else F.col("_h") / F.col("_g") > min_frac
    return m.join(hits.where(ok), "feature", "left_semi")


def standardized_variance(m: DataFrame, cells: DataFrame, by: str | None = None, span: float = 0.3) -> DataFrame:
    """(group, feature, mean, var, score): variance after stabilisation along the mean-variance
    trend, a local quadratic regression of log10(var) on log10(mean) per group.

    The variance is summed around the mean of the stored entries; the missing ones add their share of the shift.
    """
    group = F.col(by).cast("string") if by else F.lit("all")
    labelled = cells.select("cell", group.alias("group"))
    sizes = labelled.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    e = cut_lineage(m.join(labelled, "cell").select("cell", "group", "feature", F.col("value").cast("double").alias("value")))
    st = e.groupBy("group", "feature").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("k"), F.var_samp("value").alias("v"), F.avg("value").alias("a")).join(sizes, "group")
    st = st.withColumn("mean", F.col("s") / F.col("n")).withColumn(
        "var", F.try_divide(F.coalesce("v", F.lit(0.0)) * (F.col("k") - 1) + F.col("k") * F.expr("(a - mean) * (a - mean)") + (F.col("n") - F.col("k")) * F.expr("mean * mean"), F.col("n") - 1))
    ok = cut_lineage(st.where((F.col("mean") > 0) & (F.col("var") > 1e-12)).select("group", "feature", "n", "mean", "var", F.log10("mean").alias("x"), F.log10("var").alias("y")))
    fit = loess(ok, "group", "x", "y", span, "trend").withColumn("sd", F.sqrt(F.pow(F.lit(10.0), "trend")))
    fit = cut_lineage(fit.select("group", "feature", "mean", "var", "n", "sd", (F.col("sd") * F.sqrt("n") + F.col("mean")).alias("clip")))
    clipped = e.join(fit.select("group", "feature", "clip", "mean"), ["group", "feature"]).withColumn("c", F.least("value", "clip") - F.col("mean"))
    sums = clipped.groupBy("group", "feature").agg(F.sum(F.col("c") * F.col("c")).alias("cq"), F.count(F.lit(1)).alias("k"))
    score = F.expr("(cq + (n - k) * mean * mean) / ((n - 1) * sd * sd)")
    return fit.join(sums, ["group", "feature"]).select("group", "feature", "mean", "var", score.alias("score"))


def highly_variable(m: DataFrame, cells: DataFrame, n_top: int, batch_key: str | None = None) -> DataFrame:
    """(feature, n_batches, median_rank, rank) of the ``n_top`` most variable features.

    Features are ranked per batch; the result is ordered by the number of batches that picked
    the feature, then by its median rank among those, then by name.
    """
    sv = standardized_variance(m, cells, batch_key)
    picked = top_per_group(sv, ["group"], [F.round("score", 9).desc(), F.col("feature")], n_top, out="r")
    merged = picked.groupBy("feature").agg(F.count(F.lit(1)).alias("n_batches"), F.percentile(F.col("r") - 1, F.lit(0.5)).alias("median_rank"))
    return top_per_group(merged.withColumn("_all", F.lit(0)), ["_all"], [F.col("n_batches").desc(), F.col("median_rank"), F.col("feature")],
                         n_top, out="rank").drop("_all")


def align_features(m: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MATRIX restricted to the reference features, and FEATURES with a ``present`` flag.

    Padding is implicit: a reference feature without entries is a column of zeros.
    """
    kept = m.join(features.select("feature"), "feature", "left_semi")
    seen = m.select("feature").distinct().withColumn("present", F.lit(True))
    return kept, features.join(seen, "feature", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def concat_cells(*ms: DataFrame) -> DataFrame:
    out = ms[0]
    for m in ms[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out


def concat_features(*ms: DataFrame) -> DataFrame:
    """Side-by-side matrices over their common cells; shared feature names are an error."""
    common = ms[0].select("cell").distinct()
    for m in ms[1:]:
        common = common.join(m.select("cell"), "cell", "left_semi")
    names = [m.select("feature").distinct() for m in ms]
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if not a.join(b, "feature", "left_semi").isEmpty():
                raise ValueError("overlapping features are not supported")
    return concat_cells(*ms).join(common, "cell", "left_semi")


def feature_stats(m: DataFrame, cells: DataFrame, min_mean: float | None = None, min_std: float | None = None) -> DataFrame:
    """(feature, mean, std) with optional lower thresholds (population deviation)."""
    t = feature_moments(m, cells, ddof=0)
    if min_mean is not None:
        t = t.where(F.col("mean") > min_mean)
    return t if min_std is None else t.where(F.col("std") > min_std)


def common_features(*ms: DataFrame) -> DataFrame:
    out = ms[0].select("feature").distinct()
    for m in ms[1:]:
        out = out.join(m.select("feature"), "feature", "left_semi")
    return out


def split_by_suffix(m: DataFrame, suffixes: Sequence[str]) -> dict[str, DataFrame]:
    """One MATRIX per suffix, with the suffix cut off the feature names."""
    return {s: m.where(F.col("feature").endswith(s)).withColumn("feature", F.expr(f"left(feature, length(feature) - {len(s)})"))
            for s in suffixes}
