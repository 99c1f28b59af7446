"""Statistics of feature pairs along a skeleton graph."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.joins import salted_join
from strandloom.functions.ranks import positions, value_ranks
from strandloom.functions.runtime import cut_lineage, scalar
from strandloom.operators import matrix as mt
from strandloom.operators.aggregate import Dataset, metacells
from strandloom.operators.regression import BLOCK, blocked, closed_fit, sparse_fit


def _stack(ms: Sequence[DataFrame]) -> DataFrame:
    """Matrices side by side; a feature in more than one of them is an error."""
    names = ms[0].select("feature").distinct()
    for m in ms[1:]:
        names = names.unionByName(m.select("feature").distinct())
    if len(ms) > 1 and not names.groupBy("feature").count().where("count > 1").isEmpty():
        raise ValueError("overlapping features are not supported")
    out = ms[0].select("cell", "feature", "value")
    for m in ms[1:]:
        out = out.unionByName(m.select("cell", "feature", "value"))
    return out


def skeleton_corr(ms: Sequence[DataFrame], skeleton: DataFrame, cells: DataFrame, method: str = "spr",
                  prep_fns: Sequence[Callable[[DataFrame], DataFrame] | None] | None = None) -> DataFrame:
    """Skeleton EDGES with ``corr``: Pearson or Spearman over ``cells``, missing entries are zeros,
    stored NaN are left out. Biased deviations; a constant feature, or one that is NaN throughout, gives null.

    Only features on the skeleton are read. The zero level of every feature is split off, so each
    edge joins stored entries only.
    """
    if method not in ("spr", "pcc"):
        raise ValueError(f"unknown method: {method}")
    prep = list(prep_fns) if prep_fns is not None else [None] * len(ms)
    if len(prep) != len(ms):
        raise ValueError("as many prep_fns as datasets are needed")
    x = _stack([fn(m) if fn else m for m, fn in zip(ms, prep, strict=True)])
    pairs = skeleton.select("source", "target").distinct()
    used = pairs.select(F.explode(F.array("source", "target")).alias("feature")).distinct()
    x = cut_lineage(x.join(used, "feature", "left_semi").join(cells.select("cell"), "cell", "left_semi"))
    nan = F.isnan("value") | F.col("value").isNull()
    bad = x.where(nan).withColumn("value", F.lit(None).cast("double"))
    good = x.where(~nan)
    n = scalar(cells, F.count(F.lit(1)))
    miss = bad.groupBy("feature").agg(F.count(F.lit(1)).alias("nans"))
    valid = used.join(miss, "feature", "left").fillna(0, ["nans"]).withColumn("n", n).withColumn("n", F.col("n") - F.col("nans"))
    if method == "spr":
        stored = good.where("value <> 0")
        ranks = value_ranks(stored, ["feature"], "value")
        shape = stored.groupBy("feature").agg(F.count(F.lit(1)).alias("nnz"), F.count_if(F.col("value") < 0).alias("neg"))
        valid = valid.join(shape, "feature", "left").fillna(0, ["nnz", "neg"]).withColumn("zeros", F.col("n") - F.col("nnz")).withColumn(
            "base", F.when(F.col("zeros") > 0, F.col("neg") + (F.col("zeros") + 1) / 2).otherwise(0.0))
        table = ranks.join(valid, "feature").select("feature", "value", (F.col("rank") + F.when(F.col("value") > 0, F.col("zeros")).otherwise(0) - F.col("base")).alias("_r"))
        good = stored.join(table, ["feature", "value"]).select("cell", "feature", F.col("_r").alias("value"))
    else:
        valid = valid.withColumn("base", F.lit(0.0))
    sums = good.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    moments = cut_lineage(valid.join(sums, "feature", "left").fillna(0.0, ["s", "q"]).select("feature", "n", "nans", "base", "s", "q"))
    entries = good.select("cell", "feature", "value").unionByName(bad.select("cell", "feature", "value"))
    left = salted_join(entries.withColumnRenamed("feature", "source"), pairs, ["source"], ["cell"]).select("source", "target", "cell", F.col("value").alias("x"))
    both = left.join(entries.select(F.col("feature").alias("target"), "cell", F.col("value").alias("y")), ["target", "cell"])
    cross = both.groupBy("source", "target").agg(
        F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.when(F.col("y").isNull(), F.col("x"))).alias("xn"),
        F.sum(F.when(F.col("x").isNull(), F.col("y"))).alias("yn"), F.count_if(F.col("x").isNull() & F.col("y").isNull()).alias("nn"))
    s = moments.select(*[F.col(c).alias("source" if c == "feature" else f"{c}_s") for c in moments.columns])
    t = moments.select(*[F.col(c).alias("target" if c == "feature" else f"{c}_t") for c in moments.columns])
    e = pairs.join(cross, ["source", "target"], "left").fillna(0.0, ["xy", "xn", "yn", "nn"]).join(s, "source").join(t, "target")
    # joint count and sums of the shifted values over cells valid on both sides
    e = e.withColumn("total", n).withColumns({
        "nj": F.col("total") - F.col("nans_s") - F.col("nans_t") + F.col("nn"), "sx": F.col("s_s") - F.col("xn"), "sy": F.col("s_t") - F.col("yn")})
    joint = F.expr("(xy + base_s * sy + base_t * sx) / nullif(nj, 0) + base_s * base_t")
    mean_s, mean_t = F.expr("s_s / nullif(n_s, 0) + base_s"), F.expr("s_t / nullif(n_t, 0) + base_t")
    var_s, var_t = F.expr("q_s / nullif(n_s, 0) - (s_s / nullif(n_s, 0)) * (s_s / nullif(n_s, 0))"), F.expr("q_t / nullif(n_t, 0) - (s_t / nullif(n_t, 0)) * (s_t / nullif(n_t, 0))")
    varies = (var_s > 1e-12 * F.greatest(F.expr("q_s / nullif(n_s, 0)"), F.lit(1e-300))) & (var_t > 1e-12 * F.greatest(F.expr("q_t / nullif(n_t, 0)"), F.lit(1e-300)))
    corr = F.when(varies, (joint - mean_s * mean_t) / F.sqrt(var_s * var_t))
    return skeleton.join(e.select("source", "target", corr.alias("corr")), ["source", "target"], "left")


def metacell_corr(*datasets: Dataset, skeleton: DataFrame, use_rep: str, n_meta: int, method: str = "spr", agg_fns: Sequence[str] | None = None,
                  nan_sparse: Sequence[bool] | None = None, prep_fns: Sequence[Callable[[DataFrame], DataFrame] | None] | None = None, seed: int = 0) -> DataFrame:
    """Metacells common to all datasets, then :func:`skeleton_corr`."""
    kws: list[dict[str, Any]] = [{} for _ in datasets]
    for k, fn in zip(kws, agg_fns or []):
        k["X_agg"] = fn
    for k, flag in zip(kws, nan_sparse or []):
        k["nan_sparse"] = flag
    meta = metacells(*datasets, use_rep=use_rep, n_meta=n_meta, common=True, seed=seed, agg_kws=kws)
    return skeleton_corr([m for m, _ in meta], skeleton, meta[0][1].select("cell"), method, prep_fns)


def skeleton_regr(ms: Sequence[DataFrame], skeleton: DataFrame, cells: DataFrame, model: str = "Lasso", alpha: float = 1.0, l1_ratio: float = 0.5,
                  max_iter: int = 10_000, tol: float = 1e-9, block: int = BLOCK) -> DataFrame:
    """(source, target, regr): coefficients of each target's regression on its predecessors, on
    count-normalised values. Objectives: RSS / (2n) + alpha * L1 (Lasso), the elastic-net mix of
    both penalties, RSS + alpha * L2 (Ridge), RSS (LinearRegression, smallest norm).

    No target's data have to fit one task (``regression``). Where a solver does not converge, an error is raised.
    """
    if model not in ("Lasso", "ElasticNet", "Ridge", "LinearRegression"):
        raise ValueError(f"unknown model: {model}")
    x = _stack([mt.count_prep(m) for m in ms])
    pairs = skeleton.select("source", "target").distinct()
    n = cells.count()
    index = positions(cells.select("cell"), [], ["cell"]).select("cell", F.col("pos").alias("i"))
    entries = x.join(index, "cell").groupBy("feature").agg(F.collect_list(F.struct("i", "value")).alias("e"))  # one entry per metacell
    packed = cut_lineage(entries.select("feature", F.col("e.i").alias("ei"), F.col("e.value").alias("ev")))
    rows = cut_lineage(blocked(pairs, block).join(packed.withColumnRenamed("feature", "source"), "source", "left"))
    goals = cut_lineage(pairs.select("target").distinct().join(packed.select(F.col("feature").alias("target"), F.col("ei").alias("yi"), F.col("ev").alias("yv")), "target", "left"))
    if model in ("Lasso", "ElasticNet"):
        share = 1.0 if model == "Lasso" else l1_ratio
        return sparse_fit(rows, goals, n, alpha * share, alpha * (1 - share), max_iter, tol, block)
    return closed_fit(rows, goals, n, alpha if model == "Ridge" else 0.0, block)


def metacell_regr(*datasets: Dataset, use_rep: str, n_meta: int, skeleton: DataFrame, model: str = "Lasso", seed: int = 0, **kwargs: Any) -> DataFrame:
    """Metacell sums of raw counts, then :func:`skeleton_regr`."""
    for m, _ in datasets:
        if not mt.all_counts(m).first()["all_counts"]:
            raise ValueError("values must be raw counts")
    meta = metacells(*datasets, use_rep=use_rep, n_meta=n_meta, common=True, seed=seed)
    return skeleton_regr([m for m, _ in meta], skeleton, meta[0][1].select("cell"), model, **kwargs)


def feature_spearman(a: DataFrame, b: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(feature, corr): Spearman correlation of equally named features of two matrices."""
    return mt.col_spr(a, b, cells)


def _r2(moments: pd.DataFrame, k: int) -> np.ndarray:
    """R squared per row from sums, squares and cross products of y and k predictors."""
    n = moments["n"].to_numpy(dtype=float)
    names = ["y", *[f"x{i}" for i in range(k)]]
    mean = np.stack([moments[f"s_{a}"].to_numpy(dtype=float) / n for a in names], axis=1)
    c = np.empty((len(n), k + 1, k + 1))
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], start=i):
            c[:, i, j] = c[:, j, i] = moments[f"p_{a}_{b}"].to_numpy(dtype=float) / n - mean[:, i] * mean[:, j]
    out = np.full(len(n), np.nan)
    for r in range(len(n)):
        if c[r, 0, 0] > 0:
            w = np.linalg.pinv(c[r, 1:, 1:]) @ c[r, 1:, 0]
            out[r] = w @ c[r, 1:, 0] / c[r, 0, 0]
    return out


def feature_r2(y: DataFrame, xs: Mapping[str, DataFrame], cells: DataFrame, groups: str | None = None, size: int | None = None,
               repeats: int = 10, seed: int = 0) -> DataFrame:
    """(feature, [group,] r2): variance of y explained by one or several layers, per feature.

    Only sums and cross products are shuffled; the small systems are solved from them. With
    ``groups`` each group is subsampled to ``size`` cells (default: the smallest group)
    ``repeats`` times and the results are averaged.
    """
    layers = list(xs)
    names = ["y", *[f"x{i}" for i in range(len(layers))]]
    wide = None
    for a, m in zip(names, [y, *xs.values()], strict=True):
        part = m.select("cell", "feature", *[(F.col("value") if b == a else F.lit(0.0)).alias(b) for b in names])
        wide = part if wide is None else wide.unionByName(part)
    wide = wide.groupBy("cell", "feature").agg(*[F.sum(a).alias(a) for a in names])
    if groups is None:
        member = cells.select("cell", F.lit("all").alias("group"), F.lit(0).alias("rep"))
    else:
        low = size or cells.groupBy(groups).count().agg(F.min("count")).first()[0]
        member = None
        for r in range(repeats):
            part = positions(cells.select("cell", F.col(groups).cast("string").alias("group")), ["group"], ["cell"], seed + r).where(
                F.col("pos") < low).select("cell", "group", F.lit(r).alias("rep"))
            member = part if member is None else member.unionByName(part)
    n = member.groupBy("group", "rep").agg(F.count(F.lit(1)).alias("n"))
    sums = wide.join(member, "cell").groupBy("group", "rep", "feature").agg(
        *[F.sum(a).alias(f"s_{a}") for a in names],
        *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]).join(n, ["group", "rep"])

    k = len(layers)

    def solve(batches):
        for pdf in batches:
            yield pd.DataFrame({"feature": pdf["feature"], "group": pdf["group"], "r2": _r2(pdf, k)})

    out = sums.mapInPandas(solve, "feature string, group string, r2 double")
    if groups is None:
        return out.select("feature", "r2")
    return out.groupBy("feature", "group").agg(F.avg("r2").alias("r2"))


def integration_consistency(datasets: Sequence[Dataset], graph: DataFrame, use_rep: str, n_metas: Sequence[int] = (10, 20, 50, 100, 200),
                            agg_fns: Sequence[str] | None = None, prep_fns: Sequence[Callable[[DataFrame], DataFrame] | None] | None = None,
                            method: str = "spr", seed: int = 0) -> DataFrame:
    """(n_meta, consistency): weighted agreement of edge signs with metacell correlations."""
    smallest = min(c.count() for _, c in datasets)
    counts = [bool(mt.all_counts(m).first()["all_counts"]) for m, _ in datasets] if agg_fns is None or prep_fns is None else []
    agg = list(agg_fns) if agg_fns is not None else ["sum" if c else "mean" for c in counts]
    prep = list(prep_fns) if prep_fns is not None else [mt.count_prep if c else None for c in counts]
    edges = graph.where(F.col("source") != F.col("target")).select("source", "target", "weight", "sign")
    out = None
    for n in n_metas:
        if n > smallest:
            continue
        corr = metacell_corr(*datasets, skeleton=edges, use_rep=use_rep, n_meta=n, method=method, agg_fns=agg, prep_fns=prep, seed=seed)
        row = corr.where(F.col("corr").isNotNull()).agg((F.sum(F.col("sign") * F.col("weight") * F.col("corr")) / F.sum("weight")).alias("consistency"))
        row = row.select(F.lit(n).alias("n_meta"), "consistency")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("too few cells for any number of metacells")
    return out
