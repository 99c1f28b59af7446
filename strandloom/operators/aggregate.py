"""Group aggregation of matrices with their metadata, and metacells."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.joins import pair_grid
from strandloom.functions.runtime import cut_lineage
from strandloom.functions.vectors import dimension
from strandloom.operators.embed import kmeans


def majority(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): most frequent value; the smallest among equally frequent ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(group).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))["v"].alias(value))


def _check(kind: str | None, allowed: tuple[str, ...]) -> None:
    if kind is not None and kind not in allowed:
        raise ValueError(f"unknown aggregation: {kind}")


def aggregate_obs(m: DataFrame | None, cells: DataFrame, by: str, X_agg: str | None = "sum", obs_agg: Mapping[str, str] | None = None,
                  obsm_agg: Mapping[str, str] | None = None, layers_agg: Mapping[str, str] | None = None, separator: str = ",",
                  nan_sparse: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """Cells merged by a category: (MATRIX over groups, CELLS of groups).

    The category may list several groups separated by ``separator``; a null belongs to none.
    Means divide by the group size (missing entries are zeros), or with ``nan_sparse`` by the
    number of stored entries. Fields without a rule are dropped.
    """
    obs_agg, obsm_agg, layers_agg = dict(obs_agg or {}), dict(obsm_agg or {}), dict(layers_agg or {})
    for kind in (X_agg, *layers_agg.values(), *obsm_agg.values()):
        _check(kind, ("sum", "mean"))
    for kind in obs_agg.values():
        _check(kind, ("sum", "mean", "majority"))
    member = cells.select("cell", F.explode(F.array_distinct(F.split(F.col(by).cast("string"), re.escape(separator)))).alias("_g"),
                          *[c for c in {*obs_agg, *obsm_agg} if c != "cell"])
    sizes = member.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))

    matrix = None
    values = {**({"value": X_agg} if X_agg else {}), **layers_agg}
    if m is not None and values:
        joined = m.join(member.select("cell", "_g"), "cell")
        aggs = []
        for c, kind in values.items():
            aggs.append((F.avg(c) if kind == "mean" and nan_sparse else F.sum(c)).alias(c))
        matrix = joined.groupBy("_g", "feature").agg(*aggs)
        if not nan_sparse and "mean" in values.values():
            matrix = matrix.join(sizes, "_g").select("_g", "feature", *[
                (F.col(c) / F.col("_n")).alias(c) if kind == "mean" else F.col(c) for c, kind in values.items()])
        matrix = matrix.withColumnRenamed("_g", "cell")

    plain = [(F.sum if kind == "sum" else F.avg)(c).alias(c) for c, kind in obs_agg.items() if kind != "majority"]
    dims = {c: dimension(cells, c) for c in obsm_agg}
    parts = [(F.sum if obsm_agg[c] == "sum" else F.avg)(F.col(c)[i].cast("double")).alias(f"_{c}_{i}") for c, d in dims.items() for i in range(d)]
    table = member.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), *plain, *parts)
    table = table.select("_g", *[c for c, k in obs_agg.items() if k != "majority"],
                         *[F.array(*[f"_{c}_{i}" for i in range(d)]).alias(c) for c, d in dims.items()])
    for c, kind in obs_agg.items():
        if kind == "majority":
            table = table.join(majority(member, "_g", c), "_g", "left")
    return matrix, table.withColumnRenamed("_g", "cell")


def aggregate_var(m: DataFrame | None, features: DataFrame, by: str, X_agg: str | None = "sum", var_agg: Mapping[str, str] | None = None,
                  varm_agg: Mapping[str, str] | None = None, layers_agg: Mapping[str, str] | None = None, separator: str = ",",
                  nan_sparse: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """The same over features: (MATRIX over feature groups, FEATURES of groups)."""

    def swap(t: DataFrame) -> DataFrame:
        rest = [c for c in t.columns if c not in ("cell", "feature")]
        return t.select(F.col("feature").alias("cell"), F.col("cell").alias("feature"), *rest)

    flipped = swap(m) if m is not None else None
    matrix, table = aggregate_obs(flipped, features.withColumnRenamed("feature", "cell"), by, X_agg, var_agg, varm_agg, layers_agg, separator, nan_sparse)
    return (swap(matrix) if matrix is not None else None), table.withColumnRenamed("cell", "feature")


Dataset = tuple[DataFrame, DataFrame]


def metacells(*datasets: Dataset, use_rep: str, n_meta: int, common: bool = True, seed: int = 0,
              agg_kws: Sequence[Mapping[str, Any]] | None = None) -> list[tuple[DataFrame | None, DataFrame]]:
    """Joint K-means over all cells, then :func:`aggregate_obs` per dataset.

    With ``common`` only metacells that every dataset contributes to are kept.
    """
    kws = list(agg_kws) if agg_kws is not None else [{}] * len(datasets)
    if len(kws) != len(datasets):
        raise ValueError("as many agg_kws as datasets are needed")
    parts = [c.select(F.concat("cell", F.lit(f"-{i}")).alias("cell"), F.col(use_rep).alias("rep"), F.lit(i).alias("_d")) for i, (_, c) in enumerate(datasets)]
    joint = parts[0]
    for p in parts[1:]:
        joint = joint.unionByName(p)
    labels = cut_lineage(kmeans(joint, n_meta, seed, out="metacell").select("cell", "metacell", "_d"))
    out = []
    for i, (m, c) in enumerate(datasets):
        mine = labels.where(F.col("_d") == i).select(F.expr(f"left(cell, length(cell) - {len(f'-{i}')})").alias("cell"), "metacell")
        agg, table = aggregate_obs(m, c.join(mine, "cell"), "metacell", **kws[i])
        # metacell tables are small next to their input and are read many times afterwards
        out.append((cut_lineage(agg) if agg is not None else None, cut_lineage(table)))
    if not common:
        return out
    shared = labels.groupBy("metacell").agg(F.count_distinct("_d").alias("k")).where(F.col("k") == len(datasets)).select(F.col("metacell").alias("cell"))
    if shared.isEmpty():
        raise RuntimeError("no common metacells")
    return [(m.join(shared, "cell", "left_semi") if m is not None else None, c.join(shared, "cell", "left_semi")) for m, c in out]


def metacells_paired(a: Dataset, b: Dataset, use_rep: str, n_meta: int, seed: int = 0,
                     agg_kws: Sequence[Mapping[str, Any]] | None = None) -> list[tuple[DataFrame | None, DataFrame]]:
    """Metacells of paired data: clustered on the first dataset, copied to the second by cell ID."""
    kws = list(agg_kws) if agg_kws is not None else [{}, {}]
    labels = cut_lineage(kmeans(a[1], n_meta, seed, rep=use_rep, out="metacell").select("cell", "metacell"))
    return [aggregate_obs(m, c.join(labels, "cell"), "metacell", **k) for (m, c), k in zip((a, b), kws, strict=True)]


def consistent_groups(*labels: DataFrame, group: str = "cell", label: str = "cell_type") -> DataFrame:
    """Groups present in every table with one and the same label."""
    out = labels[0].select(group, label)
    for t in labels[1:]:
        out = out.join(t.select(group, label), [group, label], "left_semi")
    return out


def group_fractions(a: DataFrame, b: DataFrame, by: str, weight: str | None = None) -> DataFrame:
    """(by, frac_a, frac_b): share of cells (or of weight) per category in two datasets."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)

    def side(df: DataFrame, name: str) -> DataFrame:
        total = df.where(F.col(by).isNotNull()).agg(F.sum(w)).scalar()
        sums = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum(w).alias("_s"))
        return sums.withColumn("_t", total).select(by, (F.col("_s") / F.col("_t")).alias(name))

    both = side(a, "frac_a").join(side(b, "frac_b"), by, "full_outer")
    return both.select(by, F.coalesce("frac_a", F.lit(0.0)).alias("frac_a"), F.coalesce("frac_b", F.lit(0.0)).alias("frac_b"))


def crosstab_long(df: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, value) with zero cells, sorted by value."""
    t = df.select(F.col(left).cast("string").alias("left"), F.col(right).cast("string").alias("right")).dropna()
    counts = t.groupBy("left", "right").agg(F.count(F.lit(1)).alias("value"))
    grid = pair_grid(t.select("left").distinct(), t.select("right").distinct())
    return grid.join(counts, ["left", "right"], "left").fillna(0, ["value"]).orderBy("value")
