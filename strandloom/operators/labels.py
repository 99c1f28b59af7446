"""Label transfer, balancing weights, rank-sum markers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandloom.functions.joins import pair_grid, salted_join
from strandloom.functions.ranks import bh_fdr, positions, top_per_group
from strandloom.functions.runtime import cut_lineage, scalar
from strandloom.functions.vectors import dot, l2_normalize
from strandloom.operators import matrix as mt
from strandloom.operators.aggregate import aggregate_obs, group_fractions, majority
from strandloom.operators.embed import kmeans
from strandloom.operators.neighbors import knn, knn_approx


def _best(scores: DataFrame, key: str, label: str, weight: str) -> DataFrame:
    """Label with the largest weight per key (smallest label among equals)."""
    top = F.min(F.struct((-F.round(weight, 12)).alias("n"), F.col(label).alias("l"), F.col(weight).alias("w")))
    return scores.groupBy(key).agg(top.alias("t")).select(key, F.col("t.l").alias(label), F.col("t.w").alias(weight))


def transfer_labels(ref: DataFrame, query: DataFrame, field: str, n_neighbors: int = 30, use_rep: str = "rep", key_added: str | None = None) -> DataFrame:
    """(cell, <field>, <field>_confidence): labels voted by reference cells weighted with the
    Jaccard index of shared neighbours, looked up in both the reference and the query."""
    out = key_added or field
    k = n_neighbors

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        return cut_lineage(knn(a, b, k, rep=use_rep).select("query", "ref"))

    xx, xy = pairs(ref, ref), pairs(ref, query)
    yx, yy = (xx, xy) if ref is query else (pairs(query, ref), pairs(query, query))

    def shared(r: DataFrame, q: DataFrame) -> DataFrame:
        left = r.select(F.col("query").alias("_r"), F.col("ref").alias("_z"))
        right = q.select(F.col("query").alias("_q"), F.col("ref").alias("_z"))
        return salted_join(left, right, ["_z"], ["_r"]).groupBy("_r", "_q").agg(F.count(F.lit(1)).alias("s"))

    s = shared(xx, yx).unionByName(shared(xy, yy)).groupBy("_r", "_q").agg(F.sum("s").alias("s"))
    weighted = s.select("_r", "_q", (F.col("s") / (4 * k - F.col("s"))).alias("w"))
    votes = weighted.join(ref.select(F.col("cell").alias("_r"), F.col(field).alias(out)), "_r").groupBy("_q", out).agg(F.sum("w").alias("w"))
    total = votes.groupBy("_q").agg(F.sum("w").alias("_t"))
    votes = votes.join(total, "_q").withColumn("w", F.col("w") / F.col("_t"))
    return _best(votes, "_q", out, "w").select(F.col("_q").alias("cell"), out, F.col("w").alias(f"{out}_confidence"))


def vote_labels(ref: DataFrame, query: DataFrame, field: str, k: int = 50, rep: str = "rep", approx: bool = False) -> DataFrame:
    """(cell, <field>): most frequent label among the k reference cells of largest cosine."""
    if approx:
        nn = knn_approx(query, ref, k, metric="cosine", rep=rep)
    else:
        unit = [x.withColumn("_u", l2_normalize(F.col(rep).cast("array<double>"))) for x in (query, ref)]
        nn = knn(unit[0], unit[1], k, "ip", rep="_u")
    hits = nn.join(ref.select(F.col("cell").alias("ref"), field), "ref")
    return majority(hits, "query", field).withColumnRenamed("query", "cell")


def transfer_accuracy(df: DataFrame, true: str, pred: str, extra_pairs: DataFrame | None = None) -> DataFrame:
    """One row: share of exact matches, and of relaxed ones: a true label also matches itself
    without "?", each part of a "/" list, and the (true, pred) pairs listed; labels containing
    "unknown" count for neither hit nor total."""
    t, p = F.col(true), F.col(pred)
    strict = t == p
    loose = strict | (t.contains("?") & (p == F.regexp_replace(t, r"\?", ""))) | (t.contains("/") & F.array_contains(F.split(t, "/"), p))
    if extra_pairs is not None:
        listed = extra_pairs.select(F.col("true").alias(true), F.col("pred").alias(pred)).distinct().withColumn("_listed", F.lit(True))
        df = df.join(listed, [true, pred], "left")
        loose = loose | F.coalesce("_listed", F.lit(False))
    known = ~F.lower(true).contains("unknown")
    return df.agg(F.avg(F.when(strict, 1.0).otherwise(0.0)).alias("exact_accuracy"),
                  F.avg(F.when(known, F.when(loose, 1.0).otherwise(0.0))).alias("relaxed_accuracy"))


def balancing_weight(*datasets: DataFrame, use_rep: str = "rep", cluster: str | None = None, use_batch: str | None = None, cutoff: float = 0.5,
                     power: float = 4.0, key_added: str = "balancing", size_col: str | None = None, n_clusters: int = 20, seed: int = 0) -> list[DataFrame]:
    """CELLS with a weight that is high for cells of clusters matched across all datasets.

    Cluster means are compared by cosine (below ``cutoff`` -> 0, then ``power``); the joint
    similarity of a tuple of clusters is the product over all dataset pairs; a cluster's weight is
    its joint sum over its size, scaled to mean 1 over cells. ``size_col`` sums a column as size
    instead of counting cells. With ``use_batch`` everything is done within batches.
    """
    batch = use_batch or "_all"
    clusters, cells = [], []
    for d in datasets:
        c = kmeans(d, n_clusters, seed, rep=use_rep, out="_cluster") if cluster is None else d.withColumn("_cluster", F.col(cluster).cast("string"))
        c = c if use_batch else c.withColumn("_all", F.lit("all"))
        c = c.withColumn("_key", F.concat_ws("\u0001", F.col(batch).cast("string"), "_cluster")).withColumn("_size", F.col(size_col).cast("double") if size_col else F.lit(1.0))
        keys = c.select("_key", F.col(batch).alias("_b")).distinct()
        _, agg = aggregate_obs(None, c.select("cell", "_key", "_size", use_rep), "_key", X_agg=None, obs_agg={"_size": "sum"}, obsm_agg={use_rep: "mean"}, separator="\u0002")
        clusters.append(cut_lineage(agg.withColumnRenamed("cell", "_key").join(keys, "_key").select(
            "_key", "_b", "_size", l2_normalize(F.col(use_rep)).alias("_u"))))
        cells.append(c)
    if use_batch:
        names = clusters[0].select("_b").distinct()
        for c in clusters[1:]:
            other = c.select("_b").distinct()
            if not names.join(other, "_b", "left_anti").isEmpty() or not other.join(names, "_b", "left_anti").isEmpty():
                raise ValueError("batches must match between datasets")

    def similar(i: int, j: int) -> DataFrame:
        # cluster tables are small: tens of rows per dataset and batch
        a = clusters[i].select("_b", F.col("_key").alias(f"k{i}"), F.col("_u").alias("_ui"))
        b = clusters[j].select("_b", F.col("_key").alias(f"k{j}"), F.col("_u").alias("_uj"))
        return a.join(b, "_b").withColumn("_c", dot("_ui", "_uj")).where(F.col("_c") >= cutoff).where(F.col("_c") != 0).select(
            f"k{i}", f"k{j}", F.pow("_c", F.lit(float(power))).alias("_c"))

    joint = None
    for j in range(1, len(datasets)):
        for i in range(j):
            s = similar(i, j)
            if joint is None:
                joint = s.withColumnRenamed("_c", "_w")
            else:
                on = [c for c in (f"k{i}", f"k{j}") if c in joint.columns]
                joint = joint.join(s, on).withColumn("_w", F.col("_w") * F.col("_c")).drop("_c")
    joint = cut_lineage(joint)
    out = []
    for i, (c, cl, d) in enumerate(zip(cells, clusters, datasets, strict=True)):
        raw = cl.join(joint.groupBy(F.col(f"k{i}").alias("_key")).agg(F.sum("_w").alias("_s")), "_key", "left").select(
            "_key", (F.coalesce("_s", F.lit(0.0)) / F.col("_size")).alias("_raw"))
        w = c.join(raw, "_key")
        mean = w.groupBy(F.col(batch).alias("_mb")).agg(F.avg("_raw").alias("_mean"))
        out.append(w.join(mean, F.col(batch) == F.col("_mb")).withColumn(key_added, F.coalesce(F.try_divide("_raw", "_mean"), F.lit(float("nan")))).select(*d.columns, key_added))
    return out


def balance_by_group(a: DataFrame, b: DataFrame, by: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Both CELLS tables with ``mask`` (a random subset with the smaller of both shares of every
    group) and ``group_balancing`` = sqrt(other share / own share)."""
    frac = cut_lineage(group_fractions(a, b, by))
    out = []
    for df, own, other in ((a, "frac_a", "frac_b"), (b, "frac_b", "frac_a")):
        total = scalar(df, F.count(F.lit(1)))
        pos = positions(df, [by], ["cell"], seed).join(frac, by).withColumn("_total", total)
        keep = F.bround(F.least("frac_a", "frac_b") * F.col("_total"))
        out.append(pos.select(*df.columns, (F.col("pos") < keep).alias("mask"), F.sqrt(F.col(other) / F.col(own)).alias("group_balancing")))
    return out[0], out[1]


@F.pandas_udf(DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal tail probability."""
    return pd.Series([math.erfc(abs(v) / math.sqrt(2.0)) if v == v and v is not None else np.nan for v in z])


def rank_features_groups(m: DataFrame, cells: DataFrame, by: str) -> DataFrame:
    """(group, names, scores, pvals, pvals_adj, logfoldchanges): rank-sum test of every feature,
    each group against the rest, on log1p values; normal approximation without tie correction."""
    label = cells.where(F.col(by).isNotNull()).select("cell", F.col(by).cast("string").alias("group"))
    m = m.join(label.select("cell"), "cell", "left_semi").select("cell", "feature", "value")
    ranks, level = mt.rank_parts(m, label)
    e = m.where("value <> 0").join(label, "cell").groupBy("feature", "group").agg(F.sum("value").alias("s"))
    r = ranks.join(label, "cell").groupBy("feature", "group").agg(F.sum("value").alias("r"))
    sizes = label.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    total = e.groupBy("feature").agg(F.sum("s").alias("st"))
    grid = pair_grid(m.select("feature").distinct(), sizes)
    t = (grid.join(r, ["feature", "group"], "left").join(e, ["feature", "group"], "left").fillna(0.0, ["r", "s"])
             .join(level, "feature", "left").join(total, "feature", "left").fillna(0.0, ["zero_rank", "st"]).withColumn("nt", scalar(label, F.count(F.lit(1)))))
    z = F.expr("(r + n * zero_rank - n * (nt + 1) / 2) / sqrt(n * (nt - n) * (nt + 1) / 12)")
    lfc = F.log2((F.expm1(F.col("s") / F.col("n")) + 1e-9) / (F.expm1((F.col("st") - F.col("s")) / (F.col("nt") - F.col("n"))) + 1e-9))
    scored = cut_lineage(t.select("group", F.col("feature").alias("names"), z.alias("scores"), lfc.alias("logfoldchanges")).withColumn("pvals", _two_sided("scores")))
    return bh_fdr(scored, "pvals", "pvals_adj", ["group"])


def extract_markers(ranked: DataFrame, groups: Sequence[str] | None = None, filter_by: str = "pvals_adj < 0.01", sort_by: str = "scores",
                    ascending: bool = False) -> DataFrame:
    """Each feature under its best group only, then filtered, ordered by (group, score)."""
    df = ranked if groups is None else ranked.where(F.col("group").isin(list(groups)))
    order = F.col(sort_by).asc() if ascending else F.col(sort_by).desc()
    best = top_per_group(df, ["names"], [order, F.col("group")], 1)
    return best.where(F.expr(filter_by)).orderBy("group", order)


def marker_intersections(markers: DataFrame, universe: DataFrame) -> DataFrame:
    """For every tuple of groups, one per domain: size of the marker overlap, size expected under
    independence, and the fold. ``universe`` is (feature)."""
    domains = [r["domain"] for r in markers.select("domain").distinct().orderBy("domain").collect()]
    base = markers.select("names", "group", "domain").distinct()
    grid, hits = None, None
    for i, d in enumerate(domains):
        mine = base.where(F.col("domain") == d).select("names", F.col("group").alias(f"group_{i + 1}"))
        size = mine.groupBy(f"group_{i + 1}").agg(F.count(F.lit(1)).alias(f"n_{i + 1}"))
        grid = size if grid is None else pair_grid(grid, size)
        hits = mine if hits is None else hits.join(mine, "names")
    keys = [f"group_{i + 1}" for i in range(len(domains))]
    observed = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("observed"))
    out = grid.join(observed, keys, "left").fillna(0, ["observed"]).withColumn("_u", scalar(universe.select("feature").distinct(), F.count(F.lit(1))))
    expected = F.col("_u").cast("double")
    for i in range(len(domains)):
        expected = expected * F.col(f"n_{i + 1}") / F.col("_u")
    return out.withColumn("expected", expected).withColumn("fold", F.col("observed") / F.col("expected")).drop("_u")


def consensus_markers(markers: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` features per group among those marked for the same group in every domain, by mean
    absolute log fold change."""
    total = scalar(markers, F.count_distinct("domain"))
    agg = markers.groupBy("names", "group").agg(F.count_distinct("domain").alias("_k"), F.avg(F.abs("scores")).alias("scores"),
                                                F.avg(F.abs("logfoldchanges")).alias("logfoldchanges")).withColumn("_d", total)
    full = agg.where(F.col("_k") == F.col("_d")).select("names", "group", "scores", "logfoldchanges")
    return top_per_group(full, ["group"], [F.round("logfoldchanges", 9).desc(), F.col("names")], n, out="rank")
