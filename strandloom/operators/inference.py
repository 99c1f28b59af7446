"""Permutation-based inference, quantiles, ranking curves, edge-set statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.joins import pair_grid, salted_join
from strandloom.functions.ranks import bh_fdr, cumulate, exact_quantiles, positions, top_per_group, value_ranks
from strandloom.functions.runtime import cut_lineage, scalar
from strandloom.functions.vectors import dot, l2_normalize
from strandloom.operators.cis_sampling import place_key, samples_above
from strandloom.operators.graph import edge_product
from strandloom.operators.intervals import overlap_pairs


# ---------------------------------------------------------------- quantiles

def empirical_quantile(fg: DataFrame, bg: DataFrame, value: str, side: str = "left", out: str = "quantile") -> DataFrame:
    """Share of background values below (left) or up to (right) each foreground value.

    Foreground and background values are counted together and prefix-summed by range buckets.
    """
    both = fg.select(value, F.lit(0).alias("_b")).unionByName(bg.select(value, F.lit(1).alias("_b"))).where(F.col(value).isNotNull())
    cum = cumulate(both.groupBy(value).agg(F.sum("_b").alias("_b")), [], value, ["_b"])
    below = F.col("cum__b") - (F.col("_b") if side == "left" else F.lit(0))
    return fg.join(cum.select(value, F.coalesce(F.try_divide(below, F.col("tot__b")), F.lit(float("nan"))).alias(out)), value, "left").select(*fg.columns, out)


def quantile_edges(df: DataFrame, col: str, q: int) -> DataFrame:
    """(i, edge): exact linear-interpolated quantiles i / q, i = 0..q.

    Each distinct value covers a run of sorted positions, and emits the quantiles that fall there.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    cum = cut_lineage(cumulate(counts, [], "v", ["c"]).select("v", (F.col("cum_c") - F.col("c")).alias("a"), F.col("cum_c").alias("b"), F.col("tot_c").alias("n")))
    last = F.greatest(F.col("n") - 1, F.lit(1))
    lo = F.sequence(F.ceil(F.col("a") * q / last), F.least(F.ceil(F.col("b") * q / last) - 1, F.lit(q)))
    hi_from, hi_to = F.floor((F.col("a") - 1) * q / last) + 1, F.least(F.floor((F.col("b") - 1) * q / last), F.lit(q))
    lows = cum.where(F.ceil(F.col("a") * q / last) <= F.least(F.ceil(F.col("b") * q / last) - 1, F.lit(q))).select(
        F.explode(lo).alias("i"), F.col("v").alias("lo"), "n")
    highs = cum.where(F.greatest(hi_from, F.lit(0)) <= hi_to).select(F.explode(F.sequence(F.greatest(hi_from, F.lit(0)), hi_to)).alias("i"), F.col("v").alias("hi"))
    h = (F.col("n") - 1) * F.col("i") / q
    return lows.join(highs, "i").select(F.col("i").cast("int").alias("i"), (F.col("lo") + (F.col("hi") - F.col("lo")) * (h - F.floor(h))).alias("edge"))


def qcut(df: DataFrame, col: str, q: int, out: str = "bin") -> DataFrame:
    """0-based quantile bin, right-closed; repeated edges are dropped."""
    edges = quantile_edges(df, col, q).agg(F.array_sort(F.collect_set("edge"))).scalar()  # q + 1 numbers
    below = F.size(F.filter("_edges", lambda e: e < F.col(col).cast("double")))
    return df.withColumn("_edges", edges).withColumn(out, F.when(F.col(col).isNotNull(), F.greatest(below, F.lit(1)) - 1)).drop("_edges")


def cut(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str], out: str = "bin", include_lowest: bool = True) -> DataFrame:
    """Label of the right-closed bin between fixed edges; null outside."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin is needed")
    v, expr = F.col(col), F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        low = (v >= edges[i]) if i == 0 and include_lowest else (v > edges[i])
        expr = F.when(low & (v <= edges[i + 1]), labels[i]).otherwise(expr)
    return df.withColumn(out, expr)


def quantile_filter(df: DataFrame, col: str, frac: float) -> DataFrame:
    """Rows in the top ``frac`` share by ``col``: at or above the (1 - frac) quantile."""
    edge = exact_quantiles(df.select(col), col, [1 - frac]).select("q0").scalar()
    return df.withColumn("_edge", edge).where(F.col(col) >= F.col("_edge")).drop("_edge")


def top_n(df: DataFrame, by: str, col: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    return top_per_group(df, [by], [F.col(col).desc(), *[F.col(t) for t in ties]], n)


# ---------------------------------------------------------------- regulatory inference

def permute_rows(embedding: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """(node, rep) with the vectors of ``nodes`` shuffled among them: two pseudo-random orders of
    the same nodes are matched position by position."""
    a = positions(nodes, [], ["node"], seed).select("node", "pos")
    b = positions(embedding.join(nodes, "node", "left_semi").select("node", "rep"), [], ["node"], seed + 1).select("pos", "rep")
    return a.join(b, "pos").select("node", "rep")


def regulatory_inference(embeddings: Sequence[DataFrame], skeleton: DataFrame, alternative: str = "two.sided", seed: int = 0) -> DataFrame:
    """Skeleton EDGES with score, pval and qval.

    The score is the mean cosine over models; the background pools the cosines of all skeleton
    edges in all models after shuffling each model's vectors among the skeleton's nodes.
    Embeddings are (node, rep) tables over one feature set that covers the skeleton.
    """
    if alternative not in ("two.sided", "greater", "less"):
        raise ValueError("unknown alternative")
    nodes = cut_lineage(skeleton.select(F.explode(F.array("source", "target")).alias("node")).distinct())
    skeleton, embeddings = cut_lineage(skeleton), [cut_lineage(e.select("node", "rep")) for e in embeddings]
    if len({e.count() for e in embeddings}) != 1:
        raise ValueError("all embeddings must have the same number of rows")
    for e in embeddings:
        if not nodes.join(e, "node", "left_anti").isEmpty():
            raise ValueError("embeddings do not cover the skeleton")

    k = len(embeddings)

    def unit(e: DataFrame, name: str) -> DataFrame:
        return e.select("node", l2_normalize(F.col("rep").cast("array<double>")).alias(name))

    vecs = nodes  # own and shuffled vectors of every node, which travel together; a node that an embedding repeats has several rows
    for i, e in enumerate(embeddings):
        vecs = vecs.join(unit(e, f"u{i}"), "node").join(unit(permute_rows(e, nodes, seed + 2 * i), f"p{i}"), "node")
    names = [f"{c}{i}" for c in "up" for i in range(k)]
    vecs = cut_lineage(vecs.withColumn("_one", F.row_number().over(Window.partitionBy("node").orderBy("node")) == 1))
    s, t = (vecs.select(F.col("node").alias(end), *[F.col(c).alias(f"_{end[0]}{c}") for c in names], F.col("_one").alias(f"_{end[0]}")) for end in ("source", "target"))
    cos = {c: dot(f"_s{c}", f"_t{c}") for c in names}
    rest = [c for c in skeleton.columns if c not in ("source", "target")]
    score = sum((cos[f"u{i}"] for i in range(k)), F.lit(0.0)) / k
    scored = cut_lineage(skeleton.join(s, "source").join(t, "target").select(
        "source", "target", *rest, score.alias("score"), F.when(F.col("_s") & F.col("_t"), F.array(*[cos[f"p{i}"] for i in range(k)])).alias("_bg")))
    fg, bg = scored.drop("_bg"), scored.select(F.explode("_bg").alias("score"))
    quant = empirical_quantile(fg, bg, "score", "left", "_q")
    q = F.col("_q")
    pval = {"two.sided": 2 * F.least(q, 1 - q), "greater": 1 - q, "less": q}[alternative]
    return bh_fdr(cut_lineage(quant.withColumn("pval", pval).drop("_q")), "pval", "qval")


# ---------------------------------------------------------------- cis-regulatory ranking

def _rank_over_all(enrich: DataFrame, genes: DataFrame, tfs: DataFrame) -> DataFrame:
    """(gene, tf, rank): average ranks of -enrichment per TF over all genes; genes without an
    entry form the last tie block, whose rank is added arithmetically."""
    stored = enrich.where("enrich > 0").withColumn("_neg", -F.col("enrich").cast("double"))
    ranks = value_ranks(stored, ["tf"], "_neg").select("tf", "_neg", "rank")
    filled = stored.groupBy("tf").agg(F.count(F.lit(1)).alias("_nnz"))
    sized = tfs.join(filled, "tf", "left").fillna(0, ["_nnz"]).withColumn("_g", scalar(genes, F.count(F.lit(1))))
    grid = pair_grid(genes, sized)
    hits = stored.join(ranks, ["tf", "_neg"]).select("gene", "tf", "rank")
    tail = F.col("_nnz") + (F.col("_g") - F.col("_nnz") + 1) / 2
    return grid.join(hits, ["gene", "tf"], "left").select("gene", "tf", F.coalesce("rank", tail).cast("double").alias("rank"))


def cis_regulatory_enrichment(gene2region: DataFrame, region2tf: DataFrame, regions: DataFrame, n_samples: int = 1000, seed: int = 0) -> DataFrame:
    """(gene, tf, observed, enrich) for pairs joined by a region.

    ``observed`` counts gene-region-TF paths with multiplicity. Each sample replaces every region
    by a random one of its length bin; ``enrich`` counts the samples whose path number does not
    exceed the observed one. Samples are drawn and counted in packed blocks (``cis_sampling``).
    ``regions`` is (region [, length]).
    """
    g2r = cut_lineage(gene2region.groupBy("source", "target").agg(F.count(F.lit(1)).alias("d")))
    r2t = cut_lineage(region2tf.groupBy("source", "target").agg(F.count(F.lit(1)).alias("d")))
    obs = cut_lineage(edge_product(g2r, r2t, "d").select(F.col("source").alias("gene"), F.col("target").alias("tf"), F.col("weight").alias("observed")))
    if not n_samples:
        return obs.withColumn("enrich", F.col("observed"))
    regions = cut_lineage(regions)
    lens = regions.select("region", F.col("length").cast("double").alias("length")) if "length" in regions.columns else regions.select("region", F.lit(1.0).alias("length"))
    unique = lens.agg(F.count_distinct("length")).first()[0]
    binned = qcut(lens, "length", min(unique, 500))
    places = cut_lineage(positions(binned, ["bin"], ["region"], key=place_key("region", seed)).select("region", "bin", "pos", "n"))
    links = g2r.select(F.col("source").alias("gene"), F.col("target").alias("region"), "d")
    counts = r2t.select(F.col("source").alias("region"), F.col("target").alias("tf"), F.col("d").alias("c"))
    above = samples_above(links, counts, obs, places, n_samples, seed)
    return obs.join(above, ["gene", "tf"], "left").select("gene", "tf", "observed", (F.lit(n_samples) - F.coalesce("above", F.lit(0))).cast("double").alias("enrich"))


def cis_regulatory_ranking(gene2region: DataFrame, region2tf: DataFrame, genes: DataFrame, regions: DataFrame, tfs: DataFrame,
                           n_samples: int = 1000, seed: int = 0, normalize: bool = False) -> DataFrame:
    """(gene, tf, rank): rank 1 = most enriched gene of the TF. ``genes`` is (gene), ``tfs`` (tf).

    With ``normalize`` the result keeps the enrichment fraction as well (0 where unobserved).
    """
    enrich = cut_lineage(cis_regulatory_enrichment(gene2region, region2tf, regions, n_samples, seed))
    ranks = _rank_over_all(enrich, genes.select("gene").distinct(), tfs.select("tf").distinct())
    if not normalize:
        return ranks
    part = enrich.select("gene", "tf", (F.col("enrich") / max(n_samples, 1)).alias("fraction"))
    return ranks.join(part, ["gene", "tf"], "left").fillna(0.0, ["fraction"])


# ---------------------------------------------------------------- evidence tables and links

def evidence_table(skeleton: DataFrame, edges: Mapping[str, DataFrame], dist: str | None = None,
                   bins: tuple[Sequence[float], Sequence[str]] | None = None) -> DataFrame:
    """Skeleton EDGES with one column per evidence: its ``value`` (absent -> 0) or presence flag."""
    out = skeleton
    for name, e in edges.items():
        if "value" in e.columns:
            t = e.groupBy("source", "target").agg(F.max("value").alias(name))
            out = out.join(t, ["source", "target"], "left").fillna(0, [name])
        else:
            t = e.select("source", "target").distinct().withColumn(name, F.lit(True))
            out = out.join(t, ["source", "target"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out if bins is None else cut(out, dist or "dist", *bins, out="dist_bin")


def coaccess_links(conns: DataFrame, peaks: DataFrame, promoters: DataFrame) -> DataFrame:
    """(gene, peak, coaccess): peak pairs whose first peak overlaps a gene's promoter; of several
    such pairs per gene and peak the largest co-access is kept."""
    hit = overlap_pairs(promoters, peaks, 0, left_cols=["name"], right_cols=["name"]).select(F.col("l_name").alias("gene"), F.col("r_name").alias("peak1")).distinct()
    joined = salted_join(conns, hit, ["peak1"], ["peak2"])
    return joined.groupBy("gene", F.col("peak2").alias("peak")).agg(F.max("coaccess").alias("coaccess"))


# ---------------------------------------------------------------- ranking curves

def _thresholds(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score, best first: positives and negatives at it and up to it."""
    y = F.col(label).cast("int")
    t = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy((-F.col(score).cast("double")).alias("_neg")).agg(
        F.sum(y).cast("double").alias("p"), F.sum(1 - y).cast("double").alias("n"), F.lit(1).alias("t"))
    return cumulate(t, [], "_neg", ["p", "n", "t"])


def _thin(points: DataFrame, max_points: int) -> DataFrame:
    """Evenly spaced curve points, at most ``max_points``."""
    total = F.col("tot_t")
    step = F.floor((F.col("cum_t") - 1) * max_points / total)
    first = F.col("cum_t") == 1
    return points.where((total <= max_points) | first | (F.floor((F.col("cum_t") - 2) * max_points / total) != step))


def roc(df: DataFrame, label: str, score: str, max_points: int = 500) -> DataFrame:
    """(fpr, tpr, threshold) points of the ROC curve."""
    return _thin(_thresholds(df, label, score), max_points).select(
        F.coalesce(F.try_divide("cum_n", "tot_n"), F.lit(float("nan"))).alias("fpr"), F.coalesce(F.try_divide("cum_p", "tot_p"), F.lit(float("nan"))).alias("tpr"), (-F.col("_neg")).alias("threshold"))


def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve (NaN with one class): each threshold's negatives see the positives above it plus half of its own."""
    t = _thresholds(df, label, score)
    area = F.coalesce(F.try_divide(F.sum(F.col("n") * (F.col("cum_p") - F.col("p") / 2)), F.max("tot_p") * F.max("tot_n")), F.lit(float("nan")))
    return t.agg(area.alias("auroc"))


def prc(df: DataFrame, label: str, score: str, max_points: int = 500) -> DataFrame:
    """(recall, precision, threshold) points."""
    return _thin(_thresholds(df, label, score), max_points).select(
        F.coalesce(F.try_divide("cum_p", "tot_p"), F.lit(float("nan"))).alias("recall"), (F.col("cum_p") / (F.col("cum_p") + F.col("cum_n"))).alias("precision"), (-F.col("_neg")).alias("threshold"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    t = _thresholds(df, label, score)
    return t.agg((F.sum(F.col("p") * F.col("cum_p") / (F.col("cum_p") + F.col("cum_n"))) / F.max("tot_p")).alias("average_precision"))


# ---------------------------------------------------------------- edge sets

def _log_pmf(k: int, row: int, col: int, n: int) -> float:
    """Logarithm of the hypergeometric probability of k."""
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    return choose(row, k) + choose(n - row, col - k) - choose(n, col)


def _tail(k: int, step: int, row: int, col: int, n: int, lo: int, hi: int) -> float:
    """Sum of the probabilities from k outwards, until the terms no longer count."""
    total, term = 0.0, math.exp(_log_pmf(k, row, col, n))
    while lo <= k <= hi and term > 0:
        total += term
        if step > 0:
            ratio = (row - k) * (col - k) / ((k + 1) * (n - row - col + k + 1))
        else:
            ratio = k * (n - row - col + k) / ((row - k + 1) * (col - k + 1))
        if term < 1e-18 * total and ratio < 1:
            break
        term, k = term * ratio, k + step
    return total


def _fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of hypergeometric probabilities not above the observed one.

    The probabilities fall on both sides of the mode, so these are two tails: the one of the observed count, and beyond the mode the one
    whose start is found by bisection. Both are summed outwards by their ratios.
    """
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    mode = min(max((row + 1) * (col + 1) // (n + 2), lo), hi)
    bound = _log_pmf(a, row, col, n) + 1e-7
    if _log_pmf(mode, row, col, n) <= bound:
        return 1.0
    side = 1 if a > mode else -1
    near, far = mode, lo if side > 0 else hi  # the other tail ends at ``far``; at ``near`` the probability is above the bound
    total = _tail(a, side, row, col, n, lo, hi)
    if _log_pmf(far, row, col, n) <= bound:
        while abs(far - near) > 1:
            mid = (near + far) // 2
            near, far = (near, mid) if _log_pmf(mid, row, col, n) <= bound else (mid, far)
        total += _tail(far, -side, row, col, n, lo, hi)
    return float(min(1.0, total))


def fisher_edges(a: DataFrame, b: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: 2 x 2 counts of two edge sets over all source x target pairs, Fisher exact p-value.

    Pairs in neither set are counted by arithmetic, so the universe is never built.
    """
    s, t = sources.select("source").distinct(), targets.select("target").distinct()

    def inside(e: DataFrame) -> DataFrame:
        return e.select("source", "target").distinct().join(s, "source", "left_semi").join(t, "target", "left_semi")

    ea, eb = inside(a).withColumn("_a", F.lit(1)), inside(b).withColumn("_b", F.lit(1))
    both = ea.join(eb, ["source", "target"], "full_outer").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))
    size = scalar(s, F.count(F.lit(1))) * scalar(t, F.count(F.lit(1)))
    table = both.withColumn("_u", size).select("both", "only_a", "only_b", (F.col("_u") - F.col("both") - F.col("only_a") - F.col("only_b")).alias("neither"))

    def solve(batches):
        for pdf in batches:
            pdf["pval"] = [_fisher_two_sided(*map(int, r)) for r in pdf[["both", "only_a", "only_b", "neither"]].to_numpy()]
            yield pdf

    return table.mapInPandas(solve, "both long, only_a long, only_b long, neither long, pval double")


def discovery_rate(edges: DataFrame, subset: DataFrame, q: float = 0.05) -> DataFrame:
    """One row: share of significant edges overall and among the given edges."""
    flag = subset.select("source", "target").distinct().withColumn("_in", F.lit(True))
    hit = F.when(F.col("qval") < q, 1.0).otherwise(0.0)
    return edges.join(flag, ["source", "target"], "left").agg(F.avg(hit).alias("rate_all"), F.avg(F.when(F.col("_in"), hit)).alias("rate_subset"))


def targets_per_tf(edges: DataFrame) -> DataFrame:
    """(tf, n_targets) by number of distinct targets."""
    return edges.select(F.col("source").alias("tf"), "target").distinct().groupBy("tf").agg(F.count(F.lit(1)).alias("n_targets")).orderBy(F.col("n_targets").desc(), "tf")
