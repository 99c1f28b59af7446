"""Edge-list graph algebra. A multigraph is an EDGES table with repeated (source, target) rows."""

from __future__ import annotations

import logging
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.joins import salted_join
from strandloom.functions.packed import dealt, packed, task_count
from strandloom.functions.ranks import POSITION_BITS, cumulate, positions, running_sum
from strandloom.functions.runtime import cut_lineage, hash_key, hash_uniform
from strandloom.functions.vectors import dimension, dot, sigmoid, sum_vectors

log = logging.getLogger(__name__)


def reverse(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("source", "target")]
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *rest)


def compose(*graphs: DataFrame, directed: Sequence[bool] | None = None) -> DataFrame:
    """Union of all edges. If any graph is directed, undirected ones are mirrored first
    (a self-loop has one direction only, so it is not doubled)."""
    flags = list(directed) if directed is not None else [True] * len(graphs)
    parts = []
    for g, d in zip(graphs, flags, strict=True):
        parts.append(g)
        if any(flags) and not d:
            parts.append(reverse(g.where(F.col("source") != F.col("target"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def prob_or(col: Column | str) -> Column:
    """Probability that at least one of the grouped events happens."""
    p = F.col(col) if isinstance(col, str) else col
    return 1 - F.product(1 - p)


MERGES: dict[str, Callable[[str], Column]] = {
    "min": F.min, "max": F.max, "sum": F.sum, "mean": F.avg, "prob_or": prob_or}


def collapse(edges: DataFrame, merges: Mapping[str, str | Callable[[str], Column]], order_by: Sequence[str]) -> DataFrame:
    """One edge per (source, target): merged attributes, the last value for all others.

    An edge whose merge gives no value (null) is dropped.
    """
    aggs = []
    for c in edges.columns:
        if c in ("source", "target"):
            continue
        if c in merges:
            m = merges[c]
            aggs.append((MERGES[m] if isinstance(m, str) else m)(c).alias(c))
        else:
            aggs.append(F.max_by(c, F.struct(*order_by)).alias(c))
    return edges.groupBy("source", "target").agg(*aggs).dropna(subset=list(merges)) if aggs else edges.select("source", "target").distinct()


#: Tables of longer hops may hold so many rows per edge.
HOP_GROWTH = 4


def hop_tables(edges: DataFrame) -> list[DataFrame]:
    """(source, target) pairs 1, 2, 4, ... hops apart, each joined from the one before and written once.

    Doubling ends when no pair is left, when the hops would be longer than any path, or when the next table could outgrow the graph
    ``HOP_GROWTH``-fold, which is known from the degrees before it is joined. Chains and trees never outgrow it.
    """
    hops = cut_lineage(edges.select("source", "target").where(F.col("source") != F.col("target")).distinct())
    n_edges = hops.count()
    tables, reach = [hops], 1
    while n_edges and reach <= n_edges:
        last = tables[-1]
        into, out = last.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("a")), last.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("b"))
        pairs = into.join(out, "node").agg(F.sum(F.col("a") * F.col("b")).alias("n")).first()["n"]
        if not pairs or pairs > HOP_GROWTH * n_edges:
            break
        a, b = last.select("source", F.col("target").alias("_mid")), last.select(F.col("source").alias("_mid"), "target")
        tables.append(cut_lineage(a.join(b, "_mid").select("source", "target").where(F.col("source") != F.col("target")).distinct()))
        reach *= 2
    return tables


def reachable(edges: DataFrame, sources: DataFrame, max_sweeps: int = 1000) -> DataFrame:
    """(node) reachable from the ``sources`` nodes, which are always included.

    A sweep goes through the hop tables from the shortest on: with hops of 1, 2, 4, ..., 2^k it reaches everything within 2^(k+1) - 1 hops,
    so a chain of a thousand nodes takes ten steps. Sweeps end when single hops find nothing new.
    """
    tables = hop_tables(edges)
    known = cut_lineage(sources.select("node").distinct())
    for _ in range(max_sweeps):
        for number, hops in enumerate(tables):
            step = known.join(hops, known["node"] == hops["source"]).select(F.col("target").alias("node")).distinct()
            new = cut_lineage(step.join(known, "node", "left_anti"))
            if new.isEmpty():
                if number == 0:
                    return known
                continue
            known = cut_lineage(known.unionByName(new))
    raise RuntimeError(f"nodes are still being reached after {max_sweeps} sweeps")


def propagate_flag(edges: DataFrame, anchors: DataFrame, others: DataFrame, flag: str = "highly_variable") -> DataFrame:
    """``others`` with the flag set on features reachable from flagged anchors."""
    hit = reachable(edges, anchors.where(F.col(flag)).select(F.col("feature").alias("node")))
    base = others.drop(flag) if flag in others.columns else others
    return base.join(hit.select(F.col("node").alias("feature"), F.lit(True).alias(flag)), "feature", "left").withColumn(
        flag, F.coalesce(flag, F.lit(False)))


def graph_report(edges: DataFrame, features: DataFrame) -> DataFrame:
    """One row of violation counts: uncovered features, edges without weight or sign, nodes
    without a self-loop, edges without a reverse."""
    pairs = edges.select("source", "target").distinct()
    nodes = pairs.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    loops = pairs.where(F.col("source") == F.col("target")).select(F.col("source").alias("node"))
    bare = F.lit(False)
    for a in ("weight", "sign"):
        bare = bare | (F.col(a).isNull() if a in edges.columns else F.lit(True))
    found = [
        features.select(F.col("feature").alias("node")).distinct().join(nodes, "node", "left_anti").select(F.lit("uncovered").alias("k")),
        edges.where(bare).select(F.lit("bare").alias("k")),
        nodes.join(loops, "node", "left_anti").select(F.lit("no_loop").alias("k")),
        pairs.join(reverse(pairs), ["source", "target"], "left_anti").select(F.lit("one_way").alias("k")),
    ]
    rows = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return rows.agg(F.count_if(F.col("k") == "uncovered").alias("uncovered_features"),
                    F.count_if(F.col("k") == "bare").alias("edges_without_attributes"),
                    F.count_if(F.col("k") == "no_loop").alias("nodes_without_loop"),
                    F.count_if(F.col("k") == "one_way").alias("asymmetric_edges"))


def check_graph(edges: DataFrame, features: DataFrame, cov: str = "error", attr: str = "error",
                loop: str = "error", sym: str = "error") -> bool:
    """Raise, warn or pass over the four kinds of violation of a guidance graph."""
    for name, action in (("cov", cov), ("attr", attr), ("loop", loop), ("sym", sym)):
        if action not in ("ignore", "warn", "error"):
            raise ValueError(f"invalid `{name}`: {action}")
    counts = graph_report(edges, features).first()
    messages = ["some features are not covered by the graph", "edges without weight or sign",
                "nodes without a self-loop", "the graph is not symmetric"]
    passed = True
    for n, action, message in zip(counts, (cov, attr, loop, sym), messages, strict=True):
        if n:
            passed = False
            if action == "error":
                raise ValueError(message)
            if action == "warn":
                log.warning(message)
    return passed


def add_loops(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Add a loop (weight 1, sign 1, type loop) for every feature."""
    loops = features.select("feature").distinct().select(
        F.col("feature").alias("source"), F.col("feature").alias("target"), F.lit(1.0).alias("weight"),
        F.lit(1).alias("sign"), F.lit("loop").alias("type"))
    return edges.unionByName(loops, allowMissingColumns=True)


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    n = nodes.select("node").distinct()
    return (edges.join(n.withColumnRenamed("node", "source"), "source", "left_semi")
                 .join(n.withColumnRenamed("node", "target"), "target", "left_semi").select(*edges.columns))


def vertex_degrees(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(node, degree): weighted; for "both" a self-loop counts once. One shuffle."""
    if direction not in ("in", "out", "both"):
        raise ValueError("unknown direction")
    zero = F.lit(0.0)
    w = F.col("weight").cast("double")
    inward, outward = (w if direction != "out" else zero), (w if direction != "in" else zero)
    loop = F.col("source") == F.col("target")
    ends = F.array(
        F.struct(F.col("target").alias("node"), inward.alias("w")),
        F.struct(F.col("source").alias("node"), (F.when(loop, zero).otherwise(outward) if direction == "both" else outward).alias("w")))
    return edges.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.sum("x.w").alias("degree"))


def normalize_edges(edges: DataFrame, method: str = "keepvar", out: str = "enorm") -> DataFrame:
    """Edge weights divided by powers of the in / out degrees; degrees are summed map-side and
    joined back, so a hub is no single task's window."""
    if method not in ("in", "out", "sym", "keepvar"):
        raise ValueError("unknown method")
    df = edges.withColumn(out, F.col("weight").cast("double"))

    def divide(df: DataFrame, end: str, power: float) -> DataFrame:
        degree = edges.groupBy(end).agg(F.sum("weight").alias("_d"))
        factor = F.when(F.col("_d") > 0, F.pow("_d", F.lit(power))).otherwise(F.lit(0.0))
        return df.join(degree, end).withColumn(out, F.col(out) * factor).drop("_d")

    if method != "out":
        df = divide(df, "target", -1.0 if method == "in" else -0.5)
    if method in ("out", "sym"):
        df = divide(df, "source", -1.0 if method == "out" else -0.5)
    return df.select(*edges.columns, out)


def propagate(edges: DataFrame, node_rep: DataFrame, method: str = "keepvar", dim: int | None = None) -> DataFrame:
    """Graph convolution: per target the sum of sign * normalised weight * source vector."""
    d = dim or dimension(node_rep, "rep")
    e = normalize_edges(edges, method).select("source", "target", (F.col("sign") * F.col("enorm")).alias("_w"))
    x = e.join(node_rep.select(F.col("node").alias("source"), "rep"), "source")
    return sum_vectors(x.groupBy(F.col("target").alias("node")), [F.col("_w") * F.col("rep")[i] for i in range(d)], "rep")


def edge_score(edges: DataFrame, node_rep: DataFrame, out: str = "likelihood") -> DataFrame:
    """sigmoid(sign * <v_source, v_target>)."""
    s = node_rep.select(F.col("node").alias("source"), F.col("rep").alias("_s"))
    t = node_rep.select(F.col("node").alias("target"), F.col("rep").alias("_t"))
    return edges.join(s, "source").join(t, "target").withColumn(out, sigmoid(F.col("sign") * dot("_s", "_t"))).select(*edges.columns, out)


#: Real weights are drawn as whole numbers whose sum is about this.
UNITS = 1 << 52


def whole_weights(df: DataFrame, weight: str, out: str) -> DataFrame:
    """``weight`` as a whole number of units, its share of ``UNITS`` rounded down; positive weights have one unit at least."""
    total = df.agg(F.sum(weight).alias("s")).first()["s"] or 0.0
    share = F.floor(F.col(weight) * (UNITS / total)) if total > 0 else F.lit(0)
    return df.withColumn(out, F.when(F.col(weight) > 0, F.greatest(share, F.lit(1))).otherwise(0).cast("long"))


def _draw(draws: DataFrame, ranges: DataFrame, weight: str, total: int, n: int, u: str = "u") -> DataFrame:
    """Join whole draws in [0, total) with the ranges that hold them. Ranges are filed under cells of their mean size, so about two rows each."""
    cell = max(1, total // max(n, 1))
    held = ranges.where(F.col(weight) > 0)
    first, last = F.expr(f"lo div {cell}"), F.expr(f"(lo + {weight} - 1) div {cell}")
    filed = held.withColumn("_cell", F.explode(F.sequence(first, last)))
    hit = draws.withColumn("_cell", F.expr(f"{u} div {cell}")).join(filed, "_cell")
    return hit.where((F.col(u) >= F.col("lo")) & (F.col(u) < F.col("lo") + F.col(weight))).drop("_cell")


def _whole_draw(total: Column, *ids: str, seed: int) -> Column:
    """A whole number in [0, total)."""
    return F.least(F.floor(hash_uniform(*ids, seed=seed) * total).cast("long"), total - 1)


def _past_taken(draws: DataFrame, taken: DataFrame, by: Sequence[str], u: str = "u") -> DataFrame:
    """Draws among what is free, as places among all: ``u`` plus the sizes of the taken ranges before it.

    taken: by, lo, size, one row per range. The range that starts at lo lies before free place lo less the taken sizes before it. Both sums run
    over all groups at once, split by value, so that one group with very many ranges is no single task.
    """
    by = list(by)
    cum = cumulate(taken.select(*by, "lo", "size"), by, "lo", ["size"])
    starts = cum.select(*by, (F.col("lo") - F.col("cum_size") + F.col("size")).cast("long").alias("_v"), "size")
    wanted = draws.select(*by, F.col(u).alias("_v"), F.lit(0).cast("long").alias("size"))
    steps = cumulate(starts.unionByName(wanted).groupBy(*by, "_v").agg(F.sum("size").alias("size")), by, "_v", ["size"])
    shift = steps.select(*by, F.col("_v").alias(u), F.col("cum_size").alias("_shift"))
    return draws.join(shift, [*by, u]).withColumn(u, F.col(u) + F.col("_shift")).drop("_shift")


def _find_edges(blocks: Iterator[tuple[int, int, pa.Table]], begin: list[int]) -> Iterator[pa.RecordBatch]:
    """(draw, source, target, sign) of draws (tag 1) among a task's edges (tag 0), which lie in the order of their keys from ``begin`` on."""
    held, edges, ends = [], None, None
    for task, tag, t in blocks:
        if not tag:
            held.append(t)
            continue
        if edges is None:
            edges = pa.concat_tables(held).combine_chunks()
            key = edges.column("key").to_numpy()
            order = np.argsort(key, kind="stable")
            same = np.diff(key[order]) == 0
            tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
            if len(tied):  # parallel edges, mostly
                rest = pc.sort_indices(edges.take(pa.array(order[tied])), [(c, "ascending") for c in ("key", "source", "target", "sign", "units")])
                order[tied] = order[tied][rest.to_numpy()]
            edges, held = edges.take(pa.array(order)), []
            ends = begin[task] + np.cumsum(edges.column("units").to_numpy() * edges.column("_n").to_numpy())
        hit = edges.select(["source", "target", "sign"]).take(pa.array(np.searchsorted(ends, t.column("u").to_numpy(), "right")))
        yield from hit.add_column(0, "draw", t.column("draw")).to_batches(max_chunksize=100_000)


def _free_places(blocks: Iterator[tuple[int, int, pa.Table]], total: int) -> Iterator[pa.RecordBatch]:
    """(draw, copy, source, sign, u): copies (tag 1) of draws, each with a place of [0, total) beside the ranges taken by its (source, sign) (tag 0).

    Does what ``_past_taken`` does, for all groups of a task at once."""
    held, names = [], None
    for _, tag, t in blocks:
        if not tag:
            held.append(t)
            continue
        if names is None:
            taken = pa.concat_tables([x.select(["source", "sign", "lo", "size"]) for x in held] or [t.schema.empty_table().select(["source", "sign"])
                .append_column("lo", pa.array([], pa.int64())).append_column("size", pa.array([], pa.int64()))]).combine_chunks()
            names, held = pc.unique(taken.column("source")), []
            signs = np.unique(taken.column("sign").to_numpy())
            group = pc.index_in(taken.column("source"), names).to_numpy().astype(np.int64) * max(len(signs), 1) + np.searchsorted(signs, taken.column("sign").to_numpy())
            lo, size = taken.column("lo").to_numpy(), taken.column("size").to_numpy()
            order = np.lexsort((lo, group))
            group, lo, size = group[order], lo[order], size[order]
            first = np.concatenate([[True], (np.diff(group) != 0) | (np.diff(lo) != 0)])[:len(lo)]
            group, lo, size = group[first], lo[first], size[first]
            start = np.searchsorted(group, np.arange(len(names) * len(signs) + 1))  # the last group, without ranges, is that of all others
            cum = np.concatenate([[0], np.cumsum(size)])  # may wrap around; differences within a group do not
            v = lo - (cum[:-1] - cum[start[group]])
            steps, rank = np.unique(v, return_inverse=True)
            wide = len(steps) + 1
            at = group * wide + rank
            stop = np.append(start[1:], len(group))
        code = pc.fill_null(pc.index_in(t.column("source"), names), -1).to_numpy().astype(np.int64)
        sign = t.column("sign").to_numpy()
        own = np.searchsorted(signs, sign)
        known = (code >= 0) & (own < len(signs)) & (signs[np.minimum(own, len(signs) - 1)] == sign if len(signs) else False)
        group_of = np.where(known, code * len(signs) + own, len(start) - 1)
        base = start[group_of]
        free = total - (cum[stop[group_of]] - cum[base])
        u = np.minimum(np.floor(t.column("u").to_numpy() / float(1 << 53) * free).astype(np.int64), free - 1)
        past = np.searchsorted(at, group_of * wide + np.searchsorted(steps, u, "right"), "left")
        u += cum[np.maximum(past, base)] - cum[base]
        some = t.set_column(t.column_names.index("u"), "u", pa.array(u)).filter(pa.array(free > 0))
        yield from some.select(["draw", "copy", "source", "sign", "u"]).to_batches(max_chunksize=100_000)


def _find_nodes(blocks: Iterator[tuple[int, int, pa.Table]]) -> Iterator[pa.RecordBatch]:
    """(draw, copy, source, target, sign) of places (tag 1) among the ranges of nodes (tag 0)."""
    held, nodes = [], None
    for _, tag, t in blocks:
        if not tag:
            held.append(t)
            continue
        if nodes is None:
            nodes = pa.concat_tables(held).combine_chunks().sort_by("lo")
            nodes, lo, held = nodes.column("node"), nodes.column("lo").to_numpy(), []
        target = nodes.take(pa.array(np.searchsorted(lo, t.column("u").to_numpy(), "right") - 1))
        yield from pa.table({"draw": t.column("draw"), "copy": t.column("copy"), "source": t.column("source"), "target": target, "sign": t.column("sign")}).to_batches(max_chunksize=100_000)


#: Edges of a source from which on its free places are found by all tasks.
DRAWN_HUB = 2_000_000


def sample_edges(edges: DataFrame, neg_samples: int = 1, weighted: bool = True, deemphasize_loops: bool = True,
                 seed: int = 0) -> DataFrame:
    """Edges for training: round(sum of weights) positives drawn with probability ~ weight, and
    ``neg_samples`` corrupted copies of each, their target drawn ~ vertex degree, such that
    (source, target, sign) is no existing edge. Columns: draw, copy (-1: positive), source, target, weight, sign.

    Negative targets are drawn from the complement at once: a draw among the degrees that are free for (source, sign) is moved past the
    ranges of its known targets. Copies of a source that is linked to every vertex have no negative and are left out.

    Edges, draws and copies cross the shuffles in packed blocks: edges by ranges of a hash, copies by source (with the places of the known targets),
    and by ranges of places. Sources with more than ``DRAWN_HUB`` edges are split by value in Spark's own tables.
    """
    e = cut_lineage(edges.select("source", "target", F.col("weight").cast("double").alias("weight"), F.col("sign").cast("int").alias("sign")))
    n = round(e.agg(F.sum("weight").alias("s")).first()["s"] or 0.0)
    spark = edges.sparkSession
    key = hash_key("source", "target", "sign", "weight", seed=seed)
    units = whole_weights(e, "weight", "units").where("units > 0").withColumn("key", key)
    bucket = F.shiftright("key", 64 - POSITION_BITS) + (1 << POSITION_BITS - 1)
    sums = units.groupBy(bucket.alias("b")).agg(F.sum("units").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    total, count = sum(r["s"] for r in sums), sum(r["n"] for r in sums)
    tasks = min(task_count(spark, count), 1 << POSITION_BITS)
    begin = np.zeros(tasks + 1, np.int64)
    for r in sums:
        begin[(r["b"] * tasks >> POSITION_BITS) + 1] += r["s"]
    begin = np.cumsum(begin)[:-1]
    draws = spark.range(n if total else 0).select(F.col("id").alias("draw"), _whole_draw(F.lit(total), "id", seed=seed + 1).alias("u"))
    filed = units.select(F.shiftright(bucket * tasks, POSITION_BITS).cast("int").alias("_task"), "key", "source", "target", "sign", "units")
    blocks = packed(filed, ["key"], 0, tally=True).unionByName(packed(draws, ["u"], 1, route=lambda t: np.searchsorted(begin, t.column("u").to_numpy(), "right") - 1))
    kind = e.schema["source"].dataType.simpleString()
    ends = f"source {kind}, target {e.schema['target'].dataType.simpleString()}, sign int"
    pos = cut_lineage(dealt(blocks, tasks, lambda blocks: _find_edges(blocks, begin), f"draw long, {ends}"))
    positive = pos.select("draw", F.lit(-1).alias("copy"), "source", "target", F.lit(1.0).alias("weight"), "sign")
    if not neg_samples or not total:
        return positive

    loop, w, zero = F.col("source") == F.col("target"), F.col("weight"), F.lit(0.0)
    inward, outward = (F.when(~loop, w).otherwise(zero),) * 2 if deemphasize_loops else (w, F.when(loop, zero).otherwise(w))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = F.array(F.struct(F.col("target").alias("node"), inward.alias("w"), none.alias("out")), F.struct(F.col("source").alias("node"), outward.alias("w"), one.alias("out")))
    deg = e.select(F.explode(both).alias("x")).groupBy("x.node").agg(F.sum("x.w").alias("w"), F.sum("x.out").alias("out"))
    degree = F.when(F.col("node").isNull(), zero).otherwise(F.coalesce("w", zero)) if weighted else F.lit(1.0)
    deg = cut_lineage(deg.select("node", degree.alias("degree"), "out"))
    hubs = [r["node"] for r in deg.where((F.col("out") > DRAWN_HUB) & F.col("node").isNotNull()).select("node").collect()]
    if not deg.agg(F.sum("degree").alias("s")).first()["s"]:
        deg = deg.withColumn("degree", F.lit(1.0))
    vertex = cut_lineage(running_sum(whole_weights(deg, "degree", "size").where("size > 0"), ["node"], "size", seed + 2).select("node", "size", "lo", "total"))
    stats = vertex.agg(F.max("total").alias("t"), F.count(F.lit(1)).alias("n")).first()
    by = ["source", "sign"]
    known = F.col("source").isNotNull() & F.col("sign").isNotNull()
    taken = e.where(known).select(*by, "target").join(vertex.select(F.col("node").alias("target"), "lo", "size"), "target").select(*by, "lo", "size")
    copies = pos.where(known).select("draw", *by, F.explode(F.sequence(F.lit(0), F.lit(neg_samples - 1))).alias("copy"))
    hub = F.col("source").isin(hubs) if hubs else F.lit(False)

    tasks = task_count(spark, count + n * neg_samples)
    task = F.pmod(hash_key(*by, seed=19), F.lit(tasks)).cast("int").alias("_task")
    left = packed(taken.where(~hub).select(task, *by, "lo", "size"), [*by, "lo"], 0, tally=True)
    right = packed(copies.where(~hub).select(task, "draw", "copy", *by, F.shiftrightunsigned(hash_key("draw", "copy", seed=seed + 3), 11).alias("u")), ["draw", "copy"], 1)
    placed = dealt(left.unionByName(right), tasks, lambda blocks: _free_places(blocks, stats["t"]), f"draw long, copy int, source {kind}, sign int, u long")
    if hubs:
        own = cut_lineage(taken.where(hub).distinct())
        held = own.groupBy(*by).agg(F.sum("size").alias("_held"))
        free = F.lit(stats["t"]) - F.coalesce("_held", F.lit(0))
        open_ = cut_lineage(copies.where(hub).join(held, by, "left").where(free > 0).select("draw", "copy", *by, _whole_draw(free, "draw", "copy", seed=seed + 3).alias("u")))
        placed = placed.unionByName(_past_taken(open_, own, by).select(*placed.columns))

    tasks = task_count(spark, n * neg_samples)
    cell = max(1, -(-stats["t"] // tasks))
    filed = vertex.select(F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(lo + size - 1) div {cell}"))).alias("_task"), "node", "lo")
    blocks = packed(filed.withColumn("_task", F.col("_task").cast("int")), ["lo"], 0).unionByName(packed(placed.withColumn("_task", F.expr(f"u div {cell}").cast("int")), ["source", "draw"], 1))
    drawn = dealt(blocks, tasks, _find_nodes, f"draw long, copy int, source {kind}, target {vertex.schema['node'].dataType.simpleString()}, sign int")
    return positive.unionByName(drawn.select("draw", "copy", "source", "target", F.lit(0.0).alias("weight"), "sign"))


def validate_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row of counts: edges with an unknown vertex, a weight outside (0, 1], a bad sign."""
    v = vertices.select("node").distinct().withColumn("_known", F.lit(True))
    j = edges.join(v.withColumnsRenamed({"node": "source", "_known": "_ks"}), "source", "left").join(
        v.withColumnsRenamed({"node": "target", "_known": "_kt"}), "target", "left")
    w, s = F.col("weight"), F.col("sign")
    return j.agg(F.count_if(F.col("_ks").isNull() | F.col("_kt").isNull()).alias("missing_vertices"),
                 F.count_if(w.isNull() | F.isnan(w.cast("double")) | (w <= 0) | (w > 1)).alias("invalid_weights"),
                 F.count_if(s.isNull() | ~s.isin(-1, 1)).alias("invalid_signs"), F.count(F.lit(1)).alias("n_edges"))


#: Targets of one packed row; bytes of a packed row that is not compressed; rows of a source from which on it is dealt out to several tasks; paths of a
#: task, and paths added up at once, about.
PACKED, SHORT, HUB_ROWS, TASK_PATHS, PATHS_AT_ONCE = 512, 256, 20_000, 4_000_000, 100_000


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of targets and weights as bytes, from rows (_mid, target, _w) in the order of _mid: the weights, the lengths of the names (-1: null), the names,
    each padded to 8 bytes. Long lists are compressed, short ones stand behind a zero. A list has up to ``PACKED`` rows."""
    held = None

    def lists(t: pa.Table, runs: np.ndarray) -> pa.RecordBatch:
        size = np.diff(np.append(runs, len(t)))
        parts = -(-size // PACKED)
        ends = np.append(np.repeat(runs, parts) + PACKED * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)), len(t))
        flat = t.column("target").combine_chunks()
        names = pc.fill_null(pc.binary_length(flat), -1).to_numpy().astype("<i4")
        text, at = memoryview(flat.buffers()[2] or b""), np.frombuffer(flat.buffers()[1], "<i4")[flat.offset:flat.offset + len(flat) + 1].tolist()
        w, names = memoryview(t.column("_w").to_numpy().astype("<f8").tobytes()), memoryview(names.tobytes())
        cuts = ends.tolist()
        raw = [b"".join((w[8 * x:8 * y], names[4 * x:4 * y], bytes(4 * ((y - x) % 2)), text[at[x]:at[y]], bytes((at[x] - at[y]) % 8))) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        out = [zlib.compress(x, 6) if len(x) > SHORT else b"\0" + x for x in raw]
        return pa.RecordBatch.from_arrays([t.column("_mid").take(pa.array(ends[:-1])).combine_chunks(), pa.array(np.diff(ends), pa.int32()), pa.array(out, pa.binary())], names=["_mid", "_n", "_body"])

    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
        if not len(t):
            continue
        mid = t.column("_mid").combine_chunks().dictionary_encode()
        runs = np.append(0, np.flatnonzero(np.diff(mid.indices.to_numpy())) + 1)
        open_ = int(runs[-1]) + (len(t) - int(runs[-1])) // (64 * PACKED) * (64 * PACKED)  # the last list may go on
        if open_:
            yield lists(t.slice(0, open_), runs[runs < open_])
        held = t.slice(open_)
    if held is not None and len(held):
        yield lists(held, np.zeros(1, np.int64))


def _unpack(bodies: list[bytes], n: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The targets and weights of some packed rows, one after another."""
    raw = [zlib.decompress(x) if x[0] else x[1:] for x in bodies]
    start = np.cumsum([0, *map(len, raw)])[:-1]
    data = b"".join(raw)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    w = np.frombuffer(data, "<f8")[np.repeat(start // 8, n) + within]
    size = np.frombuffer(data, "<i4")[np.repeat(start // 4 + 2 * n, n) + within]
    kept = np.maximum(size, 0)
    head = (8 * n + 4 * (n + n % 2)).tolist()
    total = np.add.reduceat(kept, np.cumsum(n) - n).tolist()
    text = b"".join([r[a:a + z] for r, a, z in zip(raw, head, total, strict=True)])
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(kept, out=offsets[1:])
    valid = None if (size >= 0).all() else pa.py_buffer(np.packbits(size >= 0, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(text), valid), w


def _add_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, target, weight) from rows (source, _wa, _n, _body) in the order of their sources; a source is held until its last row."""
    names, codes, held, size, kind = [], {}, [], 0, None

    def summed() -> pa.Table:
        t = pa.concat_tables(held).group_by(["code", "target"], use_threads=False).aggregate([("w", "sum")])
        return t.select(["code", "target", "w_sum"]).rename_columns(["code", "target", "w"])

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        source = pa.array(names, kind).take(t.column("code").combine_chunks())
        yield from pa.table({"source": source, "target": t.column("target"), "weight": t.column("w")}).to_batches(max_chunksize=100_000)

    for batch in batches:
        kind = batch.schema.field("source").type
        n = batch.column("_n").to_numpy().astype(np.int64)
        upto, at = np.cumsum(n), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PATHS_AT_ONCE, "right")))
            some = batch.slice(at, to - at)
            own = some.column("source").dictionary_encode("encode")
            for v in own.dictionary.to_pylist():
                if v not in codes:
                    codes[v] = len(names)
                    names.append(v)
            number = np.array([codes[v] for v in own.dictionary.to_pylist()], np.int32)[own.indices.to_numpy()]
            target, w = _unpack(some.column("_body").to_pylist(), n[at:to])
            w = w * np.repeat(some.column("_wa").to_numpy(zero_copy_only=False), n[at:to])
            held.append(pa.table({"code": np.repeat(number, n[at:to]), "target": target, "w": w}))
            size, at = size + len(w), to
            if size >= PATHS_AT_ONCE:
                t = summed()
                open_ = pc.equal(t.column("code"), int(number[-1]))
                yield from out(t.filter(pc.invert(open_)))
                last, t = names[number[-1]], t.filter(open_)
                names, codes = [last], {last: 0}
                held, size = [t.set_column(0, "code", pa.array(np.zeros(len(t), np.int32)))], 0
    if held:
        yield from out(summed())


def edge_product(a: DataFrame, b: DataFrame, weight: str | None = None, binarize: bool = False) -> DataFrame:
    """(source, target, weight): paths a -> b through the shared middle node, with parallel edges
    counted. Both sides are summed per pair first and the middle key is salted.

    The targets of a middle node travel as packed rows of up to about ``PACKED``, once for each of its sources, to the task of the source, and are
    taken apart and added up there: no path is a row of a shuffle. A source with many rows goes to several tasks, whose sums are added up.
    """
    unit = F.col(weight).cast("double") if weight else F.lit(1.0)
    weigh = F.sum(unit).alias("_w")
    left = cut_lineage(a.where(F.col("target").isNotNull()).groupBy("source", F.col("target").alias("_mid")).agg(weigh).where("_w IS NOT NULL"))
    right = b.where(F.col("source").isNotNull()).groupBy(F.col("source").alias("_mid"), F.col("target").cast("string").alias("target")).agg(weigh).where("_w IS NOT NULL")
    mid, source = (a.schema[c].dataType.simpleString() for c in ("target", "source"))
    lists = right.withColumn("_mid", F.col("_mid").cast(mid)).where("_mid IS NOT NULL").repartition("_mid").sortWithinPartitions("_mid", "target")
    packs = cut_lineage(lists.mapInArrow(_pack, f"_mid {mid}, _n int, _body binary"))
    sizes = packs.groupBy("_mid").agg(F.sum("_n").alias("_n"))
    paths = left.groupBy("_mid").agg(F.count(F.lit(1)).alias("_c")).join(sizes, "_mid").agg(F.sum(F.col("_c") * F.col("_n"))).first()[0] or 0
    tasks = max(a.sparkSession.sparkContext.defaultParallelism, -(-paths // TASK_PATHS))
    hubs = left.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("_share")).where("_share > 1").withColumnRenamed("source", "_hub")
    same = F.col("source").eqNullSafe(F.col("_hub"))

    def added(rows: DataFrame, by: list[Column]) -> DataFrame:
        dealt = salted_join(rows, packs, ["_mid"], ["source"]).repartition(tasks, *by).sortWithinPartitions("source")
        return dealt.select("source", F.col("_w").alias("_wa"), "_n", "_body").mapInArrow(_add_paths, f"source {source}, target string, weight double")

    if hubs.isEmpty():
        total = added(left, [F.col("source")])
    else:
        shared = added(left.join(hubs, same), [F.col("source"), F.pmod(hash_key("_mid", seed=6), F.col("_share"))])
        total = added(left.join(hubs, same, "left_anti"), [F.col("source")]).unionByName(shared.groupBy("source", "target").agg(F.sum("weight").alias("weight")))
    if binarize:
        total = total.withColumn("weight", F.least("weight", F.lit(1.0)))
    return total.where(F.col("weight") != 0).withColumn("target", F.col("target").cast(b.schema["target"].dataType))


def convert_features(matrix: DataFrame, edges: DataFrame) -> DataFrame:
    """MATRIX times signed graph: value * weight * sign summed per (cell, target). Parallel edges
    are summed first, weights and signs apart, as two adjacency matrices would be."""
    coef = edges.groupBy(F.col("source").alias("feature"), "target").agg((F.sum("weight") * F.sum("sign")).alias("_w"))
    joined = salted_join(matrix.select("cell", "feature", "value"), coef, ["feature"], ["cell"])
    return joined.groupBy("cell", F.col("target").alias("feature")).agg(F.sum(F.col("value") * F.col("_w")).alias("value"))


def match_graph(pairs: DataFrame, features_a: DataFrame, features_b: DataFrame) -> DataFrame:
    """Guidance graph of matched (key, value) pairs: key -> value is ``rev``, value -> key ``fwd``."""
    unit = [F.lit(1.0).alias("weight"), F.lit(1).alias("sign")]
    rev = pairs.select(F.col("key").alias("source"), F.col("value").alias("target"), *unit, F.lit("rev").alias("type"))
    fwd = pairs.select(F.col("value").alias("source"), F.col("key").alias("target"), *unit, F.lit("fwd").alias("type"))
    both = features_a.select("feature").unionByName(features_b.select("feature"))
    return add_loops(rev.unionByName(fwd), both)


def suffix_edges(features: DataFrame, suffixes: Sequence[str], sign: int = -1) -> DataFrame:
    """Edge from a feature to its suffixed version; a feature with none of the suffixes is an error."""
    base, known = F.lit(None).cast("string"), F.lit(False)
    for s in reversed(suffixes):
        base = F.when(F.col("feature").endswith(s), F.expr(f"left(feature, length(feature) - {len(s)})")).otherwise(base)
        known = known | F.col("feature").endswith(s)
    source = F.when(known, base).otherwise(F.raise_error(F.lit("unexpected feature name")).cast("string"))
    return features.select(source.alias("source"), F.col("feature").alias("target"), F.lit(1.0).alias("weight"), F.lit(sign).alias("sign"))


def evidence_graph(graphs: Sequence[DataFrame], anchors: DataFrame, features: DataFrame) -> DataFrame:
    """Composed evidence graphs, mirrored, looped, restricted to what the anchors reach."""
    g = compose(*graphs)
    hit = reachable(g, anchors.select(F.col("feature").alias("node")))
    both = g.withColumn("sign", F.lit(1)).unionByName(reverse(g).withColumn("sign", F.lit(1)))
    return subgraph(add_loops(both, features), hit)


def edge_intersection(*edges: DataFrame) -> DataFrame:
    """(source, target) pairs present in every edge set."""
    out = edges[0].select("source", "target").distinct()
    for e in edges[1:]:
        out = out.join(e.select("source", "target"), ["source", "target"], "left_semi")
    return out


def drop_edges(edges: DataFrame, pairs: DataFrame, keep_types: Sequence[str] | None = None) -> DataFrame:
    """Remove the listed pairs in both orientations; edges of ``keep_types`` are left alone."""
    lo, hi = F.least("source", "target").alias("_lo"), F.greatest("source", "target").alias("_hi")
    bad = pairs.select(lo, hi).distinct()
    keyed = edges.select("*", lo, hi)
    if keep_types is None:
        return keyed.join(bad, ["_lo", "_hi"], "left_anti").select(*edges.columns)
    kept = F.coalesce(F.col("type").isin(list(keep_types)), F.lit(False))
    bad = bad.withColumn("_bad", F.lit(True))
    return keyed.join(bad, ["_lo", "_hi"], "left").where(kept | F.col("_bad").isNull()).select(*edges.columns)


def corrupt_edges(edges: DataFrame, rate: float, sources: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Replace round(rate * E) random edges by random pairs that are no edges; each new edge
    takes over the attributes of the one it replaces.

    Pairs come from the complement: a source is drawn by its number of free targets, then one of these by rank, moved past the known ones.
    Without a free pair it raises.
    """
    attrs = [c for c in edges.columns if c not in ("source", "target")]
    keyed = cut_lineage(positions(edges, [], edges.columns, seed))
    n_bad = round(rate * keyed.count())
    if n_bad == 0:
        return edges
    kept = keyed.where(F.col("pos") >= n_bad).select(*edges.columns)
    src = cut_lineage(sources.select(F.col("node").alias("source")).distinct())
    tgt = cut_lineage(positions(targets.select("node").distinct(), [], ["node"], seed + 2).select(F.col("pos").alias("lo"), F.col("node").alias("target")))
    taken = cut_lineage(edges.select("source", "target").distinct().join(src, "source", "left_semi").join(tgt, "target").select("source", "lo", F.lit(1).cast("long").alias("size")))
    nt = tgt.count()
    held = taken.groupBy("source").agg(F.count(F.lit(1)).alias("_held"))
    free = cut_lineage(src.join(held, "source", "left").select("source", (nt - F.coalesce("_held", F.lit(0))).cast("long").alias("free")).where("free > 0"))
    total, n = free.agg(F.sum("free"), F.count(F.lit(1))).first()
    if not n:
        raise RuntimeError("every pair is an edge")
    draws = keyed.where(F.col("pos") < n_bad).select("pos", *attrs, _whole_draw(F.lit(total), "pos", seed=seed + 3).alias("u"))
    ranges = running_sum(free, ["source"], "free", seed + 4).select("source", "free", F.col("lo"))
    drawn = cut_lineage(_draw(draws, ranges, "free", total, n).select("pos", "source", *attrs, (F.col("u") - F.col("lo")).cast("long").alias("u")))
    placed = _past_taken(drawn, taken, ["source"]).join(tgt, F.col("u") == F.col("lo"))
    return kept.unionByName(placed.select(*edges.columns))
