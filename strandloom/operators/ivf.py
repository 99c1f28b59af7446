"""A two-level inverted file for nearest neighbours, with a stopping rule by distance bounds.

Level one has about the square root of the number of lists as K-means cells; each cell is cut into lists of about ``LIST_ROWS`` rows by
centres of its own, fitted in parallel on a bounded sample of the cell. Centres of level one go with the code (they grow with the square
root of the table, fourfold bounded per cell below); those of level two are rows that meet the rows of their cell in its tasks.

A query first looks into its nearest lists until they hold k rows, which gives an upper bound u on its k-th distance. Then it looks into
every list whose lower bound is at most ``reach`` times u. The bounds (distance to the plane half-way to a cell's centre, at both levels,
and to the ball around a list) hold for every row, so with ``reach`` = 1 no neighbour is missed. ``reach`` is fitted: for a bounded
sample of rows with exactly known neighbours, it is the share of u below which ``target`` of the neighbours' lists lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.blocks import PAIRS_AT_ONCE, Table, fast_squares, pair_squares, spool, squared_distances, task_count
from strandloom.functions.runtime import cut_lineage, hash_key, hash_uniform

#: Rows of a list; sampled rows per centre; Lloyd rounds of a cell; rows of a task that deals out rows of one cell.
LIST_ROWS, PER_CENTRE, LLOYD, TASK_ROWS = 128, 32, 8, 200_000
#: Queries of a cell searched at once; candidates held before they are cut to the nearest.
QUERIES, HELD = 2048, 1_000_000
FOUND = pa.schema([("query", pa.string()), ("ref", pa.string()), ("dist", pa.float64())])


def _reps(batch: pa.RecordBatch, name: str = "rep") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x, dtype=float).ravel()))


def _half_way(d: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Lower bounds of the distance to each centre's cell, from squared distances to the centres: how far the plane to the nearest centre is."""
    near = d.argmin(axis=1)
    gap = np.sqrt(squared_distances(centres, centres))[near]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (d - d[np.arange(len(d)), near][:, None]) / (2 * gap)
    return np.where(gap > 0, np.maximum(out, 0.0), 0.0)


def _split(pdf: pd.DataFrame) -> pd.DataFrame:
    """Centres of one cell's lists by Lloyd's rounds on its sample."""
    x = np.stack(pdf["rep"].to_numpy()).astype(float)
    order = np.argsort(pdf["id"].to_numpy())
    x, k = x[order], int(pdf["lists"].iloc[0])
    centres = np.unique(x[:k], axis=0)
    for _ in range(LLOYD if len(centres) > 1 else 0):
        near = squared_distances(x, centres).argmin(axis=1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return pd.DataFrame({"top": int(pdf["top"].iloc[0]), "sub": np.arange(len(centres), dtype=np.int32), "centre": list(centres)})


class _Lists:
    """The lists of a file in one task: a head (centre and radius) before the rows of each."""

    def __init__(self, table: Table, tops: np.ndarray) -> None:
        self.table, self.tops = table, tops
        name = table.aux.to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        self.begin, self.end, self.radius = start + 1, np.append(start[1:], len(name)), table.num[start]
        top = np.array([int(n.split(":")[0]) for n in name[start]])
        self.of = [np.flatnonzero(top == c) for c in range(len(tops))]
        self.centre, self.size = np.array(table.x[start]), self.end - self.begin
        self.held = np.array([self.size[f].sum() for f in self.of])
        self.rank = np.empty(table.n, np.int64)
        order = pc.sort_indices(table.ids, null_placement="at_start").to_numpy()
        self.rank[order] = np.arange(table.n)
        known = pc.dictionary_encode(table.ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        self.code = known

    def near_order(self, x: np.ndarray) -> np.ndarray:
        near = np.concatenate([squared_distances(x[at:at + QUERIES], self.tops).argmin(axis=1) for at in range(0, len(x), QUERIES)])
        return np.argsort(near, kind="stable")

    def search(self, q: np.ndarray, times: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, place in the table, squared distance), k per row. ``times``: how often a query's ID is there, 0 for none, which sees its first lists only."""
        dt = squared_distances(q, self.tops)
        best = _Best(self, q, k)
        near = np.argsort(dt, axis=1, kind="stable")
        before = np.cumsum(self.held[near], axis=1) - self.held[near]
        want = np.zeros(dt.shape)
        np.put_along_axis(want, near, np.where((before < k) & (self.held[near] > 0), k - before, 0), axis=1)
        seen: dict[int, np.ndarray] = {}
        for c in np.flatnonzero((want > 0).any(axis=0)):
            rows = np.flatnonzero(want[:, c] > 0)
            by = np.argsort(squared_distances(q[rows], self.centre[self.of[c]]), axis=1, kind="stable")
            size = self.size[self.of[c]][by]
            row, col = np.nonzero(np.cumsum(size, axis=1) - size < want[rows, c][:, None])
            which = self.of[c][by[row, col]]
            for f in np.unique(which):
                seen[f] = rows[row[which == f]]
                best.measure(seen[f], f)
        best.cut()
        last = best.kth(times)
        bound = _half_way(dt, self.tops)
        for c in np.flatnonzero((bound <= reach * last[:, None]).any(axis=0) & (self.held > 0)):
            rows = np.flatnonzero(bound[:, c] <= reach * last)
            d = squared_distances(q[rows], self.centre[self.of[c]])
            ok = np.maximum(np.maximum(_half_way(d, self.centre[self.of[c]]), np.sqrt(d) - self.radius[self.of[c]]), bound[rows, c][:, None]) <= reach * last[rows][:, None]
            for j in np.flatnonzero(ok.any(axis=0)):
                f = self.of[c][j]
                best.measure(np.setdiff1d(rows[ok[:, j]], seen[f], assume_unique=True) if f in seen else rows[ok[:, j]], f)
        best.cut()
        return best.rows, best.place, best.dist


class _Best:
    """The k nearest rows of each query so far; in a list, and among the lists, ties go by ID."""

    def __init__(self, lists: _Lists, q: np.ndarray, k: int) -> None:
        self.lists, self.q, self.k = lists, q, k
        self.reach = np.full(len(q), np.inf)
        self.rows, self.place, self.dist = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        self.new: list = []
        self.n_new = 0

    def measure(self, rows: np.ndarray, f: int) -> None:
        """The rows of list ``f`` that may be among the nearest of some queries: k of them for each at most."""
        begin, end = self.lists.begin[f], self.lists.end[f]
        for at in range(0, len(rows) if end > begin else 0, max(1, 4 * PAIRS_AT_ONCE // max(1, end - begin))):
            some = rows[at:at + max(1, 4 * PAIRS_AT_ONCE // (end - begin))]
            x = np.array(self.lists.table.x[begin:end])
            d, error = fast_squares(self.q[some], x)
            within = self.reach[some][:, None]
            if d.shape[1] > self.k:
                within = np.minimum(within, np.partition(d + error, self.k - 1, axis=1)[:, self.k - 1:self.k])
            flat = np.flatnonzero(d - error <= within)
            if not len(flat):
                continue
            row, col = np.divmod(flat, d.shape[1])
            exact = pair_squares(self.q[some], x, row, col)
            order = np.lexsort((self.lists.rank[begin + col], exact, row))
            row, col, exact = row[order], col[order], exact[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < self.k
            self.new.append((some[row[keep]], begin + col[keep], exact[keep]))
            self.n_new += int(keep.sum())
        if self.n_new > HELD:
            self.cut()

    def cut(self) -> None:
        """Keep the k nearest of each query; equal rows under one ID count once."""
        rows, place, dist = (np.concatenate(v) for v in zip((self.rows, self.place, self.dist), *self.new))
        order = np.lexsort((self.lists.rank[place], dist, rows))
        rows, place, dist = rows[order], place[order], dist[order]
        code = self.lists.code[place]
        first = np.append(True, (rows[1:] != rows[:-1]) | (dist[1:] != dist[:-1]) | (code[1:] != code[:-1])) if len(rows) else np.zeros(0, bool)
        rows, place, dist = rows[first], place[first], dist[first]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < self.k
        self.rows, self.place, self.dist, self.new, self.n_new = rows[keep], place[keep], dist[keep], [], 0
        full = rank[keep] == self.k - 1
        self.reach[self.rows[full]] = self.dist[full]

    def kth(self, times: np.ndarray) -> np.ndarray:
        """Distance of each query's k-th row, or of its last; of one of fewer for an ID that is there more than once, none (-1) without one."""
        rank = np.arange(len(self.rows)) - np.searchsorted(self.rows, self.rows)
        out = np.full(len(self.q), -1.0)
        at = rank < -(-self.k // np.maximum(times, 1))[self.rows]
        np.maximum.at(out, self.rows[at], np.sqrt(self.dist[at]))
        return np.where(times > 0, out, -1.0)


class InvertedFile:
    """Index over ``ref`` (id, rep)."""

    def __init__(self, ref: DataFrame, seed: int = 0, list_rows: int = LIST_ROWS) -> None:
        self.n = ref.count()
        spark = ref.sparkSession
        self.seed, cells = seed, int(np.ceil(np.sqrt(max(1.0, self.n / list_rows))))
        some = ref.where(hash_uniform("id", seed=seed + 21) < min(1.0, 64.0 * cells / max(self.n, 1)))
        model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="v", predictionCol="c").fit(some.select(array_to_vector("rep").alias("v")) if cells > 1 else ref.select(array_to_vector("rep").alias("v")))
        self.tops = np.array(model.clusterCenters())
        tops = self.tops

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rep"), pa.array(squared_distances(_reps(b), tops).argmin(axis=1), pa.int32())], names=["id", "rep", "top"])

        rows = cut_lineage(ref.select("id", "rep").mapInArrow(nearest, "id string, rep array<double>, top int"))
        held = rows.groupBy("top").agg(F.count(F.lit(1)).alias("rows")).withColumn("lists", F.least(F.ceil(F.col("rows") / list_rows), F.lit(4 * cells)).cast("int"))
        self.held = {r["top"]: r["rows"] for r in held.collect()}
        sample = rows.join(held, "top").where(hash_uniform("id", seed=seed + 22) < PER_CENTRE * F.col("lists") / F.col("rows"))
        # a cell whose sample came out empty keeps its smallest row as the only centre
        spare = rows.groupBy("top").agg(F.min_by("rep", "id").alias("rep"), F.min("id").alias("id")).join(held, "top")
        sample = sample.select("top", "id", "rep", "lists").unionByName(spare.select("top", "id", "rep", "lists"))
        centres = cut_lineage(sample.groupBy("top").applyInPandas(_split, "top int, sub int, centre array<double>"))

        def deal(some: pa.RecordBatch, c: np.ndarray, subs: np.ndarray, extra: list) -> pa.RecordBatch | None:
            d = squared_distances(_reps(some), c)
            near = d.argmin(axis=1)
            return pa.RecordBatch.from_arrays([some.column("id"), some.column("rep"), some.column("top"), pa.array(subs[near], pa.int32()), pa.array(np.sqrt(d[np.arange(len(near)), near]))],
                                              names=["id", "rep", "top", "sub", "off"])

        self.rows = cut_lineage(self._meet(rows, centres.withColumns({"rows": F.lit(0).cast("long"), "radius": F.lit(0.0)}), deal, "id string, rep array<double>, top int, sub int, off double"))
        size = self.rows.groupBy("top", "sub").agg(F.count(F.lit(1)).alias("rows"), F.max("off").alias("radius"))
        self.centres = cut_lineage(centres.join(size, ["top", "sub"]))
        self.spark = spark

    def _meet(self, rows: DataFrame, centres: DataFrame, fn, schema: str) -> DataFrame:
        """``fn`` on batches of rows of one cell, with the cell's centres. A cell with many rows is spread over tasks, to which its centres are copied."""
        sizes = cut_lineage(rows.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias("parts")))
        c = centres.join(sizes, "top").select("top", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("tag"), "sub", F.col("centre").alias("rep"), "rows", "radius")
        r = rows.join(sizes, "top").withColumns({"part": F.pmod(hash_key("id", seed=23), "parts").cast("int"), "tag": F.lit(1)}).drop("parts")
        both = c.unionByName(r, allowMissingColumns=True).repartition(task_count(rows.sparkSession), "top", "part").sortWithinPartitions("top", "part", "tag", "sub")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, found, known = None, [], None
            for b in batches:
                if not b.num_rows:
                    continue
                where = np.stack([b.column(x).to_numpy() for x in ("top", "part", "tag")], axis=1)
                edges = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1, [len(where)]])
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    some = b.slice(lo, hi - lo)
                    if (where[lo, 0], where[lo, 1]) != key:
                        key, found, known = (where[lo, 0], where[lo, 1]), [], None
                    if where[lo, 2] == 0:
                        found.append((_reps(some), *(some.column(x).to_numpy(zero_copy_only=False) for x in ("sub", "rows", "radius"))))
                    else:
                        known = known or [np.concatenate(x) for x in zip(*found)]
                        out = fn(some, known[0], known[1], known[2:])
                        if out is not None:
                            yield out

        return both.mapInArrow(run, schema)

    def first_lists(self, queries: DataFrame, k: int) -> DataFrame:
        """(id, rep, top, sub): the nearest lists of each query that hold k rows."""
        tops, held = self.tops, np.array([self.held.get(i, 0) for i in range(len(self.tops))])

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                near = np.argsort(squared_distances(_reps(b), tops), axis=1, kind="stable")
                before = np.cumsum(held[near], axis=1) - held[near]
                row, col = np.nonzero((before < k) & (held[near] > 0))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("rep").take(pa.array(row)), pa.array(near[row, col], pa.int32()), pa.array(k - before[row, col], pa.int64())], names=["id", "rep", "top", "want"])

        def lists(some: pa.RecordBatch, c: np.ndarray, subs: np.ndarray, extra: list) -> pa.RecordBatch:
            near = np.argsort(squared_distances(_reps(some), c), axis=1, kind="stable")
            size = extra[0].astype(np.int64)[near]
            row, col = np.nonzero(np.cumsum(size, axis=1) - size < some.column("want").to_numpy()[:, None])
            take = pa.array(row)
            return pa.RecordBatch.from_arrays([some.column("id").take(take), some.column("rep").take(take), some.column("top").take(take), pa.array(subs[near[row, col]], pa.int32())], names=["id", "rep", "top", "sub"])

        pairs = queries.select("id", "rep").mapInArrow(cells, "id string, rep array<double>, top int, want long")
        return self._meet(cut_lineage(pairs), self.centres, lists, "id string, rep array<double>, top int, sub int")

    def lists_within(self, queries: DataFrame, reach: float) -> DataFrame:
        """(id, rep, top, sub, bound): lists whose lower bound is at most ``reach`` times the query's u."""
        tops = self.tops

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                bound = _half_way(squared_distances(_reps(b), tops), tops)
                u = b.column("u").to_numpy()
                row, col = np.nonzero(bound <= reach * u[:, None])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("rep").take(take), pa.array(col, pa.int32()), pa.array(bound[row, col]), pa.array(u[row])], names=["id", "rep", "top", "bound", "u"])

        def lists(some: pa.RecordBatch, c: np.ndarray, subs: np.ndarray, extra: list) -> pa.RecordBatch:
            d = squared_distances(_reps(some), c)
            bound = np.maximum(np.maximum(_half_way(d, c), np.sqrt(d) - extra[1]), some.column("bound").to_numpy()[:, None])
            row, col = np.nonzero(bound <= reach * some.column("u").to_numpy()[:, None])
            take = pa.array(row)
            return pa.RecordBatch.from_arrays([some.column("id").take(take), some.column("rep").take(take), some.column("top").take(take), pa.array(subs[col], pa.int32()), pa.array(bound[row, col])], names=["id", "rep", "top", "sub", "bound"])

        pairs = queries.select("id", "rep", "u").mapInArrow(cells, "id string, rep array<double>, top int, bound double, u double")
        return self._meet(cut_lineage(pairs), self.centres, lists, "id string, rep array<double>, top int, sub int, bound double")

    def search(self, queries: DataFrame, k: int, reach: float) -> DataFrame:
        """(query, ref, dist): for each query (id, rep) the k nearest rows of its nearest lists and of those within ``reach`` of their k-th.

        The lists lie in a temporary file of each task, in order, so a row is sent once per core and no query is copied.
        """
        radius = self.centres.select("top", "sub", "radius", "centre")
        rows = self.rows.select("id", "rep", F.concat_ws(":", "top", "sub").alias("aux"), F.lit(0.0).alias("num"), F.format_string("%010d %010d 1", "top", "sub").alias("ord"))
        heads = radius.select(F.lit(None).cast("string").alias("id"), F.col("centre").alias("rep"), F.concat_ws(":", "top", "sub").alias("aux"), F.col("radius").alias("num"),
                              F.format_string("%010d %010d 0", "top", "sub").alias("ord"))
        tops = self.tops

        def fold(table: Table, left: pa.RecordBatch, x: np.ndarray) -> Iterator[dict]:
            lists = _Lists(table, tops)
            ids = left.column("id")
            copies = pc.value_counts(ids).to_pylist()
            many = {c["values"]: c["counts"] for c in copies}
            times = np.array([many[i] if i is not None else 0 for i in ids.to_pylist()])
            order = np.argsort(squared_distances(x, tops).argmin(axis=1), kind="stable") if len(x) <= QUERIES else lists.near_order(x)
            for at in range(0, len(x), QUERIES):
                some = order[at:at + QUERIES]
                row, place, dist = lists.search(x[some], times[some], k, reach)
                yield {"query": ids.take(pa.array(some[row])), "ref": table.ids.take(pa.array(place)), "dist": np.sqrt(dist)}

        return spool(queries.select("id", "rep"), heads.unionByName(rows), fold, "query string, ref string, dist double", FOUND, order="ord")

    def fit_reach(self, bounds: DataFrame, neighbours: DataFrame, target: float) -> float:
        """From sampled queries (id, rep, u) and their exact neighbours (query, ref): the share of u that covers ``target`` of the neighbours' lists."""
        held = self.rows.select(F.col("id").alias("ref"), "top", "sub")
        wanted = neighbours.join(held, "ref").select(F.col("query").alias("id"), "top", "sub", "ref")
        ratio = wanted.join(self.lists_within(bounds, 1.0 + 1e-9).drop("rep"), ["id", "top", "sub"]).join(bounds.select("id", "u"), "id").select(
            F.when(F.col("u") > 0, F.col("bound") / F.col("u")).otherwise(0.0).alias("r"))
        got = ratio.agg(F.percentile("r", target).alias("q")).first()["q"]
        return 1.0 if got is None else min(1.0, float(got) + 1e-9)
