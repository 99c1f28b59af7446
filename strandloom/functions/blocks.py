"""Streaming of one table past small blocks of another, for distance work.

Left rows are cut into tiles of up to ``TILE`` rows. Right rows are sent to every tile that needs
them, cut into slices of bounded size, so a row is copied once per tile or slice of the other side.
Inside a task the rows of one (tile, slice) arrive in Arrow batches, left rows first; a kernel folds
the right rows into per-left-row results, ``LEFT_BLOCK`` by ``RIGHT_BLOCK`` pairs at once, so memory
stays at a tile and a block of distances, and pairs are never written out.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.runtime import hash_key

TILE = 50_000
#: Groups whose tiles are dealt out in turn; tiles of more groups start at a hash.
DEALT_GROUPS = 10_000
LEFT_BLOCK = 1024
RIGHT_BLOCK = 4096
RIGHT_SLICE = 262_144


class Kernel:
    """Folds right rows into results for one block of left rows."""

    def left(self, ids: list, x: np.ndarray, aux: list, num: np.ndarray) -> None:
        raise NotImplementedError

    def right(self, ids: list, x: np.ndarray, aux: list, num: np.ndarray) -> None:
        raise NotImplementedError

    def finish(self) -> dict[str, Any] | None:
        raise NotImplementedError


def left_blocks(n: int) -> Iterator[slice]:
    for at in range(0, n, LEFT_BLOCK):
        yield slice(at, min(n, at + LEFT_BLOCK))


#: Pairs whose coordinates are gathered at once to measure them anew.
PAIRS_AT_ONCE = 1 << 16
#: A squared distance below this share of its vectors' squared norms has lost digits in the product form.
CLOSE = 1e-4


def pair_squares(q: np.ndarray, r: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sums of squared differences of the given pairs, coordinate by coordinate, so that a pair gives the same number wherever it is measured."""
    out = np.zeros(len(rows))
    for at in range(0, len(rows), PAIRS_AT_ONCE):
        some = slice(at, at + PAIRS_AT_ONCE)
        diff = q[rows[some]] - r[cols[some]]
        for x in (diff * diff).T:
            out[some] += x
    return out


def pair_products(q: np.ndarray, r: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of the given pairs, coordinate by coordinate."""
    out = np.zeros(len(rows))
    for at in range(0, len(rows), PAIRS_AT_ONCE):
        some = slice(at, at + PAIRS_AT_ONCE)
        for x in (q[rows[some]] * r[cols[some]]).T:
            out[some] += x
    return out


def fast_squares(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances in product form and, pair by pair, a bound on their error. Vectors are taken from the median of ``q`` first."""
    centre = np.median(q, axis=0) if len(q) else 0.0
    a, b = q - centre, r - centre
    size = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    d2 = a @ b.T
    d2 *= -2.0
    d2 += size
    size *= 2 * (q.shape[1] + 8) * np.finfo(float).eps
    return d2, size


def fast_products(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products and, pair by pair, a bound on their error."""
    size = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((r * r).sum(axis=1))[None, :]
    return q @ r.T, size * (2 * (q.shape[1] + 8) * np.finfo(float).eps)


def squared_distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Matrix of squared Euclidean distances; those of close pairs are measured anew, so that each has nearly all its digits."""
    d2, error = fast_squares(q, r)
    error *= CLOSE / (2 * (q.shape[1] + 8) * np.finfo(float).eps)
    rows, cols = np.divmod(np.flatnonzero(d2 < error), max(1, len(r)))
    d2[rows, cols] = pair_squares(q, r, rows, cols)
    return np.maximum(d2, 0.0, out=d2)


def _runner(make: Callable[[], Kernel], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kernel = None, None

        def result(k: Kernel) -> Iterator[pa.RecordBatch]:
            out = k.finish()
            if out is not None and len(next(iter(out.values()))):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            group = np.asarray(batch.column("grp").to_pylist(), dtype=object)
            ids3 = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("blk", "slc", "tag")], axis=1)
            differs = (ids3[1:] != ids3[:-1]).any(axis=1) | (group[1:] != group[:-1])
            edges = np.concatenate([[0], np.flatnonzero(differs) + 1, [batch.num_rows]])
            for lo, hi in zip(edges[:-1], edges[1:]):
                part = batch.slice(lo, hi - lo)
                k = (group[lo], int(ids3[lo, 0]), int(ids3[lo, 1]))
                if k != key:
                    if kernel is not None:
                        yield from result(kernel)
                    key, kernel = k, make()
                x = part.column("rep").flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                args = (part.column("id").to_pylist(), x, part.column("aux").to_pylist(),
                        part.column("num").to_numpy(zero_copy_only=False))
                if ids3[lo, 2] == 0:
                    kernel.left(*args)
                    continue
                for at in range(0, hi - lo, RIGHT_BLOCK):
                    kernel.right(*[a[at:at + RIGHT_BLOCK] for a in args])
        if kernel is not None:
            yield from result(kernel)

    return run


def _rows(df: DataFrame, grp: Column, blk: Column, slc: Column, tag: int, order: Column) -> DataFrame:
    return df.select(grp.alias("grp"), blk.cast("long").alias("blk"), slc.cast("int").alias("slc"), F.lit(tag).alias("tag"),
                     order.alias("ord"), F.col("id"), F.col("rep"),
                     (F.col("aux") if "aux" in df.columns else F.lit(None)).cast("string").alias("aux"),
                     (F.col("num") if "num" in df.columns else F.lit(0.0)).cast("double").alias("num"))


def task_count(spark: SparkSession) -> int:
    """Partitions of kernel work. The number is given, because Spark would merge partitions by their bytes, which say little of the work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def run_rows(rows: DataFrame, make: Callable[[], Kernel], schema: str, arrow: pa.Schema) -> DataFrame:
    keyed = rows.repartition(task_count(rows.sparkSession), "grp", "blk", "slc").sortWithinPartitions("grp", "blk", "slc", "tag", "ord")
    return keyed.mapInArrow(_runner(make, arrow), schema)


def block_rows(left: DataFrame, right: DataFrame, by: Sequence[str] = (), block: int | None = None, sliced: bool = True) -> DataFrame:
    """Rows for :func:`run_rows`: every left tile meets all right rows of its group.

    Inputs have columns id, rep [, aux, num] and the ``by`` columns. A group of any size is
    spread over ceil(left / block) x ceil(right / slice) tasks; without slices each tile streams
    all right rows, for kernels whose results of slices cannot be added up.
    """
    size = max(64, min(block or TILE, -(-left.count() // left.sparkSession.sparkContext.defaultParallelism)))
    grp = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
    l, r = left.withColumn("grp", grp), right.withColumn("grp", grp)
    plan = (l.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_nb"))
             .join(r.groupBy("grp").agg((F.ceil(F.count(F.lit(1)) / RIGHT_SLICE) if sliced else F.lit(1)).cast("int").alias("_ns")), "grp"))
    lj, rj = l.join(plan, "grp"), r.join(plan, "grp")
    lj = lj.withColumn("_blk", F.pmod(hash_key("id", seed=5), "_nb")).withColumn("_slc", F.explode(F.sequence(F.lit(0), F.col("_ns") - 1)))
    rj = rj.withColumn("_slc", F.pmod(hash_key("id", seed=6), "_ns")).withColumn("_blk", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    zero = F.lit(0.0)
    return _rows(lj, F.col("grp"), F.col("_blk"), F.col("_slc"), 0, zero).unionByName(
        _rows(rj, F.col("grp"), F.col("_blk"), F.col("_slc"), 1, zero))


# ---------------------------------------------------------------- whole right tables in a temporary file

class Table:
    """The right rows of a group in the order they were sent: vectors in a temporary file, the rest in columns."""

    def __init__(self) -> None:
        self.file, self.n, self.dim, self.found, self.x = tempfile.TemporaryFile(prefix="right-"), 0, 0, [], None

    def add(self, part: pa.RecordBatch) -> None:
        x = _vectors(part)
        self.file.write(np.ascontiguousarray(x, dtype=float).tobytes())
        self.n, self.dim = self.n + len(x), x.shape[1]
        self.found.append(part.select(["id", "aux", "num"]))

    def close(self) -> None:
        """The end of the rows: ``x``, ``ids``, ``aux`` and ``num`` can be read from now on."""
        self.file.flush()
        self.x = np.memmap(self.file, float, "r", shape=(self.n, self.dim)) if self.n and self.dim else np.zeros((self.n, self.dim))
        columns = pa.Table.from_batches(self.found)
        self.ids, self.aux, self.num = columns.column("id").combine_chunks(), columns.column("aux").combine_chunks(), columns.column("num").to_numpy()
        self.found = []

    def slices(self) -> Iterator[slice]:
        for at in range(0, self.n, RIGHT_BLOCK):
            yield slice(at, min(self.n, at + RIGHT_BLOCK))


def _vectors(part: pa.RecordBatch) -> np.ndarray:
    return part.column("rep").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _spooled(fold: Callable[[Table, pa.RecordBatch, np.ndarray], Iterator[dict[str, Any]]], schema: pa.Schema):
    """Right rows (tag 0) first, then left rows (tag 1), which are folded ``TILE`` at a time; left rows that share an ID and follow one another are folded together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table, held = None, None, []

        def result() -> Iterator[pa.RecordBatch]:
            if table is None or not held:
                return
            if table.x is None:
                table.close()
            left = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for out in fold(table, left, _vectors(left)):
                if len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            group = np.asarray(batch.column("grp").to_pylist(), dtype=object)
            where = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("blk", "tag")], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]).any(axis=1) | (group[1:] != group[:-1])) + 1, [batch.num_rows]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if (group[lo], where[lo, 0]) != key:
                    yield from result()
                    key, table, held = (group[lo], where[lo, 0]), Table(), []
                if where[lo, 1] == 0:
                    table.add(batch.slice(lo, hi - lo))
                    continue
                if sum(map(len, held)) >= TILE and held[-1].column("id")[-1].as_py() != batch.column("id")[lo].as_py():
                    yield from result()
                    held = []
                held.append(batch.slice(lo, hi - lo))
        yield from result()

    return run


def spool(left: DataFrame, right: DataFrame, fold: Callable[[Table, pa.RecordBatch, np.ndarray], Iterator[dict[str, Any]]], schema: str, arrow: pa.Schema,
          by: Sequence[str] = (), order: str = "id") -> DataFrame:
    """``fold`` on every tile of left rows with all right rows of its group, which lie in a temporary file in the order of the column ``order``.

    Inputs have columns id, rep [, aux, num] and the ``by`` columns. A right row is sent once per core, so the shuffle grows with the table: left rows
    are dealt to the cores, and folded there tile by tile. They are placed by number.
    """
    spark = left.sparkSession
    slots = spark.sparkContext.defaultParallelism
    size = max(64, -(-left.count() // slots))
    grp = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
    l, r = left.withColumn("grp", grp), right.withColumn("grp", grp)
    plan = l.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_nb"))
    known = sorted(tuple(x) for x in plan.limit(DEALT_GROUPS + 1).collect())
    if len(known) <= DEALT_GROUPS:
        first = np.concatenate([[0], np.cumsum([n for _, n in known])]).tolist()
        plan = F.broadcast(spark.createDataFrame([(g, n, at) for (g, n), at in zip(known, first)], "grp string, _nb int, _first long"))
    else:
        plan = plan.withColumn("_first", F.pmod(F.xxhash64("grp"), F.lit(slots)))
    lj = l.join(plan, "grp").withColumn("_blk", F.pmod(hash_key("id", seed=5), "_nb"))
    rj = r.join(plan, "grp").withColumn("_blk", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    task = F.pmod(F.col("_first") + F.col("_blk"), F.lit(slots)).cast("int").alias("task")
    rows = None
    for df, tag in ((rj, 0), (lj, 1)):
        one = df.select(task, "grp", F.col("_blk").cast("int").alias("blk"), F.lit(tag).alias("tag"), (F.col(order) if tag == 0 else F.col("id")).cast("string").alias("ord"), "id", "rep",
                        (F.col("aux") if "aux" in df.columns else F.lit(None)).cast("string").alias("aux"), (F.col("num") if "num" in df.columns else F.lit(0.0)).cast("double").alias("num"))
        rows = one if rows is None else rows.unionByName(one)
    placed = rows.repartitionById(slots, F.col("task")).sortWithinPartitions("grp", "blk", "tag", "ord").drop("task", "ord")
    return placed.mapInArrow(_spooled(fold, arrow), schema)


def spool_rows(rows: DataFrame, fold: Callable[[Table, pa.RecordBatch, np.ndarray], Iterator[dict[str, Any]]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``fold`` on the rows that :func:`run_rows` takes: the right rows of a block lie in a temporary file in the order of ``ord``, slices are not cut."""
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    placed = rows.withColumn("tag", 1 - F.col("tag")).repartitionById(tasks, F.pmod("blk", F.lit(tasks)).cast("int"))
    return placed.sortWithinPartitions("grp", "blk", "tag", "ord").drop("slc", "ord").mapInArrow(_spooled(fold, arrow), schema)


#: Candidates that a search holds at once.
CANDIDATES = 4_000_000


def _bounds(q: np.ndarray, r: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Factors whose product bounds the squared distances from below, and each side's share of twice the greatest error."""
    share = 4 * (q.shape[1] + 8) * np.finfo(float).eps
    a, b = q - centre, r - centre
    qq, rr = (a * a).sum(axis=1), (b * b).sum(axis=1)
    one = lambda v: np.ones((len(v), 1))
    return np.hstack([a, (qq * (1 - share))[:, None], one(a)]), np.hstack([-2.0 * b, one(b), (rr * (1 - share))[:, None]]), 2 * share * qq, 2 * share * rr


class Search:
    """The nearest rows of a table, ties by the order of the table. ``columns`` are those of the vectors that count."""

    def __init__(self, table: Table, columns: slice = slice(None)) -> None:
        self.table, self.columns = table, columns
        step = max(1, -(-table.n // 8192))
        self.sample = np.array(table.x[::step, columns])
        self.centre = np.median(self.sample, axis=0) if len(self.sample) else 0.0

    def _reach(self, q: np.ndarray, want: int) -> np.ndarray:
        """A guess of the squared distance within which ``want`` rows lie."""
        share = want / self.table.n * len(self.sample)
        at = int(share + 4 * np.sqrt(share) + 8)
        if at >= len(self.sample):
            return np.full(len(q), np.inf)
        a, b, qe, re = _bounds(q, self.sample, self.centre)
        return np.partition(a @ b.T + qe[:, None] + re, at, axis=1)[:, at]

    def nearest(self, q: np.ndarray, want: int, reach: np.ndarray | None = None) -> np.ndarray:
        """(rows of q, ``want`` at most): places in the table, nearest first."""
        want = min(want, self.table.n)
        guessed = reach is None
        reach = self._reach(q, want) if guessed else reach
        held: list = []
        size = 0
        for at in self.table.slices():
            x = np.array(self.table.x[at, self.columns])
            a, b, qe, re = _bounds(q, x, self.centre)
            low = a @ b.T
            flat = np.flatnonzero(low <= reach[:, None])
            rows, cols = np.divmod(flat, len(x))
            held.append((rows, cols + at.start, low.ravel()[flat], qe[rows] + re[cols]))
            size += len(rows)
            if size > 2 * max(CANDIDATES, want * len(q)):
                held = [self._best(q, want, held)]
                size = len(held[0][0])
        rows, cols, low, wide = self._best(q, want, held)
        enough = np.bincount(rows[low + wide <= reach[rows]], minlength=len(q)) >= want
        out = np.full((len(q), want), -1)
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        out[rows, place] = cols
        if not enough.all():
            if not guessed:
                return out
            few = np.flatnonzero(~enough)
            for at in range(0, len(few), 16):
                some = few[at:at + 16]
                out[some] = self.nearest(q[some], want, np.full(len(some), np.inf))
        return out

    def _best(self, q: np.ndarray, want: int, held: list) -> tuple:
        """The ``want`` nearest candidates of each row. Those whose bounds do not part them are measured coordinate by coordinate."""
        rows, cols, low, wide = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(rows.astype(np.int16), kind="stable")
        size = np.bincount(rows, minlength=len(q))
        begin = np.cumsum(size) - size
        rows = rows[order]
        place = np.arange(len(rows)) - begin[rows]
        table = np.full((len(q), int(size.max(initial=0))), np.inf)
        table[rows, place] = low[order]
        there = np.arange(table.shape[1]) < size[:, None]
        order = order[(np.argsort(table, axis=1) + begin[:, None])[there]]
        cols, low, wide = cols[order], low[order], wide[order]
        table[there] = low + wide
        table = np.maximum.accumulate(table, axis=1)
        close = np.zeros(len(rows), bool)  # not surely farther than all before it
        close[1:] = (place[1:] > 0) & (low[1:] <= table[rows[1:], np.maximum(place[1:] - 1, 0)])
        run = np.cumsum(~close)
        first = np.flatnonzero(~close)
        near = place[first] < want  # a run that begins beyond needs no measure
        unsure = np.flatnonzero((np.bincount(run, minlength=1)[run] > 1) & near[run - 1])
        if len(unsure):
            exact = self._measured(q, rows[unsure], cols[unsure])
            inside = np.lexsort((cols[unsure], exact, run[unsure]))
            for v in (cols, low, wide):
                v[unsure] = v[unsure][inside]
        keep = place < want
        return rows[keep], cols[keep], low[keep], wide[keep]

    def _measured(self, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for at in range(0, len(rows), PAIRS_AT_ONCE):
            some = slice(at, at + PAIRS_AT_ONCE)
            diff = q[rows[some]] - self.table.x[cols[some]][:, self.columns]
            for x in (diff * diff).T:
                out[some] += x
        return out
