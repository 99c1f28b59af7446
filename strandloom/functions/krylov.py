"""Leading singular vectors of a long sparse table by a block Krylov method, whatever the number of features.

The operator A = X'X (of the centred X where wanted) is applied block-wise: cells travel as packed rows, grouped into tasks; every task
receives the current block of vectors, in ranges of columns that fit in its memory, and adds up its part of X'(X V). The feature side is
a table of blocks of ``FEATURES`` features. Only matrices of the size of the basis reach the driver. The basis grows by one block a
round, kept orthonormal by two passes, until the residuals of the wanted Ritz pairs are below the tolerance; the result is then
tested with one more application of A, and an error is raised where it fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.ranks import positions
from strandloom.functions.runtime import cut_lineage

#: Features of a block; bytes of vectors that a task holds; entries of a task; further columns of a block; rounds before it is an error.
FEATURES, TASK_BYTES, TASK_ENTRIES, OVERSAMPLE, ROUNDS = 1024, 64 << 20, 16_000_000, 10, 60


def _body(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, dtype=np.float64).tobytes()


def _matrix(body: pa.Scalar | bytes, width: int) -> np.ndarray:
    return np.frombuffer(body.as_buffer() if isinstance(body, pa.Scalar) else body, np.float64).reshape(-1, width)


class SparseRows:
    """Cells as packed rows (cell, cols, vals) over numbered features, with the means to remove."""

    def __init__(self, m: DataFrame, n_cells: int, center: bool) -> None:
        named = m.select("feature").distinct()
        self.features = cut_lineage(positions(named, [], ["feature"]).select("feature", F.col("pos")))
        numbered = m.join(self.features, "feature").select("cell", "pos", F.col("value").cast("double").alias("value"))
        entry = F.struct("pos", "value")
        self.rows = cut_lineage(numbered.groupBy("cell").agg(F.sort_array(F.collect_list(entry)).alias("e")).select("cell", F.col("e.pos").alias("cols"), F.col("e.value").alias("vals")))
        sizes = self.rows.agg(F.sum(F.size("cols")).alias("e")).first()
        self.p, self.n, self.center = self.features.count(), n_cells, center
        self.entries = sizes["e"] or 0
        self.groups = max(self.rows.sparkSession.sparkContext.defaultParallelism, -(-self.entries // TASK_ENTRIES))
        self.size = FEATURES
        self.blocks = -(-self.p // self.size)
        self.means = numbered.groupBy("pos").agg((F.sum("value") / n_cells).alias("mean")) if center else None

    def start(self, width: int, seed: int) -> DataFrame:
        """(fj, q, mu): random vectors and the feature means."""
        p, size = self.p, self.size
        base = self.features.sparkSession.range(self.blocks).select(F.col("id").alias("fj"))
        if self.means is None:
            base = base.select("fj", F.array().cast("array<struct<at:int,mean:double>>").alias("mu"))
        else:
            mu = self.means.groupBy(F.floor(F.col("pos") / size).alias("fj")).agg(F.collect_list(F.struct((F.col("pos") % size).cast("int").alias("at"), "mean")).alias("mu"))
            base = base.join(mu, "fj")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for fj, mu in zip(b.column("fj").to_pylist(), b.column("mu").to_pylist()):
                    q, mean = np.random.default_rng([seed, fj]).standard_normal((size, width)), np.zeros(size)
                    q[max(0, p - fj * size):] = 0.0
                    for x in mu:
                        mean[x["at"]] = x["mean"]
                    out.append((fj, _body(q), _body(mean)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.binary(), pa.binary()))], names=["fj", "q", "mu"])

        return base.mapInArrow(run, "fj long, q binary, mu binary")

    def shift_of(self, basis: DataFrame, width: int, last: int) -> np.ndarray:
        """The means times the last columns of the basis; zeros without centring."""
        if not self.center:
            return np.zeros(last)
        return _summed(basis.select("q", "mu"), lambda r: _matrix(r["mu"], 1).T @ _matrix(r["q"], width)[:, width - last:], (1, last))[0]

    def _tasks(self, vectors: DataFrame, width: int) -> tuple[DataFrame, list[tuple[int, int]]]:
        """Rows (grp, part, tag, fj, body, cell, cols, vals): vectors (tag 0) and cells (tag 1) of every task."""
        step = max(1, min(width, TASK_BYTES // (8 * self.size * self.blocks)))
        parts = [(a, min(a + step, width)) for a in range(0, width, step)]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for fj, body in zip(b.column("fj").to_pylist(), b.column("body")):
                    x = _matrix(body, width)
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in enumerate(parts)], pa.int32()), pa.array([fj] * len(parts), pa.int64()), pa.array([_body(x[:, lo:hi]) for lo, hi in parts], pa.binary())], names=["part", "fj", "body"])

        v = vectors.select("fj", "body").mapInArrow(cut, "part int, fj long, body binary")
        v = v.select(F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("grp"), "part", F.lit(0).alias("tag"), "fj", "body")
        grp = F.pmod(F.xxhash64("cell"), F.lit(self.groups)).cast("int")
        r = self.rows.select(grp.alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))).alias("part"), F.lit(1).alias("tag"), "cell", "cols", "vals")
        return v.unionByName(r, allowMissingColumns=True).repartitionById(self.groups * len(parts), F.col("grp") * len(parts) + F.col("part")).sortWithinPartitions("grp", "part", "tag"), parts

    def _stream(self, parts: list[tuple[int, int]], shift: np.ndarray, begin: Callable, rows: Callable, finish: Callable) -> Callable:
        blocks, size = self.blocks, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, v = None, None
            for b in batches:
                if not b.num_rows:
                    continue
                where = np.stack([b.column(c).to_numpy() for c in ("grp", "part", "tag")], axis=1)
                edges = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1, [len(where)]])
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    grp, part, tag = where[lo].tolist()
                    if (grp, part) != key:
                        if key is not None:
                            yield from finish(key[1])
                        key, (a, z) = (grp, part), parts[part]
                        v = np.zeros((blocks * size, z - a))
                        begin(v.shape)
                    some = b.slice(lo, hi - lo)
                    if tag == 0:
                        for fj, body in zip(some.column("fj").to_pylist(), some.column("body")):
                            v[fj * size:(fj + 1) * size] = _matrix(body, v.shape[1])
                    else:
                        yield from rows(some, part, v, shift[a:z])
            if key is not None:
                yield from finish(key[1])

        return run

    def gram_times(self, vectors: DataFrame, width: int, shift: np.ndarray) -> DataFrame:
        """(fj, w): A times the vectors. ``shift`` is the means times the vectors (zeros without centring)."""
        tasks, parts = self._tasks(vectors, width)
        blocks, high, most, total = self.blocks, self.size, TASK_BYTES, {}

        def begin(shape: tuple[int, int]) -> None:
            total["w"] = np.zeros(shape)

        def rows(some: pa.RecordBatch, part: int, v: np.ndarray, less: np.ndarray) -> Iterator[pa.RecordBatch]:
            for cols, vals, size in _packed(some, v.shape[1], most):
                y = _products(cols, vals, size, v) - less
                order = np.argsort(cols, kind="stable")
                at = cols[order]
                heads = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                total["w"][at[heads]] += np.add.reduceat((vals[:, None] * np.repeat(y, size, axis=0))[order], heads)
            return iter(())

        def finish(part: int) -> Iterator[pa.RecordBatch]:
            for fj in range(blocks):
                x = total["w"][fj * high:(fj + 1) * high]
                if x.any():
                    yield pa.RecordBatch.from_arrays([pa.array([fj], pa.int64()), pa.array([part], pa.int32()), pa.array([_body(x)], pa.binary())], names=["fj", "part", "body"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, w = None, None
            for b in batches:
                for fj, part, body in zip(b.column("fj").to_pylist(), b.column("part").to_pylist(), b.column("body")):
                    if fj != now:
                        if now is not None:
                            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([_body(w)], pa.binary())], names=["fj", "w"])
                        now, w = fj, np.zeros((high, width))
                    lo, hi = parts[part]
                    w[:, lo:hi] += _matrix(body, hi - lo)
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([_body(w)], pa.binary())], names=["fj", "w"])

        partial = tasks.mapInArrow(self._stream(parts, shift, begin, rows, finish), "fj long, part int, body binary")
        return cut_lineage(partial.repartition("fj").sortWithinPartitions("fj", "part").mapInArrow(add, "fj long, w binary"))

    def times(self, vectors: DataFrame, width: int, shift: np.ndarray) -> DataFrame:
        """(cell, rep): the centred rows times the vectors, for the cells that have entries."""
        tasks, parts = self._tasks(vectors, width)
        most = TASK_BYTES

        def rows(some: pa.RecordBatch, part: int, v: np.ndarray, less: np.ndarray) -> Iterator[pa.RecordBatch]:
            out = np.concatenate([_products(cols, vals, size, v) - less for cols, vals, size in _packed(some, v.shape[1], most)])
            rep = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([some.column("cell"), pa.array(np.full(len(out), part), pa.int32()), rep], names=["cell", "part", "rep"])

        found = tasks.mapInArrow(self._stream(parts, shift, lambda shape: None, rows, lambda part: iter(())), f"cell {self.rows.schema['cell'].dataType.simpleString()}, part int, rep array<double>")
        if len(parts) == 1:
            return found.select("cell", "rep")
        pieces = F.array_sort(F.collect_list(F.struct("part", "rep")))
        return found.groupBy("cell").agg(F.flatten(F.transform(pieces, lambda x: x["rep"])).alias("rep"))


def _packed(some: pa.RecordBatch, width: int, task_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Columns, values and sizes of runs of rows with a bounded number of entries."""
    lists = some.column("cols")
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    cols, vals = lists.flatten().to_numpy(zero_copy_only=False), some.column("vals").flatten().to_numpy(zero_copy_only=False)
    most, at = max(1, task_bytes // (16 * width)), 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield cols[ends[at]:ends[to]], vals[ends[at]:ends[to]], np.diff(ends[at:to + 1])
        at = to


def _products(cols: np.ndarray, vals: np.ndarray, size: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.add.reduceat(vals[:, None] * v[cols], np.cumsum(size) - size)  # rows have entries, so no run is empty


# --- the feature side -----------------------------------------------------------------------------------------------------------------

def _summed(df: DataFrame, fn: Callable[[dict[str, bytes]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum over the blocks of a small matrix made from each. Tasks add up theirs; one row a task is left to add."""
    names = df.columns

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for i in range(b.num_rows):
                total += fn({c: b.column(c)[i].as_py() for c in names})
        yield pa.RecordBatch.from_arrays([pa.array([_body(total)], pa.binary())], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for s in b.column("s").to_pylist():
                total += np.frombuffer(s).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([_body(total)], pa.binary())], names=["s"])

    row = df.mapInArrow(part, "s binary").repartition(1).mapInArrow(add, "s binary").first()
    return np.frombuffer(row["s"]).reshape(shape).copy()


def _changed(df: DataFrame, fn: Callable[[dict[str, bytes]], dict[str, np.ndarray]], keep: list[str], made: list[str]) -> DataFrame:
    """Blocks with new matrices made from their own."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                new = fn({c: b.column(c)[i].as_py() for c in names})
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, 1) for c in keep], *[pa.array([_body(new[c])], pa.binary()) for c in made]], names=[*keep, *made])

    kinds = {c: df.schema[c].dataType.simpleString() for c in keep}
    return df.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in keep], *[f"{c} binary" for c in made]]))


def _root(g: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the Gram matrix of vectors: map to orthonormal ones, their coordinates, and coordinates of the directions too small to keep."""
    lam, u = np.linalg.eigh((g + g.T) / 2)
    lam = np.maximum(lam, 0.0)
    keep = lam > max(least, 1e-10 * lam.max(initial=0.0))
    return u[:, keep] / np.sqrt(lam[keep]), np.sqrt(lam[keep])[:, None] * u[:, keep].T, np.sqrt(lam[~keep])[:, None] * u[:, ~keep].T


def leading_vectors(x: SparseRows, k: int, seed: int = 0, tol: float = 1e-9, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(fj, body) with the k leading right singular vectors, the squared singular values, and the means times the vectors."""
    width = min(k + OVERSAMPLE, x.p, x.n)
    first = cut_lineage(x.start(width, seed))
    e, _, _ = _root(_summed(first, lambda r: (lambda q: q.T @ q)(_matrix(r["q"], width)), (width, width)), 0.0)
    new = e.shape[1]
    basis = cut_lineage(_changed(first, lambda r: {"q": _matrix(r["q"], width) @ e}, ["fj", "mu"], ["q"]))
    shift = x.shift_of(basis, new, new)
    m, t, lost, top = new, np.zeros((0, 0)), [], 0.0
    for _ in range(rounds):
        have, fresh = m, new
        block = _changed(basis.select("fj", "q"), lambda r: {"body": _matrix(r["q"], have)[:, have - fresh:]}, ["fj"], ["body"])
        w = basis.join(x.gram_times(block, fresh, shift), "fj", "left")
        zero = _body(np.zeros((x.size, fresh)))
        w = cut_lineage(w.select("fj", "mu", "q", F.coalesce("w", F.lit(bytearray(zero))).alias("w")))
        c = _summed(w, lambda r: _matrix(r["q"], have).T @ _matrix(r["w"], fresh), (have, fresh))
        wide = np.zeros((have, have))
        wide[:have - fresh, :have - fresh] = t
        wide[:, have - fresh:] = c
        wide[have - fresh:, :have - fresh] = c[:have - fresh].T
        t = (wide + wide.T) / 2
        theta, z = np.linalg.eigh(t)
        theta, z = theta[::-1], z[:, ::-1]
        top = max(top, float(theta[0]))
        # what A times the newest block has outside the basis: once roughly, and again for what the first pass left
        def outside(r: dict[str, bytes]) -> np.ndarray:
            return _matrix(r["w"], fresh) - _matrix(r["q"], have) @ c

        g2 = _summed(w, lambda r: (lambda q, y: np.vstack([q.T @ y, y.T @ y]))(_matrix(r["q"], have), outside(r)), (have + fresh, fresh))
        c2 = g2[:have]
        e, r_kept, r_lost = _root(g2[have:] - c2.T @ c2, (1e-13 * top) ** 2)
        lost.append((have - fresh, have, r_lost))
        wanted = min(k, have)
        residual = (r_kept @ z[have - fresh:, :wanted]) ** 2
        square = residual.sum(axis=0) + sum(((d @ z[a:b, :wanted]) ** 2).sum(axis=0) for a, b, d in lost)
        if have >= k and np.sqrt(square.max()) <= tol * top or e.shape[1] == 0:
            break
        new = e.shape[1]
        basis = cut_lineage(_changed(w, lambda r: {"q": np.hstack([_matrix(r["q"], have), (outside(r) - _matrix(r["q"], have) @ c2) @ e])}, ["fj", "mu"], ["q"]))
        m = have + new
        shift = x.shift_of(basis, m, new)
    else:
        raise ArithmeticError(f"singular vectors have not converged: residual {np.sqrt(square.max()) / top:.1e} after {rounds} rounds")
    k = min(k, m)
    theta, z = np.maximum(theta[:k], 0.0), z[:, :k]
    have = m
    vectors = cut_lineage(_changed(basis.select("fj", "q"), lambda r: {"body": _matrix(r["q"], have) @ z}, ["fj"], ["body"]))
    shift = x.shift_of(vectors.join(basis.select("fj", "mu"), "fj").withColumnRenamed("body", "q"), k, k)
    if top > 0:
        test = vectors.join(x.gram_times(vectors, k, shift), "fj")
        left = _summed(test, lambda r: ((_matrix(r["w"], k) - _matrix(r["body"], k) * theta) ** 2).sum(axis=0)[None, :], (1, k))
        if np.sqrt(left.max()) > 100 * tol * top:
            raise ArithmeticError(f"residual {np.sqrt(left.max()) / top:.1e} of the singular vectors is above its bound")
    return vectors, theta, shift
