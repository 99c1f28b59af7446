"""Whitening of embeddings by the leading eigenvectors of their covariance, found by spectrum slicing.

The rows are read for sums, centred products and the projection; only numbers of the size of the dimension squared reach the driver.
There, LDLᵀ factors of the shifted covariance count the eigenvalues above a shift (Sylvester's law of inertia). Bisection on these
counts isolates each leading eigenvalue, Rayleigh quotient iteration finishes it with its vector, and counts on both sides of the result
certify its number.

Defined results. Rows whose vector is null or holds null, NaN or infinite entries are dropped; vectors of different lengths are an error,
as are integers whose squares leave 64 bits. Repeated rows count as often as they occur; null ids are kept. Components beyond the rank of
the covariance (eigenvalue not above rounding) have no whitened value and are left out, so one row, equal rows and empty tables give no
component. Components of equal eigenvalues are any orthonormal basis of their space. Further columns are kept by ``transform``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.runtime import cut_lineage
from strandloom.llm.text import require

SCALE, SHIFT = 1024, 100_000
#: Growth bound of symmetric pivoting with blocks of one and two.
ALPHA = (1 + 17 ** 0.5) / 8
EPS = float(np.finfo(float).eps)


# --- spectrum of a small symmetric matrix ---------------------------------------------------------------------------------------------

def count_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of a pivoted LDLᵀ of the shifted matrix."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, positive = len(a), 0, 0
    while k < n:
        col = np.abs(a[k + 1:, k])
        top = float(col.max()) if len(col) else 0.0
        pivot, size = k, 1
        if abs(a[k, k]) < ALPHA * top:
            r = k + 1 + int(col.argmax())
            row = np.abs(a[r, k:]).copy()
            row[r - k] = 0.0
            if abs(a[k, k]) * row.max() < ALPHA * top * top:
                pivot, size = (r, 1) if abs(a[r, r]) >= ALPHA * row.max() else (r, 2)
        to = k + size - 1
        if pivot != to:
            a[[to, pivot]] = a[[pivot, to]]
            a[:, [to, pivot]] = a[:, [pivot, to]]
        if size == 1:
            d = a[k, k]
            positive += bool(d > 0)
            if d != 0 and k + 1 < n:
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k] / d, a[k + 1:, k])
        else:
            positive += 1  # a block of two is taken only where it has one eigenvalue of either sign
            c = a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= c @ np.linalg.solve(a[k:k + 2, k:k + 2], c.T)
        k += size
    return positive


def _shifted(matrix: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    eye = np.eye(len(matrix))
    try:
        w = np.linalg.solve(matrix - shift * eye, v)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last digit
        w = np.linalg.solve(matrix - (shift + EPS * scale) * eye, v)
    return w


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, with unit eigenvectors as rows; fewer where the rank is less."""
    n = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    if scale == 0.0:
        return np.zeros(0), np.zeros((0, n))
    floor, counts = 16 * n * EPS * scale, {}

    def above(x: float) -> int:
        if x not in counts:
            counts[x] = count_above(matrix, x)
        return counts[x]

    k = min(k, above(floor))
    values, vectors = [], np.zeros((0, n))
    for number in range(1, k + 1):
        lo = max(x for x in counts if counts[x] >= number)
        hi = min([x for x in counts if counts[x] < number], default=scale * (1 + 4 * EPS))
        above(hi)
        while not (counts[lo] == number and counts[hi] == number - 1) and hi - lo > 8 * EPS * scale:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if above(mid) >= number else (lo, mid)
        for _ in range(200):
            v = np.random.default_rng(number).standard_normal(n)
            rho, converged = (lo + hi) / 2, False
            for step in range(12):
                v -= vectors.T @ (vectors @ v)
                v = _shifted(matrix, rho, v / np.linalg.norm(v), scale)
                v -= vectors.T @ (vectors @ v)
                v /= np.linalg.norm(v)
                if step:  # one step of inverse iteration, then Rayleigh quotients
                    rho = float(v @ matrix @ v)
                if np.linalg.norm(matrix @ v - rho * v) <= 4 * n * EPS * scale and step:
                    converged = True
                    break
            rho, slack = float(v @ matrix @ v), 8 * n * EPS * scale
            if converged and lo - slack <= rho <= hi + slack and above(rho + slack) < number <= above(rho - slack):
                break
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if above(mid) >= number else (lo, mid)
        else:
            raise ArithmeticError(f"eigenvalue {number} has not been certified")
        values.append(rho)
        vectors = np.vstack([vectors, v])
    return np.array(values), vectors


# --- sums over the rows ---------------------------------------------------------------------------------------------------------------

def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The list column as rows of a matrix."""
    col = batch.column(name)
    size = np.diff(col.offsets.to_numpy())
    if len(size) and (size != size[0]).any():
        raise ValueError("vectors have different lengths")
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(size), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch, "x")
            n, s = total.get(x.shape[1], (0, 0))
            total[x.shape[1]] = (n + len(x), s + x.sum(axis=0))
    for d, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, n), pa.int64()), pa.array(s, pa.int64())],
                                         names=["d", "i", "n", "s"])


def column_sums(df: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension of the long vectors ``x``."""
    found = df.select("x").mapInArrow(_sums, "d int, i int, n long, s long").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    if len({r["d"] for r in found}) > 1:
        raise ValueError("vectors have different lengths")
    ordered = sorted(found, key=lambda r: r["i"])
    return (ordered[0]["n"], [r["s"] for r in ordered]) if ordered else (0, [])


def centred_products(df: DataFrame, column: str, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (v - centre) and of its products with itself. Each task adds up its own rows; Spark adds the tasks."""
    d = len(centre)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch, column).astype(float) - centre
                total += y.T @ y
                rest += y.sum(axis=0)
        i, j = np.divmod(np.arange(d * (d + 1)), d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.hstack([total, rest[:, None]]).ravel())], names=["i", "j", "v"])

    out = np.zeros((d, d + 1))
    for r in df.select(column).mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out[:, d], (out[:, :d] + out[:, :d].T) / 2


# --- the operator ---------------------------------------------------------------------------------------------------------------------

def whole_vector(vector: Column) -> Column:
    """Neither null nor with null, NaN or infinite entries."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))


@dataclass
class Whitening:
    """n, sums S, trace of the covariance, its leading eigenvalues (falling) and unit eigenvectors (rows)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    rest: np.ndarray

    def transform(self, rows: DataFrame) -> DataFrame:
        """(row, x) with deviation (exact) and whitened, an array of one double per component."""
        n, sums, vectors = self.n, np.array(self.sums, dtype=np.int64), self.vectors / np.sqrt(self.values)[:, None]
        mean = np.array([s / n for s in self.sums])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch, "x")
                most = float(np.abs(x).max(initial=0)) * n + float(np.abs(sums).max(initial=0))
                if most > 2.0 ** 62 or ((x.astype(float) * n - sums) ** 2).sum(axis=1).max(initial=0) > 2.0 ** 62.99:
                    raise OverflowError("deviation leaves 64 bits")
                off = x * np.int64(n) - sums
                w = (x.astype(float) - mean) @ vectors.T
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array((off * off).sum(axis=1), pa.int64()), flat], names=["row", "deviation", "whitened"])

        return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, deviation long, whitened array<double>")


def vectors_of(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with whole vectors: row (all columns) and x (scaled integers)."""
    require(df, vector)
    v = F.col(f"`{vector}`")
    return df.where(whole_vector(v)).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), integers(v).alias("x"))


def fit(rows: DataFrame, k: int = 8) -> Whitening | None:
    """The model of all rows of ``vectors_of``; none for an empty table."""
    n, sums = column_sums(rows)
    if n == 0 or not sums:
        return None
    rest, products = centred_products(rows, "x", np.array([s / n for s in sums]))
    cov = products / n
    values, vectors = leading(cov, k)
    return Whitening(n, sums, float(np.trace(cov)), values, vectors, rest)


def whitened(df: DataFrame, vector: str = "embedding", k: int = 8) -> DataFrame:
    """One row per remaining row and component: row (all input columns), component, n, deviation, whitened, explained, identity_error."""
    rows = vectors_of(df, vector)
    model = fit(rows, k)
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        none = rows.select("row", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
        return none.where(F.lit(False))
    out = cut_lineage(model.transform(rows))
    scaled = model.vectors / np.sqrt(model.values)[:, None]
    _, products = centred_products(out, "whitened", scaled @ model.rest / model.n)
    error = float(np.abs(products / model.n - np.eye(len(model.values))).max())
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return out.select("row", "deviation", F.posexplode("whitened").alias("_at", "_w")).select(
        "row", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("_w").alias("whitened"),
        F.element_at(explained, F.col("_at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
