"""Dimension reduction on long sparse matrices and K-means on embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.krylov import SparseRows, leading_vectors
from strandloom.functions.ranks import positions
from strandloom.functions.runtime import cut_lineage
from strandloom.functions.vectors import sum_vectors, zscore
from strandloom.operators import matrix as mt


@dataclass
class Svd:
    """Truncated SVD: U per cell, singular values, V per feature, and the column means removed."""

    u: DataFrame
    s: list[float]
    v: DataFrame
    shift: list[float]


def project(m: DataFrame, v: DataFrame, size: int, cells: DataFrame | None = None, shift: list[float] | None = None) -> DataFrame:
    """(cell, rep): matrix times V, minus a constant row; sums are combined map-side."""
    joined = m.join(v, "feature")
    rep = sum_vectors(joined.groupBy("cell"), [F.col("value") * F.col("vec")[i] for i in range(size)], "rep")
    if cells is not None:
        zero = F.array(*[F.lit(0.0)] * size)
        rep = cells.select("cell").join(rep, "cell", "left").withColumn("rep", F.coalesce("rep", zero))
    if shift is not None:
        rep = rep.withColumn("rep", F.transform("rep", lambda x, i: x - F.array(*[F.lit(float(t)) for t in shift])[i]))
    return rep


#: Cells up to which their products are one small matrix; singular values below this share of the largest are left to the Krylov method.
FEW_CELLS, LEAST_SHARE = 512, 1e-4


def _few_cells(m: DataFrame, n: int, k: int, center: bool) -> tuple[DataFrame, np.ndarray, np.ndarray, DataFrame] | None:
    """(feature, vec), squared singular values, means times vectors and (cell, rep) from the products of a few cells, added up over features.

    Features are rows of cells here, and no vector of the length of the features is sent anywhere. None where there are more cells, or too small singular values.
    """
    spark = m.sparkSession
    names = [r["cell"] for r in m.select("cell").distinct().limit(n + 1).collect()] if n <= FEW_CELLS else []
    if not names or len(names) > n:
        return None
    kind = m.schema["cell"].dataType.simpleString()
    number = spark.createDataFrame(list(enumerate(names)), f"at int, _cell {kind}")
    entries = m.where(F.col("feature").isNotNull()).join(F.broadcast(number), F.col("cell").eqNullSafe(F.col("_cell")))
    rows = cut_lineage(entries.groupBy("feature").agg(F.collect_list(F.struct("at", F.col("value").cast("double").alias("value"))).alias("e")).select("feature", F.col("e.at").alias("cols"), F.col("e.value").alias("vals")))

    def dense(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for at in range(0, b.num_rows, 1024):
            some = b.slice(at, 1024)
            sizes = np.diff(some.column("cols").offsets.to_numpy())
            where = np.repeat(np.arange(some.num_rows), sizes) * n + some.column("cols").flatten().to_numpy()
            yield some, np.bincount(where, some.column("vals").flatten().to_numpy(zero_copy_only=False), some.num_rows * n).reshape(-1, n)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for b in batches:
            for _, x in dense(b):
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for b in batches:
            for s in b.column("s").to_pylist():
                total += np.frombuffer(s).reshape(n, n)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    gram = np.frombuffer(rows.select("cols", "vals").mapInArrow(products, "s binary").repartition(1).mapInArrow(add, "s binary").first()["s"]).reshape(n, n)
    mean = gram.mean(axis=0) if center else np.zeros(n)
    lam, u = np.linalg.eigh(gram - mean - mean[:, None] + mean.mean() if center else gram)
    lam, u = lam[::-1][:k], u[:, ::-1][:, :k]
    if not np.isfinite(lam).all() or lam[-1] <= (LEAST_SHARE ** 2) * lam[0]:
        return None
    by = u / np.sqrt(lam)
    if center:
        by = by - by.mean(axis=0)
    scores = gram @ by
    shift = scores.mean(axis=0) if center else np.zeros(k)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, x in dense(b):
                v = x @ by
                yield pa.RecordBatch.from_arrays([some.column("feature"), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * k, pa.int32()), pa.array(v.ravel()))], names=["feature", "vec"])

    v = cut_lineage(rows.mapInArrow(vectors, f"feature {m.schema['feature'].dataType.simpleString()}, vec array<double>"))
    return v, lam, shift, spark.createDataFrame([(c, (scores[i] - shift).tolist()) for i, c in enumerate(names)], f"cell {kind}, rep array<double>")


def svd(m: DataFrame, k: int, cells: DataFrame, center: bool = False, seed: int = 0, tol: float = 1e-9) -> Svd:
    """Truncated SVD of the (centred) matrix: from the products of all cells where they are few, else by a block Krylov method for any number of features.

    An error is raised if the residual of a wanted pair stays above ``tol`` times the largest squared singular value.
    """
    m, cells = cut_lineage(m.select("cell", "feature", "value")), cut_lineage(cells.select("cell"))
    n = cells.count()
    few = _few_cells(m, n, min(k, m.select("feature").distinct().count(), n), center) if n <= FEW_CELLS else None
    if few:
        v, lam, shift, held = few
        k = len(lam)
    else:
        x = SparseRows(m, n, center)
        k = min(k, x.p, x.n)
        vectors, lam, shift = leading_vectors(x, k, seed, tol)
        k = len(lam)

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for fj, body in zip(b.column("fj").to_pylist(), b.column("body").to_pylist()):
                    v = np.frombuffer(body).reshape(-1, k)
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * k, pa.int32()), pa.array(v.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(fj * len(v) + np.arange(len(v)), pa.int64()), vec], names=["pos", "vec"])

        v = cut_lineage(vectors.mapInArrow(unpack, "pos long, vec array<double>").join(x.features, "pos").select("feature", "vec"))
        held = x.times(vectors, k, shift)
    top = v.agg(*[F.max_by(F.col("vec")[i], F.struct(F.abs(F.col("vec")[i]), "feature")).alias(f"c{i}") for i in range(k)]).first()
    sign = [-1.0 if (c or 0) < 0 else 1.0 for c in top]
    signs = F.array(*[F.lit(c) for c in sign])
    s = np.sqrt(lam)
    s[s <= 1e-7 * s.max(initial=0.0)] = 0.0
    bare = F.array(*[F.lit(-float(c)) for c in shift])  # a cell without entries
    scores = cells.join(held, "cell", "left").withColumn("rep", F.coalesce("rep", bare))
    scale = F.array(*[F.lit(c / y if y > 1e-12 else 0.0) for c, y in zip(sign, s)])
    u = scores.withColumn("rep", F.zip_with("rep", scale, lambda a, b: a * b))
    return Svd(u, [float(y) for y in s], v.withColumn("vec", F.zip_with("vec", signs, lambda a, b: a * b)), [float(c * y) for c, y in zip(sign, shift)])


def _lsi_input(m: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    x = mt.tfidf_seurat(m, cells)
    total = x.groupBy("cell").agg(F.sum(F.abs("value")).alias("_l1"))
    return x.join(total, "cell").select("cell", "feature", F.log1p(F.col("value") / F.col("_l1") * 1e4).alias("value"))


def lsi(m: DataFrame, cells: DataFrame, n_components: int = 20, features: DataFrame | None = None) -> DataFrame:
    """(cell, rep): left singular vectors of the log-scaled TF-IDF matrix, each cell z-scored.

    ``features`` with a ``highly_variable`` flag restricts the input. Every row of ``cells`` comes out; a cell without an entry in
    the features has zeros, which the z-score makes NaN.
    """
    if features is not None:
        m = m.join(features.where("highly_variable").select("feature"), "feature", "left_semi")
    x = cut_lineage(_lsi_input(m, cells))
    out = svd(x, n_components, cells)
    return out.u.withColumn("rep", zscore("rep"))


def lsi_project(m: DataFrame, cells: DataFrame, k: int, mask: DataFrame) -> DataFrame:
    """LSI fitted on the masked cells and projected to all: X V / s, then z-scored per cell (NaN for a cell without entries)."""
    x = cut_lineage(_lsi_input(m, cells))
    fit = svd(x.join(mask.select("cell"), "cell", "left_semi"), k, mask)
    size = len(fit.s)
    inv = F.array(*[F.lit(1.0 / s if s > 1e-12 else 0.0) for s in fit.s])
    rep = project(x, fit.v, size, cells).withColumn("rep", F.zip_with("rep", inv, lambda a, b: a * b))
    return rep.withColumn("rep", zscore("rep"))


class AllCoolsLsi:
    """LSI in two steps: idf and SVD are fitted once, then any batch (or stream) of cells is
    projected with two stateless joins."""

    def __init__(self, n_components: int = 100, scale_factor: float = 1e5, seed: int = 0, idf: DataFrame | None = None) -> None:
        self.n_components, self.scale_factor, self.seed = n_components, scale_factor, seed
        self.idf = idf
        self.v: DataFrame | None = None
        self.s: list[float] = []

    def fit(self, m: DataFrame, cells: DataFrame, downsample: int | None = None) -> AllCoolsLsi:
        n = cells.count()
        if downsample is not None and downsample < n:
            cells = positions(cells.select("cell"), [], ["cell"], self.seed).where(F.col("pos") < downsample).select("cell")
            m, n = m.join(cells, "cell", "left_semi"), downsample
        fresh = mt.fit_idf(m, cells)
        x, _ = mt.tfidf_allcools(m, self.scale_factor, fresh)
        self.idf = fresh if self.idf is None else self.idf
        k = min(n - 1, m.select("feature").distinct().count() - 1, self.n_components)
        out = svd(x, k, cells)
        self.v, self.s = out.v, out.s
        return self

    def transform(self, m: DataFrame, normalize: bool = True, cells: DataFrame | None = None) -> DataFrame:
        """(cell, rep) of every row of ``cells``, with zeros for one without entries; without ``cells``, of the cells that have entries."""
        if self.v is None:
            raise ValueError("fit before transform")
        x, _ = mt.tfidf_allcools(m, self.scale_factor, self.idf)
        rep = project(x, self.v, len(self.s), cells)
        if not normalize:
            return rep
        inv = F.array(*[F.lit(1.0 / s if s > 1e-12 else 0.0) for s in self.s])
        return rep.withColumn("rep", F.zip_with("rep", inv, lambda a, b: a * b))


def pca(m: DataFrame, cells: DataFrame, k: int, mask: DataFrame | None = None, max_value: float | None = 10) -> tuple[DataFrame, list[float]]:
    """(cell, rep) principal component scores of the standardised matrix, and component variances.

    The standardised matrix is dense, but equals a sparse one plus a constant row, which centring
    removes: the decomposition runs on the sparse part. ``mask`` picks the cells used for fitting.
    """
    diff, _ = mt.scale_sparse(m, cells, max_value, mask)
    diff, cells = cut_lineage(diff), cut_lineage(cells.select("cell"))
    base, used = (diff, cells) if mask is None else (diff.join(mask.select("cell"), "cell", "left_semi"), mask)
    fit = svd(base, k, used, center=True)
    n = used.count()
    scores = project(diff, fit.v, len(fit.s), cells, fit.shift)
    return scores, [s * s / (n - 1) for s in fit.s]


def kmeans(cells: DataFrame, k: int, seed: int = 0, mask: DataFrame | None = None, rep: str = "rep", out: str = "cluster",
           max_iter: int = 20) -> DataFrame:
    """Cells with their K-means cluster (string); fitted on a subset, assigned to all."""
    # rows are placed by ID so that the seeded start does not depend on file layout
    base = cells.withColumn("_v", array_to_vector(F.col(rep).cast("array<double>")))
    fit = base if mask is None else base.join(mask.select("cell"), "cell", "left_semi")
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="_c").fit(fit.select("_v"))
    return model.transform(base).withColumn(out, F.col("_c").cast("string")).drop("_v", "_c")


def drop_missing(cells: DataFrame, rep: str = "rep") -> tuple[DataFrame, DataFrame]:
    """Cells whose embedding has no missing number, and one row with the share dropped (percent)."""
    bad = F.col(rep).isNull() | F.exists(rep, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return cells.where(~bad), cells.agg((F.avg(F.when(bad, 1.0).otherwise(0.0)) * 100).alias("percent_missing"))
