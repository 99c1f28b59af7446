"""Column functions on fixed-length ARRAY<DOUBLE> embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column | str) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = norm(a)
    return F.when(n == 0, _c(a)).otherwise(F.transform(_c(a), lambda x: x / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def zscore(a: Column | str) -> Column:
    """Centre one vector on its own mean and divide by its own sample deviation; NaN throughout where that is 0 or undefined."""
    n = F.size(_c(a))
    mean = F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x) / n
    centred = F.transform(_c(a), lambda x: x - mean)
    deviation = F.try_divide(norm(centred), F.sqrt(n - 1))
    return F.transform(centred, lambda x: F.coalesce(F.try_divide(x, deviation), F.lit(float("nan"))))


def dimension(df: DataFrame, rep: str) -> int:
    """Length of the embedding, from one row."""
    row = df.where(F.col(rep).isNotNull()).select(F.size(rep).alias("d")).first()
    if row is None:
        raise ValueError(f"no embedding in column {rep}")
    return int(row["d"])


def sum_vectors(grouped, terms: list[Column], out: str) -> DataFrame:
    """``grouped.agg`` of one sum per component, re-packed as an array (map-side combined)."""
    cols = [F.sum(t).alias(f"_v{i}") for i, t in enumerate(terms)]
    summed = grouped.agg(*cols)
    names = [f"_v{i}" for i in range(len(terms))]
    keep = [c for c in summed.columns if c not in names]
    return summed.select(*keep, F.array(*names).alias(out))
