"""Local quadratic regression (loess) of y on x within groups, computed directly at every point.

Points are numbered along x. A tile of consecutive points needs the points within ``span`` of their number on either side and no others,
so a tile is one task with a window of the sorted points, whatever the size of the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.ranks import ordered_positions
from strandloom.functions.runtime import cut_lineage

#: Points of a tile.
TILE = 4096


def local_fits(x: np.ndarray, y: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """Fits at the points numbered ``at`` of sorted ``x``: quadratics weighted by tricubes over the q nearest points.

    Where fewer than three distinct x have a weight, the curve of smallest coefficients is taken; where only equal x have one, their mean.
    """
    last = len(x) - q
    low, high = np.maximum(at - q + 1, 0), np.minimum(at, last)
    while (low < high).any():  # leftmost window whose left end is no further than the point behind its right end
        mid = (low + high) // 2
        move = x[at] - x[mid] > x[np.minimum(mid + q, len(x) - 1)] - x[at]
        low, high = np.where(move & (low < high), mid + 1, low), np.where(move | (low >= high), high, mid)
    out = np.empty(len(at))
    for i, (p, lo) in enumerate(zip(at.tolist(), low.tolist())):
        d, v = x[lo:lo + q] - x[p], y[lo:lo + q]
        h = max(-d[0], d[-1])
        if h <= 0:
            out[i] = v.mean()
            continue
        d = d / h
        w = np.sqrt((1 - np.minimum(np.abs(d), 1.0) ** 3) ** 3)
        out[i] = np.linalg.lstsq(np.stack([w, w * d, w * d * d], axis=1), w * v, rcond=1e-10)[0][0]
    return out


def loess(df: DataFrame, by: str, x: str, y: str, span: float = 0.3, out: str = "fit", ids: str = "feature", tile: int | None = None) -> DataFrame:
    """Rows with the local fit at their x; the nearest floor(span * n) points of the group count, three at least."""
    size = tile or TILE
    numbered = cut_lineage(ordered_positions(df.select(by, ids, x, y), [by], [x, ids]))
    q = F.least(F.greatest(F.floor(F.col("n") * span + 1e-5), F.lit(3)), F.col("n")).cast("long")
    first = F.greatest(F.ceil((F.col("pos") - q - size + 1) / size), F.lit(0))
    sent = numbered.withColumn("_q", q).withColumn("_tile", F.explode(F.sequence(first, F.least(F.floor((F.col("pos") + q) / size), F.floor((F.col("n") - 1) / size)))))
    kind = df.schema

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        t = int(pdf["_tile"].iloc[0])
        mine = np.flatnonzero((pdf["pos"] // size == t).to_numpy())
        found = local_fits(pdf[x].to_numpy(dtype=float), pdf[y].to_numpy(dtype=float), mine, int(pdf["_q"].iloc[0]))
        return pd.DataFrame({by: pdf[by].to_numpy()[mine], ids: pdf[ids].to_numpy()[mine], out: found})

    fits = sent.groupBy(by, "_tile").applyInPandas(fit, f"`{by}` {kind[by].dataType.simpleString()}, `{ids}` {kind[ids].dataType.simpleString()}, `{out}` double")
    return df.join(fits, [by, ids])
