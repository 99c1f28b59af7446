"""Regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.runtime import cut_lineage
from strandloom.llm.text import WS_CHARS, require, row_key, whole, words

FEATURES = ["log_words", "log_word_length", "symbols", "capitals", "marks", "distinct", "stutter", "digits", "log_line_words", "repeated_lines", "bars"]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, x: array<double>) of every row: logarithms of sizes, square roots of shares. Texts without words get all zeros."""
    df = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_key"), whole(F.col("text")).alias("t"))
    df = df.withColumns({"w": words(F.col("t")), "l": F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")})
    df = df.withColumns({"n": F.size("w").cast("double"), "c": F.length(F.array_join("w", "")).cast("double"), "nl": F.size("l").cast("double")})
    n, c, nl = (F.greatest(F.col(x), F.lit(1.0)) for x in ("n", "c", "nl"))
    only = lambda keep: F.length(F.regexp_replace("t", f"[^{keep}]+", ""))
    root = lambda x: F.sqrt(x)
    stutter = F.size(F.filter(F.col("w"), lambda x, i: (i > 0) & (x == F.get(F.col("w"), i - 1))))
    x = F.array(F.log1p("n"), F.log1p(F.col("c") / n), root(only("#*$%&|<>") / c), root(only("A-Z") / c), root(only("!?") / c), F.size(F.array_distinct("w")) / n,
                root(stutter / n), root(only("0-9") / c), F.log1p(n / nl), root((nl - F.size(F.array_distinct("l"))) / nl), root(only("|") / c))
    return df.select("doc_id", "_key", F.when(F.col("n") > 0, x).otherwise(F.array(*[F.lit(0.0)] * len(FEATURES))).alias("x"))


@dataclass
class Discriminant:
    """Per class: mean, Cholesky factor of the shrunk covariance, log determinant, log prior. Features are scaled first."""

    mean: np.ndarray
    scale: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray, float, float]]
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of the log densities."""
        z = (x - self.mean) / self.scale
        dens = {}
        for k, (mu, chol, logdet, prior) in self.classes.items():
            d = np.linalg.solve(chol, (z - mu).T)
            dens[k] = prior - 0.5 * (logdet + (d * d).sum(0))
        if len(dens) < 2:
            return np.full(len(x), float(next(iter(dens), 1)))
        return 1 / (1 + np.exp(-np.clip((dens[1] - dens[0]) / self.temperature, -40, 40)))


def fit(stats: DataFrame, shrink: float = 0.2, ridge: float = 0.05, temperature: float = 2.0) -> Discriminant:
    """Fit on ``stats`` (x, y): sums and products of each class come from one aggregate, so all labelled rows count and only two rows reach the driver.

    A class covariance is mixed with the pooled one (``shrink``) and with the identity (``ridge``), in scaled features, which keeps it
    positive definite however few or equal the rows are. Without any labelled row every score is 1; with one class it is that class.
    """
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    rows = stats.where("y in (0, 1)").groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(p)]).alias("s"),
        F.array(*[F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))) for i, j in pairs]).alias("q")).collect()
    if not rows:
        return Discriminant(np.zeros(p), np.ones(p), {}, temperature)
    n = {r["y"]: r["n"] for r in rows}
    total = sum(n.values())
    mu = {r["y"]: np.array(r["s"]) / r["n"] for r in rows}
    cov = {}
    for r in rows:
        q = np.zeros((p, p))
        for (i, j), v in zip(pairs, r["q"], strict=True):
            q[i, j] = q[j, i] = v / r["n"]
        cov[r["y"]] = q - np.outer(mu[r["y"]], mu[r["y"]])
    mean = sum(n[k] * mu[k] for k in n) / total
    within = sum(n[k] * cov[k] for k in n) / total
    scale = np.sqrt(np.maximum(np.diag(within), 0) + 1e-4)
    pooled = within / np.outer(scale, scale)
    classes = {}
    for k in n:
        s = (1 - shrink) * cov[k] / np.outer(scale, scale) + shrink * pooled
        chol = np.linalg.cholesky((1 - ridge) * s + ridge * np.eye(p))
        classes[k] = ((mu[k] - mean) / scale, chol, 2 * float(np.log(np.diag(chol)).sum()), float(np.log(n[k] / total)))
    return Discriminant(mean, scale, classes, temperature)


def scorer(model: Discriminant):
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist(), dtype=float).reshape(len(x), len(FEATURES))), dtype=float)

    return score


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, quality) of rows not held out.

    Only the text is measured. Null and empty texts score as texts of no words. Labels without 0 or 1, or of no document, are left
    out; a label that is given twice counts twice. Statistics are computed once and written; labels join on narrow rows. Extra columns are dropped.
    """
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "quality")
    stats = cut_lineage(statistics(docs))
    known = stats.where(~held_out(F.col("doc_id"))).join(labels.select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id")
    score = F.pandas_udf(scorer(fit(known)), "double")
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
