"""Linear models of every skeleton target on its predecessors, from sufficient statistics of bounded blocks.

The L1 models keep an active set per target. A round scores all predecessors of the targets that are not done against their residuals,
where the predecessors lie; the strongest violators of the optimality conditions join the active set, at most ``BLOCK`` a round; each
target's active predecessors meet in one task, which forms their Gram matrix once and runs coordinate descent on it until the
conditions hold. A target is done when no predecessor outside violates them, so the result is the optimum over all. A target with
``BLOCK`` predecessors or fewer is done in the first round. Residuals are rows of a table; nothing of a target reaches the driver.

The other models have closed forms, from the Gram matrix of the predecessors or, where these outnumber the metacells, as
(K + penalty)^-1 y in the space of the metacells, where K adds up over blocks of predecessors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.runtime import cut_lineage

#: Predecessors that join a target's active set in a round, or that one task adds to K.
BLOCK = 512
ROUNDS = 100
#: Metacells whose centred values are held at once while a Gram matrix adds up.
CELLS_AT_ONCE = 4096


def _sorted(ids: pd.Series, values: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """Entries (i, value) of each row by i; a row may have none."""
    out = []
    for i, v in zip(ids, values):
        i, v = (np.zeros(0, np.int64), np.zeros(0)) if i is None else (np.asarray(i, np.int64), np.asarray(v, float))
        order = np.argsort(i, kind="stable")
        i, v = i[order], v[order]
        last = np.append(i[1:] != i[:-1], True)[:len(i)]  # of entries of one place the last counts
        out.append((i[last], v[last]))
    return out


def _dense(ids: pd.Series, values: pd.Series, n: int) -> np.ndarray:
    """Centred vectors over metacells from lists of places and values."""
    x = np.zeros((len(ids), n))
    for row, (i, v) in enumerate(_sorted(ids, values)):
        x[row, i] = v
    return x - x.mean(axis=1, keepdims=True)


def _gram(ids: pd.Series, values: pd.Series, n: int) -> np.ndarray:
    """Products of the centred rows with each other. No row is made dense over more than ``CELLS_AT_ONCE`` metacells."""
    entries = _sorted(ids, values)
    mean = np.array([v.sum() for _, v in entries]) / n
    out = np.zeros((len(entries), len(entries)))
    for lo in range(0, n, CELLS_AT_ONCE):
        x = np.zeros((len(entries), min(CELLS_AT_ONCE, n - lo)))
        for row, (i, v) in enumerate(entries):
            at = slice(*np.searchsorted(i, [lo, lo + x.shape[1]]))
            x[row, i[at] - lo] = v[at]
        x -= mean[:, None]
        out += x @ x.T
    return out


def descend(g: np.ndarray, c: np.ndarray, l1: float, l2: float, start: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Minimum of w'Gw/2 - c'w + l1 |w|_1 + l2 |w|²/2 by coordinate descent, until the optimality conditions hold to ``tol`` times max |c|."""
    w, diag = start.copy(), np.diag(g)
    free = np.flatnonzero(diag > 1e-12 * max(1e-300, diag.max(initial=0.0)))
    w[np.setdiff1d(np.arange(len(w)), free)] = 0.0
    rest = c - g @ w  # correlation with the residual
    limit = tol * max(1e-300, np.abs(c).max(initial=0.0))
    for _ in range(max_iter):
        for j in free:
            old, rho = w[j], rest[j] + diag[j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - l1, 0.0) / (diag[j] + l2)
            if w[j] != old:
                rest -= g[:, j] * (w[j] - old)
        slope = (c - g @ w) - l2 * w
        off = np.where(w != 0, np.abs(slope - l1 * np.sign(w)), np.maximum(np.abs(slope) - l1, 0.0))
        if off[free].max(initial=0.0) <= limit:
            return w
    raise ArithmeticError(f"coordinate descent has not converged in {max_iter} rounds")


def blocked(pairs: DataFrame, block: int) -> DataFrame:
    """(target, source, blk, size): predecessors dealt into blocks of about ``block``."""
    size = pairs.groupBy("target").agg(F.count(F.lit(1)).alias("size"))
    return pairs.join(size, "target").withColumn("blk", F.pmod(F.xxhash64("source", F.lit(31)), F.ceil(F.col("size") / block)).cast("int"))


def sparse_fit(rows: DataFrame, goals: DataFrame, n: int, l1: float, l2: float, max_iter: int, tol: float, block: int = BLOCK) -> DataFrame:
    """(source, target, regr) of the models with an L1 penalty.

    rows: target, source, blk, size, ei, ev (packed predecessors). goals: target, yi, yv (packed). Both have been written.
    """
    def first(batches):
        for pdf in batches:
            for k in range(len(pdf)):  # one dense vector at a time
                yield pd.DataFrame({"target": pdf["target"].iloc[k:k + 1], "r": list(_dense(pdf["yi"].iloc[k:k + 1], pdf["yv"].iloc[k:k + 1], n))})

    def score(batches):
        for pdf in batches:
            # the residual has mean zero, so the predecessor needs no centring
            yield pdf.assign(g=[(v @ np.asarray(r)[i]) / n for (i, v), r in zip(_sorted(pdf["ei"], pdf["ev"]), pdf["r"])])[["target", "source", "g"]]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        goal = pdf["source"].isnull()
        pdf = pd.concat([pdf[~goal].sort_values("source"), pdf[goal]])
        both = _gram(pdf["ei"], pdf["ev"], n) / n
        w = descend(both[:-1, :-1], both[:-1, -1], l1, l2, pdf["w"].to_numpy(dtype=float)[:-1], max_iter, tol)
        rest: list = [None] * len(w)
        if pdf["hub"].iloc[0]:  # only targets with further rounds need their residual
            r = _dense(pdf["ei"].iloc[-1:], pdf["ev"].iloc[-1:], n)[0]
            for (i, v), x in zip(_sorted(pdf["ei"].iloc[:-1], pdf["ev"].iloc[:-1]), w):
                if x:
                    r[i] -= x * v
                    r += x * v.sum() / n
            rest[0] = r
        return pd.DataFrame({"target": pdf["target"].to_numpy()[:-1], "source": pdf["source"].to_numpy()[:-1], "w": w, "r": rest})

    open_ = goals.select("target").join(rows.select("target", "size").distinct(), "target")
    hub = F.col("size") > block
    residual = goals.join(open_.where(hub).select("target"), "target", "left_semi").select("target", "yi", "yv").mapInPandas(first, "target string, r array<double>")
    active = rows.select("target", "source", F.lit(0.0).alias("w")).where(F.lit(False))
    done = None
    top = None
    for number in range(ROUNDS):
        hubs = open_.where(hub)
        work = rows.join(hubs.select("target"), "target", "left_semi")
        parts = work.select("target", "blk").distinct()
        spread = parts.join(residual, "target")  # a residual goes to the blocks of its target, so that a hub is many tasks
        scored = work.select("target", "source", "blk", "ei", "ev").join(spread, ["target", "blk"]).select("target", "source", "ei", "ev", "r")
        scores = cut_lineage(scored.mapInPandas(score, "target string, source string, g double"))
        if number == 0:
            top = cut_lineage(scores.groupBy("target").agg((F.max(F.abs("g")) * tol).alias("slack")))
        inactive = scores.join(active.select("target", "source"), ["target", "source"], "left_anti").join(top, "target")
        strongest = Window.partitionBy("target").orderBy(F.abs("g").desc(), "source")
        joining = (inactive.where(F.abs("g") > l1 + F.col("slack")).withColumn("_r", F.row_number().over(strongest)).where(F.col("_r") <= block)
                           .select("target", "source", F.lit(0.0).alias("w")))
        if number == 0:  # small targets: all predecessors at once
            joining = joining.unionByName(rows.where(F.col("size") <= block).select("target", "source", F.lit(0.0).alias("w")))
        joining = cut_lineage(joining)
        moving = cut_lineage(joining.select("target").distinct())
        settled = active.join(moving, "target", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if moving.isEmpty():
            break
        now = active.join(moving, "target", "left_semi").unionByName(joining)
        known = now.join(rows.select("target", "source", "ei", "ev", hub.alias("hub")), ["target", "source"]).select("target", "source", "w", "ei", "ev", "hub")
        wanted = goals.join(open_, "target").join(moving, "target", "left_semi")  # the target itself is the row without a source
        met = known.unionByName(wanted.select("target", F.lit(None).cast("string").alias("source"), F.lit(0.0).alias("w"), F.col("yi").alias("ei"), F.col("yv").alias("ev"), hub.alias("hub")))
        solved = cut_lineage(met.groupBy("target").applyInPandas(solve, "target string, source string, w double, r array<double>"))
        small = solved.join(open_.where(F.col("size") <= block).select("target"), "target", "left_semi")
        done = done.unionByName(small.select("target", "source", "w"))
        kept = open_.where(F.col("size") > block).join(moving, "target", "left_semi")
        # nothing that was zero has to stay in the active set; the conditions are tested anew for it
        active = cut_lineage(solved.join(kept.select("target"), "target", "left_semi").where((F.col("w") != 0) | F.col("r").isNotNull()))
        residual = active.where(F.col("r").isNotNull()).select("target", "r")
        active = active.select("target", "source", "w")
        open_ = cut_lineage(kept)
    else:
        raise ArithmeticError(f"active sets have not settled in {ROUNDS} rounds")
    found = done.select("target", "source", F.col("w").alias("regr"))
    return rows.select("source", "target").join(found, ["source", "target"], "left").select("source", "target", F.coalesce("regr", F.lit(0.0)).alias("regr"))


def closed_fit(rows: DataFrame, goals: DataFrame, n: int, penalty: float, block: int = BLOCK) -> DataFrame:
    """(source, target, regr) of ridge regression with the penalty, or of least squares of smallest norm without one.

    A target with ``block`` predecessors or fewer, or fewer than metacells, is solved from their Gram matrix; pairs of blocks form its
    parts. Another one is solved in the space of the metacells. So the matrix of a target is as small as it can be.
    """
    def weights(g: np.ndarray, c: np.ndarray) -> np.ndarray:
        if penalty > 0:
            return np.linalg.solve(g + penalty * np.eye(len(g)), c)
        return np.linalg.pinv(g, rcond=1e-12, hermitian=True) @ c

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        goal = pdf["blk"] < 0
        pdf = pd.concat([pdf[~goal], pdf[goal]])
        both = _gram(pdf["ei"], pdf["ev"], n)
        return pd.DataFrame({"source": pdf["source"].iloc[:-1], "target": pdf["target"].iloc[:-1], "regr": weights(both[:-1, :-1], both[:-1, -1])})

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(own=pdf["blk"] == pdf["a"], goal=pdf["blk"] < 0).sort_values(["goal", "own", "source"])
        both, own, goal = _gram(pdf["ei"], pdf["ev"], n), pdf["own"].to_numpy(), pdf["goal"].to_numpy()
        a, b = (own & ~goal, ~goal) if pdf["a"].iloc[0] == pdf["b"].iloc[0] else (own & ~goal, ~own & ~goal)
        return pd.DataFrame({"target": pdf["target"].iloc[:1], "a": pdf["a"].iloc[:1], "b": pdf["b"].iloc[:1], "names": [pdf["source"].to_numpy()[a]],
                             "g": [both[np.ix_(a, b)].astype("<f8").tobytes()], "c": [both[a][:, goal].ravel()]})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["a"] == pdf["b"]].sort_values("a")
        size = own["names"].map(len).to_numpy()
        at = dict(zip(own["a"], np.cumsum(size) - size))
        wide = dict(zip(own["a"], size))
        g = np.zeros((size.sum(), size.sum()))
        for a, b, x in zip(pdf["a"], pdf["b"], pdf["g"]):
            rows_, cols = slice(at[a], at[a] + wide[a]), slice(at[b], at[b] + wide[b])
            g[rows_, cols] = np.frombuffer(x).reshape(wide[a], wide[b])
            g[cols, rows_] = g[rows_, cols].T
        return pd.DataFrame({"source": np.concatenate(own["names"].to_list()), "target": pdf["target"].iloc[0], "regr": weights(g, np.concatenate(own["c"].to_list()))})

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _dense(pdf["ei"], pdf["ev"], n)
        return pd.DataFrame({"target": [pdf["target"].iloc[0]], "blk": [int(pdf["blk"].iloc[0])], "k": [(x.T @ x).astype("<f8").tobytes()]})

    def dual(pdf: pd.DataFrame) -> pd.DataFrame:
        y, total = _dense(pdf["yi"].iloc[:1], pdf["yv"].iloc[:1], n)[0], np.zeros((n, n))
        for k in pdf.sort_values("blk")["k"]:
            total += np.frombuffer(k).reshape(n, n)
        return pd.DataFrame({"target": [pdf["target"].iloc[0]], "a": [weights(total, y)]})

    def weigh(batches):
        for pdf in batches:
            a = np.stack(pdf["a"].to_numpy()) if len(pdf) else np.zeros((0, n))
            yield pdf.assign(regr=(_dense(pdf["ei"], pdf["ev"], n) * a).sum(axis=1))[["source", "target", "regr"]]

    schema = "source string, target string, regr double"
    few, wide = F.col("size") <= block, (F.col("size") > block) & (F.col("size") >= n)
    sizes = rows.select("target", "size").distinct()
    goal = goals.join(sizes, "target").select("target", "size", F.lit(None).cast("string").alias("source"), F.lit(-1).alias("blk"), F.col("yi").alias("ei"), F.col("yv").alias("ev"))
    alike = rows.where(F.col("target").isNotNull()).select(*goal.columns).unionByName(goal)  # the target itself has block -1
    out = alike.where(few).groupBy("target").applyInPandas(small, schema)
    if not sizes.where(~few & ~wide).isEmpty():
        blocks = F.ceil(F.col("size") / block).cast("int")
        other = F.explode(F.sequence(F.lit(0), blocks - 1))
        hubs = alike.where(~few & ~wide).withColumn("o", other)
        paired = hubs.withColumn("a", F.when(F.col("blk") < 0, F.col("o")).otherwise(F.least("blk", "o"))).withColumn("b", F.when(F.col("blk") < 0, F.col("o")).otherwise(F.greatest("blk", "o")))
        parts = cut_lineage(paired.select("target", "source", "blk", "a", "b", "ei", "ev").groupBy("target", "a", "b").applyInPandas(part, "target string, a int, b int, names array<string>, g binary, c array<double>"))
        out = out.unionByName(parts.groupBy("target").applyInPandas(gather, schema))
    if not sizes.where(wide).isEmpty():
        many = rows.where(wide)
        parts = many.groupBy("target", "blk").applyInPandas(kernel, "target string, blk int, k binary")
        solved = cut_lineage(parts.join(goals, "target").groupBy("target").applyInPandas(dual, "target string, a array<double>"))
        spread = many.select("target", "blk").distinct().join(solved, "target")
        out = out.unionByName(many.select("target", "source", "blk", "ei", "ev").join(spread, ["target", "blk"]).mapInPandas(weigh, schema))
    return out
