"""Ranks, prefix sums and positions that never pull one group into one task.

Every helper splits a group along its own order into buckets, adds up the buckets, and
shifts each bucket by the total of those before it. The bucket bounds are quantiles of the
whole table, so no (group, bucket) cell holds more than about ``1 / buckets`` of the rows,
even when one group holds most of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.runtime import cut_lineage, hash_key

POSITION_BITS = 12
# Tables up to this size need no buckets: one task can order all of their rows.
SMALL_ROWS = 1_000_000


def is_small(df: DataFrame) -> bool:
    """Size check of a table that was just written (a count from file footers)."""
    return df.count() <= SMALL_ROWS


def _group(by: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in by] or [F.lit(0)]


def _bucket_count(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(max(partitions, 8), 256)


def with_value_bucket(df: DataFrame, source: DataFrame, value: str, buckets: int | None = None) -> DataFrame:
    """Add ``_bucket``: index of the quantile bucket of ``value`` over all of ``source``.

    The bounds (at most 255 numbers) are fixed before the plan is built: an approximate quantile
    may differ from run to run, and every branch of the plan must cut at the same places.
    """
    n = buckets or _bucket_count(df)
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    row = source.agg(F.percentile_approx(F.col(value).cast("double"), probs, F.lit(20 * n)).alias("b")).first()
    bounds = sorted({b for b in (row["b"] or []) if b == b})
    v = F.col(value).cast("double")

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v > bounds[mid], search(mid + 1, hi)).otherwise(search(lo, mid))

    return df.withColumn("_bucket", search(0, len(bounds)))


def _offsets(totals: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    group = _group(by)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"tot_{m}") for m in measures],
    )


def cumulate(df: DataFrame, by: Sequence[str], value: str, measures: Sequence[str],
             buckets: int | None = None) -> DataFrame:
    """Inclusive prefix sums ``cum_<m>`` along ``value`` and group totals ``tot_<m>``.

    ``df`` must hold one row per (``by``, ``value``): aggregate it first.
    """
    by = list(by)
    df = cut_lineage(df)  # read for the bounds, for the bucket totals, and for the sums
    if is_small(df):
        whole = Window.partitionBy(*_group(by))
        running = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*df.columns, *[F.sum(m).over(running).alias(f"cum_{m}") for m in measures],
                         *[F.sum(m).over(whole).alias(f"tot_{m}") for m in measures])
    split = with_value_bucket(df, df, value, buckets)
    totals = split.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(m) for m in measures])
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = split.join(_offsets(totals, by, measures), [*by, "_bucket"])
    return joined.select(
        *df.columns,
        *[(F.sum(m).over(inside) + F.col(f"_off_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"tot_{m}" for m in measures],
    )


def value_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Average ranks of the distinct values of each group: (by, value, n_ties, rank, tot)."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_ties"))
    cum = cumulate(counts, by, value, ["n_ties"])
    rank = F.col("cum_n_ties") - (F.col("n_ties") - 1) / 2
    return cum.select(*by, value, "n_ties", rank.cast("double").alias("rank"),
                      F.col("tot_n_ties").alias("n_total"))


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Rows with their 1-based average-tie rank inside the group."""
    ranks = value_ranks(df, by, value).select(*by, value, F.col("rank").alias(out))
    return df.join(ranks, [*by, value])


def positions(df: DataFrame, by: Sequence[str], ids: Sequence[str], seed: int = 0,
              out: str = "pos", total: str = "n", key: Column | None = None) -> DataFrame:
    """0-based position of each row in the group's pseudo-random order, and the group size.

    The order key is a hash of the row's own ID, so its leading bits are even buckets. Another
    64-bit hash can be given as ``key``.
    """
    by = list(by)
    keyed = (df.withColumn("_key", hash_key(*ids, seed=seed) if key is None else key)
               .withColumn("_bucket", F.shiftright("_key", 64 - POSITION_BITS)))
    totals = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("c"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key", *ids)
    joined = keyed.join(_offsets(totals, by, ["c"]), [*by, "_bucket"])
    return joined.select(
        *df.columns,
        (F.row_number().over(inside) - 1 + F.col("_off_c")).cast("long").alias(out),
        F.col("tot_c").cast("long").alias(total),
    )


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int,
                  out: str | None = None) -> DataFrame:
    """First ``n`` rows per group. Spark prunes to ``n`` rows per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = df.withColumn(out or "_rn", rank).where(F.col(out or "_rn") <= n)
    return ranked if out else ranked.drop("_rn")


def bh_fdr(df: DataFrame, pval: str, out: str = "qval", by: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg q-values: running minimum of p * n / rank from the largest p down."""
    by = list(by)
    valid = df.where(F.col(pval).isNotNull() & ~F.isnan(pval))
    counts = cut_lineage(valid.groupBy(*by, pval).agg(F.count(F.lit(1)).alias("c")))
    cum = cumulate(counts, by, pval, ["c"])
    raw = cum.withColumn("_raw", F.col(pval) * F.col("tot_c") / F.col("cum_c"))
    if is_small(counts):
        down = Window.partitionBy(*_group(by)).orderBy(F.col(pval).desc()).rowsBetween(Window.unboundedPreceding, 0)
        q = raw.select(*by, pval, F.least(F.min("_raw").over(down), F.lit(1.0)).alias(out))
        return df.join(q, [*by, pval], "left")
    # backward running minimum, again bucket by bucket
    split = with_value_bucket(raw, counts, pval)
    lows = split.groupBy(*by, "_bucket").agg(F.min("_raw").alias("_low"))
    after = Window.partitionBy(*_group(by)).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    lows = lows.select(*by, "_bucket", F.min("_low").over(after).alias("_later"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.col(pval).desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = split.join(lows, [*by, "_bucket"]).select(
        *by, pval, F.least(F.min("_raw").over(inside), F.col("_later"), F.lit(1.0)).alias(out))
    return df.join(q, [*by, pval], "left")


def ordered_positions(df: DataFrame, by: Sequence[str], ids: Sequence[str],
                      out: str = "pos", total: str = "n") -> DataFrame:
    """0-based position inside the group in ascending ``ids`` order (first ID numeric)."""
    by = list(by)
    split = with_value_bucket(df, df, ids[0])
    totals = split.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("c"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*ids)
    joined = split.join(_offsets(totals, by, ["c"]), [*by, "_bucket"])
    return joined.select(*df.columns, (F.row_number().over(inside) - 1 + F.col("_off_c")).cast("long").alias(out),
                         F.col("tot_c").cast("long").alias(total))


def running_sum(df: DataFrame, ids: Sequence[str], measure: str, seed: int = 0,
                lo: str = "lo", total: str = "total") -> DataFrame:
    """Exclusive running sum of the whole numbers ``measure`` over all rows in a fixed pseudo-random order.

    Row r covers [lo, lo + measure) of [0, total): the ranges behind weighted draws. Integers leave no gaps between them.
    """
    keyed = (df.withColumn("_key", hash_key(*ids, seed=seed))
               .withColumn("_bucket", F.shiftright("_key", 64 - POSITION_BITS)))
    totals = keyed.groupBy("_bucket").agg(F.sum(measure).alias("c"))
    inside = Window.partitionBy("_bucket").orderBy("_key", *ids).rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.join(_offsets(totals, [], ["c"]), "_bucket")
    return joined.select(
        *df.columns,
        (F.coalesce(F.sum(measure).over(inside), F.lit(0)) + F.col("_off_c")).cast("long").alias(lo),
        F.col("tot_c").cast("long").alias(total),
    )


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """One row ``q0, q1, ...``: exact linear-interpolated quantiles over all rows.

    Distinct values are counted and prefix-summed in parallel; no reducer sees all of them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    cum = cumulate(counts, [], value, ["c"])

    def at(pos: Column) -> Column:
        inside = (F.col("cum_c") - F.col("c") <= pos) & (pos < F.col("cum_c"))
        return F.max(F.when(inside, F.col(value)))

    out = []
    for i, p in enumerate(probs):
        h = (F.col("tot_c") - 1) * F.lit(float(p))
        lo, hi = at(F.floor(h)), at(F.ceil(h))
        frac = F.max(h - F.floor(h))
        out.append((lo + (hi - lo) * frac).alias(f"q{i}"))
    return cum.agg(*out)
