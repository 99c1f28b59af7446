"""Many-to-many joins on keys that may be hot on either side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.runtime import hash_key

HOT_ROWS = 1_000_000


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], salt_by: Sequence[str],
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner equi-join in which a key with many left rows is spread over several tasks.

    A key with c left rows is cut into ceil(c / hot_rows) slices; the right rows of that key are
    copied once per slice. Keys below the limit are untouched, and no row is lost or doubled.
    ``salt_by`` names left columns that tell the rows of one key apart.
    """
    on = list(on)
    hot = (left.groupBy(*on).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > hot_rows)
               .select(*on, F.ceil(F.col("_c") / hot_rows).cast("int").alias("_slices")))
    slices = F.coalesce("_slices", F.lit(1))
    l = (left.join(hot, on, "left")
             .withColumn("_slice", F.pmod(hash_key(*salt_by, seed=17), slices).cast("int")).drop("_slices"))
    r = (right.join(hot, on, "left")
              .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices"))
    return l.join(r, [*on, "_slice"]).drop("_slice")


GRID_ROWS = 100_000


def pair_grid(big: DataFrame, small: DataFrame) -> DataFrame:
    """Every row of ``big`` with every row of ``small``, for operators whose result is that grid.

    Up to ``GRID_ROWS`` rows, ``small`` becomes one array that each row of ``big`` explodes, where
    ``big`` lies and without a shuffle. Beyond that Spark's partitioned product is used.
    """
    if small.count() > GRID_ROWS:
        return big.crossJoin(small)
    items = small.agg(F.collect_list(F.struct(*small.columns)).alias("_items")).scalar()
    return big.withColumn("_item", F.explode(items)).select(*big.columns, "_item.*")
