"""Session-level helpers: lineage cuts, shared scratch folders, scalar subqueries, hash keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandloom-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table that is read more than once to the shared folder and read it back.

    The plan restarts from Parquet: columns can be pruned, sizes are known to the join planner, and
    a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_key(*cols: Column | str, seed: int = 0) -> Column:
    """64-bit order key that depends on the row only, never on partitioning."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed))


def hash_uniform(*cols: Column | str, seed: int = 0) -> Column:
    """Deterministic uniform number in [0, 1) from the row's identity."""
    return F.shiftrightunsigned(hash_key(*cols, seed=seed), 11) / F.lit(float(1 << 53))


def scalar(df: DataFrame, expr: Column) -> Column:
    """An aggregate of ``df`` as an uncorrelated scalar subquery."""
    return df.agg(expr.alias("_scalar")).scalar()


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def raise_if(cond: Column, message: str, value: Column) -> Column:
    """``value``, or a run-time error with ``message`` where ``cond`` holds."""
    return F.when(cond, F.raise_error(F.lit(message))).otherwise(value)
