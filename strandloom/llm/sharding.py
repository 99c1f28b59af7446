"""Two-pass external shuffle into shards whose row counts differ by one at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.runtime import cut_lineage, scratch_path
from strandloom.llm.text import require, whole

#: Text and framing bytes that one bucket of the first pass holds on average.
BUCKET_BYTES = 8 << 20
#: Buckets at most; beyond that they grow. It bounds the table of their offsets, which is broadcast (24 bytes a row).
MOST_BUCKETS = 1 << 20


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def scatter_and_shuffle(docs: DataFrame, seed: int = 29, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text") -> DataFrame:
    """Pass 1 scatters rows uniformly into memory-sized buckets by a seeded hash; pass 2 shuffles each bucket and writes it.

    The written table has the columns of ``docs`` and _bucket, _at (place in the bucket). The number of buckets follows from the summed sizes,
    so a bucket stays as large at any scale up to 8 TB, and then grows (100 MB at 100 TB). The hash covers id, text and the scan partition, so that repeated rows spread, too.
    Rows arrive sorted by hash; ``shuffle`` is the seeded Fisher-Yates of the SQL functions, over one array per bucket.
    """
    total = docs.agg(F.sum(record_size(F.col(text_col))).alias("_n")).first()[0] or 0
    n = min(MOST_BUCKETS, max(1, -(-total // bucket_bytes)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = (docs.select(row.alias("_row"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), whole(F.col(text_col)), F.spark_partition_id()).alias("_h"))
                 .withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), F.lit(n)).cast("int")))
    listed = (keyed.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_h")
                   .groupBy("_bucket").agg(F.collect_list("_row").alias("_rows")))
    mixed = listed.select("_bucket", F.posexplode(F.shuffle("_rows", seed)).alias("_at", "_row"))
    return cut_lineage(mixed.select("_bucket", "_at", "_row"))


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 29, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``docs`` with shard and slot: the shuffled buckets in a row, cut into ``n_shards`` runs.

    Shard s has the places ceil(s * N / n) to ceil((s + 1) * N / n) - 1, so counts differ by one at most and slots are gapless. Only
    the buckets' counts are added up (one row per bucket). Null texts have no bytes; empty tables give no rows; columns
    named shard or slot are replaced.
    """
    require(docs, "doc_id", "text")
    placed = scatter_and_shuffle(docs, seed, bucket_bytes)
    counts = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumns({"_base": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_total": F.sum("_n").over(Window.partitionBy())}).select("_bucket", "_base", "_total")
    at = F.col("_base") + F.col("_at")
    out = placed.join(F.broadcast(offsets), "_bucket").withColumn("_pos", at)
    out = out.withColumn("_shard", F.expr(f"cast((_pos * {n_shards}) div _total as int)"))
    first = F.expr(f"(_shard * _total + {n_shards - 1}) div {n_shards}")
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], F.col("_shard").alias("shard"), (F.col("_pos") - first).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str | None = None, n_shards: int = 40, seed: int = 29, bucket_bytes: int = BUCKET_BYTES) -> str:
    """Write the shards as Parquet folders shard=0 .. with rows in slot order; returns the path.

    Rows are dealt by runs of slots, so that a large shard is written by several tasks.
    """
    path = path or scratch_path(docs.sparkSession, "shards")
    sharded = shard(docs, n_shards, seed, bucket_bytes)
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
