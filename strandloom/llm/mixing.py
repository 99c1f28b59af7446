"""Mixtures with exact token budgets: hash-random keys, ranges of keys within each source, distributed prefix sums, a cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.runtime import cut_lineage
from strandloom.llm.text import n_words, require

#: Ranges of the key per source: hexadecimal digits of the key that name a range.
RANGE_DIGITS = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from one row per source with its size.

    Weights go by code point order of the source, null last, repeating. All sizes are shared by weight; a target stops at
    ``max_epochs`` times its source, and what is left over is shared again by weight. The end of that repeated sharing is
    target = min(cap, level * weight) for one level: sources reach their caps in the order of cap / weight. The windows
    below run over the table of sources only, one row each.
    """
    rank = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1)
    by_ratio = Window.orderBy("_r", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    df = (sources.withColumn("_w", w).withColumn("_cap", (max_epochs * F.col("source_size")).cast("double")).withColumn("_r", F.col("_cap") / F.col("_w"))
                 .withColumns({"_capped": F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0)), "_used": F.coalesce(F.sum("_w").over(by_ratio), F.lit(0.0)),
                               "_total": F.sum("source_size").over(all_rows).cast("double"), "_all": F.sum("_w").over(all_rows)})
                 .withColumn("_level", (F.col("_total") - F.col("_capped")) / (F.col("_all") - F.col("_used"))))
    # a cap below the level raises it and one above lowers it, so the level is the largest
    return df.withColumn("_final", F.max("_level").over(all_rows)).select("source", "source_size", F.least("_cap", F.col("_final") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, seed: int = 11, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, size: Column | None = None) -> DataFrame:
    """What the mixture takes of every row of ``docs`` (doc_id, text, source): size, source_size, target, taken, epochs.

    Each row gets a random key from a hash of seed, id and text. The key's leading digits name one of 4,096 ranges of its source; sizes
    are summed per range before anything is ordered, the ranges' prefix sums place every range in its source, and running
    sums inside a range place every row. Rows before the cut are taken whole, the row on the cut in part, so a
    source's taken words differ from its target by less than one. Where the target exceeds the source, whole passes over
    it (``epochs``) come first. A source with a third of all rows is spread over its 4,096 ranges like any other.

    A null text has size 0 and is taken 0 times; a null source is a source of its own, last in order. Rows that repeat id and text
    tie and are ordered among themselves by size only, which gives the same multiset of results in any run. An empty table gives an empty result.
    Extra columns are dropped.
    """
    require(docs, "doc_id", "text", "source")
    rows = cut_lineage(docs.select("doc_id", "source", (n_words(F.col("text")) if size is None else size).cast("long").alias("size"),
                                   F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))).alias("_key"))
                       .withColumn("_range", F.substring("_key", 1, RANGE_DIGITS)))
    ranges = cut_lineage(rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum")))
    goal = targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_epochs)
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    places = (ranges.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
                    .join(goal.withColumnRenamed("source", "_goal"), F.col("source").eqNullSafe(F.col("_goal")))
                    .select(F.col("source").alias("_s"), F.col("_range").alias("_b"), "_base", "source_size", "target"))
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(places, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_b")))
    out = out.withColumn("epochs", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))).cast("long"))
    budget = F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - F.col("_base") - F.col("_in")))
    return out.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).select("doc_id", "source", "_key", "size", "source_size", "target", "epochs", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it stands."""
    parts = F.split(text, "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])", -1)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(n.cast("int"), F.lit(1))), "")


def mixture(docs: DataFrame, seed: int = 11, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: every row once per pass that takes it, the row on a cut ended there.

    A row that is taken 0 times is absent (also every row without words). Rows of a source that repeat id and text share what the plan
    takes of them: the first copies whole, one in part, so the source's budget is met; copies that differ in other columns go by a hash of these.
    """
    cols = docs.columns
    rest = F.sum(F.col("taken") - F.col("epochs") * F.col("size"))
    plan = (mix(docs, seed, weights, max_epochs).groupBy("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"))
            .agg(F.max("size").alias("_size"), F.max("epochs").alias("_epochs"), rest.alias("_rest")).where((F.col("_epochs") * F.col("_size") > 0) | (F.col("_rest") > 0)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    other = F.xxhash64(*[F.col(f"`{c}`") for c in cols if c not in ("doc_id", "text", "source")] or [F.lit(0)])
    df = docs.select(row.alias("row"), key.alias("_key"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), other.alias("_other")).join(plan, ["_key", "_source"])
    copy = F.row_number().over(Window.partitionBy("_key", "_source").orderBy("_other"))
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("_rest") - (F.col("_copy") - 1) * F.col("_size")))
    df = df.withColumn("_copy", copy).withColumn("_last", last)
    passes = F.concat(F.array_repeat(F.col("_size"), F.col("_epochs").cast("int")), F.when(F.col("_last") > 0, F.array("_last")).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_take", F.explode(passes)).withColumn("_text", F.when(F.col("_take") < F.col("_size"), first_words(F.col("row.text"), F.col("_take"))).otherwise(F.col("row.text")))
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return df.select(*[made[c].alias(c) if c in made else F.col(f"row.`{c}`").alias(c) for c in cols])
