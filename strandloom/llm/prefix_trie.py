"""Prefix trie of conversations, with subtree totals rolled up band by band.

A node is the set of conversations that agree in their first d turns. Nodes are named by two 64-bit sums (exclusive or) of the
hashes of (position, turn); turns enter by their MD5, so that no text is moved beyond the first step.

Depth-band rollup: depths are cut into bands of ``BAND`` levels. Each node hands its own numbers to its ancestors within the band only,
all bands at once, so no node is copied more than ``BAND`` times. What is then below a band comes from the roots of the next band: their
completed totals go up from the deepest band to the first, one round a band over band roots alone, and are finally handed to the nodes
of the band above them. Depth d costs d / BAND rounds, whatever the number of conversations.

Defined results. Rows without conv_id belong to no conversation. Null roles and texts are empty; null turns come first; rows of one
conversation with equal turns are ordered by the MD5 of role and text. Repeated rows are turns of their own. An empty table gives no
node, not even the root. Further columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.runtime import cut_lineage
from strandloom.llm.text import n_words, require, whole

#: Levels of a band.
BAND = 32
#: Ids of 2**ID_BITS consecutive numbers are joined to one string before they are hashed in order.
ID_BITS = 12
#: Rounds between two cuts of the lineage.
ROUNDS = 8
KEY = ["k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, words): turns numbered from 1 within their conversation."""
    require(conversations, "conv_id", "turn", "role", "text")
    role, text = whole(F.col("role")), whole(F.col("text"))
    slim = (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
                    F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"), n_words(F.col("text")).alias("words")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return slim.select("conv_id", F.row_number().over(order).alias("at"), "digest", "words")


def rebuild(own: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first h turns of conversation c - c % ``group``; h = crc32(c) % ``most``.

    Returns the conversations (conv_id, len_head, h) and their turns. No more than ``most`` - 1 turns of a conversation are gathered,
    and ``group`` conversations at most share them.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = (own.where(F.col("at") < most).groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("at", "digest", "words"))).alias("head")))
    none = F.array().cast("array<struct<at:int,digest:string,words:bigint>>")
    convs = (own.select("conv_id").distinct().withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group}).join(heads, "base", "left")
                .select("conv_id", "h", F.filter(F.coalesce("head", none), lambda t: t["at"] <= F.col("h")).alias("head")))
    given = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.at", "t.digest", "t.words")
    kept = (own.join(convs.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where(F.col("at") > F.col("h"))
               .select("conv_id", (F.col("n") + F.col("at") - F.col("h")).cast("int").alias("at"), "digest", "words"))
    return convs.select("conv_id"), given.unionByName(kept)


def _paths(convs: DataFrame, told: DataFrame, band: int) -> DataFrame:
    """One row per conversation and depth, the root included: the node's key, its parent's, and ``up``, keys of the nodes above it.

    ``up`` reaches to the root of the node's band; for a band's root, to the root of the band above.
    """
    first = convs.select("conv_id", F.lit(0).alias("at"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), F.lit(0).cast("long").alias("words"))
    rest = told.select("conv_id", "at", F.xxhash64(F.lit(1), "at", "digest").alias("x1"), F.xxhash64(F.lit(2), "at", "digest").alias("x2"), "words")
    along = Window.partitionBy("conv_id").orderBy("at")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = first.unionByName(rest).select("conv_id", "at", "words", F.bit_xor("x1").over(so_far).alias("k1"), F.bit_xor("x2").over(so_far).alias("k2"))
    reach = F.when(F.col("at") % band == 0, F.least(F.col("at"), F.lit(band))).otherwise(F.col("at") % band)
    return (keyed.select("*", F.lag("k1").over(along).alias("p1"), F.lag("k2").over(along).alias("p2"), F.lead("at").over(along).isNull().alias("ends"),
                         F.collect_list(F.struct("k1", "k2")).over(along.rowsBetween(-band, -1)).alias("before"))
                 .withColumn("up", F.slice("before", F.size("before") - reach + 1, reach)).drop("before"))


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and piece: the SHA-256 of each key's pieces, comma-joined, streamed without keeping them."""
    key, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
            if (k1, k2) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)], names=["k1", "k2", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=["k1", "k2", "ends_sha256"])


def end_lists(ends: DataFrame, id_bits: int = ID_BITS) -> DataFrame:
    """SHA-256 of each node's ended conversations, ascending. Ids are joined in pieces of bounded size first, so that a node where very many end costs its task few rows."""
    pieces = (ends.groupBy(*KEY, F.shiftright("conv_id", id_bits).alias("piece"))
                  .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")))
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInArrow(_hash_lists, "k1 long, k2 long, ends_sha256 string")


def rollup(nodes: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """(k1, k2, values): sums over each node's subtree. ``nodes`` has k1, k2, at, up and the values, and has been written.

    Values are pre-aggregated before each shuffle, so the root and other much-shared nodes are no hot keys.
    """
    sums = [F.sum(v).alias(v) for v in values]
    carried = [F.col(v) for v in values]
    inner = F.col("at") % band != 0
    above = F.when(inner, F.col("up")).otherwise(F.array().cast(nodes.schema["up"].dataType))
    within = (nodes.select(F.explode(F.concat(F.array(F.struct(*KEY)), above)).alias("k"), *carried)
                   .groupBy("k.k1", "k.k2").agg(*sums))
    deepest = (nodes.agg(F.max("at")).first()[0] or 0) // band
    if deepest == 0:
        return within
    within = cut_lineage(within)
    roots = cut_lineage(nodes.where(~inner & (F.col("at") > 0)).select(*KEY, F.floor(F.col("at") / band).alias("level"), "up").join(within, KEY))
    complete, below = [], None
    for k in range(deepest, 0, -1):
        level = roots.where(F.col("level") == k)
        if below is not None:
            total = level.select(*KEY, *carried).unionByName(below).groupBy(*KEY).agg(*sums)
            level = level.drop(*values).join(total, KEY)
        if (deepest - k) % ROUNDS == ROUNDS - 1:
            level = cut_lineage(level)
        complete.append(level.select("up", *carried))
        below = level.select(F.col("up")[0]["k1"].alias("k1"), F.col("up")[0]["k2"].alias("k2"), *carried).groupBy(*KEY).agg(*sums)
    every = complete[0]
    for part in complete[1:]:
        every = every.unionByName(part)
    lower = every.select(F.explode("up").alias("k"), *carried).select("k.k1", "k.k2", *carried)
    return within.unionByName(lower).groupBy(*KEY).agg(*sums)


def prefix_trie(conversations: DataFrame, band: int = BAND, group: int = 20, most: int = 4) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; see the module for nulls, ties and empty tables.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    convs, told = rebuild(cut_lineage(turns(conversations)), group, most)
    paths = cut_lineage(_paths(convs, told, band))
    grouped = paths.groupBy(*KEY, "at").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
                                            F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("up").alias("up"))
    children = grouped.where(F.col("at") > 0).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(grouped.join(children, KEY, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "n_leaves": F.col("n_children").isNull().cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}))
    totals = rollup(nodes, ["n_leaves", "saved_tokens"], band)
    parents = nodes.where(F.col("n_children") > 0).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = end_lists(paths.where("ends").select(*KEY, "conv_id"))
    return (nodes.drop("n_leaves", "saved_tokens").join(totals, KEY).join(ends, KEY, "left").join(parents, ["p1", "p2"], "left")
                 .select("conv_id", F.col("at").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                         F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
