"""SimHash near-duplicates: fingerprints, an inverted index over byte positions, count filtering, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.runtime import cut_lineage
from strandloom.llm.components import components
from strandloom.llm.text import require, row_key

#: Differing bits of linked fingerprints; bytes of a fingerprint; bytes that two linked ones share at least.
MAX_BITS, BYTES = 3, 8
SHARED = BYTES - MAX_BITS
#: Postings name this many byte positions of the first BYTES - 1, of which linked fingerprints share SHARED - 1 at least.
POSTED = SHARED - 1
#: Postings with more members than this are contracted before they are paired.
HOT = 16
#: Shingles hashed at once.
PIECE = 1 << 15

_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprint_of(text: str | None) -> int:
    """SimHash of one text, as a signed 64-bit number: a bit is set where over half of the shingles' hashes have it."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws))) + np.arange(len(ws))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(ws) - 2)
    last = ends[2:] if len(ws) > 2 else ends[-1:]
    tally, digest, lanes = np.zeros(256 * BYTES, np.int64), xxhash.xxh64_digest, 256 * np.arange(BYTES)
    for i in range(0, n, PIECE):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[i:min(n, i + PIECE)].tolist(), last[i:i + PIECE].tolist(), strict=True)])
        tally += np.bincount((np.frombuffer(raw, np.uint8).reshape(-1, BYTES) + lanes).ravel(), minlength=256 * BYTES)
    ones = np.einsum("kv,vb->kb", tally.reshape(BYTES, 256), _BITS).ravel()
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in text], dtype="int64")


def simhash(text: Column | str) -> Column:
    return F.pandas_udf(_fingerprints, "long")(text)


def byte_at(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (BYTES - 1 - k)).bitwiseAND(F.lit(255))


def shared_bytes(a: str, b: str, positions: range = range(BYTES)) -> Column:
    """The tally: at how many byte positions two fingerprints agree."""
    return sum((byte_at(F.col(a).bitwiseXOR(F.col(b)), k) == 0).cast("int") for k in positions)


def links(prints: DataFrame) -> DataFrame:
    """(a, b) pairs of distinct fingerprints (fp) that suffice to connect all those MAX_BITS or fewer bits apart.

    Fingerprints 3 bits apart share 5 of 8 positional bytes, and so 4 of the first 7. The index posts every fingerprint under each choice of 4 of these
    7 positions with its bytes there (35 postings), so a posting is shared by one in 2**32 unrelated fingerprints. Each pair meets under its first 4 shared
    positions only; its shared bytes are tallied, pairs under 5 of 8 are dropped and the rest verified bit by bit.

    Postings with over HOT members come from dense groups of near copies, whose pairs would grow with the square. Their
    members are contracted first: fingerprints within one bit of the same value are at most two bits apart, so they are linked to the smallest of
    them. Hot postings then pair members of different contracted groups only. No link between different groups is lost.
    """
    seven = range(BYTES - 1)
    choices = list(combinations(seven, POSTED))
    mask = [sum(255 << (8 * (BYTES - 1 - k)) for k in ks) for ks in choices]
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("v")) for c, m in enumerate(mask)])
    posted = cut_lineage(prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.c", "k.v"))
    sizes = posted.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = cut_lineage(posted.join(sizes, ["c", "v"]))
    balls = cut_lineage(contracted(listed.where(F.col("n") > HOT).select("fp").distinct()))
    groups = components(balls) if not balls.isEmpty() else balls.select(F.col("a").alias("node"), F.col("b").alias("root"))
    marked = listed.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("g", F.coalesce("root", "fp"))
    left = marked.select("c", "v", "n", F.col("fp").alias("a"), F.col("g").alias("ga"))
    right = marked.select("c", "v", F.col("fp").alias("b"), F.col("g").alias("gb"))
    code = sum(F.when(byte_at(F.col("a").bitwiseXOR(F.col("b")), k) == 0, F.lit(1 << (BYTES - 2 - k))).otherwise(F.lit(0)) for k in seven)
    own = F.element_at(F.array(*[F.lit(sum(1 << (BYTES - 2 - k) for k in ks)) for ks in choices]), F.col("c") + 1)
    # the pair's posting is its first one if no shared position before the last named one is left out
    named = F.element_at(F.array(*[F.lit(((1 << (BYTES - 1)) - 1) & ~((1 << (BYTES - 2 - ks[-1])) - 1)) for ks in choices]), F.col("c") + 1)
    pairs = left.join(right, ["c", "v"]).where((F.col("a") < F.col("b")) & ((F.col("n") <= HOT) | (F.col("ga") != F.col("gb"))) & (code.bitwiseAND(named) == own))
    near = pairs.where(shared_bytes("a", "b") >= SHARED).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    return near.select("a", "b").union(balls.select("a", "b"))


def contracted(prints: DataFrame) -> DataFrame:
    """(a, b): members of one-bit balls, at most 65 each, linked to the smallest member."""
    centre = F.explode(F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))
    ball = Window.partitionBy("_c")
    return prints.select("fp", centre.alias("_c")).withColumn("_m", F.min("fp").over(ball)).where("fp <> _m").select(F.col("fp").alias("a"), F.col("_m").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, fp, root, fingerprint, component_id, members) for every row of ``docs`` (doc_id, text).

    Texts are lower-cased in A-Z; shingles are three words, repeats included; a shorter text is one shingle; a text without words, a null
    or an empty one has fingerprint 0 and is linked like any other. component_id is the smallest doc_id that can be reached by links
    (null if the component has no id at all). Rows that repeat an id are rows of their own. Documents with equal fingerprints are
    one node, so exact copies, however many, never become pairs. Extra columns are dropped.
    """
    require(docs, "doc_id", "text")
    rows = cut_lineage(docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_key"), simhash("text").alias("fp")))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    roots = components(links(classes.select("fp")))
    found = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    found = cut_lineage(found)
    ids = found.groupBy("root").agg(F.min("_first").alias("component_id"), F.sum("_n").alias("members"))
    return (rows.join(found.join(ids, "root").select("fp", "root", "component_id", "members"), "fp")
                .select("doc_id", "_key", "fp", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "members"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id.

    Of rows that repeat that id, one stays; components without any id keep one row. All but these rare rows stream
    past the list of rows to drop.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = cut_lineage(near_duplicates(docs))
    head = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_key")).alias("x"))
    kept = cut_lineage(head.select(F.col("x._key").alias("_key")).distinct())
    drop = found.join(kept, "_key", "left_anti").select("_key").distinct()
    twice = found.join(kept, "_key", "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_key")
    keyed = docs.select(row.alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("_key")).join(drop, "_key", "left_anti")
    once = keyed.join(twice, "_key", "left_anti")
    again = keyed.join(twice, "_key", "left_semi").dropDuplicates(["_key"])
    return once.select("row.*").union(again.select("row.*"))
