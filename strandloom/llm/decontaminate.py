"""Benchmark decontamination by winnowing: minimum k-gram hashes per window, a join of fingerprints, extended hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.runtime import cut_lineage
from strandloom.llm.text import require, row_key

#: Words of a window; of a k-gram; k-grams of a winnowing window. K + W - 1 = WINDOW, so every shared window shares a fingerprint.
WINDOW, K, W = 13, 7, 7
SIDE = WINDOW - K
#: Bytes of text handled at once, whatever the lengths of documents.
PIECE = 1 << 20
#: Words of the last piece that the next one sees again.
CARRY = 2 * WINDOW
#: Bits of the filter of benchmark fingerprints: 1 MiB, whatever the size of the benchmark.
FILTER_BITS = 1 << 23

_B, _C = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
SCHEMA = "key long, row_words long, size int, hash long, pos long, gram array<string>, left array<string>, right array<string>"
ARROW = pa.schema([("key", pa.int64()), ("row_words", pa.int64()), ("size", pa.int32()), ("hash", pa.int64()), ("pos", pa.int64()),
                   ("gram", pa.list_(pa.string())), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])


def _word_bytes() -> np.ndarray:
    ok = np.zeros(256, bool)
    ok[0x30:0x3A] = ok[0x61:0x7B] = ok[0x80:] = True
    return ok


class _Hasher:
    """Polynomial word hashes from prefix sums modulo 2**64; equal words hash alike wherever they stand."""

    def __init__(self) -> None:
        self.ok, self.n = _word_bytes(), 0

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = n
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _B)]), dtype=np.uint64)
            inverse = np.uint64(pow(int(_B), -1, 1 << 64))
            self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]), dtype=np.uint64)

    def words(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = np.zeros(len(buf) + 2, np.int8)
        mark[1:-1] = self.ok[buf]
        step = np.diff(mark)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def hashes(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self.grow(len(buf) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.power[:len(buf)], dtype=np.uint64)])
        return mixed((sums[end] - sums[start]) * self.back[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; the size takes part."""
    out = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        out = out * _C + h[j:len(h) - size + 1 + j]
    return mixed(out + np.uint64(size))


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes], list[bool]]]:
    """Rows gathered to pieces of bounded size; a longer text comes in several, cut where no word is. True: the row goes on."""
    ids, parts, more, held = [], [], [], 0
    ok = _word_bytes()
    for i, text in enumerate(texts):
        data = (text or "").encode().lower()
        if len(data) > PIECE:  # its pieces come in a row and alone, so that each finds the last words of the one before
            start = 0
            while start < len(data):
                end = min(start + PIECE, len(data))
                while end < len(data) and ok[data[end]]:
                    end += 1
                yield [i], [data[start:end]], [end < len(data)]
                start = end
            continue
        ids.append(i)
        parts.append(data)
        more.append(False)
        held += len(data)
        if held >= PIECE:
            yield ids, parts, more
            ids, parts, more, held = [], [], [], 0
    if ids:
        yield ids, parts, more


def fingerprints(sizes: tuple[int, ...], known: bytes | None):
    """The task function: (key, text) batches to one row per text with its number of words (hash null) and one per fingerprint.

    ``sizes`` are lengths of short benchmark items; for them every run of so many words counts, as for an item as short
    as that nothing can be winnowed. With ``known``, only hashes whose bit is set there are returned.
    """
    bits = None if known is None else np.frombuffer(known, np.uint8)

    def seen(h: np.ndarray) -> np.ndarray:
        b = h & np.uint64(FILTER_BITS - 1)
        return (bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def run(batches):
        hasher = _Hasher()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            counted: dict[int, int] = {}
            out: list[tuple] = []
            carry: list[bytes] = []
            for ids, parts, more in _pieces(batch.column(1).to_pylist()):
                again = 0
                if len(ids) == 1 and ids[0] in counted:  # a text goes on: its last words come again
                    again = len(carry)
                    parts = [b" ".join([*carry, parts[0]])]
                data = b" ".join(parts)
                buf = np.frombuffer(data, np.uint8)
                start, end = hasher.words(buf)
                bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
                first = np.searchsorted(start, bounds)  # of each row's words
                row = np.searchsorted(bounds, start, "right") - 1
                shift = [counted.get(i, 0) - again for i in ids]
                for k, i in enumerate(ids):
                    counted[i] = counted.get(i, 0) + int(first[k + 1] - first[k]) - again
                if len(start):
                    carry = [data[a:b] for a, b in zip(start[-CARRY:], end[-CARRY:], strict=True)] if more[-1] else []
                    h = hasher.hashes(buf, start, end)
                    for size in (*sizes, 0):
                        n = size or K
                        if len(h) < (size or WINDOW):
                            continue
                        g = grams(h, n)
                        if size:
                            at = np.flatnonzero(row[:len(g)] == row[n - 1:])
                        else:
                            inside = np.flatnonzero(row[:len(h) - WINDOW + 1] == row[WINDOW - 1:])  # windows within one row
                            keep = np.zeros(len(g), bool)
                            if len(inside):
                                place = _minima(g, inside)
                                keep[place] = True
                            at = np.flatnonzero(keep)
                        if bits is not None and len(at):
                            at = at[seen(g[at])]
                        for p in at.tolist():
                            k = int(row[p])
                            lo, hi = int(first[k]), int(first[k + 1])
                            w = lambda a, b: [data[start[x]:end[x]].decode("utf-8", "replace") for x in range(a, b)]  # noqa: B023, E731
                            out.append((keys[ids[k]], None, size, int(g[p].astype(np.int64)), p - lo + shift[k], w(p, p + n),
                                        [] if size else w(max(lo, p - SIDE), p)[::-1], [] if size else w(p + n, min(hi, p + n + SIDE))))
                            if len(out) >= 50_000:
                                yield _batch(out)
                                out = []
            out += [(keys[i], n, None, None, None, None, None, None) for i, n in counted.items()]
            yield _batch(out)

    return run


def _minima(g: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Rightmost minima of the windows of W hashes that begin at ``windows``."""
    low = g[windows].copy()
    place = windows.copy()
    for j in range(1, W):
        here = g[windows + j]
        place = np.where(here <= low, windows + j, place)
        low = np.minimum(low, here)
    return np.unique(place)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW, strict=True)], schema=ARROW)


def _filter_bits(hashes: DataFrame) -> bytes:
    """A bit per hash, in FILTER_BITS bits: at most FILTER_BITS / 64 rows come to the driver."""
    low = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = (hashes.select(F.shiftright(low, 6).alias("_w"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("_m"))
                  .groupBy("_w").agg(F.bit_or("_m").alias("_m")).collect())
    bits = np.zeros(FILTER_BITS // 64, "<i8")
    for r in rows:
        bits[r["_w"]] = r["_m"]
    return bits.tobytes()


def _run_length(mine: str, theirs: str) -> Column:
    """How many words two lists have in common before the first difference, at most SIDE."""
    out = F.lit(SIDE)
    for j in reversed(range(SIDE)):
        same = F.get(F.col(mine), F.lit(j)) == F.get(F.col(theirs), F.lit(j))
        out = F.when(F.coalesce(same, F.lit(False)), out).otherwise(F.lit(j))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.05) -> DataFrame:
    """(doc_id, _key, n_words, n_hit, n_items, items, items_sha256, contaminated) for every row of ``docs``.

    Words are the runs of digits, letters and characters beyond ASCII after lower-casing A-Z. A window is 13 consecutive words of
    an item, or the whole of a shorter one. A word of a document is hit if it lies in an occurrence of a window.

    Both sides keep the minimum 7-gram hash of every 7 consecutive ones, so each shared window has a fingerprint that both keep, at the
    same place in it. Documents' fingerprints pass a bit filter of fixed size first; the rest meet the benchmark's in a join on the hash,
    and each meeting is extended word by word: 13 equal words or more in a row are a hit. Equal fingerprints with equal surroundings in many items are one
    row until the items are listed. Hit words are counted through 64-word bit masks, so copies of a passage add rows, never pairs.

    Null or empty texts have no words and no hits; items without words have no windows; rows of items that repeat count once; an
    item_id that is null marks words but is not listed. Rows of ``docs`` that repeat id and text each get the same result.
    """
    require(docs, "doc_id", "text")
    require(benchmark, "item_id", "text")
    items = benchmark.select(row_key(F.col("item_id"), F.col("text")).alias("key"), "text")
    names = benchmark.select(row_key(F.col("item_id"), F.col("text")).alias("key"), F.col("item_id").cast("string").alias("item")).distinct()
    short = tuple(range(1, WINDOW))
    marks = cut_lineage(items.mapInArrow(fingerprints(short, None), SCHEMA))
    length = marks.where("hash is null").groupBy("key").agg(F.max("row_words").alias("_len"))
    marks = cut_lineage(marks.where("hash is not null").join(length, "key").where("size = 0 or (size = _len and pos = 0)").drop("row_words", "_len")
                             .withColumn("_ctx", F.md5(F.concat_ws("\x1f", F.col("size").cast("string"), F.array_join("gram", " "), F.array_join("left", " "), F.array_join("right", " ")))))
    sizes = tuple(sorted(r[0] for r in marks.where("size > 0").select("size").distinct().collect()))  # twelve at most
    known = _filter_bits(marks)
    found = cut_lineage(docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text").mapInArrow(fingerprints(sizes, known), SCHEMA))
    contexts = marks.select(F.col("size").alias("_size"), F.col("hash").alias("_hash"), F.col("gram").alias("_gram"), F.col("left").alias("_left"), F.col("right").alias("_right"), "_ctx").dropDuplicates(["_ctx"])
    met = (found.where("hash is not null").join(contexts, (F.col("hash") == F.col("_hash")) & (F.col("size") == F.col("_size")) & (F.col("gram") == F.col("_gram")))
                .withColumns({"_l": F.when(F.col("size") > 0, F.lit(0)).otherwise(_run_length("left", "_left")), "_r": F.when(F.col("size") > 0, F.lit(0)).otherwise(_run_length("right", "_right"))})
                .where(f"size > 0 or _l + _r + {K} >= {WINDOW}")
                .select("key", "_ctx", (F.col("pos") - F.col("_l")).alias("_a"), (F.col("_l") + F.col("_r") + F.when(F.col("size") > 0, F.col("size")).otherwise(F.lit(K))).cast("int").alias("_n")))
    met = cut_lineage(met)
    o = F.expr("cast(_a % 64 as int)")
    chunk = F.expr("_a div 64")
    two = F.array(F.struct(chunk.alias("c"), F.expr("shiftleft(shiftleft(1L, _n) - 1, cast(_a % 64 as int))").alias("m")),
                  F.struct((chunk + 1).alias("c"), F.when(o + F.col("_n") > 64, F.expr("shiftrightunsigned(shiftleft(1L, _n) - 1, 64 - cast(_a % 64 as int))")).otherwise(F.lit(0).cast("long")).alias("m")))
    hit = (met.select("key", "_a", "_n").distinct().select("key", F.explode(F.filter(two, lambda x: x["m"] != 0)).alias("x"))
              .groupBy("key", F.col("x.c").alias("c")).agg(F.bit_or("x.m").alias("m")).groupBy("key").agg(F.sum(F.bit_count("m")).alias("n_hit")))
    of = marks.select("_ctx", F.col("key").alias("_item")).distinct().join(names.withColumnRenamed("key", "_item"), "_item").select("_ctx", "item").where("item is not null").distinct()
    listed = met.select("key", "_ctx").distinct().join(of, "_ctx").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    count = found.where("hash is null").groupBy("key").agg(F.max("row_words").alias("n_words"))
    result = count.join(hit, "key", "left").join(listed, "key", "left").withColumnRenamed("key", "_key")
    ids = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return ids.join(result, "_key").select(
        "doc_id", "_key", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit >= F.col("n_words") * min_share)).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows."""
    bad = contamination(docs, benchmark).where("contaminated").select("_key").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("_key")).join(bad, "_key", "left_anti").select("row.*")
