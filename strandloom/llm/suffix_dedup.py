"""Removal of byte strings that already occur in a document with a smaller id, by prefix-free parsing.

Triggers. Every window of ``WINDOW`` bytes has a rolling hash. In each string of ``length`` bytes the window of least hash (the first of
equal ones) is its trigger, which depends on the string's bytes alone. Strings that start one after the other and share their trigger make
a phrase: it runs from the first string's start to the last one's end, so phrases overlap by length - 1 bytes, and a document is parsed
alike wherever its bytes stand.

Dictionary and parse. The dictionary holds distinct phrases with the smallest id of a document that has them; the parse says which
phrase begins where. Corpus order is wanted up to ``length`` bytes only, and because of the overlap each such prefix lies within one
phrase: the suffix array of the dictionary alone orders it, while the parse tells the documents of each place. (The parse's own suffix
array orders places whose first ``length`` bytes agree, which are one match here.) A phrase whose trigger starts no other phrase has its
suffixes to itself, so it needs no sorting: its smallest id decides. Only phrases that share their trigger with a different phrase have
their suffixes sorted, on their bytes, in the bucket of the trigger; neighbours that agree in ``length`` bytes are one match.

On Spark. Documents are dealt into batches of about ``BATCH_BYTES``; a batch sends one packed row per bucket of triggers, with one entry
per distinct trigger (pre-aggregated, so a passage in every document costs one entry a batch), and gets back what others know of its entries.
Batches, buckets and answers are bounded by their bytes; a trigger with very many phrases is spread over buckets by the suffix itself.

Defined results. A null text is empty. Strings count as bytes of UTF-8, so a cut may fall inside a character. Documents without an id come
after all others and not before one another; documents with equal ids (repeated rows too) never remove from one another. Two phrases count
as equal when two 64-bit hashes agree. Empty tables give no rows. Other columns, whatever their names, come back in ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.runtime import cut_lineage
from strandloom.llm.text import require, row_key, whole

#: Bytes of a match, and of a trigger window. The places of a phrase fit in a mask of 32 bits if they differ by 31 at most.
LENGTH, WINDOW = 50, 24
#: Text of a batch; bytes hashed at once; triggers of a bucket on average; bytes of a shuffle partition.
BATCH_BYTES, CHUNK_BYTES, BUCKET_ENTRIES, PARTITION_BYTES = 2 << 20, 1 << 17, 1 << 18, 64 << 20
#: Phrases of one trigger beyond which their suffixes are spread over buckets.
HOT_PHRASES = 1 << 15
NO_ID = np.iinfo(np.int64).max

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_CODES = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Set in the hash of a single phrase; an entry without it counts several phrases of one trigger.
SINGLE = np.uint64(1 << 63)
AMBIGUOUS, HOT = 1, 2


# --- parsing --------------------------------------------------------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _rolling(codes: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hash of every window, from those of half the size."""
    out, size, power, have = None, 1, BASE, codes
    have_size = 0
    while window:
        if window & 1:
            if out is None:
                out, have_size = have, size
            else:  # the part of ``have`` comes first, then what has been put together
                out = have[:len(out) - size] * np.uint64(pow(BASE, have_size, 1 << 64)) + out[size:]
                have_size += size
        window >>= 1
        if window:
            have = have[:-size] * np.uint64(power) + have[size:]
            power, size = power * power % (1 << 64), 2 * size
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:len(x) - size], x[size:]), 2 * size
    rest = width - size
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _TABLES:
        _TABLES[size] = _powers(BASE, size), _powers(BASE_INVERSE, size)
    return _TABLES[size]


def _parse_chunk(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, window: int) -> tuple[np.ndarray, ...]:
    """(at, count, trigger, phrase) of the pieces data[lo:hi], which lie one after the other: first place, number of places, two hashes."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(data) < length:
        return none
    codes = BYTE_CODES[data]
    hashes = _mixed(_rolling(codes, window))
    least = _least(hashes, length - window + 1)
    valid = np.ones(len(least) + length, dtype=bool)
    valid[len(least):] = False
    tails = hi[:, None] - np.arange(1, length)[None, :]
    valid[tails[tails >= 0]] = False
    valid = valid[:len(least)]
    begins = np.zeros(len(least), dtype=bool)
    begins[lo[lo < len(least)]] = True
    begins[1:] |= (least[1:] != least[:-1]) | (hashes[:len(least) - 1] == least[:-1])
    at = np.flatnonzero(begins & valid)
    if not len(at):
        return none
    piece = np.searchsorted(lo, at, "right") - 1
    count = np.minimum(np.append(at[1:], len(least)), hi[piece] - length + 1) - at
    powers, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(codes * powers[:len(data)], out=sums[1:])
    phrase = _mixed((sums[at + count + length - 1] - sums[at]) * inverse[at] + count.astype(np.uint64))
    return at, count, _mixed(least[at]), phrase | SINGLE


@dataclass
class Phrases:
    """The parse of a batch: document, place in the batch's bytes, number of places, hashes of trigger and phrase. Sorted by trigger, phrase."""

    doc: np.ndarray
    at: np.ndarray
    count: np.ndarray
    trigger: np.ndarray
    phrase: np.ndarray


def parse(data: np.ndarray, ends: np.ndarray, length: int, window: int, chunk: int = CHUNK_BYTES) -> Phrases:
    """Phrases of documents that lie one after the other in ``data`` and end at ``ends``; texts beyond a chunk are parsed in overlapping pieces."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    found: list[tuple] = []
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + chunk, "right")))
        first, last = int(starts[at]), int(ends[to - 1])
        if to == at + 1:
            for p in range(first, max(last - length + 1, first), chunk):
                size = min(last, p + chunk + length - 1) - p
                a, *rest = _parse_chunk(data[p:p + size], np.array([0]), np.array([size]), length, window)
                found.append((np.full(len(a), at), a + p, *rest))
        else:
            lo, hi = starts[at:to] - first, ends[at:to] - first
            a, *rest = _parse_chunk(data[first:last], lo, hi, length, window)
            found.append((at + np.searchsorted(lo, a, "right") - 1, a + first, *rest))
        at = to
    if not found:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    doc, place, count, trigger, phrase = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(trigger)
    trigger = trigger[order]
    same = np.flatnonzero(trigger[1:] == trigger[:-1])
    if len(same):  # phrases of one trigger in order, too
        tied = np.unique(np.concatenate([same, same + 1]))
        order[tied] = order[tied][np.lexsort((phrase[order[tied]], trigger[tied]))]
    return Phrases(doc[order], place[order], count[order], trigger, phrase[order])


# --- batches of documents and the rows that answer them -------------------------------------------------------------------------------

def _packed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compresses well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def _unpacked(body: np.ndarray, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(body.reshape(size, -1).T).view(dtype).ravel()


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and their ends."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8), offsets[1:] - offsets[0]


class Batch:
    """Documents of one batch, each distinct one once, and the answers to it. Rows come sorted by tag and key."""

    def __init__(self, number: int) -> None:
        self.number, self.answers, self.last = number, {0: [], 1: []}, None
        self._data: list[np.ndarray] = []
        self._sizes: list[np.ndarray] = []
        self._ids: list[np.ndarray] = []
        self._of: list[np.ndarray] = []
        self.rows: list[pa.Array] = []
        self.n = 0

    def add(self, part: pa.RecordBatch) -> None:
        tag = part.column("tag").to_numpy()
        told = int((tag < 2).sum())
        for t, body in zip(tag[:told].tolist(), part.column("body").slice(0, told).to_pylist()):
            self.answers[t].append(np.frombuffer(body, np.uint8))
        part = part.slice(told)
        if not part.num_rows:
            return
        key = part.column("key").to_numpy()
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = self.last is None or key[0] != self.last
        self.last = key[-1]
        self._of.append(self.n - 1 + np.cumsum(new))
        self.n += int(new.sum())
        body = part.column("body")
        data, ends = _binary(body if new.all() else body.filter(pa.array(new)))
        self._data.append(data.copy())
        self._sizes.append(np.diff(ends, prepend=0))
        self._ids.append(part.column("id").to_numpy()[new])
        if "row" in part.schema.names:
            self.rows.append(part.column("row"))

    def load(self, length: int, window: int, chunk: int) -> Batch:
        self.of = np.concatenate(self._of) if self._of else np.zeros(0, np.int64)
        self.data = np.concatenate(self._data) if self._data else np.zeros(0, np.uint8)
        self.sizes = np.concatenate(self._sizes) if self._sizes else np.zeros(0, np.int64)
        self.ids = np.concatenate(self._ids) if self._ids else np.zeros(0, np.int64)
        self._data = []
        self.found = parse(self.data, np.cumsum(self.sizes), length, window, chunk)
        self.id_of = self.ids[self.found.doc]
        self.begins = np.flatnonzero(np.append(True, self.found.trigger[1:] != self.found.trigger[:-1])[:len(self.found.trigger)])
        return self


def _each(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """Runs of equal values of a sorted column, and whether a run starts a new value."""
    last = None
    for batch in batches:
        if batch.num_rows:
            value = batch.column(column).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                yield int(value[lo]), batch.slice(lo, hi - lo), value[lo] != last
                last = value[lo]


def _document_batches(batches: Iterator[pa.RecordBatch], *sizes: int) -> Iterator[Batch]:
    now: Batch | None = None
    for number, part, new in _each(batches, "batch"):
        if new:
            if now is not None:
                yield now.load(*sizes)
            now = Batch(number)
        now.add(part)
    if now is not None:
        yield now.load(*sizes)


REQUEST = "bucket long, batch long, base int, n int, body binary"
ANSWER = "batch long, tag int, body binary"


def _rows(columns: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*columns)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[f for f, _ in fields])


def _by_bucket(bucket: np.ndarray, batch: int, body: Callable[[int, int], bytes]) -> pa.RecordBatch:
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]).tolist() if len(bucket) else [0]
    return _rows([(int(bucket[lo]), batch, lo, hi - lo, body(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:])], REQUEST)


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


# --- first exchange: what is known of each trigger ------------------------------------------------------------------------------------

def ask_triggers(b: Batch, n_buckets: int) -> pa.RecordBatch:
    """One entry per distinct trigger of the batch: its phrase, or how many it starts, and the smallest id."""
    p, at = b.found, b.begins
    if not len(at):
        return _rows([], REQUEST)
    differs = np.append(True, (p.phrase[1:] != p.phrase[:-1]) | (p.trigger[1:] != p.trigger[:-1]))
    kinds = np.add.reduceat(differs.astype(np.uint64), at)
    trigger, entry, first = p.trigger[at], np.where(kinds == 1, p.phrase[at], kinds), np.minimum.reduceat(b.id_of, at)
    return _by_bucket(_bucket(trigger, n_buckets), b.number, lambda lo, hi: b"".join(_packed(x[lo:hi]) for x in (trigger, entry, first)))


def _answers(rows: list[dict], owner: np.ndarray, tag: int, *columns: np.ndarray) -> list[tuple]:
    """Numbers per owning request, packed."""
    order = np.argsort(owner, kind="stable")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(owner[order])) + 1, [len(order)]]).tolist() if len(order) else [0]
    return [(rows[int(owner[order[lo]])]["batch"], tag, b"".join(c[order[lo:hi]].tobytes() for c in columns)) for lo, hi in zip(edges[:-1], edges[1:])]


def meet_triggers(rows: list[dict], hot: int) -> list[tuple]:
    """Per entry whose trigger others have, too: smallest id of its only phrase, or that its suffixes must be sorted."""
    cut = [np.frombuffer(r["body"], np.uint8).reshape(3, -1) for r in rows]
    trigger, entry, first = (np.concatenate([_unpacked(c[i], t) for c in cut]) for i, t in enumerate((np.uint64, np.uint64, np.int64)))
    owner = np.repeat(np.arange(len(rows)), [r["n"] for r in rows])
    index = np.concatenate([np.arange(r["base"], r["base"] + r["n"], dtype=np.uint32) for r in rows])
    order = np.argsort(trigger)
    begins = np.flatnonzero(np.append(True, trigger[order][1:] != trigger[order][:-1]))
    size = np.diff(np.append(begins, len(order)))
    order, size = order[np.repeat(size > 1, size)], size[size > 1]
    if not len(size):
        return []
    begins = np.cumsum(size) - size
    entry, first = entry[order], first[order]
    low, high, least = np.minimum.reduceat(entry, begins), np.maximum.reduceat(entry, begins), np.minimum.reduceat(first, begins)
    load = np.add.reduceat(np.where(entry & SINGLE, np.uint64(1), entry), begins)
    state = np.where((low == high) & (low & SINGLE != 0), 0, np.where(load > hot, HOT, AMBIGUOUS)).astype(np.uint8)
    state, least = np.repeat(state, size), np.repeat(least, size)
    tell = (state > 0) | (least < first)
    return _answers(rows, owner[order][tell], 0, index[order][tell], state[tell], least[tell])


# --- second exchange: suffixes of the phrases that share their trigger with other phrases ---------------------------------------------

@dataclass
class Open:
    """What the first exchange leaves: places settled whole by it, and open occurrences, each of a distinct open phrase (``of``)."""

    settled: np.ndarray
    at: np.ndarray
    count: np.ndarray
    ids: np.ndarray
    of: np.ndarray
    head: np.ndarray
    first: np.ndarray
    bucket: np.ndarray


def _string_hash(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    powers, out = _tables(length)[0][:length], np.zeros(len(at), np.uint64)
    for lo in range(0, len(at), 1 << 14):
        out[lo:lo + (1 << 14)] = (BYTE_CODES[data[at[lo:lo + (1 << 14), None] + np.arange(length)]] * powers).sum(axis=1, dtype=np.uint64)
    return _mixed(out)


def open_phrases(b: Batch, n_buckets: int, length: int) -> Open:
    """Applies the first answers. The phrases of a hot trigger are cut into strings of one place each, dealt out by their bytes."""
    p, begins = b.found, b.begins
    if not len(begins):
        none = np.zeros(0, np.int64)
        return Open(none, none, none, none, none, none, none, none)
    size = np.diff(np.append(begins, len(p.at)))
    least, most = np.minimum.reduceat(b.id_of, begins), np.maximum.reduceat(b.id_of, begins)
    several = p.phrase[begins] != p.phrase[begins + size - 1]
    state = np.where(several & (least < most), AMBIGUOUS, 0).astype(np.uint8)
    for body in b.answers[0]:
        n = len(body) // 13
        index, told, first = body[:4 * n].view(np.uint32), body[4 * n:5 * n], body[5 * n:].copy().view(np.int64)
        state[index], least[index] = told, np.minimum(least[index], first)
    of_run = np.repeat(state, size)
    settled = np.flatnonzero((of_run == 0) & (b.id_of > np.repeat(least, size)) & ~np.repeat(several, size))
    plain, hot = np.flatnonzero(of_run == AMBIGUOUS), np.flatnonzero(of_run == HOT)
    each = np.repeat(hot, p.count[hot])
    place = p.at[each] + np.arange(len(each)) - np.repeat(np.cumsum(p.count[hot]) - p.count[hot], p.count[hot])
    at, count = np.concatenate([p.at[plain], place]), np.concatenate([p.count[plain], np.ones(len(each), np.int64)])
    ids = np.concatenate([b.id_of[plain], b.id_of[each]])
    strings = _string_hash(b.data, place, length)
    deal, name = np.concatenate([p.trigger[plain], strings]), np.concatenate([p.phrase[plain], strings])
    single = np.concatenate([np.zeros(len(plain), bool), np.ones(len(each), bool)])
    order = np.lexsort((single, name, deal))
    at, count, ids, deal, name, single = (x[order] for x in (at, count, ids, deal, name, single))
    if not len(at):
        return Open(settled, at, count, ids, at, at, at, at)
    head = np.flatnonzero(np.append(True, (deal[1:] != deal[:-1]) | (name[1:] != name[:-1]) | (single[1:] != single[:-1])))
    of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(at))))
    return Open(settled, at, count, ids, of, head, np.minimum.reduceat(ids, head), _bucket(deal[head], n_buckets))


def _gathered(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[at:at + size], one after the other."""
    ends = np.cumsum(size)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - size), size)]


def ask_suffixes(b: Batch, n_buckets: int, length: int) -> pa.RecordBatch:
    """The batch's distinct open phrases with their smallest ids."""
    o = open_phrases(b, n_buckets, length)
    at, count = o.at[o.head], o.count[o.head]

    def body(lo: int, hi: int) -> bytes:
        return _packed(o.first[lo:hi]) + count[lo:hi].astype(np.uint8).tobytes() + _gathered(b.data, at[lo:hi], count[lo:hi] + length - 1).tobytes()

    return _by_bucket(o.bucket, b.number, body)


def sort_suffixes(rows: list[dict], length: int) -> list[tuple]:
    """Suffix array, to ``length`` bytes, of the bucket's dictionary of open phrases; per phrase, the places that a smaller id has, too."""
    first, count, text = [], [], []
    for r in rows:
        body, n = np.frombuffer(r["body"], np.uint8), r["n"]
        first.append(_unpacked(body[:8 * n], np.int64))
        count.append(body[8 * n:9 * n].astype(np.int64))
        text.append(body[9 * n:])
    first, count, text = np.concatenate(first), np.concatenate(count), np.concatenate(text)
    owner = np.repeat(np.arange(len(rows)), [r["n"] for r in rows])
    index = np.concatenate([np.arange(r["base"], r["base"] + r["n"], dtype=np.uint32) for r in rows])
    size = count + length - 1
    width = 1 + int(size.max())
    padded = np.zeros((len(size), width), np.uint8)  # the count comes first, so phrases of different lengths differ whatever the padding
    padded[:, 0] = count
    line = np.repeat(np.arange(len(size)), size)
    padded[line, 1 + np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)] = text
    _, head, of = np.unique(padded.view(f"S{width}").ravel(), return_index=True, return_inverse=True)
    smallest = np.full(len(head), NO_ID)
    np.minimum.at(smallest, of, first)
    phrase = np.repeat(np.arange(len(head)), count[head])
    place = np.arange(len(phrase)) - np.repeat(np.cumsum(count[head]) - count[head], count[head])
    suffix = np.lib.stride_tricks.sliding_window_view(padded, length, axis=1)[head[phrase], place + 1].copy().view(f"S{length}").ravel()
    order = np.argsort(suffix, kind="stable")
    begins = np.flatnonzero(np.append(True, suffix[order][1:] != suffix[order][:-1]))
    least = np.repeat(np.minimum.reduceat(smallest[phrase[order]], begins), np.diff(np.append(begins, len(order))))
    earlier = least < smallest[phrase[order]]
    mask = np.zeros(len(head), np.uint32)
    np.bitwise_or.at(mask, phrase[order][earlier], np.uint32(1) << place[order][earlier].astype(np.uint32))
    every = ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    found = np.where(first > smallest[of], every, mask[of])
    tell = found > 0
    return _answers(rows, owner[tell], 1, index[tell], found[tell])


# --- the result -----------------------------------------------------------------------------------------------------------------------

def removed(b: Batch, n_buckets: int, length: int) -> np.ndarray:
    """Which bytes of the batch go."""
    o, p = open_phrases(b, n_buckets, length), b.found
    mask = np.zeros(len(o.head), np.uint32)
    for body in b.answers[1]:
        n = len(body) // 8
        mask[body[:4 * n].view(np.uint32)] = body[4 * n:].copy().view(np.uint32)
    whole_ = o.ids > o.first[o.of] if len(o.of) else np.zeros(0, bool)
    part = np.flatnonzero(~whole_ & (mask[o.of] > 0)) if len(o.of) else np.zeros(0, np.int64)
    place, bit = np.nonzero(mask[o.of[part], None] >> np.arange(32, dtype=np.uint32) & np.uint32(1)) if len(part) else (part, part)
    at = np.concatenate([p.at[o.settled], o.at[whole_], o.at[part][place] + bit])
    to = np.concatenate([p.at[o.settled] + p.count[o.settled], o.at[whole_] + o.count[whole_], o.at[part][place] + bit + 1]) + length - 1
    steps = np.zeros(len(b.data) + 1, np.int32)
    np.add.at(steps, at, 1)
    np.subtract.at(steps, to, 1)
    return np.cumsum(steps[:-1]) > 0


def _result(b: Batch, gone: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(b.sizes)
    starts = ends - b.sizes
    edge = np.zeros(len(gone) + 1, bool)
    edge[starts] = True  # a run ends with its document
    before = np.append(False, gone[:-1]) if len(gone) else gone
    begin = np.flatnonzero(gone & (~before | edge[:-1]))
    stop = np.flatnonzero(gone & (~np.append(gone[1:], False) | edge[1:])) + 1 if len(gone) else begin
    doc = np.searchsorted(ends, begin, "right")
    cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.n))]), pa.int32())
    spans = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(begin - starts[doc], pa.int64()), pa.array(stop - starts[doc], pa.int64())], names=["start", "end"]))
    left = np.append(0, np.cumsum(~gone))
    kept = pa.Array.from_buffers(pa.binary(), b.n, [None, pa.py_buffer(np.append(left[starts], left[-1]).astype(np.int32).tobytes()), pa.py_buffer(b.data[~gone].tobytes())])
    of = pa.array(b.of)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(b.rows), pa.array(b.sizes[b.of], pa.int64()), spans.take(of), kept.take(of)], names=["row", "n_bytes", "spans", "kept"])


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While a table is being written, its shuffle files go as soon as it stands; they would lie on the executors' disks until the end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs``: row (its other columns), n_bytes, spans (array<struct<start, end>> of removed bytes, maximal runs), kept (binary).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id. See the module for nulls, ties and repeated rows.
    """
    require(docs, "doc_id", text_col)
    if not 0 <= length - window < 32 or window < 1:
        raise ValueError("the window must be shorter than the match, by less than 32 bytes")
    spark, chunk, hot = docs.sparkSession, CHUNK_BYTES, HOT_PHRASES
    text = whole(F.col(f"`{text_col}`"))
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    n_batches, n_buckets = -(-total // BATCH_BYTES) or 1, -(-2 * total // ((length - window + 2) * BUCKET_ENTRIES)) or 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    key = row_key(F.col("doc_id"), F.col(f"`{text_col}`"))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    dealt = docs.select(F.pmod(F.xxhash64(F.lit(3), key), F.lit(n_batches)).alias("batch"), F.lit(2).alias("tag"), key.alias("key"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.cast("binary").alias("body"), others.alias("row"))
    bare = dealt.drop("row")

    def sorted_batches(rows: DataFrame, *answers: DataFrame) -> DataFrame:
        for a in answers:
            rows = rows.unionByName(a, allowMissingColumns=True)
        return rows.repartition(parts, "batch").sortWithinPartitions("batch", "tag", "key")

    def exchange(rows: DataFrame, ask: Callable[[Batch], pa.RecordBatch], meet: Callable[[list[dict]], list[tuple]]) -> DataFrame:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _document_batches(batches, length, window, chunk):
                yield ask(b)

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[dict] = []
            for _, part, new in _each(batches, "bucket"):
                if new and rows:
                    yield _rows(meet(rows), ANSWER)
                    rows = []
                rows += part.to_pylist()
            if rows:
                yield _rows(meet(rows), ANSWER)

        asked = rows.mapInArrow(send, REQUEST)
        with _shuffles_dropped(spark):
            return cut_lineage(asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, ANSWER))

    triggers = exchange(sorted_batches(bare), lambda b: ask_triggers(b, n_buckets), lambda rows: meet_triggers(rows, hot))
    suffixes = exchange(sorted_batches(bare, triggers), lambda b: ask_suffixes(b, n_buckets, length), lambda rows: sort_suffixes(rows, length))
    out = f"row {dealt.schema['row'].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _document_batches(batches, length, window, chunk):
            if b.n:
                yield _result(b, removed(b, n_buckets, length))

    return sorted_batches(dealt, triggers, suffixes).mapInArrow(finish, out)


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated bytes, same columns; what a cut leaves of a character that was split becomes U+FFFD."""
    out = repeated_spans(docs, text_col, length)
    return out.select(*[F.decode("kept", "UTF-8").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def n_removed(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
