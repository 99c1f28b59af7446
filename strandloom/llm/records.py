"""Token ids as length-delimited binary records with masked checksums, and an offset index beside every file."""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.runtime import cut_lineage, scratch_path
from strandloom.llm.crc32c import crc32c, masked
from strandloom.llm.text import require, whole

#: One entry of an index: id of the document and whether it has one, offset of the record in the file, number of ids, bytes of an id.
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "<u1"), ("width", "<u1"), ("offset", "<u8"), ("n", "<u4")])
#: A record: length in bytes (8), masked checksum of these (4), ids as little-endian numbers, masked checksum of the ids (4).
#: Ids take two bytes if the vocabulary has no more than 65,536, else four.
FRAME = 16
#: Distinct pieces of text whose ids a worker remembers; texts encoded and ids framed at once.
REMEMBERED, TEXTS_AT_ONCE, IDS_AT_ONCE = 1_200_000, 256, 1 << 20

#: White space with the word after it. A tokenizer that works on pre-tokens never joins a non-blank with a blank that follows, so these
#: pieces are encoded on their own. Texts with the separators 1C-1F, on which notions of white space differ, are encoded whole.
PIECES = re.compile(r"\s*\S+|\s+")
UNSURE = re.compile("[\x1c-\x1f]")
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
TAIL = re.compile(f"[{LETTERS}][.,]$")
#: What the byte-level pattern takes as one pre-token, a blank and letters, and a run of ASCII symbols (no apostrophe) behind, which is one, too.
MARKED = re.compile(f"( ?[{LETTERS}]+)([!-&(-/:-@\\[-`{{-~]*)")
SPOILT = re.compile(f" ?[{LETTERS}]*[!-&(-/:-@\\[-`{{-~]*")

#: The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for themselves, the others from U+0100 on, in order.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
SPELT = {b: 256 + k for k, b in enumerate(_OTHERS)}

_ENCODERS: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Encodes texts with a tokenizers file, each distinct piece once while it is remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.code = "H" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.memo: dict[str, bytes] = {}
        # Words go to the model of the file directly if nothing but the byte-level step would come before it.
        pre, added = self.tok.pre_tokenizer, [t.content for t in self.tok.get_added_tokens_decoder().values()]
        plain = isinstance(pre, ByteLevel) and pre.use_regex and not pre.add_prefix_space and self.tok.normalizer is None and isinstance(self.tok.model, BPE)
        self.model = self.tok.model if plain and not any(map(SPOILT.fullmatch, added)) else None

    def batch(self, pieces: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def word(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(SPELT))]).tobytes()

    def learn(self, missed: list[str]) -> dict[str, bytes]:
        """The ids of new pieces and of the parts that were encoded on their own for them."""
        memo, new, split, stems = self.memo, {}, {}, {}
        for p in missed:
            if self.model is not None and (m := MARKED.fullmatch(p)):
                w, end = m.groups()
                if w not in new and w not in memo:
                    new[w] = self.word(w)
            elif TAIL.search(p):
                w, end = p[:-1], p[-1]
                stems[w] = None
            else:
                stems[p], end = None, ""
            if end:
                split[p], stems[end] = (w, end), None
        stems = [x for x in stems if x not in new and x not in memo]
        new.update(zip(stems, self.batch(stems), strict=True))
        for p, (w, end) in split.items():
            if p not in new:
                new[p] = (new.get(w) or memo[w]) + (new.get(end) or memo[end])
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as bytes. A full stop or comma after a Latin letter is a pre-token of its own, so a new piece that ends so
        is looked up without it first; so are symbols after a word where the pre-tokens are known to be byte-level."""
        memo = self.memo
        cut = [[t] if UNSURE.search(t) else PIECES.findall(t) for t in texts]
        got = [list(map(memo.get, pieces)) for pieces in cut]
        missed = dict.fromkeys(p for pieces, ids in zip(cut, got, strict=True) if None in ids for p, x in zip(pieces, ids, strict=True) if x is None)
        if missed:
            new = self.learn(missed)
            got = [[new[p] if x is None else x for p, x in zip(pieces, ids, strict=True)] if None in ids else ids for pieces, ids in zip(cut, got, strict=True)]
            if len(memo) + len(new) > REMEMBERED:
                memo.clear()
            memo.update(new)
        return list(map(b"".join, got))


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The records of some id sequences (each one id or more) and the length of each record."""
    n = np.array([len(p) for p in payloads], np.int64)
    head = n.astype("<u8")
    head_crc = masked(crc32c(head.view("<u2"), np.full(len(n), 4))).astype("<u4").tobytes()
    data_crc = masked(crc32c(np.frombuffer(b"".join(payloads), "<u2"), n // 2)).astype("<u4").tobytes()
    head = head.tobytes()
    return b"".join([x for k, p in enumerate(payloads) for x in (head[8 * k:8 * k + 8], head_crc[4 * k:4 * k + 4], p, data_crc[4 * k:4 * k + 4])]), n + FRAME


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into record files under ``path``; returns their manifest.

    The manifest has a row per file: part, file, index, n_records, n_ids. Rows are range-partitioned by id and then by a hash of the text, so
    that rows without an id (they come first) or with one id do not meet in one task, and sorted by both. Files are named by
    task attempt; only those in the manifest count, so lost, retried and speculative tasks leave no trace in the result. ``path`` may be any
    folder that all executors reach. A null or empty text is a record of the end id alone.
    """
    require(docs, "doc_id", "text")
    path = path or scratch_path(docs.sparkSession, "records")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs.create_dir(root, recursive=True)
        name, enc, end = f"part-{part:06d}-{attempt}", encoder(tokenizer), array(encoder(tokenizer).code, [end_id]).tobytes()
        offset = records = ids = 0
        with fs.open_output_stream(f"{root}/{name}.rec") as rec, fs.open_output_stream(f"{root}/{name}.idx") as idx:
            def flush(who: list, held: list[bytes]) -> None:
                nonlocal offset, records, ids
                data, sizes = frame(held)
                entry = np.zeros(len(held), INDEX)
                entry["has_id"] = [w is not None for w in who]
                entry["doc_id"] = [w or 0 for w in who]
                entry["offset"] = offset + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                entry["width"] = len(end)
                entry["n"] = (sizes - FRAME) // len(end)
                rec.write(data)
                idx.write(entry.tobytes())
                offset, records, ids = offset + len(data), records + len(held), ids + int(entry["n"].sum())

            who, held, size = [], [], 0
            for batch in batches:
                for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                    some = batch.slice(i, TEXTS_AT_ONCE)
                    for d, seq in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                        who.append(d)
                        held.append(seq + end)
                        size += len(seq)
                        if size >= 2 * IDS_AT_ONCE:
                            flush(who, held)
                            who, held, size = [], [], 0
            if held:
                flush(who, held)
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{path}/{name}.rec"]), pa.array([f"{path}/{name}.idx"]), pa.array([records]), pa.array([ids])],
                                             names=["part", "file", "index", "n_records", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return cut_lineage(rows.mapInArrow(run, "part int, file string, index string, n_records long, n_ids long"))


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, from the files alone; a wrong checksum ends the job.

    start counts all ids before the record in the order of the files; the files' totals are added up, one row per file. Each file is a task and is read in bounded runs of records.
    """
    def run(batches):
        for batch in batches:
            for base, file, index in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                fs, root = pafs.FileSystem.from_uri(file)
                with fs.open_input_stream(pafs.FileSystem.from_uri(index)[1]) as f:
                    entry = np.frombuffer(f.read(), INDEX)
                place = np.concatenate([[0], np.cumsum(entry["n"].astype(np.int64))])
                cut = np.unique(np.searchsorted(place, np.arange(0, place[-1] + IDS_AT_ONCE, IDS_AT_ONCE)).clip(0, len(entry)))
                with fs.open_input_file(root) as f:
                    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                        begin, n, width = int(entry["offset"][a]), entry["n"][a:b].astype(np.int64), int(entry["width"][a])
                        units = n * width // 2
                        f.seek(begin)
                        data = np.frombuffer(f.read(int(entry["offset"][b - 1]) - begin + width * int(n[-1]) + FRAME), "<u2")
                        at = (entry["offset"][a:b].astype(np.int64) - begin) // 2
                        head = data[at[:, None] + np.arange(6)]
                        flat = data[np.repeat(at + 6 - np.concatenate([[0], np.cumsum(units)[:-1]]), units) + np.arange(int(units.sum()))]
                        tail = np.ascontiguousarray(data[(at + 6 + units)[:, None] + np.arange(2)]).view("<u4").ravel()
                        size, check = np.ascontiguousarray(head[:, :4]), np.ascontiguousarray(head[:, 4:]).view("<u4").ravel()
                        if np.any(size.view("<u8").ravel() != 2 * units) or np.any(masked(crc32c(size.ravel(), np.full(len(n), 4))) != check) or np.any(masked(crc32c(flat, units)) != tail):
                            raise ValueError(f"damaged record in {file}")
                        flat = flat.view(f"<u{width}")
                        ends = np.cumsum(n)
                        raw = memoryview(flat.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * (e - m):4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                        ids = [int(d) if h else None for d, h in zip(entry["doc_id"][a:b], entry["has_id"][a:b], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(base + place[a:b]), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select(F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"), "file", "index")
    return placed.repartition(max(1, files), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per row of ``docs``, read back from the record files it was written to."""
    return read_records(docs.sparkSession, write_records(docs, tokenizer, end_id, path))
