"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced at stable common boundaries."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.text import require, whole

#: Characters of a chunk and of the first overlap; characters encoded in one call.
CHUNK, OVERLAP, CALL = 32_768, 256, 1 << 20
#: White space on which all definitions agree. Pre-tokens never reach across it, so tokens from the next character on
#: depend on nothing before it.
BLANK = " \t\n\r"

WORD = re.compile(f"[^{BLANK}]+")
#: Bytes of remembered pieces and counts in a worker, about.
REMEMBERED = 192 << 20

_LOADED: dict[str, object] = {}
_MEMORIES: dict[str, Memory | None] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].no_truncation()
        _LOADED[path].no_padding()
    return _LOADED[path]


def count_spliced(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text from chunks with ``overlap`` characters in common.

    Both sides of a seam are encoded with offsets. The seam goes where both have a token start right after a blank; left tokens count
    before it, and the next chunk begins there. Without such a place the overlap doubles, up to the end of the text.
    """
    at, total = 0, 0
    while True:
        wide = overlap
        while True:
            seam, end = at + chunk, at + chunk + wide
            left = tok.encode(text[at:end], add_special_tokens=False)
            if end >= len(text):
                return total + len(left)
            starts = [at + a for a, _ in left.offsets]
            right = {seam + a for a, _ in tok.encode(text[seam:end], add_special_tokens=False).offsets}
            place = next((p for p in dict.fromkeys(starts) if p > seam and p in right and text[p - 1] in BLANK), None)
            if place is not None:
                break
            wide *= 2
        total += sum(s < place for s in starts)
        at = place


def parts_at_blanks(tok) -> bool:
    """Whether a text's tokens are those of its pieces between blanks: blanks are dropped, nothing is put before a text, and no added token takes blanks in."""
    if tok.pre_tokenizer is None or (tok.normalizer is not None and tok.normalizer.normalize_str("a") != "a"):
        return False
    added = tok.get_added_tokens_decoder().values()
    return [p for p, _ in tok.pre_tokenizer.pre_tokenize_str("a \t\n\r b")] == ["a", "b"] and not any(
        t.lstrip or t.rstrip or t.single_word or set(BLANK) & set(t.content) for t in added)


class Memory:
    """Counts texts piece by piece, for tokenizers that part at blanks; each distinct piece is encoded once while it is remembered."""

    def __init__(self, tok) -> None:
        self.tok, self.known, self.held = tok, {}, 0

    def count(self, texts: list[str]) -> list[int]:
        cut = [WORD.findall(t) for t in texts]
        new = set().union(*cut).difference(self.known)
        weight = sum(4 * len(p) + 128 for p in new)
        if self.held + weight > REMEMBERED:
            self.known, new = {}, set().union(*cut)
            self.held, weight = 0, sum(4 * len(p) + 128 for p in new)
        pieces = list(new)
        self.known.update(zip(pieces, map(len, self.tok.encode_batch_fast(pieces, add_special_tokens=False)), strict=True))
        self.held += weight
        return [sum(map(self.known.__getitem__, pieces)) for pieces in cut]


def memory(path: str) -> Memory | None:
    if path not in _MEMORIES:
        _MEMORIES[path] = Memory(tokenizer(path)) if parts_at_blanks(tokenizer(path)) else None
    return _MEMORIES[path]


def counts(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    def run(batches):
        tok, known = tokenizer(path), memory(path)

        def lengths(texts: list[str]) -> list[int]:
            return known.count(texts) if known else list(map(len, tok.encode_batch_fast(texts, add_special_tokens=False)))

        for texts in batches:
            out, held, size = [0] * len(texts), [], 0

            def flush() -> None:
                for i, n in zip(held, lengths([texts.iloc[i] for i in held]), strict=True):  # noqa: B023
                    out[i] = n  # noqa: B023
            for i, t in enumerate(texts):
                if len(t) > chunk + overlap:
                    out[i] = count_spliced(tok, t, chunk, overlap)
                    continue
                held.append(i)
                size += len(t)
                if size >= CALL:
                    flush()
                    held, size = [], 0
            flush()
            yield pd.Series(out, dtype="int64")

    return run


def n_tokens(text: Column, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    run = counts(path, chunk, overlap)

    def tokens(batches: pd.Series) -> pd.Series:
        yield from run(batches)

    from collections.abc import Iterator

    tokens.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(tokens, "long")(text)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs`` (doc_id, text), as the tokenizers library counts without added tokens.

    Strings of special tokens inside a text count as the library's default has it. Null and empty texts have 0 bytes and 0 tokens; repeated
    rows are counted one by one; extra columns are dropped. Texts longer than a chunk and its overlap are spliced; where the tokenizer drops blanks, shorter ones
    are counted piece by piece, with a bounded memory of pieces. One narrow stage; memory is bounded by a chunk of a text, and by CALL characters.
    """
    require(docs, "doc_id", "text")
    df = docs.select("doc_id", whole(F.col("text")).alias("text"))
    df = df.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_tokens(F.col("text"), path, chunk, overlap).alias("n_tokens"))
    return df.withColumn("over_limit", F.col("n_tokens") > limit)
