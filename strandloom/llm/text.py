"""Words, row keys and match spans as column expressions.

A null text counts as an empty one everywhere. Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS_CHARS = " \t\n\x0b\x0c\r"
WS = "[\\x20\\x09-\\x0D]+"


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; an empty array where there is none."""
    trimmed = F.btrim(whole(text), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS, -1))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """64-bit key of a row's id and text. Rows that agree in both share it, and so do their results."""
    return F.xxhash64(doc_id.cast("string"), F.lit("\x1f"), whole(text))


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; a column mentioned in a lambda would be computed at each of its turns."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


SPANS = "array<struct<start:int,end:int,match:string,before:string>>"


def _run(steps: Column) -> Column:
    """struct<at, out>: length of a run of gaps and matches, and the places of its matches within it."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(steps, zero, lambda a, s: F.struct((a["at"] + s["gap"] + s["len"]).alias("at"), F.concat(a["out"], F.array(F.struct(
        (a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["len"]).alias("end"), s["match"].alias("match"), s["before"].alias("before")))).alias("out")))


#: Matches up to which one run is walked; appending copies what is there, so more are walked in as many runs as each has matches.
ONE_RUN = 64


def _placed(steps: Column) -> Column:
    size = F.ceil(F.sqrt(F.size(steps))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(steps) / size).cast("int") - 1), lambda i: _run(F.slice(steps, i * size + 1, size)))

    def joined_runs(runs: Column) -> Column:
        begins = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
                             lambda a, r: F.struct((a["at"] + r["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(runs, begins, lambda r, at: F.transform(r["out"], lambda x: F.struct(
            (x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["match"].alias("match"), x["before"].alias("before")))))

    return F.when(F.size(steps) <= ONE_RUN, _run(steps)["out"]).otherwise(let(parts, joined_runs))


def spans(text: Column, pattern: str, sure: Column | None = None, context: int = 0) -> Column:
    """array<struct<start, end, match, before>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between the matches give the places: a match starts after all pieces and matches before it. ``before`` is the end of the piece that
    leads to the match, at most ``context`` characters; it never reaches into the match before.
    Rows without a match (or where ``sure`` is false) stop at the first test.
    """
    lead = (lambda p: F.right(p, F.lit(context))) if context else (lambda p: F.lit(""))
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
                       lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), m.alias("match"), lead(p).alias("before")))
    taken = let(F.filter(found, lambda s: s["match"].isNotNull()), _placed)
    test = F.regexp_like(text, F.lit(pattern))
    return F.when(test if sure is None else sure & test, taken).otherwise(F.array().cast(SPANS))


def tagged(found: Column, order: int, kind: str) -> Column:
    """Spans with their kind and its place in the order of kinds."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined, by start and then by kind as listed."""
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the end doubled and added up."""
    back = F.split(F.reverse(digits), "(?!$)", -1)
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int"))
    return F.aggregate(F.transform(back, value), F.lit(0), lambda a, x: a + x)
