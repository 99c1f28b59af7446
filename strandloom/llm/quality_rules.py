"""Line-first cleaning: rules on every line, failing lines removed, documents that lose too much rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.text import WS_CHARS, require, whole, words

WINDOW = 8

#: A line may be navigation if it holds three bars or arrows, one of them behind other text (a quoted reply has all in front), and it is navigation
#: if items of SHORT_ITEM characters or fewer make up half of it, or if it is nothing but menu entries. Rows with a bar at both ends belong to
#: tables and fail only as menus. The bars are written out and the loops are possessive, so that a line of any length is matched without
#: recursion; no entry begins with a blank, a mark or another entry.
BARS = r"[|>»][^|>»]*+[|>»][^|>»]*+[|>»]"
BAR_BEHIND = r"^[|>»\s]*+[^|>»]++[|>»]"
SHORT_ITEM = 30
ENTRY = r"(?:home|menu|log ?in|sign ?up|next|previous|back|search|contact|about us)"
MENU = rf"^\s*+{ENTRY}(?:\s*+[|/>,·-]?+\s*+{ENTRY})*+\s*+$"
#: A line is boilerplate if these make up a tenth or more of its characters: one phrase fails a short line, not a long paragraph.
BOILERPLATE = r"all rights reserved|privacy policy|terms of (use|service)|cookie(s)? (policy|settings|consent)|accept (all )?cookies|enable javascript|subscribe to our|click here|lorem ipsum"
BOILERPLATE_SHARE = 0.1
#: A word decorated with marks, and the share of such words that fails a line.
DECORATED = r"[!?#*$%&<>~^=_]{2,}$"
DECORATED_SHARE = 0.3
#: A line without closing punctuation fails only if it also has no letter or digit at all.
NO_CONTENT = r"^[^0-9A-Za-z\x{80}-\x{10FFFF}]+$"


def navigation(low: Column) -> Column:
    """Whether a line in lower case is navigation."""
    ends = F.btrim(low, F.lit(WS_CHARS))
    sizes = F.transform(F.split(low, "[|>»]", -1), lambda x: F.length(F.btrim(x, F.lit(WS_CHARS))))
    # characters of short items minus those of the others
    balance = F.aggregate(sizes, F.lit(0), lambda a, n: a + F.when(n <= SHORT_ITEM, n).otherwise(-n))
    listed = F.when(F.startswith(ends, F.lit("|")) & F.endswith(ends, F.lit("|")), F.regexp_like(F.btrim(low, F.lit(WS_CHARS + "|")), F.lit(MENU))).otherwise(balance >= 0)
    return (F.regexp_like(low, F.lit(BARS)) & F.regexp_like(low, F.lit(BAR_BEHIND)) & listed) | F.regexp_like(low, F.lit(MENU))


def boilerplate(low: Column) -> Column:
    """Whether boilerplate phrases make up enough of a line in lower case."""
    covered = F.length(low) - F.length(F.regexp_replace(low, BOILERPLATE, ""))
    return F.regexp_like(low, F.lit(BOILERPLATE)) & (covered >= F.length(F.array_join(words(low), " ")) * BOILERPLATE_SHARE)


def line_fails(line: Column) -> Column:
    """Whether the punctuation, navigation or boilerplate rule removes a line. Lines without a word always stay."""
    low = F.lower(line)
    ws = words(line)
    decorated = F.size(F.filter(ws, lambda w: F.regexp_like(w, F.lit(DECORATED))))
    return (F.size(ws) > 0) & (F.regexp_like(line, F.lit(NO_CONTENT)) | (decorated > F.size(ws) * DECORATED_SHARE) | navigation(low) | boilerplate(low))


def repeated_words(df: DataFrame, words_col: str, out: str) -> DataFrame:
    """Words inside 8-word windows that occur twice or more in their text, first occurrence included.

    All in the row: window hashes, then, only where the distinct ones are fewer, a sort of (hash, position)
    that brings equal windows together. No window leaves its row.
    """
    w, h, g, s, p = (f"_rep_{x}" for x in ("w", "h", "g", "s", "p"))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(h, F.transform(F.col(words_col), lambda x: F.xxhash64(x)))
    df = df.withColumn(g, F.when(F.size(h) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(WINDOW)]))).otherwise(none))
    df = df.withColumn(s, F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(
        F.transform(F.col(g), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    same = lambda x, j: (F.coalesce(F.get(F.col(s), j - 1)["x"] == x["x"], F.lit(False))
                         | F.coalesce(F.get(F.col(s), j + 1)["x"] == x["x"], F.lit(False)))
    df = df.withColumn(p, F.sort_array(F.transform(F.filter(F.col(s), same), lambda x: x["i"])))
    step = lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(p), j + 1) - x, F.lit(WINDOW)))
    df = df.withColumn(out, F.aggregate(F.transform(F.col(p), step), F.lit(0).cast("long"), lambda a, x: a + x))
    return df.drop(w, h, g, s, p)


def clean_lines(docs: DataFrame, text_col: str = "text", max_lost: float = 0.5) -> DataFrame:
    """Measure every document and clean it line by line.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, cleaned (the text without the
    lines that fail a rule), lost (share of its non-blank characters that went) and kept. A document is kept if it passes the base
    rules (20 words or more, at most 30 % of its words in repeated windows) and loses at most ``max_lost``.

    A null or empty text has no words: base_failed, kept false, cleaned ''. Repeated rows are measured one by one. Columns of the
    input that bear an added name are replaced. One narrow stage: no shuffle, whatever the sizes.
    """
    require(docs, text_col)
    df = docs.withColumn("_t", whole(F.col(text_col)))
    df = df.withColumn("_w", words(F.col("_t"))).withColumn("_l", F.split(F.col("_t"), "\n", -1))
    df = repeated_words(df, "_w", "n_repeat_words")
    solid = F.filter(F.col("_l"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    df = df.withColumn("_s", solid).withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long")})
    df = df.withColumns({
        "n_dup_lines": (F.size("_s") - F.size(F.array_distinct("_s"))).cast("long"),
        "_k": F.filter(F.col("_l"), lambda x: ~line_fails(x))})
    df = df.withColumns({
        "cleaned": F.array_join("_k", "\n"),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))})
    left = F.length(F.regexp_replace("cleaned", "[\\x20\\x09-\\x0D]+", ""))
    df = df.withColumn("lost", F.when(F.col("word_chars") == 0, F.lit(0.0)).otherwise(1 - left / F.nullif(F.col("word_chars"), F.lit(0))))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))
    return df.drop("_t", "_w", "_l", "_s", "_k")


def keep_good(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` for the documents that are kept, with the failing lines gone from their texts."""
    cols = docs.columns
    others = [c for c in cols if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0))
    # a row number that the filter reads keeps it above the measures; below, each would be computed once per mention
    df = clean_lines(docs.select(row.alias("row"), "text")).withColumn("_no", F.monotonically_increasing_id()).where("kept and _no >= 0")
    made = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return df.select(*[made[c].alias(c) if c in made else F.col(f"row.`{c}`").alias(c) for c in cols])
