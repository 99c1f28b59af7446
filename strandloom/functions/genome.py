"""Interval schemas and column functions for BED and GTF tables (0-based half-open BED)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.runtime import raise_if, require_columns

# Fixed column lists of the two text formats.
BED_COLUMNS = ["chrom", "chromStart", "chromEnd", "name", "score", "strand",
               "thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts"]
GTF_COLUMNS = ["seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attribute"]
ATTRIBUTE_PATTERN = r'([^\s]+) "([^"]+)";'


def rectify_bed(df: DataFrame) -> DataFrame:
    """The 12 BED columns, typed, absent ones set to "."; other columns are dropped."""
    require_columns(df, *BED_COLUMNS[:3])
    return df.select(
        F.col("chrom").cast("string").alias("chrom"),
        F.col("chromStart").cast("long").alias("chromStart"),
        F.col("chromEnd").cast("long").alias("chromEnd"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(".")).alias(c) if c in df.columns
          else F.lit(".").alias(c) for c in BED_COLUMNS[3:]],
    )


def rectify_gtf(df: DataFrame) -> DataFrame:
    """The 9 GTF columns, typed, absent ones set to "."; other columns are kept after them."""
    require_columns(df, "seqname", "start", "end")
    fixed = []
    for c in GTF_COLUMNS:
        if c in ("start", "end"):
            fixed.append(F.col(c).cast("long").alias(c))
        elif c in df.columns:
            fixed.append(F.coalesce(F.col(c).cast("string"), F.lit(".")).alias(c))
        else:
            fixed.append(F.lit(".").alias(c))
    return df.select(*fixed, *[c for c in df.columns if c not in GTF_COLUMNS])


def attribute_pairs(attribute: Column | str) -> Column:
    """ARRAY<STRUCT<k, v>> of the quoted GTF attributes, in order of appearance."""
    keys = F.regexp_extract_all(attribute, F.lit(ATTRIBUTE_PATTERN), 1)
    values = F.regexp_extract_all(attribute, F.lit(ATTRIBUTE_PATTERN), 2)
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))


def attribute_map(attribute: Column | str) -> Column:
    """MAP<STRING, STRING> of the attributes; the last of repeated keys wins."""
    last_first = F.reverse(attribute_pairs(attribute))
    seen = F.transform(last_first, lambda p: p["k"])
    unique = F.filter(F.zip_with(last_first, F.sequence(F.lit(1), F.size(seen)),
                                 lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))),
                      lambda p: F.array_position(seen, p["k"]) == p["i"])
    return F.when(F.size(seen) == 0, F.create_map().cast("map<string,string>")).otherwise(
        F.map_from_entries(F.transform(unique, lambda p: F.struct(p["k"], p["v"]))))


def split_attribute(gtf: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Add one column per attribute key; a key named like a GTF column overwrites it.

    Without ``keys`` the attributes come as one map column ``attributes``.
    """
    if keys is None:
        return gtf.withColumn("attributes", attribute_map("attribute"))
    pairs = gtf.withColumn("_pairs", attribute_pairs("attribute"))

    def last(key: str) -> Column:
        hits = F.filter("_pairs", lambda p: p["k"] == key)
        found = F.when(F.size(hits) > 0, F.element_at(hits, -1)["v"])
        return F.coalesce(found, F.col(key)) if key in GTF_COLUMNS else found

    return pairs.withColumns({k: last(k) for k in keys}).drop("_pairs")


def gtf_to_bed(gtf: DataFrame, name: str | None = None) -> DataFrame:
    """1-based closed to 0-based half-open; ``name`` picks the column that becomes the BED name."""
    return rectify_bed(gtf.select(
        F.col("seqname").alias("chrom"), (F.col("start") - 1).alias("chromStart"),
        F.col("end").alias("chromEnd"), (F.col(name) if name else F.lit(".")).alias("name"),
        "score", "strand"))


def _check_strands(bed: DataFrame, strict: bool) -> None:
    if strict:
        row = bed.agg(F.sort_array(F.collect_set("strand")).alias("s")).first()
        if row["s"] != ["+", "-"]:
            raise ValueError("not all features are strand specific")


def _by_strand(plus: Column, minus: Column) -> Column:
    bad = ~F.col("strand").isin("+", "-")
    return raise_if(bad, "not all features are strand specific", F.when(F.col("strand") == "+", plus).otherwise(minus))


def start_site(bed: DataFrame, strict: bool = False) -> DataFrame:
    """One-base interval at the strand's start."""
    _check_strands(bed, strict)
    s, e = F.col("chromStart"), F.col("chromEnd")
    return bed.withColumns({"chromStart": _by_strand(s, e - 1), "chromEnd": _by_strand(s + 1, e)})


def end_site(bed: DataFrame, strict: bool = False) -> DataFrame:
    """One-base interval at the strand's end."""
    _check_strands(bed, strict)
    s, e = F.col("chromStart"), F.col("chromEnd")
    return bed.withColumns({"chromStart": _by_strand(e - 1, s), "chromEnd": _by_strand(e, s + 1)})


def expand(bed: DataFrame, upstream: int, downstream: int, chr_len: DataFrame | None = None,
           strict: bool = False) -> DataFrame:
    """Widen by ``upstream`` / ``downstream`` bases along the strand; clip to the chromosome.

    Equal widths ignore the strand; (0, 0) returns the input unclipped. ``chr_len`` is a
    (chrom, length) table and must know every chromosome of ``bed``.
    """
    if upstream == 0 and downstream == 0:
        return bed
    s, e = F.col("chromStart"), F.col("chromEnd")
    if upstream == downstream:
        start, end = s - upstream, e + downstream
    else:
        _check_strands(bed, strict)
        start, end = _by_strand(s - upstream, s - downstream), _by_strand(e + downstream, e + upstream)
    out = bed.withColumns({"chromStart": F.greatest(start, F.lit(0)), "chromEnd": end})
    if chr_len is None:
        return out
    known = out.join(chr_len.select("chrom", F.col("length").alias("_len")), "chrom", "left")
    clipped = raise_if(F.col("_len").isNull(), "chromosome without a known length", F.least("chromEnd", "_len"))
    return known.withColumn("chromEnd", clipped).select(*bed.columns)


def interval_dist(xs: Column, xe: Column, ys: Column, ye: Column) -> Column:
    """Signed distance of two intervals on one chromosome: 0 if they share a base, negative if
    x lies before y; intervals that touch are at distance 1."""
    return F.when(xs >= ye, xs - ye + 1).when(xe <= ys, xe - ys - 1).otherwise(F.lit(0))


def dist_power_decay(dist: Column | str) -> Column:
    """Weight of an edge between features ``dist`` bases apart."""
    d = F.col(dist) if isinstance(dist, str) else dist
    return F.pow((d + 1000) / 1000, F.lit(-0.75))


def ens_trim_version(col: Column | str) -> Column:
    return F.regexp_replace(col, r"\.[0-9_-]+$", "")


def parse_region(col: Column | str) -> Column:
    """STRUCT<chrom, chromStart, chromEnd> of ``chr:start-end`` or ``chr-start-end``."""
    parts = F.split(col, "[:-]")
    return F.struct(parts[0].alias("chrom"), parts[1].cast("long").alias("chromStart"),
                    parts[2].cast("long").alias("chromEnd"))


def region_name(chrom: str = "chrom", start: str = "chromStart", end: str = "chromEnd") -> Column:
    return F.concat(F.col(chrom), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def genes_with_promoters(gtf: DataFrame, promoter_len: int = 2000, name: str = "gene_id") -> DataFrame:
    """Gene bodies widened by the promoter, one row per distinct interval (smallest name)."""
    genes = split_attribute(gtf.where(F.col("feature") == "gene"), [name])
    bed = expand(gtf_to_bed(genes, name), promoter_len, 0)
    key = ["chrom", "chromStart", "chromEnd"]
    return bed.groupBy(*key).agg(F.min(F.struct("name", "score", "strand")).alias("r")).select(*key, "r.*")


def annotate_genes(features: DataFrame, gtf: DataFrame, gtf_by: str, var_by: str = "feature",
                   by_func: Callable[[Column], Column] | None = None) -> DataFrame:
    """Left join of gene coordinates; of several genes per key the one with the last seqname
    is kept (smallest start among equals)."""
    fn = by_func or (lambda c: c)
    genes = split_attribute(gtf.where(F.col("feature") == "gene"), [gtf_by])
    best = genes.groupBy(fn(F.col(gtf_by)).alias("_key")).agg(
        F.max(F.struct("seqname", (-F.col("start")).alias("neg"), "end", "strand")).alias("g"))
    bed = best.select("_key", F.col("g.seqname").alias("chrom"), (-F.col("g.neg") - 1).alias("chromStart"),
                      F.col("g.end").alias("chromEnd"), F.col("g.strand").alias("strand"))
    return features.withColumn("_key", fn(F.col(var_by))).join(bed, "_key", "left").drop("_key")


def map_unique(df: DataFrame, col: str, mapping: DataFrame, drop: bool = False) -> DataFrame:
    """Rename ``col`` through a (key, value) table, using keys with exactly one distinct value."""
    one = (mapping.groupBy("key").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
                  .where(F.col("_lo") == F.col("_hi")).select(F.col("key").alias(col), "_lo"))
    return df.join(one, col, "inner" if drop else "left").withColumn(col, F.col("_lo")).drop("_lo").select(*df.columns)


def prefer(df: DataFrame, key: str, col: str, order: Sequence[str]) -> DataFrame:
    """Rows of each key that carry its most preferred value of ``col`` (all of them)."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(col))
    ranked = df.withColumn("_rank", rank).where(F.col("_rank") > 0)
    best = ranked.groupBy(key).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [key, "_rank"], "left_semi").drop("_rank")


def make_unique(df: DataFrame, col: str, ids: Sequence[str], joiner: str = "-") -> DataFrame:
    """Suffix the second, third, ... row of a repeated name with -1, -2, ... in ``ids`` order.

    Rows are numbered through range buckets of the first ID (which must be numeric), so a
    name that covers most rows is still numbered by many tasks.
    """
    from strandloom.functions.ranks import ordered_positions

    pos = ordered_positions(df, [col], ids)
    return pos.withColumn(col, F.when(F.col("pos") == 0, F.col(col)).otherwise(
        F.concat(F.col(col), F.lit(joiner), F.col("pos").cast("string")))).select(*df.columns)


def nucleotide_content(bed: DataFrame, chunks: DataFrame, chunk_size: int) -> DataFrame:
    """Base composition per region on its own strand.

    ``chunks`` holds (chrom, chunk, seq): piece number ``chunk`` of fixed size ``chunk_size``.
    Regions are matched to the pieces they touch by an equi-join; counts add up per region.
    """
    last = F.greatest(F.col("chromStart"), F.col("chromEnd") - 1)
    parts = bed.withColumn("chunk", F.explode(F.sequence(
        F.floor(F.col("chromStart") / chunk_size), F.floor(last / chunk_size))))
    base = F.col("chunk") * chunk_size
    lo = F.greatest(F.col("chromStart") - base, F.lit(0))
    hi = F.least(F.col("chromEnd") - base, F.lit(chunk_size))
    joined = parts.join(chunks, ["chrom", "chunk"], "left").withColumn(
        "_piece", F.coalesce(F.substring("seq", (lo + 1).cast("int"), (hi - lo).cast("int")), F.lit("")))

    def count(letter: str) -> Column:
        return F.sum(F.length("_piece") - F.length(F.translate("_piece", letter + letter.lower(), "")))

    key = ["chrom", "chromStart", "chromEnd", "name", "strand"]
    raw = joined.groupBy(*key).agg(*[count(x).alias(f"_{x}") for x in "ACGTN"],
                                   F.sum(F.length("_piece")).alias("length"))
    minus = F.col("strand") == "-"

    def oriented(plus: str, rev: str) -> Column:
        return F.when(minus, F.col(f"_{rev}")).otherwise(F.col(f"_{plus}"))

    known = F.col("_A") + F.col("_C") + F.col("_G") + F.col("_T")
    return raw.select(
        *key, ((F.col("_A") + F.col("_T")) / F.col("length")).alias("pct_at"),
        ((F.col("_C") + F.col("_G")) / F.col("length")).alias("pct_gc"),
        oriented("A", "T").alias("num_a"), oriented("C", "G").alias("num_c"),
        oriented("G", "C").alias("num_g"), oriented("T", "A").alias("num_t"),
        F.col("_N").alias("num_n"), (F.col("length") - known - F.col("_N")).alias("num_oth"), "length")
