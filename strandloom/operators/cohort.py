"""Cohort preparation: model views, pairing, splits, subsamples, metadata joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.ranks import positions
from strandloom.functions.runtime import cut_lineage, hash_uniform, scalar
from strandloom.functions.vectors import dimension


def _codes(cells: DataFrame, col: str, known: Sequence[str] | None) -> Column:
    """0-based index among the sorted categories, -1 if absent or unknown."""
    cats = F.array(*[F.lit(k) for k in known]) if known is not None else scalar(cells, F.array_sort(F.collect_set(F.col(col).cast("string"))))
    return F.coalesce(F.array_position(cats, F.col(col).cast("string")).cast("int") - 1, F.lit(-1))


def dataset_view(m: DataFrame, cells: DataFrame, features: DataFrame, use_highly_variable: bool = False, use_layer: str | None = None,
                 use_rep: str | None = None, rep_dim: int | None = None, use_batch: str | None = None, batches: Sequence[str] | None = None,
                 use_cell_type: str | None = None, cell_types: Sequence[str] | None = None,
                 use_weight: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(MATRIX, CELLS, FEATURES) as a model would see them: chosen features, layer and embedding,
    integer batch and cell-type codes, weights scaled to mean 1. Absent columns are errors."""
    for df, col, what in ((features, "highly_variable" if use_highly_variable else None, "highly_variable flag"), (m, use_layer, "layer"),
                          (cells, use_rep, "embedding"), (cells, use_batch, "batch column"), (cells, use_cell_type, "cell type column"), (cells, use_weight, "weight column")):
        if col is not None and col not in df.columns:
            raise ValueError(f"configured {what} `{col}` does not exist")
    if use_rep and rep_dim is not None and dimension(cells, use_rep) != rep_dim:
        raise ValueError("the embedding has an unexpected dimension")
    feats = features.where("highly_variable") if use_highly_variable else features
    x = m.select("cell", "feature", F.col(use_layer or "value").alias("value")).join(feats.select("feature"), "feature", "left_semi").select("cell", "feature", "value")
    cols = ["cell"]
    if use_rep:
        cols.append(F.col(use_rep).alias("rep"))
    cols.append((_codes(cells, use_batch, batches) if use_batch else F.lit(0)).alias("batch_code"))
    cols.append((_codes(cells, use_cell_type, cell_types) if use_cell_type else F.lit(-1)).alias("cell_type_code"))
    if use_weight:
        cells = cells.withColumn("_mean", scalar(cells, F.avg(use_weight)))
        cols.append((F.col(use_weight) / F.col("_mean")).alias("weight"))
    else:
        cols.append(F.lit(1.0).alias("weight"))
    return x, cells.select(*cols), feats


def paired_view(*cells: DataFrame, random_fill: bool = False, seed: int = 0) -> DataFrame:
    """Union of cell IDs with, per dataset i, a presence mask ``has_i`` and the cell ``src_i`` that
    fills the slot: the cell itself, or a recycled (or random) one of that dataset."""
    rows = None
    for i, c in enumerate(cells):
        part = c.select("cell", F.lit(i).alias("d"))
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy("cell", "d").agg(F.count(F.lit(1)).alias("c"))
    view = cut_lineage(counts.groupBy("cell").agg(F.max("c").alias("_most"), *[F.max(F.when(F.col("d") == i, True)).isNotNull().alias(f"has_{i}") for i in range(len(cells))]))
    if not view.where(F.col("_most") > 1).isEmpty():
        raise ValueError("non-unique cell ID")
    out = view.drop("_most")
    for i in range(len(cells)):
        present = positions(view.where(f"has_{i}").select("cell"), [], ["cell"], seed).select(F.col("cell").alias(f"src_{i}"), F.col("pos").alias("_p"))
        missing = positions(view.where(~F.col(f"has_{i}")).select("cell"), [], ["cell"], seed + 1)
        n = view.where(f"has_{i}").count()
        slot = F.floor(hash_uniform("cell", seed=seed + 2 + i) * n).cast("long") if random_fill else F.pmod("pos", F.lit(n))
        filled = missing.withColumn("_p", slot).join(present, "_p").select("cell", f"src_{i}")
        out = out.join(filled, "cell", "left").withColumn(f"src_{i}", F.coalesce(f"src_{i}", F.when(F.col(f"has_{i}"), F.col("cell"))))
    return out


def random_split(df: DataFrame, fractions: Sequence[float], ids: Sequence[str], seed: int = 0, out: str = "split") -> DataFrame:
    """Rows with their split index; split sizes are the differences of round(cumulated fraction * n)."""
    if min(fractions) <= 0:
        raise ValueError("fractions should be greater than 0")
    if abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("fractions do not sum to 1")
    pos = positions(df, [], ids, seed)
    split, total = F.lit(len(fractions) - 1), 0.0
    bounds = []
    for f in fractions[:-1]:
        total += f
        bounds.append(total)
    for i in reversed(range(len(bounds))):
        split = F.when(F.col("pos") < F.bround(F.col("n") * bounds[i]), i).otherwise(split)
    return pos.select(*df.columns, split.cast("int").alias(out))


def recycle_join(a: DataFrame, b: DataFrame, ids_a: Sequence[str], ids_b: Sequence[str], seed: int = 0) -> DataFrame:
    """Rows of unpaired tables side by side; the smaller table is repeated as often as needed."""
    na, nb = a.count(), b.count()
    if not na or not nb:
        raise ValueError("both tables need rows")
    pa = positions(a, [], ids_a, seed).drop("n").withColumnRenamed("pos", "_pa")
    pb = positions(b, [], ids_b, seed).drop("n").withColumnRenamed("pos", "_pb")
    if na >= nb:
        return pa.withColumn("_pb", F.pmod("_pa", F.lit(nb))).join(pb, "_pb").drop("_pa", "_pb")
    return pb.withColumn("_pa", F.pmod("_pb", F.lit(na))).join(pa, "_pa").drop("_pa", "_pb").select(*a.columns, *b.columns)


def subsample(dfs: Sequence[DataFrame], size: int | None = None, frac: float | None = None, paired: bool = False, seed: int = 0,
              id_col: str = "cell") -> list[DataFrame]:
    """Random rows of each table, without replacement; paired tables share the same IDs."""
    if (size is None) == (frac is None):
        raise ValueError("exactly one of size and frac must be given")

    def pick(df: DataFrame, s: int) -> DataFrame:
        pos = positions(df, [], [id_col], s)
        limit = F.lit(size) if size is not None else F.bround(F.col("n") * frac)
        return pos.where(F.col("pos") < limit).select(*df.columns)

    if not paired:
        return [pick(df, seed + i) for i, df in enumerate(dfs)]
    if len({df.count() for df in dfs}) != 1:
        raise ValueError("datasets are not paired")
    chosen = cut_lineage(pick(dfs[0].select(id_col), seed))
    return [df.join(chosen, id_col, "left_semi") for df in dfs]


def annotate_cells(cells: DataFrame, meta: DataFrame, exclude: Mapping[str, Sequence[str]] | None = None,
                   recode: Mapping[str, Mapping[str, str]] | None = None, on: str = "cell") -> DataFrame:
    """Cells with annotation only, without the excluded categories, categories renamed."""
    out = cells.join(meta, on)
    for col, values in (exclude or {}).items():
        out = out.where(~F.coalesce(F.col(col).isin(list(values)), F.lit(False)))
    for col, table in (recode or {}).items():
        expr = F.col(col)
        for old, new in table.items():
            expr = F.when(F.col(col) == old, new).otherwise(expr)
        out = out.withColumn(col, expr)
    return out


def drop_doublets(cells: DataFrame, calls: DataFrame, label: str | None = None, pval: str | None = None, cutoff: float = 0.05,
                  barcode_pattern: str | None = None, barcode_replacement: str = "") -> DataFrame:
    """Cells not called doublets: by a boolean ``label`` column, or by ``pval`` < cutoff. Barcodes of
    the call table may be rewritten first to match the cell IDs."""
    if (label is None) == (pval is None):
        raise ValueError("exactly one of label and pval must be given")
    bad = calls.where(F.col(label)) if label else calls.where(F.col(pval) < cutoff)
    name = F.regexp_replace("barcode", barcode_pattern, barcode_replacement) if barcode_pattern else F.col("barcode")
    return cells.join(bad.select(name.alias("cell")), "cell", "left_anti")


def map_barcodes(df: DataFrame, mapping: DataFrame, col: str = "cell", sep: str = ".") -> DataFrame:
    """Replace the last ``sep``-separated part of a barcode through a (key, value) table; a part
    without an entry makes the barcode null."""
    parts = F.split(F.col(col), "\\" + sep if len(sep) == 1 else sep)
    table = mapping.select(F.col("key").alias("_last"), F.col("value").alias("_new"))
    out = df.withColumn("_parts", parts).withColumn("_last", F.element_at("_parts", -1)).join(table, "_last", "left")
    head = F.slice(F.col("_parts"), F.lit(1), F.size("_parts") - 1)
    return out.withColumn(col, F.when(F.col("_new").isNotNull(), F.concat_ws(sep, head, F.col("_new")))).select(*df.columns)


def pair_partially(a: DataFrame, b: DataFrame, strip_a: int, strip_b: int, n_paired: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Anonymised pairing: cell IDs lose their modality suffix (of fixed length) for ``n_paired``
    randomly chosen pairs and keep it for all others."""
    def base(df: DataFrame, k: int) -> DataFrame:
        return df.withColumn("_base", F.expr(f"left(cell, length(cell) - {k})"))

    xa, xb = base(a, strip_a), base(b, strip_b)
    chosen = positions(xa.select("_base").join(xb.select("_base"), "_base", "left_semi").distinct(), [], ["_base"], seed).where(
        F.col("pos") < n_paired).select("_base", F.lit(True).alias("_p"))
    chosen = cut_lineage(chosen)
    return tuple(x.join(chosen, "_base", "left").withColumn("cell", F.when(F.col("_p"), F.col("_base")).otherwise(F.col("cell"))).select(*df.columns)
                 for x, df in ((xa, a), (xb, b)))  # type: ignore[return-value]
