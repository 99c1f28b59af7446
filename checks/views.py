"""The given tables in the roles of the library's inputs; the same SQL text runs on both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "anchors": """SELECT concat('chr', p_partkey % 5) AS chrom, p_partkey * 50 AS chromStart,
        p_partkey * 50 + p_size AS chromEnd, concat('g', p_partkey) AS name, '.' AS score,
        CASE WHEN floor(p_partkey / 5) % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part""",
    "peaks": """SELECT concat('chr', l_suppkey % 5) AS chrom,
        CAST(l_partkey * 50 + l_quantity AS BIGINT) AS chromStart,
        CAST(l_partkey * 50 + l_quantity AS BIGINT) + 10 * l_linenumber AS chromEnd,
        concat('o', l_orderkey) AS name, '.' AS score, '+' AS strand FROM lineitem""",
    "peaks_u": """SELECT DISTINCT concat('chr', l_suppkey % 5) AS chrom,
        CAST(l_partkey * 50 + l_quantity AS BIGINT) AS chromStart,
        CAST(l_partkey * 50 + l_quantity AS BIGINT) + 10 * l_linenumber AS chromEnd,
        concat('o', l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey, '.', CAST(l_quantity AS BIGINT)) AS name,
        '.' AS score, '+' AS strand FROM lineitem""",
    "motifs": """SELECT concat('chr', l_suppkey % 5) AS chrom, l_partkey * 50 + 5 AS chromStart,
        l_partkey * 50 + 5 + 3 * l_linenumber AS chromEnd, concat('tf', l_suppkey % 20) AS name,
        '.' AS score, '+' AS strand FROM lineitem WHERE l_returnflag = 'R'""",
    "ev_iv": """SELECT event_type AS chrom, CAST(epoch_s AS BIGINT) AS chromStart,
        CAST(epoch_s AS BIGINT) + CAST(floor(value) AS BIGINT) + 1 AS chromEnd,
        event_id AS name, user_id FROM ev_epoch""",
    "gtf": """SELECT concat('chr', p_partkey % 5) AS seqname, 'src' AS source,
        CASE WHEN p_partkey % 7 = 0 THEN 'exon' ELSE 'gene' END AS feature,
        p_partkey * 50 + 1 AS "start", p_partkey * 50 + p_size AS "end", '.' AS score,
        CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, '.' AS frame,
        concat('gene_id "', p_partkey, '.1"; gene_name "', p_name, '"; level 2; source "', p_type, '";') AS attribute
        FROM part""",
    "mx": """SELECT CAST(o_custkey AS VARCHAR(20)) AS cell, p_brand AS feature, sum(l_quantity) AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        GROUP BY o_custkey, p_brand""",
    "mx_cells": """SELECT CAST(c_custkey AS VARCHAR(20)) AS cell, c_mktsegment AS cell_type,
        CAST(c_nationkey AS VARCHAR(20)) AS batch FROM customer""",
    "mxs": """SELECT CAST(l_suppkey AS VARCHAR(20)) AS cell, p_brand AS feature, sum(l_quantity) AS value,
        sum(l_quantity * l_discount) AS mc, sum(l_quantity) AS cov
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand""",
    "mxt": """SELECT CAST(l_suppkey AS VARCHAR(20)) AS cell, concat('t_', p_type) AS feature,
        sum(l_extendedprice) / 1000 AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_type""",
    "cells": """SELECT CAST(vec_id AS VARCHAR(20)) AS cell, CAST(embedding AS ARRAY_OF_DOUBLE) AS rep,
        CAST(label AS VARCHAR(20)) AS cell_type, CAST(vec_id % 3 AS VARCHAR(20)) AS batch,
        CAST(vec_id % 2 AS VARCHAR(20)) AS domain FROM embeddings""",
    "ed": """SELECT concat('s', l_suppkey) AS source, concat('p', l_partkey) AS target,
        1 - l_discount AS weight, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign,
        l_linestatus AS type, CAST(l_quantity AS BIGINT) AS dist FROM lineitem""",
    "ed2": """SELECT concat('p', l_partkey) AS source, concat('c', o_custkey) AS target
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ls": """SELECT labels.doc_id, quality AS label, CAST(n_chars AS DOUBLE) AS score
        FROM labels JOIN documents ON labels.doc_id = documents.doc_id""",
    "runs": """SELECT o_orderkey AS run, o_orderpriority AS dataset, o_orderstatus AS method,
        o_orderkey % 8 AS seed, o_totalprice AS m1, CAST(o_custkey AS DOUBLE) AS m2,
        CAST(o_orderkey % 97 AS DOUBLE) AS m3, CAST(o_orderkey % 89 AS DOUBLE) AS m4,
        CAST(o_orderkey % 83 AS DOUBLE) AS m5, CAST(o_orderkey % 79 AS DOUBLE) AS m6 FROM orders""",
}

# The two spots where the engines' spellings differ.
EPOCH_SPARK = "SELECT *, unix_timestamp(ts) AS epoch_s FROM events"
EPOCH_DUCK = "SELECT *, floor(epoch(ts)) AS epoch_s FROM events"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a role view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return sql(spark, sf_dir, f"SELECT * FROM {name}")


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the base tables and role views of one scale factor."""
    views = {n: b for n, b in VIEWS.items() if _mentions(text, n)}
    needed = " ".join([text, *views.values()])
    if _mentions(needed, "ev_epoch"):
        needed += " events"
    for t in TABLES:
        if _mentions(needed, t):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    if _mentions(needed, "ev_epoch"):
        spark.sql(EPOCH_SPARK).createOrReplaceTempView("ev_epoch")
    for name, body in views.items():
        body = body.replace("ARRAY_OF_DOUBLE", "ARRAY<DOUBLE>").replace('"start"', "`start`").replace('"end"', "`end`")
        spark.sql(body).createOrReplaceTempView(name)
    return spark.sql(text)


def duck(text: str) -> str:
    """DuckDB twin: the role views the text needs become leading CTEs."""
    ctes = []
    if _mentions(text, "ev_iv") or _mentions(text, "ev_epoch"):
        ctes.append(f"ev_epoch AS ({EPOCH_DUCK})")
    for name, body in VIEWS.items():
        if _mentions(text, name):
            ctes.append(f"{name} AS ({body.replace('ARRAY_OF_DOUBLE', 'DOUBLE[]')})")
    if not ctes:
        return text
    stripped = text.strip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + stripped[len("WITH RECURSIVE "):]
    if stripped.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + stripped[len("WITH "):]
    return "WITH " + ", ".join(ctes) + " " + stripped
