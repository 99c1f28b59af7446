"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.functions.runtime import cut_lineage
from strandloom.llm.decontaminate import decontaminated
from strandloom.llm.mixing import mixture
from strandloom.llm.quality_rules import keep_good
from strandloom.llm.queries import table, tokenizer_path
from strandloom.llm.records import tokenized
from strandloom.llm.simhash import deduplicated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources at their target weights, repeats as rows."""
    return mixture(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of the mixture, read back from their files."""
    return tokenized(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mixing), ("token_records", token_records)]

#: Fingerprints and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the documents table on; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
