"""A training corpus from raw documents: the stages in order, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import decontaminate, line_dedup, packing, quality_rules, queries, simhash
from lorekeep.session import ship, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger accepts."""
    return quality_rules.accepted(docs)


def line_level(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with one line left of each group of similar lines of all documents."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    ship(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule does not condemn."""
    benchmark = queries.table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, benchmark, remove="documents").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token pieces."""
    ship(spark)
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_level),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: MinHash bands, SimHash components, BPE and Karmarkar-Karp packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
