"""The corpus pipeline: raw documents to packed training sequences in five stages.

quality rules -> SimHash near-dedup -> substring dedup -> mixing -> packing

Each stage reads what the one before it wrote, keeps the columns of
``documents`` (the last returns sequences) and calls one operator of
:mod:`finledger.llm`. There is no SQL for the rows of :func:`run`: fingerprints
and token ids cannot be expressed in it; the tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finledger.llm import mixing, packing, quality_rules, simhash_dedup, substring_dedup
from finledger.llm._common import table, written


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are frequent across documents and drops rejected documents."""
    return _with_length(quality_rules.clean(docs), docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of SimHash near-duplicates (3-word shingles, 3 bits)."""
    return simhash_dedup.deduplicate(docs, shingle=3, max_bits=3)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated 13-word passages; texts are the kept words joined by one space."""
    others = [c for c in docs.columns if c != "text"]
    out = substring_dedup.remove_repeats(docs, keep=others).withColumnRenamed("kept_text", "text")
    return _with_length(out, docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents to the target weights of their sources."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("substring dedup", substring_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Not expressible: XXH64 fingerprints and tokenizer ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; every stage is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
