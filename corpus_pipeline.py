"""A document table from raw to encoded, one operator at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofcast.llm.bpe import round_trip
from proofcast.llm.common import cut, ship, table
from proofcast.llm.decontaminate import keep_clean
from proofcast.llm.exact_dedup import keep_first
from proofcast.llm.quality import keep_good
from proofcast.llm.queries import tokenizer_path
from proofcast.llm.simhash import keep_one

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    ship(spark)
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    ship(spark)
    return keep_first(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    ship(spark)
    return keep_one(docs, size=3, bits=3)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    ship(spark)
    return docs.select("doc_id", round_trip(F.col("text"), tokenizer_path()).alias("r")).select("doc_id", "r.*")


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("exact dedup", exact),
    ("simhash", simhash),
    ("decontamination", clean),
    ("encoding", encode),
]

#: Learned scores and fingerprints have no SQL; tests compare each stage with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
