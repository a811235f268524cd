"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the
last return the columns of ``documents``; the last adds each row's shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daymark.llm import decontaminate, line_rules, mixing, near_text, shards
from daymark.llm.words import table
from daymark.session import materialize

SHARD_BYTES = 1 << 20
#: Share of the tokens that the mixture keeps, whatever the rarest cell weighs.
MIX_RATE = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return line_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id: five-word
    shingles, Jaccard similarity of 0.8 or more."""
    return near_text.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the tempered shares of source, language and topic."""
    return mixing.sample_mixed(docs, rate=MIX_RATE)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the shard that it is written to."""
    return shards.shard(docs, max_bytes=SHARD_BYTES)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", sharding),
]

#: XXH64 fingerprints and content keys have no SQL counterpart; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
