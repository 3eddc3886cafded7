"""The training corpus, stage by stage: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import decontam, mixing, neardup, quality, sharding
from tablewright.llm.common import discarding, read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark."""
    return decontam.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every copy."""
    return sharding.shard_documents(docs, keep=("lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Robust scatter and near-duplicate components are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; every stage but the last is written to the shared folder.

    What a stage wrote on its way, and what the stage before it kept, is deleted once its own rows are written; the last
    stage reads its input and its own tables when the result is asked for.
    """
    docs = read(spark, sf_dir, "documents")
    with discarding(spark) as kept:
        for _, stage in STAGES[:-1]:
            with discarding(spark) as made:
                docs = written(stage(spark, docs, sf_dir))
                kept.append(made.pop())
        kept.pop()
    return STAGES[-1][1](spark, docs, sf_dir)
