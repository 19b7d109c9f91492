"""A corpus pipeline over the documents table: language, exact and near duplicates, benchmark passages, source mix.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last return the columns of ``docs``; the last
adds ``copies``, how often the mix takes a row. Null and empty texts are dropped by the first stage, as they are in no language; null
keys and sources are values of their own; an empty table stays empty. Further columns of ``docs``, whatever their names, are passed on.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opslens.llm import decontaminate, exact_dedup, langid, mixing, near_dedup
from opslens.llm.common import stored, table
from opslens.llm.registry import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the languages that ``docs`` is labelled with."""
    return langid.in_known_language(docs, langid.fit(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each class of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark table."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix of sources takes, with the column copies."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mix),
]

#: language identification and alignment of near duplicates can't be told in SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table; each result is written to the shared folder and read back."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
