"""From documents to packed training sequences: rules, quality model, near-duplicates, mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, written as Parquet and read again as the next one's
``docs``. All but the last return the columns of documents, and columns of other names pass through. An empty table gives an
empty one at every stage. Draws and ties depend on ids and texts alone, so that a run is repeated by the same rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stockloom.llm import mixing, near_text, packing, quality_model, quality_rules
from stockloom.plans.durable import staged
from stockloom.sources.tables import table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts, and those under 50 words, go; repeated rows stay or go together."""
    return quality_rules.filter_quality(docs)


def quality_model_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the rated ones among them, keeps.

    A row with a null label that decides its grade teaches nothing; without any rated document all stay. Null and empty texts are
    graded by the thresholds alone, repeated rows alike.
    """
    ratings = table(spark, sf_dir, "labels").withColumn("grade", quality_model.rating())
    return quality_model.select_quality(docs, quality_model.fit_quality(docs, ratings))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Of rows with the same id and text one stays; texts that share an id are documents of their own; null ids and texts without words stay.
    """
    return near_text.keep_one_text(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated rows up to the target of their source, null sources as one of their own.

    Texts without words come once an epoch, and once where there is none.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and places. Null and empty texts are one end token; a repeated row has pieces of its own."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_model", quality_model_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The models and random draws cannot be written in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
