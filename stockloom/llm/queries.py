"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import alignment, divergence, language, mixing, near_text, near_vectors, packing, quality_model, quality_rules, repeats, sharding, toxicity, wavelet
from stockloom.sources.tables import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(quality_rules.measure_quality(table(spark, sf_dir, "documents"))).drop("spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify_language(docs, language.fit_language(docs))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").withColumn("grade", quality_model.rating())
    return quality_model.score_quality(docs, quality_model.fit_quality(docs, ratings))


def op7_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicate_texts(table(spark, sf_dir, "documents"), threshold=85).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shuffle_shards(table(spark, sf_dir, "documents"), 40)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), 50).drop("spans")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_pack_best_fit, op3_quality_rules, op4_toxicity, op5_language, op6_quality_model, op7_wavelet_files, op8_near_texts, op9_near_vectors, op10_shards, op11_source_divergence, op12_token_alignment, op13_repeated_windows)}

#: The others cannot be written in SQL; tests/llm holds them against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {"op11_source_divergence": divergence.SOURCE_DIVERGENCE_SQL, "op13_repeated_windows": repeats.REMOVE_REPEATS_SQL}
