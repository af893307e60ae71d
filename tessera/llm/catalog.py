"""The registered queries of the corpus operators: thin, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, hnsw_search, language_id, lexical_search, mixture, periodic_runs, phrase_dedup, quality_model, shard_store, simhash_dedup, suffix_dedup, syncmer_prints, token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_search.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir))))


def op3_syncmer_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer_prints.document_prints(documents(spark, sf_dir))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_model.scores(docs, quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(documents(spark, sf_dir)))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(documents(spark, sf_dir))


def op7_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.digest(phrase_dedup.phrase_dedup(documents(spark, sf_dir)))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.digest(mixture.mix_sources(documents(spark, sf_dir)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op10_shard_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_store.sharded(documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(documents(spark, sf_dir), edit=periodic_runs.looped_tail))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hnsw_search, op2_byte_bpe, op3_syncmer_prints, op4_quality_model, op5_suffix_dedup, op6_simhash_dedup, op7_phrase_dedup, op8_mixture, op9_token_counts, op10_shard_store, op11_lexical_search, op12_language_id, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    """SQL has no pre-tokeniser, kernel regression, XXH64 or code for the others; they are tested by brute force."""
    return {"op10_shard_store": shard_store.ORACLE_SQL, "op11_lexical_search": lexical_search.ORACLE_SQL}
