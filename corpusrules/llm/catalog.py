"""The dealt operators as registered queries: ``(spark, sf_dir) -> DataFrame`` over whole tables, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusrules.llm import decontaminate, hmm, jaccard, langid, merkle, mixing, neighbours, packing, quality, repeats, sharding, tokens, whitening
from corpusrules.llm.oracles import ORACLES as ORACLES
from corpusrules.llm.storage import table, written


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Answers are read from the written sums, without encoding texts again.
    return tokens.answered(written(tokens.token_counts(table(spark, sf_dir, "documents")), "sums"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(jaccard.similar_documents(table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("statistics")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_rows(table(spark, sf_dir, "documents"))


def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.without_repeats(table(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mixed_rows(table(spark, sf_dir, "documents")))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.sharded(table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whitened(table(spark, sf_dir, "embeddings")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_quality": op4_quality,
    "op5_language_id": op5_language_id,
    "op6_neighbours": op6_neighbours,
    "op7_token_ids": op7_token_ids,
    "op8_hmm_scores": op8_hmm_scores,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mixing": op10_mixing,
    "op11_sharding": op11_sharding,
    "op12_whitening": op12_whitening,
    "op13_merkle": op13_merkle,
}
