"""One query per operator, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lograft.llm import oracles, quality, resampling, topk
from lograft.llm.common import table
from lograft.llm.jaccard import similar_classes
from lograft.llm.packing import pack_documents
from lograft.llm.personal import report_personal_data
from lograft.llm.pieces import round_trips
from lograft.llm.sharding import shard_documents
from lograft.llm.substring import substring_dedup
from lograft.llm.suffix import repeated_bytes
from lograft.llm.token_counts import count_tokens
from lograft.llm.tokens import TokenizerFile
from lograft.llm.toxicity import score_documents
from lograft.llm.whitening import whitened_vectors


def word_bpe() -> TokenizerFile:
    return TokenizerFile(public_tokenizers.path("word_bpe_49k.json"), white_free=True)


def suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"), length=50)


def top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"))


def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=13)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_bpe())


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), word_bpe())


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), k=5)


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_personal_data(table(spark, sf_dir, "documents"))


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resampled(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10,
        least_words=20, longest=1, buckets=10_000, seed=2024,
    )
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_vectors(table(spark, sf_dir, "embeddings"), k=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": suffix_array,
    "op2_top_k_search": top_k_search,
    "op3_quality_rules": quality_rules,
    "op4_sentencepiece": sentence_pieces,
    "op5_toxicity": toxicity,
    "op6_substring_dedup": substrings,
    "op7_best_fit_packing": packing,
    "op8_ngram_jaccard_join": jaccard_join,
    "op9_token_counts": token_counts,
    "op10_sharding": sharding,
    "op11_personal_data": personal_data,
    "op12_importance_resampling": importance_resampling,
    "op13_embedding_whitening": embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": oracles.SUFFIX_ARRAY,
    "op2_top_k_search": topk.SQL,
    "op3_quality_rules": quality.SQL,
    "op6_substring_dedup": oracles.SUBSTRINGS,
    "op8_ngram_jaccard_join": oracles.JACCARD,
    "op10_sharding": oracles.SHARDING,
    "op12_importance_resampling": resampling.SQL,
}
