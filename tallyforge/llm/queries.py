"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_counts, byte_pairs, lexical, mixing, negatives, orc_tokens, pieces, repeats, simhash, tiff, toxicity, vectors
from .common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.removals(table(spark, sf_dir, "documents"), repeats.WORDS, first_stays=False)
    return found.select("doc_id", found.n_units.alias("n_words"), "n_removed", "kept_sha256", "n_spans")


def op3_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.removals(table(spark, sf_dir, "documents"), repeats.BYTES, first_stays=True)
    return found.select("doc_id", found.n_units.alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op6_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_report(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.token_file_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": mixing.ORACLE_SQL, "op12_hard_negatives": negatives.ORACLE_SQL, "op13_lexical_search": lexical.ORACLE_SQL}
