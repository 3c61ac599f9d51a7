"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from perchero.llm import (
    codebooks, conversation_trie, decontaminate, jaccard, licenses, packing, pitman_yor, pseudonyms, quality,
    repeats, separators, tokenfiles, toxicity,
)
from perchero.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("version", "items")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents")).drop("kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.drop("ids")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.written_and_read(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("spans")


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.replaced(documents)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "rule")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(table(spark, sf_dir, "embeddings"))[0]


def op13_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored(table(spark, sf_dir, "documents"))


def registered() -> dict[str, Query]:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_packing": op2_packing,
        "op3_toxicity": op3_toxicity,
        "op4_token_id_output": op4_token_id_output,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_license_scan": op6_license_scan,
        "op7_pii_pseudonyms": op7_pii_pseudonyms,
        "op8_quality_rules": op8_quality_rules,
        "op9_token_counts": op9_token_counts,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_vector_codes": op12_vector_codes,
        "op13_pitman_yor": op13_pitman_yor,
    }
