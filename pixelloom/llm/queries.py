"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, clustering, decontamination, language_id, lm_score, mixing, near_dup, pii, quality, repair, token_output, toxicity, url_filter
from .common import held_out, table
from .oracle import oracle_sql

#: The tokenizer's file; a parameter of the operator, never copied here.
TOKENIZER = "word_bpe_49k.json"
#: The contract's class definition for op9.
SHINGLE, PERCENT = 3, 85


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_entities")


def op2_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"))
    model = language_id.fit(docs, "lang", "text", ~held)
    return language_id.predict(docs, model, held)


def op5_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, held_out(F.col("doc_id")))


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = quality.judge(docs, keep=["doc_id", "source"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.fit_and_score(table(spark, sf_dir, "documents"))


def op8_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontamination.with_digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_dup.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")), gone="gone")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat.as_records(chat.with_planted(table(spark, sf_dir, "conversations")))
    return chat.digest(chat.format_records(records), ["conv_id", "layout"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_pii_surrogates, op2_url_vocabulary, op3_bit_packed_tokens, op4_language_mixture, op5_toxicity_neighbours,
        op6_host_quality, op7_masked_lm, op8_fm_decontamination, op9_chosen_path_dedup, op10_source_mixing, op11_elkan_clusters, op12_conversation_repair,
        op13_chat_format,
    )}


__all__ = ["oracle_sql", "queries"]
