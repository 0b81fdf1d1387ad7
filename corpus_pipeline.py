"""The corpus pipeline: five stages over ``documents``, each stored as Parquet before the next.

Quality rules drop documents (and failed hosts), near duplicates keep one document a component
(five-word shingles, similarity 0.8), contaminated documents go, sources are mixed to their target
weights, and the rest is written as bit-packed token ids.  A stage's table is deleted once the next one is stored.
Null ids and texts, repeated rows, very long texts, empty tables and columns with clashing names have the results that the stages'
operators define; columns keep their names and values.  ``STAGES`` functions take
(spark, docs, sf_dir); all but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import decontamination, mixing, near_dup, quality, token_output
from pixelloom.llm.common import col, drop_stored, stored, table
from pixelloom.llm.queries import TOKENIZER


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator adds, and the names; ``_back`` restores them."""
    names = {c: f"_doc_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(col(docs, c).alias(n) for c, n in names.items())), names


def _back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*(col(docs, n).alias(c) for c, n in names.items()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the document rules and their host's verdict keep."""
    own, n = _apart(docs)
    return _back(quality.judge(own, text=n["text"], host=n["source"]).where("kept"), n)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id."""
    return near_dup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by ``benchmark``."""
    own, n = _apart(docs)
    return _back(decontamination.scan(own, table(spark, sf_dir, "benchmark"), text=n["text"]).where("not contaminated"), n)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed shards; returns what is read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output.encode_documents(docs, public_tokenizers.path(TOKENIZER), small=True)  # the executors hold four stages' heap


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("source mixing", mix_sources),
    ("token output", token_ids),
]

#: The tokenizer and the chosen-path join aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop_stored(docs)  # the stage before, which nothing reads again; the given table isn't ours
        docs = kept
    return docs
