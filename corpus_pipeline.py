"""A training corpus from raw documents: five stages, each written and read again by the next.

Quality rules reject documents, line dedup takes boilerplate lines out, the Jaccard join
keeps one document of each near-duplicate group, decontamination drops documents that hold
benchmark windows, and the last stage encodes what is left. All but the last return the
columns of their input. Each stage's defined results for nulls, empty texts, repeated rows
and empty tables are those of its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cuestream.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from cuestream.llm.shared import keep, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.reject(docs)


def remove_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), their digest and that of the decoded bytes."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", reject_low_quality),
    ("line_dedup", remove_boilerplate_lines),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_documents),
    ("byte_level_bpe", encode),
]

#: The merges of the last stage cannot be expressed in SQL; tests/llm/test_queries.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs
