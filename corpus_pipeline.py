"""From raw documents to token ids in five stages, each an operator of tidemark.llm.

A stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of
documents. Stages are joined by Parquet tables in the shared folder, so a lost executor costs tasks of one
stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontam, langid, neardup, suffix
from tidemark.llm.queries import table, tokenizer_path
from tidemark.llm.text import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters, or that no language fits, go."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return neardup.keep_one(docs, Scratch(spark, "pipeline-neardup"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the bytes of 200-byte strings that occur more than once."""
    return suffix.remove_repeats(docs, Scratch(spark, "pipeline-suffix"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (whether the ids decode to the text) of each document."""
    return bpe.encode_ids(docs, tokenizer_path("byte_bpe_50k.json"), Scratch(spark, "pipeline-bpe"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: No SQL: fitted models and edit distances; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, for the documents in sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
