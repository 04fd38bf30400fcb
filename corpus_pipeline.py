"""A training corpus in five stages: quality rules, near-duplicates, benchmark passages, source mixing, token files.

``run(spark, sf_dir)`` applies ``STAGES`` to ``documents``; each stage's rows are written to the session's shared folder
and read again as the next one's input. A stage that is given an empty table returns an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, orderhash, repeats, tokenfiles
from tessera.llm.common import free_name, pin, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the repetition limits reject go."""
    into = free_name(docs, "repetition")
    return repeats.repetition_rules(docs).where(F.col(into)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return orderhash.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until the sources have their weights; none is dropped."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document (and each repeat), read back from the Arrow files."""
    return tokenfiles.token_index(docs, tokenfiles.public_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("source_mixing", source_mixing),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name)
    return docs


#: the token stage needs the tokenizers library, so there is no SQL; see tests/llm for the brute-force comparison
ORACLE_SQL = None
