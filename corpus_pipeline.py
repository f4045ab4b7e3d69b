"""Corpus pipeline: the stages applied one after another to ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row that its
predecessor kept; its result is written as Parquet to the shared folder and
read again as the next stage's input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quiver.llm import bpe, exact_dedup, mixing, near_dup, toxicity
from quiver.llm.common import documents, labels, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go (operator 3)."""
    return toxicity.without_toxic(docs, labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays (operator 9)."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (operator 2)."""
    return near_dup.one_per_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the target mixture, whole texts only; a document taken twice is two rows (operator 4)."""
    return mixing.mixed_documents(docs, mixing.label_quality(labels(spark, sf_dir)), whole=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes (operator 6)."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_digest(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: Toxicity scores and MinHash groups can't be stated in SQL; tests compare
#: every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
