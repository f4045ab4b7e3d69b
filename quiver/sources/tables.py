"""Scans of the driver-provided parquet tables.

Every loader returns a lazy DataFrame; column pruning and predicate pushdown
happen in the parquet scan once an operator selects or filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; expected one of {TABLES}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    """Register every table as a temporary view for ``spark.sql``."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def input_files(df: DataFrame) -> int:
    """Number of files the frame reads (from the plan; no job runs)."""
    return len(df.inputFiles())


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a frame read from fewer files than the cluster has cores.

    Used before CPU-heavy per-row work (tokenising whole texts, scoring
    vectors): a small or single-file input would otherwise run in one task.
    A frame read from at least as many files as there are cores is returned
    unchanged, so a large scan is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if input_files(df) >= cores:
        return df
    return df.repartition(cores)
