"""Small helpers shared by the training-data operators.

White space and words follow one rule everywhere: white space is
``[\\x20\\x09-\\x0D]+`` and a word is a run of anything else.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.session import scratch_path

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut
    and a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``, is 0.  A null id counts as an
    empty text (crc32 0) and so is held out."""
    as_text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(as_text) % folds == 0


def training_ids(labels_df: DataFrame, label: str, limit: int, id_column: str = "doc_id") -> DataFrame:
    """At most ``limit`` labelled ids outside the held-out fold (a documented
    bound of every classifier here), chosen by a hash of the id.  Conflicting
    labels of one id are settled by their mean; null labels don't count."""
    return (
        labels_df.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
        .where(~held_out(id_column))
        .groupBy(F.col(id_column).alias("doc_id"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )


#: Columns of ``documents`` that a stage may read or change.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keeps_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a stage that returns rows of its input: other columns pass through
    under plain names of their own, so none can clash with the stage's."""

    @wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        plain = [c if c in DOCUMENT_COLUMNS else f"extra_{i}" for i, c in enumerate(docs.columns)]
        return stage(docs.toDF(*plain), *args, **options).toDF(*docs.columns)

    return run
