"""Bitmap index on payload labels (P7): a filtered search reads only blocks that hold a match.

``build`` writes points in blocks that are partitions of one Parquet table::

    points/block=N   at most about ``rows_per_block`` points, ordered by their label set
    bitmaps/         a row per (label, bucket): bit b is set if block b of the bucket holds the label
    blocks/          one row: the number of blocks

Points with the same labels fall into neighbouring blocks, and the id's hash
splits a label set that fills more than one, so a hot label is many blocks and
a rare one few.  ``candidate_blocks`` unites or intersects the bitmaps of the asked
labels and lists the set bits; ``matching`` joins that list with the
partition column, which Spark turns into dynamic partition pruning: other
blocks are not opened.  The row filter still runs, so the answer is that of
the plain filter.

A null label array, a null label and an empty array match nothing; a label given
twice counts once; points keep all their columns.  A point table with a column ``block``
is refused, because that name is the partition's.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Points of a block: at 1,408 floats a vector about 1.5 GB.
ROWS_PER_BLOCK = 1 << 18
#: Block numbers that may be broadcast (8 bytes each); longer lists are joined by a shuffle.
BROADCAST_BLOCKS = 1 << 20
#: Bits of one of Spark's bitmaps, which number their bits from 1.
BUCKET_BITS = 32_768


def build(points: DataFrame, path: str, labels_col: str = "groups", id_col: str = "id",
          rows_per_block: int = ROWS_PER_BLOCK) -> None:
    """Write ``points`` as blocks under ``path`` with a bitmap per label.

    One count for the number of blocks, one shuffle by range of the label set,
    and one scan of the label column for the bitmaps, combined map-side."""
    if "block" in points.columns:
        raise ValueError("the points have a column named block")
    spark, base = points.sparkSession, path.rstrip("/")
    n_blocks = max(1, -(-points.count() // rows_per_block))
    label_set = F.array_join(F.array_sort(F.array_distinct(labels_col)), "\x1f")
    dealt = points.repartitionByRange(n_blocks, label_set, F.xxhash64(id_col))
    dealt.withColumn("block", F.spark_partition_id().cast("long") + 1).write.partitionBy("block").parquet(f"{base}/points")
    held = spark.read.schema(f"block long, `{labels_col}` array<string>").parquet(f"{base}/points")
    bitmaps = (
        held.select("block", F.explode(labels_col).alias("label"))
        .filter(F.col("label").isNotNull())
        .groupBy("label", F.bitmap_bucket_number("block").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("block")).alias("bits"))
    )
    bitmaps.write.parquet(f"{base}/bitmaps")
    spark.range(1).select(F.lit(n_blocks).cast("long").alias("n"), F.lit(points.schema.json()).alias("points")).coalesce(
        1
    ).write.parquet(f"{base}/blocks")


def _asked(labels: Sequence[str], match: str) -> list[str]:
    if match not in ("any", "all"):
        raise ValueError("match must be 'any' or 'all'")
    asked = sorted(set(labels))
    if not asked:
        raise ValueError("no label given")
    return asked


def candidate_blocks(spark: SparkSession, path: str, labels: Sequence[str], match: str = "any") -> DataFrame:
    """``block`` of every block that may hold a point with any (all) of the labels."""
    asked = _asked(labels, match)
    rows = spark.read.schema("label string, bucket long, bits binary").parquet(f"{path.rstrip('/')}/bitmaps")
    combine = F.bitmap_or_agg if match == "any" else F.bitmap_and_agg
    found = rows.filter(F.col("label").isin(asked)).groupBy("bucket").agg(
        combine("bits").alias("bits"), F.count(F.lit(1)).alias("labels")
    )
    if match == "all":
        found = found.filter(F.col("labels") == len(asked))
    bytes_ = found.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(BUCKET_BITS // 8 - 1))).alias("at")).select(
        "bucket", "at", F.conv(F.hex(F.substring("bits", F.col("at") + 1, F.lit(1))), 16, 10).cast("int").alias("byte")
    )
    bits = bytes_.filter("byte <> 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    return bits.filter(F.expr("(byte & shiftleft(1, bit)) <> 0")).select(
        ((F.col("bucket") - 1) * BUCKET_BITS + F.col("at") * 8 + F.col("bit") + 1).alias("block")
    )


def label_filter(labels: Sequence[str], match: str = "any", labels_col: str = "groups") -> Column:
    """The row filter: the labels hold any (all) of those asked."""
    tests = [F.array_contains(labels_col, label) for label in _asked(labels, match)]
    out = tests[0]
    for test in tests[1:]:
        out = out | test if match == "any" else out & test
    return out


def matching(spark: SparkSession, path: str, labels: Sequence[str], match: str = "any",
             labels_col: str = "groups") -> DataFrame:
    """The indexed points that hold any (all) of ``labels``, read from candidate blocks only."""
    base = path.rstrip("/")
    head = spark.read.schema("n long, points string").parquet(f"{base}/blocks").first()
    schema = T.StructType.fromJson(json.loads(head["points"]))
    rows = spark.read.schema(schema.add("block", T.LongType())).parquet(f"{base}/points")
    blocks = candidate_blocks(spark, path, labels, match)
    blocks = F.broadcast(blocks) if head["n"] <= BROADCAST_BLOCKS else blocks
    return rows.filter(label_filter(labels, match, labels_col)).join(blocks, "block", "left_semi").drop("block")
