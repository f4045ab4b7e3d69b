"""The bitmap index against the plain filter; the plan; how many blocks are read."""

import random

import pytest
from pyspark.sql import functions as F

from quiver.operators import knn, payload_index
from quiver.session import scratch_path

SCHEMA = "id long, vector array<double>, groups array<string>, note string"


def _points(spark):
    """Two thirds 'men'; one rare label; null and empty arrays, a null label, a label twice, odd names."""
    rng = random.Random(4)
    rows = [(i, [rng.random() for _ in range(4)], ["men"] if i % 3 else ["women", "sport"], "n") for i in range(900)]
    rows += [(1000 + i, [0.1 * i, 1.0, 0.0, 0.5], ["rare", "men"], None) for i in range(5)]
    rows += [(2000, [1.0] * 4, None, "x"), (2001, [1.0] * 4, [], "x"), (2002, [1.0] * 4, [None, "rare"], "x"),
             (2003, [1.0] * 4, ["men", "men"], "x"), (2004, [1.0] * 4, ["a'b\x1f", "龍"], "x"), (2003, [1.0] * 4, ["men", "men"], "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def indexed(spark):
    path = scratch_path(spark, "payload-index")
    points = _points(spark)
    payload_index.build(points, path, rows_per_block=50)
    return points, path


@pytest.mark.parametrize("match", ["any", "all"])
@pytest.mark.parametrize("asked", [["men"], ["rare"], ["rare", "men"], ["women", "men"], ["none"], ["none", "men"], ["a'b\x1f", "龍"], ["men", "men"]])
def test_equals_plain_filter(spark, indexed, asked, match):
    points, path = indexed
    want = sorted((r for r in points.collect() if (any if match == "any" else all)(a in (r["groups"] or []) for a in asked)), key=str)
    got = payload_index.matching(spark, path, asked, match)
    assert got.columns == points.columns
    assert sorted(got.collect(), key=str) == want


def test_only_candidate_blocks_are_read(spark, indexed):
    _, path = indexed
    blocks = spark.read.parquet(path + "/points").select("block").distinct().count()
    rare = {r["block"] for r in payload_index.candidate_blocks(spark, path, ["rare"]).collect()}
    held = spark.read.parquet(path + "/points").filter(F.array_contains("groups", "rare")).select("block").distinct()
    assert rare == {r["block"] for r in held.collect()}
    assert blocks >= 15 and len(rare) <= 4
    both = {r["block"] for r in payload_index.candidate_blocks(spark, path, ["rare", "women"], "all").collect()}
    assert both <= rare
    found = payload_index.matching(spark, path, ["rare"])
    plan = found._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()


def test_a_hot_label_is_many_blocks(spark, indexed):
    _, path = indexed
    sizes = [r["count"] for r in spark.read.parquet(path + "/points").groupBy("block").count().collect()]
    assert max(sizes) < 4 * 50


def test_knn_on_the_index(spark, indexed):
    points, path = indexed
    queries = points.filter("id < 20").select(F.col("id").alias("query_id"), "vector")
    want = knn.knn_search(points, queries, k=3, filter=F.array_contains("groups", "rare")).collect()
    got = knn.knn_search(payload_index.matching(spark, path, ["rare"]), queries, k=3).collect()
    key = lambda rows: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in rows)
    assert key(got) == key(want) and len(got) == 60


def test_empty_table_and_bad_calls(spark):
    path = scratch_path(spark, "payload-index")
    none = _points(spark).limit(0)
    payload_index.build(none, path)
    assert payload_index.matching(spark, path, ["men"]).collect() == []
    with pytest.raises(ValueError):
        payload_index.matching(spark, path, [])
    with pytest.raises(ValueError):
        payload_index.candidate_blocks(spark, path, ["men"], "some")
    with pytest.raises(ValueError):
        payload_index.build(none.withColumn("block", F.lit(1)), path)


def test_bits_beyond_one_bucket(spark):
    """Block numbers around a bucket's edge come back from their bits."""
    path = scratch_path(spark, "payload-bits")
    numbers = [1, 8, 9, 32_768, 32_769, 65_536, 65_537, 200_001]
    held = spark.createDataFrame([(n,) for n in numbers], "block long")
    held.groupBy(F.lit("a").alias("label"), F.bitmap_bucket_number("block").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("block")).alias("bits")
    ).write.parquet(path + "/bitmaps")
    got = payload_index.candidate_blocks(spark, path, ["a"]).collect()
    assert sorted(r["block"] for r in got) == numbers
