"""Loads behind the Bloom filter: the rows of the plain load, few lookups."""

import pytest
from pyspark.sql import functions as F

from quiver.operators import id_filter, points
from quiver.session import scratch_path


def _batch(spark, start, stop, tag):
    return spark.range(start, stop).select("id", F.lit(tag).alias("tag"), (F.col("id") * 0.5).alias("x"))


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("as_text", [False, True])
def test_equals_the_plain_load(spark, as_text):
    path = scratch_path(spark, "filtered")
    id_filter.create(spark, path, blocks=2, parts=2)
    ids = F.concat(F.lit("n"), "id") if as_text else F.col("id")
    batches = [_batch(spark, 0, 900, "a"), _batch(spark, 600, 1500, "b"), _batch(spark, 0, 0, "none"), _batch(spark, 1400, 9000, "c")]
    twice = _batch(spark, 8000, 9500, "d").unionByName(_batch(spark, 8900, 9600, "d"))
    batches.append(twice.unionByName(spark.createDataFrame([(None, "null", 0.0)], "id long, tag string, x double")))
    schema, plain = None, None
    for i, b in enumerate(batches):
        b = b.withColumn("id", ids)
        schema = schema or b.schema
        plain = points.upsert(plain, b.where("id is not null")) if plain else points.dedupe_by_id(b)
        id_filter.load(spark, path, b, f"b{i}")
    assert _rows(id_filter.rows(spark, path, schema)) == _rows(plain.select(*schema.fieldNames()))
    assert id_filter._shape(spark, path)[1] == 8  # grown beyond 2 blocks of 2,048 ids


def test_new_ids_need_few_lookups(spark):
    path = scratch_path(spark, "filtered-new")
    id_filter.create(spark, path, blocks=64, parts=64)
    id_filter.load(spark, path, _batch(spark, 0, 50_000, "a"), "a")
    new = id_filter.load(spark, path, _batch(spark, 50_000, 55_000, "b"), "b").first()
    assert new.given == new.stored == 5000
    assert new.looked_up < 50 and new.parts_read < 40  # 0.24 % of the ids at capacity, less below
    again = id_filter.load(spark, path, _batch(spark, 100, 300, "c"), "c").first()
    assert again.looked_up == 200 and again.stored == 0


def test_repeated_and_interrupted_loads(spark):
    path = scratch_path(spark, "filtered-again")
    id_filter.create(spark, path, blocks=4, parts=4)
    a, b = _batch(spark, 0, 100, "a"), _batch(spark, 50, 150, "b")
    id_filter.load(spark, path, a, "a")
    assert id_filter.load(spark, path, a, "a").first().stored == 100  # replaces itself
    # a load that was cut off after its rows were written: nothing of it is indexed
    _batch(spark, 100, 120, "cut").write.parquet(f"{path}/points/batch=cut")
    assert id_filter.load(spark, path, b, "b").first().stored == 30
    tags = id_filter.rows(spark, path, a.schema).groupBy("tag").count().collect()
    assert {r.tag: r["count"] for r in tags} == {"a": 100, "cut": 20, "b": 30}


def test_bitmaps_are_merged(spark, monkeypatch):
    monkeypatch.setattr(id_filter, "MERGE_AFTER", 2)
    path = scratch_path(spark, "filtered-merge")
    id_filter.create(spark, path, blocks=4, parts=2)
    for i in range(4):
        id_filter.load(spark, path, _batch(spark, 10 * i, 10 * i + 15, str(i)), f"b{i}")
    version = id_filter._shape(spark, path)[0]
    assert version == 1 and id_filter._batches(spark, id_filter._index(path, version, "bits")) == {"merged", "b3"}
    assert id_filter.rows(spark, path, _batch(spark, 0, 1, "").schema).count() == 45
