"""Text embedding and synthetic vectors."""

import numpy as np
from pyspark.sql import functions as F

from quiver.operators import embed


def test_hashed_embedding(spark):
    df = spark.createDataFrame([(1, "Blue dress, blue!"), (2, ""), (3, None), (4, "été Straße")], "id long, t string")
    out = {r["id"]: r["e"] for r in embed.embed_text(df, "t", dim=32, id_col="id", out_col="e").collect()}
    v = np.array(out[1])
    assert len(v) == 32 and abs(np.linalg.norm(v) - 1) < 1e-12
    assert np.count_nonzero(v) == 2  # "blue" twice, "dress" once
    assert out[2] is None and out[3] is None and out[4] is not None


def test_xxhash_option_and_multimodal_width(spark):
    df = spark.createDataFrame([(1, "red shoes")], "id long, t string")
    e = embed.embed_text(df, "t", dim=embed.MULTIMODAL_DIM, id_col="id", hash_method="xxhash64").first()["embedding"]
    assert len(e) == 1408


def test_backend(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, t string")
    e = embed.embed_text(df, "t", dim=3, backend=lambda texts: [[len(t), 0, 1] for t in texts]).collect()
    assert [r["embedding"] for r in e] == [[1.0, 0.0, 1.0], [2.0, 0.0, 1.0]]


def test_synthetic_repeatable(spark):
    df = spark.range(5).select(F.col("id"))
    a = df.select(embed.synthetic_vector(F.col("id"), 16, seed=3).alias("v")).collect()
    b = df.repartition(3).orderBy("id").select(embed.synthetic_vector(F.col("id"), 16, seed=3).alias("v")).collect()
    assert a == b
    vals = np.array([x for r in a for x in r["v"]])
    assert vals.min() >= -1 and vals.max() < 1 and len(set(vals)) == len(vals)


def test_synthetic_vectors_repeatable_and_uniform(spark):
    from pyspark.sql import functions as F

    from quiver.operators import embed

    ids = spark.range(200).withColumnRenamed("id", "k")
    for method in ("md5", "xxhash64"):
        col = embed.synthetic_vector(F.col("k"), 16, seed=5, hash_method=method).alias("v")
        a = [r["v"] for r in ids.select(col).orderBy(F.col("v")[0]).collect()]
        b = [r["v"] for r in ids.repartition(7).select(col).orderBy(F.col("v")[0]).collect()]
        assert a == b  # same key, same vector, whatever the partitioning
        flat = np.array(a).ravel()
        assert len(flat) == 3200 and flat.min() >= -1 and flat.max() < 1
        assert abs(flat.mean()) < 0.05 and len(set(flat.tolist())) == 3200


def test_backend_is_given_a_bounded_part_of_a_batch(spark):
    df = spark.range(1000).selectExpr("id", "'a' as t").coalesce(1)
    e = embed.embed_text(df, "t", dim=1408, backend=lambda texts: np.full((len(texts), 1408), len(texts)))
    sizes = [r["n"] for r in e.select(F.col("embedding")[0].alias("n")).collect()]
    assert len(sizes) == 1000 and max(sizes) * 1408 * 8 <= embed.BACKEND_BYTES


def test_rows_are_joined_before_they_are_dense(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (1, "c")], "id long, t string")
    e = embed.embed_text(df, "t", dim=8, id_col="id")
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")
    assert sorted((r["t"] or "", r["embedding"] is None) for r in e.collect()) == [("", True), ("a b", False), ("c", False)]
