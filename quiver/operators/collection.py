"""Vector collections stored as Parquet folders (C1, C2, S5 sink).

A collection is a folder with

* ``_spec/``      one row: ``name, vectors map<string, struct<size, distance>>,
                  quantized``; every load is checked against it;
* ``points/version=N``  the points;
* ``_current/``   a row per version that became the current one; the last counts;
* ``_rejected/batch=B``  per load, the points that failed the check, with a reason;
* ``_loads/batch=B``     per load, what it counted while it wrote.

An insert-if-absent load appends the points whose id isn't there yet, so
running it again adds nothing.  An overwrite load writes the new state as the
next version beside the current one; a row in ``_current/`` then makes it the
current one.  A load that fails before that row leaves the collection as it
was, and running it again writes the unfinished version anew.  The version
before the current one stays for readers that have begun; older ones are
removed.  Loads of one collection are meant to run one after another, as
Spark's own writers are.

Existence checks, listing and deletion use the Spark catalog / filesystem as
they are (``spark.catalog``, ``DROP``); they are not rebuilt here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.vectors import check_metric
from quiver.operators.points import dedupe_by_id, error_reasons, fresh_rows, point_errors
from quiver.session import scratch_path

POINT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("vectors", T.MapType(T.StringType(), T.ArrayType(T.FloatType()))),
    T.StructField("payload", T.StructType([T.StructField("group", T.ArrayType(T.StringType()))])),
])
SPEC_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("vectors", T.MapType(
        T.StringType(),
        T.StructType([T.StructField("size", T.IntegerType()), T.StructField("distance", T.StringType())]),
    )),
    T.StructField("quantized", T.BooleanType()),
])


def _folder(spark: SparkSession, path: str):
    """``(file system, path)`` as Spark's readers and writers see them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path.rstrip("/") + "/_current")
    return fs.exists(folder)


def create(spark: SparkSession, path: str, name: str, vectors: dict[str, tuple[int, str]],
           quantized: bool = True) -> bool:
    """Create the collection if absent (returns True when created)."""
    for size, metric in vectors.values():
        check_metric(metric)
        if size <= 0:
            raise ValueError("vector size must be positive")
    if exists(spark, path):
        return False
    spec = spark.createDataFrame(
        [(name, {k: (s, m) for k, (s, m) in vectors.items()}, quantized)], SPEC_SCHEMA
    )
    # the pointer comes last, so a creation that was cut off is done again
    spec.coalesce(1).write.mode("overwrite").parquet(path.rstrip("/") + "/_spec")
    spark.createDataFrame([], POINT_SCHEMA).write.mode("overwrite").parquet(_points(path, 0))
    _make_current(spark, path, 0)
    return True


def _points(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/points/version={version}"


def _make_current(spark: SparkSession, path: str, version: int) -> None:
    """The one step that switches versions: a row appended by Spark's writer."""
    row = spark.createDataFrame([(version,)], "version long").coalesce(1)
    row.write.mode("append").parquet(path.rstrip("/") + "/_current")


def version(spark: SparkSession, path: str) -> int:
    """Number of the current version (one integer)."""
    pointer = spark.read.schema("version long").parquet(path.rstrip("/") + "/_current")
    return pointer.agg(F.max("version")).first()[0]


def _remove_version(spark: SparkSession, path: str, number: int) -> None:
    fs, folder = _folder(spark, _points(path, number))
    fs.delete(folder, True)


def spec(spark: SparkSession, path: str) -> dict[str, tuple[int, str]]:
    row = spark.read.parquet(path.rstrip("/") + "/_spec").first()
    return {k: (v["size"], v["distance"]) for k, v in row["vectors"].items()}


def current(spark: SparkSession, path: str) -> DataFrame:
    """The points of the collection."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no collection at {path}")
    return spark.read.schema(POINT_SCHEMA).parquet(_points(path, version(spark, path)))


LOAD_SCHEMA = "total long, loaded long, rejected map<string, long>"


def loads(spark: SparkSession, path: str) -> DataFrame:
    """``batch, total, loaded, rejected`` per load, counted by the load's own
    writing passes: rows given, points written, rows rejected by reason."""
    return spark.read.schema(f"{LOAD_SCHEMA}, batch string").parquet(path.rstrip("/") + "/_loads")


def load(spark: SparkSession, path: str, new_points: DataFrame, check_existing: bool = True,
         on_error: str = "quarantine", batch_id: int | str | None = None) -> DataFrame:
    """Load ``new_points`` and return those rejected, with their reason.

    Every point is checked against the collection's spec: ``quarantine``
    writes bad ones to ``_rejected/``, ``fail`` stops before anything is
    loaded.  ``check_existing=True`` (insert-if-absent, the reference's
    default) adds the ids not yet present; ``False`` replaces points by id.
    The batch is written to the scratch folder once, so it is derived once.
    A load with the ``batch_id`` of an earlier one replaces that one's rejected
    rows and counts."""
    if on_error not in ("quarantine", "fail"):
        raise ValueError("on_error must be 'quarantine' or 'fail'")
    batch_id = uuid.uuid4().hex if batch_id is None else batch_id
    schema = T.StructType([*POINT_SCHEMA.fields, T.StructField("reason", T.StringType())])
    batch_path = scratch_path(spark, "load-batch")
    points = new_points.select(*POINT_SCHEMA.fieldNames())
    declared = spec(spark, path)
    reasons = error_reasons(declared)
    seen = Observation()
    counts = [F.count_if(F.col("reason") == r).alias(f"r{i}") for i, r in enumerate(reasons)]
    checked = points.withColumn("reason", point_errors(points, declared)).observe(seen, F.count(F.lit(1)).alias("total"), *counts)
    checked.write.parquet(batch_path)
    batch = spark.read.schema(schema).parquet(batch_path)
    bad = batch.filter(F.col("reason").isNotNull())
    rejected = {r: seen.get[f"r{i}"] for i, r in enumerate(reasons) if seen.get[f"r{i}"]}
    if on_error == "fail" and rejected:
        raise ValueError(f"points rejected: {rejected}")
    bad.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_rejected/batch={batch_id}")
    good = batch.filter(F.col("reason").isNull()).drop("reason")
    existing, number = current(spark, path), version(spark, path)
    written = Observation()
    n_written = F.count(F.lit(1)).alias("n")
    if check_existing:
        fresh = fresh_rows(existing, good).select(*POINT_SCHEMA.fieldNames()).observe(written, n_written)
        fresh.write.mode("append").parquet(_points(path, number))
    else:
        last = dedupe_by_id(good).select(*POINT_SCHEMA.fieldNames()).observe(written, n_written)
        kept = existing.join(good.select("id"), on="id", how="left_anti").select(*POINT_SCHEMA.fieldNames())
        kept.unionByName(last).write.mode("overwrite").parquet(_points(path, number + 1))
        _make_current(spark, path, number + 1)
        if number:
            _remove_version(spark, path, number - 1)
    row = spark.createDataFrame([(seen.get["total"], written.get["n"], rejected)], LOAD_SCHEMA)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_loads/batch={batch_id}")
    return bad


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, vector_name: str = "image",
           filter: Column | None = None, with_payload: bool = True, with_vectors: bool = True) -> DataFrame:
    """K1: the ``k`` nearest points of the collection per query (``query_id``,
    ``vector``) under the metric of the named vector's spec, with the points'
    payload and vectors."""
    from quiver.operators.knn import knn_search

    size_metric = spec(spark, path).get(vector_name)
    if size_metric is None:
        raise ValueError(f"the collection has no vector {vector_name!r}")
    points = current(spark, path)
    points = points if filter is None else points.filter(filter)
    flat = points.select("id", F.col("vectors")[vector_name].alias("vector"))
    hits = knn_search(flat, queries, k=k, metric=size_metric[1])
    asked = [c for c, wanted in (("payload", with_payload), ("vectors", with_vectors)) if wanted]
    return hits.join(points.select("id", *asked), on="id") if asked else hits


def info(points: DataFrame, vector_name: str = "image") -> DataFrame:
    """Count, distinct ids, width range and zero vectors in one aggregate."""
    v = F.col("vectors")[vector_name]
    is_zero = ~F.exists(v, lambda x: x != 0)
    return points.agg(
        F.count(F.lit(1)).alias("points_count"),
        F.countDistinct("id").alias("distinct_ids"),
        F.min(F.size(v)).cast("long").alias("min_dim"),
        F.max(F.size(v)).cast("long").alias("max_dim"),
        F.count_if(is_zero).alias("zero_vectors"),
    )
