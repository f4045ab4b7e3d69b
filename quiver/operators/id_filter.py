"""Insert-if-absent loads behind a persisted Bloom filter.

A plain load compares a batch with every stored id.  Here the ids are also kept
in an index with a filter in front of it, so a batch of new ids is appended
without that comparison::

    <path>/points/batch=B       the rows of each load
    <path>/index/version=V/bits/batch=B          Bloom filter: 4 KiB bitmaps by block
    <path>/index/version=V/ids/batch=B/part=P    stored ids, by part (block modulo parts)
    <path>/_shape               a row per index version: its blocks and parts

An id hashes to a block and to ``HASHES`` bits of it.  Rows whose bits aren't all
set are surely new; only the others, about 0.3 % of new ids at the filter's
capacity, are looked up exactly, in the parts they belong to.  A wrong bit costs
a lookup, never an answer.  The bitmaps are made by Spark's bitmap aggregates and
meet the batch in a join on the block; no filter passes the driver.

The index grows with the table: beyond ``IDS_PER_BLOCK`` ids a block it is written
anew with four times the blocks (and its batches' bitmaps merged after
``MERGE_AFTER`` loads), beside the old one, and a row in ``_shape`` switches to it.

Rows are written before their index.  A load that stops in between is indexed by
the next one before that compares anything, and a load repeated under its batch
name with the same rows replaces what it wrote, so nothing is lost or stored twice.
Loads of one table run one after another, as with :mod:`quiver.operators.collection`.

Defined results: rows with a null id aren't stored; of rows that share an id the
one that :func:`quiver.operators.points.dedupe_by_id` picks is stored; an empty
batch stores nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.operators.collection import _folder
from quiver.operators.points import dedupe_by_id
from quiver.session import scratch_path

#: Bits of one of Spark's bitmaps.
BLOCK_BITS = 32_768
#: Ids per block before the index grows: 16 bits an id.
IDS_PER_BLOCK = 2_048
HASHES = 4
#: Loads before their bitmaps are merged.
MERGE_AFTER = 32

_SHAPE = "version int, blocks int, parts int"


def create(spark: SparkSession, path: str, blocks: int = 64, parts: int = 16) -> None:
    """A new table; ``blocks`` for ``IDS_PER_BLOCK`` ids each to begin with."""
    _switch(spark, path, 0, blocks, parts)


def _switch(spark: SparkSession, path: str, version: int, blocks: int, parts: int) -> None:
    row = spark.createDataFrame([(version, blocks, min(parts, blocks))], _SHAPE)
    row.coalesce(1).write.mode("append").parquet(f"{path}/_shape")


def _shape(spark: SparkSession, path: str) -> tuple[int, int, int]:
    return tuple(spark.read.schema(_SHAPE).parquet(f"{path}/_shape").agg(F.max(F.struct("version", "blocks", "parts")).alias("s")).select("s.*").first())


def _batches(spark: SparkSession, folder: str) -> set[str]:
    """Names of the batches under ``folder`` whose writes were finished."""
    fs, at = _folder(spark, folder)
    if not fs.exists(at):
        return set()
    done = spark._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("batch=")]
    return {p.getName().removeprefix("batch=") for p in found if fs.exists(done(p, "_SUCCESS"))}


def rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored rows."""
    if not _batches(spark, f"{path}/points"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/points")


# ---------------------------------------------------------------- the index


def _block(id_col: str, blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")


def _bit(id_col: str, j: int) -> F.Column:
    second = F.xxhash64(F.lit("bits"), F.col(id_col))
    return F.pmod(F.shiftrightunsigned(second, 15 * j), F.lit(BLOCK_BITS))


def _is_set(bits: F.Column, position: F.Column) -> F.Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def _bitmaps(ids: DataFrame, id_col: str, blocks: int) -> DataFrame:
    """``block, bits`` of ids: combined map-side, 4 KiB a block."""
    positions = F.explode(F.array(*[_bit(id_col, j) for j in range(HASHES)]))
    return ids.select(_block(id_col, blocks).alias("block"), positions.alias("p")).groupBy("block").agg(F.bitmap_construct_agg("p").alias("bits"))


def _index(path: str, version: int, what: str) -> str:
    return f"{path}/index/version={version}/{what}"


def _index_batch(spark: SparkSession, path: str, schema: T.StructType, id_col: str, batch: str) -> None:
    """Bits first, so ids that are there have their bits."""
    version, blocks, parts = _shape(spark, path)
    ids = spark.read.schema(schema).parquet(f"{path}/points/batch={batch}").select(id_col)
    _bitmaps(ids, id_col, blocks).write.mode("overwrite").parquet(f"{_index(path, version, 'bits')}/batch={batch}")
    placed = ids.withColumn("part", F.pmod(_block(id_col, blocks), F.lit(parts)))
    # a task per part, so a batch adds a file per part and not one per part and task
    placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{_index(path, version, 'ids')}/batch={batch}")


def _grow(spark: SparkSession, path: str, schema: T.StructType, id_col: str, blocks: int) -> None:
    """A new version of the index, then the switch to it."""
    version, _, parts = _shape(spark, path)
    new = version + 1
    ids = spark.read.schema(T.StructType([schema[id_col], T.StructField("batch", T.StringType())])).parquet(f"{path}/points")
    _bitmaps(ids, id_col, blocks).write.mode("overwrite").parquet(f"{_index(path, new, 'bits')}/batch=merged")
    for batch in sorted(_batches(spark, f"{path}/points")):
        placed = ids.where(F.col("batch") == batch).select(id_col, F.pmod(_block(id_col, blocks), F.lit(parts)).alias("part"))
        placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{_index(path, new, 'ids')}/batch={batch}")
    _switch(spark, path, new, blocks, parts)


def _stored_ids(spark: SparkSession, path: str, version: int, field: T.StructField) -> DataFrame | None:
    folder = _index(path, version, "ids")
    if not _batches(spark, folder):
        return None
    schema = T.StructType([field, T.StructField("batch", T.StringType()), T.StructField("part", T.IntegerType())])
    return spark.read.schema(schema).parquet(folder)


# ---------------------------------------------------------------- loading

LOADED = "batch string, given long, looked_up long, parts_read long, parts long, stored long"


def load(spark: SparkSession, path: str, new: DataFrame, batch: str, id_col: str = "id",
         order_col: str | None = None) -> DataFrame:
    """Store the rows of ``new`` whose id isn't stored yet; one row of counts:
    distinct ids given, ids the filter couldn't call new, index parts read for
    them (of ``parts``), rows stored."""
    schema = new.schema
    indexed = _batches(spark, _index(path, _shape(spark, path)[0], "ids"))
    for missed in sorted(_batches(spark, f"{path}/points") - indexed - {batch}):
        _index_batch(spark, path, schema, id_col, missed)
    version, blocks, parts = _shape(spark, path)
    last = dedupe_by_id(new.where(F.col(id_col).isNotNull()), id_col, order_col).select(*schema.fieldNames())
    placed = last.withColumn("__block", _block(id_col, blocks))
    bits_folder = _index(path, version, "bits")
    if _batches(spark, bits_folder):
        stored_bits = spark.read.schema("block int, bits binary, batch string").parquet(bits_folder)
        merged = stored_bits.groupBy(F.col("block").alias("__block")).agg(F.bitmap_or_agg("bits").alias("__bits"))
        maybe = F.lit(True)
        for j in range(HASHES):
            maybe = maybe & _is_set(F.col("__bits"), _bit(id_col, j))
        placed = placed.join(merged, "__block", "left").withColumn("__maybe", F.coalesce(maybe, F.lit(False))).drop("__bits")
    else:
        placed = placed.withColumn("__maybe", F.lit(False))
    seen = Observation()
    staged = scratch_path(spark, "filtered-load")
    placed.observe(seen, F.count(F.lit(1)).alias("given"), F.count_if("__maybe").alias("maybe")).write.parquet(staged)
    marked = spark.read.schema(placed.schema).parquet(staged)
    surely, unsure = marked.where(~F.col("__maybe")), marked.where("__maybe")
    asked = [r[0] for r in unsure.select(F.pmod("__block", F.lit(parts)).alias("p")).distinct().collect()]  # <= parts numbers
    stored_ids = _stored_ids(spark, path, version, schema[id_col])
    if asked and stored_ids is not None:
        known = stored_ids.where(F.col("part").isin(asked) & (F.col("batch") != batch)).select(id_col)
        unsure = unsure.join(known, id_col, "left_anti")
    written = Observation()
    fresh = surely.select(*schema.fieldNames()).unionByName(unsure.select(*schema.fieldNames()))
    fresh.observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/points/batch={batch}")
    _index_batch(spark, path, schema, id_col, batch)
    n_ids = rows(spark, path, schema).count()
    grown = blocks
    while n_ids > grown * IDS_PER_BLOCK:
        grown *= 4
    if grown > blocks or len(_batches(spark, bits_folder)) > MERGE_AFTER:
        _grow(spark, path, schema, id_col, grown)
    counts = (batch, seen.get["given"], seen.get["maybe"], len(asked), parts, written.get["n"])
    return spark.createDataFrame([counts], LOADED)
