"""Exact dedup by stateful streaming (operator 9).

Texts are equal when identical after each run of white space becomes one
space.  One scan writes a digest log (digest, id, content locator; no text) to
the shared folder.  A streaming query over the log keeps, per digest, the
smallest id with its locator and the number of rows in RocksDB state on disk,
without expiry: partial aggregation runs before the shuffle, so a digest that
holds a third of all rows reaches the state as one row per task.  The state is
then read with Spark's state reader.  Every hit is checked on its full bytes
against the row that stays; texts that share a digest but differ (they don't
with SHA-256) are regrouped by the text itself.

Defined results: a null text is empty; a null id sorts after all others; of
repeated rows with one id and one text a single row is kept; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm.common import SPACE, keeps_columns, text_of, written
from quiver.session import scratch_path

#: Copies compared with one shipped text of the row that stays.
COPIES_PER_SALT = 1000

_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    # Many small stores: don't reserve disk ahead for each one's logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _run_state(spark: SparkSession, log_path: str, schema, state_path: str, files_per_batch: int) -> None:
    """Fold the digest log into keyed state; files already folded are skipped,
    so later arrivals in the same folder continue from the stored state."""
    before = {k: spark.conf.get(k, None) for k in _STATE_SETTINGS}
    for k, v in _STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(log_path)
            .groupBy("digest")
            .agg(
                F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("first"),
                F.count(F.lit(1)).alias("n"),
            )
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state_path)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _state(spark: SparkSession, state_path: str) -> DataFrame:
    rows = spark.read.format("statestore").load(state_path)
    first, n = (f"value.`{c}`" for c in rows.schema["value"].dataType.names)
    return rows.select(
        F.col("key.digest").alias("digest"),
        F.col(f"{first}.doc_id").alias("keep_id"),
        F.col(f"{first}.locator").alias("keep_locator"),
        F.col(n).alias("group_size"),
    )


def exact_dedup(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 100_000,
    state_path: str | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``,
    ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``keep_locator``
    (file of the row that stays).

    ``digest`` maps the normalised text to the state key; equal texts must get
    equal keys, differing ones may (then the full-bytes check parts them).
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        normalised(text_of()).alias("norm"),
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("locator"),
    ).withColumn("digest", digest(F.col("norm")))
    log_path = scratch_path(spark, "exact-log")
    log = rows.select("digest", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "doc_id", "locator")
    log.write.parquet(log_path)
    log = spark.read.schema(log.schema).parquet(log_path)
    state_path = state_path or scratch_path(spark, "exact-state")
    _run_state(spark, log_path, log.schema, state_path, files_per_batch)
    heads = written(_state(spark, state_path).where("group_size > 1"), "exact-heads")

    collided = _collisions(rows, heads)
    per_id = log.groupBy("digest", "text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    if not collided.isEmpty():
        per_id = per_id.join(collided, "digest", "left_anti")
    same_id = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    decided = per_id.join(heads.hint("merge"), "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
        "keep_locator",
        "copies",
    )
    if not collided.isEmpty():
        decided = decided.unionByName(_by_text(rows.join(collided, "digest", "left_semi")))
    return decided.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (same_id & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
        "keep_locator",
    )


def _collisions(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Digests under which two texts differ: every copy is compared in full
    with the row that stays.  The join on the digest is a sort-merge join at
    every size; it moves the text once, and AQE splits a hot digest.  Copies of one text are dealt over salts and the
    staying text is repeated once per salt, so a group of any size spreads."""
    salts = F.ceil(F.col("group_size") / COPIES_PER_SALT).cast("int")
    copies = written(
        rows.join(heads.select("digest", "keep_id", "keep_locator", "group_size").hint("merge"), "digest").select(
            "digest",
            "norm",
            "doc_id",
            "locator",
            F.pmod(F.xxhash64("doc_id", "locator"), salts).cast("int").alias("salt"),
            salts.alias("salts"),
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_locator"))).alias("stays"),
        ),
        "exact-copies",
    )
    staying = (
        copies.where("stays")
        .groupBy("digest", "salts")
        .agg(F.min("norm").alias("kept_norm"))
        .select("digest", "kept_norm", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    )
    differing = copies.join(staying, ["digest", "salt"]).where(F.col("norm") != F.col("kept_norm"))
    return written(differing.select("digest").distinct(), "exact-collisions")


def _by_text(rows: DataFrame) -> DataFrame:
    """Group rows by the whole text (for digests shared by differing texts)."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "locator")
    groups = rows.groupBy("norm").agg(
        F.min_by("doc_id", order).alias("keep_id"),
        F.min_by("locator", order).alias("keep_locator"),
        F.count(F.lit(1)).alias("group_size"),
    )
    per_id = rows.groupBy("norm", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    return per_id.join(groups, "norm").select(
        "doc_id", "keep_id", "group_size", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        "keep_locator", "copies",
    )


@keeps_columns
def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops (all columns)."""
    decided = written(exact_dedup(docs), "exact-decided")
    keyed = docs.withColumn("__sha", F.sha2(normalised(text_of()).cast("binary"), 256)).withColumn(
        "__id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    )
    pairs = decided.groupBy(
        F.col("text_sha256").alias("__sha"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id")
    ).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    out = keyed.join(pairs.where("not kept"), ["__sha", "__id"], "left_anti")
    repeated = pairs.where("kept and n > 1").select("__sha", "__id")
    if not repeated.isEmpty():
        once = keyed.join(repeated, ["__sha", "__id"], "left_semi").dropDuplicates(["__sha", "__id"])
        out = out.join(repeated, ["__sha", "__id"], "left_anti").unionByName(once)
    return out.select(*docs.columns)
