"""Structured Streaming twins of the incremental operators.

* :func:`stream_upsert` – points arrive as files; each micro-batch is
  deduplicated by id, ids already stored are dropped by an anti join on the id
  column, and the fresh rows are appended (``foreachBatch``).  Re-running a batch after a failure writes
  nothing twice, because ids already present are skipped: the sink is
  idempotent by id.
* :func:`stream_session_state` – events arrive as files in any order; a
  streaming ``max_by`` per (app, user, session, key) replaces a value only by a
  later write, so late files cannot roll state back.  It is combined map-side
  before the state store, so a hot session costs one row per key and task.

Both keep their checkpoint in the folder that the caller names (a fresh one in
the shared checkpoint folder if none is named), so a query that is started
again with the same folder resumes after its last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.keys import event_order_key
from quiver.operators.points import fresh_rows
from quiver.operators.sessions import KEYS, after_reset, fold_state
from quiver.session import scratch_path


#: Files that a staged table is cut into, about, however many rows it has.
STAGED_FILES = 16


def stage_files(df: DataFrame, rows_per_file: int, name: str, files: int = STAGED_FILES) -> str:
    """Write ``df`` as parquet files (a file source for a stream) of at most
    ``rows_per_file`` rows, or of more rows once that would be over ``files``
    files: each micro-batch has a fixed cost and compares its rows with all
    stored ones, so batches of a fixed size would cost the square of the table.
    At most ``2 * files`` files in any case."""
    path = scratch_path(df.sparkSession, name)
    rows = max(rows_per_file, -(-df.count() // files))
    df.coalesce(files).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
    return path


def stream_upsert(spark: SparkSession, source_dir: str, schema: T.StructType, target_dir: str,
                  id_col: str = "id", files_per_trigger: int = 1, checkpoint: str | None = None) -> None:
    """Load every file under ``source_dir`` into the collection at
    ``target_dir`` (insert-if-absent), one micro-batch per ``files_per_trigger``
    files, until no file is left (``availableNow``)."""

    def load(batch: DataFrame, epoch: int) -> None:
        existing = batch.sparkSession.read.parquet(target_dir)
        fresh = fresh_rows(existing, batch, id_col).select(*schema.fieldNames())
        fresh.write.mode("append").parquet(target_dir)

    q = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(source_dir)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "ckpt-upsert"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def stream_load(spark: SparkSession, source_dir: str, collection_dir: str, checkpoint: str,
                files_per_trigger: int = 1) -> None:
    """T1 on a collection: files of points are loaded insert-if-absent until none
    is left, checked against the collection's spec, bad points quarantined.

    ``checkpoint`` is the job's stable folder: a job stopped after any batch goes
    on with the next one when it is started again.  Every part written carries
    its batch number; a batch that was cut off midway is loaded again as a
    whole, which adds only what it hadn't added (points by their id, rejected
    points by replacing the batch's own folder)."""
    from quiver.operators import collection

    def load(batch: DataFrame, epoch: int) -> None:
        collection.load(batch.sparkSession, collection_dir, batch, batch_id=epoch)

    q = (
        spark.readStream.schema(collection.POINT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(source_dir)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


#: Key of the pseudo entry that carries a session's last reset.
RESET_KEY = "__reset__"


def stream_session_state(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str,
                         files_per_trigger: int = 1, checkpoint: str | None = None) -> None:
    """Fold session events arriving as files into per-session state.

    A native streaming aggregate keeps the last write per (app, user, session,
    key) and, as one more entry, the last reset; each micro-batch writes the
    entries it changed under its own batch folder, so a repeated batch replaces
    its output.  See :func:`read_session_state`.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    seq = event_order_key(F.col("ts"), F.col("event_id"), schema["ts"].dataType)
    reset = F.when(F.col("is_reset"), F.lit(RESET_KEY))
    no_value = F.lit(None).cast(schema["state_value"].dataType)
    entries = F.array(
        F.struct(F.col("state_key").alias("state_key"), F.col("state_value").alias("state_value")),
        F.struct(reset.alias("state_key"), no_value.alias("state_value")),
    )
    folded = fold_state(events.select(*KEYS, seq.alias("_seq"), F.explode(entries).alias("e")).select(*KEYS, "_seq", "e.*"))

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={epoch}")

    q = (
        folded.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "ckpt-sessions"))
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def read_session_state(spark: SparkSession, out_dir: str) -> DataFrame:
    """Final state from the emitted entries: the latest write per (session,
    key), without those older than the session's last reset."""
    last = fold_state(spark.read.parquet(out_dir))
    resets = last.filter(F.col("state_key") == RESET_KEY).select(*KEYS, F.col("_seq").alias("last_reset"))
    return after_reset(last.filter(F.col("state_key") != RESET_KEY), resets).drop("_seq")
