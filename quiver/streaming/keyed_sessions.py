"""Session state and history kept by a keyed stateful stream.

Each event becomes entries: its state write, itself as history, a reset, a clear.
A stateful processor keeps them in RocksDB: the last write per state key, the last
reset and clear per session, and history in chunks.  The state store is the result:
:func:`read_state` and :func:`read_history` read it with Spark's state reader, as
tables, and nothing else is written.

* **Order.** Events may come in any order and in any batch.  A write replaces an
  older one only, a reset deletes what is older than itself, and what arrives
  after a reset or clear that is younger is not kept, so the result is that of
  the batch operators over all events so far.
* **Cost.** A call from Python to the state store costs about as much as the work on
  a hundred entries, so state isn't kept a key at a time: sessions are dealt over
  ``parts``, a part is one key of the store, and its marks, its writes and each
  chunk of its history are one value, an Arrow batch.  Entries are put together
  per part where they are read, so a part costs a few calls per micro-batch,
  however many sessions it has.
* **Skew.** A session's entries are dealt over salts (writes by their state key,
  history by the event), its resets and clears go to every salt; each salt of a
  session is in another part, and none needs another one.  Input is taken in a
  bounded number of rows at a time and history is copied a chunk at a time, so a
  session of any length is fine.  Marks and writes of one part are held at once.
* **Start.** ``initial`` (:func:`initial_entries` of past events) is loaded before the
  first batch; with a stable ``checkpoint`` the job resumes where it stopped.

Defined results: an event without a state key writes nothing; a null flag is
false; of events with equal ``(ts, event_id)`` one write is kept and each is
history; a null session key is a session of its own; an event without a time or
an id is older than all others and its reset or clear counts for nothing; no
events give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quiver.operators.sessions import KEYS, _with_seq, fold_state, session_history

#: Parts that the entries of one session are dealt over.
SALTS = 8
#: Parts of the state, a job's sessions are dealt over them.
PARTS = 512
#: History rows of one chunk.
SLICE = 4096
#: Entries that are put together, or taken into the state, at once.
PACK_ROWS = 1 << 17

_SEQ = "decimal(38,0)"
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # a batch writes what it changes, not whole files of the store
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_PARTITIONS = "spark.sql.shuffle.partitions"
VALUE, EVENT, RESET, CLEAR = "value", "event", "reset", "clear"
MARKS, VALUES, HISTORY = "marks", "values", "history"


# ---------------------------------------------------------------- entries


def entries(events: DataFrame, salts: int = SALTS) -> DataFrame:
    """``KEYS, salt, kind, seq, state_key, state_value, event_id, author, content``;
    a null salt stands for every salt of the session."""
    events = _with_seq(events)
    part = lambda by: F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    entry = lambda kind, salt: F.struct(F.lit(kind).alias("kind"), salt.alias("salt"))
    none = F.array().cast("array<struct<kind:string,salt:int>>")
    every = F.lit(None).cast("int")

    def when(flag: F.Column, made: F.Column) -> F.Column:
        return F.when(F.coalesce(flag, F.lit(False)), F.array(made)).otherwise(none)

    made = F.concat(
        when(F.col("state_key").isNotNull(), entry(VALUE, part("state_key"))),
        when(~F.coalesce("is_clear", F.lit(False)), entry(EVENT, part("event_id"))),
        when(F.col("is_reset"), entry(RESET, every)),
        when(F.col("is_clear"), entry(CLEAR, every)),
    )
    rows = events.withColumn("_entry", F.explode(made))
    only = lambda kind, name: F.when(F.col("_entry.kind") == kind, F.col(name)).alias(name)
    return rows.select(
        *KEYS, F.col("_entry.salt").alias("salt"), F.col("_entry.kind").alias("kind"), F.col("_seq").alias("seq"),
        only(VALUE, "state_key"), only(VALUE, "state_value"),
        only(EVENT, "event_id"), only(EVENT, "author"), only(EVENT, "content"),
    )


def initial_entries(events: DataFrame, salts: int = SALTS) -> DataFrame:
    """Entries of a batch of past events, folded first: one write per state key,
    one reset and one clear per session, and the history that is left."""
    events = _with_seq(events)
    flags = [F.lit(False).alias(n) for n in ("is_reset", "is_clear")]
    no_key = [F.lit(None).cast(events.schema[n].dataType).alias(n) for n in ("state_key", "state_value")]
    no_event = [F.lit(None).cast(events.schema[n].dataType).alias(n) for n in ("event_id", "author", "content")]
    writes = fold_state(events).select(*KEYS, "_seq", "state_key", "state_value", *no_event, *flags)
    marks = events.groupBy(*KEYS).agg(
        F.max(F.when(F.col("is_reset"), F.col("_seq"))).alias("reset"), F.max(F.when(F.col("is_clear"), F.col("_seq"))).alias("clear")
    )
    marked = [
        marks.where(F.col(n).isNotNull()).select(
            *KEYS, F.col(n).alias("_seq"), *no_key, *no_event, F.lit(n == RESET).alias("is_reset"), F.lit(n == CLEAR).alias("is_clear")
        )
        for n in (RESET, CLEAR)
    ]
    kept = session_history(events.withColumns({n: F.coalesce(n, F.lit(False)) for n in ("is_reset", "is_clear")}))
    ordered = _with_seq(kept).select(*KEYS, "_seq", *no_key, "event_id", "author", "content", *flags)
    folded = entries(writes, salts).where(F.col("kind") == VALUE).unionByName(entries(ordered, salts))
    for rows in marked:
        folded = folded.unionByName(entries(rows, salts).where(F.col("kind").isin(RESET, CLEAR)))
    return folded


# ---------------------------------------------------------------- tables of entries

#: The order key as two words of a 128-bit number, the first one signed; a null key is ``NONE, 0``.
NONE = np.iinfo(np.int64).min
_WORDS = [pa.field("hi", pa.int64()), pa.field("lo", pa.uint64())]
_COLUMNS = {MARKS: ["kind"], VALUES: ["state_key", "state_value"], HISTORY: ["event_id", "author", "content"]}


def _schema(columns: T.StructType, name: str) -> pa.Schema:
    """Arrow schema of one table of a part, its types taken from ``columns``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = lambda c: pa.string() if c == "kind" else to_arrow_type(columns[c].dataType)
    return pa.schema([*[pa.field(c, kind(c)) for c in KEYS + _COLUMNS[name]], *_WORDS])


def _schemas(events: T.StructType) -> dict[str, pa.Schema]:
    return {name: _schema(events, name) for name in _COLUMNS}


def _with_words(tbl: pa.Table) -> pa.Table:
    """The decimal ``seq`` as ``hi`` and ``lo``."""
    seq = tbl.column("seq").combine_chunks().cast(pa.decimal128(38, 0))
    words = np.frombuffer(seq.buffers()[1], np.int64)[2 * seq.offset : 2 * (seq.offset + len(seq))].reshape(-1, 2)
    null = seq.is_null().to_numpy(zero_copy_only=False)
    hi, lo = np.where(null, NONE, words[:, 1]), np.where(null, 0, words[:, 0]).view(np.uint64)
    return tbl.drop_columns("seq").append_column(_WORDS[0], pa.array(hi)).append_column(_WORDS[1], pa.array(lo))


def _seq(hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    """The decimals of the two words."""
    words = np.column_stack([lo, hi.view(np.uint64)])
    made = pa.Array.from_buffers(pa.decimal128(38, 0), len(hi), [None, pa.py_buffer(words.tobytes())])
    return pc.if_else(pa.array(hi == NONE), pa.scalar(None, made.type), made)


def _words(tbl: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tbl.column("hi").to_numpy(), tbl.column("lo").to_numpy()


def _codes(tbl: pa.Table, by: list[str]) -> np.ndarray:
    """A number per row, the same for rows that agree in the columns ``by`` (nulls agree)."""
    code, size = np.zeros(tbl.num_rows, dtype=np.int64), 1
    for name in by:
        column = tbl.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * max(1, len(column.dictionary)) + column.indices.to_numpy()
        size *= max(1, len(column.dictionary))
        if size > 1 << 31:
            found, code = np.unique(code, return_inverse=True)
            size = len(found)
    return code


def _latest(tbl: pa.Table, by: list[str]) -> pa.Table:
    """The youngest of the rows that agree in ``by``; of equally young ones the last."""
    if tbl.num_rows == 0:
        return tbl
    (hi, lo), code = _words(tbl), _codes(tbl, by)
    order = np.lexsort((lo, hi, code))
    ends = np.append(code[order][1:] != code[order][:-1], True)
    return tbl.combine_chunks().take(pa.array(np.sort(order[ends])))


def _alive(tbl: pa.Table, marks: pa.Table, clears: bool) -> np.ndarray:
    """Rows that no reset, and no clear if ``clears``, of their session has removed."""
    n = tbl.num_rows
    if n == 0 or marks.num_rows == 0:
        return np.ones(n, dtype=bool)
    codes = _codes(pa.concat_tables([tbl.select(KEYS), marks.select(KEYS)]), KEYS)
    found, who = np.unique(codes, return_inverse=True)
    kind = marks.column("kind").to_numpy(zero_copy_only=False)
    hi, lo = _words(tbl)
    alive = np.ones(n, dtype=bool)
    for name in (RESET, CLEAR) if clears else (RESET,):
        at, words = kind == name, _words(marks)
        has, mark_hi, mark_lo = np.zeros(len(found), bool), np.zeros(len(found), np.int64), np.zeros(len(found), np.uint64)
        has[who[n:][at]], mark_hi[who[n:][at]], mark_lo[who[n:][at]] = True, words[0][at], words[1][at]
        mine, h, w = who[:n], mark_hi[who[:n]], mark_lo[who[:n]]
        older = (hi < h) | ((hi == h) & ((lo < w) if name == RESET else (lo <= w)))
        alive &= ~(has[mine] & older)
    return alive


def _blob(tbl: pa.Table, schema: pa.Schema) -> bytes:
    batches = tbl.select(schema.names).cast(schema).combine_chunks().to_batches()
    return (batches[0] if batches else pa.RecordBatch.from_pylist([], schema)).serialize().to_pybytes()


def _unblob(blobs: list[bytes], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(b), schema) for b in blobs], schema)


_PACKED = "part int, marks binary, values binary, history binary"


def packed(rows: DataFrame, events: T.StructType, salts: int, parts: int) -> DataFrame:
    """Entries put together: a row per part and table of them, folded to what matters
    (the last write of a key, the last reset and clear of a session)."""
    schemas, at_once = _schemas(events), PACK_ROWS
    home = F.pmod(F.xxhash64(*KEYS), F.lit(parts)).cast("int").alias("home")

    def pieces(tbl: pa.Table, part: np.ndarray, schema: pa.Schema) -> dict[int, bytes]:
        if len(part) == 0:
            return {}
        order = np.argsort(part, kind="stable")
        batches = tbl.select(schema.names).cast(schema).take(pa.array(order)).combine_chunks().to_batches()
        names, starts = np.unique(part[order], return_index=True)
        ends = np.append(starts[1:], len(part))
        return {int(p): batches[0].slice(a, b - a).serialize().to_pybytes() for p, a, b in zip(names, starts, ends, strict=True)}

    def put_together(tbl: pa.Table) -> pa.RecordBatch:
        tbl = _with_words(tbl)
        kind = tbl.column("kind")
        marks = tbl.filter(pc.and_(pc.is_in(kind, pa.array([RESET, CLEAR])), pc.not_equal(tbl.column("hi"), NONE)))
        marks = _latest(marks, [*KEYS, "kind"])
        found = {MARKS: (marks, None), VALUES: (_latest(tbl.filter(pc.equal(kind, VALUE)), [*KEYS, "state_key"]), "salt"),
                 HISTORY: (tbl.filter(pc.equal(kind, EVENT)), "salt")}
        made = {}
        for name, (own, salt) in found.items():
            own = own.combine_chunks()
            start = own.column("home").to_numpy()
            if salt is None:  # to every salt
                part = (start[:, None] + np.arange(salts)).ravel() % parts
                own = own.take(pa.array(np.repeat(np.arange(len(start)), salts)))
            else:
                part = (start + own.column(salt).to_numpy()) % parts
            made[name] = pieces(own, part, schemas[name])
        names = sorted(set().union(*made.values()))
        columns = [pa.array(names, pa.int32()), *[pa.array([made[n].get(p) for p in names], pa.binary()) for n in _COLUMNS]]
        return pa.RecordBatch.from_arrays(columns, names=["part", *_COLUMNS])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= at_once:
                yield put_together(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield put_together(pa.Table.from_batches(held))

    return rows.select("*", home).mapInArrow(pack, _PACKED)


# ---------------------------------------------------------------- the processor


class SessionProcessor(StatefulProcessor):
    """State of one part: ``marks`` (with the number of chunks), ``values``, and the
    chunks of ``history`` by their number."""

    def __init__(self, events: T.StructType, rows: int):
        types = {n: events[n].dataType.simpleString() for c in ([*KEYS], *_COLUMNS.values()) for n in c if n != "kind"}
        like = lambda own: ",".join(f"{n}:{types[n]}" for n in KEYS + own if n in types)
        # ``row`` is always null: it tells readers the types
        self.stored = {name: f"blob binary, n int, row struct<{like(own)}>" for name, own in _COLUMNS.items()}
        self.schemas, self.rows, self.at_once = _schemas(events), rows, PACK_ROWS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState(MARKS, self.stored[MARKS])
        self.values = handle.getValueState(VALUES, self.stored[VALUES])
        self.history = handle.getMapState(HISTORY, "chunk int", self.stored[HISTORY])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._take([initialState])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._take(rows)
        return iter([])

    def _take(self, frames) -> None:
        held: dict[str, list[pa.Table]] = {name: [] for name in self.schemas}
        n = 0
        for frame in frames:
            for row in zip(*[frame[name] for name in held], strict=True):
                for name, blob in zip(held, row, strict=True):
                    if isinstance(blob, bytes | bytearray):
                        held[name].append(_unblob([blob], self.schemas[name]))
                        n += held[name][-1].num_rows
                if n >= self.at_once:
                    self._apply(held)
                    held, n = {name: [] for name in held}, 0
        if n:
            self._apply(held)

    def _stored(self, found, name: str) -> pa.Table:
        return self.schemas[name].empty_table() if found is None else _unblob([found[0]], self.schemas[name])

    def _apply(self, new: dict[str, list[pa.Table]]) -> None:
        held = self.marks.get()
        before, chunks = self._stored(held, MARKS), 0 if held is None else held[1]
        # what is stored comes last: it stays when another one is as old
        marks = _latest(pa.concat_tables([*new[MARKS], before]), [*KEYS, "kind"])
        marked = not marks.equals(before)
        if new[VALUES] or marked:
            self._write(new[VALUES], marks)
        now = self._remember(new[HISTORY], marks, chunks, marked) if new[HISTORY] or marked else chunks
        if marked or now != chunks:
            self.marks.update((_blob(marks, self.schemas[MARKS]), now, None))

    def _write(self, new: list[pa.Table], marks: pa.Table) -> None:
        schema = self.schemas[VALUES]
        before = self._stored(self.values.get(), VALUES)
        last = _latest(pa.concat_tables([*new, before]), [*KEYS, "state_key"])
        last = last.filter(pa.array(_alive(last, marks, clears=False)))
        if not last.equals(before):
            self.values.update((_blob(last, schema), last.num_rows, None))

    def _remember(self, new: list[pa.Table], marks: pa.Table, chunks: int, marked: bool) -> int:
        """Appends history; chunks that a reset or clear may have taken rows from are
        filtered one at a time and filled up again.  Returns the number of chunks."""
        schema = self.schemas[HISTORY]
        rest = schema.empty_table()
        at = 0 if marked else max(0, chunks - 1)  # the chunk that is written next
        for i in range(at, chunks):
            chunk = self._stored(self.history.getValue((i,)), HISTORY)
            kept = chunk.filter(pa.array(_alive(chunk, marks, clears=True))) if marked else chunk
            if at == i and rest.num_rows == 0 and kept.num_rows == chunk.num_rows >= self.rows:
                at += 1
                continue
            at, rest = self._fill(at, pa.concat_tables([rest, kept]))
        for tbl in new:
            at, rest = self._fill(at, pa.concat_tables([rest, tbl.filter(pa.array(_alive(tbl, marks, clears=True)))]))
        if rest.num_rows:
            self._chunk(at, rest)
            at += 1
        for i in range(at, chunks):
            self.history.removeKey((i,))
        return at

    def _fill(self, at: int, rows: pa.Table) -> tuple[int, pa.Table]:
        """Writes the full chunks of ``rows``; the next chunk's number and the rows left."""
        while rows.num_rows >= self.rows:
            self._chunk(at, rows.slice(0, self.rows))
            at, rows = at + 1, rows.slice(self.rows)
        return at, rows

    def _chunk(self, at: int, rows: pa.Table) -> None:
        self.history.updateValue((at,), (_blob(rows, self.schemas[HISTORY]), rows.num_rows, None))


# ---------------------------------------------------------------- the job


@contextmanager
def _settings(spark: SparkSession, more: dict[str, str] | None = None):
    settings = {**_SETTINGS, **(more or {})}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stream_sessions(spark: SparkSession, source_dir: str, schema: T.StructType, checkpoint: str,
                    initial: DataFrame | None = None, files_per_trigger: int = 1, salts: int = SALTS,
                    parts: int = PARTS) -> None:
    """Takes the event files under ``source_dir`` into the state until none is left.

    ``checkpoint`` is the job's stable folder and holds the state.  Give the same
    ``initial`` (past events; read once, before the first batch), ``salts`` and
    ``parts`` (at least as many as salts) whenever it is started again."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    past = None
    if initial is not None:
        # a session's entries together, so that few rows come of them
        folded = initial_entries(initial, salts).repartition(*KEYS, "salt")
        past = packed(folded, schema, salts, parts).groupBy("part")
    # a partition of the store costs a commit per batch: two a core, or as many as the session asks for
    partitions = min(int(spark.conf.get(_PARTITIONS)), max(16, 2 * spark.sparkContext.defaultParallelism))
    with _settings(spark, {_PARTITIONS: str(partitions)}):
        kept = packed(entries(events, salts), schema, salts, parts).groupBy("part").transformWithStateInPandas(
            SessionProcessor(schema, SLICE), "n long", "Update", "None", initialState=past
        )
        query = (
            kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()


def _table(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """``part, key`` (a struct of the ``KEYS``), the columns of a state table and
    ``seq``; of marks a row per part and session, ``last_reset`` and ``last_clear``."""
    with _settings(spark):
        rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    stored = "user_map_value" if name == HISTORY else "value"
    types = rows.schema[stored].dataType["row"].dataType
    schema, columns = _schema(types, name), _COLUMNS[name]
    out = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("key", T.StructType([types[k] for k in KEYS])),
        *[T.StructField(c, T.StringType() if c == "kind" else types[c].dataType) for c in columns],
        T.StructField("seq", T.DecimalType(38, 0)),
    ])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                tbl = pa.ipc.read_record_batch(pa.py_buffer(blob.as_py()), schema)
                key = pa.StructArray.from_arrays([tbl.column(k) for k in KEYS], fields=[schema.field(k) for k in KEYS])
                own = [tbl.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(tbl.num_rows, part), pa.int32()), key, *own, _seq(*_words(tbl))], names=out.names)

    found = rows.select("key.part", f"{stored}.blob").mapInArrow(unpack, out)
    if name != MARKS:
        return found
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("seq"))).alias(f"last_{kind}")
    return found.groupBy("part", "key").agg(last(RESET), last(CLEAR))


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``KEYS, state_key, state_value`` of all sessions, as after the last batch."""
    return _table(spark, checkpoint, VALUES).select(*[f"key.{k}" for k in KEYS], "state_key", "state_value")


def read_history(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``KEYS, event_id, author, content, seq`` of what is left of each session's history."""
    return _table(spark, checkpoint, HISTORY).select(*[f"key.{k}" for k in KEYS], "event_id", "author", "content", "seq")
