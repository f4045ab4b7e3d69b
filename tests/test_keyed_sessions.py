"""Session state and history in a keyed stateful stream, against the batch operators."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quiver.operators import sessions
from quiver.session import scratch_path
from quiver.streaming import keyed_sessions as keyed

EV = ("app string, user_id string, session_id string, ts timestamp_ntz, event_id long, author string, "
      "content string, state_key string, state_value double, is_final boolean, is_reset boolean, is_clear boolean")


def _events(spark, n, seed=1):
    """A third of the events in one session, keys and values missing at times, few resets and clears."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        who = "hot" if rng.random() < 0.34 else f"s{rng.randrange(6)}"
        roll = rng.random()
        rows.append((
            "a", None if who == "s5" else "u", who, dt.datetime(2024, 1, 1, 0, 0, rng.randrange(60)), i,
            rng.choice(["user", "model", None]), rng.choice(["hi", "", None]),
            rng.choice(["k1", "k2", "k3", None]), rng.choice([None, float(i)]), False, roll < 0.03, None if roll > 0.95 else roll > 0.92,
        ))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, EV)


def _batch(events):
    flags = events.withColumns({n: F.coalesce(n, F.lit(False)) for n in ("is_reset", "is_clear")})
    state = sorted(map(str, sessions.session_state(flags).select(*sessions.KEYS, "state_key", "state_value").collect()))
    history = sessions.session_history(flags.where("user_id is not null"))
    return state, sorted(map(str, history.select(*sessions.KEYS, "event_id", "author", "content").collect()))


def _kept(spark, checkpoint):
    state = keyed.read_state(spark, checkpoint).select(*sessions.KEYS, "state_key", "state_value")
    history = keyed.read_history(spark, checkpoint).where("user_id is not null")
    return (sorted(map(str, state.where("user_id is not null").collect())),
            sorted(map(str, history.select(*sessions.KEYS, "event_id", "author", "content").collect())))


def test_batches_initial_state_and_restart(spark, monkeypatch):
    monkeypatch.setattr(keyed, "SLICE", 5)
    events = _events(spark, 900).checkpoint()
    past, rest = events.where("event_id % 3 = 0"), events.where("event_id % 3 > 0")
    src, checkpoint = scratch_path(spark, "keyed-src"), scratch_path(spark, "keyed-ckpt")
    first = rest.where("event_id % 2 = 0")
    first.repartition(2).write.parquet(src)
    keyed.stream_sessions(spark, src, events.schema, checkpoint, initial=past, salts=3)
    seen = past.unionByName(first)
    expected = _batch(seen.where("user_id is not null"))
    assert _kept(spark, checkpoint) == expected
    rest.where("event_id % 2 = 1").repartition(2).write.mode("append").parquet(src)  # goes on after the last batch
    keyed.stream_sessions(spark, src, events.schema, checkpoint, initial=past, salts=3)
    assert _kept(spark, checkpoint) == _batch(events.where("user_id is not null"))
    spread = keyed._table(spark, checkpoint, "marks").where("key.session_id = 'hot'").count()
    assert spread == 3  # the hot session is split


def test_late_events_and_deletes(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    src, checkpoint = scratch_path(spark, "late-src"), scratch_path(spark, "late-ckpt")
    batches = [
        [("a", "u", "s", t(5), 5, "user", "x", "k", 5.0, False, False, False), ("a", "u", "s", t(1), 1, "user", "y", "old", 1.0, False, False, False)],
        [("a", "u", "s", t(3), 3, "user", "", "r", 3.0, False, True, False)],     # deletes the write at 1 only
        [("a", "u", "s", t(2), 2, "user", "z", "late", 2.0, False, False, False)],  # older than the reset: not kept
        [("a", "u", "s", t(4), 4, "user", "", None, None, False, False, True)],   # clears history up to 4
    ]
    for rows in batches:
        batch = spark.createDataFrame(rows, EV)
        batch.write.mode("append").parquet(src)
        keyed.stream_sessions(spark, src, batch.schema, checkpoint, salts=2)
    assert {(r.state_key, r.state_value) for r in keyed.read_state(spark, checkpoint).collect()} == {("k", 5.0), ("r", 3.0)}
    assert [r.event_id for r in keyed.read_history(spark, checkpoint).collect()] == [5]
    values = keyed._table(spark, checkpoint, "values").collect()
    assert len(values) == 2  # what a reset removes is gone from the store


def test_no_events(spark):
    src, checkpoint = scratch_path(spark, "none-src"), scratch_path(spark, "none-ckpt")
    empty = spark.createDataFrame([], EV)
    empty.write.parquet(src)
    keyed.stream_sessions(spark, src, empty.schema, checkpoint)
    assert keyed.entries(empty).count() == 0 and keyed.initial_entries(empty).count() == 0


def test_sessions_share_keys_of_the_store(spark, monkeypatch):
    """Many sessions cost as many calls as there are parts; chunks of history are filled up after deletes."""
    monkeypatch.setattr(keyed, "SLICE", 7)
    rows = [("a", "u", f"s{i % 60}", dt.datetime(2024, 1, 1, 0, 0, i % 60, i), i, "user", f"x{i}", f"k{i % 2}", float(i), False,
             i % 60 < 20 and i % 23 == 0, i % 60 < 30 and i % 31 == 0) for i in range(900)]
    events = spark.createDataFrame(rows, EV).checkpoint()
    src, checkpoint = scratch_path(spark, "many-src"), scratch_path(spark, "many-ckpt")
    events.repartition(3).write.parquet(src)
    keyed.stream_sessions(spark, src, events.schema, checkpoint, salts=2, parts=4)
    assert _kept(spark, checkpoint) == _batch(events)
    with keyed._settings(spark):
        store = {n: spark.read.format("statestore").option("stateVarName", n).load(checkpoint) for n in ("marks", "values", "history")}
    assert store["marks"].count() == store["values"].count() == 4
    sizes = [(r.part, r.n) for r in store["history"].select("key.part", "user_map_value.n").collect()]
    assert all(n <= 7 for _, n in sizes) and sum(n < 7 for _, n in sizes) <= 4


def test_events_without_a_time(spark):
    """They are older than all others; a reset without a time counts for nothing."""
    t, src, checkpoint = dt.datetime(2024, 1, 1), scratch_path(spark, "null-src"), scratch_path(spark, "null-ckpt")
    batches = [
        [("a", "u", "s", None, 1, "user", "x", "k", 1.0, False, True, False), ("a", "u", "s", None, 2, "user", "y", "k", 2.0, False, False, False),
         ("a", "u", "r", None, 3, "user", "x", "k", 3.0, False, False, False)],
        [("a", "u", "s", t, 4, "user", "z", "k", None, False, False, False), ("a", "u", "r", t, 5, "user", "", None, None, False, True, False)],
        [("a", "u", "s", None, 6, "user", "w", "k", 6.0, False, False, False), ("a", "u", "r", None, 7, "user", "w", "k", 7.0, False, False, False)],
    ]
    for rows in batches:
        batch = spark.createDataFrame(rows, EV)
        batch.write.mode("append").parquet(src)
        keyed.stream_sessions(spark, src, batch.schema, checkpoint, salts=2)
    assert [(r.session_id, r.state_key, r.state_value) for r in keyed.read_state(spark, checkpoint).collect()] == [("s", "k", None)]
    assert sorted((r.session_id, r.event_id) for r in keyed.read_history(spark, checkpoint).collect()) == [("r", 5), ("s", 1), ("s", 2), ("s", 4), ("s", 6)]
