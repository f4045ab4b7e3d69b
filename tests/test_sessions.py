"""Session folds (FIXTURES part B: session events) and turn pairing."""

import datetime as dt

from pyspark.sql import functions as F

from quiver.operators import sessions

EV = ("app string, user_id string, session_id string, ts timestamp_ntz, event_id long, author string, "
      "content string, state_key string, state_value double, is_final boolean, is_reset boolean, is_clear boolean")


def _ev(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [
        ("a", "u", "s1", t(1), 1, "user", "hi", "num_queries", 2.0, False, True, False),   # initial state
        ("a", "u", "s1", t(2), 2, "user", "q", "num_queries", 6.0, False, False, False),   # key overwritten
        ("a", "u", "s1", t(2), 3, "model", "", None, None, False, False, False),            # retry: no delta
        ("a", "u", "s1", t(3), 4, "model", "r1", "out", 1.0, True, False, False),           # final
        ("a", "u", "s1", t(3), 5, "model", "r2", "out", 2.0, True, False, False),           # second final
        ("a", "u", "s1", t(4), 6, "user", "", None, None, False, False, True),              # clear history
        ("a", "u", "s1", t(5), 7, "user", "q2", "out", 3.0, False, False, False),
        ("a", "u", "s2", t(1), 8, "user", "x", "k", 1.0, False, False, False),
        ("a", "u", "s2", t(2), 9, "user", "y", "k", 9.0, False, True, False),               # reset
    ]
    return spark.createDataFrame(rows, EV)


def test_state_fold(spark):
    st = {(r["session_id"], r["state_key"]): r["state_value"]
          for r in sessions.session_state(_ev(spark), honour_reset=False).collect()}
    assert st[("s1", "num_queries")] == 6.0 and st[("s1", "out")] == 3.0 and st[("s2", "k")] == 9.0
    after_reset = sessions.session_state(_ev(spark)).filter(F.col("session_id") == "s2").collect()
    assert [(r["state_key"], r["state_value"]) for r in after_reset] == [("k", 9.0)]


def test_history_and_clear(spark):
    h = sessions.session_history(_ev(spark), honour_clear=False).filter(F.col("session_id") == "s1")
    assert sorted(r["event_id"] for r in h.collect()) == [1, 2, 3, 4, 5, 6, 7]
    c = sessions.session_history(_ev(spark)).filter(F.col("session_id") == "s1")
    assert [r["event_id"] for r in c.collect()] == [7]
    # clearing history keeps the state
    st = sessions.session_state(_ev(spark)).filter(F.col("session_id") == "s1").count()
    assert st == 2


def test_unknown_session_lookup(spark):
    asked = spark.createDataFrame([("a", "u", "s1"), ("a", "u", "nope")], "app string, user_id string, session_id string")
    got = {r["session_id"]: r["state"] for r in sessions.lookup(asked, sessions.session_state(_ev(spark))).collect()}
    assert got["nope"] == {} and got["s1"]["out"] == 3.0


def test_first_reply_blocks(spark):
    rows = []
    roles = ["system", "user", "assistant", "assistant", "user", "user", "assistant", "user", "user", "user", "assistant"]
    for conv in range(3):
        for turn, role in enumerate(roles):
            rows.append((conv, turn, role))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string")
    want = {}
    for turn, role in enumerate(roles):
        if role == "user":
            nxt = next((t for t in range(turn + 1, len(roles)) if roles[t] == "user"), len(roles))
            want[turn] = next((t for t in range(turn + 1, nxt) if roles[t] == "assistant"), None)
    for block in (2, 3, 1024):  # small blocks exercise the carry across blocks
        got = sessions.first_reply(turns, block=block).filter(F.col("conv_id") == 1).collect()
        assert {r["user_turn"]: r["assistant_turn"] for r in got} == want
