"""Session operators over an append-only event table.

Events: ``app, user_id, session_id, ts, event_id, author, content,
state_key, state_value, is_final, is_reset, is_clear``.  The order inside a
session is ``(ts, event_id)``.  State and history are *queries* over the
events, not mutable objects:

* state   = last write per key since the last reset (a reset event opens a new
            session, so its own delta is the initial state – N1, N3);
* history = events since the last reset and after the last clear (N4).

Skew: no operator sorts or collects a whole session in one task.  The state
is folded first (``max_by`` per session and key, combined map-side) and only
the few folded rows meet the session's last reset: the last write of a key
counts if it isn't older.  History joins every event with its session's
markers; events are dealt over ``HISTORY_SALTS`` salts per session and the one
marker row is repeated per salt, so a hot session is many join keys.
The ``(ts, event_id)`` order is packed into one decimal column so these
aggregates run hash-based instead of sort-based.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions.keys import event_order_key

KEYS = ["app", "user_id", "session_id"]
#: Join keys that the events of one session are dealt over.
HISTORY_SALTS = 32


def _with_seq(events: DataFrame) -> DataFrame:
    """Add ``_seq``: the (ts, event_id) order packed in one decimal, so the
    marker and fold aggregates run as hash aggregates (see functions.keys)."""
    if "_seq" in events.columns:
        return events
    return events.withColumn(
        "_seq", event_order_key(F.col("ts"), F.col("event_id"), events.schema["ts"].dataType)
    )


def _seq() -> F.Column:
    return F.col("_seq")


def _markers(events: DataFrame) -> DataFrame:
    return events.groupBy(*KEYS).agg(
        F.max(F.when(F.col("is_reset"), _seq())).alias("last_reset"),
        F.max(F.when(F.col("is_clear"), _seq())).alias("last_clear"),
    )


def fold_state(events: DataFrame) -> DataFrame:
    """Last value per (session, key) with its order key; ``max_by`` is map-side combined."""
    events = _with_seq(events)
    return (
        events.filter(F.col("state_key").isNotNull())
        .groupBy(*KEYS, "state_key")
        .agg(F.max_by("state_value", _seq()).alias("state_value"), F.max(_seq()).alias("_seq"))
    )


def after_reset(folded: DataFrame, resets: DataFrame) -> DataFrame:
    """Folded rows whose last write isn't older than the session's last reset
    (``last_reset``); if it is older, the reset has removed the key."""
    joined = folded.join(resets, on=KEYS, how="left")
    return joined.filter(F.col("last_reset").isNull() | (_seq() >= F.col("last_reset"))).drop("last_reset")


def session_state(events: DataFrame, honour_reset: bool = True) -> DataFrame:
    """State rows ``app, user_id, session_id, state_key, state_value``."""
    events = _with_seq(events)
    folded = fold_state(events)
    if honour_reset:
        resets = events.filter("is_reset").groupBy(*KEYS).agg(F.max(_seq()).alias("last_reset"))
        folded = after_reset(folded, resets)
    return folded.drop("_seq")


def create_if_absent(requests: DataFrame) -> DataFrame:
    """State events of new sessions from requests (``KEYS``, ``ts``,
    ``event_id``, ``initial`` map).  Only a session's first request sets its
    initial state; later ones find the session there."""
    seq = event_order_key(F.col("ts"), F.col("event_id"), requests.schema["ts"].dataType)
    first = requests.groupBy(*KEYS).agg(
        F.min_by(F.struct("ts", "event_id", "initial"), seq).alias("first"),
    )
    return first.select(
        *KEYS, "first.ts", "first.event_id", F.explode("first.initial").alias("state_key", "state_value")
    )


# State keys that a run sets; the outputs start empty.
RUN_QUERY_KEY = "current_user_query"
RUN_OUTPUT_KEYS = ["query_moderator_output", "query_expander_output", "query_router_output"]


def run_delta(runs: DataFrame) -> DataFrame:
    """State events of runs (``KEYS``, ``ts``, ``event_id``, ``query``,
    ``attempt``): the first attempt sets the query and empties the outputs, a
    retry (attempt above 0) writes nothing."""
    delta = F.create_map(
        F.lit(RUN_QUERY_KEY), F.col("query"), *[x for k in RUN_OUTPUT_KEYS for x in (F.lit(k), F.lit("{}"))]
    )
    return runs.filter("attempt = 0").select(
        *KEYS, "ts", "event_id", F.explode(delta).alias("state_key", "state_value")
    )


def session_history(events: DataFrame, honour_clear: bool = True) -> DataFrame:
    """A7 + N4: event rows since the last reset and after the last clear,
    with their order key ``(ts, event_id)``; clear markers are not history."""
    events = _with_seq(events)
    salts = F.explode(F.sequence(F.lit(0), F.lit(HISTORY_SALTS - 1)))
    m = _markers(events).withColumn("_salt", salts)
    salted = events.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(HISTORY_SALTS)).cast("int"))
    out = salted.join(m, on=[*KEYS, "_salt"], how="inner").filter(
        F.col("last_reset").isNull() | (_seq() >= F.col("last_reset"))
    )
    if honour_clear:
        out = out.filter(
            (F.col("last_clear").isNull() | (_seq() > F.col("last_clear"))) & ~F.col("is_clear")
        )
    return out.drop("last_reset", "last_clear", "_seq", "_salt")


def lookup(sessions: DataFrame, state: DataFrame) -> DataFrame:
    """State of the asked sessions; an unknown session gets an empty map."""
    s = state.groupBy(*KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("state_key", "state_value"))).alias("state")
    )
    empty = F.create_map().cast("map<string,double>")
    return sessions.join(s, on=KEYS, how="left").withColumn("state", F.coalesce("state", empty))


def first_reply(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                ask: str = "user", reply: str = "assistant", block: int = 1024) -> DataFrame:
    """Each ``ask`` turn with the first ``reply`` turn before the next ask.

    Returns ``key, user_turn, assistant_turn`` (NULL when unanswered).  A reply
    belongs to the segment of the latest ask at or before it; the latest ask
    is a running max computed in two levels so no window spans more than
    ``block`` turns of one conversation: inside fixed turn blocks, then over
    the per-block maxima (``turns / block`` rows per conversation).  The
    reply per segment is a partial+final ``min`` aggregate.
    """
    t = turns.select(key, order, role).withColumn("blk", F.floor(F.col(order) / block))
    ask_turn = F.when(F.col(role) == ask, F.col(order))
    inside = t.withColumn(
        "seg_in",
        F.max(ask_turn).over(
            Window.partitionBy(key, "blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    per_block = t.groupBy(key, "blk").agg(F.max(ask_turn).alias("last_ask"))
    carry = per_block.withColumn(
        "carry",
        F.max("last_ask").over(
            Window.partitionBy(key).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
        ),
    ).select(key, "blk", "carry")
    seg = inside.join(carry, on=[key, "blk"], how="inner").withColumn(
        "seg", F.coalesce("seg_in", "carry")
    )
    replies = (
        seg.filter((F.col(role) == reply) & F.col("seg").isNotNull())
        .groupBy(key, "seg")
        .agg(F.min(order).alias("assistant_turn"))
    )
    asks = t.filter(F.col(role) == ask).select(key, F.col(order).alias("user_turn"))
    return asks.join(
        replies.withColumnRenamed("seg", "user_turn"), on=[key, "user_turn"], how="left"
    )
