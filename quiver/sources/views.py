"""Derived views over the driver tables.

The reference ships no data, so its inputs (articles, features, user queries,
model responses, latencies, session events) are derived from the driver tables.
Each view is ONE SQL text that runs unchanged in Spark (tables bound as
DataFrame parameters) and in DuckDB (tables by name), so the oracle sees
exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiver.sources.tables import table

# Category codes cycled over parts.  They cover every pattern of
# the labelling rule, an upper-case non-match, a plain non-match and NULL.
CATEGORY_CODES = [
    "men_shirts", "women_tops", "ladies_dresses", "kids_boy50-98", "kids_newborn50-98",
    "boy92-140", "boy92-170", "boy134-170", "girl50-98", "girl92-140",
    "girl92-170", "girl134-170", "home", "Men_Upper", None,
]

# Shopper sentences cycled over customers; {w} is the first word
# of the matching part name.  Includes blank, padded and NULL queries and two
# lexicon terms for the moderation rules.
QUERY_TEMPLATES = [
    "{w} shirt for men",
    "jacket for a boy 5 years old",
    "{w} dress for girl size 140",
    "clothes for kids",
    "   ",
    "{w} romper for my newborn son",
    "{w} hoodie with a gun print",
    "  {w} summer dress  ",
    "trousers for boy size 164",
    "top for a teen girl 12 years",
    None,
    "I hate you, idiot",
]

# Model responses cycled over customers (valid, unknown group,
# missing field, bad JSON, blocked, error, empty, non-object JSON).
RESPONSE_TEMPLATES = [
    '{"block": false, "queries": ["{w} dress", "{w} skirt"], "group": "ladies"}',
    '{"block": false, "queries": ["{w} top"], "group": "unisex"}',
    '{"block": false, "group": "men"}',
    '{"block": false, "queries": [',
    '{"block": true}',
    '{"error": "ERROR: model timeout"}',
    "",
    "[1, 2]",
]


def _lit(text: str) -> str:
    # SQL string literal; braces doubled because the text is later formatted
    # with table placeholders by spark.sql(**kwargs) and str.format.
    return "'" + text.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def _sql_str(value: str | None, word_col: str | None = None) -> str:
    if value is None:
        return "NULL"
    if word_col and "{w}" in value:
        pieces = value.split("{w}")
        parts = []
        for i, piece in enumerate(pieces):
            if i:
                parts.append(word_col)
            if piece:
                parts.append(_lit(piece))
        return " || ".join(parts)
    return _lit(value)


def _case(key: str, values: list[str | None], word_col: str | None = None) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {_sql_str(v, word_col)}" for i, v in enumerate(values)
    )
    return f"CASE {key} % {len(values)} {arms} END"


VIEW_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "articles": (
        f"""SELECT CAST(p_partkey AS STRING) AS castor,
       {_case('p_partkey', CATEGORY_CODES)} AS category_code,
       CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'SE' ELSE 'GB' END AS country_code,
       CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END AS buyable_status
FROM {{part}}""",
        ("part",),
    ),
    "features": (
        "SELECT CAST(vec_id AS STRING) AS castor, embedding AS features FROM {embeddings}",
        ("embeddings",),
    ),
    "latencies": (
        "SELECT CAST(event_id AS STRING) AS query, value AS latency_seconds FROM {events}",
        ("events",),
    ),
    "session_events": (
        """SELECT 'shop' AS app, CAST(user_id AS STRING) AS user_id,
       CAST(user_id % 40 AS STRING) AS session_id, ts, event_id,
       event_type AS author, props AS content,
       event_type AS state_key, value AS state_value,
       event_type = 'purchase' AS is_final,
       event_type = 'signup' AS is_reset,
       event_type = 'error' AS is_clear
FROM {events}""",
        ("events",),
    ),
    "user_queries": (
        f"""SELECT c.c_custkey AS query_id,
       {_case('c.c_custkey', QUERY_TEMPLATES, 'coalesce(p.w, ' + chr(39) + 'plain' + chr(39) + ')')} AS user_queries
FROM {{customer}} c
LEFT JOIN (SELECT p_partkey, split_part(p_name, ' ', 1) AS w FROM {{part}}) p
  ON p.p_partkey = c.c_custkey""",
        ("customer", "part"),
    ),
    "responses": (
        f"""SELECT c.c_custkey AS query_id,
       {_case('c.c_custkey', QUERY_TEMPLATES, 'coalesce(p.w, ' + chr(39) + 'plain' + chr(39) + ')')} AS query,
       {_case('c.c_custkey', RESPONSE_TEMPLATES, 'coalesce(p.w, ' + chr(39) + 'plain' + chr(39) + ')')} AS response,
       c.c_acctbal / 10000.0 AS latency_seconds
FROM {{customer}} c
LEFT JOIN (SELECT p_partkey, split_part(p_name, ' ', 1) AS w FROM {{part}}) p
  ON p.p_partkey = c.c_custkey""",
        ("customer", "part"),
    ),
}


#: Customers whose texts one task works on, about.
TASK_CUSTOMERS = 1 << 14


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers dealt over tasks by their number: they are few bytes in few
    files, while the patterns that their texts go through cost far more than the
    reading, and would else all run in the one or two tasks of the scan."""
    rows = table(spark, sf_dir, "customer")
    return rows.repartition(max(2, min(-(-rows.count() // TASK_CUSTOMERS), 10_000)), "c_custkey")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a derived view as a lazy DataFrame."""
    text, deps = VIEW_SQL[name]
    return spark.sql(text, **{d: _customers(spark, sf_dir) if d == "customer" else table(spark, sf_dir, d) for d in deps})


def duckdb_with(*names: str) -> str:
    """``WITH`` clause defining the given views for the DuckDB oracle."""
    parts = []
    for name in names:
        text, deps = VIEW_SQL[name]
        parts.append(f"{name} AS ({text.format(**{d: d for d in deps})})")
    return "WITH " + ",\n".join(parts)
