"""DuckDB texts equivalent to the registered queries (the correctness oracle).

They read the same driver tables and the same view texts
(:mod:`quiver.sources.views`), and compute every result the plain way –
cross products, full sorts – which is fine at the check's scale.
"""

from __future__ import annotations

from quiver.operators.labels import GROUP_RULES, GROUPS
from quiver.sources.views import duckdb_with

ORACLE: dict[str, str] = {}


def _group_case_list() -> str:
    arms = []
    for label, patterns in GROUP_RULES:
        cond = " OR ".join(f"category_code LIKE '{p}'" for p in patterns)
        arms.append(f"CASE WHEN {cond} THEN ['{label}'] ELSE [] END")
    return "flatten([" + ", ".join(arms) + "])"


GROUP_LIST = "[" + ", ".join(f"'{g}'" for g in GROUPS) + "]"

EXTRACT = duckdb_with("articles", "features") + f""",
raw AS (SELECT castor, {_group_case_list()} AS pg FROM articles
        WHERE country_code = 'GB' AND buyable_status = 1),
agg AS (SELECT castor, list_sort(list(DISTINCT g)) AS groups
        FROM (SELECT castor, unnest(pg) AS g FROM raw) GROUP BY castor),
ext AS (SELECT f.castor, f.features, a.groups FROM features f JOIN agg a ON f.castor = a.castor),
pts AS (SELECT TRY_CAST(regexp_replace(castor, '^\\s+|\\s+$', '', 'g') AS BIGINT) AS id,
               castor, features::DOUBLE[] AS vector, groups FROM ext)
"""

ORACLE["param_sql"] = EXTRACT + """
SELECT castor, array_to_string(groups, ',') AS groups, CAST(len(features) AS BIGINT) AS n_dims FROM ext"""
ORACLE["extract_vectors"] = ORACLE["param_sql"]

ORACLE["filter_buyable"] = duckdb_with("articles") + """
SELECT * FROM articles WHERE country_code = 'GB' AND buyable_status = 1"""

ORACLE["label_groups"] = EXTRACT + """
SELECT castor, array_to_string(pg, ',') AS potential_groups, CAST(len(pg) AS BIGINT) AS n_groups FROM raw"""

ORACLE["aggregate_groups"] = EXTRACT + """
SELECT castor, array_to_string(groups, ',') AS groups FROM agg"""

ORACLE["to_points"] = EXTRACT + """
SELECT id, castor, array_to_string(groups, ',') AS groups, CAST(len(vector) AS BIGINT) AS n_dims FROM pts"""

RAW_POINTS = duckdb_with("features") + """,
raw AS (SELECT CASE WHEN p_partkey % 4 = 1 THEN ' ' || CAST(p_partkey AS VARCHAR) || ' '
                    WHEN p_partkey % 4 = 2 THEN 'p' || CAST(p_partkey AS VARCHAR)
                    ELSE CAST(p_partkey AS VARCHAR) END AS castor,
               f.features
        FROM part LEFT JOIN features f ON CAST(p_partkey AS VARCHAR) = f.castor),
rp AS (SELECT castor, TRY_CAST(regexp_replace(castor, '^\\s+|\\s+$', '', 'g') AS BIGINT) AS id, features FROM raw)
"""

ORACLE["quarantine_bad_rows"] = RAW_POINTS + """
SELECT castor, id,
       CASE WHEN id IS NULL THEN 'id_not_integer'
            WHEN features IS NULL THEN 'missing_vector:image'
            WHEN len(features) <> 64 THEN 'dimension_mismatch:image' END AS reason
FROM rp"""

ORACLE["validate_vectors"] = RAW_POINTS + """
SELECT 'image' AS vector_name, 64 AS expected_size, count(*) AS n_points,
       count_if(features IS NOT NULL AND len(features) = 64) AS n_ok,
       count_if(features IS NULL) AS n_missing,
       count_if(features IS NOT NULL AND len(features) <> 64) AS n_mismatch,
       CAST(min(len(features)) AS INTEGER) AS min_size, CAST(max(len(features)) AS INTEGER) AS max_size
FROM rp
UNION ALL
SELECT 'text', 768, count(*), 0, count(*), 0, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER) FROM rp"""

ORACLE["collection_info"] = EXTRACT + """
SELECT count(*) AS points_count, count(DISTINCT id) AS distinct_ids,
       CAST(min(len(vector)) AS BIGINT) AS min_dim, CAST(max(len(vector)) AS BIGINT) AS max_dim,
       count_if(list_sum(list_transform(vector, lambda x: x * x)) = 0) AS zero_vectors
FROM pts"""

UPSERT = """
WITH old AS (SELECT o_orderkey AS id, 'old' AS version, o_totalprice * 1.0 AS price FROM orders
             WHERE o_orderdate < TIMESTAMP '1995-01-01'),
     new AS (SELECT o_orderkey AS id, 'new' AS version, o_totalprice * 1.1 AS price FROM orders
             WHERE o_orderdate >= TIMESTAMP '1994-01-01')
"""
ORACLE["upsert_insert_absent"] = UPSERT + """
SELECT id, version, round(price, 6) AS price FROM old
UNION ALL
SELECT id, version, round(price, 6) FROM new WHERE id NOT IN (SELECT id FROM old)"""
ORACLE["upsert_id_filter"] = ORACLE["upsert_insert_absent"]
ORACLE["upsert_overwrite"] = UPSERT + """
SELECT id, version, round(price, 6) AS price FROM old WHERE id NOT IN (SELECT id FROM new)
UNION ALL
SELECT id, version, round(price, 6) FROM new"""

ORACLE["scroll_first_page"] = EXTRACT + """
SELECT id, array_to_string(groups, ',') AS groups FROM pts ORDER BY id LIMIT 1000"""

ORACLE["retrieve_by_ids"] = EXTRACT + """
SELECT id, array_to_string(groups, ',') AS groups FROM pts
WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')"""

ORACLE["count_points"] = EXTRACT + "SELECT count(*) AS count FROM pts"
ORACLE["count_filtered"] = EXTRACT + "SELECT count(*) AS count FROM pts WHERE list_contains(groups, 'men')"

_METRIC_SQL = {
    "Cosine": ("list_cosine_similarity(p.v, q.v)", "DESC"),
    "Dot": ("list_inner_product(p.v, q.v)", "DESC"),
    "Euclid": ("list_distance(p.v, q.v)", "ASC"),
    "Manhattan": ("list_sum(list_transform(list_zip(p.v, q.v), lambda t: abs(t[1] - t[2])))", "ASC"),
}


def _knn_sql(metric: str, k: int = 10) -> str:
    expr, direction = _METRIC_SQL[metric]
    return f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, p.vec_id AS id, {expr} AS score FROM e p, e q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {direction}, id) AS rnk
      FROM s WHERE score IS NOT NULL AND NOT isnan(score))
SELECT query_id, CAST(rnk AS BIGINT) AS rank, id, round(score, 6) AS score FROM r WHERE rnk <= {k}"""


for _m in ("Cosine", "Dot", "Euclid", "Manhattan"):
    ORACLE[f"knn_{_m.lower()}"] = _knn_sql(_m)

ORACLE["knn_filtered"] = EXTRACT + f""",
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, ({GROUP_LIST})[label % 8 + 1] AS grp FROM embeddings),
s AS (SELECT q.query_id, p.id, list_cosine_similarity(p.vector, q.v) AS score
      FROM pts p JOIN q ON list_contains(p.groups, q.grp)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk
      FROM s WHERE score IS NOT NULL AND NOT isnan(score))
SELECT query_id, CAST(rnk AS BIGINT) AS rank, id, round(score, 6) AS score FROM r WHERE rnk <= 5"""

ORACLE["knn_payload_filter"] = EXTRACT + """,
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.query_id, p.id, list_cosine_similarity(p.vector, q.v) AS score
      FROM pts p, q WHERE list_contains(p.groups, 'men')),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk
      FROM s WHERE score IS NOT NULL AND NOT isnan(score))
SELECT query_id, CAST(rnk AS BIGINT) AS rank, id, round(score, 6) AS score FROM r WHERE rnk <= 5"""

ORACLE["knn_bitmap_filter"] = ORACLE["knn_payload_filter"]

ORACLE["payload_index_match"] = EXTRACT + """
SELECT 'all' AS "match", id, array_to_string(groups, ',') AS groups FROM pts
WHERE list_contains(groups, 'boy_92_140') AND list_contains(groups, 'boy_134_170')
UNION ALL
SELECT 'any', id, array_to_string(groups, ',') FROM pts
WHERE list_contains(groups, 'boy_92_140') OR list_contains(groups, 'boy_134_170')"""

# ---------------------------------------------------------------- statistics

ORACLE["eval_average_row"] = duckdb_with("latencies") + """
SELECT query, round(latency_seconds, 6) AS latency_seconds FROM latencies
UNION ALL
SELECT 'AVERAGE', round(avg(latency_seconds), 6) FROM latencies HAVING count(latency_seconds) > 0"""

ORACLE["latency_stats"] = duckdb_with("latencies") + """,
r AS (SELECT latency_seconds AS v, row_number() OVER (ORDER BY latency_seconds) AS rn,
             count(*) OVER () AS m FROM latencies WHERE latency_seconds IS NOT NULL),
cuts AS (SELECT * FROM (VALUES ('p95', 19, 20), ('p99', 99, 100)) t(name, i, n)),
k AS (SELECT name, i, n, m, v, rn,
             least(greatest(CAST(floor(i * (m + 1) / n) AS BIGINT), 1), m - 1) AS j
      FROM r CROSS JOIN cuts),
q AS (SELECT name,
             (max(CASE WHEN rn = j THEN v END) * (max(n) - max(i * (m + 1) - j * n))
              + max(CASE WHEN rn = j + 1 THEN v END) * max(i * (m + 1) - j * n)) / max(n) AS value
      FROM k WHERE rn IN (j, j + 1) GROUP BY name)
SELECT 'count' AS metric, CAST(count(latency_seconds) AS DOUBLE) AS value FROM latencies
UNION ALL SELECT 'mean', round(avg(latency_seconds), 6) FROM latencies
UNION ALL SELECT name, round(value, 6) FROM q"""

ORACLE["latency_stats_ms"] = """
WITH latencies AS (SELECT l_quantity * l_discount + l_tax AS latency_seconds FROM lineitem)""" + (
    ORACLE["latency_stats"].removeprefix(duckdb_with("latencies"))
    .replace("round(avg(latency_seconds), 6)", "round(1000 * avg(latency_seconds), 6)")
    .replace("round(value, 6)", "round(1000 * value, 6)")
)

ORACLE["latency_p95_index"] = duckdb_with("latencies") + """,
r AS (SELECT latency_seconds AS v, row_number() OVER (ORDER BY latency_seconds) AS rn,
             count(*) OVER () AS m FROM latencies WHERE latency_seconds IS NOT NULL)
SELECT CAST(max(m) AS BIGINT) AS n,
       round(max(CASE WHEN rn = least(CAST(floor(m * 0.95::DOUBLE) AS BIGINT), m - 1) + 1 THEN v END), 6) AS p95
FROM r"""

# ---------------------------------------------------------------- sessions

SESS = duckdb_with("session_events") + """,
lr AS (SELECT app, user_id, session_id, ts AS r_ts, event_id AS r_id FROM (
         SELECT *, row_number() OVER (PARTITION BY app, user_id, session_id ORDER BY ts DESC, event_id DESC) AS k
         FROM session_events WHERE is_reset) WHERE k = 1),
lc AS (SELECT app, user_id, session_id, ts AS c_ts, event_id AS c_id FROM (
         SELECT *, row_number() OVER (PARTITION BY app, user_id, session_id ORDER BY ts DESC, event_id DESC) AS k
         FROM session_events WHERE is_clear) WHERE k = 1),
cur AS (SELECT e.* FROM session_events e LEFT JOIN lr USING (app, user_id, session_id)
        WHERE lr.r_ts IS NULL OR e.ts > lr.r_ts OR (e.ts = lr.r_ts AND e.event_id >= lr.r_id))
"""


def _fold(src: str) -> str:
    return f"""
SELECT user_id, session_id, state_key, round(state_value, 6) AS state_value FROM (
  SELECT *, row_number() OVER (PARTITION BY app, user_id, session_id, state_key
                               ORDER BY ts DESC, event_id DESC) AS k
  FROM {src} WHERE state_key IS NOT NULL) WHERE k = 1"""


ORACLE["session_state"] = SESS + _fold("session_events")
ORACLE["session_reset"] = SESS + _fold("cur")
ORACLE["session_history"] = SESS + "SELECT user_id, session_id, event_id, author FROM cur"
ORACLE["session_clear_history"] = SESS + """
SELECT user_id, session_id, event_id, author FROM cur LEFT JOIN lc USING (app, user_id, session_id)
WHERE NOT is_clear AND (lc.c_ts IS NULL OR cur.ts > lc.c_ts OR (cur.ts = lc.c_ts AND cur.event_id > lc.c_id))"""

ORACLE["session_run_delta"] = """
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS user_id, CAST(conv_id % 40 AS VARCHAR) AS session_id, turn, text
           FROM conversations WHERE role = 'user'),
d AS (SELECT user_id, session_id, max(turn) AS turn, arg_max(text, turn) AS text FROM t WHERE turn % 5 <> 4 GROUP BY ALL)
SELECT user_id, session_id, 'num_queries' AS state_key, CAST(min(turn) + 1 AS VARCHAR) AS state_value FROM t GROUP BY ALL
UNION ALL SELECT user_id, session_id, 'current_user_query', text FROM d
UNION ALL SELECT user_id, session_id, unnest(['query_moderator_output', 'query_expander_output', 'query_router_output']), '{}' FROM d"""

ORACLE["turn_pairs"] = """
WITH u AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt
           FROM conversations WHERE role = 'user')
SELECT u.conv_id, u.turn AS user_turn,
       (SELECT min(a.turn) FROM conversations a
        WHERE a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn > u.turn
          AND (u.nxt IS NULL OR a.turn < u.nxt)) AS assistant_turn
FROM u"""

# ---------------------------------------------------------------- enrichment

from quiver.operators import enrich as _en  # noqa: E402
from quiver.plans.registered import PROMPT_TEMPLATE, PROMPT_VALUES  # noqa: E402


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {_lit(pattern)})"


def _topic(col: str) -> str:
    arms = " ".join(
        f"WHEN {_rx(col, _en._topic_pattern(terms))} THEN {_lit(name)}" for name, terms in _en.MODERATION_LEXICON
    )
    return f"CASE {arms} END"


def _band(v: str, bands) -> str:
    arms = " ".join(f"WHEN {v} < {b} THEN {_lit(name)}" for b, name in bands)
    return f"CASE WHEN {v} IS NULL THEN NULL {arms} ELSE {_lit(_en.TOP_BAND)} END"


def _route(col: str) -> str:
    size = f"TRY_CAST(regexp_extract({col}, {_lit(_en.SIZE)}, 1) AS INTEGER)"
    age = f"TRY_CAST(regexp_extract({col}, {_lit(_en.AGE)}, 1) AS INTEGER)"
    word = f"CASE WHEN {_rx(col, _en.BABY)} THEN '50_98' WHEN {_rx(col, _en.TEEN)} THEN {_lit(_en.TOP_BAND)} END"
    band = f"coalesce({_band(size, _en.SIZE_BANDS)}, {_band(age, _en.AGE_BANDS)}, {word})"
    gender = (f"CASE WHEN {_rx(col, _en.BOY)} THEN 'boy' WHEN {_rx(col, _en.GIRL)} THEN 'girl' "
              f"WHEN {_rx(col, _en.KIDS)} THEN 'girl' END")
    return (f"CASE WHEN {col} IS NULL THEN {_lit(_en.DEFAULT_GROUP)} "
            f"WHEN {gender} IS NOT NULL THEN {gender} || '_' || coalesce({band}, '92_140') "
            f"WHEN {_rx(col, _en.MEN)} THEN 'men' ELSE {_lit(_en.DEFAULT_GROUP)} END")


def _expand_base(col: str) -> str:
    b = col
    for p in _en.STRIP_PATTERNS:
        b = f"regexp_replace({b}, {_lit(p)}, ' ', 'g')"
    b = f"regexp_replace({b}, '\\s+', ' ', 'g')"
    return f"regexp_replace({b}, '^\\s+|\\s+$', '', 'g')"


def _expand(base: str, n: int = _en.NUM_QUERIES) -> str:
    facets = "[" + ", ".join(_lit(f) for f in _en.FACETS) + "]"
    return (f"CASE WHEN {base} IS NULL OR {base} = '' THEN []::VARCHAR[] ELSE "
            f"list_concat([{base}], list_transform({facets}, lambda f: {base} || ' ' || f))[1:{n}] END")


ENRICH = duckdb_with("user_queries") + """,
uq AS (SELECT query_id, user_queries, lower(user_queries) AS lq FROM user_queries),
cq AS (SELECT query_id, regexp_replace(user_queries, '^\\s+|\\s+$', '', 'g') AS query FROM user_queries),
cl AS (SELECT query_id, query, lower(query) AS lq FROM cq WHERE query IS NOT NULL AND query <> '')
"""

ORACLE["clean_queries"] = ENRICH + "SELECT query_id, query FROM cl"
ORACLE["moderate_queries"] = ENRICH + f"""
SELECT query_id, ({_topic('lq')}) IS NOT NULL AS block, {_topic('lq')} AS topic FROM uq"""
ORACLE["route_queries"] = ENRICH + f"SELECT query_id, {_route('lq')} AS \"group\" FROM uq"
ORACLE["expand_queries"] = ENRICH + f"""
SELECT query_id, array_to_string(q, '|') AS queries FROM (
  SELECT query_id, {_expand('base')} AS q FROM (SELECT query_id, {_expand_base('lq')} AS base FROM uq))"""

_PIPE = ENRICH + f""",
e AS (SELECT query_id, ({_topic('lq')}) AS topic, {_route('lq')} AS grp,
             {_expand(_expand_base('lq'))} AS q FROM cl)
"""
ORACLE["pipeline_parallel"] = _PIPE + """
SELECT query_id, topic IS NOT NULL AS block, topic, array_to_string(q, '|') AS queries, grp AS "group" FROM e"""
ORACLE["pipeline_gated"] = _PIPE + """
SELECT query_id, topic IS NOT NULL AS block, topic,
       CASE WHEN topic IS NULL THEN array_to_string(q, '|') END AS queries,
       CASE WHEN topic IS NULL THEN grp END AS "group" FROM e"""
ORACLE["merge_enrichments"] = _PIPE + """
SELECT query_id, topic IS NOT NULL AS block,
       CASE WHEN len(q) > 0 THEN array_to_string(q, '|') END AS queries,
       CASE WHEN topic IS NULL THEN grp END AS "group" FROM e"""

ORACLE["evaluate_batch"] = _PIPE + """
SELECT cl.query, true AS timed, topic IS NOT NULL AS block, array_to_string(q, '|') AS queries, grp AS "group",
       NULL::VARCHAR AS error, NULL::VARCHAR AS raw_response FROM e JOIN cl USING (query_id)
UNION ALL SELECT 'AVERAGE', true, NULL, NULL, NULL, NULL, NULL"""
_ANSWERED = "NOT contains(query, 'z') AND NOT contains(query, 'men')"
ORACLE["evaluate_batch_timed"] = ENRICH + f"""
SELECT query_id, query, true AS timed, CASE WHEN {_ANSWERED} THEN contains(query, 'gun') END AS block,
       CASE WHEN {_ANSWERED} THEN query || '|' || query || ' sale' END AS queries, CASE WHEN {_ANSWERED} THEN 'ladies' END AS "group",
       CASE WHEN contains(query, 'z') THEN 'ERROR: no answer for ' || length(query) || ' characters' END AS error,
       CASE WHEN NOT contains(query, 'z') AND contains(query, 'men') THEN 'I would say ' || query END AS raw_response,
       CASE WHEN {_ANSWERED} THEN '{{"words":"' || len(string_split(query, ' ')) || '","note":"{{\\"own_session\\":true}}"}}' END AS other FROM cl
UNION ALL SELECT NULL, 'AVERAGE', true, NULL, NULL, NULL, NULL, NULL, NULL"""
_ROUTED = "CASE WHEN contains(query, 'z') THEN NULL WHEN contains(query, 'men') THEN 'men' ELSE 'ladies' END"
ORACLE["agent_retry"] = ENRICH + f"""
SELECT query_id, {_ROUTED} AS "group", contains(query, 'z') AS failed FROM cl"""
ORACLE["pipeline_gated_model"] = ENRICH + f"""
SELECT query_id, CASE WHEN contains(query, 'z') THEN NULL ELSE contains(query, 'gun') END AS block,
       CASE WHEN contains(query, 'z') THEN '{{}}' WHEN contains(query, 'gun') THEN '{{"block":true}}'
            ELSE '{{"block":false,"group":"' || {_ROUTED} || '"}}' END AS response FROM cl"""

_expr = _lit(PROMPT_TEMPLATE)
for _k, _v in PROMPT_VALUES.items():
    _expr = f"replace({_expr}, {_lit('{' + _k + '}')}, {_lit(str(_v))})"
_expr = f"replace({_expr}, '{{query}}', query)"
ORACLE["render_prompt"] = ENRICH + f"SELECT query_id, {_expr} AS prompt FROM cl"

RESP = duckdb_with("responses") + """,
rv AS (SELECT query_id, response, CASE WHEN json_valid(response) THEN response END AS js FROM responses),
rp AS (SELECT *, coalesce(json_type(js) = 'OBJECT'
                 AND coalesce(json_type(js, '$.block') IN ('BOOLEAN', 'NULL'), true)
                 AND coalesce(json_type(js, '$.queries') IN ('ARRAY', 'NULL'), true)
                 AND coalesce(json_type(js, '$.group') IN ('VARCHAR', 'NULL'), true), false) AS ok
       FROM rv),
pr AS (SELECT query_id, response, ok,
              CASE WHEN ok THEN TRY_CAST(json_extract(js, '$.block') AS BOOLEAN) END AS block,
              CASE WHEN ok THEN TRY_CAST(json_extract(js, '$.queries') AS VARCHAR[]) END AS queries,
              CASE WHEN ok THEN json_extract_string(js, '$.group') END AS grp,
              CASE WHEN ok THEN json_extract_string(js, '$.error') END AS error,
              CASE WHEN NOT ok THEN response END AS raw_response
       FROM rp)
"""
ORACLE["json_response_parse"] = RESP + """
SELECT query_id, block, array_to_string(queries, '|') AS queries, grp AS "group", error, raw_response FROM pr"""
_GROUPS_SQL = "[" + ", ".join(_lit(g) for g in GROUPS) + "]"
ORACLE["validate_outputs"] = RESP + f""",
st AS (SELECT *, CASE WHEN raw_response IS NOT NULL OR response IS NULL THEN 'bad_json'
                      WHEN error IS NOT NULL THEN 'error'
                      WHEN grp IS NOT NULL AND NOT list_contains({_GROUPS_SQL}, grp) THEN 'bad_enum'
                      ELSE 'ok' END AS status FROM pr)
SELECT query_id, status,
       CASE WHEN status = 'ok' THEN coalesce(block, false) END AS block,
       CASE WHEN status = 'ok' THEN array_to_string(coalesce(queries, []::VARCHAR[]), '|') END AS queries,
       CASE WHEN status = 'ok' THEN coalesce(grp, 'ladies') END AS "group"
FROM st"""

# ---------------------------------------------------------------- embeddings, quantization

from quiver.operators.embed import TEXT_DIM  # noqa: E402
from quiver.plans.registered import QUANTILE  # noqa: E402


def _weights(src: str, key: str, dim: int = TEXT_DIM) -> str:
    """Signed hashed term counts ``key, bucket, w`` of a (key, text) source."""
    return f"""
SELECT {key} AS key, h % {dim} AS bucket, sum(1 - 2 * ((h // {dim}) % 2)) AS w FROM (
  SELECT {key}, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h FROM (
    SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS tok FROM {src})
  WHERE tok <> '')
GROUP BY 1, 2 HAVING sum(1 - 2 * ((h // {dim}) % 2)) <> 0"""


ORACLE["embed_text"] = f"""
WITH w AS ({_weights('documents', 'doc_id')}),
n AS (SELECT key, sqrt(sum(w * w)) AS nrm FROM w GROUP BY key),
s AS (SELECT w.key, count(*) AS n_nonzero, round(sqrt(sum((w / nrm) * (w / nrm))), 6) AS norm,
             round(sum((w / nrm) * (bucket + 1)), 6) AS wsum
      FROM w JOIN n USING (key) GROUP BY w.key)
SELECT d.doc_id, CAST(len(regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}]+')) AS BIGINT) AS n_tokens,
       s.n_nonzero, s.norm, s.wsum
FROM documents d LEFT JOIN s ON s.key = d.doc_id"""

ORACLE["benchmark_search"] = f"""
WITH dw AS ({_weights('documents', 'doc_id')}),
qw AS ({_weights('benchmark', 'item_id')}),
dn AS (SELECT key, sqrt(sum(w * w)) AS nrm FROM dw GROUP BY key),
qn AS (SELECT key, sqrt(sum(w * w)) AS nrm FROM qw GROUP BY key),
dot AS (SELECT qw.key AS query_id, dw.key AS id, sum(qw.w * dw.w) AS d
        FROM qw JOIN dw USING (bucket) GROUP BY 1, 2),
s AS (SELECT q.key AS query_id, p.key AS id, coalesce(dot.d, 0) / (q.nrm * p.nrm) AS score
      FROM qn q CROSS JOIN dn p LEFT JOIN dot ON dot.query_id = q.key AND dot.id = p.key),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk FROM s)
SELECT query_id, CAST(rnk AS BIGINT) AS rank, id, round(score, 6) AS score FROM r WHERE rnk <= 5"""

_P_LO = (1 - QUANTILE) / 2
_P_HI = 1 - (1 - QUANTILE) / 2
ORACLE["quantize_int8"] = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT unnest(v) AS x FROM e),
r AS (SELECT x, row_number() OVER (ORDER BY x) AS rn FROM c),
m AS (SELECT count(*) AS m FROM c),
p AS (SELECT CAST('{_P_LO!r}' AS DOUBLE) * (m - 1) AS plo, CAST('{_P_HI!r}' AS DOUBLE) * (m - 1) AS phi, m FROM m),
b AS (SELECT
  max(CASE WHEN rn = floor(plo) + 1 THEN x END)
    + (max(CASE WHEN rn = least(floor(plo) + 2, m) THEN x END) - max(CASE WHEN rn = floor(plo) + 1 THEN x END))
      * (plo - floor(plo)) AS lo,
  max(CASE WHEN rn = floor(phi) + 1 THEN x END)
    + (max(CASE WHEN rn = least(floor(phi) + 2, m) THEN x END) - max(CASE WHEN rn = floor(phi) + 1 THEN x END))
      * (phi - floor(phi)) AS hi
  FROM r, p GROUP BY plo, phi, m)
SELECT vec_id AS id,
       array_to_string(list_transform(v, lambda x:
         CAST(floor((least(greatest(x, b.lo), b.hi) - b.lo) / (b.hi - b.lo) * 255 + 0.5) AS INTEGER)), ',') AS codes,
       round(b.lo, 6) AS lo, round(b.hi, 6) AS hi
FROM e, b"""

# The 3 queries with the smallest md5 key of (query_id, seed).
ORACLE["sample_queries"] = ENRICH + """
SELECT query_id, query FROM cl ORDER BY md5(CAST(query_id AS VARCHAR) || '-42'), query_id LIMIT 3"""

# Load job: the collection after an insert-if-absent load and a re-run with
# changed payloads equals the first load.
ORACLE["load_collection"] = EXTRACT + """
SELECT id, array_to_string(groups, ',') AS groups, CAST(len(vector) AS BIGINT) AS n_dims FROM pts"""

ORACLE["load_rejects"] = """
WITH p AS (SELECT vec_id, CASE WHEN vec_id % 7 <> 3 THEN vec_id // 2 END AS id,
                  CASE WHEN vec_id % 7 = 3 THEN 'id_not_integer' WHEN vec_id % 7 = 1 THEN 'dimension_mismatch:image'
                       WHEN vec_id % 7 = 2 THEN 'null_component:image' END AS reason FROM embeddings),
bad AS (SELECT reason, id FROM p WHERE reason IS NOT NULL AND vec_id % 3 = 0
        UNION ALL SELECT reason, id FROM p WHERE reason IS NOT NULL)
SELECT 'stored' AS what, count(DISTINCT id) AS n, count(DISTINCT id) AS ids FROM p WHERE reason IS NULL
UNION ALL SELECT reason, count(*), count(DISTINCT id) FROM bad GROUP BY reason"""

ORACLE["load_counts"] = """
WITH c AS (SELECT count(*) AS total, count(DISTINCT CASE WHEN vec_id % 5 <> 1 THEN vec_id // 2 END) AS ids,
                  count(*) FILTER (vec_id % 5 = 1) AS bad FROM embeddings)
SELECT batch, total, CASE WHEN batch = 'again' THEN 0 ELSE ids END AS loaded,
       '{"dimension_mismatch:image":' || bad || '}' AS rejected FROM c, (SELECT unnest(['first', 'again', 'over']) AS batch)"""

ORACLE["search_collection"] = EXTRACT + """
, s AS (SELECT q.vec_id AS query_id, p.id, p.groups, len(p.vector) AS n_dims,
        list_cosine_similarity(q.embedding::DOUBLE[], p.vector::DOUBLE[]) AS score FROM embeddings q, pts p)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS rank, id,
       round(score, 6) AS score, array_to_string(groups, ',') AS groups, CAST(n_dims AS BIGINT) AS n_dims
FROM s QUALIFY rank <= 5"""

# Every customer's session state; unknown sessions -> no keys.
ORACLE["session_lookup"] = SESS + """,
st AS (SELECT user_id, session_id, state_key, state_value FROM (
         SELECT *, row_number() OVER (PARTITION BY app, user_id, session_id, state_key
                                      ORDER BY ts DESC, event_id DESC) AS k
         FROM cur WHERE state_key IS NOT NULL) WHERE k = 1),
agg AS (SELECT user_id, session_id, count(*) AS n, string_agg(state_key, ',' ORDER BY state_key) AS keys,
               sum(state_value) AS total FROM st GROUP BY user_id, session_id)
SELECT CAST(c.c_custkey AS VARCHAR) AS user_id, CAST(coalesce(agg.n, 0) AS BIGINT) AS n_keys,
       coalesce(agg.keys, '') AS keys, round(coalesce(agg.total, 0.0), 6) AS total
FROM customer c LEFT JOIN agg ON agg.user_id = CAST(c.c_custkey AS VARCHAR) AND agg.session_id = CAST(c.c_custkey % 40 AS VARCHAR)"""

ORACLE["result_sink"] = "SELECT query, timed, block, queries, \"group\", error FROM (" + ORACLE["evaluate_batch"] + ")"

# K8: the md5-derived synthetic vector of every benchmark item, top 3 embeddings.
ORACLE["synthetic_vectors"] = """
WITH q AS (SELECT item_id AS query_id, list_transform(range(1, 65), lambda i:
             CAST(('0x' || substring(md5(CAST(item_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) || '-1'), 1, 13))
                  AS BIGINT) / 4503599627370496.0 * 2 - 1) AS v FROM benchmark),
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.query_id, e.vec_id AS id, list_cosine_similarity(e.v, q.v) AS score FROM e, q),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk
        FROM s WHERE score IS NOT NULL AND NOT isnan(score))
SELECT query_id, CAST(rnk AS BIGINT) AS rank, id, round(score, 6) AS score FROM top WHERE rnk <= 3"""

# K5: search on the int8 codes with error bounds, exact re-rank: the exact search.
ORACLE["knn_quantized_rerank"] = ORACLE["knn_cosine"]
ORACLE["knn_product_codes"] = ORACLE["knn_cosine"]
# K4 completed by radius bounds: the exact search.
ORACLE["ann_exact"] = ORACLE["knn_cosine"]
ORACLE["knn_pivots"] = ORACLE["knn_euclid"]
# K4 at a stated recall: every query has 10 true neighbours, 0.9 of all are found.
ORACLE["ann_targeted"] = f"SELECT count(*) AS total, true AS reached FROM ({ORACLE['knn_cosine']})"

# K7 + U3: the stand-in model counts characters by their code modulo the width.
ORACLE["embed_backend"] = """
WITH c AS (SELECT doc_id, unicode(unnest(regexp_extract_all(coalesce(text, ''), '(?s).'))) % 1408 AS i FROM documents),
n AS (SELECT doc_id, i, count(*) AS n FROM c GROUP BY doc_id, i),
s AS (SELECT doc_id, count(*) AS k, sum(n) AS total, sum(n * n) AS squares, sum(n * i) AS wsum FROM n GROUP BY doc_id)
SELECT doc_id, 1408::BIGINT AS dim, coalesce(k, 0) AS n_nonzero, coalesce(total, 0)::DOUBLE AS total,
       coalesce(squares, 0)::DOUBLE AS squares, coalesce(wsum, 0)::DOUBLE AS wsum FROM documents LEFT JOIN s USING (doc_id)"""

# ---------------------------------------------------------------- streaming twins (same answers as batch)

ORACLE["stream_upsert"] = ORACLE["upsert_insert_absent"]
ORACLE["stream_session_state"] = ORACLE["session_reset"]
ORACLE["stream_sessions_keyed"] = ORACLE["session_reset"]
ORACLE["stream_history_keyed"] = ORACLE["session_clear_history"]

# ---------------------------------------------------------------- files, composite

ORACLE["csv_required_column"] = duckdb_with("user_queries") + "SELECT query_id, user_queries FROM user_queries"

ORACLE["retrieve_for_queries"] = EXTRACT + f""",
uqv AS ({duckdb_with("user_queries")[5:].split(" AS (", 1)[1].rsplit(")", 1)[0]}),
cl AS (SELECT query_id, q AS query, lower(q) AS lq FROM (
         SELECT query_id, regexp_replace(user_queries, '^\\s+|\\s+$', '', 'g') AS q FROM uqv)
       WHERE q IS NOT NULL AND q <> ''),
e AS (SELECT query_id, {_route('lq')} AS grp, {_expand(_expand_base('lq'))} AS ex
      FROM cl WHERE ({_topic('lq')}) IS NULL),
x AS (SELECT query_id, grp, unnest(ex) AS text, generate_subscripts(ex, 1) - 1 AS pos FROM e),
xq AS (SELECT query_id * 16 + pos AS eq_id, query_id, grp, text FROM x),
qw AS ({_weights('xq', 'eq_id', 64)}),
qn AS (SELECT key, sqrt(sum(w * w)) AS nrm FROM qw GROUP BY key),
pv AS (SELECT id, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS bucket FROM pts),
pn AS (SELECT id, sqrt(list_sum(list_transform(vector, lambda v: v * v))) AS nrm, groups FROM pts),
dot AS (SELECT qw.key AS eq_id, pv.id, sum(qw.w * pv.x) AS d FROM qw JOIN pv USING (bucket) GROUP BY 1, 2),
s AS (SELECT xq.query_id, xq.eq_id, pn.id, dot.d / (qn.nrm * pn.nrm) AS score
      FROM xq JOIN qn ON qn.key = xq.eq_id JOIN pn ON list_contains(pn.groups, xq.grp)
      JOIN dot ON dot.eq_id = xq.eq_id AND dot.id = pn.id),
r1 AS (SELECT *, row_number() OVER (PARTITION BY eq_id ORDER BY score DESC, id) AS k1 FROM s),
b AS (SELECT query_id, id, max(score) AS score FROM r1 WHERE k1 <= 5 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk FROM b)
SELECT query_id, CAST(rnk AS BIGINT) AS rank, id, round(score, 6) AS score FROM r WHERE rnk <= 5"""
ORACLE["stream_load"] = ORACLE["load_collection"]
