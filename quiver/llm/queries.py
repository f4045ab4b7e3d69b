"""The dealt operators as registered queries, with DuckDB twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm.ann import nearest
from quiver.llm.bpe import bpe_digest
from quiver.llm.chat import formatted_digest, probe_conversation
from quiver.llm.common import documents, labels
from quiver.llm.debruijn import substring_dedup
from quiver.llm.exact_dedup import exact_dedup
from quiver.llm.mixing import label_quality, mix_sources
from quiver.llm.near_dup import jaccard_join
from quiver.llm.phrases import phrases
from quiver.llm.quality import quality
from quiver.llm.spelling import spelling_variants
from quiver.llm.suffix import suffix_dedup
from quiver.llm.token_files import token_digest
from quiver.llm.toxicity import toxicity


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), window=400)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir), threshold=0.8, n=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), label_quality(labels(spark, sf_dir))).drop("text_hash")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return nearest(embeddings, F.col("vec_id") % 20 == 0, k=20)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("keep_locator")


def op10_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), window=20)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(documents(spark, sf_dir), limit=2000, min_count=30)


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return formatted_digest(turns.unionByName(probe_conversation(spark)))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


REGISTRY = {
    "op1_suffix_array": op1_suffix_array,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_ann": op7_ann,
    "op8_token_files": op8_token_files,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_debruijn": op10_debruijn,
    "op11_phrases": op11_phrases,
    "op12_chat": op12_chat,
    "op13_spelling": op13_spelling,
}

ORACLE = {
    "op10_debruijn": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        k AS (
            SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS t
            FROM d WHERE len(w) >= 20),
        r AS (SELECT doc_id, s FROM k QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r),
        g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)""",
    "op11_phrases": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
            FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
        f AS MATERIALIZED (SELECT lang, k, g, array_to_string(g, ' ') AS t, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND f >= 30),
        cuts AS (SELECT lang, k, g, t, f, unnest(range(1, k)) AS i FROM c),
        s AS (
            SELECT cuts.lang, cuts.k, cuts.t, cuts.f AS a, i, l.f AS l, r.f AS r, (2000000::HUGEINT * cuts.f) // (l.f + r.f) AS score
            FROM cuts JOIN f l ON l.lang = cuts.lang AND l.k = i AND l.t = array_to_string(cuts.g[1:i], ' ')
            JOIN f r ON r.lang = cuts.lang AND r.k = cuts.k - i AND r.t = array_to_string(cuts.g[i + 1:], ' ')),
        best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, t ORDER BY score, i) = 1),
        inside AS (
            SELECT lang, k, f, unnest([array_to_string(g[b:b + m - 1], ' ') FOR b IN range(1, k - m + 2)]) AS t
            FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k),
        cover AS (SELECT lang, t, max(f) AS f FROM inside GROUP BY lang, t),
        kept AS (
            SELECT best.* FROM best LEFT JOIN cover USING (lang, t)
            WHERE cover.f IS NULL OR 100::HUGEINT * cover.f < 80::HUGEINT * best.a),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(t)) AS rank FROM kept)
        SELECT lang, rank, t AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, encode(role), encode(text))) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, encode(role), encode(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(role) + length(text) + 17
                   + len(regexp_extract_all(role, '\[\\*/?INST\]|<\\*/?s>')) + len(regexp_extract_all(text, '\[\\*/?INST\]|<\\*/?s>')))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op2_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT a AS doc_id, min(b) AS class_id, (SELECT count(*) FROM links WHERE links.a = reach.a) AS n_links FROM reach GROUP BY a""",
    "op4_mixing": r"""
        WITH q AS (
            SELECT doc_id, CASE WHEN avg(quality) >= 0.5 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS q
            FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
        d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   -ln((('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
                   / coalesce(q.q, 1.0::DOUBLE) AS key
            FROM documents LEFT JOIN q USING (doc_id)),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
                   ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
            FROM d GROUP BY source),
        l AS (
            SELECT *, row_number() OVER o AS place,
                   (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                   / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM s WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
        t AS (
            SELECT source, source_size,
                   least(cap::DOUBLE, w * (SELECT arg_min(level, place) FROM l WHERE level <= cap / w)) AS target
            FROM l),
        b AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t)
        SELECT doc_id, size, source_size, target, d.source,
               (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - coalesce(sum(size) OVER (
                   PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
        FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source""",
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
}
