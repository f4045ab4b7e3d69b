"""Enrichment rules, schema checks and the model backend (FIXTURES part A)."""

import json
import time

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.operators import enrich
from quiver.sources.views import view

from paths import SF_CHECK


def _q(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_router_bands_and_defaults(spark):
    texts = ["I need a black dress", "shirt for men", "clothes for kids", "jacket for a boy 5 years old",
             "dress for girl size 140", "romper for my newborn son", "trousers for boy size 164",
             "top for a teen girl 12 years", "my boyfriend", None]
    got = [r["g"] for r in _q(spark, texts).select(enrich.route(F.col("query")).alias("g")).collect()]
    assert got == ["ladies", "men", "girl_92_140", "boy_92_140", "girl_134_170", "boy_50_98",
                   "boy_134_170", "girl_134_170", "men", "ladies"]
    assert all(g in enrich.GROUPS for g in got)


def test_moderation(spark):
    df = _q(spark, ["hoodie with a gun print", "I hate you, idiot", "blue dress", None])
    got = [(r["b"], r["t"]) for r in df.select(*[c.alias(n) for c, n in zip(enrich.moderation(F.col("query")), "bt")]).collect()]
    assert got == [(True, "firearms_weapons"), (True, "toxic_content"), (False, None), (False, None)]


def test_expander(spark):
    r = _q(spark, ["Black dress for girl size 140"]).select(enrich.expand(F.col("query")).alias("e")).first()["e"]
    assert r[0] == "black dress" and len(r) == enrich.NUM_QUERIES and all("girl" not in x for x in r)


def test_expander_gives_exactly_the_number_asked(spark):
    for n in (1, 9, 12, 300):
        e = _q(spark, ["black dress"]).select(enrich.expand(F.col("query"), n).alias("e")).first()["e"]
        assert len(e) == len(set(e)) == n and e[0] == "black dress"


def test_gated_pipeline_keeps_only_block(spark):
    e = enrich.enrich(_q(spark, ["gun", "blue dress"]), "query", gated=True).collect()
    assert json.loads(e[0]["response"]) == {"block": True}
    assert set(json.loads(e[1]["response"])) == {"block", "queries", "group"}


def test_validate_and_parse(spark):
    rows = ['{"block": false, "queries": ["a"], "group": "ladies"}', '{"group": "invalid_group"}',
            '{"block": "x"}', "not json", "[1]", '{"error": "ERROR: boom"}', "{}", ""]
    df = spark.createDataFrame(list(enumerate(rows)), "query_id long, response string")
    got = [r["status"] for r in enrich.validate_outputs(df).orderBy("query_id").collect()]
    assert got == ["ok", "bad_enum", "bad_json", "bad_json", "bad_json", "error", "ok", "bad_json"]
    defaults = enrich.validate_outputs(df).filter(F.col("query_id") == 6).first()
    assert (defaults["block"], defaults["queries"], defaults["group"]) == (False, [], "ladies")


ROUTER = T.StructType([T.StructField("group", T.StringType())])


def test_model_backend_retries(spark):
    calls = []

    def model(texts, feedback):
        calls.append(list(feedback))
        # first answer invalid, the retry (with feedback) valid; "bad" never valid
        return [json.dumps({"group": "ladies"}) if fb and t != "bad" else '{"group": "invalid_group"}'
                for t, fb in zip(texts, feedback)]

    agent = enrich.Agent("router", ROUTER, model, (("group", tuple(enrich.GROUPS)),))
    df = spark.createDataFrame([(1, "dress"), (2, "bad")], "id long, q string").coalesce(1)
    out = {r["id"]: r for r in enrich.run_agent(df, "q", agent, max_retries=3).collect()}
    assert out[1]["router"]["group"] == "ladies" and out[1]["router_error"] is None
    assert out[2]["router"] is None and "must be one of" in out[2]["router_error"]


def test_short_and_failing_answers_are_errors(spark):
    def short(texts, feedback):
        return ['{"group": "men"}']

    def failing(texts, feedback):
        raise RuntimeError("down")

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, q string").coalesce(1)
    once = enrich.run_agent(df, "q", enrich.Agent("m", ROUTER, short), max_retries=0).orderBy("id").collect()
    assert [r["m_error"] for r in once] == [None, "no answer", "no answer"]
    retried = enrich.run_agent(df, "q", enrich.Agent("m", ROUTER, short), max_retries=3).collect()
    assert all(r["m"]["group"] == "men" and r["m_error"] is None for r in retried)
    down = enrich.run_agent(df, "q", enrich.Agent("m", ROUTER, failing), max_retries=1).collect()
    assert all(r["m"] is None and "down" in r["m_error"] for r in down)


def test_gate_asks_only_about_passed_texts_and_fails_open(spark):
    block = T.StructType([T.StructField("block", T.BooleanType())])

    def moderator(texts, feedback):
        return ["?" if t == "odd" else json.dumps({"block": t == "bad"}) for t in texts]

    def router(texts, feedback):
        assert "bad" not in texts
        return ['{"group": "men"}' for _ in texts]

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "odd")], "id long, q string").coalesce(1)
    agents = enrich.Agent("mod", block, moderator), [enrich.Agent("router", ROUTER, router)]
    got = {r["id"]: json.loads(r["response"]) for r in enrich.run_pipeline(df, "q", *agents).collect()}
    assert got == {1: {"block": False, "group": "men"}, 2: {"block": True}, 3: {"group": "men"}}


def test_merge_branches_right_wins(spark):
    base = spark.createDataFrame([(1,), (2,)], "k long")
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k long, v string")
    got = dict((r["k"], r["v"]) for r in enrich.merge_branches(base, "k", a, b).collect())
    assert got == {1: "y", 2: "z"}


def test_evaluate_batch(spark):
    df = spark.createDataFrame([(" blue dress ",), ("",), (None,), ("boom",)], "user_queries string")

    def backend(q):
        if q == "boom":
            raise RuntimeError("model down")
        return '{"block": false, "queries": [], "group": "ladies"}'

    out = enrich.evaluate_batch(df, "user_queries", backend=backend).collect()
    by = {r["query"]: r for r in out}
    assert set(by) == {"blue dress", "boom", "AVERAGE"}
    assert by["boom"]["error"] == "ERROR: model down"
    assert by["blue dress"]["group"] == "ladies" and by["AVERAGE"]["latency_seconds"] >= 0


def test_evaluate_batch_average_matches_rows(spark):
    """Calls run once: the AVERAGE row is the mean of the latencies returned,
    even for a backend whose timing differs on every call."""
    import random

    def backend(q):
        time.sleep(random.random() / 200)
        return '{"block": false, "queries": [], "group": "men"}'

    df = spark.createDataFrame([(f"q{i}",) for i in range(40)], "user_queries string").repartition(4)
    rows = enrich.evaluate_batch(df, "user_queries", backend=backend).collect()
    lat = [r["latency_seconds"] for r in rows if r["query"] != "AVERAGE"]
    avg = [r["latency_seconds"] for r in rows if r["query"] == "AVERAGE"]
    assert len(lat) == 40 and avg == [pytest.approx(sum(lat) / 40, abs=1e-12)]
