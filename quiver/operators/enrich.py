"""Query enrichment over a table of user queries.

The reference asks a language model three questions per query – moderate
(``block``), expand (``queries``) and route (``group``) – checks each answer
against a schema, retries, and merges the three records.  Here every operator
has two backends behind one signature:

* **rules** (default): a fixed, documented rule set written as Catalyst
  expressions – regex matches on the lower-cased text – so the work stays in
  whole-stage codegen and is checkable by SQL;
* **model**: a user batch callable run by ``mapInPandas``
  (:func:`run_agent`), with per-row schema validation, bounded retries with
  feedback, schema defaults, and an ``error`` column instead of a failed job.

The rule set is data (patterns, bands, facets).  A model pipeline
(:func:`run_pipeline`) asks a moderator first and the other agents only about
the texts it lets through; a moderator that fails lets a text through.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import combinations
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.text import parse_json, raw_response, strip
from quiver.operators.labels import GROUPS

# ----------------------------------------------------------------- rule data
# The twelve prohibited topics of the moderator, each with a
# small lexicon of our own (the reference leaves the judgement to a model).
MODERATION_LEXICON: list[tuple[str, list[str]]] = [
    ("sexual_content", ["porn", "xxx", "nude", "nudes", "sex"]),
    ("hate_speech", ["nazi", "racist", "supremacist"]),
    ("harassment_bullying", ["bully", "harass", "stalk"]),
    ("dangerous_content", ["explosive", "explosives", "bomb", "poison"]),
    ("toxic_content", ["hate you", "shut up"]),
    ("derogatory_content", ["subhuman", "retard"]),
    ("violent_content", ["kill", "murder", "gore"]),
    ("insults", ["idiot", "stupid", "moron", "loser"]),
    ("profanity", ["fuck", "shit", "damn"]),
    ("illegal", ["counterfeit", "malware", "fraud", "stolen"]),
    ("death_harm_tragedy", ["suicide", "self harm", "corpse"]),
    ("firearms_weapons", ["gun", "guns", "rifle", "pistol", "ammo", "knife"]),
]

# Routing patterns (on lower-cased text) and size/age bands.
BOY = r"\b(?:boy|boys|son|sons)\b"
GIRL = r"\b(?:girl|girls|daughter|daughters)\b"
KIDS = r"\b(?:kid|kids|child|children|baby|babies|toddler|toddlers|newborn|newborns|infant|teen|teens|teenager)\b"
MEN = r"\b(?:men|man|mens|male|gentleman|gentlemen|husband|boyfriend)\b"
SIZE = r"\bsize ([0-9]{2,3})\b"
AGE = r"\b([0-9]{1,2}) ?(?:years?|yrs?)\b"
BABY = r"\b(?:baby|babies|newborn|newborns|infant|toddler|toddlers)\b"
TEEN = r"\b(?:teen|teens|teenager)\b"
SIZE_BANDS = [(92, "50_98"), (134, "92_140")]  # size < bound -> band, else 134_170
AGE_BANDS = [(3, "50_98"), (10, "92_140")]  # age < bound -> band, else 134_170
TOP_BAND = "134_170"
DEFAULT_GROUP = "ladies"

# Words removed by the expander (age, size, section) and the
# facets appended to the cleaned query.
STRIP_PATTERNS = [
    SIZE,
    AGE + r"(?: old)?",
    r"\b(?:for )?(?:a |an |my |the )?(?:boys?|girls?|sons?|daughters?|kids?|child|children|"
    r"men|man|mens|women|woman|womens|ladies|lady|teens?|newborn|baby|toddler)\b",
]
FACETS = ["casual", "formal", "cotton", "patterned", "oversized", "slim fit", "knitted", "denim"]
NUM_QUERIES = 6

OUTPUT_SCHEMA = T.StructType([
    T.StructField("block", T.BooleanType()),
    T.StructField("queries", T.ArrayType(T.StringType())),
    T.StructField("group", T.StringType()),
    T.StructField("error", T.StringType()),
])


def _topic_pattern(terms: list[str]) -> str:
    return r"\b(?:" + "|".join(re.escape(t) for t in terms) + r")\b"


# ----------------------------------------------------------------- Catalyst form


def _lower(text: Column) -> Column:
    return F.lower(text)


def moderation(text: Column) -> tuple[Column, Column]:
    """(block, first matching topic).  NULL text is not blocked.

    One combined pattern decides ``block``; the per-topic patterns run only
    for the (few) blocked rows to name the first matching topic."""
    q = _lower(text)
    any_term = _topic_pattern([t for _, terms in MODERATION_LEXICON for t in terms])
    block = F.coalesce(q.rlike(any_term), F.lit(False))
    topic = None
    for name, terms in MODERATION_LEXICON:
        cond = q.rlike(_topic_pattern(terms))
        topic = F.when(cond, F.lit(name)) if topic is None else topic.when(cond, F.lit(name))
    return block, F.when(block, topic)


def _band(value: Column, bands: list[tuple[int, str]]) -> Column:
    out = None
    for bound, band in bands:
        cond = value < bound
        out = F.when(cond, F.lit(band)) if out is None else out.when(cond, F.lit(band))
    return F.when(value.isNotNull(), out.otherwise(F.lit(TOP_BAND)))


def route(text: Column) -> Column:
    """One of the eight product groups."""
    q = _lower(text)
    size = F.regexp_extract(q, SIZE, 1).try_cast("int")
    age = F.regexp_extract(q, AGE, 1).try_cast("int")
    word_band = F.when(q.rlike(BABY), F.lit("50_98")).when(q.rlike(TEEN), F.lit(TOP_BAND))
    band = F.coalesce(_band(size, SIZE_BANDS), _band(age, AGE_BANDS), word_band)
    gender = F.when(q.rlike(BOY), F.lit("boy")).when(q.rlike(GIRL), F.lit("girl")).when(
        q.rlike(KIDS), F.lit("girl")
    )
    child = F.concat(gender, F.lit("_"), F.coalesce(band, F.lit("92_140")))
    return (
        F.when(q.isNull(), F.lit(DEFAULT_GROUP))
        .when(gender.isNotNull(), child)
        .when(q.rlike(MEN), F.lit("men"))
        .otherwise(F.lit(DEFAULT_GROUP))
    )


def facet_texts(count: int) -> list[str]:
    """The first ``count`` facet variations: single facets, then pairs and so
    on; when all combinations are used up they come again with a number."""
    combined = [" ".join(c) for size in range(1, len(FACETS) + 1) for c in combinations(FACETS, size)]
    return [combined[i % len(combined)] + (f" {i // len(combined) + 1}" if i >= len(combined) else "") for i in range(count)]


def expand(text: Column, num_queries: int = NUM_QUERIES) -> Column:
    """The cleaned query first, then facet variations: exactly
    ``num_queries`` queries, none for a text that is empty after cleaning."""
    base = _lower(text)
    for p in STRIP_PATTERNS:
        base = F.regexp_replace(base, p, " ")
    base = strip(F.regexp_replace(base, r"\s+", " "))
    # Plain expressions (no lambda): codegen evaluates ``base`` once per row.
    variants = [F.concat(base, F.lit(" " + f)) for f in facet_texts(max(num_queries - 1, 0))]
    full = F.array(base, *variants)
    return F.when(base.isNull() | (base == ""), F.array().cast("array<string>")).otherwise(
        F.slice(full, 1, num_queries)
    )


def is_group(col: Column) -> Column:
    return col.isin(*GROUPS)


def enrich(df: DataFrame, text_col: str, gated: bool = False, num_queries: int = NUM_QUERIES) -> DataFrame:
    """Add ``block, topic, queries, group, response``.

    ``gated=False`` (parallel): all three answers for every query.
    ``gated=True``: a blocked query keeps only the moderator answer; the
    merged response then holds ``block`` alone.
    """
    text = F.col(text_col)
    block, topic = moderation(text)
    out = df.withColumns({"block": block, "topic": topic})
    keep = ~F.col("block") if gated else F.lit(True)
    out = out.withColumns({
        "queries": F.when(keep, expand(text, num_queries)),
        "group": F.when(keep, route(text)),
    })
    return out.withColumn("response", F.to_json(F.struct("block", "queries", "group")))


def clean_queries(df: DataFrame, text_col: str, out_col: str = "query") -> DataFrame:
    """Stripped text, blank and NULL rows dropped."""
    return df.withColumn(out_col, strip(F.col(text_col))).filter(
        F.col(out_col).isNotNull() & (F.col(out_col) != "")
    )


def parse_response(df: DataFrame, col: str = "response") -> DataFrame:
    """``block, queries, group, error, raw_response`` from a JSON answer,
    and ``other map<string, string>``: the keys the schema doesn't declare, with
    their values (nested ones as JSON text); NULL when there are none."""
    parsed = parse_json(F.col(col), OUTPUT_SCHEMA)
    every = F.from_json(F.col(col), "map<string, string>")
    undeclared = F.map_filter(every, lambda key, _: ~key.isin(OUTPUT_SCHEMA.fieldNames()))
    is_object = raw_response(F.col(col), F.col("_p")).isNull()
    return df.withColumn("_p", parsed).withColumns({
        "other": F.when(is_object & (F.size(undeclared) > 0), undeclared),
        "block": F.col("_p.block"),
        "queries": F.col("_p.queries"),
        "group": F.col("_p.group"),
        "error": F.col("_p.error"),
        "raw_response": raw_response(F.col(col), F.col("_p")),
    }).drop("_p")


def validate_outputs(df: DataFrame, col: str = "response") -> DataFrame:
    """Schema check of a model answer.  ``status`` is ``ok``,
    ``bad_json`` (syntax, non-object, wrong type), ``error`` (the call
    failed) or ``bad_enum`` (group outside the eight).  Absent fields take
    the schema defaults (block false, queries empty, group ladies)."""
    p = parse_response(df, col)
    status = (
        F.when(F.col("raw_response").isNotNull() | F.col(col).isNull(), F.lit("bad_json"))
        .when(F.col("error").isNotNull(), F.lit("error"))
        .when(F.col("group").isNotNull() & ~is_group(F.col("group")), F.lit("bad_enum"))
        .otherwise(F.lit("ok"))
    )
    ok = status == "ok"
    return p.withColumns({
        "status": status,
        "block": F.when(ok, F.coalesce("block", F.lit(False))),
        "queries": F.when(ok, F.coalesce("queries", F.array().cast("array<string>"))),
        "group": F.when(ok, F.coalesce("group", F.lit(DEFAULT_GROUP))),
    })


def merge_branches(base: DataFrame, key: str, *branches: DataFrame) -> DataFrame:
    """Left-join separately produced branch tables on ``key``; a column
    present in several branches takes the right-most non-missing value; a
    missing branch row leaves its columns NULL (the reference logs and goes on)."""
    out = base
    for i, br in enumerate(branches):
        cols = [c for c in br.columns if c != key]
        renamed = br.select(key, *[F.col(c).alias(f"_b{i}_{c}") for c in cols])
        out = out.join(renamed, on=key, how="left")
        for c in cols:
            if c in out.columns:
                out = out.withColumn(c, F.coalesce(F.col(f"_b{i}_{c}"), F.col(c)))
            else:
                out = out.withColumnRenamed(f"_b{i}_{c}", c)
        out = out.drop(*[f"_b{i}_{c}" for c in cols if f"_b{i}_{c}" in out.columns])
    return out


# ----------------------------------------------------------------- model backend


@dataclass(frozen=True)
class Agent:
    """An answering function with its instruction, output schema and enum rules.

    ``call(prompts, feedback)`` gets a list of prompts (the instruction
    template with ``{query}`` filled in; the text itself without one) and, on
    retry, why the last answer was refused; it returns one JSON text per
    prompt.  ``output_key`` names the column of the answers, ``defaults`` the
    values of fields that an answer leaves out.
    """

    name: str
    schema: T.StructType
    call: Callable[[list[str], list[str | None]], list[str]]
    enums: tuple[tuple[str, tuple[str, ...]], ...] = ()
    instruction: str | None = None
    output_key: str | None = None
    defaults: tuple[tuple[str, Any], ...] = ()

    @property
    def column(self) -> str:
        return self.output_key or self.name

    def prompt(self, text: str) -> str:
        return text if self.instruction is None else self.instruction.replace("{query}", text)


def _check(answer: str | None, agent: Agent) -> tuple[dict | None, str | None]:
    if answer is None:
        return None, "no answer"
    try:
        obj = json.loads(answer)
    except (TypeError, ValueError) as exc:
        return None, f"invalid JSON: {exc}"
    if not isinstance(obj, dict):
        return None, "answer is not a JSON object"
    for field in agent.schema.fields:
        v = obj.get(field.name)
        if v is None:
            continue
        dt = field.dataType
        if isinstance(dt, T.BooleanType) and not isinstance(v, bool):
            return None, f"{field.name} must be a boolean"
        if isinstance(dt, T.StringType) and not isinstance(v, str):
            return None, f"{field.name} must be a string"
        if isinstance(dt, T.ArrayType) and not (isinstance(v, list) and all(isinstance(x, str) for x in v)):
            return None, f"{field.name} must be a list of strings"
    for field, allowed in agent.enums:
        if obj.get(field) is not None and obj[field] not in allowed:
            return None, f"{field} must be one of {list(allowed)}"
    defaults = dict(agent.defaults)
    values = {f.name: obj.get(f.name) for f in agent.schema.fields}
    return {k: defaults.get(k) if v is None else v for k, v in values.items()}, None


def _ask(agent: Agent, prompts: list[str], feedback: list[str | None]) -> list[tuple[str | None, str | None]]:
    """One (answer, error) per prompt: a call that fails or answers fewer
    prompts than asked leaves the rest without an answer."""
    try:
        answers = list(agent.call(prompts, feedback))
    except Exception as exc:  # noqa: BLE001 – recorded per row
        return [(None, f"call failed: {exc}")] * len(prompts)
    if len(answers) > len(prompts):
        return [(None, f"{len(answers)} answers to {len(prompts)} prompts")] * len(prompts)
    return [(a, None) for a in answers] + [(None, "no answer")] * (len(prompts) - len(answers))


def run_agent(df: DataFrame, text_col: str, agent: Agent, max_retries: int = 3) -> DataFrame:
    """E4 with a model backend: answer, validate, retry with feedback.

    Runs in ``mapInPandas``; only rows without a valid answer are re-asked (at
    most ``max_retries`` times, so ``max_retries + 1`` attempts); rows still
    invalid get ``<column>_error`` instead of failing the job.  A model call is
    not repeatable, so materialise the result (write or checkpoint) before
    using it twice.
    """
    out_struct = T.StructType([T.StructField(f.name, f.dataType) for f in agent.schema.fields])
    schema = T.StructType(
        list(df.schema.fields)
        + [T.StructField(agent.column, out_struct), T.StructField(f"{agent.column}_error", T.StringType())]
    )

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text_col].astype(object).where(pdf[text_col].notna(), "").tolist()
            results: list[dict | None] = [None] * len(texts)
            errors: list[str | None] = [None] * len(texts)
            todo = list(range(len(texts)))
            feedback: list[str | None] = [None] * len(texts)
            for _ in range(max_retries + 1):
                if not todo:
                    break
                answers = _ask(agent, [agent.prompt(texts[i]) for i in todo], [feedback[i] for i in todo])
                again = []
                for i, (ans, failed) in zip(todo, answers, strict=True):
                    obj, err = (None, failed) if failed else _check(ans, agent)
                    results[i], errors[i] = obj, err
                    if err is not None:
                        feedback[i] = f"The answer was refused ({err}); answer again in the asked format."
                        again.append(i)
                todo = again
            pdf = pdf.copy()
            pdf[agent.column] = results
            pdf[f"{agent.column}_error"] = errors
            yield pdf

    return df.mapInPandas(fn, schema)


def run_pipeline(df: DataFrame, text_col: str, moderator: Agent, others: list[Agent], gated: bool = True,
                 max_retries: int = 3) -> DataFrame:
    """E5/E6 with model backends: the moderator's answer, then the other
    agents' and their merged ``response``.

    ``gated``: agents are asked only about texts that the moderator doesn't
    block; one that it could not answer for passes (the gate fails open).  The
    moderator's answers are checkpointed, so each text is asked once.
    """
    judged = run_agent(df, text_col, moderator, max_retries)
    if not gated:
        out = judged
        for agent in others:
            out = run_agent(out, text_col, agent, max_retries)
        return _merged(out, [moderator, *others])
    judged = judged.checkpoint(eager=True)
    blocked = F.coalesce(F.col(f"{moderator.column}.block"), F.lit(False))
    passed = judged.filter(~blocked)
    for agent in others:
        passed = run_agent(passed, text_col, agent, max_retries)
    return _merged(passed.unionByName(judged.filter(blocked), allowMissingColumns=True), [moderator, *others])


def _merged(df: DataFrame, agents: list[Agent]) -> DataFrame:
    """``response``: the agents' fields as one JSON object (absent ones left out)."""
    fields = [F.col(f"{a.column}.{f.name}").alias(f.name) for a in agents for f in a.schema.fields]
    return df.withColumn("response", F.to_json(F.struct(*fields)))


def run_ids(key: Column, run: str) -> dict[str, Column]:
    """``user_id`` and ``session_id`` of an evaluation run, one fresh pair
    per query: version-4-shaped ids made from the run's name and the query's
    key, so a repeated task names the same session."""

    def uuid(kind: str) -> Column:
        h = F.md5(F.concat_ws("-", F.lit(run), F.lit(kind), key.cast("string")))
        cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
        return F.concat_ws("-", *[F.substring(h, at, size) for at, size in cuts])

    return {"user_id": F.concat(F.lit("eval-user-"), uuid("user")), "session_id": uuid("session")}


def evaluate_batch(df: DataFrame, text_col: str,
                   backend: Callable[[str], str] | None = None,
                   concurrency: int = 4, id_col: str | None = None, run: str = "evaluation") -> DataFrame:
    """Clean -> answer each query (timed) -> parse -> errors -> AVERAGE row.

    ``backend(query) -> JSON text`` is called on a bounded thread pool per task
    and timed; a failing call becomes ``{"error": "ERROR: ..."}``.  Without a
    backend the rules answer as columns of the same plan; no call is made, so
    there is no latency to report and it is 0.  With ``id_col`` every query
    runs as its own user and session (:func:`run_ids`), and a ``backend`` is
    called with ``(query, user_id, session_id)``.
    """
    from quiver.operators.stats import with_average_row

    cleaned = clean_queries(df, text_col)
    ids = run_ids(F.col(id_col), run) if id_col else {}
    called_with = ["query", *ids]
    kept = ([id_col] if id_col else []) + list(ids)
    cleaned = cleaned.withColumns(ids).select("query", *kept) if ids else cleaned.select("query")
    if backend is None:
        answered = enrich(cleaned, "query").select("query", *kept, F.lit(0.0).alias("latency_seconds"), "response")
        return with_average_row(parse_response(answered).drop("response"))
    schema = T.StructType([
        *cleaned.schema.fields,
        T.StructField("latency_seconds", T.DoubleType()),
        T.StructField("response", T.StringType()),
    ])

    def timed(args: tuple) -> tuple[float, str]:
        t0 = time.perf_counter()
        try:
            ans = backend(*args)
        except Exception as exc:  # noqa: BLE001 – recorded per row like the reference
            ans = json.dumps({"error": f"ERROR: {exc}"})
        return time.perf_counter() - t0, ans

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for pdf in batches:
                res = list(pool.map(timed, pdf[called_with].itertuples(index=False, name=None)))
                yield pdf.assign(latency_seconds=[r[0] for r in res], response=[r[1] for r in res])

    # The answers feed both the rows and the AVERAGE row: write them once to
    # the shared checkpoint folder so the calls (timed, maybe not repeatable)
    # run once and the average describes exactly the rows returned.
    answered = cleaned.mapInPandas(fn, schema).checkpoint(eager=True)
    parsed = parse_response(answered).drop("response")
    return with_average_row(parsed)
