"""Toxicity by a weighted finite-state pattern grammar (operator 3).

A clause is read as a string of word classes (insult, threat, target,
negation, report, other).  Small weighted transducers rewrite it: negation
weakens the insults that follow it closely, a report weakens what it quotes, a
target strengthens insults and turns a threat into an attack.  They are
composed once into a single machine; a matched clause adds its weights.  A
threat scores only as an attack on a target.  An insult scores without a target
too, though less: half of the labelled toxic texts with an insult have no target
in its clause (figures in the README).

The word lists below seed the grammar; further insults and their weights are
learned from labelled training rows.  Evidence for a word is the number of
independent contexts (neighbours that differ on both sides) it has in toxic
texts, so the words of a text with many near copies don't count as insults.
A logistic curve, fitted on the same bounded sample, calibrates the score.

Defined results: a null or empty text gets the score of a text without any
match; a null id is held out; repeated rows are scored separately; extra
columns are ignored; without labels the seed grammar is used with a fixed
curve; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm import logistic
from quiver.llm.common import held_out, keeps_columns, text_of, training_ids, written

#: Labelled rows that the lexicon and the curve are fitted on, at most.
TRAINING_ROWS = 20_000
#: Learned insults, at most.
LEXICON_TERMS = 2_000
MIN_CONTEXTS = 4

# Seed words of the grammar (English, German, French, Spanish).
INSULTS = """idiot moron scum trash loser stupid pathetic worthless disgusting clown vermin filth
    abschaum trottel dummkopf arschloch imbécile connard ordure imbécil basura escoria""".split()
THREATS = "kill hurt destroy beat stab töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = """you your he she they them him her people du dich dein ihr euch sie er tu toi vous il elle ils
    tú usted ustedes él ella ellos""".split()
NEGATIONS = "not no never isn aren nobody nicht kein keine nie ne pas jamais nunca jamás tampoco".split()
REPORTS = """said says called calls wrote reported quoted claims sagte sagt nannte schrieb dit disait appelé
    écrit dijo dice llamó escribió""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, WEAK, ATTACK = range(8)
_CLAUSE = re.compile(r"[.!?;\n]+")
_WORDS = re.compile(r"\w+")


@dataclass
class Transducer:
    """Weighted transitions ``(state, class) -> (state, class, log weight)``;
    a missing one stays in its state and copies the class at weight 0."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds what ``first`` writes to ``second``."""
    out = Transducer(first.states * second.states)
    for a in range(first.states):
        for b in range(second.states):
            for symbol in range(8):
                to_a, written_symbol, weight_a = first.step(a, symbol)
                to_b, last, weight_b = second.step(b, written_symbol)
                out.arcs[a * second.states + b, symbol] = (to_a * second.states + to_b, last, weight_a + weight_b)
    return out


def negation(reach: int = 3) -> Transducer:
    """Insults up to ``reach`` words after a negation are weak ones."""
    t = Transducer(reach + 1)
    for state in range(reach + 1):
        for symbol in (OTHER, TARGET, REPORT, INSULT, THREAT):
            t.arcs[state, symbol] = (max(0, state - 1), symbol, 0.0)
        t.arcs[state, NEGATION] = (reach, NEGATION, 0.0)
        if state:
            t.arcs[state, INSULT] = (state - 1, WEAK, math.log(0.5))
            t.arcs[state, THREAT] = (state - 1, OTHER, 0.0)
    return t


def reported() -> Transducer:
    """After a report, the rest of the clause counts less."""
    t = Transducer(2, {(0, REPORT): (1, REPORT, 0.0)})
    for symbol in (INSULT, WEAK, THREAT):
        t.arcs[1, symbol] = (1, symbol, math.log(0.7))
    return t


def targeted() -> Transducer:
    """After a target, insults count more and a threat becomes an attack;
    a threat without a target is no match."""
    t = Transducer(2, {(0, TARGET): (1, TARGET, 0.0), (0, THREAT): (0, OTHER, 0.0)})
    t.arcs[1, INSULT] = (1, INSULT, math.log(1.5))
    t.arcs[1, THREAT] = (1, ATTACK, 0.0)
    return t


def grammar() -> Transducer:
    return compose(compose(negation(), reported()), targeted())


class Matcher:
    """Scores texts with the composed grammar and a weighted lexicon."""

    def __init__(self, insults: dict[str, float]):
        self.machine = grammar()
        self.classes = {w: (OTHER, 0.0) for w in insults}
        for words, symbol in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)):
            self.classes |= {w: (symbol, 1.0) for w in words}
        self.classes |= {w: (INSULT, weight) for w, weight in insults.items()}
        self.triggers = ahocorasick.Automaton()
        for w in [*insults, *THREATS]:
            self.triggers.add_word(w, len(w))
        self.triggers.make_automaton()

    def _triggered(self, text: str) -> bool:
        """Whether a trigger stands in the lower-case text as a word."""
        for end, n in self.triggers.iter(text):
            before, after = text[end - n : end - n + 1] if end >= n else " ", text[end + 1 : end + 2]
            if not (before.isalnum() or before == "_" or after.isalnum() or after == "_"):
                return True
        return False

    def clause(self, words: Iterable[str]) -> float:
        state, total = 0, 0.0
        for word in words:
            symbol, weight = self.classes.get(word, (OTHER, 0.0))
            state, symbol, log_weight = self.machine.step(state, symbol)
            if symbol in (INSULT, WEAK, ATTACK):
                total += weight * math.exp(log_weight)
        return total

    def score(self, text: str) -> tuple[float, float]:
        """The sum over matched clauses and the largest of one."""
        text = text.lower()
        if not self._triggered(text):
            return 0.0, 0.0
        scores = [self.clause(_WORDS.findall(c)) for c in _CLAUSE.split(text)]
        return sum(scores), max(scores, default=0.0)


def learned_insults(rows: DataFrame, weight_cap: float = 6.0) -> dict[str, float]:
    """Words of toxic texts and their weights, from ``rows`` (``text``, ``label``).

    A word counts once per pair of neighbours, pairs that share a neighbour
    once; it is kept if its share of toxic contexts is beyond chance over all
    words tried (Chernoff bound).
    """
    words = F.filter(F.split(F.lower(text_of()), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    tokens = (
        rows.select("label", words.alias("w"))
        .select(
            "label",
            F.explode(
                F.arrays_zip(
                    F.col("w").alias("word"),
                    F.concat(F.array(F.lit("")), F.col("w")).alias("before"),
                    F.concat(F.expr("slice(w, 2, greatest(0, size(w) - 1))"), F.array(F.lit(""))).alias("after"),
                )
            ).alias("t"),
        )
        .select("label", "t.*")
        .where("word is not null")
    )
    toxic = tokens.where("label = 1")
    contexts = toxic.groupBy("word", "before").agg(F.min("after").alias("after"))
    contexts = contexts.groupBy("word").agg(F.countDistinct("after").alias("k"))
    counts = tokens.groupBy("word").agg(
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("m"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("toxic"),
    )
    counts = written(counts, "toxic-words")
    totals = counts.agg(F.count(F.lit(1)), F.sum("toxic"), F.sum("m")).first()
    tried, n_toxic, n_clean = totals[0], totals[1] or 0, totals[2] or 0
    if not n_toxic or not n_clean:
        return {}
    base = n_toxic / (n_toxic + n_clean)
    share = F.col("k") / (F.col("k") + F.col("m"))
    clean = 1 - share
    evidence = (F.col("k") + F.col("m")) * (
        share * F.log(share / base) + F.when(clean > 0, clean * F.log(clean / (1 - base))).otherwise(0.0)
    )
    kept = (
        contexts.where(F.col("k") >= MIN_CONTEXTS)
        .join(counts, "word")
        .where((share > 0.8) & (evidence > math.log(tried / 0.01)))
        .select("word", "k", "m")
        .orderBy(F.desc("k"), "word")
        .limit(LEXICON_TERMS)
        .collect()
    )
    odds = n_clean / n_toxic
    return {r.word: min(weight_cap, math.log((r.k + 0.5) / (r.m + 0.5) * odds)) for r in kept}


def clause_scores(docs: DataFrame, insults: dict[str, float]) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, any ``keep`` columns) with ``total`` and
    ``largest`` instead of the text."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(insults)
        for batch in batches:
            found = [matcher.score(t.as_py() or "") for t in batch.column("text")]
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array([x[k] for x in found], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in kept], "total", "largest"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["total double", "largest double"])
    return docs.mapInArrow(score, schema)


#: Curve used without labels: a text without a match is clean, one targeted insult isn't.
DEFAULT_CURVE = np.array([1.5, 0.0, -2.0])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and curve from at most ``limit`` labelled rows outside the held-out fold."""
    ids = F.broadcast(training_ids(labels, "toxic", limit))  # at most limit rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id").select("text", "label")
    insults = {w: 2.0 for w in INSULTS} | learned_insults(rows)
    fitted = clause_scores(rows, insults).toPandas()
    if fitted.empty:
        return insults, DEFAULT_CURVE
    curve = logistic.fit(_features(fitted["total"].to_numpy(), fitted["largest"].to_numpy()), fitted["label"].to_numpy())
    return insults, curve


def _features(total: np.ndarray, largest: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(total), np.minimum(largest, 1.0)])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = TRAINING_ROWS) -> DataFrame:
    """Per document ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    insults, curve = train(docs, labels, limit)
    scored = clause_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), insults)
    a, b, c = (float(x) for x in curve)
    line = a * F.log1p("total") + b * F.least(F.col("largest"), F.lit(1.0)) + c
    score = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


@keeps_columns
def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` (all columns) without the rows scored at ``threshold`` or more.

    The score is added to each row where it stands: no join, no shuffle.
    """
    insults, curve = train(docs, labels, limit)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(insults)
        for batch in batches:
            found = np.array([matcher.score(t.as_py() or "") for t in batch.column("text")]).reshape(-1, 2)
            clean = logistic.predict(curve, _features(found[:, 0], found[:, 1])) < threshold
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
