"""Spelling variants by finite-state composition (operator 13).

Words are near when one inserted, deleted or replaced code point leads from
one to the other.  The pairs are the paths of *acceptor o one-edit transducer
o acceptor*: the vocabulary is held by minimised acyclic acceptors, one for
each state that the words reach from the initial state, and the composed
machine is walked from its initial state.  Before the edit both acceptors are
in the same state; after it the two must accept the same rest.

Partitions: words of m and m + 1 code points that share their first i and
last j code points form a cell.  One edit leaves at least half of what lies
between unchanged, on its left or on its right, so a cell can always be split
in two kinds of smaller cells without losing a pair.  Splitting begins with
the halves of the words and goes on in every cell of more than ``CELL`` words,
until one code point (two in the longer words) is left open, so a cell is
bounded by the alphabet, whatever the vocabulary.

Defined results: a null text has no words, a null ``doc_id`` counts as an
empty text in the checksum, repeated rows count again, ties go to the smallest
word in code-point order, other columns are ignored, an empty table or one
without frequent words gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import text_of, written

OUTSIDE = "[^A-Za-zÀ-ÿ]+"
#: Words of a cell above which it is split further.
CELL = 512

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- words


def lower_ascii(text: Column) -> Column:
    """Only A-Z lower-cased."""
    return F.when(F.lower(text) == text, text).otherwise(F.translate(text, _UPPER, _LOWER))


def vocabulary(docs: DataFrame, min_chars: int = 6, min_count: int = 5, drop_every: int = 199) -> DataFrame:
    """``word, n``: the letter runs of whole texts, counted over all documents.

    The checksum of ``<doc_id>:<run>`` removes a code point from every run that
    ``drop_every`` divides it for."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.split(text_of(), OUTSIDE)).alias("r")
    ).where(F.length("r") >= min_chars)
    runs = runs.select("d", lower_ascii(F.col("r")).alias("r"))
    h = F.crc32(F.concat("d", F.lit(":"), "r").cast("binary"))
    at = (F.col("h") % F.length("r")).cast("int")
    shorter = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))
    words = runs.select("r", h.alias("h")).select(
        F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("r")).alias("word")
    )
    counted = words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


# ---------------------------------------------------------------- automata


def acceptor(words: Iterable[str]) -> tuple[list[tuple[bool, dict[str, int]]], int]:
    """The minimised acyclic acceptor of sorted, distinct words: its states
    ``(accepting, {symbol: next state})`` and the initial one.

    Words come in order, so whatever the next word does not share with the last
    one is complete and is replaced by an equal state that is there already."""
    numbers: dict[tuple, int] = {}
    growing: list[tuple[list[bool], list[tuple[str, int]]]] = [([False], [])]
    last = ""

    def settle(keep: int) -> None:
        while len(growing) > keep + 1:
            (accepting,), arcs = growing.pop()
            state = numbers.setdefault((accepting, tuple(arcs)), len(numbers))
            growing[-1][1].append((last[len(growing) - 1], state))

    for word in words:
        shared = 0
        for a, b in zip(last, word):
            if a != b:
                break
            shared += 1
        settle(shared)
        growing.extend(([False], []) for _ in word[shared:])
        growing[-1][0][0] = True
        last = word
    settle(0)
    (accepting,), arcs = growing[0]
    first = numbers.setdefault((accepting, tuple(arcs)), len(numbers))
    return [(accepts, dict(arcs)) for accepts, arcs in numbers], first


def _common(states: list, p: int, q: int) -> Iterator[str]:
    """Strings accepted from both states."""
    todo = [(p, q, "")]
    while todo:
        p, q, done = todo.pop()
        (p_accepts, p_arcs), (q_accepts, q_arcs) = states[p], states[q]
        if p_accepts and q_accepts:
            yield done
        for symbol, after in p_arcs.items():
            if symbol in q_arcs:
                todo.append((after, q_arcs[symbol], done + symbol))


def one_edit_pairs(words: list[str], shortest: int) -> set[tuple[str, str]]:
    """Pairs that one edit leads between and whose shorter word has
    ``shortest`` code points: the composed machine walked from its initial
    state.  ``words`` are sorted and distinct."""
    states, first = acceptor(words)
    found = set()
    todo = [(first, "")]
    while todo:
        state, done = todo.pop()
        arcs = list(states[state][1].items())
        for i, (a, after) in enumerate(arcs):
            for b, other in arcs[:i]:  # a replaced by b
                for rest in _common(states, after, other):
                    if len(done) + 1 + len(rest) == shortest:
                        found.add((done + b + rest, done + a + rest))
            for rest in _common(states, state, after):  # a inserted
                if len(done) + len(rest) == shortest:
                    found.add((done + rest, done + a + rest))
            todo.append((after, done + a))
    return found


# ---------------------------------------------------------------- cells


def _halved(rows: DataFrame) -> DataFrame:
    """The two smaller cells of each row's cell."""
    half = F.floor((F.col("m") - F.col("i") - F.col("j")) / 2).cast("int")
    sides = F.array(
        F.struct((F.col("i") + half).alias("i"), F.col("j").alias("j")),
        F.struct(F.col("i").alias("i"), (F.col("j") + half).alias("j")),
    )
    split = rows.select("word", "n", "m", F.explode(sides).alias("side")).select("word", "n", "m", "side.i", "side.j")
    first = F.substring("word", F.lit(1), F.col("i"))
    final = F.substring("word", F.length("word") - F.col("j") + 1, F.col("j"))
    return split.withColumn("shared", F.concat(first, F.lit(" "), final))


CELL_KEY = ["m", "i", "j", "shared"]


def cells(words: DataFrame, limit: int = CELL, min_chars: int = 1) -> DataFrame:
    """``m, i, j, shared, words array<struct<word, n>>``: every cell of at
    least two words; a pair of near words (of ``min_chars`` code points or
    more) meets in one at least."""
    size = F.length("word")
    as_either = F.array(size, size - 1)
    rows = words.select("word", "n", F.explode(as_either).alias("m")).where(F.col("m") >= min_chars)
    rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    settled = None
    while True:
        rows = _halved(rows)
        counts = rows.groupBy(*CELL_KEY).agg(F.count(F.lit(1)).alias("c"))
        # `counts` is read twice: which cells go on, and whether any does
        crowded = written(counts.where((F.col("c") > limit) & (F.col("m") - F.col("i") - F.col("j") > 1)), "spelling-crowded")
        keep = rows.join(crowded, CELL_KEY, "left_anti")
        settled = keep if settled is None else settled.unionByName(keep)
        if crowded.isEmpty():
            break
        rows = written(rows.join(crowded, CELL_KEY, "left_semi"), "spelling-split")
    return (
        settled.groupBy(*CELL_KEY)
        .agg(F.sort_array(F.collect_set(F.struct("word", "n"))).alias("words"))
        .where(F.size("words") > 1)
    )


def _pairs_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for m, i, j, members in zip(*(batch.column(c).to_pylist() for c in ("m", "i", "j", "words"))):
            counts = {w["word"][i : len(w["word"]) - j]: (w["word"], w["n"]) for w in members}
            for a, b in one_edit_pairs(sorted(counts), m - i - j):
                for one, other in ((a, b), (b, a)):
                    out[0].append(counts[one][0])
                    out[1].append(counts[other][0])
                    out[2].append(counts[other][1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())],
            names=["word", "near", "near_n"],
        )


def near_words(words: DataFrame, limit: int = CELL, min_chars: int = 1) -> DataFrame:
    """``word, near, near_n``: every pair of near words, in both directions."""
    found = cells(words, limit, min_chars).mapInArrow(_pairs_of_cells, "word string, near string, near_n long")
    return found.dropDuplicates(["word", "near"])


# ---------------------------------------------------------------- forms and roots


def follow(links: DataFrame) -> DataFrame:
    """``word, root``: ``links`` (word, form) followed to the last form.  Every
    round doubles the steps taken, so there are about log2 of the longest chain."""
    at = written(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(at.join(onward, "root", "left").select("word", "root", "further"), "spelling-roots")
        if step.where("further is not null").isEmpty():
            return at
        at = step.select("word", F.coalesce("further", "root").alias("root"))


def spelling_variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5, drop_every: int = 199) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every frequent word: its
    near word of largest count is its form if that count is ``ratio`` times its
    own, and the root is the last form that following forms leads to."""
    words = written(vocabulary(docs, min_chars, min_count, drop_every), "spelling-words")
    best = near_words(words, min_chars=min_chars).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    )
    told = words.join(best, "word", "left")
    has_form = -F.col("best.order") >= ratio * F.col("n")
    told = written(
        told.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.order")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = follow(told.where("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
