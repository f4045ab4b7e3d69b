"""Phrase collocations by best-first branch and bound (operator 11).

Phrases grow word by word.  A phrase *p* with prefix counts known bounds every
phrase *q* that it grows to: ``f(q) <= f(p)``, and for each cut inside *p* the
right part is at least as frequent as *q* itself, so

    score(q) <= floor(scale * f(p) / (f(left part) + f(p)))        (admissible)

The frontier of a language holds its phrases by that bound.  It is expanded
best first, all phrases above a floor at a time: a round counts, in one scan
of the texts each for three and for four words, the phrases that continue one
above the floor, and those that end in one (they decide whether it survives).
Every phrase that scores at least the floor is then known, and so is which of
them survive.  A language is settled once ``limit`` survivors reach its floor;
all that tie with the last of them do too.  The floor of the others is lowered
and their frontier expanded further, down to zero if need be.

Counting: a task cuts its texts into words on whole buffers and combines equal
phrases before the shuffle, which then carries the phrases themselves, so
counts are exact.  Which phrases may be counted is told to the tasks by bit
sets of a fixed size (``FILTER_BITS``).  They only save work: an unset bit
proves that a phrase isn't in the set, a wrongly set one lets a phrase be
counted for nothing.

A phrase that lies in a longer candidate also lies in one that is just one
word longer and at least as frequent, so survival needs the neighbours of one
word only.

Defined results: a null text is empty, a null ``lang`` is ``und`` (together
with rows that say so), ``doc_id`` plays no part, repeated rows count again,
ties go by count and by the phrase's bytes, other columns are ignored, an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.common import text_of, written
from quiver.llm.tokens import PrefixHash, mix, text_slices

#: Bits of a set of phrases that tasks consult (2 MiB), whatever its number of members.
FILTER_BITS = 1 << 24
#: Bytes of text that a task cuts into words at a time.
SLICE_BYTES = 1 << 19
#: Phrases per result row that the first floor aims at.
AHEAD = 4
LONGEST = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK, _BLANK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK[[0x20, 0x09]] = True

Wanted = Callable[[Callable[[int, int], np.ndarray]], np.ndarray]


# ---------------------------------------------------------------- counting


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts, each followed by one blank: that buffer, the
    start of every word in it (and the end of the last), the piece it is in
    and the text."""
    data = _LOWER[data]
    solid = ~(_BREAK[data] | _BLANK[data])
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(_BREAK[data])[starts] + text  # a text's end ends a piece too
    place = np.concatenate([[0], np.cumsum(stops - starts + 1)])
    if not len(starts):
        return np.zeros(0, np.uint8), place, piece, text
    source = np.arange(place[-1]) + np.repeat(starts - place[:-1], np.diff(place))
    packed = data[np.minimum(source, len(data) - 1)]
    packed[place[1:] - 1] = 0x20
    return packed, place, piece, text


def _lang_keys(langs: pa.Array) -> np.ndarray:
    """A 64-bit number per language, the same in every task."""
    coded = langs.dictionary_encode()
    keys = [(zlib.crc32(v.encode()) << 32) | zlib.adler32(v.encode()) for v in coded.dictionary.to_pylist()]
    return np.array(keys, dtype=np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]


def _is_set(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


class Phrases:
    """The words of a slice of texts and the phrases in it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang_keys: np.ndarray):
        self.packed, self.place, self.piece, text = _cut(data, offsets)
        self.lang = lang_keys[text]
        self.text = text
        self.hash = PrefixHash(self.packed, seed=11)

    def starts(self, k: int) -> np.ndarray:
        """Numbers of the words that begin a phrase of k words."""
        n = len(self.piece) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def cells(self, first: np.ndarray, k: int) -> np.ndarray:
        """Number of the bit of the k words from each ``first``."""
        h = self.hash.of(self.place[first], self.place[first + k] - 1)
        return (mix(h ^ self.lang[first], 3) % np.uint64(FILTER_BITS)).astype(np.int64)

    def strings(self, first: np.ndarray, k: int) -> pa.Array:
        starts, stops = self.place[first], self.place[first + k] - 1
        ends = np.concatenate([[0], np.cumsum(stops - starts)])
        source = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], np.diff(ends))
        buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.packed[source])]
        return pa.Array.from_buffers(pa.large_string(), len(first), buffers).cast(pa.string())


def _phrase_counter(k: int, wanted: Callable[[Phrases, np.ndarray], np.ndarray]):
    """Task: phrases of k words that are wanted, combined per slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _lang_keys(batch.column("lang")) if batch.num_rows else None
            for row, data, offsets in text_slices(batch.column("text"), SLICE_BYTES):
                slice_ = Phrases(data, offsets, keys[row : row + len(offsets) - 1])
                first = slice_.starts(k)
                first = first[wanted(slice_, first)] if len(first) else first
                if not len(first):
                    continue
                found = pa.table({
                    "lang": batch.column("lang").take(pa.array(row + slice_.text[first])),
                    "phrase": slice_.strings(first, k),
                }).group_by(["lang", "phrase"]).aggregate([([], "count_all")])
                yield from found.rename_columns(["lang", "phrase", "f"]).to_batches()

    return count


def _count(texts: DataFrame, k: int, wanted, name: str, least: int) -> DataFrame:
    """``lang, phrase, f`` of the wanted phrases of k words that occur ``least`` times."""
    found = texts.mapInArrow(_phrase_counter(k, wanted), "lang string, phrase string, f long")
    counted = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return written(counted, f"phrases-{name}")


def _bits(phrases: DataFrame, k: int) -> np.ndarray:
    """The bit set of some phrases of k words: at most ``FILTER_BITS`` bits
    come to the driver, however many phrases there are."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _lang_keys(batch.column("lang")) if batch.num_rows else None
            for row, data, offsets in text_slices(batch.column("phrase"), SLICE_BYTES):
                one = Phrases(data, offsets, keys[row : row + len(offsets) - 1])
                yield pa.RecordBatch.from_arrays([pa.array(one.cells(one.starts(k), k) + 1)], names=["cell"])

    # native bitmaps number their bits from 1
    cell = phrases.select("lang", "phrase").mapInArrow(number, "cell long")
    grouped = cell.groupBy(F.bitmap_bucket_number("cell").alias("bucket"))
    rows = grouped.agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS >> 3, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(r["bits"], dtype=np.uint8)
        out[(r["bucket"] - 1) * len(part) : r["bucket"] * len(part)] = part
    return out


# ---------------------------------------------------------------- scores


def _first(k: Column | int) -> Column:
    return F.expr(f"substring_index(phrase, ' ', {k})")


def _ratio(a: Column, total: Column, scale: int) -> Column:
    """``floor(scale * a / total)``, exact: the product is a decimal."""
    a = a.cast("decimal(20,0)")
    return F.call_function("div", a * F.lit(scale).cast("decimal(10,0)"), total.cast("decimal(20,0)")).cast("long")


def _with_parts(counted: DataFrame, k: int, known: list[DataFrame]) -> DataFrame:
    """``left_i`` and ``right_i``: counts of the parts of each phrase of k words cut after i words."""
    out = counted
    for i in range(1, k):
        for side, size, part in (("left", i, _first(i)), ("right", k - i, _first(-(k - i)))):
            counts = known[size - 1].select("lang", F.col("phrase").alias("part"), F.col("f").alias(f"{side}_{i}"))
            out = out.withColumn("part", part).join(counts, ["lang", "part"], "left").drop("part")
    return out


def _scored(counted: DataFrame, k: int, known: list[DataFrame], scale: int) -> DataFrame:
    """``lang, phrase, f, l, r, score``: the lowest-scoring cut, the shortest
    first part among equals."""
    cuts = [
        F.struct(
            _ratio(F.col("f"), F.col(f"left_{i}") + F.col(f"right_{i}"), scale).alias("score"), F.lit(i).alias("i"),
            F.col(f"left_{i}").alias("l"), F.col(f"right_{i}").alias("r"),
        )
        for i in range(1, k)
    ]
    lowest = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    told = _with_parts(counted, k, known).select("lang", "phrase", "f", lowest.alias("cut"))
    return told.select("lang", "phrase", "f", "cut.l", "cut.r", "cut.score")


def _bounded(counted: DataFrame, k: int, known: list[DataFrame], scale: int) -> DataFrame:
    """``bound``: no phrase that begins with this one scores higher."""
    out = counted
    for i in range(1, k):
        counts = known[i - 1].select("lang", F.col("phrase").alias("part"), F.col("f").alias(f"left_{i}"))
        out = out.withColumn("part", _first(i)).join(counts, ["lang", "part"], "left").drop("part")
    bounds = [_ratio(F.col("f"), F.col(f"left_{i}") + F.col("f"), scale) for i in range(1, k)]
    return out.select("lang", "phrase", "f", (F.least(*bounds) if len(bounds) > 1 else bounds[0]).alias("bound"))


def _surviving(scored: DataFrame, k: int, longer: DataFrame | None, share: int) -> DataFrame:
    """Without phrases that lie in a phrase of one word more with ``share`` percent of their count."""
    if longer is None:
        return scored
    ends = F.array(_first(k), _first(-k))
    around = longer.select("lang", F.explode(ends).alias("phrase"), F.col("f").alias("around"))
    most = around.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = scored.join(most, ["lang", "phrase"], "left")
    return kept.where(F.col("around").isNull() | (100 * F.col("around") < share * F.col("f"))).drop("around")


# ---------------------------------------------------------------- growth


def phrases(docs: DataFrame, limit: int = 2000, min_count: int = 30, scale: int = 2_000_000, share: int = 80) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first
    ``limit`` phrases of 2 to 4 words by score, that no longer candidate covers
    with ``share`` percent of their occurrences."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text"))
    broadcast = docs.sparkSession.sparkContext.broadcast

    words = _count(texts, 1, lambda s, first: np.ones(len(first), dtype=bool), "words", 1)
    totals = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-totals")
    words = words.where(F.col("f") >= min_count)
    w_bits = broadcast(_bits(words, 1))

    def both_frequent(s: Phrases, first: np.ndarray) -> np.ndarray:
        return _is_set(w_bits.value, s.cells(first, 1)) & _is_set(w_bits.value, s.cells(first + 1, 1))

    pairs = _count(texts, 2, both_frequent, "pairs", min_count)
    pair_scores = written(_scored(pairs, 2, [words], scale), "phrases-pair-scores")
    pair_bounds = written(_bounded(pairs, 2, [words], scale), "phrases-pair-bounds")
    p_bits = broadcast(_bits(pairs, 2))

    best_first = Window.partitionBy("lang").orderBy(F.desc("score"))
    reach = AHEAD * limit
    settled: list[DataFrame] = []
    open_langs = totals.select("lang")
    while True:
        # the floor: the reach-th best pair's score, 0 where there are fewer pairs
        nth = pair_scores.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= reach)
        floors = nth.groupBy("lang").agg(F.when(F.count(F.lit(1)) == reach, F.min("score")).alias("floor"))
        floors = open_langs.join(floors, "lang", "left").select("lang", F.coalesce("floor", F.lit(0)).alias("floor"))
        floors = written(floors, "phrases-floors")

        tops = _above(texts, words, pairs, pair_scores, pair_bounds, floors, p_bits, min_count, scale, share)
        place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), F.asc("phrase"))
        ranked = tops.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= limit)
        ranked = written(ranked, "phrases-top")
        found = ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        state = floors.join(found, "lang", "left")
        is_settled = (F.col("floor") == 0) | (F.coalesce("found", F.lit(0)) >= limit)
        settled.append(ranked.join(state.where(is_settled).select("lang"), "lang", "left_semi"))
        open_langs = written(state.where(~is_settled).select("lang"), "phrases-open")
        if open_langs.isEmpty():
            break
        reach *= 4
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def _above(texts, words, pairs, pair_scores, pair_bounds, floors, p_bits, min_count, scale, share) -> DataFrame:
    """Survivors that score at least their language's floor."""
    broadcast = texts.sparkSession.sparkContext.broadcast

    def above(df: DataFrame, by: str) -> DataFrame:
        return df.join(floors, "lang").where(F.col(by) >= F.col("floor")).drop("floor")

    frontier2 = written(above(pair_bounds, "bound").select("lang", "phrase", "bound"), "phrases-frontier2")
    f2_bits = broadcast(_bits(frontier2, 2))

    def triple(s: Phrases, first: np.ndarray) -> np.ndarray:
        a, b = s.cells(first, 2), s.cells(first + 1, 2)
        frequent = _is_set(p_bits.value, a) & _is_set(p_bits.value, b)
        return frequent & (_is_set(f2_bits.value, a) | _is_set(f2_bits.value, b))

    triples = _count(texts, 3, triple, "triples", min_count)
    # a triple that only ends in a frontier pair may be incomplete as a frontier phrase, not as a count
    bound3 = _bounded(triples, 3, [words, pairs], scale)
    frontier3 = written(above(bound3, "bound").select("lang", "phrase"), "phrases-frontier3")
    f3_bits, t_bits = broadcast(_bits(frontier3, 3)), None

    def quadruple(s: Phrases, first: np.ndarray) -> np.ndarray:
        frequent = np.ones(len(first), dtype=bool)
        for i in range(3):
            frequent &= _is_set(p_bits.value, s.cells(first + i, 2))
        a, b = s.cells(first, 3), s.cells(first + 1, 3)
        return frequent & (_is_set(f3_bits.value, a) | _is_set(f3_bits.value, b))

    fours = _count(texts, 4, quadruple, "fours", min_count)
    # the last three words of a four-word phrase need not continue or end a frontier pair: count those too
    tails = fours.select("lang", _first(-3).alias("phrase")).distinct()
    unknown = written(tails.join(triples, ["lang", "phrase"], "left_anti"), "phrases-tails")
    known3 = triples
    if not unknown.isEmpty():
        t_bits = broadcast(_bits(unknown, 3))
        counted = _count(texts, 3, lambda s, first: _is_set(t_bits.value, s.cells(first, 3)), "tails", min_count)
        known3 = triples.unionByName(counted.join(triples.select("lang", "phrase"), ["lang", "phrase"], "left_anti"))
    scored3 = above(_scored(triples, 3, [words, pairs], scale), "score")
    scored4 = above(_scored(fours, 4, [words, pairs, known3], scale), "score")
    scored2 = above(pair_scores, "score")
    return (
        _surviving(scored2, 2, triples, share)
        .unionByName(_surviving(scored3, 3, fours, share))
        .unionByName(_surviving(scored4, 4, None, share))
    )
