"""Repeated windows of a corpus through super-k-mers.

A window is ``k`` consecutive symbols (words or bytes) of one text.  Its
minimizer is the leftmost of its ``q``-grams with the least hash; consecutive
windows with the same minimizer form a super-k-mer, a path that no window
leaves.  Equal windows have equal minimizers at equal places, so windows need
only be compared under one minimizer (the key):

* super-k-mers with equal content (key and body hash) are one path that occurs
  several times;
* a key with a single path needs no look at its windows;
* a key with several paths branches: its windows are looked at one by one.

Rows are combined in each map task before they are shuffled: a path that
occurs several times in a task, or a key that branches there, leaves the task
once.  So no key gets more rows than there are map tasks, however often it
occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.common import text_of, written
from quiver.llm.tokens import PrefixHash, mix, text_slices, words

#: Rows that a map task combines at a time.
COMBINED_ROWS = 400_000

PATH, BRANCHING, OPEN, REPEATED = range(4)
ROWS = "key long, body long, doc long, at long"


@dataclass(frozen=True)
class Windows:
    """Windows of ``k`` symbols under minimizers of ``q``; ``first_stays``: of
    equal windows the first one (by document, then place) isn't a repeat."""

    unit: str  # "words" or "bytes"
    k: int
    q: int
    first_stays: bool
    seed: int = 0

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of a slice of texts and the first symbol of each text."""
        if self.unit == "bytes":
            return data, offsets
        starts, ends, first = words(data, offsets)
        return PrefixHash(data, 11 + self.seed).of(starts, ends), first


def pack(pos: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
    """Place in the text, number of windows and kind in one integer."""
    return (pos.astype(np.int64) << 20) | (np.asarray(n).astype(np.int64) << 2) | kind


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 20, (at >> 2) & ((1 << 18) - 1), at & 3


def leftmost_least(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in every stretch of ``width``."""
    at, span = np.arange(len(g)), 1
    while span < width:
        step = min(span, width - span)
        near, far = at[:-step], at[step:]
        at = np.where(g[far] < g[near], far, near)
        span += step
    return at


def super_kmers(w: Windows, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, body hash, text number, place in the text, and number of windows."""
    size = len(symbols)
    if size < w.k:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = PrefixHash(symbols, 21 + w.seed)
    starts = np.arange(size - w.q + 1)
    g = grams.of(starts, starts + w.q)
    least = leftmost_least(g, w.k - w.q + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    s = np.flatnonzero(np.arange(w.k, size + 1) <= first[1:][text[: size - w.k + 1]])
    if not len(s):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    p = least[s]
    begins = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    n = np.diff(np.r_[begins, len(s)])
    lo, p = s[begins], p[begins]
    body = PrefixHash(symbols, 31 + w.seed).of(lo, lo + n - 1 + w.k)
    body = mix(body ^ ((p - lo).astype(np.uint64) << np.uint64(32)) ^ n.astype(np.uint64), 5)
    return g[p].view(np.int64), body.view(np.int64), text[lo], lo - first[text[lo]], n


def _rows(key, body, doc, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, body, doc, at)], ["key", "body", "doc", "at"])


def _classes(key, body, doc, pos) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by class and place; first row of the class of each row, class
    beginnings, class sizes."""
    order = np.lexsort((pos, doc, body, key))
    key, body = key[order], body[order]
    begins = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (body[1:] != body[:-1])]) if len(key) else order
    sizes = np.diff(np.r_[begins, len(key)])
    return order, np.repeat(begins, sizes), begins, sizes


def combine(w: Windows, key, body, doc, pos, n, branch: bool) -> Iterator[pa.RecordBatch]:
    """What leaves a map task.  A repeat carries the place it repeats instead
    of key and body.  ``branch``: keys with several bodies branch."""
    order, head, begins, sizes = _classes(key, body, doc, pos)
    key, body, doc, pos, n = (x[order] for x in (key, body, doc, pos, n))
    if w.first_stays:
        repeat = (doc != doc[head]) | (pos != pos[head])
    else:
        repeat = np.repeat(sizes > 1, sizes)
    if repeat.any():
        yield _rows(doc[head][repeat], pos[head][repeat], doc[repeat], pack(pos[repeat], n[repeat], REPEATED))
    key, body, doc, pos, n = (x[begins] for x in (key, body, doc, pos, n))
    if not len(key):
        return
    many = np.zeros(len(key), dtype=bool)
    if branch:
        key_begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        bodies = np.diff(np.r_[key_begins, len(key)])
        many = np.repeat(bodies > 1, bodies)
        marked = key_begins[bodies > 1]
        if len(marked):
            yield _rows(key[marked], body[marked], doc[marked], pack(pos[marked], n[marked], BRANCHING))
            yield _rows(key[many], body[many], doc[many], pack(pos[many], n[many], OPEN))
    one = ~many
    if one.any():
        yield _rows(key[one], body[one], doc[one], pack(pos[one], n[one], PATH))


def settle(w: Windows, rows: DataFrame, branch: bool) -> DataFrame:
    """Bring the rows of a key together and decide: repeats (with the place
    they repeat) and open paths remain."""
    route = F.when(kind().isin(PATH, BRANCHING), F.col("key")).otherwise(F.xxhash64("doc", "at"))
    dealt = rows.withColumn("route", F.xxhash64(route)).repartition("route").drop("route")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0
        for batch in batches:
            block = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            final = (block[3] & 3) >= OPEN
            if final.any():
                yield _rows(*block[:, final])
                block = block[:, ~final]
            kept.append(block)
            size += block.shape[1]
            if size > 200_000:
                block = np.concatenate(kept, axis=1)
                cut = int(np.searchsorted(block[0], block[0][-1]))  # the last key may go on
                if cut:
                    yield from _decided(w, block[:, :cut], branch)
                    kept, size = [block[:, cut:]], block.shape[1] - cut
        if size:
            yield from _decided(w, np.concatenate(kept, axis=1), branch)

    return dealt.sortWithinPartitions("key").mapInArrow(decide, ROWS)


def _decided(w: Windows, block: np.ndarray, branch: bool) -> Iterator[pa.RecordBatch]:
    key, body, doc, at = block
    pos, n, kind = unpack(at)
    if branch:
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[begins, len(key)])
        several = (
            (np.maximum.reduceat(body, begins) != np.minimum.reduceat(body, begins))
            | (np.maximum.reduceat(kind, begins) == BRANCHING)
        )
        several = np.repeat(several, sizes)
        opened = several & (kind == PATH)
        if opened.any():
            yield _rows(key[opened], body[opened], doc[opened], pack(pos[opened], n[opened], OPEN))
        key, body, doc, pos, n = (x[~several] for x in (key, body, doc, pos, n))
        if not len(key):
            return
    order, head, _, sizes = _classes(key, body, doc, pos)
    doc, pos, n = doc[order], pos[order], n[order]
    repeat = (doc != doc[head]) | (pos != pos[head]) if w.first_stays else np.repeat(sizes > 1, sizes)
    if repeat.any():
        yield _rows(doc[head][repeat], pos[head][repeat], doc[repeat], pack(pos[repeat], n[repeat], REPEATED))


def paths(w: Windows, docs: DataFrame) -> DataFrame:
    """Super-k-mers of ``docs`` (``doc``, ``text``), combined per task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            for at, data, offsets in text_slices(batch.column("text")):
                key, body, text, pos, n = super_kmers(w, *w.symbols(data, offsets))
                held.append((key, body, doc[at + text], pos, n))
                size += len(key)
            if size > COMBINED_ROWS:
                yield from combine(w, *map(np.concatenate, zip(*held, strict=True)), True)
                held, size = [], 0
        if size:
            yield from combine(w, *map(np.concatenate, zip(*held, strict=True)), True)

    return docs.select("doc", "text").mapInArrow(cut, ROWS)


def single_windows(w: Windows, opened: DataFrame) -> DataFrame:
    """Repeats among the windows of open paths, each window by its hash.
    ``opened``: ``doc``, ``text``, ``open`` (packed places)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            places = batch.column("open")
            for at, data, offsets in text_slices(batch.column("text")):
                symbols, first = w.symbols(data, offsets)
                own = [np.array(places[at + t].as_py(), dtype=np.int64) for t in range(len(offsets) - 1)]
                text = np.repeat(np.arange(len(own)), [len(o) for o in own])
                pos, n, _ = unpack(np.concatenate(own))
                lead = np.cumsum(n) - n
                inside = np.arange(int(n.sum())) - np.repeat(lead, n)
                pos, text = np.repeat(pos, n) + inside, np.repeat(text, n)
                start = first[text] + pos
                h1 = PrefixHash(symbols, 41 + w.seed).of(start, start + w.k).view(np.int64)
                h2 = PrefixHash(symbols, 51 + w.seed).of(start, start + w.k).view(np.int64)
                held.append((h1, h2, doc[at + text], pos, np.ones(len(pos), dtype=np.int64)))
                size += len(pos)
                if size > COMBINED_ROWS:
                    yield from combine(w, *map(np.concatenate, zip(*held, strict=True)), False)
                    held, size = [], 0
        if size:
            yield from combine(w, *map(np.concatenate, zip(*held, strict=True)), False)

    return settle(w, opened.mapInArrow(expand, ROWS), False)


@contextmanager
def semi_join_filters(spark):
    """Let Spark send a Bloom filter of bounded size to the larger side of a
    join even where that side is below Spark's usual limit."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` as ``doc``, ``doc_id``, ``text``; ``doc`` orders the documents.

    Usually ``doc`` is ``doc_id``.  Where an id is null or repeated, documents
    are numbered by id (null last), then text; identical rows share a number.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    keyed = rows.withColumn("h", F.sha2("text", 256))
    distinct = keyed.select("doc_id", "h").distinct().orderBy(F.asc_nulls_last("doc_id"), "h")
    numbered = written(distinct.withColumn("doc", F.monotonically_increasing_id()), "repeat-numbers")
    same = keyed["doc_id"].eqNullSafe(numbered["doc_id"]) & (keyed["h"] == numbered["h"])
    return keyed.join(numbered, same).select("doc", keyed["doc_id"], "text")


def kind() -> Column:
    return F.col("at").bitwiseAND(3)


def affected(w: Windows, rows: DataFrame, settled: DataFrame, opened: DataFrame) -> DataFrame:
    """Texts that take part in a repeat or a branch, with what ``opened`` says
    of them (``doc`` and any columns), written to the shared folder."""
    sources = settled.where(kind() == REPEATED).select(F.col("key").alias("doc"))
    wanted = settled.select("doc").union(sources).distinct().join(opened, "doc", "left")
    wanted = written(wanted.withColumn("used", F.lit(1)), "repeat-wanted").where("used > 0").drop("used")
    with semi_join_filters(rows.sparkSession):
        found = rows.select("doc", "text").join(wanted.hint("merge"), "doc")
        return written(found.dropDuplicates(["doc"]), "repeat-texts")


def pieces(settled: DataFrame) -> DataFrame:
    """Repeats as ``doc``, ``start``, ``n`` (windows), ``source``, ``source_start``."""
    return settled.where(kind() == REPEATED).select(
        "doc",
        F.shiftright("at", 20).alias("start"),
        F.shiftright("at", 2).bitwiseAND((1 << 18) - 1).alias("n"),
        F.col("key").alias("source"),
        F.col("body").alias("source_start"),
    )


def compacted(found: DataFrame) -> DataFrame:
    """Join paths that continue each other in the text and in their source."""
    order = Window.partitionBy("doc").orderBy("start", "source", "source_start")
    goes_on = (
        (F.lag("source").over(order) == F.col("source"))
        & (F.lag("start").over(order) + F.lag("n").over(order) == F.col("start"))
        & (F.lag("source_start").over(order) + F.lag("n").over(order) == F.col("source_start"))
    )
    marked = found.withColumn("begins", F.when(goes_on, 0).otherwise(1))
    chained = marked.withColumn("chain", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        chained.groupBy("doc", "chain")
        .agg(
            F.min("start").alias("start"),
            F.sum("n").alias("n"),
            F.first("source").alias("source"),
            F.min("source_start").alias("source_start"),
        )
        .drop("chain")
    )


def _digests(w: Windows, texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (``doc``, ``start``, ``n``, ``source``, ``source_start``)
    without ``doc`` and ``start``, with a 128-bit hash of their bytes: other
    hash functions, and other symbols for words, than those that found them."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("spans")
            counts = np.diff(own.offsets.to_numpy())
            flat = own.flatten()
            start, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
            keys = [flat.field(c) for c in ("source", "source_start", "n")]
            begin = np.r_[0, np.cumsum(counts)]
            for at, data, offsets in text_slices(batch.column("text")):
                lo, hi = begin[at], begin[at + len(offsets) - 1]
                text = np.repeat(np.arange(len(offsets) - 1), counts[at : at + len(offsets) - 1])
                body, starts, ends, first = plain_bytes(w, data, offsets)
                a = first[text] + start[lo:hi]
                b = a + n[lo:hi] - 2 + w.k
                hashes = [PrefixHash(body, seed).of(starts[a], ends[b]).view(np.int64) for seed in (71, 81)]
                columns = [k.slice(lo, hi - lo) for k in keys] + [pa.array(h) for h in hashes]
                yield pa.RecordBatch.from_arrays(columns, ["source", "source_start", "n", "h1", "h2"])

    grouped = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "source", "source_start")).alias("spans"))
    joined = texts.select("doc", "text").join(grouped.hint("merge"), "doc").select("text", "spans")
    return joined.mapInArrow(digest, "source long, source_start long, n long, h1 long, h2 long")


def verified(w: Windows, texts: DataFrame, spans: DataFrame) -> bool:
    """Whether the bytes of every span equal those at its source."""
    elsewhere = (F.col("doc") != F.col("source")) | (F.col("start") != F.col("source_start"))
    copies = spans.where(elsewhere)
    origins = copies.select("source", "source_start", "n").distinct()
    origins = origins.select(F.col("source").alias("doc"), F.col("source_start").alias("start"), "n", "source", "source_start")
    sides = _digests(w, texts, copies).unionByName(_digests(w, texts, origins))
    h = [f(c).alias(f"{f.__name__}_{c}") for c in ("h1", "h2") for f in (F.min, F.max)]
    compared = sides.groupBy("source", "source_start", "n").agg(*h)
    return compared.where("min_h1 <> max_h1 or min_h2 <> max_h2").isEmpty()


def plain_bytes(w: Windows, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bytes with one space between the words of a text (as they are, if
    symbols are bytes), start and end of every symbol in them, and the first
    symbol of each text."""
    if w.unit == "bytes":
        return data, np.arange(len(data)), np.arange(1, len(data) + 1), offsets
    starts, ends, first = words(data, offsets)
    length = ends - starts
    begin = np.cumsum(length + 1) - (length + 1)
    body = np.full(int((length + 1).sum()), 0x20, dtype=np.uint8)
    place = np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)
    source = np.arange(int(length.sum())) + np.repeat(starts - (np.cumsum(length) - length), length)
    body[place] = data[source]
    return body, begin, begin + length, first


def checked(w: Windows, attempt: Callable[[Windows], tuple], tries: int = 3) -> tuple[Windows, tuple]:
    """What ``attempt`` returns (texts, spans to verify, anything) under hashes
    for which all spans are verified."""
    for seed in range(tries):
        w = replace(w, seed=seed)
        found = attempt(w)
        if verified(w, *found[:2]):
            return w, found
    raise RuntimeError(f"repeats could not be verified under {tries} hash seeds")


def stretch(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Symbols as bytes, joined by one space if they are words; a plain slice
    of the text where nothing or single spaces part them."""
    if not len(starts):
        return b""
    if (starts[1:] == ends[:-1]).all():
        return data[starts[0] : ends[-1]].tobytes()
    if (starts[1:] == ends[:-1] + 1).all():
        out = data[starts[0] : ends[-1]].copy()
        out[ends[:-1] - starts[0]] = 0x20
        return out.tobytes()
    raw = data.tobytes()
    return b" ".join(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def covered(size: int, starts: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Mask of the symbols that windows cover: of the ones at ``starts``, and the ``n - 1`` after each."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0
