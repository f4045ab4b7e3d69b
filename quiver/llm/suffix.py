"""Suffix-array dedup of repeated byte strings (operator 1).

A byte goes if a string of 400 bytes that covers it also starts anywhere else.
Windows that may repeat are found through super-k-mers (see ``repeats``):
whole stretches that occur several times are settled there, and what branches
comes here.  Contexts that share a minimizer meet in one task, where the
suffixes at equal places of the minimizer are put in order by a mergesort; two
suffixes are compared by prefix polynomial hashes and a binary search for
their common extension, so a comparison takes logarithmic time.  Neighbours
that agree on 400 bytes repeat and are verified byte by byte; stretches settled
before are verified against their source by another 128-bit hash.

A minimizer with more than ``CROWD`` contexts isn't brought into one task: its
windows are told apart by their hash in Spark, combined before the shuffle.

Defined results: a null text is empty; a text shorter than 400 bytes keeps all
its bytes; repeated rows repeat each other, so both lose every string of 400
bytes; a null id is a document like others; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm import repeats
from quiver.llm.common import written
from quiver.llm.repeats import OPEN, Windows
from quiver.llm.tokens import PrefixHash, text_slices

WINDOW_BYTES, MINIMIZER_BYTES = 400, 128
#: Contexts of one minimizer that are sorted in one task, at most.
CROWD = 1024
#: Suffixes that are sorted together.
SUFFIXES = 150_000


class Suffixes:
    """Suffixes (of at most ``depth`` bytes) of a buffer, compared by hashes."""

    def __init__(self, data: np.ndarray, depth: int):
        self.data = np.append(data, np.uint8(0))
        self.hashes = PrefixHash(data, 61)
        self.depth = depth

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.depth, np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            equal = self.hashes.of(a, a + middle) == self.hashes.of(b, b + middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        at = self.common(a, b)
        end = at >= self.depth
        return np.where(end, or_equal, self.data[np.where(end, 0, a + at)] < self.data[np.where(end, 0, b + at)])

    def sort(self, suffix: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """``suffix`` in order within each (contiguous) bucket: a bottom-up
        mergesort over all buckets at once.  An element's place in a merged
        run is its place in its own half and, by binary search, the number of
        elements of the other half that go before it."""
        begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[begins, len(bucket)])
        base = np.repeat(begins, sizes)
        inside = np.arange(len(bucket)) - base
        size = np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            run = inside // (2 * width) * (2 * width)
            active = np.flatnonzero(run + width < size)
            if len(active):
                left = inside[active] - run[active] < width
                start = base[active] + run[active]
                middle = start + width
                end = np.minimum(start + 2 * width, base[active] + size[active])
                low = np.where(left, middle, start)
                high = np.where(left, end, middle)
                first = low.copy()
                own = suffix[active]
                while True:
                    open_ = np.flatnonzero(low < high)
                    if not len(open_):
                        break
                    probe = (low[open_] + high[open_]) >> 1
                    before = self.less(suffix[probe], own[open_], ~left[open_])
                    low[open_] = np.where(before, probe + 1, low[open_])
                    high[open_] = np.where(before, high[open_], probe)
                place = start + (inside[active] - run[active]) - np.where(left, 0, width) + (low - first)
                merged = suffix.copy()
                merged[place] = own
                suffix = merged
            width *= 2
        return suffix


def repeated_windows(contexts: list[bytes], keys: np.ndarray, counts: np.ndarray, w: Windows) -> list[np.ndarray]:
    """Per context a mask of its windows (``counts`` of them) that occur in
    another context of the same key, or elsewhere in their own."""
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    lengths = np.array([len(c) for c in contexts])
    begin = np.cumsum(lengths) - lengths
    # a context's minimizer is the first of its q-grams that hashes to the key
    places = np.arange(max(0, len(data) - w.q + 1))
    g = PrefixHash(data, 21 + w.seed).of(places, places + w.q).view(np.int64)
    owner = np.repeat(np.arange(len(contexts)), lengths)
    hits = np.flatnonzero(g == keys[owner[: len(g)]])
    anchor = hits[np.searchsorted(hits, begin)]
    context = np.repeat(np.arange(len(contexts)), counts)
    window = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begin[context] + window
    offset = anchor[context] - start
    order = np.lexsort((start, offset, keys[context]))
    bucket = np.cumsum(
        np.r_[True, (np.diff(keys[context][order]) != 0) | (np.diff(offset[order]) != 0)][: len(order)]
    )
    suffixes = Suffixes(data, w.k)
    ranked = suffixes.sort(start[order], bucket)
    same_bucket = bucket[1:] == bucket[:-1]
    pair = np.flatnonzero(same_bucket)
    equal = pair[suffixes.common(ranked[pair], ranked[pair + 1]) >= w.k]
    equal = equal[_same_bytes(data, ranked[equal], ranked[equal + 1], w.k)]
    repeat = np.zeros(len(data) + 1, dtype=bool)
    repeat[ranked[equal]] = True
    repeat[ranked[equal + 1]] = True
    return [repeat[b : b + n] for b, n in zip(begin, counts, strict=True)]


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether stretches really are equal: those that continue each other are
    compared at once, and one by one where that fails."""
    out = np.ones(len(a), dtype=bool)
    order = np.lexsort((a, b - a))
    a, b = a[order], b[order]
    cuts = np.flatnonzero(np.r_[True, (np.diff(a) != 1) | (np.diff(b) != 1)]) if len(a) else []
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(a)].astype(int), strict=True):
        length = hi - lo - 1 + size
        if not np.array_equal(data[a[lo] : a[lo] + length], data[b[lo] : b[lo] + length]):
            for i in range(lo, hi):
                out[order[i]] = np.array_equal(data[a[i] : a[i] + size], data[b[i] : b[i] + size])
    return out


def _sorted_contexts(w: Windows, texts: DataFrame) -> DataFrame:
    """Repeats among the open windows of ``texts`` (``doc``, ``text``,
    ``shared``: list of key and packed place): ``doc``, ``start``, ``n``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_pylist()
            shared = batch.column("shared")
            for at, data, offsets in text_slices(batch.column("text")):
                keys, owners, packed, contexts = [], [], [], []
                for t in range(len(offsets) - 1):
                    for place in shared[at + t].as_py():
                        pos, n = place["at"] >> 20, (place["at"] >> 2) & ((1 << 18) - 1)
                        begin = offsets[t] + pos
                        keys.append(place["key"])
                        owners.append(docs[at + t])
                        packed.append(place["at"])
                        contexts.append(data[begin : begin + n - 1 + w.k].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()), pa.array(owners, pa.int64()), pa.array(packed, pa.int64()),
                        pa.array(contexts, pa.binary()),
                    ],
                    ["key", "doc", "at", "context"],
                )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, CROWD)
                held.append(part)
                windows += int(((part.column("at").to_numpy() >> 2) & ((1 << 18) - 1)).sum())
                at += CROWD
                if windows >= SUFFIXES:
                    held, windows, out = _sorted_part(held, w, False)
                    yield from out
        if held:
            yield from _sorted_part(held, w, True)[2]

    opened = texts.mapInArrow(cut, "key long, doc long, at long, context binary")
    dealt = opened.withColumn("route", F.xxhash64("key")).repartition("route").drop("route")
    return dealt.sortWithinPartitions("key").mapInArrow(sort, "doc long, start long, n long")


def _sorted_part(held: list[pa.RecordBatch], w: Windows, last: bool):
    """Sort all complete keys of ``held``; the last key stays unless it is the end."""
    table = pa.Table.from_batches(held)
    keys = table["key"].to_numpy()
    stop = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
    rest = table.slice(stop).combine_chunks().to_batches()
    counts = (table["at"].to_numpy() >> 2) & ((1 << 18) - 1)
    out = []
    if stop:
        contexts = table["context"].slice(0, stop).to_pylist()
        masks = repeated_windows(contexts, keys[:stop], counts[:stop], w)
        docs, places = table["doc"].to_numpy()[:stop], table["at"].to_numpy()[:stop] >> 20
        doc, start, n = [], [], []
        for mask, own, place in zip(masks, docs.tolist(), places.tolist(), strict=True):
            if mask.any():
                edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
                doc += [own] * (len(edge) // 2)
                start += (edge[::2] + place).tolist()
                n += (edge[1::2] - edge[::2]).tolist()
        columns = [pa.array(x, pa.int64()) for x in (doc, start, n)]
        out.append(pa.RecordBatch.from_arrays(columns, ["doc", "start", "n"]))
    return rest, int(counts[stop:].sum()), out


def suffix_dedup(docs: DataFrame, window: int = WINDOW_BYTES, minimizer: int = MINIMIZER_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256``."""
    w = Windows("bytes", window, min(minimizer, window), first_stays=False)
    rows = repeats.identified(docs)
    w, (texts, _, spans) = repeats.checked(w, lambda w: _repeated(w, rows))
    kept = _kept(w, texts, spans)
    plain = rows.select(
        "doc", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("plain")
    )
    none = F.lit(0).cast("long")
    return plain.join(kept.hint("merge"), "doc", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("sha", "plain").alias("kept_sha256"),
    )


def _repeated(w: Windows, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Affected texts, the spans whose source is still to be verified, and all
    repeated spans (``doc``, ``start``, ``n`` windows)."""
    settled = written(repeats.settle(w, repeats.paths(w, rows), True), "suffix-paths")
    branch = settled.where(repeats.kind() == OPEN).select("key", "doc", "at")
    crowds = branch.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > CROWD)
    judged = branch.join(crowds.hint("merge"), "key", "left")
    crowded = F.col("contexts").isNotNull()
    opened = judged.groupBy("doc").agg(
        F.collect_list(F.when(crowded, F.col("at"))).alias("open"),
        F.collect_list(F.when(~crowded, F.struct("key", "at"))).alias("shared"),
    )
    texts = repeats.affected(w, rows, settled, opened)
    singles = repeats.single_windows(w, texts.where("size(open) > 0").select("doc", "text", "open"))
    single = written(singles, "suffix-singles")
    by_order = written(
        _sorted_contexts(w, texts.where("size(shared) > 0").select("doc", "text", "shared")), "suffix-sorted"
    )
    sourced = written(
        repeats.compacted(repeats.pieces(settled).unionByName(repeats.pieces(single))), "suffix-spans"
    )
    return texts, sourced, sourced.select("doc", "start", "n").unionByName(by_order)


def _kept(w: Windows, texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc``, ``n_removed``, ``n_spans``, ``sha`` of the texts with repeats."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            spans_of = batch.column("spans")
            for at, data, offsets in text_slices(batch.column("text")):
                counts, runs, shas = [], [], []
                for t in range(len(offsets) - 1):
                    own = np.array(spans_of[at + t].as_py(), dtype=np.int64)
                    body = data[offsets[t] : offsets[t + 1]]
                    gone = repeats.covered(len(body), own >> 32, own & 0xFFFFFFFF, w.k)
                    counts.append(int(gone.sum()))
                    runs.append(int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum()))
                    shas.append(hashlib.sha256(body[~gone].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[at : at + len(counts)]), pa.array(counts, pa.int64()), pa.array(runs, pa.int64()),
                        pa.array(shas, pa.string()),
                    ],
                    ["doc", "n_removed", "n_spans", "sha"],
                )

    packed = F.shiftleft("start", 32).bitwiseOR(F.col("n"))
    grouped = spans.groupBy("doc").agg(F.collect_list(packed).alias("spans"))
    joined = texts.select("doc", "text").join(grouped.hint("merge"), "doc")
    return joined.mapInArrow(keep, "doc long, n_removed long, n_spans long, sha string")
