"""N-gram Jaccard join over banded MinHash signatures (operator 2).

Texts with equal sets of word n-grams form a class; its representative is the
row with the smallest id.  A representative's MinHash signature gives one key
per band (``TREES`` bands; called tries in the code).  The number of values in
a band is the largest, from ``MAX_DEPTH`` down, at which a pair at the
threshold meets in some band with the target probability; it depends on the
threshold only, not on the data.  This stands in place of an LSH forest.
Representatives that share a key are candidates; candidates that hang
together (connected components over the keys) are dealt into blocks, and every pair of a component is verified on
the exact n-gram sets, block against block.  So all pairs of a component are
compared once, without a row per pair: a task returns, per representative, the
number of its links (copies counted) and a label of the part it is linked to.

Links between different texts are counted, but for pairs that meet in no band
(at the threshold one in about 1,500, see README); copies are counted by class
size.  Groups (``class_id``) are the connected components of the links.

Defined results: a text with fewer words than n has one n-gram, all its words;
a text without words has none and no links; a null id takes part in nothing
(its ``class_id`` is null, its ``n_links`` 0); rows that share an id but not
their n-grams are separate documents; repeated rows are copies of each other;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import keeps_columns, text_of, written
from quiver.llm.components import components
from quiver.llm.tokens import PrefixHash, mix, text_slices, words

TREES, MAX_DEPTH, TARGET_RECALL = 24, 8, 0.999
#: Representatives of a block, about.
BLOCK = 256
#: n-gram columns of a dense product.
COLUMNS = 16_384


def matched_depth(threshold: float, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some trie
    with probability ``target``."""
    depth = MAX_DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < target:
        depth -= 1
    return depth


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text."""
    starts, ends, first = words(data, offsets)
    own = PrefixHash(data, 11).of(starts, ends)
    over = PrefixHash(own, 12)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a < n:
            grams = over.of(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64)
        else:
            at = np.arange(a, b - n + 1)
            grams = over.of(at, at + n)
        out.append(np.unique(grams))
    return out


@lru_cache(maxsize=2)
def _factors(count: int) -> np.ndarray:
    return np.random.default_rng(1000).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def trie_keys(sets: list[np.ndarray], depth: int) -> np.ndarray:
    """Keys of the trie nodes of ``depth`` (one column per trie) of non-empty
    sets: a MinHash is the least of the n-gram hashes times an odd factor."""
    grams = np.concatenate(sets)
    begins = np.cumsum([0] + [len(s) for s in sets[:-1]])
    factors = _factors(TREES * MAX_DEPTH)
    keys = np.empty((len(sets), TREES), dtype=np.uint64)
    for tree in range(TREES):
        key = np.full(len(sets), tree, dtype=np.uint64)
        for level in range(depth):
            key = mix(key ^ np.minimum.reduceat(grams * factors[tree * MAX_DEPTH + level], begins), 7)
        keys[:, tree] = key
    return keys


def digest(grams: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _signatures(docs: DataFrame, n: int, depth: int) -> DataFrame:
    """``doc_id``, ``text_hash``, the 128-bit digest of the n-gram set, and the trie keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch.column("text")):
                sets = shingle_sets(data, offsets, n)
                digests = [digest(s) for s in sets]
                full = [s for s in sets if len(s)]
                found = iter(trie_keys(full, depth).view(np.int64)) if full else iter(())
                keys = [next(found) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(sets)),
                        batch.column("text_hash").slice(at, len(sets)),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_hash", "h1", "h2", "keys"],
                )

    return docs.mapInArrow(sign, "doc_id long, text_hash long, h1 long, h2 long, keys array<long>")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id`` (smallest id of
    its group of linked documents), ``n_links`` (other documents at
    ``threshold`` or more)."""
    return _joined(docs, threshold, n).drop("text_hash")


def _joined(docs: DataFrame, threshold: float, n: int) -> DataFrame:
    depth = matched_depth(threshold)
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), _text_hash().alias("text_hash")
    )
    rows = given.where("doc_id is not null")
    signed = written(_signatures(rows, n, depth), "near-signed")
    classes = (
        signed.where("keys is not null")
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    )
    classes, renumbered = _numbered(written(classes, "near-classes"))
    candidates = written(_candidates(classes), "near-candidates")
    sets = _candidate_sets(rows, candidates, n)
    counted = written(_verified(sets, threshold), "near-counted")
    links = counted.groupBy("number").agg(F.sum("links").alias("links"))
    groups = components(counted.select(F.col("number").alias("a"), F.col("label").alias("b")))
    groups = groups.select("node", F.col("component").alias("least"))
    if renumbered:
        ids = classes.select(F.col("number").alias("least"), "rep")
        groups = groups.join(ids.hint("merge"), "least").select("node", F.col("rep").alias("least"))
    per_class = (
        classes.select("h1", "h2", "rep", "number", "copies")
        .join(links.hint("merge"), "number", "left")
        .join(groups.hint("merge"), F.col("number") == F.col("node"), "left")
        .select(
            "h1", "h2",
            F.coalesce("least", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    answered = signed.where("keys is not null").join(per_class.hint("merge"), ["h1", "h2"])
    alone = signed.where("keys is null").unionByName(given.where("doc_id is null"), allowMissingColumns=True)
    return answered.select("doc_id", "class_id", "n_links", "text_hash").unionByName(
        alone.select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    )


def _text_hash() -> Column:
    return F.xxhash64(text_of())


def _numbered(classes: DataFrame) -> tuple[DataFrame, bool]:
    """``classes`` with a ``number`` of their own that goes up with ``rep``, and
    whether it is another one than ``rep``.

    Usually it is ``rep``.  Where an id is repeated with another text, several
    classes can have one ``rep``; then they are numbered in order.
    """
    if classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return classes.withColumn("number", F.col("rep")), False
    ordered = classes.orderBy("rep", "h1", "h2").withColumn("number", F.monotonically_increasing_id())
    return written(ordered, "near-numbers"), True


def _candidates(classes: DataFrame) -> DataFrame:
    """Representatives with a candidate partner: ``h1``, ``h2``, ``rep``,
    ``number``, ``copies``, ``component``, ``blocks``, ``block``."""
    nodes = classes.select("h1", F.explode("keys").alias("key"))
    shared = nodes.groupBy("key").agg(F.min("h1").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = nodes.join(shared.hint("merge"), "key").select(F.col("h1").alias("a"), F.col("head").alias("b"))
    parts = written(components(met.distinct()), "near-components")
    sizes = parts.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = parts.join(sizes.hint("merge"), "component")
    return (
        classes.select("h1", "h2", "rep", "number", "copies")
        .join(placed.hint("merge"), F.col("h1") == F.col("node"))
        .select(
            "h1", "h2", "rep", "number", "copies", "component", "blocks",
            F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int").alias("block"),
        )
    )


def _candidate_sets(rows: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """n-gram sets of the candidate representatives, by block."""
    kept = ["component", "block", "blocks", "number", "copies"]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h2 = batch.column("h2").to_pylist()
            h1 = batch.column("h1").to_pylist()
            for at, data, offsets in text_slices(batch.column("text")):
                sets = shingle_sets(data, offsets, n)
                # an id may be repeated with another text: that is another class
                own = pa.array([digest(s) == (h1[at + k], h2[at + k]) for k, s in enumerate(sets)])
                columns = [batch.column(c).slice(at, len(sets)) for c in kept]
                packed = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, packed], [*kept, "grams"]).filter(own)

    wanted = candidates.withColumnRenamed("rep", "doc_id").hint("merge")
    texts = rows.join(wanted, "doc_id")
    found = texts.select(*kept, "h1", "h2", "text").mapInArrow(
        grams, "component long, block int, blocks int, number long, copies long, grams binary"
    )
    return written(found, "near-sets")


def _verified(sets: DataFrame, threshold: float) -> DataFrame:
    """``number``, ``links``, ``label`` for every representative with a link, once
    per pair of blocks in which it has one."""
    kind = "component long, block int, blocks int, numbers binary, copies binary, sizes binary, grams binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[dict] = []

        def packed() -> pa.RecordBatch:
            own = {k: run[0][k] for k in ("component", "block", "blocks")}
            own["numbers"] = np.array([r["number"] for r in run], "<i8").tobytes()
            own["copies"] = np.array([r["copies"] for r in run], "<i8").tobytes()
            own["sizes"] = np.array([len(r["grams"]) // 8 for r in run], "<i8").tobytes()
            own["grams"] = b"".join(r["grams"] for r in run)
            return pa.RecordBatch.from_pylist([own], _PACKED)

        for batch in batches:
            for row in batch.to_pylist():
                if run and (row["component"], row["block"]) != (run[0]["component"], run[0]["block"]):
                    yield packed()
                    run = []
                if not run or row["number"] != run[-1]["number"]:  # else a repeated row
                    run.append(row)
        if run:
            yield packed()

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _counted(*_linked([_unpacked(row)], threshold))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                other = {k: row[f"{k}_2"] for k in _PARTS}
                yield from _counted(*_linked([_unpacked(row), _unpacked(other)], threshold))

    dealt = sets.repartition("component", "block").sortWithinPartitions("component", "block", "number")
    packs = written(dealt.mapInArrow(pack, kind), "near-packs")
    result = "number long, links long, label long"
    own = packs.mapInArrow(within, result)
    split = packs.where("blocks > 1")
    others = F.explode(F.sequence(F.col("block") + 1, F.col("blocks")))
    left = split.select("*", others.alias("other")).where("other < blocks")
    right = split.select("component", F.col("block").alias("other"), *[F.col(c).alias(f"{c}_2") for c in _PARTS])
    across = left.join(right.hint("merge"), ["component", "other"]).mapInArrow(between, result)
    return own.unionByName(across)


_PARTS = ("numbers", "copies", "sizes", "grams")
_PACKED = pa.schema(
    [("component", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32())]
    + [(c, pa.binary()) for c in _PARTS]
)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (*(np.frombuffer(row[c], "<i8") for c in ("numbers", "copies", "sizes")), np.frombuffer(row["grams"], "<u8"))


def _linked(blocks: list, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, copies, and the symmetric matrix of links; between two blocks only
    the links from one to the other."""
    numbers, copies, sizes, grams = (np.concatenate(x) for x in zip(*blocks, strict=True))
    n, half = len(numbers), len(blocks[0][0])
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(grams, kind="stable")
    fresh = np.r_[True, np.diff(grams[order]) != 0] if len(order) else np.zeros(0, bool)
    column = np.cumsum(fresh) - 1
    count = np.bincount(column)
    shared = count[column] > 1
    row, column = row[order][shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((n, n), dtype=np.float32) if len(blocks) == 1 else np.zeros((half, n - half), dtype=np.float32)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        dense = np.zeros((n, COLUMNS), dtype=np.float32)
        dense[row[part], column[part] - at] = 1
        common += dense @ dense.T if len(blocks) == 1 else dense[:half] @ dense[half:].T
    a, b = (sizes, sizes) if len(blocks) == 1 else (sizes[:half], sizes[half:])
    union = a[:, None] + b[None, :] - common
    near = common >= (threshold - 1e-9) * union
    if len(blocks) == 1:
        np.fill_diagonal(near, False)
        return numbers, copies, near
    linked = np.zeros((n, n), dtype=bool)
    linked[:half, half:] = near
    linked[half:, :half] = near.T
    return numbers, copies, linked


def _counted(numbers: np.ndarray, copies: np.ndarray, linked: np.ndarray) -> Iterator[pa.RecordBatch]:
    has = np.flatnonzero(linked.any(1))
    if not len(has):
        return
    numbers, copies, linked = numbers[has], copies[has], linked[np.ix_(has, has)]
    label = numbers.copy()
    while True:  # smallest number that a representative is linked to, directly or not
        least = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
        if (least == label).all():
            break
        label = least
    yield pa.RecordBatch.from_pydict(
        {"number": pa.array(numbers), "links": pa.array(linked @ copies), "label": pa.array(label)}
    )


@keeps_columns
def one_per_group(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """``docs`` without the rows whose own text is in a group that holds a smaller id (rows of a null id stay)."""
    joined = written(_joined(docs, threshold, n), "near-joined")
    dropped = joined.where("class_id < doc_id").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = (F.col("doc_id") == F.col("__id")) & (_text_hash() == F.col("__hash"))
    return docs.join(dropped.distinct().hint("merge"), same, "left_anti")
