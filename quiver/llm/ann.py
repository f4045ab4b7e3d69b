"""Approximate nearest neighbours by stable projections (operator 7).

Largest inner product becomes smallest distance by one more coordinate
(vectors are lifted to one norm).  Vectors are projected to ``DIMENSIONS``
Gaussian (2-stable) directions and indexed by a kd-tree over the projections,
whose splits come from a bounded sample; every row is indexed.  A squared
projected distance over the squared true one follows chi-square, so a search
may stop at projected distance ``r`` once a point beyond it is closer than the
k-th best found with a chance below ``1 - confidence``:
``r**2 > quantile(confidence) * best**2``.

A search runs in two rounds of joins by cell: first a query's own cell, then
the cells whose box the stopping test doesn't exclude.  Inside a block the
projected neighbours are verified in growing radii on the original vectors in
double precision until the test holds.  Points travel in blocks of at most
about ``BLOCK_ROWS`` and queries in packs of at most ``PACK_ROWS``, so a cell
that one vector fills with a third of all rows is many blocks; a block returns
at most k candidates per query.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do null ids; equal scores
go to the smaller id; repeated ids are separate candidates, but none of them
answers a query with its id; fewer candidates than k give fewer rows; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import written

DIMENSIONS = 8
#: Rows that the splits of the tree are taken from, at most.
SAMPLE_ROWS = 20_000
LEAF_ROWS, BLOCK_ROWS, PACK_ROWS = 1024, 2048, 256
#: Radii of a block search, as shares of the radius at which the test holds.
RADII = (0.6, 0.8, 1.0)
#: Relative slack that covers rounding of the blocked products.
SLACK = 1e-12


def chi2_quantile(confidence: float, m: int = DIMENSIONS) -> float:
    """Quantile of the chi-square law with an even number of degrees."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if 1 - tail < confidence else (low, x)
    return high


@dataclass(frozen=True)
class Tree:
    """Projection, lift norm, and the splits of a complete kd-tree in heap order."""

    directions: np.ndarray  # (d + 1, m)
    norm: float
    depth: int
    axis: np.ndarray
    value: np.ndarray

    def project(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(1), 0.0))
        return vectors @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def project_queries(self, vectors: np.ndarray) -> np.ndarray:
        scale = self.norm / np.sqrt((vectors**2).sum(1))
        return (vectors * scale[:, None]) @ self.directions[:-1]

    def cells(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), dtype=np.int64)
        rows = np.arange(len(projected))
        for _ in range(self.depth):
            node = 2 * node + 1 + (projected[rows, self.axis[node]] > self.value[node])
        return (node - ((1 << self.depth) - 1)).astype(np.int32)


def build_tree(sample: np.ndarray, norm: float, rows: int, seed: int) -> Tree:
    d = sample.shape[1]
    directions = np.random.default_rng(seed).standard_normal((d + 1, DIMENSIONS))
    depth = max(0, min(math.ceil(math.log2(max(1, rows / LEAF_ROWS))), int(math.log2(max(1, len(sample) / 16)))))
    inner = (1 << depth) - 1
    axis, value = np.zeros(max(1, inner), dtype=np.int64), np.zeros(max(1, inner))
    tree = Tree(directions, norm, depth, axis, value)
    parts = {0: tree.project(sample)}
    for node in range(inner):
        own = parts.pop(node)
        axis[node] = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
        value[node] = float(np.median(own[:, axis[node]])) if len(own) else 0.0
        right = own[:, axis[node]] > value[node]
        parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]
    return tree


def _matrix(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows of ``batch`` that take part."""
    lists = batch.column("embedding")
    good = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(lists.offsets.to_numpy()) == d)
    good &= batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
    rows = pa.array(np.flatnonzero(good))
    values = lists.take(rows).flatten().to_numpy(zero_copy_only=False)  # null components become NaN
    vectors = values.astype(np.float64).reshape(-1, d)
    usable = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
    return batch.column("vec_id").take(rows).to_numpy(zero_copy_only=False)[usable], vectors[usable]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[list[dict]]:
    """Runs of at most ``limit`` rows with equal keys from sorted batches."""
    run: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if run and (len(run) == limit or any(row[k] != run[0][k] for k in keys)):
                yield run
                run = []
            run.append(row)
    if run:
        yield run


_FOUND = np.dtype([("query", "<i4"), ("id", "<i8"), ("score", "<f8")])


def _best(found: np.ndarray, k: int) -> np.ndarray:
    """The k best per query: larger scores first, then smaller ids."""
    found = found[np.lexsort((found["id"], -found["score"], found["query"]))]
    query = found["query"]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    return found[np.arange(len(query)) - start < k]


def _kth(found: np.ndarray, n: int, k: int) -> np.ndarray:
    """Score of the k-th best per query; -inf where there are fewer."""
    out = np.full(n, -np.inf)
    found = _best(found, k)
    count = np.bincount(found["query"], minlength=n)
    lowest = np.full(n, np.inf)
    np.minimum.at(lowest, found["query"], found["score"])
    out[count >= k] = lowest[count >= k]
    return out


class _Search:
    """Searches one block for one pack of queries."""

    def __init__(self, tree: Tree, d: int, k: int, quantile: float):
        self.tree, self.d, self.k, self.quantile = tree, d, k, quantile

    def radius2(self, kth: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Squared projected distance at which the stopping test holds."""
        best2 = 2 * self.tree.norm**2 - 2 * self.tree.norm * kth / norms
        return self.quantile * np.maximum(best2, 0.0) * (1 + 1e-9) + 1e-9 * self.tree.norm**2

    def block(self, queries, query_ids, kth, points, ids) -> np.ndarray:
        norms = np.sqrt((queries**2).sum(1))
        far2 = _distances2(self.tree.project_queries(queries), self.tree.project(points))
        kth = kth.copy()
        found = np.zeros(0, _FOUND)
        inside = np.zeros(far2.shape, dtype=bool)
        for share in RADII:
            limit = self.radius2(kth, norms) * share**2
            fresh = (far2 <= limit[:, None]) & ~inside
            inside |= fresh
            columns = np.flatnonzero(fresh.any(0))
            rows = np.flatnonzero(fresh.any(1))
            if len(columns):
                scores = queries[rows] @ points[columns].T
                floor = kth[rows] - SLACK * norms[rows] * self.tree.norm
                a, b = np.nonzero(fresh[np.ix_(rows, columns)] & (scores >= floor[:, None]))
                a, b = rows[a], columns[b]
                other = ids[b] != query_ids[a]
                found = np.concatenate([found, self._exact(queries, points, ids, a[other], b[other])])
                found = _best(found, self.k)
                kth = np.maximum(kth, _kth(found, len(queries), self.k))
        return found

    def _exact(self, queries, points, ids, a, b, step: int = 1 << 16) -> np.ndarray:
        """Inner products pair by pair: equal vectors get equal scores."""
        out = np.zeros(len(a), _FOUND)
        out["query"], out["id"] = a, ids[b]
        for at in range(0, len(a), step):
            part = slice(at, at + step)
            out["score"][part] = (queries[a[part]] * points[b[part]]).sum(1)
        return out


def _distances2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T), 0.0)


def nearest(
    embeddings: DataFrame, query_filter, k: int = 20, confidence: float = 0.98, seed: int = 7
) -> DataFrame:
    """Per query (rows of ``embeddings`` that ``query_filter`` selects) its
    ``k`` nearest other rows by inner product: ``query_id``, ``rank``,
    ``vec_id``, ``score``."""
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce(query_filter, F.lit(False)).alias("is_query"),
    )
    out_schema = "query_id long, rank int, vec_id long, score double"
    size = rows.where("vec_id is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count()
    common = size.orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], out_schema)
    d = int(common["d"])

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, largest = 0, 0.0
        for batch in batches:
            _, vectors = _matrix(batch, d)
            n += len(vectors)
            largest = max([largest, *(np.sqrt((vectors**2).sum(1)))])
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "norm": pa.array([largest], pa.float64())})

    n, norm = rows.mapInArrow(norms, "n long, norm double").agg(F.sum("n"), F.max("norm")).first()
    if not n:
        return spark.createDataFrame([], out_schema)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vec_id", "embedding").toArrow()
    vectors = np.concatenate([np.zeros((0, d)), *(_matrix(b, d)[1] for b in sample.to_batches())])
    tree = build_tree(vectors, float(norm), n, seed)
    search = _Search(tree, d, k, chi2_quantile(confidence))

    indexed = written(_assigned(rows, tree, d), "ann-rows")
    blocks = written(_blocks(indexed, tree, d), "ann-blocks")
    boxes = _boxes(blocks, tree)
    packs = written(_packs(indexed.where("is_query"), search), "ann-packs")
    first = written(_reduced(_searched(blocks, packs, search), search), "ann-first")
    further = _open_cells(packs, first, boxes, search)
    final = _reduced(first.unionByName(_searched(blocks, further, search)), search)
    return _answers(packs, final, out_schema)


def _assigned(rows: DataFrame, tree: Tree, d: int) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("vec_id").is_valid())
            places = pa.array(np.arange(batch.num_rows), pa.int64())
            place, vectors = _matrix(
                pa.RecordBatch.from_arrays([places, batch.column("embedding")], ["vec_id", "embedding"]), d
            )
            if not len(place):
                continue
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False)[place].astype(bool)
            cells = tree.cells(tree.project(vectors))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(place)),
                    pa.array(is_query),
                    pa.array(cells),
                    pa.array(tree.cells(tree.project_queries(vectors))),
                    pa.array([v.tobytes() for v in vectors], pa.binary()),
                ],
                ["vec_id", "is_query", "cell", "home", "vector"],
            )

    return rows.mapInArrow(assign, "vec_id long, is_query boolean, cell int, home int, vector binary")


def _dealt(rows: DataFrame, cell: str, size: int) -> DataFrame:
    """``rows`` sorted by cell and part; a cell has a part per ``size`` rows."""
    parts = rows.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    keyed = rows.join(F.broadcast(parts), cell).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return keyed.repartition(cell, "part").sortWithinPartitions(cell, "part", "vec_id")


def _blocks(indexed: DataFrame, tree: Tree, d: int) -> DataFrame:
    """Points of a cell in blocks, with the box of their projections."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["cell", "part"], 2 * BLOCK_ROWS):
            points = np.frombuffer(b"".join(r["vector"] for r in run)).reshape(-1, d)
            projected = tree.project(points)
            yield pa.RecordBatch.from_pydict(
                {
                    "cell": pa.array([run[0]["cell"]], pa.int32()),
                    "ids": pa.array([np.array([r["vec_id"] for r in run], dtype="<i8").tobytes()], pa.binary()),
                    "points": pa.array([points.tobytes()], pa.binary()),
                    "low": pa.array([projected.min(0).tolist()], pa.list_(pa.float64())),
                    "high": pa.array([projected.max(0).tolist()], pa.list_(pa.float64())),
                }
            )

    dealt = _dealt(indexed.select("cell", "vec_id", "vector"), "cell", BLOCK_ROWS)
    return dealt.mapInArrow(
        pack, "cell int, ids binary, points binary, low array<double>, high array<double>"
    )


def _boxes(blocks: DataFrame, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Box of each cell; the sample bounds the number of cells.  A cell
    without points has an infinite distance."""
    sides = (
        blocks.select("cell", F.posexplode(F.arrays_zip("low", "high")))
        .groupBy("cell", "pos")
        .agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"))
        .collect()
    )
    low = np.full((1 << tree.depth, DIMENSIONS), np.inf)
    high = np.full((1 << tree.depth, DIMENSIONS), np.inf)
    for r in sides:
        low[r["cell"], r["pos"]], high[r["cell"], r["pos"]] = r["low"], r["high"]
    return low, high


_PACK = "pack long, cell int, at binary, query_ids binary, queries binary, kth binary"


def _packs(queries: DataFrame, search: _Search) -> DataFrame:
    """Queries of one home cell in packs; ``at`` is a query's place in its
    pack and ``kth`` the score it has to reach."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        for run in _runs(batches, ["home", "part"], PACK_ROWS):
            ids = np.array([r["vec_id"] for r in run], dtype="<i8")
            vectors = np.frombuffer(b"".join(r["vector"] for r in run)).reshape(len(run), -1)
            yield _pack_row(
                base + number, run[0]["home"], np.arange(len(run)), ids, vectors, np.full(len(run), -np.inf)
            )
            number += 1

    dealt = _dealt(queries.select("home", "vec_id", "vector"), "home", PACK_ROWS)
    return dealt.mapInArrow(pack, _PACK)


def _pack_row(pack: int, cell: int, at, ids, vectors, kth) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "pack": pa.array([pack], pa.int64()),
            "cell": pa.array([cell], pa.int32()),
            "at": pa.array([at.astype("<i4").tobytes()], pa.binary()),
            "query_ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
            "queries": pa.array([vectors.astype("<f8").tobytes()], pa.binary()),
            "kth": pa.array([kth.astype("<f8").tobytes()], pa.binary()),
        }
    )


def _found_row(pack: int, found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"pack": pa.array([pack], pa.int64()), "found": pa.array([found.tobytes()], pa.binary())}
    )


def _searched(blocks: DataFrame, visits: DataFrame, search: _Search) -> DataFrame:
    """Every visit joined with the blocks of its cell: ``pack``, ``found``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["at"], "<i4")
                found = search.block(
                    np.frombuffer(row["queries"], "<f8").reshape(len(at), -1),
                    np.frombuffer(row["query_ids"], "<i8"),
                    np.frombuffer(row["kth"], "<f8"),
                    np.frombuffer(row["points"], "<f8").reshape(-1, search.d),
                    np.frombuffer(row["ids"], "<i8"),
                )
                if len(found):
                    found["query"] = at[found["query"]]
                    yield _found_row(row["pack"], found)

    joined = visits.join(blocks.select("cell", "ids", "points").hint("merge"), "cell")
    return joined.mapInArrow(scan, "pack long, found binary")


def _reduced(found: DataFrame, search: _Search) -> DataFrame:
    """The k best per query of each pack, folded block by block."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, best = None, np.zeros(0, _FOUND)
        for batch in batches:
            for row in batch.to_pylist():
                if row["pack"] != pack:
                    if pack is not None:
                        yield _found_row(pack, best)
                    pack, best = row["pack"], np.zeros(0, _FOUND)
                best = _best(np.concatenate([best, np.frombuffer(row["found"], _FOUND)]), search.k)
        if pack is not None:
            yield _found_row(pack, best)

    return found.repartition("pack").sortWithinPartitions("pack").mapInArrow(fold, "pack long, found binary")


def _open_cells(packs: DataFrame, first: DataFrame, boxes, search: _Search) -> DataFrame:
    """Visits of the cells that the stopping test leaves open after the first round."""
    low, high = boxes

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["at"], "<i4")
                queries = np.frombuffer(row["queries"], "<f8").reshape(len(at), -1)
                ids = np.frombuffer(row["query_ids"], "<i8")
                kth = _kth(np.frombuffer(row["found"] or b"", _FOUND), len(at), search.k)
                limit = search.radius2(kth, np.sqrt((queries**2).sum(1)))
                projected = search.tree.project_queries(queries)
                for cell in np.flatnonzero(np.isfinite(low[:, 0])):
                    if cell == row["cell"]:
                        continue
                    outside = np.maximum(np.maximum(low[cell] - projected, projected - high[cell]), 0.0)
                    near = np.flatnonzero((outside**2).sum(1) <= limit)
                    if len(near):
                        yield _pack_row(row["pack"], int(cell), at[near], ids[near], queries[near], kth[near])

    return packs.join(first, "pack", "left").mapInArrow(visits, _PACK)


def _answers(packs: DataFrame, final: DataFrame, schema: str) -> DataFrame:
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["query_ids"], "<i8")
                found = np.frombuffer(row["found"], _FOUND)
                first = np.searchsorted(found["query"], found["query"])
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array(ids[found["query"]]),
                        "rank": pa.array((np.arange(len(found)) - first + 1).astype(np.int32)),
                        "vec_id": pa.array(found["id"].copy()),
                        "score": pa.array(found["score"].copy()),
                    }
                )

    return packs.select("pack", "query_ids").join(final, "pack").mapInArrow(answer, schema)
