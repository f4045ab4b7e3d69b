"""Exact search that skips blocks of points by pivot bounds (K1, K2).

For a few pivots every point keeps its distances to them.  Points are stored in
blocks of neighbours, and a block knows, for each pivot, the smallest and the
largest distance of its points, and its longest vector.  By the triangle
inequality a point *x* of a block is at least

    LB(q) = max over pivots of  d(q, p) - largest,  smallest - d(q, p)

away from a query *q*, so the best score in the block is at most

    Euclid, Manhattan   LB                              (smaller is better)
    Cosine              1 - LB^2 / 2                    (on unit vectors)
    Dot                 min(|q| m, (|q|^2 + m^2 - LB^2) / 2)   with m the longest vector

(the first part of the last line is Cauchy-Schwarz).  A search scores each
query's most promising blocks first and then only those whose bound can still
reach its k-th best score: the exact answer, whatever is skipped.  How much
that is depends on the data: much where they form groups, next to nothing on
random directions in many dimensions.  :func:`skipped_share` reports it.

Queries, block summaries and points meet in block joins
(:func:`quiver.operators.knn.block_join`); only the pivots, chosen from a
bounded sample, are known everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quiver.functions.vectors import check_metric, l2_normalize, list_array, lists, norm
from quiver.operators.knn import _best, _matrix, _select, _tiles, block_join, gated_search, knn_search, reduce_topk
from quiver.session import scratch_path

#: Points among which the pivots are chosen.
PIVOT_SAMPLE = 1024


@dataclass
class PivotIndex:
    """``points``: ``id, vector, block``; ``blocks``: ``block, size, low, high, longest``."""

    points: DataFrame
    blocks: DataFrame
    pivots: np.ndarray
    metric: str


def _distances(X: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    out = np.empty((len(X), len(pivots)))
    for j, p in enumerate(pivots):
        diff = X - p
        out[:, j] = np.abs(diff).sum(axis=1) if metric == "Manhattan" else np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def _spread_out(X: np.ndarray, n: int, metric: str) -> np.ndarray:
    """Farthest-first: each pivot is the row farthest from those before it."""
    chosen = [0]
    gap = _distances(X, X[:1], metric)[:, 0]
    while len(chosen) < min(n, len(X)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, _distances(X, X[chosen[-1:]], metric)[:, 0])
    return X[chosen]


def _with_distances(df: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """``__d``: distances of ``__x`` to the pivots."""

    def measure(v: pa.Array) -> pa.Array:
        x, off, null = lists(v)
        D = _distances(x.reshape(-1, pivots.shape[1]), pivots, metric)
        return list_array(D.ravel(), np.arange(0, D.size + 1, D.shape[1]), null)

    return df.withColumn("__d", arrow_udf(measure, "array<double>")(F.col("__x")))


def _measured(df: DataFrame, vector_col: str, metric: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    if metric != "Cosine":
        return df.withColumn("__x", v)
    return df.filter(norm(F.col(vector_col)) > 0).withColumn("__x", l2_normalize(v))


def build_pivots(points: DataFrame, vector_col: str = "vector", metric: str = "Euclid", id_col: str = "id",
                 n_pivots: int = 16, block_rows: int = 256, seed: int = 5) -> PivotIndex:
    """Index ``points`` (integral ids, vectors of one width; rows without an id
    or vector, and zero vectors under Cosine, take no part)."""
    check_metric(metric)
    spark = points.sparkSession
    usable = points.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    usable = _measured(usable, "vector", metric)
    sample = usable.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(PIVOT_SAMPLE).select("__x").toArrow()
    if sample.num_rows == 0:
        empty = spark.createDataFrame([], "block long, size long, low array<double>, high array<double>, longest double")
        return PivotIndex(usable.select("id", "vector", F.lit(0).cast("long").alias("block")), empty, np.zeros((1, 1)), metric)
    pivots = _spread_out(_matrix(sample, "__x", len(sample.column("__x")[0])), n_pivots, metric)

    # neighbours stand together: by the nearest pivot, then the second nearest, then the distance
    placed = _with_distances(usable, pivots, metric)
    nearest = F.array_min("__d")
    home = F.array_position("__d", nearest)
    second = F.array_position("__d", F.array_min(F.array_remove(F.col("__d"), nearest)))
    # salted beyond the distance, so equal points are dealt over ranges as well
    order = [home, F.coalesce(second, F.lit(0)), nearest, F.xxhash64("id")]
    ranged = placed.withColumns({f"__o{i}": c for i, c in enumerate(order)})
    keys = [f"__o{i}" for i in range(len(order))]
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "vector", "__d", norm(F.col("vector")).alias("__norm"))
    schema = T.StructType([*ranged.schema.fields, T.StructField("block", T.LongType())])

    def number(batches):
        seen = TaskContext.get().partitionId() << 36
        at = 0
        for batch in batches:
            rows = np.arange(at, at + batch.num_rows) // block_rows
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen + rows, pa.int64())], names=[*batch.schema.names, "block"])

    path = scratch_path(spark, "pivot-points")
    ranged.mapInArrow(number, schema).write.parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    each = stored.select("block", "id", "__norm", F.posexplode("__d").alias("j", "d"))
    ends = each.groupBy("block", "j").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    boxes = ends.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("j", "low", "high"))).alias("e"))
    sizes = stored.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.max("__norm").alias("longest"))
    blocks = boxes.join(sizes, "block").select("block", "size", F.col("e.low").alias("low"), F.col("e.high").alias("high"), "longest")
    return PivotIndex(stored.select("id", "vector", "block"), blocks.checkpoint(), pivots, metric)


def _bests(metric: str, chunk: pa.Table, slab: pa.Table, t: slice, m: int) -> np.ndarray:
    """The best score that each block can hold for the queries of a tile."""
    D = _matrix(chunk, "__q", m)[t]
    low, high = _matrix(slab, "low", m), _matrix(slab, "high", m)
    LB = np.zeros((len(D), len(low)))
    for j in range(m):
        np.maximum(LB, D[:, j, None] - high[None, :, j], out=LB)
        np.maximum(LB, low[None, :, j] - D[:, j, None], out=LB)
    LB = np.maximum(LB - 1e-9 * (1.0 + LB), 0.0)  # distances are rounded
    if metric in ("Euclid", "Manhattan"):
        return LB
    if metric == "Cosine":
        return 1.0 - LB * LB / 2.0
    q = chunk.column("__norm").to_numpy()[t][:, None]
    longest = slab.column("longest").to_numpy()[None, :]
    return np.minimum(q * longest, (q * q + longest * longest - LB * LB) / 2.0)


def _blocks_of(index: PivotIndex, asked: DataFrame, keep, schema: str) -> DataFrame:
    """``keep(query ids, block ids, best scores, limits) -> table`` over queries x blocks."""
    m, metric = len(index.pivots), index.metric
    fields = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("block", T.LongType())])
    if schema == "scored":
        fields = fields.add("score", T.DoubleType())

    def kernel(chunk: pa.Table, slab: pa.Table) -> pa.Table:
        ids, blocks, limit = (c.to_numpy() for c in (chunk.column("query_id"), slab.column("block"), chunk.column("limit")))
        return pa.concat_tables([
            keep(ids[t], blocks, _bests(metric, chunk, slab, t, m), limit[t]) for t in _tiles(len(ids), len(blocks))
        ])

    qs = asked.select("query_id", F.col("__d").alias("__q"), "__norm", "limit")
    return block_join(index.blocks, qs, "block", "query_id", 2 * m, kernel, fields)


def pivot_search(index: PivotIndex, queries: DataFrame, k: int = 10, first: int = 4, query_id_col: str = "query_id",
                 query_vector_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """``(exact top k: query_id, rank, id, score; scored blocks: query_id, block)``.

    ``first``: blocks per query that are scored before the others are judged.
    Which of the others may hold an answer is settled in the groups that score
    them (:func:`quiver.operators.knn.gated_search`); the second frame lists the
    blocks and is computed only if it is read."""
    metric, higher = index.metric, check_metric(index.metric)
    usable = queries.filter(F.size(query_vector_col) == index.pivots.shape[1]).select(
        F.col(query_id_col).cast("long").alias("query_id"), F.col(query_vector_col).cast("array<double>").alias("vector")
    )
    asked = _with_distances(_measured(usable, "vector", metric), index.pivots, metric)
    asked = asked.select("query_id", "vector", "__d", norm(F.col("vector")).alias("__norm")).checkpoint()

    def promising(ids, blocks, best, _):
        r, c = _select(best, first, higher)
        found = pa.table({"query_id": ids[r], "block": blocks[c], "score": best[r, c]})
        return reduce_topk(found, first, higher, "block")

    none = F.lit(float("nan")).alias("limit")
    tried = _best(_blocks_of(index, asked.withColumn("limit", none), promising, "scored"), first, higher, "block")
    tried = tried.select("query_id", "block").checkpoint()

    pairs = tried.join(asked.select("query_id", "vector"), "query_id").withColumn("blocks", F.array("block"))
    top = knn_search(index.points, pairs, k=k, metric=metric, probe_match=("blocks", "block")).checkpoint()
    limits = top.filter(F.col("rank") == k).select("query_id", F.col("score").alias("limit"))
    home = tried.groupBy("query_id").agg(F.min("block").alias("__home"))
    limited = asked.join(limits, "query_id", "left").withColumn("limit", F.coalesce("limit", none)).checkpoint()

    def reach(best: np.ndarray, limit: np.ndarray) -> np.ndarray:
        slack = 1e-9 * (1.0 + np.abs(limit))
        with np.errstate(invalid="ignore"):
            return ~(best < (limit - slack)[:, None] if higher else best > (limit + slack)[:, None])

    def reaching(ids, blocks, best, limit):
        r, c = np.nonzero(reach(best, limit))
        return pa.table({"query_id": ids[r], "block": blocks[c]})

    m, dim = len(index.pivots), index.pivots.shape[1]

    def may_hold(chunk: pa.Table, blocks: pa.Table) -> np.ndarray:
        chunk = chunk.rename_columns({"__q": "vector", "__d": "__q"})
        return reach(_bests(metric, chunk, blocks, slice(0, chunk.num_rows), m), chunk.column("limit").to_numpy())

    # blocks tried before are looked at again: their best rows come with the others'
    # by the query's id, as the first blocks are: rows that share one are asked together
    vectors = asked.select("query_id", F.col("vector").alias("__q"))
    qs = limited.drop("vector").join(vectors, "query_id").join(home, "query_id", "left")
    found = gated_search(index.points, index.blocks, qs, k, metric, dim, may_hold, gate_col="block")
    rest = _blocks_of(index, limited, reaching, "pairs").join(tried, ["query_id", "block"], "left_anti")
    return found, tried.unionByName(rest)


def skipped_share(index: PivotIndex, scored: DataFrame, queries: DataFrame) -> DataFrame:
    """``pairs, skipped``: scored (query, point) pairs, and the share of all that never were."""
    one = F.lit(1).alias("one")
    pairs = scored.join(index.blocks, "block").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("pairs")).select(one, "pairs")
    points = index.blocks.agg(F.sum("size").alias("points")).select(one, "points")
    asked = queries.agg(F.count(F.lit(1)).alias("asked")).select(one, "asked")
    both = pairs.join(points, "one").join(asked, "one")
    return both.select("pairs", (1 - F.col("pairs") / (F.col("points") * F.col("asked"))).alias("skipped"))
