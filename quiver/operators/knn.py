"""Exact k-nearest-neighbour search (K1, K2, P7, W1) as a join of blocks.

Neither side is collected or broadcast.  Points of a cell are dealt into slabs
and its queries into chunks, both by a hash of the id and both of at most
``block_bytes`` of vectors; a chunk is sent to every slab of its cell and the
other way round, and each (cell, slab, chunk) group is scored by one matrix
product::

    points  --filter--> cell, slab, chunk ----+
                                              +--> cogroup: top k per query
    queries ----------> cell, slab, chunk ----+        --> row_number() <= k

* A cell is what queries and points must agree on: a payload group (P7), a
  probed bucket (K4), both, or nothing.  Only pairs that can be answers are
  scored, and only their rows are shuffled.
* A hot cell, even one with every point, has as many slabs as its points fill,
  so no task holds more than one slab and one chunk, whatever the table sizes.
* No pair table is built: a group sends on at most ``k`` rows per query, each
  task trims its rows again (Catalyst's partial ``WindowGroupLimit``) before the
  last exchange.  ``bound_fraction`` lets a sample of the points bound each
  query's k-th score first, which cuts those rows to about ``k / fraction``.
* The payload filter runs before scoring (a filter after top-k would change
  the answer) and is pushed into the parquet scan when it is a plain
  predicate.
* Ties are broken by ascending id; a zero-norm vector has no cosine score and
  is never returned.
* :func:`candidates_within_error` is the same join for approximate vectors
  with a per-point error bound: it returns every point that may be in a
  query's top k (used by the exact search on int8 codes).
* :func:`search_one` serves a single vector without any join: one scan, one
  partial top-k per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.vectors import check_metric, pair_scores, score_against
from quiver.session import scratch_path

#: Vector bytes (as doubles) of one side of a scored group.
BLOCK_BYTES = 32 << 20
#: Rows of one side of a scored group, for narrow vectors.
BLOCK_ROWS = 1 << 14
#: Score entries (queries x points) computed at once in a task: 2^20 doubles = 8 MiB.
SCORE_TILE = 1 << 20
#: Entries of a score matrix that stay in a core's cache while components are added up.
CACHE_TILE = 1 << 16
#: A row's best entries are first looked for in this part (one in so many) of it.
SELECT_PART = 16
#: Slabs and chunks of a large join, about, as far as ``block_bytes`` allows: each row
#: is sent to the blocks of the other side, so blocks grow before their number does.
BLOCKS = 16
#: Levels of a component for bounds of Manhattan distances: two of them add up in a byte.
LEVELS = 127
#: Queries and points whose bounds are added up at once, in a core's cache.
LEVEL_TILE = (64, 1 << 10)
#: Points of a gate that stand together.
GATE_ROWS = 1 << 10
#: Pairs that are scored exactly at once.
EXACT_PAIRS = 1 << 14
#: Approximate searches of more points bound the k-th best by one in ``BOUND_PART`` of them.
BOUND_ROWS, BOUND_PART = 1 << 16, 8
#: Pairs and rows of one partition of a block join, about.
PARTITION_PAIRS, PARTITION_ROWS = 1 << 24, 1 << 16

_CELL, _SLAB, _CHUNK = "__cell", "__slab", "__chunk"
_KEY = [_CELL, _SLAB, _CHUNK]


# ---------------------------------------------------------------- scoring


def _scores(metric: str, P: np.ndarray, Q: np.ndarray, qnorm: np.ndarray) -> np.ndarray:
    """Score matrix (queries x points) in double."""
    if metric == "Manhattan":
        return _manhattan(P, Q)
    G = Q @ P.T
    if metric == "Dot":
        return G
    pn2 = np.einsum("ij,ij->i", P, P)
    if metric == "Cosine":
        den = qnorm[:, None] * np.sqrt(pn2)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            S = G / den
        S[den == 0] = np.nan
        return S
    d2 = (qnorm**2)[:, None] + pn2[None, :] - 2.0 * G
    return np.sqrt(np.maximum(d2, 0.0))


def _manhattan(P: np.ndarray, Q: np.ndarray) -> np.ndarray:
    """Sums of absolute differences, in tiles that a core's cache holds."""
    out = np.zeros((len(Q), len(P)))
    columns, step = np.ascontiguousarray(P.T), min(len(P), CACHE_TILE >> 3)
    rows = CACHE_TILE // max(1, step)
    for at in range(0, len(P), max(1, step)):
        for top in range(0, len(Q), rows):
            q, total = Q[top : top + rows], np.zeros((min(rows, len(Q) - top), min(step, len(P) - at)))
            gap = np.empty_like(total)
            for j in range(Q.shape[1]):
                np.subtract(q[:, j, None], columns[None, j, at : at + step], out=gap)
                np.abs(gap, out=gap)
                total += gap
            out[top : top + rows, at : at + step] = total
    return out


def _manhattan_pairs(P: np.ndarray, Q: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of the pairs ``(r, c)``, added up in the order of :func:`_manhattan`."""
    out = np.empty(len(r))
    for at in range(0, len(r), EXACT_PAIRS):
        some = slice(at, at + EXACT_PAIRS)
        out[some] = np.add.reduce(np.ascontiguousarray(np.abs(Q[r[some]] - P[c[some]]).T), axis=0)
    return out


class _Levels:
    """Lower bounds of Manhattan distances, from components rounded to few levels.

    With levels ``p`` and ``q`` a distance is ``step * (sum p + sum q - 2 sum min(p, q))``,
    off by at most what rounding took from both vectors.  Minima of bytes are added up,
    a multiple faster than differences of doubles; pairs that the bounds leave open are
    scored exactly.  ``fit`` is false where bounds say nothing (a component that is not
    finite, or all equal)."""

    def __init__(self, P: np.ndarray, Q: np.ndarray):
        self.P, self.Q = P, Q
        every = [X.ravel() for X in (P, Q)]
        with np.errstate(over="ignore", invalid="ignore"):
            reach = max(np.abs(x).max(initial=0.0) for x in every)  # NaN if any is
            self.fit = bool(np.isfinite(4.0 * reach * P.shape[1]))
        if not self.fit:
            return
        ends = [np.quantile(x[:: max(1, len(x) >> 18)], [0.0005, 0.9995]) for x in every]
        low, high = min(e[0] for e in ends), max(e[1] for e in ends)
        self.step = (high - low) / LEVELS
        self.fit = bool(self.step > 1e-12 * reach)
        if not self.fit:
            return
        (p, p_sum, p_miss), (q, self.q_sum, self.q_miss) = self._rounded(P, low, reach), self._rounded(Q, low, reach)
        self.p, self.q = np.ascontiguousarray(p.T), q
        # a pair's minima and the point's share of its bound, both as whole numbers above zero
        share = p_sum / 2 - p_miss / (2 * self.step)
        self.top, self.half = share.max(), p_sum / 2
        widest = max(0.0, np.ceil(LEVELS * P.shape[1] / 2 + self.top) + 1)  # no limit is above: always left open
        kind = np.uint16 if LEVELS * P.shape[1] + widest < 1 << 16 else np.uint32
        self.share = np.minimum(np.ceil(self.top - share), widest).astype(kind)

    def _rounded(self, X: np.ndarray, low: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        levels = np.clip(np.rint((X - low) / self.step), 0, LEVELS)
        miss = np.abs(X - (low + levels * self.step)).sum(axis=1) * (1 + 1e-9) + 1e-12 * reach * X.shape[1]
        return levels.astype(np.uint8), levels.sum(axis=1), miss

    def _sums(self, t: slice) -> np.ndarray:
        """Minima of the queries ``t`` and all points, with the points' shares."""
        q, (dim, n) = self.q[t], self.p.shape
        out, (high, wide) = np.empty((len(q), n), self.share.dtype), LEVEL_TILE
        for at in range(0, n, wide):
            points, share = self.p[:, at : at + wide], self.share[at : at + wide]
            for top in range(0, len(q), high):
                some = q[top : top + high]
                total = np.repeat(share[None, :], len(some), axis=0)
                one, two = np.empty(total.shape, np.uint8), np.empty(total.shape, np.uint8)
                for j in range(0, dim, 2):
                    np.minimum(some[:, j, None], points[j], out=one)
                    if j + 1 < dim:
                        np.minimum(some[:, j + 1, None], points[j + 1], out=two)
                        np.add(one, two, out=one)
                    np.add(total, one, out=total)
                out[top : top + high, at : at + wide] = total
        return out

    def nearest(self, t: slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, col, distance)`` of every pair that may be within the ``k`` best of its
        row, ties included; rows count from ``t``."""
        Q, sums = self.Q[t], self._sums(t)
        m, n = sums.shape
        part = sums[:, : n // SELECT_PART] if n // SELECT_PART >= k else sums
        first = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k]
        r, c = np.divmod(np.flatnonzero(sums >= first[:, None]), n)
        # the k that look nearest: none of the k nearest is further than the last of them
        look = sums[r, c] - self.share[c].astype(np.float64) - self.half[c]
        order = np.lexsort((-look, r))
        best = order[np.arange(len(r)) - np.searchsorted(r, np.arange(m))[r] < k]
        reach = _manhattan_pairs(self.P, Q, r[best], c[best]).reshape(m, k).max(axis=1) * (1 + 1e-9)
        limit = (self.step * self.q_sum[t] - self.q_miss[t] - reach) / (2 * self.step) + self.top
        limit = np.maximum(np.ceil(limit - 1e-3), 0)
        if (limit < first).any():
            r, c = np.divmod(np.flatnonzero(sums >= limit.astype(sums.dtype)[:, None]), n)
        else:
            near = sums[r, c] >= limit[r]
            r, c = r[near], c[near]
        if len(r) > m * n // SELECT_PART:  # the bounds leave too much open
            S = _manhattan(self.P, Q)
            r, c = _select(S, k, False)
            return r, c, S[r, c]
        return r, c, _manhattan_pairs(self.P, Q, r, c)


def _exact_refine(P: np.ndarray, Q: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Recompute Euclid candidates from differences (no cancellation error)."""
    diff = P[c] - Q[r]
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def _singles(X: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Unit-length rows in single precision; NaN for a row of zero length."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return (X / norm[:, None]).astype(np.float32)


def _ordinary(*norms: np.ndarray) -> bool:
    """Whether no product of two lengths leaves the range of a double."""
    return all((((n >= 1e-100) & (n <= 1e100)) | (n == 0)).all() for n in norms)


def _cosines(P: np.ndarray, Q: np.ndarray, pnorm: np.ndarray, qnorm: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of the pairs ``(r, c)`` in double, ``EXACT_PAIRS`` at a time."""
    out = np.empty(len(r))
    for at in range(0, len(r), EXACT_PAIRS):
        some = slice(at, at + EXACT_PAIRS)
        out[some] = np.einsum("ij,ij->i", Q[r[some]], P[c[some]]) / (qnorm[r[some]] * pnorm[c[some]])
    return out


def _select(S: np.ndarray, k: int, higher: bool, slack: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) of every entry within the k best of its row, ties included, and
    of those that ``slack`` leaves open.

    The k-th best of a part of a row bounds that of the whole row, so one
    comparison leaves few entries to be put in order."""
    n = S.shape[1]
    kk, part = min(k, n), n // SELECT_PART

    def bound(block: np.ndarray) -> np.ndarray:
        key = -block if higher else block.copy()
        key[~np.isfinite(key)] = np.inf
        t = np.partition(key, kk - 1, axis=1)[:, kk - 1 : kk]
        # scores of one point pair differ in the last bits from tile to tile
        t = t + slack * (1.0 + np.abs(t))
        return -t if higher else t

    if kk == n:
        return np.nonzero(np.isfinite(S))
    first = bound(S[:, :part] if part >= kk else S)
    with np.errstate(invalid="ignore"):
        at = np.flatnonzero(S >= first if higher else S <= first)
    r, c = np.divmod(at, n)
    s = S[r, c]
    good = np.isfinite(s)
    r, c, s = r[good], c[good], s[good]
    if part < kk or len(r) == 0:
        return r, c
    key = -s if higher else s
    order = np.lexsort((key, r))
    starts = np.searchsorted(r, np.arange(len(S)))
    counts = np.diff(np.append(starts, len(r)))
    last = order[np.minimum(starts + np.minimum(counts, kk) - 1, len(r) - 1)]
    t = np.where(counts >= kk, key[last], np.inf)
    keep = key <= (t + slack * (1.0 + np.abs(t)))[r]
    return r[keep], c[keep]


def reduce_topk(tbl: pa.Table, k: int, higher: bool, id_col: str, qcol: str = "query_id") -> pa.Table:
    """Keep the k best rows per query in an Arrow table (ties by ascending id)."""
    if tbl.num_rows == 0:
        return tbl
    q = tbl.column(qcol).to_numpy()
    ids = tbl.column(id_col).to_numpy()
    s = tbl.column("score").to_numpy()
    order = np.lexsort((ids, -s if higher else s, q))
    qs = q[order]
    starts = np.r_[0, np.flatnonzero(qs[1:] != qs[:-1]) + 1]
    first = np.repeat(starts, np.diff(np.r_[starts, len(qs)]))
    keep = order[(np.arange(len(qs)) - first) < k]
    return tbl.take(pa.array(np.sort(keep)))


def _within(found: np.ndarray, bound: np.ndarray, higher: bool) -> np.ndarray:
    """Candidates that can still be in the query's top k: not worse than the
    k-th best score of a sample of the points (``bound``; NaN = no bound).
    Compared on final scores; a small slack keeps ties up to rounding."""
    slack = 1e-9 * (1.0 + np.abs(bound))
    with np.errstate(invalid="ignore"):
        worse = found < bound - slack if higher else found > bound + slack
    return ~worse


def _matrix(tbl: pa.Table, col: str, dim: int) -> np.ndarray:
    flat = tbl.column(col).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def _floats(tbl: pa.Table, col: str) -> np.ndarray:
    return tbl.column(col).to_numpy().astype(np.float64)


def _tiles(n_queries: int, n_points: int, entries: int = SCORE_TILE):
    step = max(1, entries // n_points)
    for at in range(0, n_queries, step):
        yield slice(at, min(at + step, n_queries))


# ---------------------------------------------------------------- the join


def _sized(rows: DataFrame, name: str, per_block: int, count: str) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy(_CELL).agg(F.ceil(n / per_block).cast("int").alias(name), n.alias(count))


def _partitions(groups: int, pairs: int, rows: int) -> int:
    """Partitions for a join's groups (two at least: one would be a single-partition
    exchange): enough that pairs and rows of one stay
    bounded, a few per group so that groups seldom share one."""
    return max(2, min(4 * groups, max(-(-pairs // PARTITION_PAIRS), -(-rows // PARTITION_ROWS)), 10_000))


def block_join(points: DataFrame, queries: DataFrame, id_col: str, query_id_col: str, dim: int,
               kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every (query, point) pair, of equal ``__cell`` where the sides have one,
    given to ``kernel`` in groups: ``kernel(chunk of queries, slab of points) ->
    rows of schema``.

    Without cells the two row counts settle the numbers of slabs and chunks.
    With them a sizes table has a row per cell that both sides have; it is
    written first, so Spark broadcasts it only if its real size allows.

    The groups are dealt over as many partitions as their pairs ask for: rows
    are few beside pairs, so partitions joined up by the bytes of their rows
    would leave most cores idle."""
    per_block = max(1, min(block_bytes // (8 * dim), BLOCK_ROWS))
    if _CELL in points.columns:
        key = _KEY
        sizes = _sized(points, "__slabs", per_block, "__np").join(_sized(queries, "__chunks", per_block, "__nq"), _CELL)
        path = scratch_path(points.sparkSession, "knn-cells")
        sizes.write.parquet(path)
        sizes = points.sparkSession.read.schema(sizes.schema).parquet(path)
        slabs, chunks, n_p, n_q = (F.col(c).cast("double") for c in ("__slabs", "__chunks", "__np", "__nq"))
        total = sizes.agg(F.sum(slabs * chunks), F.sum(n_p * n_q), F.sum(n_p * chunks + n_q * slabs)).first()
        n_parts = _partitions(*[int(x or 0) for x in total])
        sizes = sizes.drop("__np", "__nq")
        points, queries = points.join(sizes, _CELL), queries.join(sizes, _CELL)
    else:
        key = _KEY[1:]
        n_p, n_q = points.count(), queries.count()
        per_block = max(1, min(block_bytes // (8 * dim), max(BLOCK_ROWS, -(-max(n_p, n_q) // BLOCKS))))
        n_slabs, n_chunks = -(-n_p // per_block), -(-n_q // per_block)
        n_parts = _partitions(n_slabs * n_chunks, n_p * n_q, n_p * n_chunks + n_q * n_slabs)
        n = {"__slabs": F.lit(n_slabs), "__chunks": F.lit(n_chunks)}
        points, queries = points.withColumns(n), queries.withColumns(n)

    def dealt(rows: DataFrame, by: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.col(by)), F.col(n_own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(n_other).cast("int") - 1))
        return rows.where(F.col(n_other) > 0).withColumn(own, mine).withColumn(other, every).drop("__slabs", "__chunks")

    q = dealt(queries, query_id_col, _CHUNK, "__chunks", _SLAB, "__slabs")
    p = dealt(points, id_col, _SLAB, "__slabs", _CHUNK, "__chunks")

    def score_group(chunk: pa.Table, slab: pa.Table) -> pa.Table:
        if chunk.num_rows == 0 or slab.num_rows == 0:
            return pa.schema([_arrow_field(f) for f in schema.fields]).empty_table()
        return kernel(chunk, slab)

    q, p = q.repartition(n_parts, *key), p.repartition(n_parts, *key)
    return q.groupBy(*key).cogroup(p.groupBy(*key)).applyInArrow(score_group, schema)


def _arrow_field(field: T.StructField) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field(field.name, to_arrow_type(field.dataType), nullable=True)


def _query_shape(queries: DataFrame, vector_col: str, group_col: str | None = None) -> tuple[int, bool]:
    """``(common vector width, whether a query has no group)`` in one
    aggregate; NULL vectors are ignored, differing widths raise."""
    free = F.count_if(F.col(group_col).isNull()) if group_col else F.lit(0)
    stats = queries.agg(F.min(F.size(vector_col)).alias("lo"), F.max(F.size(vector_col)).alias("hi"), free.alias("free")).first()
    lo, hi = stats["lo"], stats["hi"]
    if lo is not None and hi > 0 and (lo if lo > 0 else hi) != hi:
        raise ValueError(f"query vectors must share one positive width, got {lo}..{hi}")
    return int(hi or 1), bool(stats["free"])


def _in_cells(points: DataFrame, queries: DataFrame, group_match: tuple[str, str] | None,
              probe_match: tuple[str, str] | None, free: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__cell`` if they must agree on anything: one row per
    cell that a row belongs to.  A
    query without a group meets all points, in a cell that has them all."""
    if group_match:
        grp, member = F.col(group_match[0]).cast("string"), F.col(group_match[1])
        named = F.transform(F.array_distinct(F.array_compact(member)), lambda g: F.concat(F.lit("="), g.cast("string")))
        named = F.coalesce(named, F.array().cast("array<string>"))
        points = points.withColumn(_CELL, F.explode(F.concat(named, F.array(F.lit("*"))) if free else named))
        queries = queries.withColumn(_CELL, F.coalesce(F.concat(F.lit("="), grp), F.lit("*")))
    if probe_match:
        within = [_CELL] if group_match else []
        probed = F.explode(F.array_distinct(F.col(probe_match[0]).cast("array<long>")))
        queries = queries.withColumn("__probe", probed).withColumn(_CELL, F.concat_ws("|", *within, "__probe")).drop("__probe")
        points = points.withColumn(_CELL, F.concat_ws("|", *within, F.col(probe_match[1]).cast("long")))
    return points, queries


def _best(rows: DataFrame, k: int, higher: bool, id_col: str, passthrough: Sequence[str] = ()) -> DataFrame:
    order = F.desc("score") if higher else F.asc("score")
    w = Window.partitionBy("query_id").orderBy(order, F.asc(id_col))
    return (
        rows.withColumn("rank", F.row_number().over(w).cast("long"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", id_col, "score", *passthrough)
    )


def _search(points: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str, vec_col: str,
            passthrough: list[str], dim: int, block_bytes: int) -> DataFrame:
    """Top k of ``queries`` (query_id, __q, optional __cell and __bound) among ``points``."""
    higher = check_metric(metric)
    bounded = "__bound" in queries.columns
    fields = [T.StructField("query_id", T.LongType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields + [points.schema[name] for name in passthrough])
    arrow = pa.schema([_arrow_field(f) for f in schema.fields])

    def kernel(chunk: pa.Table, slab: pa.Table) -> pa.Table:
        Q, P = _matrix(chunk, "__q", dim), _matrix(slab, vec_col, dim)
        qids = chunk.column("query_id").to_numpy()
        qnorm = np.sqrt(np.einsum("ij,ij->i", Q, Q))
        bound = _floats(chunk, "__bound") if bounded else None
        kept, singles = [], False
        if metric == "Cosine":
            pnorm = np.sqrt(np.einsum("ij,ij->i", P, P))
            singles = _ordinary(pnorm, qnorm)
        if singles:
            # cosines in single precision are off by at most ``dim + 2`` roundings: those
            # that may be among the best are few, and they alone are scored in double
            unit_p, unit_q, slack = _singles(P, pnorm), _singles(Q, qnorm), 2.5 * (dim + 4) * 2.0**-24
        levels = _Levels(P, Q) if metric == "Manhattan" and len(P) > SELECT_PART * k else None
        levels = levels if levels and levels.fit else None
        for t in _tiles(len(Q), len(P), SCORE_TILE << 2 if levels else SCORE_TILE):
            if levels:
                r, c, s = levels.nearest(t, k)
            elif singles:
                r, c = _select(unit_q[t] @ unit_p.T, k, True, slack)
                s = _cosines(P, Q[t], pnorm, qnorm[t], r, c)
            else:
                S = _scores(metric, P, Q[t], qnorm[t])
                r, c = _select(S, k, higher)
                s = _exact_refine(P, Q[t], r, c) if metric == "Euclid" else S[r, c]
            if bound is not None:
                near = _within(s, bound[t][r], higher)
                r, c, s = r[near], c[near], s[near]
            took = slab.take(pa.array(c))
            cols = [pa.array(qids[t][r], pa.int64()), took.column(id_col), pa.array(s, pa.float64())]
            found = pa.table(cols + [took.column(n) for n in passthrough], schema=arrow)
            kept.append(reduce_topk(found, k, higher, id_col))
        return pa.concat_tables(kept)

    return _best(block_join(points, queries, id_col, "query_id", dim, kernel, schema, block_bytes), k, higher, id_col, passthrough)


def knn_search(
    points: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: str = "Cosine",
    *,
    id_col: str = "id",
    vector_col: str = "vector",
    query_id_col: str = "query_id",
    query_vector_col: str = "vector",
    filter: Column | None = None,
    passthrough: Sequence[str] = (),
    group_match: tuple[str, str] | None = None,
    probe_match: tuple[str, str] | None = None,
    block_bytes: int = BLOCK_BYTES,
    bound_fraction: float | None = None,
) -> DataFrame:
    """Top-``k`` points per query, best first: ``query_id, rank, id, score, *passthrough``.

    ``points`` needs an integral ``id_col`` and an array ``vector_col``;
    ``queries`` an integral, unique ``query_id_col`` and an array
    ``query_vector_col`` of one common width.  Points of another width, with
    NULL vectors or without an id are not scored (``validate_vectors`` reports
    them); a query with a NULL or empty vector gets no rows.

    ``group_match=(query_col, point_array_col)`` restricts each query to the
    points whose array contains the query's value (a per-query payload
    filter, applied before ranking; a NULL query value means no restriction).
    ``probe_match=(query_array_col, point_bucket_col)`` scores a point for a
    query only if the point's bucket is in the query's probe list (used by
    the bucketed approximate search).

    ``bound_fraction``: before the full pass, search a seeded sample of this
    share of the points; the k-th best sample score of a query is a bound no
    true top-k score can be worse than, so the full pass ships only points
    that beat it, about ``k / fraction`` candidates per query instead of
    ``k`` per slab.  Exact.  Worth its second scan where there are thousands
    of slabs (0.01, say); None: no bound.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    higher = check_metric(metric)
    dim, free = _query_shape(queries, query_vector_col, group_match[0] if group_match else None)
    if filter is not None:
        points = points.filter(filter)
    passthrough = [c for c in passthrough if c != id_col]
    points = points.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) == dim) & F.col(id_col).isNotNull())
    queries = queries.filter(F.size(query_vector_col) == dim)
    points, queries = _in_cells(points, queries, group_match, probe_match, free)
    kept = [c for c in passthrough if c != vector_col]
    cell = [_CELL] if group_match or probe_match else []
    points = points.select(F.col(id_col).cast("long").alias(id_col), vector_col, *kept, *cell)
    queries = queries.select(F.col(query_id_col).cast("long").alias("query_id"), F.col(query_vector_col).alias("__q"), *cell)
    if bound_fraction:
        sample = points.sample(fraction=bound_fraction, seed=17)
        top = _search(sample, queries, k, metric, id_col, vector_col, [], dim, block_bytes)
        kth = F.min("score") if higher else F.max("score")
        bounds = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), kth.alias("b")).filter(F.col("n") >= k)
        bounds = bounds.select("query_id", F.col("b").alias("__bound"))
        queries = queries.join(bounds, "query_id", "left").withColumn("__bound", F.coalesce("__bound", F.lit(float("nan"))))
    return _search(points, queries, k, metric, id_col, vector_col, passthrough, dim, block_bytes)


# ---------------------------------------------------------------- approximate vectors with known errors


def _intervals(metric: str, P: np.ndarray, err: np.ndarray, Q: np.ndarray, qnorm: np.ndarray):
    """``(lower, upper)`` ends of each pair's true score, NaN where there is none."""
    S = _scores(metric, P, Q, qnorm)
    # error in score space, widened for float rounding of S itself
    E = np.abs(S)
    np.nan_to_num(E, copy=False)
    E += 1.0
    E *= 1e-6
    E += (qnorm[:, None] if metric == "Dot" else 1.0) * err[None, :] * (1 + 1e-9)
    if metric == "Cosine" and not np.isfinite(S).all():
        # approximate vector of zero length: the true cosine is anywhere in [-1, 1]
        lost = ~np.isfinite(S) & np.isfinite(err)[None, :] & (qnorm > 0)[:, None]
        S[lost], E[lost] = 0.0, 1.0 + 1e-6
    with np.errstate(invalid="ignore"):
        low = S - E
        high = np.add(S, E, out=S)
    if not (np.isfinite(low).all() and np.isfinite(high).all()):
        none = ~(np.isfinite(low) & np.isfinite(high))
        low[none] = high[none] = np.nan
    return low, high


def _pair_ends(P: np.ndarray, err: np.ndarray, Q: np.ndarray, pnorm: np.ndarray, qnorm: np.ndarray, r: np.ndarray, c: np.ndarray):
    """:func:`_intervals` of the cosines of the pairs ``(r, c)`` only."""
    with np.errstate(divide="ignore", invalid="ignore"):
        S = _cosines(P, Q, pnorm, qnorm, r, c)
        E = (np.abs(S) + 1.0) * 1e-6 + err[c] * (1 + 1e-9)
    lost = ~np.isfinite(S) & np.isfinite(err[c]) & (qnorm[r] > 0)
    S[lost], E[lost] = 0.0, 1.0 + 1e-6
    return S - E, S + E


class _SingleEnds:
    """Ends of the cosines of a chunk and a slab by one product in single precision: the
    error of a point is one more component, and what rounding may add is ``slack``.  No
    cosine is further than 2 from another one, so an error of 4 leaves a pair open."""

    def __init__(self, P: np.ndarray, err: np.ndarray, Q: np.ndarray, pnorm: np.ndarray, qnorm: np.ndarray, sign: int):
        unit = _singles(P, pnorm)
        unit[pnorm == 0] = 0.0
        known = np.isfinite(err)
        width = np.where(known, sign * np.where(pnorm > 0, np.minimum(np.where(known, err, 0.0), 4.0), 4.0), -np.inf)
        self.points = np.column_stack([unit, width.astype(np.float32)]).T
        self.queries = np.column_stack([_singles(Q, qnorm), np.ones(len(Q), dtype=np.float32)])
        self.slack = 2.5 * (P.shape[1] + 16) * 2.0**-24 + 2.1e-6

    def __call__(self, t: slice) -> np.ndarray:
        return self.queries[t] @ self.points


def _row_kth(r: np.ndarray, key: np.ndarray, rows: int, k: int) -> np.ndarray:
    """The ``k``-th least ``key`` of each row number in ``r`` (ascending); infinite if there are fewer."""
    starts = np.searchsorted(r, np.arange(rows + 1))
    widest = int(np.diff(starts).max(initial=0))
    if widest < k:
        return np.full(rows, np.inf)
    if widest * rows > 4 * len(r) + SCORE_TILE:  # a few long rows
        order = np.lexsort((key, r))
        at = np.minimum(starts[:-1] + k - 1, len(r) - 1)
        return np.where(np.diff(starts) >= k, key[order[at]], np.inf)
    table = np.full((rows, widest), np.inf, dtype=key.dtype)
    table[r, np.arange(len(r)) - starts[r]] = key
    return np.partition(table, k - 1, axis=1)[:, k - 1]


def exact_units(metric: str, P: np.ndarray, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Directions of ordinary vectors in single precision, for :func:`exact_best`."""
    if metric != "Cosine":
        return None
    norms = [np.sqrt(np.einsum("ij,ij->i", X, X)) for X in (P, Q)]
    return (_singles(P, norms[0]), _singles(Q, norms[1])) if _squared(*norms) else None


def _squared(*norms: np.ndarray) -> bool:
    """Whether no product of squares of two lengths leaves the range of a double."""
    return all((((n >= 1e-70) & (n <= 1e70)) | (n == 0)).all() for n in norms)


def _near_best(metric: str, P: np.ndarray, Q: np.ndarray, r: np.ndarray, c: np.ndarray, k: int,
               units: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which of the candidate pairs (``r`` ascending) may be among the ``k`` best of their
    query, by scores that are right but for their last digits."""
    if len(r) == 0:
        return np.zeros(0, dtype=bool)
    key, loose = np.empty(len(r), dtype=np.float32 if units else np.float64), 0.0
    blocks = [slice(at, at + EXACT_PAIRS) for at in range(0, len(r), EXACT_PAIRS)]
    with np.errstate(all="ignore"):
        if units:
            for some in blocks:
                key[some] = np.einsum("ij,ij->i", units[1][r[some]], units[0][c[some]])
            key, loose = -key, 2.5 * (P.shape[1] + 4) * 2.0**-24
        elif metric in ("Cosine", "Dot"):
            norms = [np.sqrt(np.einsum("ij,ij->i", X, X)) for X in (P, Q)]
            if not _squared(*norms):
                return np.ones(len(r), dtype=bool)
            ones = [np.ones_like(n) for n in norms]
            key = -_cosines(P, Q, *(norms if metric == "Cosine" else ones), r, c)
            loose = 1e-12 * norms[1][r] * norms[0][c] if metric == "Dot" else 0.0
        else:
            pairs = _manhattan_pairs if metric == "Manhattan" else _exact_refine
            for some in blocks:
                key[some] = pairs(P, Q, r[some], c[some])
        loose = loose + 1e-9 * (1.0 + np.abs(key))
        worst = np.where(np.isfinite(key), key + loose, np.inf)
        return ~(key - loose > _row_kth(r, worst, len(Q), k)[r])


def exact_best(metric: str, P: np.ndarray, Q: np.ndarray, r: np.ndarray, c: np.ndarray, qids: np.ndarray,
               ids: np.ndarray, k: int, id_col: str, units: tuple[np.ndarray, np.ndarray] | None = None) -> pa.Table:
    """``query_id, id, score``: of the candidate pairs ``(r, c)``, ``r`` ascending, the k best of each
    query by their exact scores, ``EXACT_PAIRS`` at a time.  ``units`` are those of :func:`exact_units`."""
    higher = check_metric(metric)
    near = _near_best(metric, P, Q, r, c, k, units)
    r, c = r[near], c[near]
    scores = np.empty(len(r))
    for at in range(0, len(r), EXACT_PAIRS):
        some = slice(at, at + EXACT_PAIRS)
        scores[some] = pair_scores(metric, P[c[some]], Q[r[some]])
    good = ~np.isnan(scores)
    found = {"query_id": qids[r[good]], id_col: ids[c[good]], "score": scores[good]}
    return reduce_topk(pa.table(found), k, higher, id_col)


def _bound_points(points: DataFrame, id_col: str) -> DataFrame:
    """All points of a small table, a share of a large one: the k-th best score among
    any of the points bounds the k-th best of all."""
    if points.count() <= BOUND_ROWS:
        return points
    return points.filter(F.pmod(F.xxhash64(F.lit(23), F.col(id_col)), F.lit(BOUND_PART)) == 0)


def candidates_within_error(points: DataFrame, queries: DataFrame, k: int = 10, metric: str = "Cosine",
                            *, id_col: str = "id", vector_col: str = "vector", error_col: str = "error",
                            query_id_col: str = "query_id", query_vector_col: str = "vector",
                            block_bytes: int = BLOCK_BYTES, exact_col: str | None = None) -> DataFrame:
    """``query_id, id`` of every point that may be in a query's exact top k
    when ``vector_col`` is only an approximation of the true vector.

    ``exact_col``, the true vectors, lets each group score its candidates exactly
    and send on only the ``k`` best per query, so what leaves the join grows with
    the queries, whatever number of candidates the errors make necessary.

    ``error_col`` bounds the approximation per point in score units: for Dot
    ``|p - p~|_2`` (scaled by ``|q|`` here), for Cosine ``2 |p - p~|_2 / |p|``
    (cosine against the unit direction of ``p~``), for Euclid ``|p - p~|_2``,
    for Manhattan ``|p - p~|_1``.  The exact top k
    of each query is always inside the returned set (re-rank it exactly);
    the set has no fixed size, it is as large as the errors make necessary.

    Two passes: the first finds each query's k-th best worst-case score over
    all points (a share of many), which no true k-th best score is worse than;
    the second returns the points whose best case reaches it.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    higher = check_metric(metric)
    dim, _ = _query_shape(queries, query_vector_col)
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) == dim) & F.col(error_col).isNotNull() & F.col(id_col).isNotNull()
    exact = [F.col(exact_col).alias("__exact")] if exact_col else []
    pts = points.filter(usable).select(
        F.col(id_col).cast("long").alias(id_col), vector_col, F.col(error_col).cast("double").alias("__err"), *exact
    )
    qs = queries.filter(F.size(query_vector_col) == dim).select(
        F.col(query_id_col).cast("long").alias("query_id"), F.col(query_vector_col).alias("__q")
    )
    pair = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(id_col, T.LongType())])
    scored = T.StructType([*pair.fields, T.StructField("score", T.DoubleType())])
    bounds_of = lambda chunk, slab, t: _intervals(
        metric, _matrix(slab, vector_col, dim), _floats(slab, "__err"), chunk["Q"][t], chunk["norm"][t]
    )

    def unpack(chunk: pa.Table) -> dict[str, np.ndarray]:
        Q = _matrix(chunk, "__q", dim)
        return {"Q": Q, "norm": np.sqrt(np.einsum("ij,ij->i", Q, Q)), "id": chunk.column("query_id").to_numpy()}

    def singles(q: dict[str, np.ndarray], slab: pa.Table, sign: int):
        """Cosines of ordinary vectors: ends in single precision, and those of some pairs in double."""
        if metric != "Cosine":
            return None, None
        P, err = _matrix(slab, vector_col, dim), _floats(slab, "__err")
        pnorm = np.sqrt(np.einsum("ij,ij->i", P, P))
        if not _ordinary(pnorm, q["norm"]):
            return None, None
        ends = lambda t, r, c: _pair_ends(P, err, q["Q"][t], pnorm, q["norm"][t], r, c)
        return _SingleEnds(P, err, q["Q"], pnorm, q["norm"], sign), ends

    def worst_cases(chunk: pa.Table, slab: pa.Table) -> pa.Table:
        q, ids, kept = unpack(chunk), slab.column(id_col).to_numpy(), []
        single, ends = singles(q, slab, -1)
        for t in _tiles(len(q["id"]), slab.num_rows):
            if single:
                r, c = _select(single(t), k, True, single.slack)
                worst, _ = ends(t, r, c)
                r, c, worst = (x[np.isfinite(worst)] for x in (r, c, worst))
            else:
                low, high = bounds_of(q, slab, t)
                worst = low if higher else high
                r, c = _select(worst, k, higher)
                worst = worst[r, c]
            found = pa.table({"query_id": q["id"][t][r], id_col: ids[c], "score": worst})
            kept.append(reduce_topk(found, k, higher, id_col))
        return pa.concat_tables(kept)

    def reaching(chunk: pa.Table, slab: pa.Table) -> pa.Table:
        q, ids, kept = unpack(chunk), slab.column(id_col).to_numpy(), []
        true = _matrix(slab, "__exact", dim) if exact_col else None
        limit = _floats(chunk, "__limit")
        single, ends = singles(q, slab, 1)
        units = exact_units(metric, true, q["Q"]) if exact_col else None
        for t in _tiles(len(q["id"]), slab.num_rows):
            if single:
                least = np.where(np.isnan(limit[t]), -1e38, limit[t] - single.slack).astype(np.float32)  # an unknown error is -inf
                with np.errstate(invalid="ignore"):
                    r, c = np.divmod(np.flatnonzero(single(t) >= least[:, None]), slab.num_rows)
                    if not exact_col:
                        low, high = ends(t, r, c)
                        open_ = ~(high < limit[t][r]) & np.isfinite(low)
                        r, c = r[open_], c[open_]
            else:
                low, high = bounds_of(q, slab, t)
                with np.errstate(invalid="ignore"):
                    out = high < limit[t][:, None] if higher else low > limit[t][:, None]
                r, c = np.nonzero(~out & np.isfinite(low))
            if exact_col:
                mine = (units[0], units[1][t]) if units else None
                kept.append(exact_best(metric, true, q["Q"][t], r, c, q["id"][t], ids, k, id_col, mine))
            else:
                kept.append(pa.table({"query_id": q["id"][t][r], id_col: ids[c]}))
        return pa.concat_tables(kept)

    bounding = _bound_points(pts.drop("__exact"), id_col)
    worst = _best(block_join(bounding, qs, id_col, "query_id", dim, worst_cases, scored, block_bytes), k, higher, id_col)
    limits = worst.filter(F.col("rank") == k).select("query_id", F.col("score").alias("__limit"))
    qs = qs.join(limits, "query_id", "left").withColumn("__limit", F.coalesce("__limit", F.lit(float("nan")))).checkpoint()
    if exact_col:
        found = block_join(pts, qs, id_col, "query_id", dim, reaching, scored, block_bytes)
        return _best(found, k, higher, id_col).select("query_id", id_col)
    return block_join(pts, qs, id_col, "query_id", dim, reaching, pair, block_bytes)


# ---------------------------------------------------------------- points behind gates


def gated_search(points: DataFrame, gates: DataFrame, queries: DataFrame, k: int, metric: str, dim: int,
                 opens: Callable[[pa.Table, pa.Table], np.ndarray], *, id_col: str = "id", vector_col: str = "vector",
                 gate_col: str = "gate", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Top ``k`` of each query among the points whose gate it opens: ``query_id, rank, id, score``.

    ``gates`` has a row per gate (a leaf, a block) with what ``opens(queries, gates)
    -> bool matrix`` looks at; ``queries`` has ``query_id, __q, __home`` and what it
    looks at, ``__home`` being the gate that it is nearest to.  Which gates a query
    opens is settled where its chunk meets a slab, so no table of (query, gate)
    pairs is written or shuffled.  A slab holds points of a gate together (a large
    gate in parts) and the gates' rows beside them; queries of one home are scored
    together, and only against points of gates that one of them opens."""
    higher = check_metric(metric)
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.DoubleType())])
    gates = gates.withColumnRenamed(gate_col, "__gate")
    points = points.filter(F.size(vector_col) == dim).select(
        F.col(id_col).cast("long").alias(id_col), vector_col, F.col(gate_col).alias("__gate"))
    parts = points.groupBy("__gate").agg(F.ceil(F.count(F.lit(1)) / GATE_ROWS).cast("int").alias("__parts"))
    deal = F.xxhash64("__gate", "__part").alias("__deal")
    own = points.join(parts, "__gate").withColumn("__part", F.pmod(F.xxhash64(id_col), "__parts").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))
    beside = gates.join(parts, "__gate").withColumn("__part", every).drop("__parts")
    slabs = own.select(id_col, vector_col, "__gate", deal).unionByName(
        beside.select("*", deal).drop("__part"), allowMissingColumns=True)

    def kernel(chunk: pa.Table, slab: pa.Table) -> pa.Table:
        chunk, is_gate = chunk.sort_by("__home"), pc.is_null(slab.column(id_col))
        mine, pts = slab.filter(is_gate), slab.filter(pc.invert(is_gate))
        names, at = np.unique(mine.column("__gate").to_numpy(), return_index=True)
        mine, ids = mine.take(pa.array(at)), pts.column(id_col).to_numpy()
        if len(ids) == 0:
            return pa.schema([_arrow_field(f) for f in schema.fields]).empty_table()
        behind = np.searchsorted(names, pts.column("__gate").to_numpy())
        Q, P, qids = _matrix(chunk, "__q", dim), _matrix(pts, vector_col, dim), chunk.column("query_id").to_numpy()
        qnorm, kept = np.sqrt(np.einsum("ij,ij->i", Q, Q)), []
        for t in _tiles(len(Q), max(len(P), len(names))):
            opened = opens(chunk.slice(t.start, t.stop - t.start), mine)
            cols = np.flatnonzero(opened.any(axis=0)[behind])
            if len(cols) == 0:
                continue
            X = P if len(cols) == len(P) else P[cols]
            S = _scores(metric, X, Q[t], qnorm[t])
            if not opened.all():
                S[~opened[:, behind[cols]]] = np.nan
            r, c = _select(S, k, higher)
            s = _exact_refine(X, Q[t], r, c) if metric == "Euclid" else S[r, c]
            kept.append(reduce_topk(pa.table({"query_id": qids[t][r], id_col: ids[cols[c]], "score": s}), k, higher, id_col))
        return pa.concat_tables(kept) if kept else pa.schema([_arrow_field(f) for f in schema.fields]).empty_table()

    return _best(block_join(slabs, queries, "__deal", "query_id", dim, kernel, schema, block_bytes), k, higher, id_col)


# ---------------------------------------------------------------- a single vector


def search_one(points: DataFrame, vector: Sequence[float], k: int = 10, metric: str = "Cosine", *,
               id_col: str = "id", vector_col: str = "vector", filter: Column | None = None,
               passthrough: Sequence[str] = ()) -> DataFrame:
    """Search with a single query vector given by the caller (query_id 0).

    No join and no exchange but the last one of ``k`` rows per task: the vector
    is part of the scoring function, and ``orderBy.limit`` keeps a top-k per task."""
    higher = check_metric(metric)
    if k <= 0:
        raise ValueError("k must be positive")
    if filter is not None:
        points = points.filter(filter)
    passthrough = [c for c in passthrough if c != id_col]
    scored = points.select(
        F.col(id_col).cast("long").alias(id_col), score_against(metric, F.col(vector_col), vector).alias("score"), *passthrough
    ).filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col(id_col).isNotNull())
    best = scored.orderBy(F.desc("score") if higher else F.asc("score"), F.asc(id_col)).limit(k)
    # the limited rows are one ordered partition, so their running number is their rank
    ranked = best.withColumn("rank", F.monotonically_increasing_id() + 1).withColumn("query_id", F.lit(0).cast("long"))
    return ranked.select("query_id", "rank", id_col, "score", *passthrough)
