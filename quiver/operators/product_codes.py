"""Residual product codes with table-lookup distances and exact re-rank (K5).

A vector is described by the nearest of a few coarse centroids and, for each
group of neighbouring components (a subspace), by one byte a stage: the first
stage names the codeword nearest to what the centroid leaves over, each further
stage the one nearest to what the stages before it leave over.

* :func:`fit` learns the codebooks.  Coarse centroids come from ``spark.ml``
  KMeans; the codebooks of a subspace are fitted in one task per subspace, on a
  seeded sample of at most ``sample_rows`` points.  Only codebooks
  (``stages x 256 x width`` doubles) reach the driver, never points.
* :func:`encode` is one pass without a shuffle.  Every point is encoded, and
  keeps the exact lengths of what its first stage and all its stages miss, so a
  point that the sample doesn't represent costs work, never an answer.
* :func:`search` scores pairs from tables: a query's products with all codewords
  are computed once per chunk, a pair's score is a sum of entries.  The first
  stage alone rules out most pairs by its error; only the others look up
  the tables of all stages.  For cosines the first stage's codewords are looked up
  once per slab instead and multiplied with many queries at a time, which gives the
  same sums.  What may still be an answer is scored on the original
  vectors, so the result equals the exact search.  Only codes are shuffled to
  the queries: a byte per subspace and stage in place of 8 per component.

The Manhattan distance isn't a sum of products; its pairs are scored on vectors
decoded from the codes, under the same error bounds.

Points with a null vector, a null id, another width, or a length that is not
finite aren't encoded and never found; a zero vector has no cosine score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quiver.functions.vectors import check_metric, list_array, norm, score
from quiver.operators.knn import (
    EXACT_PAIRS, _best, _bound_points, _floats, _matrix, _ordinary, _query_shape, _scores, _select, _singles, _tiles, block_join,
    exact_best, exact_units, reduce_topk,
)

#: Codewords of a codebook: a code is one byte.
CODEWORDS = 256
#: Points that the codebooks are fitted on, about; every point is encoded.
SAMPLE_ROWS = 16_384
#: Vector bytes (as doubles) of one side of a scored group.
BLOCK_BYTES = 8 << 20
#: Products (points x queries) that a core's cache holds while codes are looked up.
LOOKUP_TILE = 1 << 16


@dataclass(frozen=True)
class Codebooks:
    """``coarse[c]`` is a centroid, ``words[stage][s]`` the codewords of subspace
    ``s``, which has the components ``edges[s]`` up to ``edges[s + 1]``."""

    coarse: np.ndarray
    edges: np.ndarray
    words: list[list[np.ndarray]]

    @property
    def width(self) -> int:
        return int(self.edges[-1])

    @property
    def subspaces(self) -> int:
        return len(self.edges) - 1

    def part(self, s: int) -> slice:
        return slice(int(self.edges[s]), int(self.edges[s + 1]))

    def decode(self, cell: np.ndarray, codes: np.ndarray, stages: int) -> np.ndarray:
        """Vectors of ``codes`` (rows x stages * subspaces), first ``stages`` stages."""
        X = self.coarse[cell].copy()
        for t in range(stages):
            for s in range(self.subspaces):
                X[:, self.part(s)] += self.words[t][s][codes[:, t * self.subspaces + s]]
        return X


# ---------------------------------------------------------------- fitting


def _nearest(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    """Index of the nearest row of ``C`` for each row of ``X``."""
    half = 0.5 * np.einsum("ij,ij->i", C, C)
    out = np.empty(len(X), dtype=np.int64)
    for at in range(0, len(X), 8192):
        out[at : at + 8192] = np.argmin(half[None, :] - X[at : at + 8192] @ C.T, axis=1)
    return out


def _codebook(X: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """At most ``CODEWORDS`` centroids of ``X`` (rounds of k-means from distinct rows)."""
    distinct = np.unique(X, axis=0)
    if len(distinct) <= CODEWORDS:
        return distinct
    C = distinct[rng.choice(len(distinct), CODEWORDS, replace=False)]
    for _ in range(rounds):
        mine = _nearest(X, C)
        n = np.bincount(mine, minlength=CODEWORDS)
        sums = np.column_stack([np.bincount(mine, weights=X[:, j], minlength=CODEWORDS) for j in range(X.shape[1])])
        C = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], C)
    return C


def _usable(vector: F.Column, width: int) -> F.Column:
    length = norm(vector)
    whole = vector.isNotNull() & (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull())
    return F.when(whole, length).otherwise(F.lit(None)) < float("inf")


def fit(points: DataFrame, vector_col: str = "vector", *, width: int | None = None, component_group: int = 2,
        cells: int = 16, stages: int = 2, sample_rows: int = SAMPLE_ROWS, rounds: int = 8, seed: int = 11) -> Codebooks:
    """Codebooks for vectors of ``width`` (the most frequent one if not given),
    ``component_group`` components a subspace, so ``stages / component_group``
    bytes a component.  An empty table gives a codebook with one zero codeword."""
    if width is None:
        widths = points.filter(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("w")).count()
        top = widths.orderBy(F.desc("count"), "w").first()
        width = top["w"] if top else 1
    edges = np.unique(np.append(np.arange(0, width, component_group), width))
    spark = points.sparkSession
    good = points.filter(_usable(F.col(vector_col), width)).select(F.col(vector_col).cast("array<double>").alias("v"))
    n = good.count()
    if n == 0:
        zero = [np.zeros((1, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return Codebooks(np.zeros((1, width)), edges, [zero] * stages)
    sample = good.sample(fraction=min(1.0, sample_rows / n), seed=seed) if n > sample_rows else good
    sample = sample.checkpoint()
    if sample.isEmpty():
        sample = good.limit(sample_rows)
    model = KMeans(k=max(2, cells), seed=seed, maxIter=5, featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
    coarse = np.array(model.clusterCenters())
    parts = [slice(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    rest = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def leftovers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            X = _matrix(pa.table([batch.column(0)], names=["v"]), "v", width)
            X -= coarse[_nearest(X, coarse)]
            for s, part in enumerate(parts):
                own = np.ascontiguousarray(X[:, part])
                off = np.arange(len(X) + 1) * own.shape[1]
                xs = list_array(own.ravel(), off, np.zeros(len(X), dtype=bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(X), s), pa.int32()), xs], names=["s", "x"])

    words_type = "s int, stage int, word int, x array<double>"

    def learn(group: pa.Table) -> pa.Table:
        s = group.column("s")[0].as_py()
        X = _matrix(group, "x", parts[s].stop - parts[s].start)
        X = X[np.lexsort(X.T)]  # the same codebooks whatever the order of the rows
        rng = np.random.default_rng([seed, s])
        rows: list[tuple] = []
        for stage in range(stages):
            C = _codebook(X, rng, rounds)
            rows += [(s, stage, i, c.tolist()) for i, c in enumerate(C)]
            X = X - C[_nearest(X, C)]
        names = [("s", pa.int32()), ("stage", pa.int32()), ("word", pa.int32()), ("x", pa.list_(pa.float64()))]
        columns = list(zip(*rows, strict=True))
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, names, strict=True)], names=[m for m, _ in names])

    learned = sample.mapInArrow(leftovers, rest).groupBy("s").applyInArrow(learn, words_type)
    words: list[list[list]] = [[[] for _ in parts] for _ in range(stages)]
    # stages x subspaces x 256 codewords, whatever the table's size
    for row in sorted(learned.collect(), key=lambda r: (r["s"], r["stage"], r["word"])):
        words[row["stage"]][row["s"]].append(row["x"])
    return Codebooks(coarse, edges, [[np.array(w) for w in stage] for stage in words])


# ---------------------------------------------------------------- encoding

#: What the codes miss: L2 after the first stage and after all, L1 after all.
CODE_TYPE = "struct<cell:int,codes:binary,len2:array<double>,norm:double,miss1:double,miss:double,miss_l1:double>"


def encode(points: DataFrame, books: Codebooks, vector_col: str = "vector", out_col: str = "pq") -> DataFrame:
    """``points`` with ``out_col``: cell, codes (a byte per stage and subspace),
    squared lengths of the decoded vector (after the first stage, after all), the
    vector's own length, and the exact lengths of what the codes miss.  Null for
    a vector that can't be encoded."""
    stages, n_sub, width = len(books.words), books.subspaces, books.width

    def to_codes(v: pa.Array) -> pa.Array:
        X = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        cell = _nearest(X, books.coarse)
        left = X - books.coarse[cell]
        codes = np.empty((len(X), stages * n_sub), dtype=np.uint8)
        len2, miss = [], []
        for t in range(stages):
            for s in range(n_sub):
                part, words = books.part(s), books.words[t][s]
                mine = _nearest(left[:, part], words)
                codes[:, t * n_sub + s] = mine
                left[:, part] -= words[mine]
            if t in (0, stages - 1):
                near = X - left
                len2.append(np.einsum("ij,ij->i", near, near))
                miss.append(np.sqrt(np.einsum("ij,ij->i", left, left)))
        off = pa.array(np.arange(len(X) + 1) * codes.shape[1], pa.int32())
        packed = pa.Array.from_buffers(pa.binary(), len(X), [None, off.buffers()[1], pa.py_buffer(codes.tobytes())])
        two = np.column_stack([len2[0], len2[-1]])
        columns = [
            pa.array(cell, pa.int32()), packed,
            list_array(two.ravel(), np.arange(len(X) + 1) * 2, np.zeros(len(X), dtype=bool)),
            pa.array(np.sqrt(np.einsum("ij,ij->i", X, X)), pa.float64()),
            pa.array(miss[0], pa.float64()), pa.array(miss[-1], pa.float64()),
            pa.array(np.abs(left).sum(axis=1), pa.float64()),
        ]
        return pa.StructArray.from_arrays(columns, names=["cell", "codes", "len2", "norm", "miss1", "miss", "miss_l1"])

    good = _usable(F.col(vector_col), width)
    stand_in = F.array_repeat(F.lit(0.0), width)  # a function sees every row of a batch
    safe = F.when(good, F.col(vector_col).cast("array<double>")).otherwise(stand_in)
    return points.withColumn(out_col, F.when(good, arrow_udf(to_codes, CODE_TYPE)(safe)))


# ---------------------------------------------------------------- searching


class _Block:
    """Intervals of the true scores of a chunk of queries and a slab of codes."""

    def __init__(self, books: Codebooks, metric: str, chunk: pa.Table, slab: pa.Table, dim: int):
        self.books, self.metric, self.stages = books, metric, len(books.words)
        self.Q = _matrix(chunk, "__q", dim)
        self.qnorm = np.sqrt(np.einsum("ij,ij->i", self.Q, self.Q))
        raw = slab.column("codes").combine_chunks()
        offsets = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4)
        self.codes = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(raw), -1)
        self.first_codes = np.ascontiguousarray(self.codes[:, : books.subspaces].T.astype(np.intp))
        self.cell = slab.column("cell").to_numpy()
        two = _matrix(slab, "len2", 2)
        self.len2 = {1: two[:, 0], self.stages: two[:, 1]}
        self.norm = _floats(slab, "norm")
        self.miss = {1: _floats(slab, "miss1"), self.stages: _floats(slab, "miss")}
        self.miss_l1 = _floats(slab, "miss_l1")
        if metric == "Manhattan":
            self.near = books.decode(self.cell, self.codes, self.stages)
        self.single = metric == "Cosine" and _ordinary(self.norm, self.qnorm)
        if self.single:
            self._set_singles(dim)

    def _set_singles(self, dim: int) -> None:
        """First stage's vectors over the points' lengths, and what they miss as one more
        component.  A point that they miss by more than its length is never ruled out by
        them; ``slack`` is what single precision may add."""
        with np.errstate(divide="ignore", invalid="ignore"):
            width = (self.miss[1] * (1 + 1e-9) + 1e-12 * (np.sqrt(self.len2[1]) + 2.0 * self.norm)) / self.norm
            near = self.books.decode(self.cell, self.codes, 1) / self.norm[:, None]
        far = ~(width <= 1.0)
        near[far], width[far] = 0.0, 4.0
        width[self.norm == 0] = -np.inf  # no cosine
        self.near = near.astype(np.float32)
        self.width = width.astype(np.float32)
        self.unit = _singles(self.Q, self.qnorm)
        self.slack = 5.0 * (dim + 16) * 2.0**-24

    def _ends(self, products: np.ndarray, r, c, stage: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends from approximate products; ``r`` and ``c`` index queries and points."""
        qn, pn, miss = self.qnorm[r], self.norm[c], self.miss[stage][c]
        near = np.sqrt(self.len2[stage][c])
        rounding = 1e-12 * (qn * (near + pn) + 1e-300)
        if self.metric == "Euclid":
            d2 = qn**2 + near**2 - 2.0 * products
            loose = 1e-12 * (qn**2 + near**2) + 1e-300
            slack = 1e-9 * (qn + near) + 1e-300
            low = np.sqrt(np.maximum(d2 - loose, 0.0)) - miss - slack
            return low, np.sqrt(np.maximum(d2, 0.0) + loose) + miss + slack
        spread = qn * miss * (1 + 1e-9) + rounding
        low, high = products - spread, products + spread
        if self.metric == "Cosine":
            with np.errstate(divide="ignore", invalid="ignore"):
                low, high = low / (qn * pn), high / (qn * pn)
            low, high = low - 1e-12, high + 1e-12
            none = ~(qn * pn > 0)
            low, high = np.where(none, np.nan, low), np.where(none, np.nan, high)
        return low, high

    def tables(self, t: slice) -> None:
        """Products of the queries ``t`` with all codewords: a row per codeword, so a
        code's products with all these queries are looked up together."""
        self.by_cell = self.books.coarse @ self.Q[t].T
        self.looked_up = [[w @ self.Q[t, self.books.part(s)].T for s, w in enumerate(stage)] for stage in self.books.words]

    def products(self, t: slice) -> np.ndarray:
        """Products of the queries ``t`` with all points, by the first stage's tables."""
        self.tables(t)
        width, n = self.by_cell.shape[1], len(self.cell)
        out, step = np.empty((width, n)), max(1, LOOKUP_TILE // max(1, width))
        found = np.empty((min(step, n), width))
        for at in range(0, n, step):
            some = slice(at, min(at + step, n))
            total, got = self.by_cell[self.cell[some]], found[: some.stop - at]
            for s, table in enumerate(self.looked_up[0]):
                np.take(table, self.first_codes[s, some], axis=0, out=got, mode="clip")
                total += got
            out[:, some] = total.T
        return out

    def first(self, t: slice) -> tuple[np.ndarray, np.ndarray]:
        """Ends of all pairs of the queries ``t``, by the first stage's tables."""
        if self.metric == "Manhattan":
            S = _scores("Manhattan", self.near, self.Q[t], self.qnorm[t])
            E = self.miss_l1[None, :] * (1 + 1e-9) + 1e-9 * (1 + S)
            return S - E, S + E
        rows, points = np.arange(len(self.Q))[t][:, None], np.arange(len(self.cell))[None, :]
        return self._ends(self.products(t), rows, points, 1)

    def likely(self, t: slice, k: int, higher: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (counted from ``t``) within the ``k`` best of their query by the first stage."""
        if not self.single:
            low, high = self.first(t)
            return _select((low + high) / 2, k, higher)
        self.tables(t)
        S = self.unit[t] @ self.near.T
        S[:, self.norm == 0] = np.nan
        return _select(S, k, higher)

    def not_out(self, t: slice, limit: np.ndarray, higher: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (counted from ``t``) that the first stage does not rule out."""
        if self.single:
            self.tables(t)
            S = self.unit[t] @ self.near.T
            S += self.width
            least = np.where(np.isnan(limit), -np.inf, limit - self.slack).astype(np.float32)
            with np.errstate(invalid="ignore"):
                r, c = np.divmod(np.flatnonzero(S >= least[:, None]), len(self.cell))
            some = self.norm[c] > 0
            return r[some], c[some]
        if self.metric != "Cosine":
            return np.nonzero(~_ruled_out(*self.first(t), limit[:, None], higher))
        # best case = product / (|q| |p|) + a term of the point alone; none with a zero vector
        S, near = self.products(t), np.sqrt(self.len2[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            S /= self.norm[None, :]
            S /= self.qnorm[t][:, None]
            S += ((self.miss[1] * (1 + 1e-9) + 1e-12 * (near + 2.0 * self.norm)) / self.norm)[None, :]
            r, c = np.nonzero(S >= np.where(np.isnan(limit), -np.inf, limit - 1e-12)[:, None])
        good = np.isfinite(S[r, c])
        return r[good], c[good]

    def full(self, t: slice, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the pairs ``(t.start + r, c)``, by the tables of all stages."""
        g = self.by_cell[self.cell[c], r]
        width = self.by_cell.shape[1]
        for at in range(0, len(r), EXACT_PAIRS):
            some = slice(at, at + EXACT_PAIRS)
            codes, sums = np.ascontiguousarray(self.codes[c[some]].T), g[some]
            for own, table in zip(codes, (x for tables in self.looked_up for x in tables), strict=True):
                sums += np.take(table.ravel(), own.astype(np.intp) * width + r[some], mode="clip")
        return self._ends(g, r + t.start, c, self.stages)


def _ruled_out(low: np.ndarray, high: np.ndarray, bound: np.ndarray, higher: bool) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return (high < bound if higher else low > bound) | ~np.isfinite(low) | ~np.isfinite(high)


@dataclass(frozen=True)
class _Asked:
    """Codes and bounded queries, written once, and what both passes know."""

    points: DataFrame
    queries: DataFrame
    books: Codebooks
    k: int
    metric: str
    dim: int
    id_col: str
    block_bytes: int

    def join(self, points: DataFrame, kernel, columns: list[T.StructField]) -> DataFrame:
        fields = [T.StructField("query_id", T.LongType()), T.StructField(self.id_col, T.LongType()), *columns]
        return block_join(points, self.queries, self.id_col, "query_id", self.dim, kernel, T.StructType(fields), self.block_bytes)


_SCORE = T.StructField("score", T.DoubleType())


def _bounded(encoded: DataFrame, queries: DataFrame, books: Codebooks, k: int, metric: str, id_col: str, codes_col: str,
             query_id_col: str, query_vector_col: str, block_bytes: int, exact_col: str | None) -> _Asked:
    """The first pass: queries with ``__limit``, a bound of their k-th best score."""
    if k <= 0:
        raise ValueError("k must be positive")
    higher = check_metric(metric)
    dim, _ = _query_shape(queries, query_vector_col)
    exact = [F.col(exact_col).alias("__exact")] if exact_col else []
    pts = encoded.filter(F.col(codes_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias(id_col), f"{codes_col}.*", *exact
    )
    pts = (pts if dim == books.width else pts.limit(0)).checkpoint()
    qs = queries.filter(F.size(query_vector_col) == dim).select(
        F.col(query_id_col).cast("long").alias("query_id"), F.col(query_vector_col).alias("__q")
    )
    tabled = metric != "Manhattan"

    def worst_cases(chunk: pa.Table, slab: pa.Table) -> pa.Table:
        block, kept = _Block(books, metric, chunk, slab, dim), []
        qids, ids = chunk.column("query_id").to_numpy(), slab.column(id_col).to_numpy()
        for t in _tiles(len(qids), len(ids)):
            if tabled:
                r, c = block.likely(t, 2 * k, higher)
                low, high = block.full(t, r, c)
                r, c, low, high = (x[np.isfinite(low)] for x in (r, c, low, high))
            else:
                low, high = block.first(t)
                r, c = _select((low + high) / 2, 2 * k, higher)
                low, high = low[r, c], high[r, c]
            found = {"query_id": qids[t][r], id_col: ids[c], "score": low if higher else high}
            kept.append(reduce_topk(pa.table(found), k, higher, id_col))
        return pa.concat_tables(kept)

    asked = _Asked(pts, qs, books, k, metric, dim, id_col, block_bytes)
    worst = _best(asked.join(_bound_points(pts.drop("__exact"), id_col), worst_cases, [_SCORE]), k, higher, id_col)
    limits = worst.filter(F.col("rank") == k).select("query_id", F.col("score").alias("__limit"))
    qs = qs.join(limits, "query_id", "left").withColumn("__limit", F.coalesce("__limit", F.lit(float("nan"))))
    return replace(asked, queries=qs.checkpoint())


def _reaching(asked: _Asked, exact: bool) -> DataFrame:
    """The second pass: all candidates, or the ``k`` best of them by exact scores."""
    books, k, metric, dim, id_col = asked.books, asked.k, asked.metric, asked.dim, asked.id_col
    higher, tabled = check_metric(metric), metric != "Manhattan"

    def reaching(chunk: pa.Table, slab: pa.Table) -> pa.Table:
        block, kept = _Block(books, metric, chunk, slab, dim), []
        qids, ids = chunk.column("query_id").to_numpy(), slab.column(id_col).to_numpy()
        limit = _floats(chunk, "__limit")  # NaN: fewer than k points, so none is ruled out
        true = _matrix(slab, "__exact", dim) if exact else None
        units = exact_units(metric, true, block.Q) if exact else None
        for t in _tiles(len(qids), len(ids)):
            r, c = block.not_out(t, limit[t], higher)
            if tabled:
                left = ~_ruled_out(*block.full(t, r, c), limit[t][r], higher)
                r, c = r[left], c[left]
            if exact:
                mine = (units[0], units[1][t]) if units else None
                kept.append(exact_best(metric, true, block.Q[t], r, c, qids[t], ids, k, id_col, mine))
            else:
                kept.append(pa.table({"query_id": qids[t][r], id_col: ids[c]}))
        return pa.concat_tables(kept)

    if exact:
        found = asked.join(asked.points, reaching, [_SCORE])
        return _best(found, k, higher, id_col).select("query_id", id_col)
    return asked.join(asked.points.drop("__exact"), reaching, [])


def candidates(encoded: DataFrame, queries: DataFrame, books: Codebooks, k: int = 10, metric: str = "Cosine", *,
               id_col: str = "id", codes_col: str = "pq", query_id_col: str = "query_id",
               query_vector_col: str = "vector", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, id`` of every point that may be in a query's exact top ``k``.

    Two passes over the codes: the first bounds each query's k-th best score
    by the worst cases of points that look best (of a share of many points), the
    second returns the points whose best case reaches that bound."""
    asked = _bounded(encoded, queries, books, k, metric, id_col, codes_col, query_id_col, query_vector_col, block_bytes, None)
    return _reaching(asked, exact=False)


def search(encoded: DataFrame, queries: DataFrame, books: Codebooks, k: int = 10, metric: str = "Cosine", *,
           id_col: str = "id", codes_col: str = "pq", vector_col: str = "vector",
           query_vector_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """``(query_id, rank, id, score; the candidates that were scored exactly)``.

    The answer equals :func:`quiver.operators.knn.knn_search`.  Candidates are
    scored on the original vectors in the group that finds them and never leave
    it; the ``k`` best of each query are written once to the checkpoint folder
    and ranked by joins on the ids.  The second frame lists all candidates and is
    computed only if it is read."""
    higher = check_metric(metric)
    asked = _bounded(encoded, queries, books, k, metric, id_col, codes_col, "query_id", query_vector_col, BLOCK_BYTES, vector_col)
    best = _reaching(asked, exact=True).checkpoint()
    qv = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(query_vector_col).alias("_qv"))
    exact = (
        encoded.select(F.col(id_col).cast("long").alias(id_col), vector_col)
        .join(best, id_col)
        .join(qv, "query_id")
        .withColumn("score", score(metric, F.col(vector_col), F.col("_qv")))
        .filter(F.col("score").isNotNull() & ~F.isnan("score"))
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score") if higher else F.asc("score"), F.asc(id_col))
    ranked = exact.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", id_col, "score"), _reaching(asked, exact=False)
