"""Scalar int8 quantization (K3) and search on codes with exact re-rank (K5).

The collection setting "INT8, quantile 0.99" keeps the central 99 % of all
vector components: bounds are the 0.5 % and 99.5 % percentiles of every
component of every vector, values are clamped into the bounds and mapped
linearly to 0..255.  Bounds are exact (linear interpolation) and computed
with :func:`quiver.operators.stats.percentiles_inclusive` – distributed, no
task holds all components.  Codes are stored as ``array<tinyint>`` holding
``code - 128`` (1 byte per component, 8x narrower than doubles), next to the
vector's length and its quantization error.  The error bounds every score
computed on the codes, so search on codes followed by a re-rank of the
candidates on the original vectors is exact, without a fixed candidate count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quiver.functions.vectors import check_metric, list_array, lists, row_sums, score
from quiver.operators.knn import candidates_within_error
from quiver.operators.stats import percentiles_inclusive


@dataclass(frozen=True)
class Bounds:
    lo: float
    hi: float


def fit_bounds(points: DataFrame, vector_col: str = "vector", quantile: float = 0.99) -> Bounds:
    """Bounds of the central ``quantile`` of all finite components."""
    comps = points.select(F.explode(vector_col).alias("x")).filter(F.abs("x") < float("inf"))
    p_lo = (1 - quantile) / 2
    p_hi = 1 - (1 - quantile) / 2
    got = percentiles_inclusive(comps, "x", [p_lo, p_hi])
    return Bounds(got[p_lo], got[p_hi])


def _code_values(x: np.ndarray, b: Bounds) -> np.ndarray:
    """0..255 codes: clamp into the bounds, scale, round half up."""
    span = b.hi - b.lo
    if span <= 0:
        return np.zeros(len(x), dtype=np.int64)
    return np.floor((np.minimum(np.maximum(x, b.lo), b.hi) - b.lo) / span * 255 + 0.5).astype(np.int64)


def codes(vector: F.Column, b: Bounds) -> F.Column:
    """``array<int>`` of 0..255 codes of a vector column (one numpy pass per
    Arrow batch)."""

    def to_codes(v: pa.Array) -> pa.Array:
        x, off, null = lists(v)
        return list_array(_code_values(x, b), off, null, pa.int32())

    return arrow_udf(to_codes, "array<int>")(vector)


ERROR_TYPE = "struct<norm:double,l2:double,l1:double>"


def quantize(points: DataFrame, vector_col: str = "vector", out_col: str = "codes",
             bounds: Bounds | None = None, quantile: float = 0.99,
             error_col: str = "qerr") -> tuple[DataFrame, Bounds]:
    """Add ``out_col array<tinyint>`` (code - 128) and ``error_col`` –
    ``struct<norm, l2, l1>``: the vector's length and the L2 / L1 length of
    its quantization error (24 bytes a point), which make search on the codes
    exact (:func:`knn_quantized`).  Returns the frame and the bounds."""
    b = bounds or fit_bounds(points, vector_col, quantile)
    span = b.hi - b.lo

    def to_stored(v: pa.Array) -> pa.Array:
        x, off, null = lists(v)
        return list_array((_code_values(x, b) - 128).astype(np.int8), off, null, pa.int8())

    def errors(v: pa.Array) -> pa.Array:
        x, off, null = lists(v)
        xhat = b.lo + _code_values(x, b).astype(np.float64) / 255 * span
        d = x - xhat
        cols = [np.sqrt(row_sums(x * x, off)), np.sqrt(row_sums(d * d, off)), row_sums(np.abs(d), off)]
        return pa.StructArray.from_arrays(
            [pa.array(c, pa.float64()) for c in cols], names=["norm", "l2", "l1"], mask=pa.array(null, pa.bool_())
        )

    out = points.withColumns({
        out_col: arrow_udf(to_stored, "array<tinyint>")(F.col(vector_col)),
        error_col: arrow_udf(errors, ERROR_TYPE)(F.col(vector_col)),
    })
    return out, b


def dequantize(stored: F.Column, b: Bounds) -> F.Column:
    """Code midpoints back in the vector space (``array<double>``)."""
    span = b.hi - b.lo

    def decode(v: pa.Array) -> pa.Array:
        x, off, null = lists(v)
        return list_array(b.lo + (x + 128) / 255 * span, off, null)

    return arrow_udf(decode, "array<double>")(stored)


def score_error(metric: str, err: F.Column) -> F.Column:
    """Per-point bound on |score(q, p) - score(q, p~)| (Dot: times |q|)."""
    if metric == "Manhattan":
        return err["l1"]
    if metric == "Cosine":
        return F.when(err["norm"] > 0, 2 * err["l2"] / err["norm"])
    return err["l2"]


def knn_quantized(points: DataFrame, queries: DataFrame, b: Bounds, k: int = 10, metric: str = "Cosine",
                  id_col: str = "id", codes_col: str = "codes", error_col: str = "qerr",
                  vector_col: str = "vector", query_vector_col: str = "vector") -> DataFrame:
    """K5: search on the int8 codes (narrow scan), exact re-rank on the floats.

    Exact, with no fixed number of candidates: each point's score on its
    codes is off by at most its stored quantization error (Cauchy-Schwarz /
    triangle inequality), so a point is kept only while its best possible
    score can reach the k-th best worst-case score
    (:func:`quiver.operators.knn.candidates_within_error`).  The candidates are
    scored on the original vectors where they are found, the ``k`` best per query
    (written once to the checkpoint folder) are ranked by joins on the ids; the
    answer equals the exact search.
    """
    higher = check_metric(metric)
    approx_pts = points.select(
        id_col, vector_col, dequantize(F.col(codes_col), b).alias("_dq"), score_error(metric, F.col(error_col)).alias("_err")
    )
    cand = candidates_within_error(approx_pts, queries, k=k, metric=metric, id_col=id_col,
                                   vector_col="_dq", error_col="_err", query_vector_col=query_vector_col,
                                   exact_col=vector_col)
    cand = cand.checkpoint()
    qv = queries.select("query_id", F.col(query_vector_col).alias("_qv"))
    exact = (
        points.select(id_col, vector_col)
        .join(cand, id_col)
        .join(qv, "query_id")
        .withColumn("score", score(metric, F.col(vector_col), F.col("_qv")))
        .filter(F.col("score").isNotNull())
    )
    order = F.desc("score") if higher else F.asc("score")
    w = Window.partitionBy("query_id").orderBy(order, F.asc(id_col))
    return (
        exact.withColumn("rank", F.row_number().over(w).cast("long"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", id_col, "score")
    )
