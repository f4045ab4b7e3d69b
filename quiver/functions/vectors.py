"""Vector column functions, evaluated on whole Arrow batches.

Per-element vector arithmetic written as Catalyst higher-order functions
(``transform`` / ``aggregate`` lambdas) runs interpreted, element by element,
outside whole-stage codegen (about 1 µs per component).  These helpers are
Arrow scalar UDFs instead: one numpy pass over the flattened values of a batch
(a few ns per component), still used as ordinary ``Column`` expressions.

All arithmetic is in double.  A NULL vector gives NULL; a pair of vectors of
different widths gives a NULL score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

# The four metrics of a collection and whether a larger score is
# better (similarities) or a smaller one (distances).
METRICS: dict[str, bool] = {"Cosine": True, "Dot": True, "Euclid": False, "Manhattan": False}


def check_metric(metric: str) -> bool:
    """Return True if larger scores are better; raise for an unknown metric."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {list(METRICS)}")
    return METRICS[metric]


# ---------------------------------------------------------------- Arrow helpers


def lists(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(values float64, row offsets from 0, null mask)`` of a list array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    off = arr.offsets.to_numpy().astype(np.int64)
    vals = arr.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False)
    return vals.astype(np.float64), off - off[0], arr.is_null().to_numpy(zero_copy_only=False)


def row_sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each row segment ``x[off[i]:off[i+1]]`` (0 for an empty row)."""
    lens = np.diff(off)
    out = np.zeros(len(lens))
    nz = lens > 0
    if nz.any():
        out[nz] = np.add.reduceat(x, off[:-1][nz])
    return out


def list_array(values: np.ndarray, off: np.ndarray, null: np.ndarray, value_type=pa.float64()) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(off, pa.int32()), pa.array(values, value_type), mask=pa.array(null, pa.bool_())
    )


def _aligned(a: pa.Array, b: pa.Array):
    """Flattened components of two list columns paired row by row; rows with
    a NULL side or different widths are marked bad and contribute nothing."""
    xa, oa, na = lists(a)
    xb, ob, nb = lists(b)
    la, lb = np.diff(oa), np.diff(ob)
    bad = na | nb | (la != lb)
    if not bad.any() and np.array_equal(oa, ob):
        return xa, xb, oa, bad
    n = np.where(bad, 0, la)
    off = np.r_[0, np.cumsum(n)]
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(off[-1]) - off[:-1][row]
    return xa[oa[:-1][row] + within], xb[ob[:-1][row] + within], off, bad


def _pair_scores(metric: str, a: pa.Array, b: pa.Array) -> pa.Array:
    xa, xb, off, bad = _aligned(a, b)
    if metric == "Manhattan":
        s = row_sums(np.abs(xa - xb), off)
    elif metric == "Euclid":
        d = xa - xb
        s = np.sqrt(row_sums(d * d, off))
    else:
        s = row_sums(xa * xb, off)
        if metric == "Cosine":
            den = np.sqrt(row_sums(xa * xa, off) * row_sums(xb * xb, off))
            bad = bad | (den == 0)
            s = np.divide(s, den, out=np.zeros_like(s), where=den > 0)
    return pa.array(s, pa.float64(), mask=bad)


def pair_scores(metric: str, A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Scores of the rows of two matrices, by the arithmetic of :func:`score`
    (NaN where that is null)."""
    def lists_of(M: np.ndarray) -> pa.Array:
        return list_array(M.ravel(), np.arange(len(M) + 1) * M.shape[1], np.zeros(len(M), dtype=bool))

    return _pair_scores(metric, lists_of(A), lists_of(B)).to_numpy(zero_copy_only=False)


# ---------------------------------------------------------------- Column functions
# A UDF object is built per expression: building one needs a live session, and
# its JVM side belongs to the session that first runs it (so none is cached
# across sessions).


def _norm(v: pa.Array) -> pa.Array:
    x, off, null = lists(v)
    return pa.array(np.sqrt(row_sums(x * x, off)), pa.float64(), mask=null)


def _unit(v: pa.Array) -> pa.Array:
    x, off, null = lists(v)
    n = np.sqrt(row_sums(x * x, off))
    inv = np.divide(1.0, n, out=np.zeros_like(n), where=n > 0)
    return list_array(x * np.repeat(inv, np.diff(off)), off, null)


def _udf(name: str):
    if name == "norm":
        return arrow_udf(_norm, "double")
    if name == "unit":
        return arrow_udf(_unit, "array<double>")

    def pair(a: pa.Array, b: pa.Array) -> pa.Array:
        return _pair_scores(name, a, b)

    return arrow_udf(pair, "double")


def norm(v: Column) -> Column:
    """Euclidean length of each vector."""
    return _udf("norm")(v)


def l2_normalize(v: Column) -> Column:
    """Unit-length copy of each vector (``array<double>``); a zero vector stays zero."""
    return _udf("unit")(v)


def score(metric: str, a: Column, b: Column) -> Column:
    """Score of two vectors per row under a collection metric (zero norm ->
    NULL for Cosine; NULL or different widths -> NULL)."""
    check_metric(metric)
    return _udf(metric)(a, b)


def dot(a: Column, b: Column) -> Column:
    return score("Dot", a, b)


def score_against(metric: str, a: Column, vector: list[float]) -> Column:
    """Score of each vector and one given vector, which travels inside the
    function instead of being a literal of a thousand components."""
    check_metric(metric)
    q = np.asarray(vector, dtype=np.float64)

    def fn(v: pa.Array) -> pa.Array:
        x, off, null = lists(v)
        bad = null | (np.diff(off) != len(q))
        X = np.zeros((len(bad), len(q)))
        X[~bad] = x[(off[:-1][~bad, None] + np.arange(len(q))).ravel()].reshape(-1, len(q))
        if metric == "Manhattan":
            s = np.abs(X - q).sum(axis=1)
        elif metric == "Euclid":
            s = np.sqrt(((X - q) ** 2).sum(axis=1))
        else:
            s = X @ q
            if metric == "Cosine":
                den = np.sqrt(np.einsum("ij,ij->i", X, X) * (q @ q))
                bad = bad | (den == 0)
                s = np.divide(s, den, out=np.zeros_like(s), where=den > 0)
        return pa.array(s, pa.float64(), mask=bad)

    return arrow_udf(fn, "double")(a)
