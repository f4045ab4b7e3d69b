"""Text embedding (K6, K7) and synthetic vectors (K8).

The reference calls a hosted embedding model (768-d text, 1408-d multimodal).
Here the operator is ``embed_text(df, text_col, dim, backend=None)``:

* default backend: a signed hashed term-frequency vector, L2-normalised,
  computed entirely in Catalyst – whole texts are tokenised (never a prefix),
  tokens exploded, ``(row, bucket)`` counts summed with a partial+final
  aggregate (a huge document is pre-aggregated per task), and the dense vector
  rebuilt from at most ``dim`` entries per row.  Token hash: ``xxhash64``
  (default, fast) or ``md5`` (first 32 bits of MD5: any SQL engine can
  reproduce the vectors – used by the oracle-checked queries; ~10x costlier).
* ``backend=callable(list[str]) -> array (n x dim)``: a user model run in
  ``mapInPandas`` on Arrow batches.

A row with no token gets a NULL vector (the reference raises on an empty
embedding; a job should not die for one row).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.sources.tables import spread

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
TEXT_DIM = 768
MULTIMODAL_DIM = 1408
#: Bytes of vectors that a task makes at once.
BACKEND_BYTES = 4 << 20


def tokens(text: Column) -> Column:
    """Lower-cased letter/digit runs of the whole text."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def token_hash(tok: Column, method: str = "xxhash64") -> Column:
    """Non-negative 32-bit hash of a token (``md5``: portable; ``xxhash64``: faster)."""
    if method == "md5":
        return F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long")
    if method == "xxhash64":
        return F.pmod(F.xxhash64(tok), F.lit(1 << 32))
    raise ValueError("method must be 'md5' or 'xxhash64'")


def term_weights(df: DataFrame, id_col: str, text_col: str, dim: int, hash_method: str = "xxhash64") -> DataFrame:
    """``id, bucket, w``: signed token counts per hash bucket (no zero rows).

    Split, explode and drop empty tokens with plain expressions (whole-stage
    codegen); a higher-order ``filter`` lambda would run interpreted."""
    h = token_hash(F.col("tok"), hash_method)
    exploded = spread(df).select(
        F.col(id_col), F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("tok")
    ).filter(F.col("tok") != "")
    signed = exploded.select(
        id_col,
        (h % dim).cast("int").alias("bucket"),
        (F.lit(1) - 2 * (F.floor(h / dim) % 2)).cast("long").alias("sign"),
    )
    return signed.groupBy(id_col, "bucket").agg(F.sum("sign").alias("w")).filter(F.col("w") != 0)


def embed_text(df: DataFrame, text_col: str, dim: int = TEXT_DIM, id_col: str | None = None,
               out_col: str = "embedding", backend: Callable[[list[str]], np.ndarray] | None = None,
               hash_method: str = "xxhash64") -> DataFrame:
    """K6/K7: add ``out_col array<double>`` (unit length) to every row of ``df``."""
    if backend is not None:
        return _embed_with_backend(df, text_col, dim, out_col, backend)
    if id_col is None:
        raise ValueError("the hashed embedder needs a unique id column")
    w = term_weights(df, id_col, text_col, dim, hash_method)
    sparse = w.groupBy(id_col).agg(
        F.collect_list("bucket").alias("b"), F.collect_list("w").alias("w")
    )
    # joined while sparse: dense rows, mostly zeros, shrink so far in a shuffle that
    # partitions joined up by their bytes would be many times as large in a sort
    joined = df.join(sparse.withColumnsRenamed({"b": "__b", "w": "__w"}), on=id_col, how="left")
    kept = [c for c in joined.columns if c not in ("__b", "__w")]
    out_schema = T.StructType([*joined.select(kept).schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    return joined.mapInArrow(_densifier(kept, out_col, dim), out_schema)


def _densifier(kept: list[str], out_col: str, dim: int):
    """Scatter (bucket, weight) lists into unit-length dense rows, one numpy
    assignment per ``BACKEND_BYTES`` (a per-element lambda would run interpreted);
    null for a row without lists."""
    import pyarrow as pa

    step = max(1, BACKEND_BYTES // (8 * dim))

    def fn(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                n = batch.num_rows
                b, wl = batch.column("__b"), batch.column("__w")
                null = b.is_null().to_numpy(zero_copy_only=False)
                counts = np.where(null, 0, np.diff(b.offsets.to_numpy()))
                rows = np.repeat(np.arange(n), counts)
                dense = np.zeros((n, dim))
                dense[rows, b.flatten().to_numpy(zero_copy_only=False)] = wl.flatten().to_numpy(
                    zero_copy_only=False
                )
                with np.errstate(invalid="ignore"):
                    dense /= np.sqrt(np.einsum("ij,ij->i", dense, dense))[:, None]
                offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
                vectors = pa.ListArray.from_arrays(offsets, pa.array(dense.ravel(), pa.float64()), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], vectors], [*kept, out_col])

    return fn


def _embed_with_backend(df, text_col, dim, out_col, backend):
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    rows = max(1, BACKEND_BYTES // (8 * dim))

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), rows):
                pdf = whole.iloc[at : at + rows].copy()
                texts = pdf[text_col].fillna("").tolist()
                mat = np.asarray(backend(texts), dtype=np.float64)
                if mat.shape != (len(texts), dim):
                    raise ValueError(f"embedding backend returned {mat.shape}, expected {(len(texts), dim)}")
                pdf[out_col] = [row for row in mat]
                yield pdf

    return df.mapInPandas(fn, schema)


def synthetic_vector(key: Column, dim: int, seed: int = 0, hash_method: str = "xxhash64") -> Column:
    """K8: ``dim`` values uniform in [-1, 1) derived from ``key`` and ``seed``.

    Hash based, so the same key gives the same vector whatever the
    partitioning or re-execution (``rand()`` depends on the partition).
    ``md5`` (52 bits of the MD5 of ``key-i-seed``) gives vectors any SQL
    engine reproduces; ``xxhash64`` is faster."""
    if hash_method == "md5":
        scale = float(1 << 52)

        def value(i: Column) -> Column:
            text = F.concat_ws("-", key.cast("string"), i.cast("string"), F.lit(str(seed)))
            return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / scale * 2 - 1

    elif hash_method == "xxhash64":
        scale = float(1 << 53)

        def value(i: Column) -> Column:
            return (F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(1 << 53)).cast("double") / scale) * 2 - 1

    else:
        raise ValueError("hash_method must be 'md5' or 'xxhash64'")
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), value)
