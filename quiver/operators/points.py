"""Points: mapping, validation, upsert, scroll, retrieve, count.

A point is ``id bigint, vectors map<string,array<float>>, payload struct<group:array<string>>``.
A collection's vector spec is a dict ``name -> (size, metric)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.vectors import check_metric


def parse_id(text: Column) -> Column:
    """Integer id from text: surrounding white space allowed, anything else NULL."""
    return F.regexp_replace(text, r"^\s+|\s+$", "").try_cast("bigint")


def to_points(rows: DataFrame, vector_name: str = "image", id_col: str = "castor",
              features_col: str = "features", groups_col: str = "groups") -> DataFrame:
    """P3 (U1): ``castor, features, groups`` -> ``id, vectors, payload`` (``castor`` kept)."""
    return rows.select(
        F.col(id_col).alias("castor"),
        parse_id(F.col(id_col)).alias("id"),
        F.create_map(F.lit(vector_name), F.col(features_col)).alias("vectors"),
        F.struct(F.col(groups_col).alias("group")).alias("payload"),
    )


def point_errors(points: DataFrame, spec: dict[str, tuple[int, str]]) -> Column:
    """Reason a point cannot be stored, or NULL (first failing rule wins).

    Rules: id must be an integer; every declared vector must be present with
    the declared width and without null, NaN or infinite components.  (A declared-but-missing name is only a warning in the
    reference's first-row probe; a stored point without it could never be
    searched, so here it is reported as ``missing_vector``.)
    """
    expr = None
    for cond, reason in _checks(spec):
        expr = F.when(cond, reason) if expr is None else expr.when(cond, reason)
    return expr


def error_reasons(spec: dict[str, tuple[int, str]]) -> list[str]:
    """Every reason that :func:`point_errors` can give, in its order."""
    return [reason for _, reason in _checks(spec)]


def _checks(spec: dict[str, tuple[int, str]]) -> list[tuple[Column, str]]:
    checks = [(F.col("id").isNull(), "id_not_integer")]
    for name, (size, metric) in spec.items():
        check_metric(metric)
        v = F.col("vectors").getItem(name)
        checks.append((v.isNull(), f"missing_vector:{name}"))
        checks.append((F.size(v) != size, f"dimension_mismatch:{name}"))
        checks.append((F.exists(v, lambda x: x.isNull()), f"null_component:{name}"))
        checks.append((F.exists(v, lambda x: F.isnan(x)), f"nan_component:{name}"))
        checks.append((F.exists(v, lambda x: F.abs(x) == float("inf")), f"infinite_component:{name}"))
    return checks


def quarantine_bad_rows(points: DataFrame, spec: dict[str, tuple[int, str]],
                        on_error: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Split into (good points, rejected rows with ``reason``).

    ``on_error="fail"`` raises if any row is rejected (one aggregate pass);
    ``"quarantine"`` keeps going like the reference does after its first row.
    """
    tagged = points.withColumn("reason", point_errors(points, spec))
    good = tagged.filter(F.col("reason").isNull()).drop("reason")
    bad = tagged.filter(F.col("reason").isNotNull())
    if on_error == "fail":
        first = bad.select("reason").limit(1).collect()
        if first:
            raise ValueError(f"point rejected: {first[0]['reason']}")
    elif on_error != "quarantine":
        raise ValueError("on_error must be 'quarantine' or 'fail'")
    return good, bad


def validate_vectors(points: DataFrame, spec: dict[str, tuple[int, str]]) -> DataFrame:
    """P5: one row per declared vector with whole-table counts (single aggregate pass).

    Columns: ``vector_name, expected_size, n_points, n_ok, n_missing,
    n_mismatch, min_size, max_size``.
    """
    aggs = [F.count(F.lit(1)).alias("n_points")]
    for i, (name, (size, metric)) in enumerate(spec.items()):
        check_metric(metric)
        v = F.col("vectors").getItem(name)
        aggs += [
            F.count_if(v.isNotNull() & (F.size(v) == size)).alias(f"ok{i}"),
            F.count_if(v.isNull()).alias(f"missing{i}"),
            F.count_if(v.isNotNull() & (F.size(v) != size)).alias(f"mismatch{i}"),
            F.min(F.size(v)).alias(f"min{i}"),
            F.max(F.size(v)).alias(f"max{i}"),
        ]
    wide = points.agg(*aggs)
    rows = [
        F.struct(
            F.lit(name).alias("vector_name"),
            F.lit(size).cast("int").alias("expected_size"),
            F.col("n_points"),
            F.col(f"ok{i}").alias("n_ok"),
            F.col(f"missing{i}").alias("n_missing"),
            F.col(f"mismatch{i}").alias("n_mismatch"),
            F.col(f"min{i}").cast("int").alias("min_size"),
            F.col(f"max{i}").cast("int").alias("max_size"),
        )
        for i, (name, (size, _)) in enumerate(spec.items())
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _hashable(field: T.StructField) -> Column:
    """The column, with a map as its entries in key order (maps can't be hashed)."""
    column = F.col(field.name)
    return F.array_sort(F.map_entries(column)) if isinstance(field.dataType, T.MapType) else column


def dedupe_by_id(points: DataFrame, id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """One row per id: the greatest ``order_col`` wins, else the greatest hash
    of all columns, so the winner doesn't depend on the order of the rows.

    ``max_by`` is a partial + final aggregate, so a hot id is reduced on the
    map side instead of landing whole in one task.
    """
    fields = [f for f in points.schema.fields if f.name != id_col]
    if not fields:
        return points.select(id_col).distinct()
    rank = F.struct(*([F.col(order_col)] if order_col else []), F.xxhash64(*[_hashable(f) for f in fields]))
    return (
        points.groupBy(id_col)
        .agg(F.max_by(F.struct(*[F.col(f.name) for f in fields]), rank).alias("_row"))
        .select(id_col, "_row.*")
    )


def fresh_rows(existing: DataFrame, new: DataFrame, id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """Rows of ``new`` (one per id, see :func:`dedupe_by_id`) whose id is not
    in ``existing``: an anti join on the id columns alone; AQE broadcasts a
    side that proves small and splits a skewed partition."""
    return dedupe_by_id(new, id_col, order_col).join(existing.select(id_col), on=id_col, how="left_anti")


def upsert(existing: DataFrame, new: DataFrame, mode: str = "insert_absent",
           id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """The collection after loading ``new`` into ``existing``.

    * ``insert_absent`` (reference default): existing ids are left unchanged,
      only new ids are added  ->  ``existing  UNION  fresh_rows(existing, new)``.
    * ``overwrite``: new rows replace existing ones with the same id
      ->  ``(existing ANTI JOIN new)  UNION  new``.
    """
    if mode == "insert_absent":
        fresh = fresh_rows(existing, new, id_col, order_col)
        return existing.unionByName(fresh.select(*existing.columns))
    if mode != "overwrite":
        raise ValueError("mode must be 'insert_absent' or 'overwrite'")
    last = dedupe_by_id(new, id_col, order_col).select(*existing.columns)
    return existing.join(new.select(id_col), on=id_col, how="left_anti").unionByName(last)


def scroll(points: DataFrame, limit: int = 1000, with_vectors: bool = True,
           id_col: str = "id") -> DataFrame:
    """First page in id order (TakeOrderedAndProject: per-task top-n, then merge)."""
    cols = [c for c in points.columns if with_vectors or c != "vectors"]
    return points.select(*cols).orderBy(id_col).limit(limit)


def retrieve(points: DataFrame, ids: DataFrame, with_payload: bool = True,
             with_vectors: bool = True, id_col: str = "id") -> DataFrame:
    """Points whose id occurs in ``ids`` (left semi join).

    The id list is made distinct first – a partial + final aggregate, so an id
    repeated across a third of the list collapses on the map side and the
    join's shuffle carries each id once per task."""
    cols = [id_col] + [c for c in points.columns if c != id_col
                       and (with_payload or c != "payload") and (with_vectors or c != "vectors")]
    return points.select(*cols).join(ids.select(id_col).distinct(), on=id_col, how="left_semi")


def count_points(points: DataFrame, filter: Column | None = None) -> DataFrame:
    """Number of points, optionally filtered (one partial+final aggregate)."""
    if filter is not None:
        points = points.filter(filter)
    return points.agg(F.count(F.lit(1)).alias("count"))


def group_filter(group: str) -> Column:
    """Payload filter 'point belongs to product group'."""
    return F.array_contains(F.col("payload.group"), F.lit(group))
