"""Pivot bounds: the exact answer with most pairs skipped where points form groups."""

import numpy as np
import pytest

from quiver.operators import knn, pivots

METRICS = ["Cosine", "Dot", "Euclid", "Manhattan"]


def _frames(spark, P, Q):
    pts = spark.createDataFrame([(i, v if v is None else [float(x) for x in v]) for i, v in enumerate(P)], "id long, vector array<double>")
    qs = spark.createDataFrame([(i, v if v is None else [float(x) for x in v]) for i, v in enumerate(Q)], "query_id long, vector array<double>")
    return pts.repartition(3), qs


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())


@pytest.mark.parametrize("metric", METRICS)
def test_equals_exact_search_and_skips(spark, metric):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(15, 6)) * 6
    P = centers[rng.integers(0, 15, 900)] + rng.normal(size=(900, 6)) * 0.3
    Q = centers[rng.integers(0, 15, 25)] + rng.normal(size=(25, 6)) * 0.3
    pts, qs = _frames(spark, P, Q)
    index = pivots.build_pivots(pts, metric=metric, block_rows=20)
    got, scored = pivots.pivot_search(index, qs, k=5)
    assert _rows(got) == _rows(knn.knn_search(pts, qs, k=5, metric=metric))
    share = pivots.skipped_share(index, scored, qs).first()
    assert share["skipped"] > (0.3 if metric == "Dot" else 0.6)
    assert scored.dropDuplicates().count() == scored.count()  # no block is scored twice for a query


@pytest.mark.parametrize("metric", METRICS)
def test_bounds_hold_without_structure(spark, metric):
    """Random directions, ties, a third of the points equal, zero, null and empty vectors."""
    rng = np.random.default_rng(8)
    P = [v for v in rng.normal(size=(120, 5))] + [np.ones(5)] * 60 + [np.zeros(5), None, []]
    Q = [v for v in rng.normal(size=(8, 5))] + [np.ones(5), None, []]
    pts, qs = _frames(spark, P, Q)
    index = pivots.build_pivots(pts, metric=metric, n_pivots=4, block_rows=7)
    got, _ = pivots.pivot_search(index, qs, k=8, first=1)
    assert _rows(got) == _rows(knn.knn_search(pts.filter("size(vector) = 5"), qs.filter("size(vector) = 5"), k=8, metric=metric))


def test_fewer_points_than_asked_for(spark):
    pts, qs = _frames(spark, [[1.0, 0.0], [0.0, 2.0]], [[1.0, 1.0]])
    got, scored = pivots.pivot_search(pivots.build_pivots(pts), qs, k=5)
    assert _rows(got) == [(0, 1, 0), (0, 2, 1)]
    none = pivots.build_pivots(pts.limit(0))
    assert none.blocks.count() == 0


def test_reaching_blocks_are_settled_where_they_are_scored(spark, monkeypatch):
    """Only the first few blocks of a query become rows; where the bounds skip nothing, the others don't."""
    rng = np.random.default_rng(3)
    pts, qs = _frames(spark, rng.normal(size=(200, 12)), rng.normal(size=(6, 12)))
    index = pivots.build_pivots(pts, n_pivots=3, block_rows=5)
    sent, plain = [], pivots.knn_search
    monkeypatch.setattr(pivots, "knn_search", lambda points, asked, **b: sent.append(asked.count()) or plain(points, asked, **b))
    got, scored = pivots.pivot_search(index, qs, k=5, first=2)
    assert _rows(got) == _rows(knn.knn_search(pts, qs, k=5, metric="Euclid"))
    assert sent == [12] and scored.count() > 100
