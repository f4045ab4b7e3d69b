"""Residual product codes: the exact answer from few candidates."""

import numpy as np
import pyarrow as pa
import pytest

from quiver.operators import knn, product_codes, quantize

METRICS = ["Cosine", "Dot", "Euclid", "Manhattan"]


def _frames(spark, P, Q):
    row = lambda i, v: (i, v if v is None else [None if x is None else float(x) for x in v])
    pts = spark.createDataFrame([row(i, v) for i, v in enumerate(P)], "id long, vector array<double>")
    qs = spark.createDataFrame([row(i, v) for i, v in enumerate(Q)], "query_id long, vector array<double>")
    return pts.repartition(3), qs


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())


@pytest.mark.parametrize("metric", METRICS)
def test_equals_exact_search(spark, metric):
    """Random directions of an odd width with ties, a far outlier, and vectors that can't be encoded."""
    rng = np.random.default_rng(3)
    P = [*rng.normal(size=(600, 7)), *[np.ones(7)] * 40, np.zeros(7), 900.0 * np.arange(7), None, [], [1.0], [None] * 7]
    Q = [*rng.normal(size=(12, 7)), np.ones(7), np.zeros(7)]
    pts, qs = _frames(spark, P, Q)
    books = product_codes.fit(pts, cells=4, sample_rows=300, rounds=4)
    got, cand = product_codes.search(product_codes.encode(pts, books), qs, books, k=6, metric=metric)
    whole = pts.filter("size(vector) = 7 and vector[0] is not null")
    assert _rows(got) == _rows(knn.knn_search(whole, qs, k=6, metric=metric))
    assert cand.dropDuplicates().count() == cand.count()


def test_fewer_candidates_than_int8(spark):
    rng = np.random.default_rng(4)
    P, Q = rng.normal(size=(4000, 16)), rng.normal(size=(20, 16))
    pts, qs = _frames(spark, P, Q)
    books = product_codes.fit(pts)
    got, cand = product_codes.search(product_codes.encode(pts, books), qs, books, k=10)
    assert _rows(got) == _rows(knn.knn_search(pts, qs, k=10))
    coded, b = quantize.quantize(pts)
    approx = coded.select("id", quantize.dequantize(coded.codes, b).alias("v"),
                          quantize.score_error("Cosine", coded.qerr).alias("e"))
    int8 = knn.candidates_within_error(approx, qs, k=10, vector_col="v", error_col="e")
    assert 200 <= cand.count() < int8.count() / 2


def test_codes_and_errors(spark):
    rng = np.random.default_rng(6)
    pts, _ = _frames(spark, rng.normal(size=(900, 5)), [])
    books = product_codes.fit(pts, component_group=2, stages=3, sample_rows=500)
    assert list(books.edges) == [0, 2, 4, 5] and len(books.words) == 3
    for r in product_codes.encode(pts, books).collect():
        codes = np.frombuffer(bytes(r.pq.codes), np.uint8)[None, :]
        near = {t: books.decode(np.array([r.pq.cell]), codes, t)[0] for t in (1, 3)}
        v = np.array(r.vector)
        assert r.pq.miss1 == pytest.approx(np.linalg.norm(v - near[1]), abs=1e-12)
        assert r.pq.miss == pytest.approx(np.linalg.norm(v - near[3]), abs=1e-12)
        assert r.pq.miss_l1 == pytest.approx(np.abs(v - near[3]).sum(), abs=1e-12)
        assert r.pq.len2 == pytest.approx([near[1] @ near[1], near[3] @ near[3]])


def test_small_and_empty_tables(spark):
    pts, qs = _frames(spark, [[1.0, 0.0], [0.0, 2.0]], [[1.0, 1.0]])
    for frame, expected in ((pts, [(0, 1, 0), (0, 2, 1)]), (pts.limit(0), [])):
        books = product_codes.fit(frame, width=2)
        got, _ = product_codes.search(product_codes.encode(frame, books), qs, books, k=5)
        assert _rows(got) == expected


def test_candidates_never_leave_their_group(spark, monkeypatch):
    """Codes of a few points: many candidates, but k rows a query are sent on."""
    monkeypatch.setattr(knn, "BOUND_ROWS", 100)
    rng = np.random.default_rng(5)
    pts, qs = _frames(spark, rng.normal(size=(300, 4)), rng.normal(size=(7, 4)))
    books = product_codes.fit(pts, cells=2, stages=1, sample_rows=20)
    kept, plain = [], product_codes._reaching
    monkeypatch.setattr(product_codes, "_reaching", lambda asked, exact: kept.append(plain(asked, exact)) or kept[-1])
    got, cand = product_codes.search(product_codes.encode(pts, books), qs, books, k=6)
    assert _rows(got) == _rows(knn.knn_search(pts, qs, k=6))
    assert kept[0].count() == 42 < cand.count()


def test_first_stage_in_single_precision_rules_out_no_answer(spark):
    """Zero vectors have no cosine; a far outlier, unlike the sample, stays open."""
    rng = np.random.default_rng(8)
    P = np.concatenate([rng.normal(size=(500, 7)), [np.zeros(7), 900.0 * np.arange(7)]])
    Q = np.concatenate([rng.normal(size=(11, 7)), [np.zeros(7), np.arange(7.0)]])
    pts, _ = _frames(spark, P, [])
    books = product_codes.fit(pts.where("id < 500"), cells=4, sample_rows=300, rounds=4)
    slab = product_codes.encode(pts, books).select("id", "pq.*").toArrow().sort_by("id")
    chunk = pa.table({"query_id": np.arange(len(Q)), "__q": Q.tolist()})
    block = product_codes._Block(books, "Cosine", chunk, slab, 7)
    assert block.single
    with np.errstate(invalid="ignore"):
        S = Q @ P.T / (np.linalg.norm(Q, axis=1)[:, None] * np.linalg.norm(P, axis=1))
    some = ~np.isnan(S)
    limit = np.where(some.any(axis=1), -np.sort(-np.where(some, S, -2), axis=1)[:, 5], 0.0)
    for t in (slice(0, 6), slice(6, 13)):
        r, c = block.not_out(t, limit[t], True)
        assert set(zip(*np.nonzero(some[t] & (S[t] >= limit[t][:, None])))) <= set(zip(r, c)) and some[t][r, c].all()
        assert len(r) < some[t].size / 4
        low, high = block.full(t, r, c)
        assert (low <= S[t][r, c]).all() and (S[t][r, c] <= high).all()
        r, c = block.not_out(t, np.full(t.stop - t.start, np.nan), True)
        assert len(r) == some[t].sum()
        r, c = block.likely(t, 4, True)
        assert some[t][r, c].all() and (np.bincount(r, minlength=len(S[t]))[some[t].any(axis=1)] >= 4).all()
