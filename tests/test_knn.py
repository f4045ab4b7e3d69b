"""kNN against brute force; the reference's integration scenario; ANN recall."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.operators import ann, knn, quantize

from paths import SF_CHECK


def test_integration_scenario(spark):
    """Two points, Dot metric, query [.9]*4, k=1 -> id 2 with its payload."""
    pts = spark.createDataFrame(
        [(1, [0.1] * 4, "London"), (2, [0.9] * 4, "Berlin")], "id long, vector array<float>, city string"
    )
    res = knn.search_one(pts, [0.9] * 4, k=1, metric="Dot", passthrough=["city"]).collect()
    assert [(r["id"], r["city"], r["rank"]) for r in res] == [(2, "Berlin", 1)]
    assert pts.count() == 2


def _brute(P, Q, metric, k):
    out = {}
    for qi, q in enumerate(Q):
        if metric == "Cosine":
            den = np.linalg.norm(P, axis=1) * np.linalg.norm(q)
            s = np.where(den > 0, P @ q / np.where(den > 0, den, 1), np.nan)
        elif metric == "Dot":
            s = P @ q
        elif metric == "Euclid":
            s = np.linalg.norm(P - q, axis=1)
        else:
            s = np.abs(P - q).sum(axis=1)
        key = -s if metric in ("Cosine", "Dot") else s
        ok = ~np.isnan(key)
        idx = np.arange(len(P))[ok]
        order = np.lexsort((idx, key[ok]))[:k]
        out[qi] = [int(idx[o]) for o in order]
    return out


@pytest.mark.parametrize("metric", ["Cosine", "Dot", "Euclid", "Manhattan"])
def test_metrics_match_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    P = rng.normal(size=(300, 8))
    P[5] = 0.0  # zero vector: no cosine score
    P[7] = P[8]  # exact tie: smaller id first
    Q = rng.normal(size=(12, 8))
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(P)], "id long, vector array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(Q)], "query_id long, vector array<double>")
    got = {}
    for r in knn.knn_search(pts.repartition(5), qs, k=7, metric=metric).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    want = _brute(P, Q, metric, 7)
    for qi in range(len(Q)):
        assert [i for _, i in sorted(got[qi])] == want[qi]
    if metric == "Cosine":
        assert all(5 not in v for v in want.values())


def test_chunked_query_set_equals_single(spark):
    rng = np.random.default_rng(5)
    pts = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(200)], "id long, vector array<double>")
    qs = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(40)], "query_id long, vector array<double>")
    one = sorted(tuple(r) for r in knn.knn_search(pts, qs, k=3).select("query_id", "rank", "id").collect())
    many = sorted(
        tuple(r) for r in knn.knn_search(pts, qs, k=3, block_bytes=400).select("query_id", "rank", "id").collect()
    )
    assert one == many


def test_group_filter_before_ranking(spark):
    pts = spark.createDataFrame(
        [(1, [1.0, 0.0], ["men"]), (2, [0.9, 0.1], ["ladies"]), (3, [0.0, 1.0], ["ladies", "men"])],
        "id long, vector array<double>, groups array<string>",
    )
    qs = spark.createDataFrame([(0, [1.0, 0.0], "ladies"), (1, [1.0, 0.0], None)], "query_id long, vector array<double>, grp string")
    res = knn.knn_search(pts, qs, k=1, group_match=("grp", "groups")).collect()
    assert {r["query_id"]: r["id"] for r in res} == {0: 2, 1: 1}


def test_quantized_rerank_and_ann_recall(spark):
    emb = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    pts = emb.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    qs = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = knn.knn_search(pts, qs, k=10)
    q, b = quantize.quantize(pts, "vector")
    assert b.lo < 0 < b.hi
    rer = quantize.knn_quantized(q, qs, b, k=10)
    assert sorted(tuple(r) for r in rer.select("query_id", "rank", "id").collect()) == sorted(
        tuple(r) for r in exact.select("query_id", "rank", "id").collect()
    )  # search on codes within their error bounds + re-rank is exact
    index, assigned = ann.build_ivf(pts, nlist=16)
    r2 = ann.recall_at_k(ann.ann_search(index, assigned, qs, k=10, nprobe=4), exact).first()["recall"]
    assert r2 >= 0.5  # random unit vectors are the hardest case for bucketing
    r_all = ann.recall_at_k(ann.ann_search(index, assigned, qs, k=10, nprobe=16), exact).first()["recall"]
    assert r_all == 1.0  # probing every bucket is exact


def test_quantization_error_within_one_step(spark):
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(i, rng.uniform(-1, 1, 4).tolist()) for i in range(100)], "id long, vector array<double>")
    q, b = quantize.quantize(pts, "vector")
    step = (b.hi - b.lo) / 255
    for r in q.select("vector", quantize.dequantize(F.col("codes"), b).alias("dq")).collect():
        for x, y in zip(r["vector"], r["dq"]):
            if b.lo <= x <= b.hi:
                assert abs(x - y) <= step / 2 + 1e-12


@pytest.mark.parametrize("metric", ["Cosine", "Dot", "Euclid", "Manhattan"])
def test_sampled_bound_is_exact(spark, metric):
    """The sample bound only removes candidates that cannot be in the top k."""
    rng = np.random.default_rng(11)
    P = rng.normal(size=(400, 6))
    P[10] = P[11]  # tie
    Q = rng.normal(size=(9, 6))
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(P)], "id long, vector array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(Q)], "query_id long, vector array<double>")
    got = {}
    for r in knn.knn_search(pts.repartition(7), qs, k=5, metric=metric, bound_fraction=0.3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    want = _brute(P, Q, metric, 5)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == want


def test_sampled_bound_with_groups_and_vector_functions(spark):
    """Group-filtered search with a bound equals the unbounded search, and the
    Arrow pair scorer agrees with numpy (NULL and width mismatch -> NULL)."""
    from quiver.functions.vectors import l2_normalize, score

    rng = np.random.default_rng(2)
    groups = ["a", "b", "c"]
    rows = [(i, rng.normal(size=4).tolist(), [groups[i % 3]] + (["b"] if i % 5 == 0 else [])) for i in range(300)]
    pts = spark.createDataFrame(rows, "id long, vector array<double>, groups array<string>")
    qs = spark.createDataFrame(
        [(i, rng.normal(size=4).tolist(), groups[i % 3] if i % 4 else None) for i in range(12)],
        "query_id long, vector array<double>, grp string",
    )
    args = dict(k=4, group_match=("grp", "groups"))
    a = sorted(tuple(r) for r in knn.knn_search(pts.repartition(4), qs, bound_fraction=None, **args).collect())
    b = sorted(tuple(r) for r in knn.knn_search(pts.repartition(4), qs, bound_fraction=0.25, **args).collect())
    assert a == b and len(a) == 48

    pairs = spark.createDataFrame(
        [([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 0.0]), (None, [1.0]), ([1.0, 2.0], [1.0])],
        "a array<double>, b array<double>",
    )
    out = pairs.select(
        score("Cosine", F.col("a"), F.col("b")).alias("c"), score("Euclid", F.col("a"), F.col("b")).alias("e"),
        score("Manhattan", F.col("a"), F.col("b")).alias("m"), score("Dot", F.col("a"), F.col("b")).alias("d"),
        l2_normalize(F.col("a")).alias("u"),
    ).collect()
    assert out[0]["c"] == pytest.approx(1.0) and out[0]["d"] == pytest.approx(25.0) and out[0]["e"] == 0.0
    assert out[0]["u"] == pytest.approx([0.6, 0.8])
    assert out[1]["c"] is None and out[1]["m"] == pytest.approx(1.0)
    assert out[2]["c"] is None and out[2]["u"] is None
    assert out[3]["e"] is None and out[3]["d"] is None


def test_null_query_vector_gets_no_rows(spark):
    """A query without a vector must not shift the other queries' vectors."""
    pts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    qs = spark.createDataFrame(
        [(10, None), (11, [0.0, 1.0]), (12, [1.0, 0.0]), (13, None)], "query_id long, vector array<double>"
    )
    got = sorted((r["query_id"], r["id"]) for r in knn.knn_search(pts, qs, k=1).collect())
    assert got == [(11, 2), (12, 1)]


def test_stored_ivf_equals_in_memory_and_prunes(spark):
    import contextlib
    import io

    from quiver.session import scratch_path

    emb = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    pts = emb.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    qs = emb.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index, assigned = ann.build_ivf(pts, nlist=16)
    mem = sorted(tuple(r) for r in ann.ann_search(index, assigned, qs, k=5, nprobe=1).collect())
    path = scratch_path(spark, "ivf-test")
    ann.write_ivf(assigned, path)
    res = ann.ann_search(index, spark.read.parquet(path), qs, k=5, nprobe=1)
    assert sorted(tuple(r) for r in res.collect()) == mem
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        res.explain("formatted")
    assert "PartitionFilters: [" in buf.getvalue() and "bucket" in buf.getvalue()


@pytest.mark.parametrize("metric", ["Cosine", "Dot", "Euclid", "Manhattan"])
def test_quantized_search_is_exact(spark, metric):
    """Codes + stored error bounds + re-rank equal brute force, also with
    components clamped outside the quantization bounds and near-ties."""
    rng = np.random.default_rng(7)
    P = rng.normal(size=(250, 6))
    P[:5] *= 8  # far outside the central 99 %: clamped, large error
    P[20] = P[21] + 1e-7  # near tie
    Q = rng.normal(size=(8, 6))
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(P)], "id long, vector array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(Q)], "query_id long, vector array<double>")
    q, b = quantize.quantize(pts.repartition(3), "vector")
    got = {}
    for r in quantize.knn_quantized(q, qs, b, k=6, metric=metric).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    want = _brute(P, Q, metric, 6)
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == want


def test_candidates_within_error_chunked_equals_single(spark):
    rng = np.random.default_rng(9)
    pts = spark.createDataFrame(
        [(i, rng.normal(size=5).tolist(), float(rng.uniform(0, 0.05))) for i in range(150)],
        "id long, vector array<double>, error double",
    )
    qs = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(30)], "query_id long, vector array<double>")
    one = sorted(tuple(r) for r in knn.candidates_within_error(pts, qs, k=4, metric="Euclid").collect())
    many = sorted(tuple(r) for r in knn.candidates_within_error(pts, qs, k=4, metric="Euclid", block_bytes=300).collect())
    assert one == many
    exact = {(r["query_id"], r["id"]) for r in knn.knn_search(pts, qs, k=4, metric="Euclid").collect()}
    assert exact <= set(one)  # the exact answer is always inside the candidates


@pytest.mark.parametrize("metric", ["Cosine", "Euclid", "Dot", "Manhattan"])
def test_exact_ivf_equals_brute_force(spark, metric):
    """Probed buckets first, then every bucket the radius bound cannot rule out."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 5)) * 3
    P = centers[rng.integers(0, 6, 300)] + rng.normal(size=(300, 5))
    Q = rng.normal(size=(10, 5)) * 2
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(P)], "id long, vector array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(Q)], "query_id long, vector array<double>")
    index, assigned = ann.build_ivf(pts, metric=metric, nlist=8, seed=3)
    got = {}
    for r in ann.ann_search(index, assigned, qs, k=5, nprobe=1, exact=True).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    want = _brute(P, Q, metric, 5)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == want


@pytest.mark.parametrize("metric", ["Cosine", "Euclid"])
def test_targeted_search_reaches_its_recall(spark, metric):
    """Clustered points: the stated recall at a fraction of the pairs; an
    infinite ratio probes everything and is exact."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(20, 8)) * 4
    P = centers[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 8))
    Q = centers[rng.integers(0, 20, 60)] + rng.normal(size=(60, 8))
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(P)], "id long, vector array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(Q)], "query_id long, vector array<double>")
    index = ann.build_leaves(pts.repartition(4), metric=metric, leaf_rows=48)
    assert index.points.count() == 1500 and index.centroids.count() >= 20
    exact = knn.knn_search(pts, qs, k=10, metric=metric)
    found, probed = ann.targeted_search(index, qs, k=10, recall=0.9)
    assert ann.recall_at_k(found, exact).first()["recall"] >= 0.9
    assert ann.scored_share(index, probed, qs).first()["share"] < 0.5
    every, _ = ann.targeted_search(index, qs, k=10, ratio=float("inf"))
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in every.collect()) == sorted(
        (r["query_id"], r["rank"], r["id"]) for r in exact.collect())


def test_leaves_with_a_hot_point_and_missing_vectors(spark):
    """A third of the points on one spot, null, empty and zero vectors."""
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(300)]
    rows += [(300, None), (301, []), (302, [0.0, 0.0, 0.0])]
    pts = spark.createDataFrame(rows, "id long, vector array<double>")
    qs = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, None)], "query_id long, vector array<double>")
    index = ann.build_leaves(pts, metric="Cosine", leaf_rows=16)
    found, _ = ann.targeted_search(index, qs, k=5)
    assert [r["id"] for r in found.orderBy("rank").collect()] == [0, 3, 6, 9, 12]
    assert index.points.count() == 301


@pytest.mark.parametrize("hot", ["men", None])
def test_hot_group_is_dealt_over_slabs(spark, hot):
    """A third of the points in one payload group, blocks far smaller than it."""
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=4).tolist(), [hot] if i % 3 == 0 else [f"g{i % 7}", "rest"]) for i in range(240)]
    pts = spark.createDataFrame(rows, "id long, vector array<double>, groups array<string>").repartition(3)
    qs = spark.createDataFrame([(i, rng.normal(size=4).tolist(), g) for i, g in enumerate(["men", "rest", "g1", "none", None] * 3)],
                               "query_id long, vector array<double>, grp string")
    big, small = (
        sorted((r["query_id"], r["rank"], r["id"]) for r in knn.knn_search(pts, qs, k=6, group_match=("grp", "groups"), block_bytes=b).collect())
        for b in (1 << 20, 320)
    )
    assert big == small and len(big) == 3 * 6 * (3 + (hot is not None))


def test_no_query_row_leaves_the_executors(spark, monkeypatch):
    """Neither collected, nor sent to the driver as Arrow, nor broadcast by hand."""
    pts = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, vector array<double>")
    qs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(30)], "query_id long, vector array<double>")

    def refuse(*_, **__):
        raise AssertionError("rows to the driver")

    frame = type(pts)
    collect = frame.collect

    def sizes_only(self):
        assert set(self.columns) == {"lo", "hi", "free"}  # one row: widths, and whether a query has no group
        return collect(self)

    with monkeypatch.context() as m:
        for name in ("toArrow", "toPandas", "toLocalIterator"):
            m.setattr(frame, name, refuse)
        m.setattr(frame, "collect", sizes_only)
        m.setattr(type(spark.sparkContext), "broadcast", refuse)
        found = knn.knn_search(pts, qs, k=3, metric="Euclid")
    assert found.count() == 90


@pytest.mark.parametrize("metric", ["Cosine", "Dot", "Euclid", "Manhattan"])
def test_single_vector_equals_the_join(spark, metric):
    rng = np.random.default_rng(20)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)] + [(200, None), (201, [1.0]), (202, [0.0] * 6), (None, [1.0] * 6)]
    pts = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    q = rng.normal(size=6).tolist()
    one = [(r["rank"], r["id"]) for r in knn.search_one(pts, q, k=9, metric=metric).collect()]
    qs = spark.createDataFrame([(0, q)], "query_id long, vector array<double>")
    assert one == sorted((r["rank"], r["id"]) for r in knn.knn_search(pts, qs, k=9, metric=metric).collect())


def test_groups_of_a_block_join_are_dealt_by_their_pairs(spark, monkeypatch):
    """Few bytes but many pairs: adaptive execution must not join the groups up into one task."""
    monkeypatch.setattr(knn, "BLOCK_ROWS", 8)
    monkeypatch.setattr(knn, "PARTITION_PAIRS", 64, raising=False)
    rows = spark.range(64).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("__q"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType())])

    def pairs(chunk, slab):
        q, p = chunk.column("query_id").to_numpy(), slab.column("id").to_numpy()
        return pa.table({"query_id": np.repeat(q, len(p)), "id": np.tile(p, len(q))})

    for cell in (False, True):
        sides = [d.withColumn("__cell", F.lit("a")) if cell else d for d in (rows, asked)]
        joined = knn.block_join(*sides, "id", "query_id", 2, pairs, schema)
        found = joined.withColumn("task", F.spark_partition_id()).collect()
        assert len({(r["query_id"], r["id"]) for r in found}) == len(found) == 64 * 64
        assert len({r["task"] for r in found}) > 16


def test_manhattan_in_tiles(monkeypatch):
    monkeypatch.setattr(knn, "CACHE_TILE", 24, raising=False)
    rng = np.random.default_rng(3)
    for n_points, n_queries in ((1, 1), (7, 5), (40, 9)):
        P, Q = rng.standard_normal((n_points, 6)), rng.standard_normal((n_queries, 6))
        assert np.allclose(knn._scores("Manhattan", P, Q, None), np.abs(Q[:, None] - P[None]).sum(axis=2), rtol=1e-12)


@pytest.mark.parametrize("higher", [True, False])
def test_select_bounds_a_row_by_a_part_of_it(higher):
    """The same entries as by ordering each row whole, with ties, NaN and infinities."""
    rng = np.random.default_rng(2)
    S = rng.integers(0, 300, size=(40, 900)).astype(float)
    S[rng.random(S.shape) < 0.05] = np.nan
    S[rng.random(S.shape) < 0.05] = np.inf
    S[0], S[1, 4:], S[2] = np.nan, np.nan, 7.0
    for k in (1, 5, 60, 1000):
        want = set()
        for r, row in enumerate(S):
            good = np.flatnonzero(np.isfinite(row))
            key = -row[good] if higher else row[good]
            if len(good):
                edge = np.sort(key)[min(k, len(key)) - 1]
                want |= {(r, int(c)) for c in good[key <= edge + 1e-9 * (1 + abs(edge))]}
        assert set(zip(*map(np.ndarray.tolist, knn._select(S, k, higher)), strict=True)) == want


@pytest.mark.parametrize("metric", ["Cosine", "Manhattan"])
def test_candidates_scored_where_they_are_found(spark, metric, monkeypatch):
    """Errors that rule nothing out: k rows a query leave the join, not every pair."""
    monkeypatch.setattr(knn, "BOUND_ROWS", 100)
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(i, rng.normal(size=4).tolist(), 50.0) for i in range(200)], "id long, v array<double>, error double")
    qs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "query_id long, vector array<double>")
    got = knn.candidates_within_error(pts, qs, k=3, metric=metric, vector_col="v", exact_col="v", block_bytes=1000)
    exact = knn.knn_search(pts, qs, k=3, metric=metric, vector_col="v")
    assert sorted(map(tuple, got.collect())) == sorted((r["query_id"], r["id"]) for r in exact.collect())


def test_probed_leaves_are_settled_where_they_are_scored(spark, monkeypatch):
    """No row per (query, leaf) is made for the search itself; a hot leaf comes in parts."""
    monkeypatch.setattr(knn, "GATE_ROWS", 7)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist() if i % 2 else [1.0, 2.0, 3.0, 4.0]) for i in range(300)]
    pts = spark.createDataFrame(rows, "id long, vector array<double>")
    qs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(20)], "query_id long, vector array<double>")
    index = ann.build_leaves(pts, metric="Euclid", leaf_rows=16)
    matched, plain = [], ann.knn_search
    monkeypatch.setattr(ann, "knn_search", lambda *a, **b: matched.append(b.get("probe_match")) or plain(*a, **b))
    found, _ = ann.targeted_search(index, qs, k=5, ratio=float("inf"))
    exact = plain(pts, qs, k=5, metric="Euclid")
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert key(found) == key(exact) and matched and not any(matched)


def test_cosines_closer_than_single_precision(spark):
    """The candidates come from single precision, their order and scores from double."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    P = np.vstack([base + 1e-5 * rng.normal(size=(40, 8)), rng.normal(size=(40, 8)), np.zeros((1, 8)), [base * 1e150]])
    Q = np.vstack([base, rng.normal(size=8), np.zeros(8)])
    pts = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(P)], "id long, vector array<double>")
    qs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(Q)], "query_id long, vector array<double>")
    for points, rows in ((pts, P), (pts.where("id < 81"), P[:81])):  # with and without a length beyond the ordinary
        found = knn.knn_search(points, qs, k=5, metric="Cosine").collect()
        for i in (0, 1):
            mine = sorted((r for r in found if r["query_id"] == i), key=lambda r: r["rank"])
            with np.errstate(invalid="ignore"):
                s = (rows @ Q[i]) / (np.linalg.norm(rows, axis=1) * np.linalg.norm(Q[i]))
            best = np.lexsort((np.arange(len(rows)), -np.nan_to_num(s, nan=-2)))[:5]
            assert np.allclose([r["score"] for r in mine], s[best], rtol=0, atol=1e-14)
            assert set(np.round(s[[r["id"] for r in mine]], 13)) == set(np.round(s[best], 13))
        assert not [r for r in found if r["query_id"] == 2 or r["id"] == 80]


@pytest.mark.parametrize("dim", [1, 7, 64, 300])
def test_manhattan_levels_leave_few_pairs_open(dim):
    """Bounds from rounded components give the distances of the plain kernel, whatever the scale and shape of the data."""
    rng = np.random.default_rng(dim)
    normal, heavy = rng.normal(size=(2000, dim)), rng.standard_cauchy(size=(2000, dim))
    far = normal.copy()
    far[:30] *= 1e6
    few = rng.integers(0, 3, size=(2000, dim)).astype(float)
    for P in (normal, heavy, far, few, normal * 1e200, normal * 1e-200):
        Q, k = np.concatenate([P[:9], rng.permutation(P)[:9]]), 6
        S = knn._manhattan(P, Q)
        levels = knn._Levels(P, Q)
        assert levels.fit
        for t in (slice(0, 11), slice(11, 18)):
            r, c, s = levels.nearest(t, k)
            assert (s == S[t][r, c]).all()
            kth = np.sort(S[t], axis=1)[:, k - 1]
            assert (np.bincount(r[s <= kth[r]], minlength=len(kth)) == (S[t] <= kth[:, None]).sum(axis=1)).all()
            assert P is few or dim == 1 or len(r) < 0.07 * S[t].size
    assert not knn._Levels(np.ones((50, dim)), np.ones((3, dim))).fit
    assert not knn._Levels(np.full((50, dim), np.inf), np.ones((3, dim))).fit


def test_manhattan_search_by_levels(spark, monkeypatch):
    """A slab of many points is searched by levels: distances on a grid, many of them equal."""
    rng = np.random.default_rng(12)
    P, Q = np.round(rng.normal(size=(700, 5)), 1), np.round(rng.normal(size=(9, 5)), 1)
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(P)], "id long, vector array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(Q)], "query_id long, vector array<double>")
    got = sorted((r.query_id, r["rank"], r.id) for r in knn.knn_search(pts, qs, k=5, metric="Manhattan").collect())
    S = knn._manhattan(P, Q)
    assert got == sorted((i, j + 1, int(c)) for i, s in enumerate(S) for j, c in enumerate(np.lexsort((np.arange(len(P)), s))[:5]))


@pytest.mark.parametrize("metric", ["Cosine", "Dot", "Euclid", "Manhattan"])
def test_candidates_are_trimmed_before_they_are_scored(monkeypatch, metric):
    """Of all pairs as candidates few are scored by the final arithmetic; ties, zero vectors and far points included."""
    rng = np.random.default_rng(3)
    P, Q, k = np.round(rng.normal(size=(900, 6)), 1), np.round(rng.normal(size=(7, 6)), 1), 5
    P[10:20], P[20], P[21], Q[2] = P[30], 0.0, 1e6, 0.0
    r, c = np.divmod(np.arange(7 * 900), 900)
    whole = knn.pair_scores(metric, P[c], Q[r])
    good = ~np.isnan(whole)
    tbl = pa.table({"query_id": r[good], "id": c[good], "score": whole[good]})
    scored, plain = [], knn.pair_scores
    monkeypatch.setattr(knn, "pair_scores", lambda m, a, b: scored.append(len(a)) or plain(m, a, b))
    got = knn.exact_best(metric, P, Q, r, c, np.arange(7), np.arange(900), k, "id")
    assert got.equals(knn.reduce_topk(tbl, k, knn.check_metric(metric), "id"))
    assert sum(scored) < 3000  # a zero query scores all points alike
    assert knn.exact_best(metric, P, Q, r[:0], c[:0], np.arange(7), np.arange(900), k, "id").num_rows == 0


def test_single_precision_ends_enclose_those_in_double():
    rng = np.random.default_rng(5)
    P, Q = rng.normal(size=(500, 9)) * rng.uniform(1e-3, 1e3, (500, 1)), rng.normal(size=(20, 9))
    err = rng.uniform(0, 0.3, 500)
    P[3], Q[4], err[5], err[6], err[7] = 0.0, 0.0, np.nan, np.inf, 9.0
    pnorm, qnorm = np.linalg.norm(P, axis=1), np.linalg.norm(Q, axis=1)
    low, high = knn._intervals("Cosine", P, err, Q, qnorm)
    r, c = np.divmod(np.arange(low.size), 500)
    ends = [x.reshape(20, 500) for x in knn._pair_ends(P, err, Q, pnorm, qnorm, r, c)]
    known = np.isfinite(low)
    assert (known == (np.isfinite(ends[0]) & np.isfinite(ends[1]))).all()
    assert np.allclose(ends[0][known], low[known], atol=1e-12) and np.allclose(ends[1][known], high[known], atol=1e-12)
    above, below = knn._SingleEnds(P, err, Q, pnorm, qnorm, 1), knn._SingleEnds(P, err, Q, pnorm, qnorm, -1)
    every = slice(0, 20)
    near = known & (high < 3.9)
    assert (above(every)[near] + above.slack >= high[near]).all()
    assert (above(every)[known] + above.slack >= np.minimum(high[known], 1.0)).all()
    assert (below(every)[near] <= low[near] + below.slack).all()
    assert not np.isfinite(above(every)[~known]).any()
