"""Points: mapping, validation, upsert (FIXTURES part A and B)."""

import pytest
from pyspark.sql import functions as F

from quiver.operators import collection, points
from quiver.session import scratch_path

RAW = "castor string, features array<float>, groups array<string>"


def test_mapper_ids(spark):
    raw = spark.createDataFrame(
        [("12", [0.1, 0.2], ["men"]), (" 12 ", [0.1, 0.2], ["men"]), ("abc", [0.1, 0.2], []), (None, None, None)], RAW
    )
    ids = [r["id"] for r in points.to_points(raw).collect()]
    assert ids == [12, 12, None, None]


def test_quarantine_and_validation(spark):
    raw = spark.createDataFrame(
        [("1", [0.1], ["a"]), ("x", [0.1], ["a"]), ("3", [0.1, 0.2], ["a"]), ("4", None, ["a"])], RAW
    )
    pts = points.to_points(raw)
    good, bad = points.quarantine_bad_rows(pts, {"image": (1, "Cosine")})
    assert [r["id"] for r in good.collect()] == [1]
    reasons = {r["castor"]: r["reason"] for r in bad.collect()}
    assert reasons == {"x": "id_not_integer", "3": "dimension_mismatch:image", "4": "missing_vector:image"}
    with pytest.raises(ValueError, match="dimension_mismatch|id_not_integer|missing"):
        points.quarantine_bad_rows(pts, {"image": (1, "Cosine")}, on_error="fail")
    v = points.validate_vectors(pts, {"image": (1, "Cosine")}).first()
    assert (v["n_points"], v["n_ok"], v["n_missing"], v["n_mismatch"]) == (4, 2, 1, 1)
    with pytest.raises(ValueError):
        points.validate_vectors(pts, {"image": (1, "Hamming")})


SCH = "id long, v string"


def test_upsert_insert_absent_and_overwrite(spark):
    old = spark.createDataFrame([(1, "old"), (2, "old")], SCH)
    new = spark.createDataFrame([(2, "new"), (3, "new"), (3, "new2")], SCH)
    ins = dict(points.upsert(old, new).collect())
    assert ins[1] == "old" and ins[2] == "old" and ins[3] in ("new", "new2")
    assert points.upsert(old, new).count() == 3
    ov = dict(points.upsert(old, new, mode="overwrite").collect())
    assert ov[1] == "old" and ov[2] == "new"
    empty = spark.createDataFrame([], SCH)
    assert sorted(points.upsert(old, empty).collect()) == sorted(old.collect())
    # loading the same batch twice equals loading it once
    once = points.upsert(old, new)
    twice = points.upsert(once, new)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_dedupe_order_column(spark):
    new = spark.createDataFrame([(3, "a", 1), (3, "b", 2)], "id long, v string, t int")
    assert points.dedupe_by_id(new, order_col="t").first()["v"] == "b"


def test_scroll_retrieve_count(spark):
    pts = spark.createDataFrame(
        [(i, {"image": [float(i)]}, (["men"] if i % 2 else ["ladies"],)) for i in range(10)],
        "id long, vectors map<string,array<float>>, payload struct<group:array<string>>",
    )
    assert [r["id"] for r in points.scroll(pts, limit=3).collect()] == [0, 1, 2]
    assert "vectors" not in points.scroll(pts, 3, with_vectors=False).columns
    ids = spark.createDataFrame([(3,), (3,), (42,)], "id long")
    assert [r["id"] for r in points.retrieve(pts, ids).collect()] == [3]
    assert points.count_points(pts).first()["count"] == 10
    assert points.count_points(pts, points.group_filter("men")).first()["count"] == 5


def test_collection_lifecycle(spark):
    path = scratch_path(spark, "coll-test")
    assert collection.create(spark, path, "c", {"image": (2, "Cosine")})
    assert not collection.create(spark, path, "c", {"image": (2, "Cosine")})
    assert collection.spec(spark, path) == {"image": (2, "Cosine")}
    new = spark.createDataFrame(
        [(1, {"image": [0.1, 0.2]}, (["men"],))], collection.POINT_SCHEMA
    )
    collection.load(spark, path, new)
    collection.load(spark, path, new)  # idempotent by id
    cur = collection.current(spark, path)
    assert cur.count() == 1
    info = collection.info(cur).first()
    assert (info["points_count"], info["min_dim"], info["zero_vectors"]) == (1, 2, 0)


def _pts(spark, rows):
    return spark.createDataFrame([(i, {"image": v}, ([g],)) for i, v, g in rows], collection.POINT_SCHEMA)


def test_collection_loads(spark):
    """Insert-if-absent loads add only fresh ids; an overwrite load replaces by id."""
    path = scratch_path(spark, "coll-loads")
    collection.create(spark, path, "c", {"image": (2, "Dot")})

    def state():
        return sorted((r["id"], r["payload"]["group"][0]) for r in collection.current(spark, path).collect())

    collection.load(spark, path, _pts(spark, [(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a")]))
    collection.load(spark, path, _pts(spark, [(2, [5.0, 5.0], "b"), (3, [1.0, 1.0], "b")]))  # 2 kept, 3 added
    assert state() == [(1, "a"), (2, "a"), (3, "b")]
    collection.load(spark, path, _pts(spark, [(1, [2.0, 2.0], "c")]), check_existing=False)
    assert state() == [(1, "c"), (2, "a"), (3, "b")]
    collection.load(spark, path, _pts(spark, [(4, [0.5, 0.5], "d"), (1, [9.0, 9.0], "x")]))
    assert state() == [(1, "c"), (2, "a"), (3, "b"), (4, "d")]


def test_loads_enforce_the_spec(spark):
    path = scratch_path(spark, "coll-spec")
    collection.create(spark, path, "c", {"image": (2, "Cosine")})
    rows = [(1, [1.0, 0.0], "ok"), (2, [1.0], "narrow"), (None, [1.0, 0.0], "no id"), (3, [1.0, None], "null"),
            (4, [1.0, float("nan")], "nan")]
    bad = collection.load(spark, path, _pts(spark, rows))
    assert {r["reason"] for r in bad.collect()} == {
        "dimension_mismatch:image", "id_not_integer", "null_component:image", "nan_component:image"}
    assert [r["id"] for r in collection.current(spark, path).collect()] == [1]
    with pytest.raises(ValueError, match="dimension_mismatch"):
        collection.load(spark, path, _pts(spark, rows[1:2]), on_error="fail")


def test_duplicate_ids_have_one_winner_in_any_order(spark):
    rows = [(1, [1.0, float(i)], "g") for i in range(6)]
    winners = {
        tuple(points.dedupe_by_id(_pts(spark, r).coalesce(1)).first()["vectors"]["image"]) for r in (rows, rows[::-1])
    }
    assert len(winners) == 1


def test_upsert_modes(spark):
    existing = spark.createDataFrame([(i, f"old{i}") for i in range(0, 60, 2)], "id long, v string")
    new = spark.createDataFrame(
        [(i, f"new{i}") for i in range(0, 90, 3)] + [(3, "dup3")], "id long, v string"
    )
    for mode in ("insert_absent", "overwrite"):
        got = sorted(tuple(r) for r in points.upsert(existing, new, mode=mode).collect())
        ids = [r[0] for r in got]
        assert len(ids) == len(set(ids)) == len(set(range(0, 60, 2)) | set(range(0, 90, 3)))
        assert dict(got)[6] == ("old6" if mode == "insert_absent" else "new6")


def test_overwrite_that_fails_midway_leaves_the_collection(spark, monkeypatch):
    """Until the pointer row is written the old version is the current one."""
    path = scratch_path(spark, "coll-midway")
    collection.create(spark, path, "c", {"image": (2, "Dot")})
    state = lambda: sorted((r["id"], r["payload"]["group"][0]) for r in collection.current(spark, path).collect())
    old, new = _pts(spark, [(1, [1.0, 0.0], "a"), (2, [1.0, 1.0], "a")]), _pts(spark, [(2, [2.0, 2.0], "b"), (3, [3.0], "bad")])
    collection.load(spark, path, old)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(collection, "_make_current", stop)
        with pytest.raises(RuntimeError):
            collection.load(spark, path, new, check_existing=False, batch_id=7)
    assert state() == [(1, "a"), (2, "a")]
    for _ in range(3):  # run again, and again: same state, rejected rows not doubled
        collection.load(spark, path, new, check_existing=False, batch_id=7)
        assert state() == [(1, "a"), (2, "b")]
    rejected = spark.read.parquet(path + "/_rejected").where("batch = '7'").collect()
    assert [(r["id"], r["reason"]) for r in rejected] == [(3, "dimension_mismatch:image")]


def test_load_counts_with_nothing_to_load(spark):
    path = scratch_path(spark, "coll-empty")
    collection.create(spark, path, "c", {"image": (2, "Dot")})
    some = _pts(spark, [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [float("inf"), 0.0], "a")])
    collection.load(spark, path, some.limit(0), batch_id="none")
    collection.load(spark, path, some, batch_id="some")
    collection.load(spark, path, some.limit(0), check_existing=False, batch_id="over")
    got = {r["batch"]: (r["total"], r["loaded"], dict(r["rejected"])) for r in collection.loads(spark, path).collect()}
    assert got == {"none": (0, 0, {}), "some": (3, 1, {"infinite_component:image": 1}), "over": (0, 0, {})}
    assert collection.current(spark, path).count() == 1


def test_stopped_stream_load_goes_on(spark):
    """A load stopped after its first batch and started again equals one batch load."""
    from quiver.streaming import jobs

    rows = [(i % 40, [float(i), 1.0] if i % 7 else [1.0], f"g{i}") for i in range(120)]
    source = jobs.stage_files(_pts(spark, rows).repartition(6), 1000, "load-source")
    path, checkpoint = scratch_path(spark, "coll-stream"), scratch_path(spark, "load-checkpoint")
    collection.create(spark, path, "c", {"image": (2, "Dot")})
    real, seen = collection.load, []

    def once(*args, **how):
        if seen:
            raise RuntimeError("stopped")
        seen.append(how["batch_id"])
        return real(*args, **how)

    collection.load = once
    try:
        with pytest.raises(Exception, match="stopped"):
            jobs.stream_load(spark, source, path, checkpoint, files_per_trigger=2)
    finally:
        collection.load = real
    after_one = collection.current(spark, path).count()
    jobs.stream_load(spark, source, path, checkpoint, files_per_trigger=2)
    whole = scratch_path(spark, "coll-whole")
    collection.create(spark, whole, "c", {"image": (2, "Dot")})
    collection.load(spark, whole, _pts(spark, rows))
    ids = lambda p: sorted(r["id"] for r in collection.current(spark, p).select("id").collect())
    assert 0 < after_one <= 40 and ids(path) == ids(whole)
    rejected = lambda p: spark.read.parquet(p + "/_rejected").count()
    assert rejected(path) == rejected(whole) == sum(i % 7 == 0 for i in range(120))
    assert [r["batch"] for r in collection.loads(spark, path).orderBy("batch").collect()] == ["0", "1", "2"]
