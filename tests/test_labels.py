"""Labelling rule edge cases (FIXTURES part B: articles, features, expected labels)."""

from pyspark.sql import functions as F

from quiver.operators import labels
from quiver.sources.sql import load_sql

ART = "castor string, category_code string, country_code string, buyable_status int"


def _articles(spark):
    rows = [
        ("1", "men_shirts", "GB", 1),
        ("2", "women_tops", "GB", 1),          # %men% matches women
        ("3", "ladies_dress", "GB", 1),
        ("4", "kids_boy50-98", "GB", 1),
        ("5", "newborn50-98", "GB", 1),        # boy and girl 50_98
        ("6", "boy92-140", "GB", 1),
        ("7", "boy92-170", "GB", 1),           # 92_140 and 134_170
        ("8", "boy134-170", "GB", 1),
        ("9", "girl50-98", "GB", 1),
        ("10", "girl92-140", "GB", 1),
        ("11", "girl92-170", "GB", 1),
        ("12", "girl134-170", "GB", 1),
        ("13", "MEN_UPPER", "GB", 1),          # case sensitive: no label
        ("14", None, "GB", 1),                 # NULL code: no label
        ("15", "home", "GB", 1),               # no match
        ("16", "men_shirts", "SE", 1),         # other country
        ("17", "men_shirts", "GB", 0),         # not buyable
        ("18", "men_shirts", None, 1),         # NULL country
        ("19", "men_shirts", "GB", 1),         # same castor, two codes
        ("19", "ladies_dress", "GB", 1),
        (None, "men_shirts", "GB", 1),         # NULL castor
    ]
    return spark.createDataFrame(rows, ART)


def test_group_labels(spark):
    got = {
        r["castor"]: r["groups"]
        for r in labels.aggregate_groups(labels.label_groups(_articles(spark))).collect()
    }
    assert got["1"] == ["men"] and got["2"] == ["men"] and got["3"] == ["ladies"]
    assert got["5"] == ["boy_50_98", "girl_50_98"]
    assert got["7"] == ["boy_134_170", "boy_92_140"]
    assert got["11"] == ["girl_134_170", "girl_92_140"]
    assert got["9"] == ["girl_50_98"] and got["10"] == ["girl_92_140"]
    assert got["19"] == ["ladies", "men"]
    for missing in ("13", "14", "15", "16", "17", "18"):
        assert missing not in got
    assert None in got  # a NULL castor still aggregates; the join drops it


def test_empty_list_for_null_code(spark):
    row = labels.label_groups(_articles(spark)).filter(F.col("castor") == "14").first()
    assert row["potential_groups"] == []


def test_extract_join(spark):
    feats = spark.createDataFrame(
        [("1", [1.0, 0.0]), ("1", [0.0, 1.0]), ("99", [1.0, 1.0]), ("5", [0.5, 0.5]), (None, [0.0, 0.0])],
        "castor string, features array<float>",
    )
    out = labels.extract_vectors(_articles(spark), feats)
    assert sorted(r["castor"] for r in out.collect()) == ["1", "1", "5"]  # fan-out, no match, NULL key


def test_sql_file_equals_dataframe_form(spark):
    arts = _articles(spark)
    feats = spark.createDataFrame([(str(i), [float(i)]) for i in range(1, 20)], "castor string, features array<float>")
    a = load_sql(spark, "labelled_features.sql", {"articles": arts, "features": feats}, {"rules": labels.rules_column(), "country": "GB", "status": 1})
    b = labels.extract_vectors(arts, feats)
    key = lambda df: sorted((r["castor"], tuple(r["groups"])) for r in df.collect())
    assert key(a) == key(b)


def test_sql_loader_is_strict(spark, tmp_path):
    import pytest

    with pytest.raises(FileNotFoundError):
        load_sql(spark, tmp_path / "nope.sql", {})
    with pytest.raises(KeyError):
        load_sql(spark, "labelled_features.sql", {"articles": _articles(spark)})


def test_hot_castor_is_spread(spark):
    """A third of the features on one castor: a join by shuffles deals them over
    its tasks (unsalted, the hot one would hold half of all rows); no row is lost."""
    rows = [("1" if i % 3 == 0 else str(100 + i), [float((i * j) % 97) for j in range(1, 9)]) for i in range(12_000)]
    feats = spark.createDataFrame(rows, "castor string, features array<float>").repartition(6)
    arts = spark.createDataFrame(
        [("1", "ladies", "GB", 1)] + [(str(100 + i), "men", "GB", 1) for i in range(12_000)],
        "castor string, category_code string, country_code string, buyable_status int",
    )
    shuffled = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in shuffled}
    try:
        for k, v in shuffled.items():
            spark.conf.set(k, v)
        out = labels.extract_vectors(arts, feats)
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(tasks) == 12_000 and len(tasks) == 4
    assert max(tasks) < 0.36 * 12_000


def test_only_articles_with_features_are_labelled(spark, monkeypatch):
    """The group side grows with the matches, not with the articles."""
    grouped = []

    def watched(labelled):
        grouped.append(aggregate(labelled))
        return grouped[-1]

    aggregate = labels.aggregate_groups
    monkeypatch.setattr(labels, "aggregate_groups", watched)
    arts = spark.range(500).select(
        F.col("id").cast("string").alias("castor"), F.lit("men").alias("category_code"), F.lit("GB").alias("country_code"),
        F.lit(1).alias("buyable_status"),
    )
    feats = spark.createDataFrame([("7", [1.0]), ("7", [2.0]), ("900", [3.0]), (None, [4.0])], "castor string, features array<float>")
    out = labels.extract_vectors(arts, feats)
    assert sorted((r["castor"], r["features"][0], tuple(r["groups"])) for r in out.collect()) == [("7", 1.0, ("men",)), ("7", 2.0, ("men",))]
    assert [r["castor"] for r in grouped[0].collect()] == ["7"]
