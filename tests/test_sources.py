"""CSV source with a required column and the result sink."""

import pytest
from pyspark.sql import types as T

from quiver.session import scratch_path
from quiver.sources import files, views


def test_csv_required_column(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([("  padded  ", 1), ("", 2), (None, 3)], "user_queries string, other long")
    files.write_csv(df, path)
    back = files.read_csv_required(spark, path, {"user_queries": T.StringType()})
    # white space survives the round trip; an empty cell reads back as NULL
    assert sorted(back.collect(), key=lambda r: r["other"]) == [("  padded  ", "1"), (None, "2"), (None, "3")]
    with pytest.raises(ValueError):
        files.read_csv_required(spark, path, {"missing": T.StringType()})
    with pytest.raises(FileNotFoundError):
        files.read_csv_required(spark, path + "-nope", {"user_queries": T.StringType()})


def test_csv_headers_are_checked_and_files_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text("query_id,user_queries\n1,red dress\n")
    (tmp_path / "b.csv").write_text("user_queries,query_id\nblue dress,2\n")
    df = files.read_csv_required(spark, str(tmp_path), {"user_queries": T.StringType()})
    with pytest.raises(Exception, match="header"):
        df.collect()
    big = tmp_path / "big.csv"
    big.write_text("user_queries\n" + "some query text\n" * 200_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    try:
        split = files.read_csv_required(spark, str(big), {"user_queries": T.StringType()})
        assert split.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    ids = [r["query_id"] for r in files.with_query_ids(split).select("query_id").collect()]
    assert len(set(ids)) == 200_000


def test_nested_results_can_be_saved(spark):
    path = scratch_path(spark, "nested-results")
    df = spark.createDataFrame([("a", ["x", "y"])], "query string, queries array<string>")
    files.write_results(df, path)
    assert files.read_csv_required(spark, path, {"queries": T.StringType()}).first()["queries"] == '["x","y"]'


def test_result_sink(spark):
    path = scratch_path(spark, "results")
    empty = spark.createDataFrame([], "query string")
    assert files.write_results(empty, path) is False
    df = spark.createDataFrame([("a", 1.0)], "query string, latency_seconds double")
    assert files.write_results(df, path + "/nested/out") is True
    assert spark.read.option("header", True).csv(path + "/nested/out").count() == 1


def test_spread_only_touches_few_file_inputs(spark):
    from quiver.sources.tables import input_files, spread, table

    from paths import SF_SMALL

    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    assert input_files(docs) == 1
    spread_docs = spread(docs)
    assert spread_docs.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r[0] for r in spread_docs.select("doc_id").collect()) == sorted(
        r[0] for r in docs.select("doc_id").collect()
    )
    # a frame read from at least as many files as cores is returned as it is
    path = scratch_path(spark, "many-files")
    docs.repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    many = spark.read.parquet(path)
    assert input_files(many) >= spark.sparkContext.defaultParallelism and spread(many) is many


def test_customers_are_dealt_over_tasks_by_their_number(spark, tmp_path, monkeypatch):
    """One small file of texts is still worked on by as many tasks as its rows ask for."""
    spark.range(100).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(50).selectExpr("id AS p_partkey", "'red shirt' AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(views, "TASK_CUSTOMERS", 10)
    queries = views.view(spark, str(tmp_path), "user_queries")
    assert queries.rdd.getNumPartitions() == 10
    assert queries.count() == 100 and queries.where("user_queries LIKE 'red %'").count() == 17
