"""Staged files of a stream: their number stays bounded, every row is in one."""

from pathlib import Path

from quiver.streaming import jobs


def test_number_of_files_does_not_grow_with_the_table(spark):
    few = jobs.stage_files(spark.range(0, 900, 1, 2), 100, "staged-few")
    many = jobs.stage_files(spark.range(0, 20_000, 1, 50), 100, "staged-many")
    for path, n in ((few, 900), (many, 20_000)):
        rows = spark.read.parquet(path)
        assert rows.count() == rows.distinct().count() == n
    files = lambda path: len(list(Path(path.removeprefix("file:")).glob("*.parquet")))
    assert 9 <= files(few) <= 11  # of at most the rows asked for
    assert files(many) <= 2 * jobs.STAGED_FILES
    assert jobs.stage_files(spark.range(0), 100, "staged-none")
