"""File sources and sinks.

* :func:`read_csv_required` – header CSV with no schema inference; a missing
  path or a missing required column raises before any data is read (only the
  header line is inspected), and a further file whose header names other
  columns, or the same in another order, fails the read instead of being taken
  by position.  Files are split among tasks unless ``multi_line`` asks for
  cells that hold line breaks.  Leading/trailing white space is kept; an empty
  cell reads as NULL (like a missing cell).
* :func:`with_query_ids` – numbers the rows of a table without an id.
* :func:`write_results` – the evaluation sink: an empty result writes nothing
  (warning), otherwise the folder is overwritten; parent folders are created by
  the writer.  The reference writes a spreadsheet; the spreadsheet library is
  not available here, so CSV (a header per part file, no index column, nested
  columns as JSON) or Parquet is written instead.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from quiver.session import scratch_path

log = logging.getLogger(__name__)

CSV_OPTIONS = {
    "header": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "enforceSchema": "false",
    "escape": '"',
}


def read_csv_required(spark: SparkSession, path: str, required: dict[str, T.DataType],
                      multi_line: bool = False) -> DataFrame:
    """Columns ``required`` (name -> type) of a header CSV, plus every other column as text."""
    try:
        header_only = spark.read.options(**CSV_OPTIONS, multiLine=str(multi_line).lower()).csv(path)
    except AnalysisException as exc:
        raise FileNotFoundError(f"input file not found: {path}") from exc
    missing = [c for c in required if c not in header_only.columns]
    if missing:
        raise ValueError(f"input CSV must have the column(s) {missing}")
    return header_only.select(
        *[F.col(c).cast(required[c]).alias(c) if c in required else F.col(c) for c in header_only.columns]
    )


def with_query_ids(df: DataFrame, id_col: str = "query_id") -> DataFrame:
    """``df`` with an ascending id per row; written once, so the ids stay."""
    path = scratch_path(df.sparkSession, "query-ids")
    numbered = df.select(F.monotonically_increasing_id().alias(id_col), *df.columns)
    numbered.write.parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns (arrays, structs, maps) are written as JSON."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> bool:
    """Write ``df`` to ``path``; returns False (and writes nothing) when empty."""
    if df.isEmpty():
        log.warning("nothing to write to %s: the result is empty", path)
        return False
    if fmt == "csv":
        write_csv(df, path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")
    return True
