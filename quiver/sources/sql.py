"""Parameterised SQL files.

A SQL file names its inputs as ``{placeholders}``.  Tables are bound as
DataFrames through ``spark.sql(text, **tables)`` – Spark substitutes a
reference to each DataFrame's plan, not spliced text – and values are bound
with ``args`` as named parameters (``:name``).  Loading is strict: a missing
file or an unbound placeholder raises before anything runs.
"""

from __future__ import annotations

import string
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SQL_DIR = Path(__file__).parent / "sql"


def placeholders(text: str) -> set[str]:
    """Names of the ``{...}`` fields in a SQL text."""
    return {field for _, field, _, _ in string.Formatter().parse(text) if field}


def load_sql(
    spark: SparkSession,
    path: str | Path,
    tables: dict[str, DataFrame],
    args: dict[str, Any] | None = None,
) -> DataFrame:
    path = Path(path)
    if not path.is_absolute() and not path.exists():
        path = SQL_DIR / path
    if not path.exists():
        raise FileNotFoundError(f"no SQL text at {path}")
    text = path.read_text(encoding="utf-8")
    missing = placeholders(text) - set(tables)
    if missing:
        raise KeyError(f"unbound table placeholders in {path.name}: {sorted(missing)}")
    return spark.sql(text, args=args, **tables)
