"""Text column expressions: clean, dates, template rendering, JSON parse/dump."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS_EDGES = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    """remove leading and trailing white space (all kinds, not just blanks)."""
    return F.regexp_replace(text, WS_EDGES, "")


def date_text(day: str | Column | None = None) -> Column:
    """a date as ``YYYY-MM-DD`` text; today when ``day`` is None (pass the
    day explicitly for a repeatable result)."""
    d = F.current_date() if day is None else F.to_date(F.lit(day) if isinstance(day, str) else day)
    return F.date_format(d, "yyyy-MM-dd")


def render(template: str | Column, values: dict[str, Column | str | int]) -> Column:
    """F8: replace ``{name}`` placeholders; a value may be a column or a constant."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        v = value if isinstance(value, Column) else F.lit(str(value))
        out = F.replace(out, F.lit("{" + name + "}"), v.cast("string"))
    return out


CORRUPT = "_corrupt_record"


def parse_json(text: Column, schema: T.StructType) -> Column:
    """permissive parse into ``schema`` plus ``_corrupt_record``.

    Bad syntax, a non-object document and a field of the wrong type all land
    in ``_corrupt_record`` with every other field NULL; absent fields are NULL.
    """
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    return F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def raw_response(text: Column, parsed: Column) -> Column:
    """The input text when it did not parse to an object (empty text included)."""
    return F.coalesce(
        parsed[CORRUPT], F.when(parsed.isNull() & text.isNotNull(), text)
    )
