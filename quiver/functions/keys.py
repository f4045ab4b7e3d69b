"""Order keys as single primitive columns.

``max``/``max_by`` over a struct ordering (``struct(ts, event_id)``) force
Spark into a sort-based aggregate.  :func:`event_order_key` packs the same
ordering into one ``decimal(38,0)`` – epoch microseconds * 10^20 plus the
event id shifted to be non-negative – which the hash aggregate can hold in
its buffer.  The packing is exact and order preserving for every timestamp
in years 1..9999 and every 64-bit id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 10^20 (room for any shifted 64-bit id) and 2^63 (id shift).
_SHIFT = "CAST('100000000000000000000' AS DECIMAL(38,0))"
_HALF = "CAST('9223372036854775808' AS DECIMAL(38,0))"


def epoch_micros(ts: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970-01-01 00:00:00, without any time-zone step.

    ``TIMESTAMP_NTZ`` is decomposed into calendar parts (a cast to the zoned
    type would apply the session zone and could reorder wall times around a
    daylight-saving gap); a zoned ``TIMESTAMP`` is already an instant.
    """
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(ts)
    days = F.unix_date(ts.cast("date")).cast("long")
    secs = F.date_part(F.lit("SECOND"), ts)  # decimal(8,6): seconds + micros
    return (
        days * 86_400_000_000
        + F.hour(ts).cast("long") * 3_600_000_000
        + F.minute(ts).cast("long") * 60_000_000
        + (secs * 1_000_000).cast("long")
    )


def event_order_key(ts: Column, event_id: Column, ts_type: T.DataType) -> Column:
    """One ``decimal(38,0)`` ordered exactly like ``(ts, event_id)``."""
    micros = epoch_micros(ts, ts_type).cast("decimal(38,0)")
    return micros * F.expr(_SHIFT) + (event_id.cast("decimal(38,0)") + F.expr(_HALF))
