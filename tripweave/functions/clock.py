"""Whole-second time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970 of a timestamp column, rounded down, before 1970 too.

    A zone-less timestamp is counted on its own clock: going through the session zone
    would add or lose an hour around a daylight-saving change.
    """
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        micros = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)"
        return F.expr(f"({micros} - pmod({micros}, 1000000L)) div 1000000L")
    return F.unix_timestamp(F.col(name))
