"""The check-in table's columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

CHECKIN_COLUMNS = ("user", "checkinTime", "latitude", "longitude")


def project_checkins(table: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The check-in columns, plus those that tell simultaneous rows apart."""
    return table.select(*CHECKIN_COLUMNS, *extra)
