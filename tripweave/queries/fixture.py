"""Check-ins derived from the ``events`` table, which has no coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture: eight groups of 15 sites, sites on a 12-wide grid, every
# tenth event anywhere, every 53rd event alone.  Integer arithmetic with one last
# division, so that any SQL engine gives the same bits.
_FROM_EVENTS = """
WITH e AS (
  SELECT event_id, user_id, ts,
    CASE WHEN event_id % 10 = 0 THEN (event_id * 13) % 120
         ELSE (user_id % 8) * 15 + (event_id * event_id + user_id) % 15 END AS site,
    CAST((event_id - event_id % 53) / 53 AS BIGINT) AS n
  FROM {events})
SELECT event_id, user_id AS `user`, ts AS `checkinTime`, site,
  CAST(CASE WHEN event_id % 53 = 0 THEN -60000000 + (n % 1000) * 20000
       ELSE 37000000 + CAST((site - site % 12) / 12 AS BIGINT) * 50000
            + ((event_id * 31) % 5 - 2) * 2000 END AS DOUBLE) / 1000000 AS latitude,
  CAST(CASE WHEN event_id % 53 = 0 THEN 100000000 + CAST((n - n % 1000) / 1000 AS BIGINT) * 100000
       ELSE -122000000 + (site % 12) * 50000
            + ((event_id * 17 + user_id) % 5 - 2) * 2000 END AS DOUBLE) / 1000000 AS longitude
FROM e
"""


def checkins_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    return spark.sql(_FROM_EVENTS, events=events)


def spoiled(checkins: DataFrame) -> DataFrame:
    """Coordinates made unusable by the rule in ``SPOILED``: no number, infinite, beyond a pole."""
    event, lat, lon = F.col("event_id"), F.col("latitude"), F.col("longitude")
    number = lambda text: F.lit(float(text))
    return checkins.withColumns(
        {
            "latitude": F.when(event % 17 == 3, number("nan"))
            .when(event % 17 == 4, lat + 360)
            .when(event % 17 == 5, F.lit(None).cast("double"))
            .otherwise(lat),
            "longitude": F.when(event % 17 == 3, number("nan"))
            .when(event % 17 == 6, number("-inf"))
            # A whole turn away is the same place.
            .when(event % 17 == 7, lon + 360)
            .otherwise(lon),
        }
    )


#: The event_ids whose coordinates :func:`spoiled` makes unusable.
SPOILED = "event_id % 17 BETWEEN 3 AND 6"
