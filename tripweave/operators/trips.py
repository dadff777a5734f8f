"""Trips: each user's check-ins cut at long gaps, nested or flat, and successive stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tripweave.functions.clock import epoch_seconds
from tripweave.plans.ordered import OrderedScan
from tripweave.plans.skew import HOT_ROWS

TRIP_GAP_S = 3 * 24 * 60 * 60
# Stops in one row of an exported history.  The flat stops are what other operators read.
MAX_STOPS = 1_000_000

_STOP = ("cluster", "latitude", "longitude", "checkinTime")


def segment_trips(
    checkins: DataFrame,
    gap_s: int = TRIP_GAP_S,
    tie: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``gap`` (whole seconds since the user's last check-in) and ``trip`` (from 0).

    A new trip starts where the gap is above ``gap_s``.  ``tie`` orders check-ins of one
    user at one time; by default all other columns do, those of the place first.
    """
    return _segmented(checkins, gap_s, tie, hot_rows).frame().drop("_s", "_before", "_new")


def trip_histories(
    checkins: DataFrame,
    gap_s: int = TRIP_GAP_S,
    tie: Sequence[str] | None = None,
    max_stops: int = MAX_STOPS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per user: ``trips``, an array of trips, each an array of check-in structs.

    Stops are in time order.  A user with more than ``max_stops`` check-ins gets further
    rows (``part`` 1, 2, …); ``first_trip`` is the number of the first trip in the row, and
    a trip on the border continues in the next part.
    """
    placed = (
        _segmented(checkins, gap_s, tie, hot_rows)
        .derive(_one=F.lit(1))
        .running_sum("_one", "_place")
        .derive(part=F.floor((F.col("_place") - 1) / F.lit(max_stops)).cast("int"))
        .frame()
    )
    stops = F.array_sort(F.collect_list(F.struct("_place", *_STOP)))
    bare = F.transform(stops, lambda s: F.struct(*[s[name].alias(name) for name in _STOP]))
    return (
        placed.groupBy("user", "part", "trip")
        .agg(bare.alias("_stops"))
        .groupBy("user", "part")
        .agg(
            F.min("trip").alias("first_trip"),
            F.array_sort(F.collect_list(F.struct("trip", "_stops"))).alias("_trips"),
        )
        .select("user", "part", "first_trip", F.col("_trips._stops").alias("trips"))
    )


def explode_trips(histories: DataFrame) -> DataFrame:
    """Back to one row per check-in, with its ``trip`` number."""
    return (
        histories.select("user", "first_trip", F.posexplode("trips").alias("_at", "_stops"))
        .select(
            "user",
            (F.col("first_trip") + F.col("_at")).alias("trip"),
            F.explode("_stops").alias("checkin"),
        )
        .select("user", "trip", "checkin.*")
    )


def previous_stop(
    trips: DataFrame,
    order: str = "time",
    tie: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``previous``: the check-in before this one in its trip, null at the first.

    ``order="time"`` follows the traveller.  ``order="struct"`` orders a trip by site
    number first and time last, the order the check-in struct compares in.
    """
    scan = OrderedScan(trips, ["user", "trip"], _stop_order(order, _ties(trips, tie)), hot_rows)
    return scan.previous(_STOP, "previous").frame()


def trip_moves(
    checkins: DataFrame,
    order: str = "time",
    gap_s: int = TRIP_GAP_S,
    tie: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(``src``, ``dst``) of every successive pair of different sites in a trip.

    In time order this is one pass over each user: the last stop belongs to the same trip
    exactly when the gap is within ``gap_s``.  In struct order a trip visits each of its
    sites once in ascending order, so only its distinct sites are sorted.
    """
    if tie is None:
        # Stops at one time and site are alike here.
        tie = ["cluster"]
    slim = checkins.select("user", "checkinTime", *dict.fromkeys(["cluster", *tie]))
    if order == "time":
        stops = (
            OrderedScan(
                slim.withColumn("_s", epoch_seconds(slim, "checkinTime")),
                ["user"],
                ["checkinTime", *tie],
                hot_rows,
            )
            .previous(["_s", "cluster"], "_before")
            .frame()
            .filter(F.col("_s") - F.col("_before._s") <= gap_s)
        )
    else:
        _stop_order(order, tie)
        visited = (
            segment_trips(slim, gap_s, tie, hot_rows)
            .filter(F.col("cluster").isNotNull())
            .select("user", "trip", "cluster")
            .distinct()
        )
        stops = (
            OrderedScan(visited, ["user", "trip"], ["cluster"], hot_rows)
            .previous(["cluster"], "_before")
            .frame()
        )
    src, dst = F.col("_before.cluster"), F.col("cluster")
    return stops.select(src.alias("src"), dst.alias("dst")).filter(F.col("src") != F.col("dst"))


def _segmented(
    checkins: DataFrame, gap_s: int, tie: Sequence[str] | None, hot_rows: int
) -> OrderedScan:
    return (
        OrderedScan(
            checkins.withColumn("_s", epoch_seconds(checkins, "checkinTime")),
            ["user"],
            ["checkinTime", *_ties(checkins, tie)],
            hot_rows,
        )
        .previous(["_s"], "_before")
        .derive(gap=F.col("_s") - F.col("_before._s"))
        .derive(_new=F.when(F.col("gap") > gap_s, 1).otherwise(0))
        .running_sum("_new", "trip")
    )


def _ties(checkins: DataFrame, tie: Sequence[str] | None) -> list[str]:
    """The given columns, or every column that can be ordered, those of a stop first; rows that
    agree in all of them are alike."""
    if tie is not None:
        return list(tie)
    kinds = {f.name: f.dataType for f in checkins.schema if not isinstance(f.dataType, (MapType, VariantType))}
    taken = {"user", "checkinTime", "gap", "trip", "previous"}
    return [n for n in dict.fromkeys([*_STOP, *kinds]) if n in kinds and n not in taken]


def _stop_order(order: str, tie: Sequence[str]) -> list[str]:
    if order == "time":
        return ["checkinTime", *tie]
    if order == "struct":
        return [*_STOP, *(name for name in tie if name not in _STOP)]
    raise ValueError(f"order must be 'time' or 'struct', not {order!r}")
