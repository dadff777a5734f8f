from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tripweave.functions.clock import epoch_seconds
from tripweave.operators import graph, trips
from tripweave.queries.fixture import checkins_from_events
from tripweave.sources.stages import read_stage

START = datetime(2020, 3, 1, 12, 0, 0)
DAY = timedelta(days=1)

SCHEMA = "event_id long, user long, checkinTime timestamp_ntz, cluster int, latitude double, longitude double"


def frame(spark, stops):
    rows = [
        (i, user, START + at, cluster, cluster / 10, -cluster / 10)
        for i, (user, at, cluster) in enumerate(stops)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def fixture_stops(spark, sf_dir):
    events = read_stage(spark, sf_dir, "events.parquet")
    return checkins_from_events(spark, events).withColumnRenamed("site", "cluster").cache()


def test_gap_is_strict(spark):
    df = frame(
        spark,
        [
            (1, 0 * DAY, 1),
            (1, 3 * DAY, 2),
            (1, 6 * DAY + timedelta(seconds=1), 3),
            (2, 0 * DAY, 4),
        ],
    )
    got = {r["event_id"]: (r["gap"], r["trip"]) for r in trips.segment_trips(df).collect()}
    assert got == {0: (None, 0), 1: (259200, 0), 2: (259201, 1), 3: (None, 0)}


def test_fractions_of_a_second_are_dropped_first(spark):
    df = frame(
        spark,
        [(1, timedelta(microseconds=900_000), 1), (1, 3 * DAY + timedelta(seconds=1), 2)],
    )
    assert [r["gap"] for r in trips.segment_trips(df).orderBy("event_id").collect()] == [None, 259201]


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_orders_of_a_trip(spark, hot_rows):
    df = frame(spark, [(1, timedelta(hours=i), c) for i, c in enumerate((9, 2, 5))])
    for order, want in (("time", {(9, 2), (2, 5)}), ("struct", {(2, 5), (5, 9)})):
        got = graph.transition_edges(df, order, hot_rows=hot_rows).collect()
        assert {(r["src"], r["dst"]) for r in got} == want
    with pytest.raises(ValueError):
        graph.transition_edges(df, "random")


@pytest.mark.parametrize("order", ["time", "struct"])
def test_moves_agree_with_previous_stop(fixture_stops, order):
    stops = trips.previous_stop(trips.segment_trips(fixture_stops), order)
    slow = (
        stops.select(F.col("previous.cluster").alias("src"), F.col("cluster").alias("dst"))
        .filter("src <> dst")
        .groupBy("src", "dst")
        .count()
    )
    fast = graph.transition_edges(fixture_stops, order)
    assert set(map(tuple, slow.collect())) == set(map(tuple, fast.collect()))


def test_split_users_give_the_same_trips(fixture_stops):
    plain = trips.segment_trips(fixture_stops).select("event_id", "gap", "trip")
    split = trips.segment_trips(fixture_stops, hot_rows=20).select("event_id", "gap", "trip")
    assert set(map(tuple, plain.collect())) == set(map(tuple, split.collect()))
    for order in ("time", "struct"):
        plain = graph.transition_edges(fixture_stops, order)
        split = graph.transition_edges(fixture_stops, order, hot_rows=20)
        assert set(map(tuple, plain.collect())) == set(map(tuple, split.collect()))


@pytest.mark.parametrize("options", [{}, {"max_stops": 7}, {"max_stops": 7, "hot_rows": 10}])
def test_histories_explode_to_the_same_rows(fixture_stops, options):
    histories = trips.trip_histories(fixture_stops, **options)
    sizes = histories.select(F.expr("aggregate(trips, 0, (n, t) -> n + size(t))").alias("n")).collect()
    assert sum(r["n"] for r in sizes) == fixture_stops.count()
    assert max(r["n"] for r in sizes) <= options.get("max_stops", 10**9)
    got = trips.explode_trips(histories).select("user", "trip", "cluster", "checkinTime")
    want = trips.segment_trips(fixture_stops).select("user", "trip", "cluster", "checkinTime")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_histories_are_in_time_order(fixture_stops):
    bad = trips.trip_histories(fixture_stops).filter(
        "exists(trips, t -> t <> array_sort(t, (a, b) -> CASE"
        " WHEN a.checkinTime < b.checkinTime THEN -1 WHEN a.checkinTime > b.checkinTime THEN 1 ELSE 0 END))"
    )
    assert bad.count() == 0
    stop = trips.trip_histories(fixture_stops).schema["trips"].dataType.elementType.elementType
    assert stop.names == ["cluster", "latitude", "longitude", "checkinTime"]


def test_struct_order_edges_ascend(fixture_stops):
    assert graph.transition_edges(fixture_stops, "struct").filter("src >= dst").isEmpty()


def test_zone_changes_do_not_move_gaps(spark):
    # 3 days by the wall clock, across the 2020-03-08 change in New York.
    df = frame(spark, [(1, 6 * DAY, 1), (1, 9 * DAY, 2)])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert [r["gap"] for r in trips.segment_trips(df).orderBy("event_id").collect()] == [None, 259200]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_default_ties_need_no_event_number(spark):
    rows = [(1, datetime(2024, 1, 1), c, 1.0, 2.0) for c in (5, 3, 3, None)]
    frame = spark.createDataFrame(rows, "user long, checkinTime timestamp_ntz, cluster int, latitude double, longitude double")
    moves = [tuple(r) for r in graph.transition_edges(frame).collect()]
    assert moves == [(3, 5, 1)]
    assert trips.previous_stop(trips.segment_trips(frame)).count() == 4


def test_seconds_before_1970_round_down(spark):
    frame = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 23:59:58.5' AS t UNION ALL SELECT TIMESTAMP_NTZ'1970-01-01 00:00:01.5'")
    assert sorted(r[0] for r in frame.select(epoch_seconds(frame, "t")).collect()) == [-2, 1]
