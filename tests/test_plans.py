import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tripweave.operators import graph, trips
from tripweave.plans import ordered
from tripweave.plans.lineage import RollingCut, cut_lineage, cut_measured, is_scan, owns_copies, shared_folder
from tripweave.plans.ordered import OrderedScan
from tripweave.plans.ranking import compact_ids
from tripweave.plans.skew import group_sizes, hot_keys, hot_keys_if_any, sized_join, spread_join
from tripweave.queries.catalog import QUERIES
from tripweave.queries.fixture import checkins_from_events
from tripweave.queries.folders import name_folder


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == spark.sparkContext.getCheckpointDir()


def test_cut_lineage_keeps_rows_and_types(spark):
    df = spark.sql("SELECT 1 AS a, array(struct(2L AS b)) AS c, CAST(NULL AS double) AS d")
    assert cut_lineage(df).collect() == df.collect()
    assert cut_lineage(df).dtypes == df.dtypes


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [1, 10, 1000])
def test_spread_join_equals_plain_join(spark, how, hot_rows):
    rng = random.Random(3)
    facts = spark.createDataFrame(
        [(i, rng.choice([1, 1, 1, 2, 3, 4, 9, None])) for i in range(300)], "id long, k long"
    )
    dims = spark.createDataFrame([(k, f"v{k}") for k in (1, 2, 3, 4, 5)], "k long, v string")
    hot = hot_keys(group_sizes(facts, ["k"]), ["k"], hot_rows=hot_rows)
    got = spread_join(facts, dims, ["k"], ["id"], hot, how)
    want = facts.join(dims, ["k"], how)
    assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(
        map(str, want.select("id", "k", "v").collect())
    )


def test_hot_rows_are_spread_over_salts(spark):
    facts = spark.range(1000).select("id", F.lit(7).alias("k"))
    row = hot_keys(group_sizes(facts, ["k"]), ["k"], hot_rows=100).first()
    assert (row["k"], row["_salts"]) == (7, 10)
    assert hot_keys_if_any(group_sizes(facts, ["k"]), ["k"], hot_rows=1000) is None


def test_sized_join_equals_plain_join(spark):
    facts = spark.range(200).selectExpr("id", "if(id < 150, 0, id % 5) AS k")
    sized = facts.join(group_sizes(facts, ["k"], "n"), "k")
    dims = group_sizes(facts, ["k"], "n").selectExpr("k", "n", "k * 10 AS v")
    got = sized_join(sized, dims, ["k"], ["id"], "n", hot_rows=20)
    assert sorted((r["id"], r["v"]) for r in got.collect()) == sorted(
        (r["id"], r["k"] * 10) for r in facts.collect()
    )


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_ordered_scan(spark, hot_rows):
    rng = random.Random(11)
    keys = ["a", "a", "a", None, None, "b"]
    rows = [(rng.choice(keys), rng.randrange(40), i, rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int")
    got = (
        OrderedScan(df, ["k"], ["t", "id"], hot_rows)
        .previous(["id", "v"], "p")
        .derive(up=F.when(F.col("v") > F.col("p.v"), 1).otherwise(0))
        .running_sum("up", "ups")
        .frame()
        .collect()
    )
    want = {}
    for key in ("a", "b", None):
        before, ups = None, 0
        for _, t, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            ups += before is not None and v > before[1]
            want[i] = (before, ups)
            before = (i, v)
    assert {r["id"]: (tuple(r["p"]) if r["p"] else None, r["ups"]) for r in got} == want


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_compact_ids(spark, hot_rows):
    values = [70, 70, 70, 70, 70, -4, 12, 12, None, 900, None]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v long")
    got = {r["id"]: r["v"] for r in compact_ids(df, "v", hot_rows=hot_rows).collect()}
    rank = {v: k + 1 for k, v in enumerate(sorted({v for v in values if v is not None}))}
    assert got == {i: rank.get(v) for i, v in enumerate(values)}
    assert dict(compact_ids(df, "v").dtypes)["v"] == "int"


def test_compact_ids_over_many_partitions(spark):
    df = spark.range(0, 5000).selectExpr("id", "pmod(id * 7919, 1000) * 3 AS v")
    wrong = compact_ids(df.withColumn("want", F.expr("v div 3 + 1")), "v").filter("v <> want")
    assert wrong.count() == 0


def test_rolling_cut_keeps_the_last_two(spark):
    cut = RollingCut()
    copies = [cut(spark.range(n)) for n in range(1, 5)]
    kept = [c.inputFiles() for c in copies[2:]]
    assert all(kept) and [c.count() for c in copies[2:]] == [3, 4]
    gone = {Path(f.removeprefix("file:")).parent for f in copies[0].inputFiles() + copies[1].inputFiles()}
    assert gone and not any(folder.exists() for folder in gone)


def copies(spark):
    return {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("cut-*")}


def test_owner_removes_what_its_result_does_not_read(spark):
    @owns_copies
    def inner(n):
        kept = cut_lineage(spark.range(n))
        cut_lineage(spark.range(1)).count()
        return kept.filter("id > 2")

    @owns_copies
    def outer():
        total = inner(20).count()
        return inner(total)

    before = copies(spark)
    result = outer()
    assert len(copies(spark) - before) == 1
    assert result.count() == 14
    spent = owns_copies(lambda: inner(10).count())
    assert spent() == 7 and len(copies(spark) - before) == 1


def test_queries_leave_only_the_copies_their_results_read(spark, sf_dir):
    for name in ("dbscan_sites", "mcl_power_5", "pagerank_converged"):
        before = copies(spark)
        result = QUERIES[name](spark, sf_dir)
        left = copies(spark) - before
        assert left <= {part for f in result.inputFiles() for part in f.split("/") if part.startswith("cut-")}
        assert result.count() > 0


def test_without_a_named_folder_nothing_is_chosen(spark, monkeypatch):
    class Bare:
        master = "spark://somewhere:7077"
        named = None

        def getCheckpointDir(self):
            return self.named

        def setCheckpointDir(self, folder):
            self.named = folder

    class Session:
        sparkContext = Bare()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    session = Session()
    name_folder(session)
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared_folder(session)
    session.sparkContext.master = "local[2]"
    name_folder(session)
    assert session.sparkContext.named


def test_cut_measured(spark):
    copy, largest = cut_measured(spark.range(5).selectExpr("id * 3 AS n"), "n")
    assert (copy.count(), largest) == (5, 12)
    assert cut_measured(spark.range(0).selectExpr("id AS n"), "n")[1] == 0


def test_every_hot_key_is_listed(spark):
    facts = spark.range(60_000).selectExpr("id", "id % 20000 AS k")
    assert hot_keys(group_sizes(facts, ["k"]), ["k"], hot_rows=2).count() == 20_000
    assert hot_keys(group_sizes(facts, ["k"]), ["k"], hot_rows=3).count() == 0


@pytest.mark.parametrize("listed", [False, True])
def test_rows_without_a_key_are_spread(spark, listed):
    facts = spark.range(40_000).selectExpr("id", "if(id % 2 = 0, NULL, id % 1000) AS k")
    dims = spark.range(1000).selectExpr("id AS k", "id * 2 AS v")
    hot = spark.createDataFrame([(1, 2)], "k long, _salts int") if listed else None
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spread_join(facts, dims, ["k"], ["id"], hot, "left")
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 40_000 and max(sizes) < 8_000


@pytest.mark.parametrize("name", ["edges_time", "edges_struct", "previous_stop", "previous_stop_struct"])
def test_the_source_is_read_once(spark, sf_dir, name):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    clustered = checkins_from_events(spark, events).withColumnRenamed("site", "cluster")
    clustered = clustered.mapInArrow(counted, clustered.schema)
    if name.startswith("edges"):
        graph.transition_edges(clustered, name.removeprefix("edges_")).count()
    else:
        order = "struct" if name.endswith("struct") else "time"
        trips.previous_stop(trips.segment_trips(clustered), order).count()
    assert rows.value == events.count()


@pytest.mark.parametrize("counters", [1, 3, 1 << 22])
def test_crowded_keys_are_complete_and_exact(spark, monkeypatch, counters):
    monkeypatch.setattr(ordered, "_SKETCH", counters)
    rng = random.Random(counters)
    keys = [rng.choice(["a"] * 12 + [None] * 9 + [f"k{i}" for i in range(30)]) for _ in range(600)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, id int")
    found = ordered.crowded_keys(df, ["k"], 50)
    want = {(k, n) for k, n in Counter(keys).items() if n > 50}
    assert {tuple(r) for r in found.collect()} == want and {k for k, _ in want} == {"a", None}
    assert ordered.crowded_keys(df, ["k"], 600) is None
    assert ordered.crowded_keys(df.limit(0), ["k"], 0) is None


def test_scan_writes_rows_of_crowded_keys_only(spark, monkeypatch):
    rows = [("hot" if i % 3 == 0 else f"u{i % 50}", i, "x" * 9) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, wide string")
    written = []
    monkeypatch.setattr(ordered, "cut_lineage", lambda frame: written.append(frame) or cut_lineage(frame))
    for hot_rows, copied in ((20, 100), (1000, 0)):
        written.clear()
        scan = OrderedScan(df, ["k"], ["t"], hot_rows).previous(["t"], "p").frame()
        wide = [frame for frame in written if "wide" in frame.columns]
        assert sum(frame.count() for frame in wide) == copied and len(written) > len(wide)
        last: dict = {}
        want = set()
        for k, t, _ in rows:
            want.add((k, t, last.get(k)))
            last[k] = t
        assert {(r["k"], r["t"], r["p"] and r["p"]["t"]) for r in scan.collect()} == want


def test_what_is_a_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    checkins = checkins_from_events(spark, events)
    assert is_scan(checkins) and is_scan(checkins.filter("event_id > 5").unionByName(checkins))
    assert is_scan(cut_lineage(checkins.distinct())) and is_scan(spark.createDataFrame([(1,)], "id int"))
    assert not is_scan(checkins.distinct()) and not is_scan(checkins.join(events, "event_id"))
    assert not is_scan(checkins.mapInArrow(lambda batches: batches, checkins.schema))


def test_crowded_keys_read_the_key_columns_only(spark, sf_dir, monkeypatch):
    plans = []

    def recorded(frame):
        plans.append(str(frame._jdf.queryExecution().executedPlan()))
        return cut_lineage(frame)

    monkeypatch.setattr(ordered, "cut_lineage", recorded)
    checkins = checkins_from_events(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))
    trips.segment_trips(checkins.withColumnRenamed("site", "cluster")).count()
    scans = [plan for plan in plans if "FileScan parquet [" in plan and "user_id" in plan]
    assert scans and all("ReadSchema: struct<user_id:bigint>" in plan for plan in scans)
