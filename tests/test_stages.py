import pytest
from pyspark.sql import functions as F

from tripweave.operators.graph import SiteGraph
from tripweave.sources import stages
from tripweave.queries.fixture import checkins_from_events
from tripweave.sources.checkins import project_checkins
from tripweave.sources.versions import StageConflict, VersionedStage


def test_checkins_have_their_columns(spark, sf_dir):
    checkins = checkins_from_events(spark, stages.read_stage(spark, sf_dir, "events.parquet"))
    assert checkins.columns == ["event_id", "user", "checkinTime", "site", "latitude", "longitude"]
    table = project_checkins(checkins)
    assert table.dtypes == [
        ("user", "bigint"),
        ("checkinTime", "timestamp_ntz"),
        ("latitude", "double"),
        ("longitude", "double"),
    ]
    assert table.distinct().count() == 1000
    assert table.select("latitude", "longitude").distinct().count() == 214


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_stage_overwrite_replaces_the_schema(spark, tmp_path, fmt):
    first = spark.range(5)
    second = spark.sql("SELECT 'a' AS name, array(1, 2) AS list")
    stages.write_stage(first, str(tmp_path), "step", fmt)
    back = stages.write_stage(second, str(tmp_path), "step", fmt)
    assert back.collect() == second.collect()
    assert stages.read_stage(spark, str(tmp_path), "step", fmt).collect() == second.collect()


def test_graph_round_trip(spark, tmp_path):
    vertices = spark.createDataFrame([(1, 3), (2, 3)], "id long, normal long")
    edges = spark.createDataFrame([(1, 2, 3)], "src long, dst long, normal long")
    stages.write_graph(SiteGraph(vertices, edges), str(tmp_path))
    back = stages.read_graph(spark, str(tmp_path))
    assert sorted(back.vertices.collect()) == sorted(vertices.collect())
    assert back.edges.collect() == edges.collect()


def test_catalog_tables(spark):
    stages.write_table(spark.range(3), "tripweave_step")
    stages.write_table(spark.range(4).withColumnRenamed("id", "other"), "tripweave_step")
    try:
        back = stages.read_table(spark, "tripweave_step")
        assert back.columns == ["other"] and back.count() == 4
    finally:
        spark.sql("DROP TABLE tripweave_step")


# --- versions -----------------------------------------------------------------------


def test_stage_rewritten_by_a_plan_that_reads_it(spark, tmp_path):
    root = str(tmp_path)
    stages.write_stage(spark.range(4), root, "step")
    for round_ in range(3):
        own = stages.read_stage(spark, root, "step")
        stages.write_stage(own.withColumn(f"c{round_}", F.col("id") + round_), root, "step")
    back = stages.read_stage(spark, root, "step")
    assert back.columns == ["id", "c0", "c1", "c2"]
    assert sorted(tuple(r) for r in back.collect()) == [(i, i, i + 1, i + 2) for i in range(4)]


def test_write_that_stops_half_way_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path)
    stages.write_stage(spark.range(100), root, "step")
    fails = spark.range(100, numPartitions=8).select(
        F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("other")
    )
    with pytest.raises(Exception, match="lost"):
        stages.write_stage(fails, root, "step")
    assert stages.stage_version(spark, root, "step") == 1
    assert stages.read_stage(spark, root, "step").count() == 100
    # A version number taken by a writer that died before it was complete is passed over.
    (tmp_path / "step" / "_versions" / "000000000002").write_text('{"folder": "v-')
    assert stages.stage_version(spark, root, "step") == 1
    assert stages.publish_stage(spark.range(7), root, "step") == 3
    assert stages.read_stage(spark, root, "step").count() == 7


def test_versions_stay_while_they_are_read(spark, tmp_path):
    root = str(tmp_path)
    stages.publish_stage(spark.range(1), root, "step")
    with stages.reading_stage(spark, root, "step") as first:
        for n in range(2, 6):
            stages.publish_stage(spark.range(n), root, "step", keep=0)
        assert first.count() == 1
        stage = VersionedStage(spark, f"{root}/step")
        assert stage.versions() == [1, 5]
    stages.publish_stage(spark.range(9), root, "step")
    assert stage.versions() == [5, 6]
    assert len([p for p in (tmp_path / "step").iterdir() if p.name.startswith("v-")]) == 2
    # A mark older than its term is no reader's any more, and so is data never published.
    held = stages.read_stage(spark, root, "step")
    stages.publish_stage(spark.range(3), root, "step")
    spark.range(2).write.parquet(f"{root}/step/v-orphan")
    assert held.count() == 9 and stage.remove_unread(keep=0) == [] and stage.versions() == [6, 7]
    assert (tmp_path / "step" / "v-orphan").exists()
    assert stage.remove_unread(keep=0, abandoned_h=-1) == [6]
    assert not (tmp_path / "step" / "v-orphan").exists()


def test_change_made_from_an_old_version_is_refused(spark, tmp_path):
    root = str(tmp_path)
    version = stages.publish_stage(spark.range(1), root, "step")
    stages.publish_stage(spark.range(2), root, "step", expect=version)
    with pytest.raises(StageConflict):
        stages.publish_stage(spark.range(3), root, "step", expect=version)
    assert stages.read_stage(spark, root, "step").count() == 2


def test_plain_folder_becomes_a_versioned_stage(spark, tmp_path):
    root = str(tmp_path)
    spark.range(3).write.parquet(f"{root}/step")
    plain = stages.read_stage(spark, root, "step")
    back = stages.write_stage(plain.withColumn("twice", 2 * F.col("id")), root, "step")
    assert sorted(tuple(r) for r in back.collect()) == [(0, 0), (1, 2), (2, 4)]
    with pytest.raises(FileNotFoundError):
        stages.read_stage(spark, root, "step", version=8)


def test_empty_stage_keeps_its_schema(spark, tmp_path):
    back = stages.write_stage(spark.range(3).filter("id < 0"), str(tmp_path), "step")
    assert back.columns == ["id"] and back.count() == 0


def test_catalog_name_published_from_itself(spark, tmp_path):
    stages.publish_table(spark.range(3), str(tmp_path), "tripweave_view")
    try:
        own = stages.read_table(spark, "tripweave_view")
        back = stages.publish_table(own.withColumn("more", F.lit("x")), str(tmp_path), "tripweave_view")
        assert back.columns == ["id", "more"] and back.count() == 3
    finally:
        spark.sql("DROP VIEW tripweave_view")
