"""Empty inputs give empty outputs."""

from tripweave.operators import communities, density, graph, mcl, rank, sparse, trips

SCHEMA = "event_id long, user long, checkinTime timestamp_ntz, cluster int, latitude double, longitude double"


def test_empty_checkins(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert density.dbscan(nothing.drop("cluster")).count() == 0
    assert trips.trip_histories(nothing).count() == 0
    assert graph.transition_edges(nothing, "struct").count() == 0


def test_empty_graph(spark):
    empty = graph.site_graph(spark.createDataFrame([], "src long, dst long, normal long"))
    assert rank.pagerank(empty).count() == 0
    assert communities.label_propagation(empty).count() == 0
    assert mcl.mcl(sparse.as_matrix(empty.edges), iterations=2).count() == 0
