"""Each query takes (spark, folder of parquet tables) and returns a DataFrame.

Check-ins are derived from ``events``.  Queries of one operator use the stand-in ``site``
column as cluster; the density queries and the two chains compute their own sites.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.operators import communities, density, graph, mcl, rank, routes, sitemodel, sites, sparse, trips
from tripweave.plans.lineage import cut_lineage, owns_copies, shared_folder
from tripweave.plans.ranking import compact_ids
from tripweave.queries.fixture import checkins_from_events, spoiled
from tripweave.queries.folders import name_folder
from tripweave.sources import checkins as source
from tripweave.sources import stages

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register ``build``; what it copies and its result does not read is removed at once."""

    @functools.wraps(build)
    def named(spark: SparkSession, folder: str) -> DataFrame:
        name_folder(spark)
        return owns_copies(build)(spark, folder)

    QUERIES[build.__name__] = named
    return named


# --- inputs -------------------------------------------------------------------------


def _checkins(spark: SparkSession, folder: str) -> DataFrame:
    events = stages.read_stage(spark, folder, "events.parquet")
    return checkins_from_events(spark, events)


def _clustered(spark: SparkSession, folder: str) -> DataFrame:
    return _checkins(spark, folder).withColumnRenamed("site", "cluster")


def _found(spark: SparkSession, folder: str, min_pts: int = 2) -> DataFrame:
    checkins = source.project_checkins(_checkins(spark, folder), ["event_id"])
    return density.dbscan(checkins, eps_m=400.0, min_pts=min_pts, spread_by=["event_id"])


def _at_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Check-ins with the sites found in them, noise dropped; a table, as it is read often."""
    return cut_lineage(sites.drop_noise(_found(spark, folder)))


def _edges(spark: SparkSession, folder: str, order: str = "time") -> DataFrame:
    return graph.transition_edges(_clustered(spark, folder), order)


def _graph(spark: SparkSession, folder: str, order: str = "time") -> graph.SiteGraph:
    return graph.site_graph(cut_lineage(_edges(spark, folder, order)))


def _matrix(spark: SparkSession, folder: str, order: str = "time") -> DataFrame:
    return sparse.as_matrix(_edges(spark, folder, order))


def _degrees(name: str) -> Column:
    """Coordinates to six places; the nudge keeps exact halves from rounding either way."""
    return F.round(F.col(name) + F.lit(1e-9), 6).alias(name)


def _listed(clusters: DataFrame) -> DataFrame:
    return clusters.select(
        "cluster_id", "attractor", "part", F.array_join(F.col("members").cast("array<string>"), ",").alias("members")
    )


# --- sources and sinks --------------------------------------------------------------


@query
def scan_checkins(spark, folder):
    return source.project_checkins(_checkins(spark, folder), ["event_id"])


@query
def stage_roundtrip(spark, folder):
    root = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    written = stages.write_graph(graph.site_graph(_edges(spark, folder)), root)
    back = stages.read_graph(spark, root)
    return back.edges.join(
        written.vertices.select(F.col("id").alias("dst"), F.col("normal").alias("dst_normal")), "dst"
    ).select("src", "dst", "normal", "dst_normal")


@query
def stage_rewrite(spark, folder):
    """Edges get a column and then another, each time as a new version of the stage they are
    read from; vertices likewise."""
    root = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    clustered = _clustered(spark, folder)
    stages.write_graph(graph.site_graph(cut_lineage(graph.transition_edges(clustered))), root)
    stages.publish_stage(graph.out_share(stages.read_graph(spark, root).edges), root, "graph_edges")
    stages.publish_stage(graph.transition_probabilities(stages.read_graph(spark, root).edges), root, "graph_edges")
    counted = graph.enrich_vertices(stages.read_graph(spark, root).vertices, sites.points_per_site(clustered))
    stages.publish_stage(counted, root, "graph_vertices")
    back = stages.read_graph(spark, root)
    return back.edges.join(back.vertices.select(F.col("id").alias("dst"), "num_points"), "dst")


# --- sites --------------------------------------------------------------------------


@query
def dbscan_sites(spark, folder):
    return _found(spark, folder).select("event_id", "cluster")


@query
def dbscan_minpts5(spark, folder):
    return _found(spark, folder, 5).select("event_id", "cluster")


@query
def dbscan_dirty(spark, folder):
    """Unusable coordinates are noise and leave the other sites as they are."""
    dirty = spoiled(source.project_checkins(_checkins(spark, folder), ["event_id"]))
    return density.dbscan(dirty, spread_by=["event_id"]).select("event_id", "cluster")


@query
def dbscan_transform(spark, folder):
    """Sites of two check-ins in three, saved as a model, label all check-ins moved a little north
    and east; the steps leave no check-in midway between two positions."""
    checkins = source.project_checkins(_checkins(spark, folder), ["event_id"])
    model = sitemodel.fit_sites(checkins.filter(F.col("event_id") % 3 != 0))
    saved = model.save(f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}")
    event = F.col("event_id")
    moved = checkins.withColumns(
        {
            "latitude": F.col("latitude") + (event % 7) * F.lit(0.00047) + F.lit(0.00011),
            "longitude": F.col("longitude") + (event % 5) * F.lit(0.00031) + F.lit(0.00013),
        }
    )
    return sitemodel.label_sites(saved, moved, spread_by=["event_id"]).select("event_id", "cluster")


@query
def dbscan_denoised(spark, folder):
    return sites.drop_noise(_found(spark, folder)).select("event_id", "user", "cluster")


@query
def site_centroids(spark, folder):
    return sites.site_centroids(sites.drop_noise(_found(spark, folder))).select(
        "cluster", _degrees("latitude"), _degrees("longitude")
    )


def _at_date_line(checkins: DataFrame) -> DataFrame:
    """The sites found, moved east until some lie across 180 degrees, and some of their check-ins
    a turn away."""
    moved = F.col("longitude") + F.lit(301.705)
    wrapped = F.when(moved >= 180, moved - 360).otherwise(moved)
    return checkins.withColumn("longitude", wrapped + 360 * (F.col("event_id") % 3 - 1))


@query
def site_centroids_turned(spark, folder):
    return sites.site_centroids(_at_date_line(_at_sites(spark, folder))).select(
        "cluster", _degrees("latitude"), _degrees("longitude"), "num_points"
    )


@query
def site_centroids_sphere(spark, folder):
    return sites.site_centroids(_at_date_line(_at_sites(spark, folder)), on="sphere").select(
        "cluster", _degrees("latitude"), _degrees("longitude"), "num_points"
    )


@query
def snap_to_sites(spark, folder):
    kept = _at_sites(spark, folder)
    return sites.snap_to_sites(kept, sites.site_centroids(kept), spread_by=["event_id"]).select(
        "event_id", "user", "checkinTime", "cluster", _degrees("latitude"), _degrees("longitude")
    )


@query
def compact_site_ids(spark, folder):
    gappy = _clustered(spark, folder).withColumn("cluster", F.col("cluster") * F.col("cluster") + 5)
    return compact_ids(gappy.select("event_id", "cluster"), "cluster", ["event_id"])


@query
def points_per_site(spark, folder):
    return sites.points_per_site(_clustered(spark, folder))


# --- trips --------------------------------------------------------------------------


@query
def trip_segments(spark, folder):
    return trips.segment_trips(_clustered(spark, folder)).select("event_id", "user", "gap", "trip")


def _histories(spark, folder, **options):
    def stop(s: Column) -> Column:
        return F.concat_ws(
            "@",
            s["cluster"],
            F.date_format(s["checkinTime"], "yyyy-MM-dd HH:mm:ss"),
            F.round(s["latitude"] * 1_000_000).cast("long"),
            F.round(s["longitude"] * 1_000_000).cast("long"),
        )

    text = F.array_join(F.transform("trips", lambda t: F.array_join(F.transform(t, stop), ",")), "|")
    return trips.trip_histories(_clustered(spark, folder), **options).select(
        "user", "part", "first_trip", F.size("trips").alias("num_trips"), text.alias("trips")
    )


@query
def trip_histories(spark, folder):
    return _histories(spark, folder)


@query
def trip_histories_paged(spark, folder):
    return _histories(spark, folder, max_stops=7)


@query
def trips_unnested(spark, folder):
    histories = trips.trip_histories(_clustered(spark, folder))
    return trips.explode_trips(histories).select("user", "trip", "cluster", "checkinTime")


def _previous(spark, folder, order):
    stops = trips.previous_stop(trips.segment_trips(_clustered(spark, folder)), order)
    return stops.select(
        "event_id",
        "user",
        "trip",
        "cluster",
        F.col("previous.cluster").alias("prev_cluster"),
        F.col("previous.checkinTime").alias("prev_time"),
    )


@query
def previous_stop(spark, folder):
    return _previous(spark, folder, "time")


@query
def previous_stop_struct(spark, folder):
    return _previous(spark, folder, "struct")


# --- graph --------------------------------------------------------------------------


@query
def edges_time(spark, folder):
    return _edges(spark, folder)


@query
def edges_struct(spark, folder):
    return _edges(spark, folder, "struct")


@query
def edges_no_id(spark, folder):
    """Check-ins as they come without an event number."""
    return graph.transition_edges(_clustered(spark, folder).drop("event_id"))


@query
def site_in_strength(spark, folder):
    return graph.in_strength(_edges(spark, folder))


@query
def site_out_strength(spark, folder):
    return graph.out_strength(_edges(spark, folder))


@query
def vertex_strength(spark, folder):
    return graph.vertex_table(_edges(spark, folder))


@query
def graph_dangling_check(spark, folder):
    """Ends of all edges that the vertices of a subgraph lack."""
    whole = _graph(spark, folder)
    inner = graph.induced_subgraph(whole, lambda site: site < 100)
    return graph.SiteGraph(inner.vertices, whole.edges).dangling_ends()


@query
def edge_out_share(spark, folder):
    return graph.out_share(_edges(spark, folder)).select("src", "dst", "out_share")


@query
def transition_prob(spark, folder):
    return graph.transition_probabilities(_edges(spark, folder))


@query
def vertices_enriched(spark, folder):
    clustered = _clustered(spark, folder)
    vertices = graph.vertex_table(graph.transition_edges(clustered))
    return graph.enrich_vertices(vertices, sites.points_per_site(clustered))


@query
def subgraph_edges(spark, folder):
    inner = graph.induced_subgraph(
        graph.site_graph(_edges(spark, folder)), lambda site: site < 100
    )
    return inner.edges


@query
def subgraph_by_rank(spark, folder):
    """Edges between the sites of more than average rank, with what both ends are worth."""
    whole = _graph(spark, folder)
    ranked = graph.SiteGraph(rank.pagerank(whole, tol=None, max_iter=20), whole.edges)
    inner = graph.vertex_subgraph(ranked, (F.col("pagerank") > 1) & (F.col("normal") > 50))
    ends = inner.vertices.select("id", "normal")
    return inner.edges.join(ends.toDF("src", "src_normal"), "src").join(ends.toDF("dst", "dst_normal"), "dst")


@query
def pagerank_20(spark, folder):
    ranked = rank.pagerank(_graph(spark, folder), tol=None, max_iter=20)
    return ranked.select("id", F.round("pagerank", 6).alias("pagerank"))


@query
def pagerank_converged(spark, folder):
    ranked = rank.pagerank(_graph(spark, folder), reset=0.15, tol=1e-5)
    return ranked.select("id", F.round("pagerank", 6).alias("pagerank"))


@query
def pagerank_top6(spark, folder):
    ranked = rank.pagerank(_graph(spark, folder), tol=None, max_iter=20)
    return graph.top_k(ranked, "pagerank", 6).select("id", F.round("pagerank", 6).alias("pagerank"))


@query
def lpa_labels(spark, folder):
    return communities.label_propagation(_graph(spark, folder)).select("id", "label")


@query
def lpa_struct(spark, folder):
    """Labels on the graph of sorted trips, where several communities last; every round sends
    only what has changed."""
    return communities.label_propagation(_graph(spark, folder, "struct"), few_edges=0).select("id", "label")


@query
def lpa_struct_top5(spark, folder):
    labelled = communities.label_propagation(_graph(spark, folder, "struct"))
    return graph.top_k(communities.community_sizes(labelled), "num_vertices", 5, then="label")


@query
def lpa_compact(spark, folder):
    labelled = communities.label_propagation(_graph(spark, folder))
    return compact_ids(labelled, "label", ["id"]).select("id", "label")


@query
def lpa_top5(spark, folder):
    sizes = communities.community_sizes(communities.label_propagation(_graph(spark, folder)))
    return graph.top_k(sizes, "num_vertices", 5, then="label")


# --- sparse matrices and Markov clustering ------------------------------------------


@query
def mat_multiply(spark, folder):
    m = _matrix(spark, folder)
    return sparse.multiply(m, m)


@query
def mat_gram(spark, folder):
    m = _matrix(spark, folder)
    return sparse.multiply_transposed(m, m)


@query
def mat_power3(spark, folder):
    return sparse.power(_matrix(spark, folder), 3)


@query
def mat_gram_power3(spark, folder):
    return sparse.power(_matrix(spark, folder), 3, product="gram")


@query
def mat_normalize(spark, folder):
    return sparse.normalize(_matrix(spark, folder))


@query
def mat_inflate(spark, folder):
    return sparse.inflate(_matrix(spark, folder), 2)


@query
def mat_prune(spark, folder):
    return sparse.prune(sparse.inflate(_matrix(spark, folder), 2), 0.001)


@query
def mat_prune_tight(spark, folder):
    """A threshold that drops most entries at every scale."""
    return sparse.prune(sparse.inflate(_matrix(spark, folder), 2), 0.02)


@query
def mat_converged(spark, folder):
    m = cut_lineage(sparse.normalize(_matrix(spark, folder)))
    cases = {
        "same": sparse.converged(m, m),
        "moved": sparse.converged(m, sparse.inflate(m, 2)),
        "appeared": sparse.converged(sparse.prune(m, 0.05), m),
        "vanished": sparse.converged(m, sparse.prune(m, 0.05)),
        "empty": sparse.converged(m, sparse.prune(m, 2.0)),
    }
    answer = None
    for name, case in cases.items():
        row = case.select(F.lit(name).alias("pair"), "converged")
        answer = row if answer is None else answer.unionByName(row)
    return answer


_TEXTBOOK = {"loop_value": "max", "normalize_input": True, "product": "power"}
_RAW_GRAM = {"loop_value": 0, "normalize_input": False, "product": "gram"}


@query
def mcl_attractors(spark, folder):
    flow = mcl.mcl_matrix(_matrix(spark, folder), iterations=1, **_TEXTBOOK)
    return _listed(mcl.attractor_clusters(flow))


@query
def mcl_power_5(spark, folder):
    return _listed(mcl.mcl(_matrix(spark, folder), iterations=5, **_TEXTBOOK))


@query
def mcl_gram_5(spark, folder):
    return _listed(mcl.mcl(_matrix(spark, folder), iterations=5, **_RAW_GRAM))


@query
def mcl_struct_gram_5(spark, folder):
    return _listed(mcl.mcl(_matrix(spark, folder, "struct"), iterations=5, **_RAW_GRAM))


@query
def mcl_default(spark, folder):
    """All defaults: loops of one, and passes until nothing moves."""
    return _listed(mcl.mcl(_matrix(spark, folder)))


@query
def mcl_clusters_paged(spark, folder):
    return _listed(mcl.mcl(_matrix(spark, folder), max_members=3, iterations=5, **_TEXTBOOK))


def _popular(edges):
    flow = mcl.mcl_matrix(sparse.as_matrix(edges), iterations=5, **_TEXTBOOK)
    return routes.route_graph(mcl.attractor_members(flow), edges)


def _routes(spark, folder):
    return _popular(cut_lineage(_edges(spark, folder)))


@query
def route_graph(spark, folder):
    return _routes(spark, folder)


@query
def routes_from_table(spark, folder):
    """Routes from clusters that were saved, in pages of three members, and read back."""
    edges = cut_lineage(_edges(spark, folder))
    clusters = mcl.mcl(sparse.as_matrix(edges), max_members=3, iterations=5, **_TEXTBOOK)
    saved = stages.write_stage(clusters, f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}", "mcl_clusters")
    return routes.route_graph(routes.listed_members(saved), edges)


@query
def routes_sorted(spark, folder):
    return routes.sort_routes(_routes(spark, folder))


# --- whole chains on the sites found ------------------------------------------------


@query
def site_transitions(spark, folder):
    """Check-ins to transition probabilities."""
    edges = graph.transition_edges(_at_sites(spark, folder))
    return graph.transition_probabilities(edges)


@query
def popular_routes(spark, folder):
    """Check-ins to popular routes."""
    return routes.sort_routes(_popular(cut_lineage(graph.transition_edges(_at_sites(spark, folder)))))


@query
def subgraph_routes(spark, folder):
    """Markov clustering of an induced subgraph of the sites found, and its popular routes."""
    whole = graph.site_graph(cut_lineage(graph.transition_edges(_at_sites(spark, folder))))
    inner = graph.induced_subgraph(whole, lambda site: site < 60)
    return _popular(cut_lineage(inner.edges))


@query
def site_profile(spark, folder):
    """All that is told of a site found: strength, rank, check-ins and community."""
    found = _at_sites(spark, folder)
    whole = graph.site_graph(cut_lineage(graph.transition_edges(found, "struct")))
    ranked = rank.pagerank(whole, tol=None, max_iter=20)
    counted = graph.enrich_vertices(ranked, sites.points_per_site(found))
    labelled = compact_ids(communities.label_propagation(whole).select("id", "label"), "label", ["id"])
    return counted.join(labelled.select("id", "label"), "id").select(
        "id", "normal", F.round("pagerank", 6).alias("pagerank"), "num_points", "label"
    )


@query
def edge_profile(spark, folder):
    """All that is told of an edge between sites found: moves, out-share and probability."""
    edges = cut_lineage(graph.transition_edges(_at_sites(spark, folder)))
    return graph.transition_probabilities(graph.out_share(edges)).select(
        "src", "dst", "normal", "out_share", "transfer_prob"
    )
