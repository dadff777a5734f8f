from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.operators import communities, graph, rank, sites
from tripweave.plans.skew import group_sizes, hot_keys, spread_join

G6 = [(1, 2), (1, 3), (2, 3), (3, 1), (3, 4), (5, 3), (6, 4)]


def weighted(spark, pairs, weights=None):
    weights = weights or [1] * len(pairs)
    rows = [(a, b, w) for (a, b), w in zip(pairs, weights, strict=True)]
    return spark.createDataFrame(rows, "src long, dst long, normal long")


def random_pairs(seed, n, m):
    rng = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b}
    # A hub that a third of the edges touch.
    pairs |= {(0, i) for i in range(1, n)} | {(i, 0) for i in range(1, n, 3)}
    return sorted(pairs)


def test_vertex_strength_is_in_plus_out(spark):
    edges = weighted(spark, G6, [5, 1, 2, 3, 4, 6, 7])
    vertices = {r["id"]: r["normal"] for r in graph.vertex_table(edges).collect()}
    outer = defaultdict(int)
    for r in graph.in_strength(edges).collect():
        outer[r["dst"]] += r["incoming_weight"]
    for r in graph.out_strength(edges).collect():
        outer[r["src"]] += r["outgoing_weight"]
    assert vertices == dict(outer)
    assert sum(vertices.values()) == 2 * 28


def test_dangling_ends(spark):
    edges = weighted(spark, G6)
    assert graph.site_graph(edges).dangling_ends().isEmpty()
    partial = graph.SiteGraph(graph.vertex_table(edges).filter("id <> 4"), edges)
    assert [r["id"] for r in partial.dangling_ends().collect()] == [4]


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_shares_per_source(spark, hot_rows):
    pairs = random_pairs(1, 30, 80)
    weights = [(a * 7 + b) % 11 + 1 for a, b in pairs]
    edges = weighted(spark, pairs, weights)
    degree, total = Counter(), Counter()
    for (a, _), w in zip(pairs, weights, strict=True):
        degree[a] += 1
        total[a] += w
    shares = graph.out_share(edges, hot_rows).collect()
    assert {(r["src"], r["dst"]): r["out_share"] for r in shares} == {
        p: 1 / degree[p[0]] for p in pairs
    }
    probabilities = graph.transition_probabilities(edges, hot_rows).collect()
    assert {(r["src"], r["dst"]): r["transfer_prob"] for r in probabilities} == {
        p: w / total[p[0]] for p, w in zip(pairs, weights, strict=True)
    }


def test_induced_subgraph_filters_at_the_scan(spark, tmp_path):
    path = str(tmp_path / "edges")
    weighted(spark, G6).write.parquet(path)
    inner = graph.induced_subgraph(graph.site_graph(spark.read.parquet(path)), lambda i: i < 4)
    assert {(r["src"], r["dst"]) for r in inner.edges.collect()} == {
        p for p in G6 if max(p) < 4
    }
    plan = inner.edges._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(src,4)" in plan and "LessThan(dst,4)" in plan


def test_enrich_and_top_k(spark):
    vertices = graph.vertex_table(weighted(spark, G6))
    counts = spark.createDataFrame([(1, 10), (2, 30), (3, 30)], "cluster long, num_points int")
    enriched = graph.enrich_vertices(vertices, counts)
    assert [(r["id"], r["num_points"]) for r in graph.top_k(enriched, "num_points", 2).collect()] == [
        (2, 30),
        (3, 30),
    ]
    assert enriched.count() == 3


def test_pagerank_of_the_small_graph(spark):
    got = rank.pagerank(graph.site_graph(weighted(spark, G6)), tol=1e-9)
    ranks = [r["pagerank"] for r in got.orderBy("id").collect()]
    want = [1.144577, 0.841327, 1.858105, 1.446227, 0.354882, 0.354882]
    assert np.allclose(ranks, want, atol=1e-6)
    with pytest.raises(ValueError):
        rank.pagerank(graph.site_graph(weighted(spark, G6)), tol=None)


@pytest.mark.parametrize("hot_rows", [4, 1_000_000])
def test_pagerank_against_dense(spark, hot_rows):
    n, pairs = 40, random_pairs(2, 40, 120)
    got = rank.pagerank(
        graph.site_graph(weighted(spark, pairs)), tol=None, max_iter=7, hot_rows=hot_rows
    ).collect()
    a = np.zeros((n, n))
    for s, d in pairs:
        a[d, s] = 1
    a = a / np.maximum(a.sum(axis=0), 1)
    r = np.ones(n)
    for _ in range(7):
        r = 0.15 + 0.85 * a @ r
    r = r * n / r.sum()
    assert np.allclose([x["pagerank"] for x in sorted(got, key=lambda x: x["id"])], r, rtol=1e-12)
    assert np.isclose(sum(x["pagerank"] for x in got), n)


def propagate(n, pairs, rounds):
    lines = pairs + [(b, a) for a, b in pairs]
    label = {i: i for i in range(n)}
    for _ in range(rounds):
        votes = defaultdict(Counter)
        for a, b in lines:
            votes[b][label[a]] += 1
        label = {
            i: min(votes[i], key=lambda x: (-votes[i][x], x)) if votes[i] else label[i] for i in label
        }
    return label


@pytest.mark.parametrize("hot_rows", [4, 1_000_000])
def test_label_propagation(spark, hot_rows):
    n, pairs = 40, random_pairs(4, 40, 60)
    edges = weighted(spark, pairs)
    vertices = spark.range(n + 1)
    for few in (0, communities.FEW_EDGES):
        got = communities.label_propagation(graph.SiteGraph(vertices, edges), 6, hot_rows, few_edges=few).collect()
        assert {r["id"]: r["label"] for r in got} == propagate(n + 1, pairs, 6)


def test_opposite_edges_vote_twice(spark):
    # Vertex 3 hears 2 twice (edges both ways) and 1 once.
    pairs = [(2, 3), (3, 2), (1, 3)]
    got = communities.label_propagation(graph.site_graph(weighted(spark, pairs)), 1).collect()
    assert {r["id"]: r["label"] for r in got}[3] == 2


def test_community_sizes(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 9)], "id long, label long")
    assert {(r["label"], r["num_vertices"]) for r in communities.community_sizes(df).collect()} == {
        (5, 2),
        (9, 1),
    }


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_sites(spark, hot_rows):
    df = spark.createDataFrame(
        [(1, 1, 0.0, 0.0), (2, 1, 2.0, 4.0), (3, 1, 4.0, 8.0), (4, 2, 9.0, 9.0), (5, None, 1.0, 1.0)],
        "event_id long, cluster int, latitude double, longitude double",
    )
    kept = sites.drop_noise(df)
    snapped = sites.snap_to_sites(kept, sites.site_centroids(kept), hot_rows=hot_rows)
    assert {(r["event_id"], r["latitude"], r["longitude"]) for r in snapped.collect()} == {
        (1, 2.0, 4.0),
        (2, 2.0, 4.0),
        (3, 2.0, 4.0),
        (4, 9.0, 9.0),
    }
    assert {(r["cluster"], r["num_points"]) for r in sites.points_per_site(kept).collect()} == {
        (1, 3),
        (2, 1),
    }


def _centroid(spark, rows, on):
    df = spark.createDataFrame([(1, *r) for r in rows], "cluster int, latitude double, longitude double")
    row = sites.site_centroids(df, on=on).first()
    return row["latitude"], row["longitude"], row["num_points"]


@pytest.mark.parametrize("on", ["plane", "sphere"])
def test_centroids_across_the_date_line_and_turns(spark, on):
    lat, lon, n = _centroid(spark, [(1.0, 179.9995), (1.0, -179.9995)], on)
    assert np.isclose(lat, 1.0, atol=1e-6) and np.isclose(abs(lon), 180.0) and n == 2
    lat, lon, _ = _centroid(spark, [(50.0, 10.0), (50.0, 370.0), (50.0, -350.0)], on)
    assert np.allclose((lat, lon), (50.0, 10.0))
    lat, lon, _ = _centroid(spark, [(0.0, 179.9), (0.0, -179.7)], on)
    assert np.allclose((lat, lon), (0.0, -179.9))
    lat, lon, _ = _centroid(spark, [(0.0, -0.1), (0.0, 0.3), (0.0, 360.1)], on)
    assert np.allclose((lat, lon), (0.0, 0.1), atol=1e-9)
    # A position that is none counts, and moves nothing.
    unusable = [(50.0, 10.0), (None, 10.0), (91.0, 90.0), (50.0, float("nan")), (float("nan"), 10.0)]
    lat, lon, n = _centroid(spark, unusable, on)
    assert np.allclose((lat, lon), (50.0, 10.0)) and n == 5


def test_centroids_on_the_sphere(spark):
    lat, _, _ = _centroid(spark, [(89.999, 0.0), (89.999, 90.0), (89.999, 180.0), (89.999, -90.0)], "sphere")
    assert np.isclose(lat, 90.0)
    assert _centroid(spark, [(0.0, 0.0), (0.0, 180.0)], "sphere") == (None, None, 2)


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_subgraph_by_any_column(spark, hot_rows):
    # Vertex 0 is a hub at both ends.
    pairs = random_pairs(8, 40, 150) + [(0, i) for i in range(1, 40)] + [(i, 0) for i in range(1, 40)]
    pairs = sorted(set(pairs))
    names = spark.createDataFrame([(i, f"v{i % 3}", None if i == 5 else i) for i in range(40)], "id long, kind string, w long")
    whole = graph.SiteGraph(names, weighted(spark, pairs))
    inner = graph.vertex_subgraph(whole, (F.col("kind") != "v1") & (F.col("w") < 30), hot_rows)
    kept = {i for i in range(30) if i % 3 != 1 and i != 5}
    assert {r["id"] for r in inner.vertices.collect()} == kept
    assert inner.edges.columns == whole.edges.columns
    assert sorted((r["src"], r["dst"]) for r in inner.edges.collect()) == [p for p in pairs if set(p) <= kept]
    assert graph.vertex_subgraph(whole, "id < 0").edges.count() == 0


def test_hub_edges_are_dealt_to_several_tasks(spark):
    """With no broadcast, the edges that leave and enter a hub meet its id in more than one task."""
    pairs = [(0, i) for i in range(1, 401)] + [(i, 0) for i in range(401, 801)]
    whole = graph.SiteGraph(spark.range(801), weighted(spark, pairs))
    keep = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in keep}
    for name, value in keep.items():
        spark.conf.set(name, value)
    try:
        def spread(hot_rows, end, pairs):
            ids = spark.range(801).toDF(end)
            sizes = group_sizes(weighted(spark, pairs), [end])
            hot = hot_keys(sizes, [end], hot_rows=hot_rows)
            other = "dst" if end == "src" else "src"
            met = spread_join(weighted(spark, pairs), ids, [end], [other], hot, "left_semi")
            rows = met.filter(F.col(end) == 0).groupBy(F.spark_partition_id()).count().collect()
            return sorted(r["count"] for r in rows)

        assert spread(1_000_000, "src", pairs[:400]) == [400]
        for end, own in (("src", pairs[:400]), ("dst", pairs[400:])):
            dealt = spread(20, end, own)
            assert len(dealt) == 4 and max(dealt) < 200 and sum(dealt) == 400
        assert graph.vertex_subgraph(whole, "id < 500", hot_rows=20).edges.count() == 499
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.mark.parametrize("hot_rows", [4, 1_000_000])
def test_vertices_at_rest_send_nothing(spark, hot_rows):
    """A chain that leads into a cycle: vertices come to rest one after the other."""
    pairs = [(i, i + 1) for i in range(30)] + [(30, 31), (31, 32), (32, 30), (31, 30), (40, 30), (41, 42)]
    vertices = spark.range(45)
    a = np.zeros((45, 45))
    for s, d in pairs:
        a[d, s] = 1
    a = a / np.maximum(a.sum(axis=0), 1)
    r, rounds = np.ones(45), 0
    while True:
        old, r, rounds = r, 0.15 + 0.85 * a @ r, rounds + 1
        if abs(r - old).max() <= 1e-6:
            break
    told = []
    whole = graph.SiteGraph(vertices, weighted(spark, pairs))
    got = rank.pagerank(whole, tol=1e-6, hot_rows=hot_rows, on_round=lambda n, sent: told.append((n, sent))).collect()
    ranks = np.array([x["pagerank"] for x in sorted(got, key=lambda x: x["id"])])
    # All deviations together stay within the slack of the tolerance.
    assert abs(ranks - r * 45 / r.sum()).sum() <= 2 * 1e-3 * 1e-6
    assert [n for n, _ in told] == list(range(1, rounds + 1))
    sent = [m for _, m in told]
    assert sent[0] == len(pairs) and max(sent[1:]) <= 5
    exact = rank.pagerank(whole, tol=1e-6, hot_rows=hot_rows, slack=0.0, max_iter=rounds).collect()
    assert np.allclose([x["pagerank"] for x in sorted(exact, key=lambda x: x["id"])], r * 45 / r.sum(), rtol=1e-12)
    assert rank.pagerank(whole, tol=1e-6, max_iter=3).count() == 45
    assert rank.pagerank(graph.SiteGraph(vertices.limit(0), weighted(spark, pairs).limit(0))).collect() == []


@pytest.mark.parametrize("rounds", [0, 1, 2, 3, 5, 9])
def test_changed_labels_alone_give_the_full_rounds(spark, rounds):
    n, pairs = 60, random_pairs(rounds, 60, 90)
    pairs = [p for p in pairs if 0 not in p] + [(50, 51), (51, 50)]
    told = []
    whole = graph.SiteGraph(spark.range(n + 1), weighted(spark, pairs))
    got = communities.label_propagation(whole, rounds, on_round=lambda i, sent: told.append(sent), few_edges=0).collect()
    assert {r["id"]: r["label"] for r in got} == propagate(n + 1, pairs, rounds)
    assert len(told) <= rounds and told[:1] == [2 * len(pairs)][:rounds]
    assert all(sent <= 2 * len(pairs) for sent in told)


def test_labels_that_swing_and_labels_at_rest(spark):
    # 1 and 2 swing for ever; 10 to 13 are at rest after two rounds, and then send nothing.
    swing, rest = [(1, 2)], [(a, b) for a in range(10, 14) for b in range(10, 14) if a < b]
    for pairs, last in ((swing, 2), (rest, None), (swing + rest, 2)):
        told = []
        whole = graph.site_graph(weighted(spark, pairs))
        got = communities.label_propagation(whole, 7, on_round=lambda i, sent: told.append(sent), few_edges=0).collect()
        want = propagate(14, pairs, 7)
        assert {r["id"]: r["label"] for r in got} == {i: want[i] for p in pairs for i in p}
        assert (told[-1] == last and len(told) == 7) if last else len(told) < 5
    assert communities.label_propagation(graph.SiteGraph(spark.range(0), weighted(spark, rest).limit(0))).collect() == []
