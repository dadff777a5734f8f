import numpy as np
import pytest

from tripweave.functions.geo import EARTH_RADIUS_M
from tripweave.operators.components import connected_components
from tripweave.operators.density import dbscan


def haversine(lat, lon):
    phi, lam = np.radians(lat), np.radians(lon)
    h = (
        np.sin((phi[:, None] - phi[None, :]) / 2) ** 2
        + np.cos(phi)[:, None] * np.cos(phi)[None, :] * np.sin((lam[:, None] - lam[None, :]) / 2) ** 2
    )
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def brute_dbscan(points, eps_m, min_pts):
    """All-pairs labels with our numbering: sites by smallest core position, border to smallest."""
    lat = np.array([p[0] for p in points])
    lon = np.array([p[1] for p in points])
    near = haversine(lat, lon) <= eps_m
    core = near.sum(axis=1) >= min_pts
    n = len(points)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in np.flatnonzero(near[i]):
            if core[i] and core[j]:
                root[find(i)] = find(int(j))
    first = {}
    for i in range(n):
        if core[i]:
            r = find(i)
            first[r] = min(first.get(r, points[i]), points[i])
    number = {r: k + 1 for k, r in enumerate(sorted(first, key=first.get))}
    labels = []
    for i in range(n):
        if core[i]:
            labels.append(number[find(i)])
        else:
            around = [number[find(int(j))] for j in np.flatnonzero(near[i]) if core[j]]
            labels.append(min(around) if around else None)
    return labels


def run(spark, points, eps_m, min_pts, **kw):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(points)]
    df = spark.createDataFrame(rows, "event_id long, latitude double, longitude double")
    got = dbscan(df, eps_m=eps_m, min_pts=min_pts, **kw).collect()
    assert len(got) == len(points)
    return [r["cluster"] for r in sorted(got, key=lambda r: r["event_id"])]


def meters_north(m):
    return float(np.degrees(m / EARTH_RADIUS_M))


def test_border_and_noise(spark):
    pts = [(meters_north(m), 0.0) for m in (0, 300, 600, 900, 50_000)]
    assert run(spark, pts, 400, 3) == [1, 1, 1, 1, None]
    assert run(spark, pts, 400, 3) == brute_dbscan(pts, 400, 3)


def test_date_line_and_pole(spark):
    half = meters_north(50)
    pts = [(0.0, 180 - half), (0.0, -180 + half), (90 - half, 10.0), (90 - half, -170.0)]
    assert run(spark, pts, 400, 2) == [1, 1, 2, 2]


def test_repeats_count_as_neighbours(spark):
    pts = [(10.0, 10.0)] * 3 + [(20.0, 20.0)]
    assert run(spark, pts, 400, 3) == [1, 1, 1, None]
    assert run(spark, pts, 400, 4) == [None] * 4


def test_rows_without_coordinates_are_noise(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 1.0), (2, 1.0, 1.0), (3, None, 1.0)],
        "event_id long, latitude double, longitude double",
    )
    got = {r["event_id"]: r["cluster"] for r in dbscan(df).collect()}
    assert got == {1: 1, 2: 1, 3: None}


def test_border_between_two_sites_takes_the_smaller(spark):
    # Two tight groups 760 m apart with one lone position half-way, min_pts above its count.
    left = [(meters_north(i), 0.0) for i in (0, 5, 10, 15)]
    right = [(meters_north(760 + i), 0.0) for i in (0, 5, 10, 15)]
    pts = [*right, (meters_north(385), 0.0), *left]
    assert run(spark, pts, 380, 10) == brute_dbscan(pts, 380, 10)
    assert run(spark, pts, 380, 4) == brute_dbscan(pts, 380, 4)


@pytest.mark.parametrize(
    "seed,n,spread_m,min_pts,kw",
    [
        (1, 150, 4000, 2, {}),
        (2, 150, 3000, 5, {}),
        (3, 250, 1500, 9, {"hot_rows": 7}),
        # Crowded cubes: every shortcut and every refinement must still be exact.
        (4, 300, 900, 3, {"hot_rows": 5, "pair_budget": 2}),
    ],
)
def test_against_all_pairs(spark, seed, n, spread_m, min_pts, kw):
    rng = np.random.default_rng(seed)
    deg = meters_north(spread_m)
    pts = [tuple(p) for p in np.round(rng.normal(0, deg, (n, 2)) + (45.0, 179.99), 7)]
    pts = [(a, b - 360 if b > 180 else b) for a, b in pts]
    pts += pts[:: n // 10]
    assert run(spark, pts, 400, min_pts, **kw) == brute_dbscan(pts, 400, min_pts)


@pytest.mark.parametrize("gap_m,sites", [(399.0, 1), (401.0, 2)])
def test_parallel_walls_need_refinement(spark, gap_m, sites):
    """Two long dense rows about eps apart: no shortcut decides, only the finer boxes do."""
    east = [k * 2.0 for k in range(100)]
    pts = [(0.0, meters_north(x)) for x in east] + [(meters_north(gap_m), meters_north(x)) for x in east]
    got = run(spark, pts, 400, 2, pair_budget=4)
    assert got == brute_dbscan(pts, 400, 2)
    assert len(set(got)) == sites


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_components(spark, hot_rows):
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)]
    loose = [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))]
    edges = spark.createDataFrame(chain + star + loose, "a long, b long")
    nodes = spark.range(0, 300).withColumnRenamed("id", "node")
    got = {r["node"]: r["component"] for r in connected_components(nodes, edges, hot_rows).collect()}
    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in chain + star + loose:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {i: find(i) for i in range(300)}


def test_unusable_coordinates_are_noise(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 40.0, 10.0), (2, 40.0, 370.0), (3, 400.0, 10.0), (4, -90.5, 10.0),
        (5, nan, nan), (6, nan, nan), (7, inf, 0.0), (8, 0.0, -inf), (9, None, 1.0), (10, 1.0, nan), (11, 1.0, nan),
    ]
    frame = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    got = {r["id"]: r["cluster"] for r in dbscan(frame, spread_by=["id"]).collect()}
    assert got == {1: 1, 2: 1} | dict.fromkeys(range(3, 12))
