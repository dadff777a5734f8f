"""A fitted site model against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripweave.operators import density, sitemodel

SCHEMA = "id long, latitude double, longitude double"


def _sphere(lat, lon):
    phi, lam = math.radians(lat), math.radians(lon)
    return math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi)


def _away(a, b):
    return sum((x - y) ** 2 for x, y in zip(_sphere(*a), _sphere(*b), strict=True))


def nearest_sites(fitted, asked, min_pts, eps_m=400.0):
    """Site of each asked position, by comparing it with every core position."""
    limit = density.chord_of(eps_m) ** 2
    places = sorted(set(fitted))
    around = {p: [q for q in places if _away(p, q) <= limit] for p in places}
    cores = [p for p in places if sum(fitted.count(q) for q in around[p]) >= min_pts]
    site, number = {}, 0
    for start in cores:
        if start in site:
            continue
        number += 1
        todo = [start]
        while todo:
            p = todo.pop()
            if p not in site:
                site[p] = number
                todo += [q for q in around[p] if q in set(cores)]
    answers = []
    for p in asked:
        near = [(_away(p, q), q) for q in cores]
        best = min(near, default=(9.0, None))
        answers.append(site[best[1]] if best[0] <= limit else None)
    return answers


def _check(spark, fitted, asked, min_pts, **options):
    frame = lambda rows: spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], SCHEMA)
    model = sitemodel.fit_sites(frame(fitted), min_pts=min_pts, **options)
    rows = sitemodel.label_sites(model, frame(asked), **options).orderBy("id").collect()
    assert [r["cluster"] for r in rows] == nearest_sites(fitted, asked, min_pts)
    return model


@pytest.mark.parametrize("leaf", [64, 3])
@pytest.mark.parametrize("min_pts", [2, 5])
def test_labels_are_those_of_the_nearest_core_position(spark, monkeypatch, leaf, min_pts):
    monkeypatch.setattr(sitemodel, "LEAF", leaf)
    rng = random.Random(leaf + min_pts)
    spot = lambda: (rng.uniform(48.0, 48.03), rng.uniform(11.0, 11.04))
    # Some spots by themselves and one crowded place far smaller than a cube.
    fitted = [spot() for _ in range(60)]
    fitted += [(48.01 + rng.uniform(0, 2e-4), 11.02 + rng.uniform(0, 2e-4)) for _ in range(80)]
    asked = [spot() for _ in range(150)] + fitted[::4]
    asked += [(48.01 + rng.uniform(-4e-3, 4e-3), 11.02 + rng.uniform(-6e-3, 6e-3)) for _ in range(100)]
    _check(spark, fitted, asked, min_pts)


def test_hot_cubes_are_split(spark, monkeypatch):
    monkeypatch.setattr(sitemodel, "LEAF", 4)
    rng = random.Random(3)
    crowd = [(10 + rng.uniform(0, 1e-3), 20 + rng.uniform(0, 1e-3)) for _ in range(60)]
    asked = [(10 + rng.uniform(-1e-3, 3e-3), 20 + rng.uniform(-1e-3, 4e-3)) for _ in range(200)]
    _check(spark, crowd, asked, 2, hot_rows=7)


def test_date_line_and_pole(spark):
    fitted = [(0.0, 179.9995), (0.0, -179.9995), (89.9999, 10.0), (89.9999, -170.0)]
    asked = [(0.0001, 180.0), (0.0, 539.9995), (90.0, 55.0), (0.5, 180.0)]
    _check(spark, fitted, asked, 2)


def test_core_positions_keep_their_site(spark, sf_dir):
    from tripweave.queries.catalog import _checkins

    checkins = _checkins(spark, sf_dir).select("event_id", "latitude", "longitude")
    model = sitemodel.fit_sites(checkins)
    theirs = density.dbscan(checkins, spread_by=["event_id"]).withColumnRenamed("cluster", "fitted")
    ours = sitemodel.label_sites(model, checkins, spread_by=["event_id"]).select("event_id", "cluster")
    # With two points a site has no border: every position with a neighbour is core.
    assert theirs.join(ours, "event_id").filter(~F.col("fitted").eqNullSafe(F.col("cluster"))).count() == 0


def test_unusable_positions_empty_frames_and_saving(spark, tmp_path):
    schema = SCHEMA + ", pid long, low double"
    fitted = spark.createDataFrame([(1, 1.0, 2.0, 1, 0.0), (2, 1.0, 2.0, 2, 0.0), (3, 91.0, 2.0, 3, 0.0)], schema)
    model = sitemodel.fit_sites(fitted).save(str(tmp_path))
    again = sitemodel.load_model(spark, str(tmp_path))
    assert again.eps_m == 400.0
    asked = spark.createDataFrame(
        [(1, 1.001, 2.0, 1, 0.0), (1, 1.001, 2.0, 1, 0.0), (2, None, 2.0, 1, 0.0), (3, float("nan"), 2.0, 1, 0.0),
         (4, 1.0, 362.0, 1, 0.0), (5, 1.0, float("inf"), 1, 0.0)],
        schema,
    )
    rows = sitemodel.label_sites(again, asked).collect()
    assert sorted((r["id"], r["cluster"]) for r in rows if r["cluster"]) == [(1, 1), (1, 1), (4, 1)] and len(rows) == 6
    assert sitemodel.label_sites(model, asked.limit(0)).collect() == []
    nothing = sitemodel.fit_sites(fitted.limit(0))
    assert {r["cluster"] for r in sitemodel.label_sites(nothing, asked).collect()} == {None}
