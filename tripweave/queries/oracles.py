"""SQL that DuckDB runs on the same tables, one text per query of the catalog."""

from __future__ import annotations

from tripweave.queries.fixture import SPOILED

_CHECKINS = """
e AS (
  SELECT event_id, user_id, ts,
    CASE WHEN event_id % 10 = 0 THEN (event_id * 13) % 120
         ELSE (user_id % 8) * 15 + (event_id * event_id + user_id) % 15 END AS site,
    CAST((event_id - event_id % 53) / 53 AS BIGINT) AS n
  FROM events),
checkins AS (
  SELECT event_id, user_id AS "user", ts AS "checkinTime", site,
    CAST(CASE WHEN event_id % 53 = 0 THEN -60000000 + (n % 1000) * 20000
         ELSE 37000000 + CAST((site - site % 12) / 12 AS BIGINT) * 50000
              + ((event_id * 31) % 5 - 2) * 2000 END AS DOUBLE) / 1000000 AS latitude,
    CAST(CASE WHEN event_id % 53 = 0 THEN 100000000 + CAST((n - n % 1000) / 1000 AS BIGINT) * 100000
         ELSE -122000000 + (site % 12) * 50000
              + ((event_id * 17 + user_id) % 5 - 2) * 2000 END AS DOUBLE) / 1000000 AS longitude
  FROM e)"""

_STAND_IN = _CHECKINS + """,
stops AS (SELECT event_id, "user", "checkinTime", site AS cluster, latitude, longitude FROM checkins)"""


def _density(min_pts: int, without: str = "false") -> str:
    """All-pairs DBSCAN; ``found`` has every check-in with its site or null.  Check-ins for which
    ``without`` holds are left out, and so are not in ``found``."""
    return _CHECKINS + f""",
usable AS (SELECT * FROM checkins WHERE NOT ({without})),
positions AS (
  SELECT latitude AS lat, longitude AS lon, count(*) AS m,
    row_number() OVER (ORDER BY latitude, longitude) AS pid
  FROM usable GROUP BY latitude, longitude),
pairs AS MATERIALIZED (
  SELECT a.pid AS p, b.pid AS q, b.m
  FROM positions a JOIN positions b ON b.lat BETWEEN a.lat - 0.004 AND a.lat + 0.004
  WHERE 2 * 6371008.8 * asin(sqrt(least(1.0,
      power(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= 400),
core AS MATERIALIZED (SELECT p AS pid FROM pairs GROUP BY p HAVING sum(m) >= {min_pts}),
links AS MATERIALIZED (
  SELECT p, q FROM pairs WHERE p IN (SELECT pid FROM core) AND q IN (SELECT pid FROM core)),
reached(pid, root) AS (
  SELECT pid, pid FROM core
  UNION
  SELECT l.q, r.root FROM reached r JOIN links l ON l.p = r.pid),
component AS (SELECT pid, min(root) AS root FROM reached GROUP BY pid),
numbered AS (SELECT pid, dense_rank() OVER (ORDER BY root) AS site FROM component),
labels AS (
  SELECT pid, site FROM numbered
  UNION ALL
  SELECT x.p, min(n.site) FROM pairs x JOIN numbered n ON n.pid = x.q
  WHERE x.p NOT IN (SELECT pid FROM core) GROUP BY x.p),
found AS MATERIALIZED (
  SELECT c.event_id, c."user", c."checkinTime", c.latitude, c.longitude, CAST(l.site AS INTEGER) AS cluster
  FROM usable c
  JOIN positions s ON s.lat = c.latitude AND s.lon = c.longitude
  LEFT JOIN labels l ON l.pid = s.pid)"""


_MODEL_LABELS = _density(2, "event_id % 3 = 0") + """,
moved AS (
  SELECT event_id, latitude + (event_id % 7) * 0.00047::DOUBLE + 0.00011::DOUBLE AS lat,
    longitude + (event_id % 5) * 0.00031::DOUBLE + 0.00013::DOUBLE AS lon
  FROM checkins),
nearest AS (
  SELECT a.lat, a.lon, min({'away': power(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2),
    'pid': b.pid, 'site': n.site}) AS best
  FROM (SELECT DISTINCT lat, lon FROM moved) a
  JOIN positions b ON b.lat BETWEEN a.lat - 0.004 AND a.lat + 0.004
  JOIN numbered n ON n.pid = b.pid
  GROUP BY a.lat, a.lon),
labelled AS (
  SELECT lat, lon, best.site AS site FROM nearest
  WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, best.away))) <= 400)"""

# Site numbers are dense as they come.
_FOUND_STOPS = _density(2) + """,
stops AS (SELECT * FROM found WHERE cluster IS NOT NULL)"""

_CENTROIDS = """,
centroids AS (
  SELECT cluster, avg(latitude) AS latitude, avg(longitude) AS longitude
  FROM found WHERE cluster IS NOT NULL GROUP BY cluster)"""

_AT_DATE_LINE = """,
moved AS (
  SELECT cluster, latitude, CASE WHEN longitude + 301.705 >= 180 THEN longitude + 301.705 - 360 ELSE longitude + 301.705 END AS turned
  FROM found WHERE cluster IS NOT NULL)"""

_TRIPS = """,
timed AS (
  SELECT *, CAST(floor(epoch_us("checkinTime") / 1000000) AS BIGINT) AS s FROM stops),
lagged AS (
  SELECT *, s - lag(s) OVER (PARTITION BY "user" ORDER BY "checkinTime", event_id) AS gap FROM timed),
trips AS (
  SELECT *, CAST(sum(CASE WHEN gap > 259200 THEN 1 ELSE 0 END) OVER (
      PARTITION BY "user" ORDER BY "checkinTime", event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS trip
  FROM lagged)"""

_ORDERS = {
    "time": '"checkinTime", event_id',
    "struct": 'cluster, latitude, longitude, "checkinTime", event_id',
}


def _edges(order: str = "time", stops: str = _STAND_IN) -> str:
    return stops + _TRIPS + f""",
moves AS (
  SELECT lag(cluster) OVER (PARTITION BY "user", trip ORDER BY {_ORDERS[order]}) AS src, cluster AS dst
  FROM trips),
edges AS MATERIALIZED (
  SELECT src, dst, count(*) AS normal FROM moves
  WHERE src IS NOT NULL AND src <> dst GROUP BY src, dst)"""


_VERTICES = """,
vertices AS (
  SELECT coalesce(i.dst, o.src) AS id,
    CAST(coalesce(i.w, 0) + coalesce(o.w, 0) AS BIGINT) AS normal
  FROM (SELECT dst, sum(normal) AS w FROM edges GROUP BY dst) i
  FULL OUTER JOIN (SELECT src, sum(normal) AS w FROM edges GROUP BY src) o ON i.dst = o.src)"""

_RANK_LINES = """,
degrees AS (SELECT src, count(*) AS degree FROM edges GROUP BY src),
lines AS MATERIALIZED (
  SELECT e.src, e.dst, 1.0::DOUBLE / d.degree AS part FROM edges e JOIN degrees d ON d.src = e.src
  UNION ALL SELECT id, id, 0.0::DOUBLE FROM vertices)"""

_RANKED_20 = """,
pr(step, id, r) AS (
  SELECT 0, id, 1.0::DOUBLE FROM vertices
  UNION ALL
  SELECT p.step + 1, l.dst, 0.15 + 0.85 * sum(l.part * p.r)
  FROM pr p JOIN lines l ON l.src = p.id WHERE p.step < 20 GROUP BY p.step, l.dst),
ranked AS (
  SELECT id, r * (SELECT count(*) FROM vertices) / (SELECT sum(r) FROM pr WHERE step = 20) AS pagerank
  FROM pr WHERE step = 20)"""
_RANK_20 = _edges() + _VERTICES + _RANK_LINES + _RANKED_20

_RANK_TOL = _edges() + _VERTICES + _RANK_LINES + """,
pr(step, id, r, moved) AS (
  SELECT 0, id, 1.0::DOUBLE, 1.0::DOUBLE FROM vertices
  UNION ALL
  SELECT step, id, r, max(abs(r - old)) OVER ()
  FROM (
    SELECT p.step + 1 AS step, l.dst AS id, 0.15 + 0.85 * sum(l.part * p.r) AS r,
      max(CASE WHEN l.part = 0 THEN p.r END) AS old
    FROM pr p JOIN lines l ON l.src = p.id WHERE p.moved > 1e-5 GROUP BY p.step, l.dst)),
ranked AS (
  SELECT id, r * count(*) OVER () / sum(r) OVER () AS pagerank
  FROM pr WHERE step = (SELECT max(step) FROM pr))"""

_LABELLED = """,
ties AS MATERIALIZED (
  SELECT src, dst, 1 AS votes FROM edges
  UNION ALL SELECT dst, src, 1 FROM edges
  UNION ALL SELECT id, id, 0 FROM vertices),
lp(step, id, label) AS (
  SELECT 0, id, id FROM vertices
  UNION ALL
  SELECT step, id, label FROM (
    SELECT p.step + 1 AS step, l.dst AS id, p.label,
      row_number() OVER (PARTITION BY l.dst ORDER BY sum(l.votes) DESC, p.label) AS place
    FROM lp p JOIN ties l ON l.src = p.id WHERE p.step < 10 GROUP BY p.step, l.dst, p.label)
  WHERE place = 1),
labelled AS (SELECT id, label FROM lp WHERE step = 10)"""
_LABELS = _edges() + _VERTICES + _LABELLED

_MATRIX = """,
a0 AS (SELECT CAST(src AS BIGINT) AS i, CAST(dst AS BIGINT) AS j, CAST(normal AS DOUBLE) AS v FROM edges)"""

_NORMALIZED = """,
n0 AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM a0)"""

_INFLATED = """,
n0 AS MATERIALIZED (SELECT i, j, v * v / sum(v * v) OVER (PARTITION BY j) AS v FROM a0)"""

_LOOPED = """,
ends AS (SELECT i AS k, NULL::DOUBLE AS v FROM a0 UNION ALL SELECT j, v FROM a0),
looped AS (
  SELECT i, j, sum(v) AS v FROM (
    SELECT * FROM a0 UNION ALL SELECT k, k, coalesce(max(v), 1.0) FROM ends GROUP BY k)
  GROUP BY i, j),
m0 AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM looped)"""

_UNLOOPED = """,
m0 AS MATERIALIZED (SELECT * FROM a0)"""


def _passes(count: int, product: str) -> str:
    inner, column = ("b.i", "b.j") if product == "power" else ("b.j", "b.i")
    text = ""
    for k in range(1, count + 1):
        text += f""",
m{k} AS MATERIALIZED (
  SELECT i, j, v FROM (
    SELECT i, j, s * s / sum(s * s) OVER (PARTITION BY j) AS v FROM (
      SELECT a.i, {column} AS j, sum(a.v * b.v) AS s
      FROM m{k - 1} a JOIN m{k - 1} b ON a.j = {inner} GROUP BY a.i, {column}))
  WHERE v > 0.001)"""
    return text


def _members(last: int) -> str:
    return f""",
members AS (
  SELECT i AS attractor, j AS member FROM m{last}
  WHERE i IN (SELECT i FROM m{last} WHERE i = j AND v > 0))"""


_LOOPED_ONE = """,
looped AS (
  SELECT i, j, sum(v) AS v FROM (
    SELECT * FROM a0 UNION ALL SELECT k, k, 1.0::DOUBLE FROM (SELECT i AS k FROM a0 UNION SELECT j FROM a0))
  GROUP BY i, j),
m0 AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM looped)"""

# Passes after nothing moves any more change nothing, so there may be too many.
_DEFAULT_PASSES = 40
_DEFAULT = _MATRIX + _LOOPED_ONE + _passes(_DEFAULT_PASSES, "power") + _members(_DEFAULT_PASSES)
_TEXTBOOK = _MATRIX + _LOOPED + _passes(5, "power") + _members(5)
_RAW_GRAM = _MATRIX + _UNLOOPED + _passes(5, "gram") + _members(5)

_LISTED = """
SELECT dense_rank() OVER (ORDER BY attractor) - 1 AS cluster_id, attractor, CAST(0 AS INTEGER) AS part,
  string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS members
FROM members GROUP BY attractor"""

_PAGED = """
SELECT dense_rank() OVER (ORDER BY attractor) - 1 AS cluster_id, attractor, part,
  string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS members
FROM (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY attractor ORDER BY member) - 1) / 3) AS INTEGER) AS part
  FROM members)
GROUP BY attractor, part"""

_ROUTES = """,
routes AS (
  SELECT e.src, e.dst, e.normal AS weight
  FROM members x JOIN edges e ON e.src = x.attractor AND e.dst = x.member)"""

_PROBABILITY = """
SELECT src, dst, normal, normal / CAST(sum(normal) OVER (PARTITION BY src) AS DOUBLE) AS transfer_prob FROM edges"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.lstrip()}\n{select.strip()}"


ORACLES: dict[str, str] = {
    "scan_checkins": _with(
        _CHECKINS, 'SELECT "user", "checkinTime", latitude, longitude, event_id FROM checkins'
    ),
    "stage_roundtrip": _with(
        _edges() + _VERTICES,
        "SELECT e.src, e.dst, e.normal, v.normal AS dst_normal FROM edges e JOIN vertices v ON v.id = e.dst",
    ),
    "stage_rewrite": _with(
        _edges(),
        """SELECT e.dst, e.src, e.normal, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS out_share,
          e.normal / CAST(sum(e.normal) OVER (PARTITION BY src) AS DOUBLE) AS transfer_prob, c.num_points
        FROM edges e
        JOIN (SELECT cluster, CAST(count(*) AS INTEGER) AS num_points FROM stops GROUP BY cluster) c ON c.cluster = e.dst""",
    ),
    "dbscan_sites": _with(_density(2), "SELECT event_id, cluster FROM found"),
    "dbscan_minpts5": _with(_density(5), "SELECT event_id, cluster FROM found"),
    "dbscan_dirty": _with(
        _density(2, SPOILED),
        f"""SELECT event_id, cluster FROM found
        UNION ALL SELECT event_id, NULL FROM checkins WHERE {SPOILED}""",
    ),
    "dbscan_transform": _with(
        _MODEL_LABELS,
        "SELECT event_id, CAST(site AS INTEGER) AS cluster FROM moved LEFT JOIN labelled USING (lat, lon)",
    ),
    "dbscan_denoised": _with(
        _density(2), 'SELECT event_id, "user", cluster FROM found WHERE cluster IS NOT NULL'
    ),
    "site_centroids": _with(
        _density(2) + _CENTROIDS,
        """SELECT cluster, round(latitude + 1e-9, 6) AS latitude, round(longitude + 1e-9, 6) AS longitude
        FROM centroids""",
    ),
    "site_centroids_turned": _with(
        _density(2) + _AT_DATE_LINE,
        """SELECT cluster, round(avg(latitude) + 1e-9, 6) AS latitude,
          round(CASE WHEN avg(around) >= 180 THEN avg(around) - 360 ELSE avg(around) END + 1e-9, 6) AS longitude,
          count(*) AS num_points
        FROM (SELECT *, CASE WHEN turned < 0 THEN turned + 360 ELSE turned END AS around FROM moved) GROUP BY cluster""",
    ),
    "site_centroids_sphere": _with(
        _density(2) + _AT_DATE_LINE,
        """SELECT cluster, round(degrees(atan2(z, sqrt(x * x + y * y))) + 1e-9, 6) AS latitude,
          round(degrees(atan2(y, x)) + 1e-9, 6) AS longitude, num_points
        FROM (
          SELECT cluster, count(*) AS num_points, avg(sin(radians(latitude))) AS z,
            avg(cos(radians(latitude)) * cos(radians(turned))) AS x, avg(cos(radians(latitude)) * sin(radians(turned))) AS y
          FROM moved GROUP BY cluster)""",
    ),
    "snap_to_sites": _with(
        _density(2) + _CENTROIDS,
        """SELECT f.event_id, f."user", f."checkinTime", f.cluster,
          round(c.latitude + 1e-9, 6) AS latitude, round(c.longitude + 1e-9, 6) AS longitude
        FROM found f JOIN centroids c ON c.cluster = f.cluster""",
    ),
    "compact_site_ids": _with(
        _STAND_IN,
        """SELECT event_id, CAST(dense_rank() OVER (ORDER BY cluster * cluster + 5) AS INTEGER) AS cluster
        FROM stops""",
    ),
    "points_per_site": _with(
        _STAND_IN, "SELECT cluster, CAST(count(*) AS INTEGER) AS num_points FROM stops GROUP BY cluster"
    ),
    "trip_segments": _with(_STAND_IN + _TRIPS, 'SELECT event_id, "user", gap, trip FROM trips'),
    **{
        name: _with(
            _STAND_IN + _TRIPS,
            f"""SELECT "user", part, min(trip) AS first_trip,
              CAST(count(*) AS INTEGER) AS num_trips, string_agg(stops, '|' ORDER BY trip) AS trips
            FROM (
              SELECT "user", part, trip, string_agg(
                concat_ws('@', cluster, strftime("checkinTime", '%Y-%m-%d %H:%M:%S'),
                  CAST(round(latitude * 1000000) AS BIGINT), CAST(round(longitude * 1000000) AS BIGINT)),
                ',' ORDER BY "checkinTime", event_id) AS stops
              FROM (
                SELECT *, CAST(floor((row_number() OVER (
                    PARTITION BY "user" ORDER BY "checkinTime", event_id) - 1) / {page}) AS INTEGER) AS part
                FROM trips)
              GROUP BY "user", part, trip)
            GROUP BY "user", part""",
        )
        for name, page in (("trip_histories", 1_000_000), ("trip_histories_paged", 7))
    },
    "trips_unnested": _with(
        _STAND_IN + _TRIPS, 'SELECT "user", trip, cluster, "checkinTime" FROM trips'
    ),
    **{
        name: _with(
            _STAND_IN + _TRIPS,
            f"""SELECT event_id, "user", trip, cluster, lag(cluster) OVER w AS prev_cluster,
              lag("checkinTime") OVER w AS prev_time
            FROM trips WINDOW w AS (PARTITION BY "user", trip ORDER BY {_ORDERS[order]})""",
        )
        for name, order in (("previous_stop", "time"), ("previous_stop_struct", "struct"))
    },
    "edges_time": _with(_edges(), "SELECT src, dst, normal FROM edges"),
    "edges_no_id": _with(_edges(), "SELECT src, dst, normal FROM edges"),
    "edges_struct": _with(_edges("struct"), "SELECT src, dst, normal FROM edges"),
    "site_in_strength": _with(
        _edges(), "SELECT dst, CAST(sum(normal) AS BIGINT) AS incoming_weight FROM edges GROUP BY dst"
    ),
    "site_out_strength": _with(
        _edges(), "SELECT src, CAST(sum(normal) AS BIGINT) AS outgoing_weight FROM edges GROUP BY src"
    ),
    "vertex_strength": _with(_edges() + _VERTICES, "SELECT id, normal FROM vertices"),
    "graph_dangling_check": _with(
        _edges(), "SELECT id FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) WHERE id >= 100"
    ),
    "edge_out_share": _with(
        _edges(), "SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS out_share FROM edges"
    ),
    "transition_prob": _with(_edges(), _PROBABILITY),
    "vertices_enriched": _with(
        _edges() + _VERTICES,
        """SELECT v.id, v.normal, c.num_points FROM vertices v
        JOIN (SELECT cluster, CAST(count(*) AS INTEGER) AS num_points FROM stops GROUP BY cluster) c
          ON v.id = c.cluster""",
    ),
    "subgraph_edges": _with(_edges(), "SELECT src, dst, normal FROM edges WHERE src < 100 AND dst < 100"),
    "subgraph_by_rank": _with(
        _RANK_20 + ",\nkept AS (SELECT id, normal FROM vertices JOIN ranked USING (id) WHERE pagerank > 1 AND normal > 50)",
        """SELECT e.src, e.dst, e.normal, s.normal AS src_normal, d.normal AS dst_normal
        FROM edges e JOIN kept s ON s.id = e.src JOIN kept d ON d.id = e.dst""",
    ),
    "pagerank_20": _with(_RANK_20, "SELECT id, round(pagerank, 6) AS pagerank FROM ranked"),
    "pagerank_converged": _with(_RANK_TOL, "SELECT id, round(pagerank, 6) AS pagerank FROM ranked"),
    "pagerank_top6": _with(
        _RANK_20,
        "SELECT id, round(pagerank, 6) AS pagerank FROM (SELECT * FROM ranked ORDER BY pagerank DESC, id LIMIT 6)",
    ),
    "lpa_labels": _with(_LABELS, "SELECT id, label FROM labelled"),
    "lpa_struct": _with(_edges("struct") + _VERTICES + _LABELLED, "SELECT id, label FROM labelled"),
    "lpa_struct_top5": _with(
        _edges("struct") + _VERTICES + _LABELLED,
        """SELECT label, count(*) AS num_vertices FROM labelled GROUP BY label
        ORDER BY num_vertices DESC, label LIMIT 5""",
    ),
    "lpa_compact": _with(
        _LABELS, "SELECT id, CAST(dense_rank() OVER (ORDER BY label) AS INTEGER) AS label FROM labelled"
    ),
    "lpa_top5": _with(
        _LABELS,
        """SELECT label, count(*) AS num_vertices FROM labelled GROUP BY label
        ORDER BY num_vertices DESC, label LIMIT 5""",
    ),
    "mat_multiply": _with(
        _edges() + _MATRIX,
        "SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a0 a JOIN a0 b ON a.j = b.i GROUP BY a.i, b.j",
    ),
    "mat_gram": _with(
        _edges() + _MATRIX,
        "SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM a0 a JOIN a0 b ON a.j = b.j GROUP BY a.i, b.i",
    ),
    "mat_power3": _with(
        _edges()
        + _MATRIX
        + """,
a2 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a0 a JOIN a0 b ON a.j = b.i GROUP BY a.i, b.j)""",
        "SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a2 a JOIN a0 b ON a.j = b.i GROUP BY a.i, b.j",
    ),
    "mat_gram_power3": _with(
        _edges()
        + _MATRIX
        + """,
a2 AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM a0 a JOIN a0 b ON a.j = b.j GROUP BY a.i, b.i)""",
        "SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM a2 a JOIN a0 b ON a.j = b.j GROUP BY a.i, b.i",
    ),
    "mat_normalize": _with(_edges() + _MATRIX + _NORMALIZED, "SELECT i, j, v FROM n0"),
    "mat_inflate": _with(_edges() + _MATRIX + _INFLATED, "SELECT i, j, v FROM n0"),
    "mat_prune": _with(_edges() + _MATRIX + _INFLATED, "SELECT i, j, v FROM n0 WHERE v > 0.001"),
    "mat_prune_tight": _with(_edges() + _MATRIX + _INFLATED, "SELECT i, j, v FROM n0 WHERE v > 0.02"),
    "mat_converged": _with(
        _edges()
        + _MATRIX
        + _NORMALIZED
        + """,
cut AS (SELECT * FROM n0 WHERE v > 0.05),
grown AS (SELECT i, j, v * v / sum(v * v) OVER (PARTITION BY j) AS v FROM n0),
cases AS (
  SELECT 'same' AS pair, n.v AS new, o.v AS old FROM n0 n LEFT JOIN n0 o USING (i, j)
  UNION ALL SELECT 'moved', n.v, o.v FROM grown n LEFT JOIN n0 o USING (i, j)
  UNION ALL SELECT 'appeared', n.v, o.v FROM n0 n LEFT JOIN cut o USING (i, j)
  UNION ALL SELECT 'vanished', n.v, o.v FROM cut n LEFT JOIN n0 o USING (i, j)
  UNION ALL SELECT 'empty', NULL, NULL)""",
        """SELECT pair, coalesce(bool_and(abs(coalesce(old, 0) - new) <= 1e-8 + 1e-5 * abs(new)), true) AS converged
        FROM cases GROUP BY pair""",
    ),
    "mcl_attractors": _with(_edges() + _MATRIX + _LOOPED + _passes(1, "power") + _members(1), _LISTED),
    "mcl_power_5": _with(_edges() + _TEXTBOOK, _LISTED),
    "mcl_gram_5": _with(_edges() + _RAW_GRAM, _LISTED),
    "mcl_struct_gram_5": _with(_edges("struct") + _RAW_GRAM, _LISTED),
    "mcl_default": _with(_edges() + _DEFAULT, _LISTED),
    "mcl_clusters_paged": _with(_edges() + _TEXTBOOK, _PAGED),
    "route_graph": _with(_edges() + _TEXTBOOK + _ROUTES, "SELECT src, dst, weight FROM routes"),
    "routes_from_table": _with(_edges() + _TEXTBOOK + _ROUTES, "SELECT src, dst, weight FROM routes"),
    "routes_sorted": _with(
        _edges() + _TEXTBOOK + _ROUTES, "SELECT src, dst, weight FROM routes ORDER BY weight, src, dst"
    ),
    "site_transitions": _with(_edges(stops=_FOUND_STOPS), _PROBABILITY),
    "popular_routes": _with(
        _edges(stops=_FOUND_STOPS) + _TEXTBOOK + _ROUTES,
        "SELECT src, dst, weight FROM routes ORDER BY weight, src, dst",
    ),
    "subgraph_routes": _with(
        _edges(stops=_FOUND_STOPS).replace("edges AS MATERIALIZED", "whole AS MATERIALIZED")
        + ",\nedges AS (SELECT * FROM whole WHERE src < 60 AND dst < 60)"
        + _TEXTBOOK
        + _ROUTES,
        "SELECT src, dst, weight FROM routes",
    ),
    "site_profile": _with(
        _edges("struct", _FOUND_STOPS) + _VERTICES + _RANK_LINES + _RANKED_20 + _LABELLED,
        """SELECT v.id, v.normal, round(r.pagerank, 6) AS pagerank, c.num_points, l.label
        FROM vertices v JOIN ranked r USING (id)
        JOIN (SELECT cluster AS id, CAST(count(*) AS INTEGER) AS num_points FROM stops GROUP BY cluster) c USING (id)
        JOIN (SELECT id, CAST(dense_rank() OVER (ORDER BY label) AS INTEGER) AS label FROM labelled) l USING (id)""",
    ),
    "edge_profile": _with(
        _edges(stops=_FOUND_STOPS),
        """SELECT src, dst, normal, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS out_share,
          normal / CAST(sum(normal) OVER (PARTITION BY src) AS DOUBLE) AS transfer_prob FROM edges""",
    ),
}
