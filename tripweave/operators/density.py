"""DBSCAN over coordinates, exact, with work that stays bounded in crowded places.

Distinct positions are put on the unit sphere and cut into cubes whose diagonal is
eps, so positions sharing a cube are always neighbours.  A cube holding ``min_pts``
points is *dense*: all of it is core and in one cluster, and no pair inside it is ever
formed.  The other cubes hold fewer than ``min_pts`` positions each, so their
neighbour counts cost at most a constant number of comparisons per position.  Whether
two dense cubes touch is decided on nested boxes (see ``_touching``), not on all pairs.

Definition after Ester et al., "A Density-Based Algorithm for Discovering Clusters"
(KDD 1996): a point is its own neighbour, and repeats of a position count.  A border
position with several clusters in reach goes to the one with the smallest core position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.functions.geo import (
    AXES,
    box_aggregates,
    chord_of,
    grid_index,
    squared_distance,
    squared_gap,
    squared_reach,
    sum_of_squares,
    unit_sphere,
    usable,
)
from tripweave.operators.components import connected_components
from tripweave.plans.lineage import cut_lineage, cut_measured, owns_copies
from tripweave.plans.ranking import dense_ranks
from tripweave.plans.skew import (
    HOT_ROWS,
    hot_keys,
    sized_join,
    spread_join,
)

# Pairs of boxes with at most this many position pairs are compared position by position.
PAIR_BUDGET = 4096
# A box that needs a closer look is cut into this many parts per axis.
_FINER = 4

# Cubes per axis in a block of the neighbour search.
_BLOCK = 4

_BOX = [f"{axis}{end}" for axis in AXES for end in (0, 1)]
_REP = [f"r{axis}" for axis in AXES]


@owns_copies
def dbscan(
    checkins: DataFrame,
    lat: str = "latitude",
    lon: str = "longitude",
    eps_m: float = 400.0,
    min_pts: int = 2,
    out: str = "cluster",
    spread_by: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
    pair_budget: int = PAIR_BUDGET,
    kind: str = "int",
) -> DataFrame:
    """Add ``out``: the site number (from 1) of each row, null for noise.

    ``kind="long"`` where there may be over two billion sites.
    A row without a usable position (see :func:`usable`) is noise and no one's neighbour.
    """
    on = ["_site_lat", "_site_lon"]
    sites, largest = cut_measured(
        position_sites(checkins, lat, lon, eps_m, min_pts, hot_rows, pair_budget, kind).drop("core").toDF(*on, "_m", out),
        "_m",
    )
    known = usable(F.col(lat), F.col(lon))
    spread_by = spread_by or [name for name in checkins.columns if name not in (lat, lon)]
    return spread_join(
        checkins.withColumns({on[0]: F.when(known, F.col(lat)), on[1]: F.when(known, F.col(lon))}),
        sites.drop("_m"),
        on,
        spread_by or [lat],
        hot_keys(sites, on, "_m", hot_rows) if largest > hot_rows else None,
        "left",
    ).select(*checkins.columns, out)


def position_sites(
    checkins: DataFrame,
    lat: str,
    lon: str,
    eps_m: float,
    min_pts: int,
    hot_rows: int = HOT_ROWS,
    pair_budget: int = PAIR_BUDGET,
    kind: str = "int",
) -> DataFrame:
    """The positions of sites: ``_lat, _lon``, multiplicity ``m``, ``site`` number and whether it is
    ``core``.

    Noise is left out.  A position repeated ``min_pts`` times is core, so what is left out
    is never a hot key of a later join.
    """
    chord = chord_of(eps_m)
    limit = F.lit(chord * chord)
    side = cube_side(chord)

    positions = dense_ranks(
        checkins.filter(usable(F.col(lat), F.col(lon)))
        .groupBy(F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
        .agg(F.count(F.lit(1)).alias("m")),
        ["_lat", "_lon"],
        "pid",
    )
    points, cells = _into_cells(positions, side, hot_rows)
    dense = F.col("weight") >= min_pts

    near = cut_lineage(_adjacent(cells, side).filter(squared_gap("a_", "b_") <= limit))
    links = _touching(
        near.filter((F.col("a_weight") >= min_pts) & (F.col("b_weight") >= min_pts)),
        points,
        cells,
        side,
        limit,
        hot_rows,
        pair_budget,
    )

    reach = _sparse_reach(near, points.filter(~dense), points, min_pts, limit, hot_rows)
    sparse = _sparse_cores(points.filter(~dense), reach, min_pts)
    cores = sparse.filter("core").select("pid", "node")
    # Core neighbours of each sparse position, named by the node they belong to.
    bonds = cut_lineage(
        reach.filter(F.col("partner").isNull())
        .select("pid", F.col("beside").alias("other"))
        .unionByName(
            reach.filter(F.col("partner").isNotNull())
            .select("pid", "partner")
            .join(cores.toDF("partner", "other"), "partner")
            .select("pid", "other")
        )
    )

    nodes = cells.filter(dense).select(F.col("cell").alias("node")).unionByName(
        cores.select("node").distinct()
    )
    joined = connected_components(
        nodes,
        links.unionByName(
            bonds.join(cores, "pid").select(F.col("node").alias("a"), F.col("other").alias("b"))
        ),
        hot_rows,
    )
    numbers = dense_ranks(joined.select("component").distinct(), ["component"], "site")
    named = cut_lineage(
        joined.join(numbers, "component").select("node", F.col("site").cast(kind).alias("site"))
    )

    in_dense = sized_join(
        points.filter(dense).select("_lat", "_lon", "m", "pid", "cell", "n"),
        cells.select("cell", "n").join(named.withColumnRenamed("node", "cell"), "cell"),
        ["cell"],
        ["pid"],
        "n",
        hot_rows,
    )
    # Its own node for a core position; for a border position every node in reach.
    candidates = (
        sparse.filter(F.col("node").isNotNull())
        .select("pid", "node")
        .unionByName(
            bonds.join(sparse.filter(~F.col("core")).select("pid"), "pid").select(
                "pid", F.col("other").alias("node")
            )
        )
    )
    in_sparse = (
        points.filter(~dense)
        .join(candidates.join(named, "node").groupBy("pid").agg(F.min("site").alias("site")), "pid")
        .join(sparse.select("pid", "core"), "pid")
    )
    columns = ["_lat", "_lon", "m", "site", "core"]
    return in_dense.withColumn("core", F.lit(True)).select(*columns).unionByName(in_sparse.select(*columns))


def cube_side(chord: float) -> float:
    """Side of cubes whose positions are all within ``chord`` of each other: a hair under
    chord/sqrt(3), so that rounding cannot part two positions of one cube."""
    return chord / math.sqrt(3.0) * (1.0 - 1e-9)


def _into_cells(
    positions: DataFrame, side: float, hot_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Positions with their cube, and one row per cube; a cube is named by its first pid."""
    cube = ["cx", "cy", "cz"]
    located = positions.select(
        "pid", "m", "_lat", "_lon", *[c.alias(k) for k, c in unit_sphere(F.col("_lat"), F.col("_lon")).items()]
    ).withColumns({"c" + axis: grid_index(F.col(axis), side) for axis in AXES})
    cells, largest = cut_measured(_boxes(located, cube, "cell"), "n")
    points = cut_lineage(
        spread_join(
            located,
            cells.select(*cube, "cell", "n", "weight"),
            cube,
            ["pid"],
            hot_keys(cells, cube, "n", hot_rows) if largest > hot_rows else None,
        ).drop(*cube)
    )
    return points, cells


def _boxes(points: DataFrame, keys: list[str], name: str) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.min("pid").alias(name),
        F.count(F.lit(1)).alias("n"),
        F.sum("m").alias("weight"),
        *box_aggregates(),
        *[F.min_by(axis, "pid").alias("r" + axis) for axis in AXES],
    )


def _adjacent(cells: DataFrame, side: float) -> DataFrame:
    """Each pair of occupied cubes close enough to hold neighbours, once."""
    cube = ["cx", "cy", "cz"]
    # Only names travel through this join; boxes are fetched for the pairs it finds.
    pairs = (
        cubes_within(cells.select(F.col("cell").alias("a_cell"), *cube), cells.select(F.col("cell").alias("b_cell"), *cube), side)
        .filter("a_cell < b_cell")
        .select("a_cell", "b_cell")
    )
    for end in ("a_", "b_"):
        pairs = pairs.join(cells.select(*[F.col(c).alias(end + c) for c in _carried()]), end + "cell")
    return pairs


def cubes_within(left: DataFrame, right: DataFrame, side: float) -> DataFrame:
    """Each pair of cubes (cx, cy, cz) that may hold neighbours, with the place of the left one
    and the other columns of both.

    Such cubes are at most two steps apart on every axis.  Cubes are gathered in blocks of
    ``_BLOCK`` per axis: one side joins by its own block, the other by every block within two
    steps.  A block holds at most ``_BLOCK`` cubed cubes, so no group of the join can grow.
    """
    around = right.withColumnsRenamed({f"c{axis}": f"_c{axis}" for axis in AXES})
    for axis in AXES:
        low, high = (f"floor((_c{axis} {way} 2) / {_BLOCK})" for way in "-+")
        around = around.withColumn("_b" + axis, F.expr(f"explode(array_distinct(array({low}, {high})))"))
    block = [f"_b{axis}" for axis in AXES]
    here = left.withColumns({f"_b{axis}": F.expr(f"floor(c{axis} / {_BLOCK})") for axis in AXES})
    steps = " AND ".join(f"abs(c{axis} - _c{axis}) <= 2" for axis in AXES)
    return (
        here.hint("shuffle_hash")
        .join(around.filter(_meets_sphere("_b", side * _BLOCK)), block)
        .filter(steps)
        .drop(*block, *[f"_c{axis}" for axis in AXES])
    )


def _carried() -> list[str]:
    return ["cell", "n", "weight", *_BOX, *_REP]


def _meets_sphere(prefix: str, side: float) -> Column:
    """Drops cubes (prefix + axis) the unit sphere does not cross: they hold no position."""
    inner, outer = [], []
    for axis in AXES:
        low, high = f"({prefix}{axis} * {side!r}D)", f"(({prefix}{axis} + 1) * {side!r}D)"
        inner.append(f"greatest({low}, -{high}, 0D)")
        outer.append(f"greatest(abs({low}), abs({high}))")
    nearest, farthest = sum_of_squares(inner), sum_of_squares(outer)
    # The margin is far above rounding and far below the side of a cube.
    return F.expr(f"{nearest} <= 1 + 1e-9D AND {farthest} >= 1 - 1e-9D")


def _touching(
    pairs: DataFrame,
    points: DataFrame,
    boxes: DataFrame,
    side: float,
    limit: Column,
    hot_rows: int,
    pair_budget: int,
) -> DataFrame:
    """Pairs of dense cubes with some position of one within eps of one of the other.

    A pair of boxes is settled when the boxes are surely near (or their representatives
    are) or surely apart.  Small undecided pairs are compared position by position; large
    ones are cut into smaller boxes and looked at again, so only boxes lying at about
    eps from each other are ever refined.
    """
    roots = ["root_a", "root_b"]
    rep = squared_distance("a_r", "b_r") <= limit
    box_cols = [side_ + c for side_ in ("a_", "b_") for c in ("cell", "n", *_BOX, *_REP)]
    work = pairs.select(
        F.col("a_cell").alias("root_a"), F.col("b_cell").alias("root_b"), *box_cols
    )
    points = points.select("pid", "m", *AXES, "cell", "n")
    found = None
    while True:
        # Boxes that surely or visibly touch settle their root pair.
        judged = work.withColumn("_sure", (squared_reach("a_", "b_") <= limit) | rep)
        sure = judged.filter("_sure").select(*roots)
        undecided = judged.filter(~F.col("_sure")).drop("_sure")
        if found is not None:
            # From the second look on a root pair has many boxes.
            sure = sure.distinct()
            undecided = undecided.join(sure, roots, "left_anti")
        product = F.col("a_n") * F.col("b_n")
        little = points.filter(F.col("n") <= pair_budget)
        compared = (
            undecided.filter(product <= pair_budget)
            .select(*roots, "a_cell", "b_cell")
            .join(_prefixed(little, "a_"), "a_cell")
            .join(_prefixed(little, "b_"), "b_cell")
            .filter(squared_distance("a_", "b_") <= limit)
            .select(*roots)
        )
        settled = sure.unionByName(compared)
        large = judged.filter(~F.col("_sure") & (product > pair_budget))
        done = large.isEmpty()
        if not done:
            settled = cut_lineage(settled.distinct())
            large = cut_lineage(
                large.select(*roots, "a_cell", "b_cell").join(settled, roots, "left_anti")
            )
        found = settled if found is None else found.unionByName(settled)
        if done:
            return found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        side = side / _FINER
        points, boxes = _refined(points, boxes, large, side, hot_rows)
        carried = ["cell", "n", *_BOX, *_REP]
        half = [
            boxes.select(F.col("parent").alias(p + "cell"), *[F.col(c).alias(p + "_" + c) for c in carried])
            for p in ("a_", "b_")
        ]
        work = cut_lineage(
            large.join(half[0], "a_cell")
            .join(half[1], "b_cell")
            .select(*roots, *[F.col(p + "_" + c).alias(p + c) for p in ("a_", "b_") for c in carried])
            .filter(squared_gap("a_", "b_") <= limit)
        )


def _refined(
    points: DataFrame, boxes: DataFrame, large: DataFrame, side: float, hot_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Cut the boxes named in ``large``: their positions under finer boxes, and those boxes."""
    named = large.select(F.col("a_cell").alias("cell")).unionByName(
        large.select(F.col("b_cell").alias("cell"))
    ).distinct()
    sizes = boxes.select("cell", "n").join(named, "cell")
    kept = sized_join(points, sizes, ["cell"], ["pid"], "n", hot_rows)
    fine = ["parent", "fx", "fy", "fz"]
    located = kept.drop("n").withColumnRenamed("cell", "parent").withColumns(
        {"f" + axis: grid_index(F.col(axis), side) for axis in AXES}
    )
    parts, largest = cut_measured(_boxes(located, fine, "cell"), "n")
    return (
        cut_lineage(
            spread_join(
                located,
                parts.select(*fine, "cell", "n"),
                fine,
                ["pid"],
                hot_keys(parts, fine, "n", hot_rows) if largest > hot_rows else None,
            ).drop(*fine)
        ),
        parts,
    )


def _prefixed(points: DataFrame, prefix: str) -> DataFrame:
    return points.select(*[F.col(c).alias(prefix + c) for c in ("cell", "pid", *AXES)])


def _sparse_reach(
    near: DataFrame,
    sparse: DataFrame,
    points: DataFrame,
    min_pts: int,
    limit: Column,
    hot_rows: int,
) -> DataFrame:
    """What each position of a sparse cube has within eps in other cubes.

    One row per dense cube in reach (``partner`` null, all its positions in reach summed)
    and one per single position in reach in another sparse cube.
    """
    sides = [("a_", "b_"), ("b_", "a_")]
    beside = None
    for own, other in sides:
        half = near.filter(F.col(own + "weight") < min_pts).select(
            F.col(own + "cell").alias("cell"),
            F.col(other + "cell").alias("beside"),
            F.col(other + "n").alias("beside_n"),
            F.col(other + "weight").alias("beside_weight"),
            *[F.col(other + c).alias("c_" + c) for c in _BOX],
        )
        beside = half if beside is None else beside.unionByName(half)
    # A position is a box of no extent.
    probes = (
        sparse.select("pid", "cell", *[F.col(axis).alias("p_" + axis) for axis in AXES])
        .withColumns({f"p_{axis}{end}": F.col("p_" + axis) for axis in AXES for end in (0, 1)})
        .join(beside, "cell")
        .filter(squared_gap("p_", "c_") <= limit)
    )
    dense_beside = F.col("beside_weight") >= min_pts
    inside = dense_beside & (squared_reach("p_", "c_") <= limit)
    whole = probes.filter(inside).select(
        "pid", "beside", F.lit(None).cast("long").alias("partner"), F.col("beside_weight").alias("w")
    )
    compared = (
        sized_join(
            points.select(
                F.col("pid").alias("q_pid"),
                "m",
                *[F.col(axis).alias("q_" + axis) for axis in AXES],
                F.col("cell").alias("beside"),
                F.col("n").alias("beside_n"),
            ),
            probes.filter(~inside).select(
                "pid", "beside", "beside_n", "beside_weight", *["p_" + axis for axis in AXES]
            ),
            ["beside"],
            ["q_pid"],
            "beside_n",
            hot_rows,
        )
        .filter(squared_distance("p_", "q_") <= limit)
        .withColumn("partner", F.when(~dense_beside, F.col("q_pid")))
        .groupBy("pid", "beside", "partner")
        .agg(F.sum("m").alias("w"))
    )
    return cut_lineage(whole.unionByName(compared))


def _sparse_cores(sparse: DataFrame, reach: DataFrame, min_pts: int) -> DataFrame:
    """Positions of sparse cubes: ``core`` or not, and ``node``, the first core of the cube.

    A cube counts fewer than ``min_pts`` positions here, so grouping by cube is bounded.
    """
    core = F.col("weight") + F.coalesce("w", F.lit(0)) >= min_pts
    first = F.min(F.when(F.col("core"), F.col("pid"))).over(Window.partitionBy("cell"))
    return cut_lineage(
        sparse.join(reach.groupBy("pid").agg(F.sum("w").alias("w")), "pid", "left")
        .select("pid", "cell", core.alias("core"))
        .select("pid", "core", first.alias("node"))
    )
