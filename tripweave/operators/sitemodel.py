"""Sites found in one frame of check-ins, to label those of another.

A model keeps the core positions of the sites in nested boxes: the cubes of density clustering,
cut ever finer down to boxes of at most ``LEAF`` positions, and at the bottom the positions
themselves, as boxes without extent.  A check-in belongs to the site of the nearest core position
within eps, of equally near ones of that with the smallest (latitude, longitude); with none in
reach it is noise.

The search goes down the boxes level by level.  A box that cannot hold anything nearer than what
another surely holds is dropped, and a position whose remaining boxes are all of one site, one of
them surely in reach, is settled.  So a position meets a bounded number of boxes a level, and the
positions of a crowded cube are never compared with those of another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripweave.functions.geo import (
    AXES,
    box_aggregates,
    chord_of,
    grid_index,
    squared_distance,
    squared_gap,
    squared_reach,
    unit_sphere,
    usable,
)
from tripweave.operators import density
from tripweave.plans.lineage import cut_lineage, cut_measured, owns_copies
from tripweave.plans.ranking import dense_ranks
from tripweave.plans.skew import HOT_ROWS, group_sizes, hot_keys, hot_keys_if_any, sized_join, spread_join
from tripweave.sources import stages

#: Positions of a box that is not cut any finer.
LEAF = 64
#: Parts per axis of a box that is.
_FINER = 4
#: After so many cuts boxes are smaller than the spacing of coordinates.
_MOST_LEVELS = 24

_BOX = [f"{axis}{end}" for axis in AXES for end in (0, 1)]
_REP = [f"r{axis}" for axis in AXES]


@dataclass(frozen=True)
class SiteModel:
    """``roots``: the cubes, by their grid place (cx, cy, cz); ``boxes``: what a box is cut into, by
    (level, parent).  Both carry the box's name, number of positions, site, extent and one of its
    positions."""

    roots: DataFrame
    boxes: DataFrame
    eps_m: float

    def save(self, root: str, name: str = "site_model", fmt: str = "parquet") -> SiteModel:
        """Write the model as stages under ``root`` and return it as read back."""
        sized = self.roots.withColumn("eps_m", F.lit(self.eps_m))
        spark = self.roots.sparkSession
        stages.publish_stage(spark.range(1).select(F.lit(self.eps_m).alias("eps_m")), root, f"{name}_params", fmt)
        stages.publish_stage(sized.drop("eps_m"), root, f"{name}_roots", fmt)
        stages.publish_stage(self.boxes, root, f"{name}_boxes", fmt)
        return load_model(spark, root, name)


def load_model(spark: SparkSession, root: str, name: str = "site_model") -> SiteModel:
    eps_m = stages.read_stage(spark, root, f"{name}_params").first()["eps_m"]
    return SiteModel(
        stages.read_stage(spark, root, f"{name}_roots"), stages.read_stage(spark, root, f"{name}_boxes"), eps_m
    )


def _side(eps_m: float) -> float:
    return density.cube_side(chord_of(eps_m))


@owns_copies
def _index(cores: DataFrame, eps_m: float, hot_rows: int) -> DataFrame:
    """One frame of all boxes; ``cores`` is (_lat, _lon, site)."""
    side = _side(eps_m)
    placed = dense_ranks(cores, ["_lat", "_lon"], "pid").select(
        "pid", "site", *[c.alias(k) for k, c in unit_sphere(F.col("_lat"), F.col("_lon")).items()]
    )
    # Positions that fall together on the sphere are at distance zero, so of one site.
    points = placed.groupBy(*AXES).agg(F.min("pid").alias("pid"), F.min_by("site", "pid").alias("site"))
    cube = [f"c{axis}" for axis in AXES]
    points = points.withColumns({"c" + axis: grid_index(F.col(axis), side) for axis in AXES})
    boxes, largest = cut_measured(_boxed(points, cube), "n")
    points = cut_lineage(_under(points, boxes, cube, largest, hot_rows))
    nothing = F.lit(None).cast("long")
    found = boxes.select(F.lit(-1).alias("level"), nothing.alias("parent"), *cube, *_carried())
    for level in range(_MOST_LEVELS + 1):
        last = level == _MOST_LEVELS
        # A box of one position is that position.
        whole = F.lit(False) if last else F.col("n") > LEAF
        found = found.unionByName(
            points.filter((F.col("n") > 1) & ~whole).select(
                F.lit(level).alias("level"),
                F.col("cell").alias("parent"),
                *[nothing.alias(c) for c in cube],
                F.col("pid").alias("cell"),
                F.lit(1).cast("long").alias("n"),
                "site",
                *[F.col(axis).alias(axis + end) for axis in AXES for end in "01"],
                *[F.col(axis).alias("r" + axis) for axis in AXES],
            )
        )
        if last or (largest or 0) <= LEAF:
            return found
        side = side / _FINER
        points = (
            points.filter(F.col("n") > LEAF)
            .drop("n")
            .withColumnRenamed("cell", "parent")
            .withColumns({"c" + axis: grid_index(F.col(axis), side) for axis in AXES})
        )
        boxes, largest = cut_measured(_boxed(points, ["parent", *cube]), "n")
        points = cut_lineage(_under(points, boxes, ["parent", *cube], largest, hot_rows))
        found = found.unionByName(
            boxes.select(F.lit(level).alias("level"), "parent", *[nothing.alias(c) for c in cube], *_carried())
        )


def _carried() -> list[str]:
    return ["cell", "n", "site", *_BOX, *_REP]


def _boxed(points: DataFrame, keys: list[str]) -> DataFrame:
    """A box is named by its first position, which a box and its first part share: the level
    tells them apart."""
    return points.groupBy(*keys).agg(
        F.min("pid").alias("cell"),
        F.count(F.lit(1)).alias("n"),
        # Positions of a cube are neighbours, so all of one site.
        F.min("site").alias("site"),
        *box_aggregates(),
        *[F.min_by(axis, "pid").alias("r" + axis) for axis in AXES],
    )


def _under(points: DataFrame, boxes: DataFrame, keys: list[str], largest: int, hot_rows: int) -> DataFrame:
    hot = hot_keys(boxes, keys, "n", hot_rows) if largest > hot_rows else None
    return spread_join(points, boxes.select(*keys, "cell", "n"), keys, ["pid"], hot).drop(*keys)


@owns_copies
def _fitted(checkins, lat, lon, eps_m, min_pts, hot_rows, kind) -> DataFrame:
    found = density.position_sites(checkins, lat, lon, eps_m, min_pts, hot_rows, kind=kind)
    return cut_lineage(found.filter("core").select("_lat", "_lon", "site"))


def fit_sites(
    checkins: DataFrame,
    lat: str = "latitude",
    lon: str = "longitude",
    eps_m: float = 400.0,
    min_pts: int = 2,
    hot_rows: int = HOT_ROWS,
    kind: str = "int",
) -> SiteModel:
    """The sites that :func:`density.dbscan` finds in ``checkins``, as a model; their numbers are
    the same.  Rows without a usable position take no part."""
    index = cut_lineage(_index(_fitted(checkins, lat, lon, eps_m, min_pts, hot_rows, kind), eps_m, hot_rows))
    roots = index.filter(F.col("level") < 0).drop("level", "parent")
    return SiteModel(roots, index.filter(F.col("level") >= 0).drop("cx", "cy", "cz"), eps_m)


@owns_copies
def label_sites(
    model: SiteModel,
    checkins: DataFrame,
    lat: str = "latitude",
    lon: str = "longitude",
    out: str = "cluster",
    spread_by: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the site of the nearest core position within the model's eps, ties to the
    smallest (latitude, longitude); null for noise and for rows without a usable position.

    A core position of the fitted frame is its own nearest, and keeps its site.  A border position
    between sites may differ: clustering gives it the site of the smallest number in reach.
    """
    on = ["_site_lat", "_site_lon"]
    known = usable(F.col(lat), F.col(lon))
    keyed = checkins.withColumns({on[0]: F.when(known, F.col(lat)), on[1]: F.when(known, F.col(lon))})
    positions, largest = cut_measured(
        group_sizes(keyed.filter(known).select(*on), on, "_m"), "_m"
    )
    placed = dense_ranks(positions.select(*on), on, "pid")
    located = cut_lineage(
        placed.select(
            "pid", *on, *[c.alias(k) for k, c in unit_sphere(F.col(on[0]), F.col(on[1])).items()]
        )
    )
    nearest = _nearest(model, located.select("pid", *AXES), hot_rows)
    found = located.select("pid", *on).join(nearest, "pid").select(*on, F.col("site").alias(out))
    spread_by = spread_by or [name for name in checkins.columns if name not in (lat, lon)] or [lat]
    hot = hot_keys(positions, on, "_m", hot_rows) if largest > hot_rows else None
    return spread_join(keyed, found, on, spread_by, hot, "left").select(*checkins.columns, out)


def _nearest(model: SiteModel, points: DataFrame, hot_rows: int) -> DataFrame:
    """(pid, site) of the positions with a core position in reach."""
    chord = chord_of(model.eps_m)
    limit = F.lit(chord * chord)
    cube = [f"c{axis}" for axis in AXES]
    work = _in_reach(model, points, limit, cube, hot_rows)
    mine = Window.partitionBy("pid")
    settled = None
    level = 0
    while True:
        # The nearest core position lies no farther than ``_sure``, in one of the boxes kept.
        judged = (
            work.withColumn("_sure", F.min("high").over(mine))
            .filter(F.col("low") <= F.col("_sure"))
            .withColumns(
                {
                    "_first": F.min("site").over(mine),
                    "_last": F.max("site").over(mine),
                    "_open": F.max(F.when(F.col("n") > 1, 1).otherwise(0)).over(mine),
                }
            )
        )
        same = (F.col("_first") == F.col("_last")) & (F.col("_sure") <= limit)
        # All boxes left are positions: the nearest wins, then the first.
        decided = same | (F.col("_open") == 0)
        judged = cut_lineage(judged.withColumn("_decided", decided))
        answers = (
            judged.filter("_decided")
            .groupBy("pid")
            .agg(F.min_by("site", F.struct("low", "cell")).alias("site"))
        )
        settled = answers if settled is None else settled.unionByName(answers)
        rest = judged.filter(~F.col("_decided")).select("pid", *AXES, "level", *_carried(), "low", "high")
        if rest.isEmpty():
            return settled
        opened = cut_lineage(rest.filter(F.col("n") > 1))
        parts = model.boxes.filter(F.col("level") == level).select(
            F.col("level").alias("_level"), "parent", *_carried()
        )
        asked = cut_lineage(group_sizes(opened.select(F.col("cell").alias("parent")), ["parent"]))
        below = spread_join(
            opened.select("pid", *AXES, F.col("cell").alias("parent")),
            parts,
            ["parent"],
            ["pid"],
            hot_keys_if_any(asked, ["parent"], "_rows", hot_rows),
        ).drop("parent")
        work = _bounds(below.withColumnRenamed("_level", "level"), limit).unionByName(rest.filter(F.col("n") == 1))
        level += 1


def _bounds(pairs: DataFrame, limit: Column) -> DataFrame:
    """Add the least and the largest possible squared distance of the box's nearest position;
    boxes out of reach go."""
    as_box = pairs.withColumns(
        {f"p_{axis}{end}": F.col(axis) for axis in AXES for end in (0, 1)}
        | {f"p_{axis}": F.col(axis) for axis in AXES}
        | {f"b_{c}": F.col(c) for c in (*_BOX, *_REP)}
    )
    one = F.least(squared_reach("p_", "b_"), squared_distance("p_", "b_r"))
    return as_box.withColumns({"low": squared_gap("p_", "b_"), "high": one}).filter(F.col("low") <= limit).select(
        "pid", *AXES, "level", *_carried(), "low", "high"
    )


def _in_reach(model: SiteModel, points: DataFrame, limit: Column, cube: list[str], hot_rows: int) -> DataFrame:
    """Each position with the cubes of the model in reach.

    Cubes of the positions find those of the model first, as both number far fewer; then the
    positions of a cube, split where there are many, meet the cubes found.
    """
    side = _side(model.eps_m)
    placed = points.withColumns({"c" + axis: grid_index(F.col(axis), side) for axis in AXES})
    own, largest = cut_measured(
        placed.groupBy(*cube).agg(F.count(F.lit(1)).alias("_n"), *box_aggregates()), "_n"
    )
    near = density.cubes_within(
        own.select(*cube, *[F.col(c).alias("a_" + c) for c in _BOX]),
        model.roots.select(*cube, *[F.col(c).alias("b_" + c) for c in ("cell", "n", "site", *_BOX, *_REP)]),
        side,
    ).filter(squared_gap("a_", "b_") <= limit)
    near = near.join(own.select(*cube, "_n"), cube)
    carried = near.select(*cube, "_n", *[F.col("b_" + c).alias(c) for c in _carried()])
    if largest > hot_rows:
        sized = spread_join(placed, own.select(*cube, "_n"), cube, ["pid"], hot_keys(own, cube, "_n", hot_rows))
        pairs = sized_join(sized, carried, cube, ["pid"], "_n", hot_rows).drop("_n")
    else:
        pairs = placed.join(carried.drop("_n"), cube)
    return _bounds(pairs.drop(*cube).withColumn("level", F.lit(-1)), limit)
