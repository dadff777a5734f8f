"""Sites: what to do with the clusters found in a check-in table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.geo import AXES, unit_sphere, usable
from tripweave.plans.skew import HOT_ROWS, hot_keys, spread_join


def drop_noise(checkins: DataFrame, cluster: str = "cluster") -> DataFrame:
    return checkins.filter(F.col(cluster).isNotNull())


def site_centroids(checkins: DataFrame, cluster: str = "cluster", on: str = "plane") -> DataFrame:
    """Mean coordinates per cluster, with ``num_points``, the rows behind them; one aggregation.

    ``on="plane"`` takes the plain means, of longitudes brought to one turn around the site: 370
    degrees counts as 10, and 179.9 and -179.9 meet at the date line.  ``on="sphere"`` takes the
    mean of the positions as unit vectors, which is right at the poles as well; positions that
    cancel out (opposite ones) have no centroid, and its coordinates are null.  Longitudes come
    out within -180 and 180.  Rows with an unusable position count in ``num_points`` alone.
    """
    means = {"plane": _plane_mean, "sphere": _sphere_mean}[on]()
    known = checkins.select(
        cluster,
        *[F.when(usable(F.col("latitude"), F.col("longitude")), F.col(c)).alias(c) for c in ("latitude", "longitude")],
    )
    sums = known.groupBy(cluster).agg(F.count(F.lit(1)).alias("num_points"), *means[0])
    return sums.select(cluster, *[c.alias(name) for name, c in means[1].items()], "num_points")


def _plane_mean() -> tuple[list[Column], dict[str, Column]]:
    """What to aggregate, and the coordinates from it.

    Longitudes are taken from -180 to 180 and again from 0 to 360: a site that the one cuts in two
    lies in one piece in the other, where it spans less.
    """
    lon = F.col("longitude")
    # Longitudes of the first turn stay as they are, to the last bit.
    west = F.when((lon >= -180) & (lon < 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)
    east = F.when(west < 0, west + 360).otherwise(west)
    seen = [F.avg("latitude").alias("_lat")]
    for name, turn in (("_west", west), ("_east", east)):
        seen += [F.avg(turn).alias(name), (F.max(turn) - F.min(turn)).alias(name + "_span")]
    crossing = F.when(F.col("_east") >= 180, F.col("_east") - 360).otherwise(F.col("_east"))
    return seen, {
        "latitude": F.col("_lat"),
        "longitude": F.when(F.col("_east_span") < F.col("_west_span"), crossing).otherwise(F.col("_west")),
    }


def _sphere_mean() -> tuple[list[Column], dict[str, Column]]:
    at = unit_sphere(F.col("latitude"), F.col("longitude"))
    x, y, z = (F.col("_" + axis) for axis in AXES)
    flat = F.sqrt(x * x + y * y)
    # Below this the sum of unit vectors is rounding.
    there = flat + F.abs(z) > 1e-12
    return [F.avg(at[axis]).alias("_" + axis) for axis in AXES], {
        "latitude": F.when(there, F.degrees(F.atan2(z, flat))),
        "longitude": F.when(there, F.degrees(F.atan2(y, x))),
    }


def snap_to_sites(
    checkins: DataFrame,
    centroids: DataFrame,
    cluster: str = "cluster",
    spread_by: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Replace the coordinates of each check-in by those of its site."""
    plain = checkins.drop("latitude", "longitude")
    spread_by = spread_by or [name for name in plain.columns if name != cluster]
    return spread_join(
        plain,
        centroids.select(cluster, "latitude", "longitude"),
        [cluster],
        spread_by,
        hot_keys(centroids, [cluster], "num_points", hot_rows),
    ).select(*checkins.columns)


def points_per_site(checkins: DataFrame, cluster: str = "cluster", kind: str = "int") -> DataFrame:
    """Rows per site; ``kind="long"`` where a site may have over two billion."""
    return checkins.groupBy(cluster).agg(F.count(F.lit(1)).cast(kind).alias("num_points"))
