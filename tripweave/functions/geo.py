"""Points on the unit sphere, where great-circle distance is a plain chord length.

Chords need no special case at the poles or the date line, and comparing squared
chords costs no trigonometry per pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8

AXES = ("x", "y", "z")


def unit_sphere(lat: Column, lon: Column) -> dict[str, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return {
        "x": F.cos(phi) * F.cos(lam),
        "y": F.cos(phi) * F.sin(lam),
        "z": F.sin(phi),
    }


def usable(lat: Column, lon: Column) -> Column:
    """Whether both coordinates are finite and the latitude is within 90 degrees; never null.

    A longitude may be any number: 370 degrees is 10.
    """
    known = (F.abs(lat) <= 90) & (F.abs(lon) < F.lit(float("inf")))
    return F.coalesce(known, F.lit(False))


def chord_of(distance_m: float) -> float:
    return 2.0 * math.sin(distance_m / (2.0 * EARTH_RADIUS_M))


def squared_distance(a: str, b: str) -> Column:
    """Between two points whose coordinates are named prefix + axis."""
    return F.expr(sum_of_squares([f"({a}{axis} - {b}{axis})" for axis in AXES]))


def squared_gap(a: str, b: str) -> Column:
    """Smallest possible squared distance between two boxes (prefix + axis + 0/1).

    The sums run in the order of :func:`squared_distance`, so rounding never puts the
    gap above the distance of a pair of points inside the boxes.
    """
    return F.expr(
        sum_of_squares(
            [
                f"greatest({a}{axis}0 - {b}{axis}1, {b}{axis}0 - {a}{axis}1, 0D)"
                for axis in AXES
            ]
        )
    )


def squared_reach(a: str, b: str) -> Column:
    """Largest possible squared distance between two boxes (prefix + axis + 0/1)."""
    return F.expr(
        sum_of_squares(
            [f"greatest({a}{axis}1 - {b}{axis}0, {b}{axis}1 - {a}{axis}0)" for axis in AXES]
        )
    )


def box_aggregates() -> list[Column]:
    return [
        F.expr(f"{bound}({axis}) AS {axis}{end}")
        for axis in AXES
        for end, bound in ((0, "min"), (1, "max"))
    ]


def grid_index(value: Column, side: float) -> Column:
    return F.floor(value / F.lit(side))


def sum_of_squares(terms: list[str]) -> str:
    return " + ".join(f"{term} * {term}" for term in terms)
