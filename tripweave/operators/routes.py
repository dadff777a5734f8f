"""Popular routes: real moves between the attractor and the members of a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route_graph(members: DataFrame, edges: DataFrame, weight: str = "normal") -> DataFrame:
    """Edges from an attractor to one of its members, with their own ``weight``.

    ``members`` has the pairs (``attractor``, ``member``) that the last matrix of Markov
    clustering gives.
    """
    pairs = members.select(F.col("attractor").alias("src"), F.col("member").alias("dst"))
    return pairs.join(edges.select("src", "dst", F.col(weight).alias("weight")), ["src", "dst"])


def listed_members(clusters: DataFrame, attractor: str = "attractor", members: str = "members") -> DataFrame:
    """The pairs of :func:`route_graph` from a table of clusters with an array of members each, as
    Markov clustering exports it: all pages of an attractor, in any order.

    Both names may lead into a struct (``nodes.src``, ``nodes.value``).  A cluster without members
    gives no pair, and a pair listed more than once counts once.
    """
    return clusters.select(F.col(attractor).alias("attractor"), F.explode(members).alias("member")).distinct()


def sort_routes(routes: DataFrame) -> DataFrame:
    return routes.orderBy("weight", "src", "dst")
