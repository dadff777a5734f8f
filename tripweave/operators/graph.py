"""The weighted directed site graph: a pair of DataFrames, and plain reports on it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.operators.trips import TRIP_GAP_S, trip_moves
from tripweave.plans.lineage import cut_lineage
from tripweave.plans.skew import HOT_ROWS, group_sizes, hot_keys, hot_keys_if_any, spread_join


@dataclass(frozen=True)
class SiteGraph:
    """``vertices`` keyed by ``id``, ``edges`` by (``src``, ``dst``)."""

    vertices: DataFrame
    edges: DataFrame

    def dangling_ends(self) -> DataFrame:
        """Edge ends that are no vertex; empty for a sound graph."""
        ends = self.edges.select(F.col("src").alias("id")).unionByName(
            self.edges.select(F.col("dst").alias("id"))
        )
        return ends.distinct().join(self.vertices.select("id"), "id", "left_anti")


def transition_edges(
    checkins: DataFrame,
    order: str = "time",
    gap_s: int = TRIP_GAP_S,
    tie: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Site-to-site moves counted as ``normal``; see :func:`trip_moves` for ``order``."""
    moves = trip_moves(checkins, order, gap_s, tie, hot_rows)
    return moves.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("normal"))


def in_strength(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.sum("normal").alias("incoming_weight"))


def out_strength(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum("normal").alias("outgoing_weight"))


def vertex_table(edges: DataFrame) -> DataFrame:
    """Every site on an edge with ``normal``, its incoming plus outgoing moves.

    Both ends of an edge go through one aggregation; joining two strength tables would
    shuffle twice as often for the same sums.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "normal")
    return ends.groupBy("id").agg(F.sum("normal").alias("normal"))


def site_graph(edges: DataFrame) -> SiteGraph:
    return SiteGraph(vertex_table(edges), edges)


def out_share(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``out_share``: one over the number of edges leaving ``src``."""
    return _with_source_totals(edges, hot_rows).select(
        *edges.columns, (F.lit(1.0) / F.col("_degree")).alias("out_share")
    )


def transition_probabilities(
    edges: DataFrame, hot_rows: int = HOT_ROWS, weight: str = "normal"
) -> DataFrame:
    """Add ``transfer_prob``: the edge's part of all ``weight`` leaving ``src``."""
    return _with_source_totals(edges, hot_rows, weight).select(
        *edges.columns, (F.col(weight) / F.col("_total")).alias("transfer_prob")
    )


def enrich_vertices(vertices: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``num_points`` of each vertex from a (``cluster``, ``num_points``) table."""
    return vertices.sparkSession.sql(
        "SELECT v.*, c.num_points FROM {v} v JOIN {c} c ON v.id = c.cluster",
        v=vertices,
        c=counts.select("cluster", "num_points"),
    )


def induced_subgraph(graph: SiteGraph, keep: Callable[[Column], Column]) -> SiteGraph:
    """The vertices whose id passes ``keep``, and the edges between them.

    The condition is on the id alone, so it is put on both edge ends directly and reaches
    the scan; no join is needed.
    """
    return SiteGraph(
        graph.vertices.filter(keep(F.col("id"))),
        graph.edges.filter(keep(F.col("src")) & keep(F.col("dst"))),
    )


def vertex_subgraph(graph: SiteGraph, where: Column | str, hot_rows: int = HOT_ROWS) -> SiteGraph:
    """The vertices for which ``where`` holds, a condition on any of their columns, and the edges
    between them.

    The edges meet the kept ids twice, by sender and by receiver.  The ids are written first, so
    Spark knows their size and broadcasts them if, and only if, its threshold allows; else the
    edges of a hub, at either end, are split.  For a condition on the id alone
    :func:`induced_subgraph` needs no join.
    """
    kept = cut_lineage(graph.vertices.filter(where))
    edges = graph.edges
    for end, other in (("src", "dst"), ("dst", "src")):
        ids = kept.select(F.col("id").alias(end))
        sizes = cut_lineage(group_sizes(edges, [end]))
        hot = hot_keys_if_any(sizes, [end], hot_rows=hot_rows)
        edges = spread_join(edges, ids, [end], [other], hot, "left_semi")
    return SiteGraph(kept, edges.select(*graph.edges.columns))


def top_k(df: DataFrame, by: str, k: int, then: str = "id") -> DataFrame:
    """The ``k`` rows with the largest ``by``, ties by ``then``."""
    return df.orderBy(F.col(by).desc(), then).limit(k)


def _with_source_totals(edges: DataFrame, hot_rows: int, weight: str = "normal") -> DataFrame:
    # A window over src would put all edges of a hub in one task.
    totals = edges.groupBy("src").agg(
        F.sum(weight).alias("_total"), F.count(F.lit(1)).alias("_degree")
    )
    return spread_join(
        edges, totals, ["src"], ["dst"], hot_keys(totals, ["src"], "_degree", hot_rows)
    )
