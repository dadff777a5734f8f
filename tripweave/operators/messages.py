"""Edges laid out for rounds of message passing.

The edges are hashed by sender once and kept; a round moves only the vertex values.  A
vertex with very many edges is split into salts, and its value is copied to each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.plans.lineage import cut_lineage
from tripweave.plans.skew import (
    HOT_ROWS,
    all_salts,
    group_sizes,
    hot_keys,
    salt_of,
)


class EdgeLayout:
    """Kept edges (``id``, ``to`` and payload columns) grouped by ``id``.

    Use as a context manager: leaving it releases the kept copy.
    """

    def __init__(self, edges: DataFrame, hot_rows: int = HOT_ROWS):
        edges = cut_lineage(edges)
        #: The edges as they came, and the number each sender has.
        self.edges, self.sizes = edges, group_sizes(edges, ["id"])
        sizes = self.sizes
        self._hot = None
        self._on = ["id"]
        told = sizes.agg(F.max("_rows").alias("most"), F.sum("_rows").alias("all")).first()
        #: Number of edges.
        self.total = told["all"] or 0
        if (told["most"] or 0) > hot_rows:
            self._on = ["id", "_salt"]
            self._hot = cut_lineage(hot_keys(sizes, ["id"], hot_rows=hot_rows))
            self._one = F.coalesce("_salts", F.lit(1))
            edges = (
                edges.join(F.broadcast(self._hot), "id", "left")
                .withColumn("_salt", salt_of(["to"], self._one))
                .drop("_salts")
            )
        # The session's own width: a join moves a side narrower than that, and the kept edges
        # must stay where they are.
        width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self._edges = edges.repartition(width, *self._on).persist()

    @property
    def crowded(self) -> bool:
        """Whether a vertex has more than ``hot_rows`` edges."""
        return self._hot is not None

    def __enter__(self) -> EdgeLayout:
        return self

    def __exit__(self, *_) -> None:
        self._edges.unpersist()

    def send(self, values: DataFrame) -> DataFrame:
        """Join each edge with the value row of its sender ``id``."""
        if self._hot is not None:
            values = (
                values.join(F.broadcast(self._hot), "id", "left")
                .withColumn("_salt", all_salts(self._one))
                .drop("_salts")
            )
        return self._edges.join(values, self._on)
