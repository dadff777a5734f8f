"""Communities by synchronous label propagation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tripweave.operators.graph import SiteGraph
from tripweave.operators.messages import EdgeLayout
from tripweave.plans.lineage import RollingCut, cut_bucketed, owns_copies
from tripweave.plans.skew import HOT_ROWS

_ROUNDS_PER_CUT = 5
#: Edges, both ways, up to which every vertex votes in every round.
FEW_EDGES = 1_000_000

OnRound = Callable[[int, int], None]


@owns_copies
def label_propagation(
    graph: SiteGraph,
    max_iter: int = 10,
    hot_rows: int = HOT_ROWS,
    on_round: OnRound | None = None,
    few_edges: int = FEW_EDGES,
) -> DataFrame:
    """Add ``label`` to the vertices after ``max_iter`` rounds.

    Labels start as the vertex id and travel along an edge both ways, so a pair of opposite
    edges counts twice.  A vertex takes the label most of its messages carry, the smallest
    on a tie; the round count is part of the result, as labels may swing back and forth.

    In the first round every vertex votes, and the votes are kept where they are counted.  From
    then on only vertices whose label has changed send, along each edge one vote less for the old
    label and one more for the new; so labels come out as if all had voted anew.  Rounds after one
    that changes nothing are left out.  ``on_round`` is told the number of each round and of the
    edges along which something was sent.

    Where a vertex has more than ``hot_rows`` votes they cannot lie in one place; then all
    vertices vote in every round, and hubs are split.  They all vote as well where an edge and its
    reverse number ``few_edges`` at most: several rounds then make one job, and starting jobs is
    what takes the time.
    """
    ids = graph.vertices.select("id")
    ends = graph.edges.select("src", "dst")
    lines = ends.toDF("id", "to").unionByName(ends.toDF("to", "id"))
    with EdgeLayout(lines, hot_rows) as layout:
        rounds = _full_rounds if layout.crowded or layout.total <= few_edges else _changes
        labels = rounds(layout, ids, max_iter, on_round)
    return graph.vertices.join(labels, "id")


def _full_rounds(layout: EdgeLayout, ids: DataFrame, max_iter: int, on_round: OnRound | None) -> DataFrame:
    cut = RollingCut()
    labels = ids.select("id", F.col("id").alias("label"))
    messages = layout.total
    for done in range(1, max_iter + 1):
        votes = layout.send(labels).groupBy(F.col("to").alias("id"), "label").agg(F.count(F.lit(1)).alias("votes"))
        # A vertex that hears nobody keeps its label.
        labels = labels.join(_most_voted(votes), "id", "left").select("id", F.coalesce("new", "label").alias("label"))
        if on_round:
            on_round(done, messages)
        if done % _ROUNDS_PER_CUT == 0 or done == max_iter:
            labels = cut(labels)
    return labels


def _changes(layout: EdgeLayout, ids: DataFrame, max_iter: int, on_round: OnRound | None) -> DataFrame:
    """Rounds that send changes.  Labels and votes lie by the vertex they belong to, so only the
    messages move; the votes of the start are written once, and what has changed since is a table
    of its own."""
    state = ids.join(layout.sizes, "id", "left").select(
        "id", F.col("id").alias("label"), F.lit(None).cast(ids.schema["id"].dataType).alias("old"),
        F.coalesce("_rows", F.lit(0)).alias("degree"),
    )
    cut, cut_difference, cut_changes = RollingCut("id"), RollingCut("id"), RollingCut("id")
    state = cut(state)
    if max_iter < 1:
        return cut.plain(state).select("id", "label")
    # Every vertex votes for itself, so the first votes are the edges.
    votes = layout.edges.groupBy(F.col("to").alias("id"), F.col("id").alias("label"))
    votes = cut_bucketed(votes.agg(F.count(F.lit(1)).alias("votes")), "id")
    changes = None
    state, sent = _relabelled(cut, state, _most_voted(votes))
    if on_round:
        on_round(1, layout.total)
    for done in range(2, max_iter + 1):
        if not sent:
            break
        messages = sent
        difference = cut_difference(_difference(layout, state))
        with _joins_where_rows_lie(ids.sparkSession):
            changes = difference if changes is None else cut_changes(_added(changes, difference))
            # Only a vertex that got a message may take another label.
            touched = difference.select("id").distinct()
            votes_now = _added(*(part.join(touched, "id", "left_semi") for part in (votes, changes)))
            state, sent = _relabelled(cut, state, _most_voted(votes_now.filter(F.col("votes") > 0)))
        if on_round:
            on_round(done, messages)
    return cut.plain(state).select("id", "label")


def _most_voted(votes: DataFrame) -> DataFrame:
    return votes.groupBy("id").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("new"))


def _relabelled(cut: RollingCut, state: DataFrame, new: DataFrame) -> tuple[DataFrame, int]:
    """The state with the labels of ``new``, and how many edges leave vertices that changed."""
    seen = Observation()
    following = state.join(new, "id", "left").select(
        "id", F.coalesce("new", "label").alias("label"), F.col("label").alias("old"), "degree"
    )
    changed = F.sum(F.when(F.col("label") != F.col("old"), F.col("degree")).otherwise(0)).alias("sent")
    following = cut(following.observe(seen, changed))
    return following, seen.get["sent"] or 0


def _difference(layout: EdgeLayout, state: DataFrame) -> DataFrame:
    """What the changed labels add to the votes: rows (id, label, votes)."""
    sent = layout.send(state.filter(F.col("label") != F.col("old")).select("id", "label", "old"))
    swing = [F.struct(F.col(name).alias("label"), F.lit(vote).cast("long").alias("votes")) for name, vote in (("old", -1), ("label", 1))]
    return (
        sent.select(F.col("to").alias("id"), F.explode(F.array(*swing)).alias("vote"))
        .groupBy("id", F.col("vote.label").alias("label"))
        .agg(F.sum("vote.votes").alias("votes"))
    )


def _added(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums of two tables of votes.  A join, as a union would not read them as they lie."""
    return a.join(b.withColumnRenamed("votes", "_more"), ["id", "label"], "full").select(
        "id", "label", (F.coalesce("votes", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("votes")
    )


@contextmanager
def _joins_where_rows_lie(spark: SparkSession) -> Iterator[None]:
    """Rows that lie by ``id`` need not be dealt anew for a join by ``id`` and ``label``.  Plans are
    made when they are written, which must be inside."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def community_sizes(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("label").agg(F.count(F.lit(1)).alias("num_vertices"))
