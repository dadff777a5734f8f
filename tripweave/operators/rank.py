"""PageRank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tripweave.operators.graph import SiteGraph
from tripweave.operators.messages import EdgeLayout
from tripweave.plans.lineage import RollingCut
from tripweave.plans.skew import HOT_ROWS

# Rounds put into one job when no convergence test is asked for.
_ROUNDS_PER_CUT = 5
# Shares of the budget, each ten times the one before, tried for the least rank worth sending.
_STEPS = 16


def pagerank(
    graph: SiteGraph,
    reset: float = 0.15,
    tol: float | None = 1e-5,
    max_iter: int | None = None,
    hot_rows: int = HOT_ROWS,
    slack: float = 1e-3,
    on_round: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """Add ``pagerank`` to the vertices.

    Every edge of a vertex carries an equal part of its rank; rank of vertices without
    outgoing edges is not handed on.  Runs ``max_iter`` rounds, or until no rank moves by
    more than ``tol``; ranks are then scaled to add up to the number of vertices.

    With a ``tol`` vertices send what their rank has moved by, and those whose rank has hardly
    moved keep it back for later.  All that is kept back is at most ``slack * tol * reset /
    (1 - reset)`` at any time.  A round multiplies the sum of all deviations from full rounds by at
    most 1 - reset and adds at most (1 - reset) times that, so the deviations of all ranks
    together never exceed ``slack * tol``.  ``on_round`` is told the number of each such round and
    of the messages sent in it.
    """
    if tol is None and max_iter is None:
        raise ValueError("give tol, max_iter or both")
    ids = graph.vertices.select("id")
    degrees = graph.edges.groupBy(F.col("src").alias("id")).agg(
        F.count(F.lit(1)).alias("degree")
    )
    start = ids.join(degrees, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    lines = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("to"))
    if tol is None:
        ranks = _full_rounds(ids, lines, start, reset, max_iter, hot_rows)
    else:
        ranks = _moves(lines, start, reset, tol, max_iter, hot_rows, slack, on_round)
    sums = ranks.agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("total")).first()
    scale = sums["n"] / sums["total"] if sums["n"] else 1.0
    return graph.vertices.join(
        ranks.select("id", (F.col("rank") * F.lit(scale)).alias("pagerank")), "id"
    )


def _full_rounds(
    ids: DataFrame, lines: DataFrame, start: DataFrame, reset: float, max_iter: int, hot_rows: int
) -> DataFrame:
    # A vertex sends itself a message worth nothing: so it turns up in every round.
    lines = lines.withColumn("part", F.lit(1.0)).unionByName(
        ids.select("id", F.col("id").alias("to"), F.lit(0.0).alias("part"))
    )
    with EdgeLayout(lines, hot_rows) as layout:
        cut = RollingCut()
        ranks = cut(
            start.select("id", F.greatest("degree", F.lit(1)).alias("degree"), F.lit(1.0).alias("rank"))
        )
        for done in range(1, max_iter + 1):
            ranks = _round(layout, ranks, reset)
            if done % _ROUNDS_PER_CUT == 0 or done == max_iter:
                ranks = cut(ranks)
    return ranks


def _moves(
    lines: DataFrame,
    start: DataFrame,
    reset: float,
    tol: float,
    max_iter: int | None,
    hot_rows: int,
    slack: float,
    on_round: Callable[[int, int], None] | None,
) -> DataFrame:
    """Rounds in which a vertex sends ``due``: what its rank has moved by since it last sent."""
    with EdgeLayout(lines, hot_rows) as layout:
        # Vertices lie by id, as sums of messages arrive: a round moves messages only.
        cut = RollingCut("id")
        state = cut(start.select("id", "degree", F.lit(1.0).alias("rank"), F.lit(1.0).alias("due")))
        vertices = state.count()
        budget = slack * tol * reset / (1.0 - reset)
        # Vertices times this are within the budget; larger ones are tried on the ranks at hand.
        least = budget / max(vertices, 1)
        floor, done = 0.0, 0
        messages = state.agg(F.sum("degree")).first()[0] or 0
        while max_iter is None or done < max_iter:
            first = done == 0
            sends = (F.abs(F.col("due")) > floor) & (F.col("degree") > 0)
            sent = layout.send(state.filter(sends).select("id", (F.col("due") / F.col("degree")).alias("part")))
            sums = sent.groupBy(F.col("to").alias("id")).agg(F.sum("part").alias("_sum"))
            moved = (1.0 - reset) * F.coalesce("_sum", F.lit(0.0))
            # The first round hands on whole ranks; what arrives replaces the rank of the start.
            step = moved + (reset - 1.0) if first else moved
            kept = F.when(sends, 0.0).otherwise(F.col("due"))
            # A vertex that nobody hears counts its moves all the same; they are none of the rest.
            due = F.when(F.col("degree") > 0, step if first else kept + step).otherwise(0.0)
            following = state.join(sums, "id", "left").select(
                "id", "degree", (F.col("rank") + step).alias("rank"), due.alias("due"), F.abs(step).alias("_step")
            )
            # Measured while the round is written.
            seen = Observation()
            away = F.abs(F.col("due"))
            measures = [F.max("_step").alias("moved")]
            for k in range(_STEPS):
                small = away <= least * 10.0**k
                measures.append(F.sum(F.when(small, away).otherwise(0.0)).alias(f"held{k}"))
                measures.append(F.sum(F.when(small, 0).otherwise(F.col("degree"))).alias(f"sent{k}"))
            state = cut(following.observe(seen, *measures))
            done += 1
            if on_round:
                on_round(done, messages)
            told = seen.get
            if (told["moved"] or 0.0) <= tol:
                break
            # Half the budget leaves room for the rounding of the sums, and for what a repeated
            # task adds to them; only a little more may be sent than need be.
            best = max((k for k in range(_STEPS) if (told[f"held{k}"] or 0.0) <= budget / 2), default=None)
            floor = least * 10.0**best if best is not None else 0.0
            messages = told[f"sent{best}"] if best is not None else messages
    return cut.plain(state)


def _round(layout: EdgeLayout, ranks: DataFrame, reset: float) -> DataFrame:
    own = F.col("part") == 0.0
    return (
        layout.send(ranks)
        .groupBy(F.col("to").alias("id"))
        .agg(
            F.max(F.when(own, F.col("degree"))).alias("degree"),
            F.sum(F.col("part") * F.col("rank") / F.col("degree")).alias("_sum"),
        )
        .select("id", "degree", (reset + (1.0 - reset) * F.col("_sum")).alias("rank"))
    )
