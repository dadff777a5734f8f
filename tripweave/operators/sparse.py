"""Sparse matrices as (``i``, ``j``, ``v``) tables: row, column, value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.plans.lineage import cut_lineage
from tripweave.plans.skew import (
    HOT_ROWS,
    all_salts,
    group_sizes,
    hot_keys,
    salt_of,
    spread_join,
    threshold,
)

# Entries of one matrix meeting those of another under one inner index in one task.
SIDE_ENTRIES = 2_000


def as_matrix(edges: DataFrame, weight: str = "normal") -> DataFrame:
    """Edges as a matrix: row ``src``, column ``dst``."""
    return edges.select(
        F.col("src").cast("long").alias("i"),
        F.col("dst").cast("long").alias("j"),
        F.col(weight).cast("double").alias("v"),
    )


@dataclass(frozen=True)
class Extent:
    """The most entries in one column and in one row."""

    column: int
    row: int


def multiply(
    a: DataFrame, b: DataFrame, side_entries: int = SIDE_ENTRIES, balanced: bool = False
) -> DataFrame:
    """A · B.  ``balanced``: the caller knows that no inner index is crowded."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("c"), "v")
    return _product(a, right, side_entries, balanced)


def multiply_transposed(
    a: DataFrame, b: DataFrame, side_entries: int = SIDE_ENTRIES, balanced: bool = False
) -> DataFrame:
    """A · Bᵀ.  ``balanced`` as in :func:`multiply`.  Of A · Aᵀ, which is symmetric, one half is
    computed and mirrored."""
    right = b.select(F.col("j").alias("k"), F.col("i").alias("c"), "v")
    return _product(a, right, side_entries, balanced, symmetric=a is b)


def power(
    a: DataFrame,
    n: int,
    product: str = "power",
    side_entries: int = SIDE_ENTRIES,
    balanced: bool = False,
) -> DataFrame:
    """``n - 1`` multiplications of A: by A (``product="power"``, the matrix power) or by its
    transpose (``product="gram"``).  ``balanced`` speaks of the first one only."""
    times = {"power": multiply, "gram": multiply_transposed}[product]
    result = a
    for step in range(1, n):
        first = step == 1
        result = times(result if first else cut_lineage(result), a, side_entries, balanced and first)
    return result


def normalize(m: DataFrame, hot_rows: int = HOT_ROWS, balanced: bool = False) -> DataFrame:
    """Divide each entry by the sum of its column.

    ``balanced``: the caller knows that no column has more than ``hot_rows`` entries.  Then one
    window reads the entries once, and leaves them dealt by column.
    """
    if balanced:
        whole = F.sum("v").over(Window.partitionBy("j"))
        return m.select("i", "j", (F.col("v") / whole).alias("v"))
    sums = m.groupBy("j").agg(F.sum("v").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    hot = hot_keys(sums, ["j"], hot_rows=hot_rows)
    return spread_join(m, sums.drop("_rows"), ["j"], ["i"], hot).select(
        "i", "j", (F.col("v") / F.col("_sum")).alias("v")
    )


def inflate(
    m: DataFrame, r: float, hot_rows: int = HOT_ROWS, balanced: bool = False
) -> DataFrame:
    """Raise each entry to ``r`` and normalise the columns; ``balanced`` as there."""
    raised = F.col("v") * F.col("v") if r == 2 else F.pow("v", F.lit(float(r)))
    return normalize(m.select("i", "j", raised.alias("v")), hot_rows, balanced)


def prune(m: DataFrame, threshold: float) -> DataFrame:
    """Keep entries above ``threshold``; columns are not normalised again."""
    return m.filter(F.col("v") > threshold)


def converged(old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """One row, ``converged``: every entry of ``new`` is close to that of ``old``.

    An entry missing from ``old`` counts as 0; entries that vanished are not looked at, so an
    empty ``new`` has converged.  ``strict`` looks at them too, as 0 in ``new``.  Close means
    |old - new| <= 1e-8 + 1e-5 |new|.
    """
    before, after = F.coalesce("_old", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    close = F.abs(before - after) <= 1e-8 + 1e-5 * F.abs(after)
    was = old.select("i", "j", F.col("v").alias("_old"))
    return new.join(was, ["i", "j"], "full" if strict else "left").agg(
        F.coalesce(F.bool_and(close), F.lit(True)).alias("converged")
    )


def extent(m: DataFrame, verdict: DataFrame | None = None) -> DataFrame:
    """One row, ``column`` and ``row``: the numbers of :class:`Extent`.  The one row of
    :func:`converged`, if given, adds its answer, so that one job tells all."""
    facts = None
    for name, key in (("column", "j"), ("row", "i")):
        one = group_sizes(m, [key]).agg(F.max("_rows").alias(name))
        facts = one if facts is None else facts.unionByName(one, allowMissingColumns=True)
    told = [F.coalesce(F.max(name), F.lit(0)).alias(name) for name in ("column", "row")]
    if verdict is not None:
        facts = facts.unionByName(verdict, allowMissingColumns=True)
        told.append(F.bool_and("converged").alias("converged"))
    return facts.agg(*told)


def with_loops(m: DataFrame, value: float | str) -> DataFrame:
    """Add an entry on the diagonal for every index: ``value``, or with ``"max"`` the largest
    entry of the column (1 for an empty column).  Loops already there are kept on top."""
    ends = m.select(F.explode(F.array("i", "j")).alias("i"), F.lit(None).cast("double").alias("v"))
    if value == "max":
        seen = ends.unionByName(m.select(F.col("j").alias("i"), "v"))
        loops = seen.groupBy("i").agg(F.coalesce(F.max("v"), F.lit(1.0)).alias("v"))
    else:
        loops = ends.select("i").distinct().withColumn("v", F.lit(float(value)))
    loops = loops.select("i", F.col("i").alias("j"), "v")
    return m.unionByName(loops).groupBy("i", "j").agg(F.sum("v").alias("v"))


def _product(a: DataFrame, b: DataFrame, side_entries: int, balanced: bool, symmetric: bool = False) -> DataFrame:
    """Sum of a.v * b.v over the shared inner index: A's column, B's ``k``.

    All entries of A's column k meet all entries of B's row k; that is what the product is.
    Where this is many pairs, both sides are cut: A's part p meets B's part q in task
    (k, p, q), and A is copied once per q, B once per p.

    ``symmetric``: both sides are the same entries, so a pair and its mirror image add the same.
    Only parts p <= q meet then, and inside one part only rows i <= c.
    """
    left = a.select(F.col("j").alias("k"), "i", F.col("v").alias("_a"))
    right = b.select("k", "c", F.col("v").alias("_b"))
    if balanced:
        pairs = left.join(right, "k")
        return _mirrored(pairs.filter("i <= c")) if symmetric else _summed(pairs)
    met = (
        group_sizes(left, ["k"], "_an")
        .join(group_sizes(right, ["k"], "_bn"), "k")
        .withColumn("_met", F.col("_an").cast("double") * F.col("_bn"))
    )
    hubs = F.broadcast(
        met.filter(F.col("_met") > threshold(met, "_met", side_entries * side_entries)).select(
            "k",
            F.ceil(F.col("_an") / side_entries).cast("int").alias("_ps"),
            F.ceil(F.col("_bn") / side_entries).cast("int").alias("_qs"),
        )
    )
    ps, qs = F.coalesce("_ps", F.lit(1)), F.coalesce("_qs", F.lit(1))
    left = left.join(hubs, "k", "left").withColumn("_p", salt_of(["i"], ps))
    right = right.join(hubs, "k", "left").withColumn("_q", salt_of(["c"], qs))
    if symmetric:
        left = left.withColumn("_q", F.explode(F.sequence("_p", qs - 1)))
        right = right.withColumn("_p", F.explode(F.sequence(F.lit(0), "_q")))
    else:
        left, right = left.withColumn("_q", all_salts(qs)), right.withColumn("_p", all_salts(ps))
    pairs = left.drop("_ps", "_qs").join(right.drop("_ps", "_qs"), ["k", "_p", "_q"])
    return _mirrored(pairs.filter("_p < _q OR i <= c")) if symmetric else _summed(pairs)


def _summed(pairs: DataFrame) -> DataFrame:
    return (
        pairs.groupBy("i", F.col("c").alias("j"))
        .agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))
        .filter(F.col("v") != 0)
    )


def _mirrored(pairs: DataFrame) -> DataFrame:
    """Sums of one half of a symmetric matrix, and their images across the diagonal."""
    half = _summed(pairs.select(F.least("i", "c").alias("i"), F.greatest("i", "c").alias("c"), "_a", "_b"))
    one = F.struct("i", "j")
    both = F.when(F.col("i") == F.col("j"), F.array(one)).otherwise(
        F.array(one, F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    return half.select(F.explode(both).alias("at"), "v").select("at.i", "at.j", "v")
