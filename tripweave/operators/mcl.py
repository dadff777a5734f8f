"""Markov clustering on sparse matrices (van Dongen, 2000)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.operators import sparse
from tripweave.plans.lineage import RollingCut, cut_lineage, owns_copies
from tripweave.plans.ordered import OrderedScan
from tripweave.plans.ranking import dense_ranks
from tripweave.plans.skew import (
    HOT_ROWS,
    group_sizes,
    hot_keys,
    hot_keys_if_any,
    spread_join,
)

# Members in one row of an exported cluster.  The flat pairs are what other operators read.
MAX_MEMBERS = 1_000_000


@owns_copies
def mcl_matrix(
    matrix: DataFrame,
    expansion: int = 2,
    inflation: float = 2,
    loop_value: float | str = 1,
    iterations: int = 100,
    pruning_threshold: float = 0.001,
    pruning_frequency: int = 1,
    convergence_check_frequency: int = 1,
    normalize_input: bool = True,
    product: str = "power",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Run the passes and return the last matrix.

    A pass expands, inflates and (every ``pruning_frequency`` passes) prunes; every
    ``convergence_check_frequency`` passes it stops if nothing moved.

    ``product="power"`` with self-loops and a normalised input is the textbook method.
    ``product="gram", loop_value=0, normalize_input=False`` multiplies by the transpose on
    raw counts instead.
    """
    current = cut_lineage(matrix)
    if loop_value:
        current = sparse.with_loops(current, loop_value)
    if normalize_input:
        current = sparse.normalize(current, hot_rows)
    # Copies lie by column: that is how the next product, its sums and its sizes read them.
    cut = RollingCut("j")
    current = cut(current)
    known = sparse.Extent(**sparse.extent(current).first().asDict())
    for done in range(iterations):
        light, even = _bounds(known, expansion, product, hot_rows)
        prunes = done % pruning_frequency == 0
        following = cut(_pass(current, expansion, inflation, product, light, even, hot_rows, pruning_threshold if prunes else None))
        # The convergence test and the sizes for the next pass in one job of one row.
        told = sparse.extent(following)
        if done % convergence_check_frequency == 0:
            told = sparse.extent(following, sparse.converged(current, following))
        told = told.first().asDict()
        current = following
        if told.pop("converged", False):
            break
        known = sparse.Extent(**told)
    return cut.plain(current)


def _pass(
    current: DataFrame, expansion: int, inflation: float, product: str, light: bool, even: bool, hot_rows: int, threshold: float | None
) -> DataFrame:
    """One pass as a plan.  Of entries that lie by column a balanced pass moves one side of the
    product (none of ``gram``), its sums, and the sums again by column."""
    grown = sparse.power(current, expansion, product, balanced=light)
    following = sparse.inflate(grown, inflation, hot_rows, balanced=even)
    return following if threshold is None else sparse.prune(following, threshold)


def _bounds(
    known: sparse.Extent, expansion: int, product: str, hot_rows: int
) -> tuple[bool, bool]:
    """Whether no inner index and no column of the product can be crowded.

    A pruned matrix has fewer than 1 / threshold entries per column, so from the second pass
    on this usually holds and the guards against skew can stay away.
    """
    if expansion > 2:
        return False, False
    if product == "power":
        meetings, column = known.column * known.row, known.column**expansion
    else:
        meetings, column = known.column**2, known.row * known.column
    return meetings <= sparse.SIDE_ENTRIES**2, column <= hot_rows


def attractor_members(m: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(``attractor``, ``member``) pairs: rows with a positive diagonal, and their columns.

    The flat form of the clusters.  A member may belong to several attractors.
    """
    attractors = m.filter((F.col("i") == F.col("j")) & (F.col("v") > 0)).select("i").distinct()
    # Entries are distinct in (i, j), so no second grouping is needed here.
    sizes = group_sizes(m, ["i"])
    return spread_join(m, attractors, ["i"], ["j"], hot_keys(sizes, ["i"], hot_rows=hot_rows)).select(
        F.col("i").alias("attractor"), F.col("j").alias("member")
    )


def merged_equal(pairs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``pairs`` of :func:`attractor_members` with one attractor, the smallest, for each set of
    members.  Sets are told apart by their size and two hashes over their members."""
    hashed = F.xxhash64("member")
    sets = cut_lineage(
        pairs.groupBy("attractor").agg(
            F.count(F.lit(1)).alias("_rows"),
            F.bit_xor(hashed).alias("_xor"),
            F.sum(F.hash("member", hashed).cast("long")).alias("_sum"),
        )
    )
    kept = sets.groupBy("_rows", "_xor", "_sum").agg(F.min("attractor").alias("attractor"))
    hot = hot_keys_if_any(sets, ["attractor"], hot_rows=hot_rows)
    return spread_join(pairs, kept.select("attractor"), ["attractor"], ["member"], hot)


def attractor_clusters(
    m: DataFrame,
    max_members: int = MAX_MEMBERS,
    hot_rows: int = HOT_ROWS,
    merge_equal: bool = False,
) -> DataFrame:
    """``cluster_id`` (from 0, by attractor), ``attractor`` and its sorted ``members``.

    Members are paged by rank: ``part`` 0 holds the first ``max_members``, ``part`` 1 the next.
    ``merge_equal`` lists attractors with the same members once.
    """
    pairs = attractor_members(m, hot_rows)
    if merge_equal:
        pairs = merged_equal(pairs, hot_rows)
    placed = (
        OrderedScan(pairs, ["attractor"], ["member"], hot_rows)
        .derive(_one=F.lit(1))
        .running_sum("_one", "_place")
        .derive(part=F.floor((F.col("_place") - 1) / F.lit(max_members)).cast("int"))
        .frame()
    )
    pages = cut_lineage(
        placed.groupBy("attractor", "part").agg(F.array_sort(F.collect_list("member")).alias("members"))
    )
    named = dense_ranks(pages.select("attractor").distinct(), ["attractor"], "cluster_id", start=0)
    return pages.join(named, "attractor").select("cluster_id", "attractor", "part", "members")


def mcl(matrix: DataFrame, max_members: int = MAX_MEMBERS, **options) -> DataFrame:
    """Clusters of ``matrix``; ``options`` as in :func:`mcl_matrix`."""
    return attractor_clusters(mcl_matrix(matrix, **options), max_members)
