"""Dense ranks over the distinct values of a column, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.plans.lineage import cut_lineage
from tripweave.plans.skew import HOT_ROWS, group_sizes, hot_keys_if_any, spread_join

# monotonically_increasing_id keeps the partition above bit 33 and the row below it.
_ROW_BITS = 33


def dense_ranks(values: DataFrame, by: Sequence[str], out: str, start: int = 1) -> DataFrame:
    """Number the rows of ``values``, unique in ``by``, along the order of ``by``.

    Range partitions are sorted in parallel; a row's rank is its place inside the
    partition plus the sizes of the partitions before it.
    """
    placed = cut_lineage(
        values.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("_at"), _ROW_BITS)
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row per partition, so the unpartitioned window and the broadcast are small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, row + F.col("_before") + F.lit(start))
        .drop("_at", "_part", "_before")
    )


def compact_ids(
    df: DataFrame,
    column: str,
    spread_by: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
    kind: str = "int",
) -> DataFrame:
    """Replace ``column`` by its dense rank (from 1); nulls stay null.

    ``kind="long"`` where there may be over two billion values.
    """
    names = df.columns
    sizes = group_sizes(df.filter(F.col(column).isNotNull()), [column])
    ranks = dense_ranks(sizes, [column], "_rank")
    hot = hot_keys_if_any(ranks, [column], "_rows", hot_rows)
    spread_by = spread_by or [name for name in names if name != column]
    ranked = spread_join(df, ranks.select(column, "_rank"), [column], spread_by, hot, "left")
    return ranked.withColumn(column, F.col("_rank").cast(kind)).select(*names)
