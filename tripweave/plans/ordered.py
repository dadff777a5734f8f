"""Row-order operators (previous row, running sum) over keys of any size.

Ordinary keys use one window.  A key with more than ``hot_rows`` rows is cut into
range blocks along its order; the window runs per block, and what a block needs from
the blocks before it comes from a one-row-per-block summary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.plans.lineage import cut_lineage, is_scan
from tripweave.plans.skew import HOT_ROWS, group_sizes, threshold

_BLOCK = "_scan_block"
# Counters of the pass that looks for crowded keys; over four a key that could be crowded.
_SKETCH = 1 << 22


class OrderedScan:
    """A frame seen in the order of ``order`` inside each ``keys`` group.

    ``order`` must tell any two different rows of a group apart, or the answer would
    depend on how rows were placed.

    Of rows that come straight from tables (:func:`is_scan`) crowded keys are found in a pass over
    the key columns alone: rows are read in full by the scan only, and only rows of crowded keys
    are written.  Other rows are written once, and counted and scanned from there.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        hot_rows: int = HOT_ROWS,
    ):
        self._keys = list(keys)
        self._order = list(order)
        self._names = df.columns
        df = df if is_scan(df) else cut_lineage(df)
        crowded = crowded_keys(df, self._keys, hot_rows)
        if crowded is None:
            self._plain, self._blocked = df, None
            return
        rows = crowded.agg(F.sum("_scan_rows")).first()[0]
        listed = F.broadcast(crowded.select(*self._keys))
        self._plain = _same_keys(df, listed, self._keys, "left_anti")
        self._blocked = cut_lineage(
            _same_keys(df, listed, self._keys, "left_semi")
            .repartitionByRange(int(-(-rows // hot_rows)) + 1, *self._keys, *self._order)
            .withColumn(_BLOCK, F.spark_partition_id())
        )

    def previous(self, columns: Sequence[str], out: str) -> OrderedScan:
        """Add ``out``: a struct of ``columns`` from the row before, null on the first row."""
        value = F.struct(*columns)
        whole = Window.partitionBy(*self._keys).orderBy(*self._order)
        self._plain = self._plain.withColumn(out, F.lag(value).over(whole))
        if self._blocked is not None:
            last = self._blocked.groupBy(*self._keys, _BLOCK).agg(
                F.max_by(value, F.struct(*self._order)).alias("_scan_last")
            )
            carried = last.select(
                *self._keys, _BLOCK, F.lag("_scan_last").over(self._over_blocks()).alias("_scan_carried")
            )
            inside = Window.partitionBy(*self._keys, _BLOCK).orderBy(*self._order)
            self._blocked = (
                _same_keys(
                    self._blocked.withColumn(out, F.lag(value).over(inside)),
                    carried,
                    [*self._keys, _BLOCK],
                )
                .withColumn(out, F.coalesce(out, "_scan_carried"))
                .drop("_scan_carried")
            )
        self._names = [*self._names, out]
        return self

    def derive(self, **columns) -> OrderedScan:
        """Add plain column expressions."""
        self._plain = self._plain.withColumns(columns)
        if self._blocked is not None:
            self._blocked = self._blocked.withColumns(columns)
        self._names = [*self._names, *(name for name in columns if name not in self._names)]
        return self

    def running_sum(self, column: str, out: str) -> OrderedScan:
        """Add ``out``: the sum of ``column`` from the first row up to this one."""
        so_far = (Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*self._keys).orderBy(*self._order).rowsBetween(*so_far)
        self._plain = self._plain.withColumn(out, F.sum(column).over(whole))
        if self._blocked is not None:
            before = self._over_blocks().rowsBetween(Window.unboundedPreceding, -1)
            offsets = (
                self._blocked.groupBy(*self._keys, _BLOCK)
                .agg(F.sum(column).alias("_scan_sum"))
                .select(
                    *self._keys,
                    _BLOCK,
                    F.coalesce(F.sum("_scan_sum").over(before), F.lit(0)).alias("_scan_before"),
                )
            )
            inside = Window.partitionBy(*self._keys, _BLOCK).orderBy(*self._order)
            self._blocked = (
                _same_keys(
                    self._blocked.withColumn(out, F.sum(column).over(inside.rowsBetween(*so_far))),
                    offsets,
                    [*self._keys, _BLOCK],
                )
                .withColumn(out, F.col(out) + F.col("_scan_before"))
                .drop("_scan_before")
            )
        self._names = [*self._names, out]
        return self

    def frame(self) -> DataFrame:
        plain = self._plain.select(*self._names)
        if self._blocked is None:
            return plain
        return plain.unionByName(self._blocked.select(*self._names))

    def _over_blocks(self):
        return Window.partitionBy(*self._keys).orderBy(_BLOCK)


def crowded_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Every key with more rows than the threshold and their number, ``_scan_rows``; None if there
    is none.

    Keys are first counted together by hash, ``_SKETCH`` counters in all: each task hands on its
    own counters, however many keys there are.  A crowded key makes its counter crowded, so the
    keys of crowded counters, counted one by one, are all there can be.
    """
    counter = F.pmod(F.xxhash64(*keys), F.lit(_SKETCH)).alias("_scan_counter")
    counters = cut_lineage(df.select(counter).groupBy("_scan_counter").agg(F.count(F.lit(1)).alias("_scan_rows")))
    over = F.col("_scan_rows") > threshold(counters, "_scan_rows", hot_rows)
    heavy = cut_lineage(counters.filter(over).select("_scan_counter"))
    if heavy.isEmpty():
        return None
    # Fewer than a million short rows, as the threshold is over a millionth of all.
    likely = df.select(*keys, counter).join(F.broadcast(heavy), "_scan_counter", "left_semi")
    crowded = cut_lineage(group_sizes(likely, keys, "_scan_rows").filter(over))
    return None if crowded.isEmpty() else crowded


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null: rows without a key are a group too."""
    right = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    joined = left.join(right, same, how)
    return joined.drop(*(f"_right_{key}" for key in keys))
