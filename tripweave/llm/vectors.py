"""What the operators on vectors and on lists of best matches share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Products and sums of integers up to here are exact in double precision.
EXACT = float(1 << 53)
#: Lists that one group of a merging round joins.
FAN_IN = 64


def usable_vectors(rows: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """Rows (key as vec_id, vector, then ``more`` as they are) whose vector is there and holds
    finite components only.  No other column is read, so none can clash."""
    infinite = F.lit(float("inf"))
    numbers = F.transform(F.col(vector), lambda x: x.cast("double"))
    kept = rows.select(F.col(key).cast("long").alias("vec_id"), numbers.alias("vector"), *more)
    return kept.filter(
        F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite))
    )


def matrix(column: pa.Array, scale: float = 1024.0, width: int | None = None) -> np.ndarray:
    """A column of vectors as rows of floor(scale * x), in doubles.  Shorter vectors are filled
    with zeros, up to ``width`` or the longest of the column."""
    lengths = np.asarray(pc.list_value_length(column), dtype=np.int64)
    values = np.floor(scale * np.asarray(column.flatten(), dtype=np.float64))
    widest = int(lengths.max(initial=0)) if width is None else width
    if lengths.size and (lengths == widest).all():
        return values.reshape(len(lengths), widest)
    out = np.zeros((len(lengths), widest))
    row = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if lengths.size else lengths
    out[row, np.arange(values.size) - np.repeat(starts, lengths)] = values
    return out


def largest(values: np.ndarray) -> float:
    return float(np.abs(values).max(initial=0.0))


def regrouped(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of ``batches`` in tables of ``rows`` rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - count)
            held.append(part)
            count += part.num_rows
            at += part.num_rows
            if count == rows:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def leading(group: np.ndarray, score: np.ndarray, keyless: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's ``k`` highest scores, ties to the smaller key, rows without a key
    last; ordered by group and rank."""
    order = np.lexsort((key, keyless, -score, group))
    sorted_groups = group[order]
    first = np.concatenate(([True], sorted_groups[1:] != sorted_groups[:-1])) if order.size else np.zeros(0, bool)
    begins = np.maximum.accumulate(np.where(first, np.arange(order.size), 0))
    return order[np.arange(order.size) - begins < k]


def merged_lists(rows: DataFrame, lists: Sequence[str], k: int, most: int, key: str) -> DataFrame:
    """Join the best matches that tasks have found: rows (``lists``, _part, ``key``, score), at
    most ``k`` for each list and task ``_part``, ``most`` being the largest task number.

    Lists are merged as a tree: ``FAN_IN`` of them in a group, then the lists of as many groups,
    so no group ever holds more than ``FAN_IN * k`` rows, however many tasks there were.  Adds
    the column rank, from 1.
    """
    wide = 1
    while True:
        wide *= FAN_IN
        group = Window.partitionBy(*lists, "_group").orderBy(F.col("score").desc(), F.col(key).asc_nulls_last())
        rows = (
            rows.withColumn("_group", F.floor(F.col("_part") / wide).cast("long"))
            .withColumn("rank", F.row_number().over(group))
            .filter(F.col("rank") <= k)
            .drop("_group")
        )
        if wide > most:
            return rows.drop("_part")
