"""Exact search for the k largest inner products.

Queries and vectors meet tile by tile: a block of queries is broadcast, each task multiplies
it with its own vectors as products of small matrices, and of every tile a query keeps its k
largest.  A task joins the lists of its tiles and hands on one list a query; lists of tasks
are then merged as a tree.  Components are integers, so products are exact and so are ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tripweave.llm.common import map_arrow
from tripweave.llm.vectors import EXACT, largest, leading, matrix, merged_lists, regrouped, usable_vectors
from tripweave.plans.lineage import cut_measured
from tripweave.plans.ranking import dense_ranks

#: Queries broadcast at once; at 64 components some 32 MB.
QUERY_BLOCK = 65_536
#: Rows of a tile: queries and vectors.  A tile of products takes 16 MB.
TILE_QUERIES, TILE_ROWS = 512, 4_096

_FOUND = StructType(
    [StructField(name, LongType()) for name in ("_nth", "query_id", "_part", "vec_id", "score")]
)


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in doubles where no sum can leave their whole
    numbers, else in 64-bit integers.  A component that one side lacks counts as zero."""
    width = min(queries.shape[1], rows.shape[1])
    left, right = queries[:, :width], rows[:, :width]
    bound = largest(left) * largest(right) * max(width, 1)
    if bound < EXACT:
        return (left @ right.T).astype(np.int64)
    if bound >= 2.0**63:
        raise OverflowError("inner products of these vectors may exceed 64 bits")
    return left.astype(np.int64) @ right.astype(np.int64).T


def _tile_best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` largest scores, of equal ones the first columns;
    ``own`` marks what takes no part."""
    if own.any():
        scores = np.where(own, np.iinfo(np.int64).min, scores)
    k = min(k, scores.shape[1])
    last = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    above, level = scores > last, scores == last
    room = k - above.sum(axis=1)
    for row in np.flatnonzero(level.sum(axis=1) > room):
        level[row, np.flatnonzero(level[row])[room[row] :]] = False
    return np.nonzero((above | level) & ~own)


class _Lists:
    """The best matches so far of one tile's queries."""

    def __init__(self, k: int):
        self._k = k
        self.query = self.score = self.key = np.zeros(0, np.int64)
        self.keyless = np.zeros(0, bool)

    def add(self, query, score, key, keyless) -> None:
        query, score = np.concatenate((self.query, query)), np.concatenate((self.score, score))
        key, keyless = np.concatenate((self.key, key)), np.concatenate((self.keyless, keyless))
        best = leading(query, score, keyless, key, self._k)
        self.query, self.score, self.key, self.keyless = query[best], score[best], key[best], keyless[best]


def exact_top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 1024.0,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` rows of
    ``rows`` of another key with the largest inner product of floor(scale * x), all if fewer;
    equal scores by ascending key, rows without a key after the others.

    Vectors that are null or hold null or non-finite components take no part.  A vector shorter
    than another counts as filled up with zeros.  Query rows that repeat a key have a list each;
    vectors that repeat a key are matches each.  An empty table on either side gives no rows;
    other columns are not read.  Scores beyond 64 bits are an error.

    ``query_block`` queries are broadcast at a time: one block is one pass over ``rows``.
    """
    spark = rows.sparkSession
    asked = dense_ranks(usable_vectors(queries, key, vector), ["vec_id"], "_nth", start=0)
    candidates = usable_vectors(rows, key, vector)
    total = asked.count()
    found = None
    for first in range(0, total, query_block):
        block = asked.filter(F.col("_nth").between(first, first + query_block - 1)).toArrow()
        shared = spark.sparkContext.broadcast(
            (
                block.column("_nth").to_numpy(),
                np.asarray(block.column("vec_id").fill_null(0), np.int64),
                np.asarray(block.column("vec_id").is_null(), bool),
                matrix(block.column("vector").combine_chunks(), scale),
            )
        )
        lists = map_arrow(candidates, _search(shared, k, scale), _FOUND)
        found = lists if found is None else found.unionByName(lists)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    # Written once: a lost executor then costs a merge, and never the products.
    found, most = cut_measured(found, "_part")
    merged = merged_lists(found, ["_nth", "query_id"], k, most, "vec_id")
    return merged.select("query_id", "rank", "vec_id", "score")


def _search(shared, k: int, scale: float):
    def search(batches):
        numbers, ids, keyless, queries = shared.value
        part = TaskContext.get().partitionId()
        tiles = range(0, len(ids), TILE_QUERIES)
        lists = [_Lists(k) for _ in tiles]
        for table in regrouped(batches, TILE_ROWS):
            column = table.column("vec_id")
            row_keyless = np.asarray(column.is_null(), bool)
            row_ids = np.asarray(column.fill_null(0), np.int64)
            # In order of key, so that the first columns win a tie.
            order = np.lexsort((row_ids, row_keyless))
            row_ids, row_keyless = row_ids[order], row_keyless[order]
            vectors = matrix(table.column("vector").combine_chunks(), scale)[order]
            for at, held in zip(tiles, lists, strict=True):
                own_ids, own_keyless = ids[at : at + TILE_QUERIES], keyless[at : at + TILE_QUERIES]
                own = (own_ids[:, None] == row_ids) & ~own_keyless[:, None] & ~row_keyless
                scores = _products(queries[at : at + TILE_QUERIES], vectors)
                query, column = _tile_best(scores, own, k)
                held.add(query + at, scores[query, column], row_ids[column], row_keyless[column])
        for held in lists:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers[held.query], pa.int64()),
                    pa.array(ids[held.query], pa.int64(), mask=keyless[held.query]),
                    pa.array(np.full(len(held.query), part), pa.int64()),
                    pa.array(held.key, pa.int64(), mask=held.keyless),
                    pa.array(held.score, pa.int64()),
                ],
                names=_FOUND.fieldNames(),
            )

    return search
