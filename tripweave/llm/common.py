"""What several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
from collections.abc import Callable, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Entries a worker keeps of what it has computed per word.  A full cache stops growing
#: and later words are computed anew, so results do not depend on it.
WORKER_CACHE = 200_000

#: Rows with a text that a worker turns into Python objects at a time.
TEXTS_AT_ONCE = 1_000

_shipped: set[str] = set()


def ship_package(context: SparkContext) -> None:
    """Give the workers this package as a Python file of the application, once a session.

    Functions that run in workers are then found there by name, wherever the driver had the
    package from, and what a module keeps lasts from task to task.
    """
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="package-")
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def map_arrow(rows: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers.

    Rows with a text come in small batches, and a task that ends gives its memory back: workers
    live on from stage to stage beside each other, and each would keep the most it ever used.
    """
    ship_package(rows.sparkSession.sparkContext)
    texts = any(isinstance(f.dataType, StringType) for f in rows.schema)

    def run(batches):
        try:
            yield from function(_sliced(batches) if texts else batches)
        finally:
            _release_memory()

    return rows.mapInArrow(run, schema)


def _sliced(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def _release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def key_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text is empty.

    Every other column stays out, so extra columns cannot clash with working names.
    """
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key written as text, modulo ``divisor``; a row without a key counts as 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % divisor, F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the plain lower() does just that where all is ASCII, and is faster."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, capitals, capitals.lower())
    )


def total(df: DataFrame, columns: Sequence[str]) -> list[int]:
    """Sums of ``columns`` over all rows, 0 where there are none."""
    row = df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns)).first()
    return [row[c] for c in columns]
