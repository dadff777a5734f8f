"""Stage tables: what one step writes and the next one reads.

A stage can be overwritten by a plan that reads it: each write is a version of its own that
becomes current in one step (see :mod:`tripweave.sources.versions`).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from tripweave.operators.graph import SiteGraph
from tripweave.sources.versions import VersionedStage


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, by its full name."""
    return spark.table(name)


def write_table(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    """Overwrite a catalog table, schema included.

    Spark tables other than Delta cannot be overwritten by a plan that reads them; see
    :func:`publish_table`.
    """
    _overwriting(df, fmt).saveAsTable(name)


def publish_table(df: DataFrame, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Publish ``df``, which may read the table itself, as a version of the stage ``name`` under
    ``root``, and let the catalog name ``name`` stand for it.  The name is a view: replacing it is
    one step of the catalog, schema included."""
    spark = df.sparkSession
    stage = VersionedStage(spark, f"{root}/{name}")
    folder = stage.folder(stage.publish(df, fmt))
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {fmt}.`{folder}`")
    return spark.table(name)


def read_stage(spark: SparkSession, root: str, name: str, fmt: str = "parquet", version: int | None = None) -> DataFrame:
    """The current version of a stage, or ``version``; it stays until the session ends.  A plain
    folder or file without versions is read as ``fmt``."""
    stage = VersionedStage(spark, f"{root}/{name}")
    if version is None and stage.current() is None:
        return spark.read.format(fmt).load(f"{root}/{name}")
    return stage.read(version)[0]


@contextmanager
def reading_stage(spark: SparkSession, root: str, name: str, version: int | None = None) -> Iterator[DataFrame]:
    """The stage while the block runs; a later write may remove the version after that."""
    stage = VersionedStage(spark, f"{root}/{name}")
    frame, _, mark = stage.read(version)
    try:
        yield frame
    finally:
        stage.release(mark)


def stage_version(spark: SparkSession, root: str, name: str) -> int | None:
    """Number of a stage's current version; None if it has none."""
    return VersionedStage(spark, f"{root}/{name}").current()


def publish_stage(df: DataFrame, root: str, name: str, fmt: str = "parquet", expect: int | None = None, keep: int = 1) -> int:
    """Make ``df`` the current version of the stage ``name`` under ``root``; its number.

    ``df`` may read the stage.  With ``expect`` it is an error if another version has been
    published since that one.  Versions that nobody reads any more are removed, but for the
    ``keep`` before the new one.
    """
    return VersionedStage(df.sparkSession, f"{root}/{name}").publish(df, fmt, expect, keep)


def write_stage(df: DataFrame, root: str, name: str, fmt: str = "parquet", expect: int | None = None) -> DataFrame:
    """:func:`publish_stage`, and the version as read back."""
    return read_stage(df.sparkSession, root, name, fmt, publish_stage(df, root, name, fmt, expect))


def read_graph(spark: SparkSession, root: str, fmt: str = "parquet") -> SiteGraph:
    return SiteGraph(
        read_stage(spark, root, "graph_vertices", fmt), read_stage(spark, root, "graph_edges", fmt)
    )


def write_graph(graph: SiteGraph, root: str, fmt: str = "parquet") -> SiteGraph:
    return SiteGraph(
        write_stage(graph.vertices, root, "graph_vertices", fmt),
        write_stage(graph.edges, root, "graph_edges", fmt),
    )


def _overwriting(df: DataFrame, fmt: str) -> DataFrameWriter:
    """Delta keeps a table's old schema unless told otherwise; other formats know no such option."""
    writer = df.write.format(fmt).mode("overwrite")
    return writer.option("overwriteSchema", "true") if fmt == "delta" else writer
