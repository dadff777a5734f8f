"""The folder for intermediate copies, where a session that runs the queries names none."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def name_folder(spark: SparkSession) -> None:
    """Leave the session's own ``spark.checkpoint.dir`` alone.  Without one a local master, where
    one machine is the whole cluster, gets a temporary folder; any other master gets none, and
    the first copy fails with what to set."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and is_local(context.master):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tripweave-"))


def is_local(master: str) -> bool:
    """Whether the executors are threads of the driver: ``local`` and ``local[...]``."""
    return master == "local" or master.startswith("local[")
