"""Materialisation points for plans that are used more than once, and who removes them."""

from __future__ import annotations

import functools
import re
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_COPY = re.compile(r"/(cut-[0-9a-f]{32})(?:/|$)")

# The name of the node in a line of a printed plan.
_NODE = re.compile(r"[\s:+-]*([A-Za-z]\w*)")


class _Owners(threading.local):
    """Copies made so far, by the operators now at work in this thread, innermost last."""

    def __init__(self):
        self.stack: list[dict[str, str]] = []


_owners = _Owners()


def shared_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session, named in ``spark.checkpoint.dir``.

    All executors must be able to read and write it, so there is no default.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back.

    The copy outlives the executors that made it, so a lost node costs a re-read and not a
    replay of every earlier round.  A table is written rather than a checkpoint taken: it
    comes back with its true size and without the size guesses and constraints a checkpoint
    inherits, which square with every product in a loop.

    The copy belongs to the innermost operator marked :func:`owns_copies`.  What nobody has
    removed goes when the session's JVM ends.
    """
    return _written(df)[1]


def cut_measured(df: DataFrame, size: str) -> tuple[DataFrame, int]:
    """:func:`cut_lineage` and the largest ``size`` (0 for none), measured while it is written; a
    repeated task cannot change a maximum."""
    seen = Observation()
    copy = cut_lineage(df.observe(seen, F.max(size).alias("largest")))
    return copy, seen.get["largest"] or 0


def is_scan(df: DataFrame) -> bool:
    """Whether the rows come straight from tables, by projections, filters and unions: reading them
    again costs no more than reading the tables again, and fewer columns cost less."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {found[1] for line in plan.splitlines() if (found := _NODE.match(line))}
    return nodes <= {"Project", "Filter", "Union", "Relation", "RelationV2", "LocalRelation", "LogicalRDD", "Range"}


def owns_copies(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Remove the copies that ``operator`` has made once it returns, but for those its result
    still reads; these pass to the operator around it, or stay until the session ends."""

    @functools.wraps(operator)
    def owning(*args, **options):
        mine: dict[str, str] = {}
        _owners.stack.append(mine)
        try:
            result = operator(*args, **options)
        finally:
            _owners.stack.pop()
        read = _copies_read(result) if isinstance(result, DataFrame) else set()
        spark = SparkSession.active()
        for name, path in mine.items():
            if name not in read:
                _remove(spark, path)
            elif _owners.stack:
                _owners.stack[-1][name] = path
        return result

    return owning


def cut_bucketed(df: DataFrame, key: str) -> DataFrame:
    """:func:`cut_lineage` that keeps the rows dealt by ``key``: a join, window or aggregation by
    it reads the copy as it lies, with no exchange.

    There are as many buckets as the session has shuffle partitions, so the other side of a join
    is dealt alike.  Where ``df`` is dealt by ``key`` already, each task writes its own buckets.
    Spark knows buckets of catalog tables only, so the copy has an entry in the current database,
    under its own name, until it is removed.
    """
    return _written(df, key)[1]


class RollingCut:
    """:func:`cut_lineage` for the rounds of a loop, or :func:`cut_bucketed` where a key is named;
    only the last two copies are kept.

    A round may read the copies of the round before and of its own, nothing older.
    """

    def __init__(self, key: str | None = None):
        self._key = key
        self._paths: list[str] = []

    def plain(self, copy: DataFrame) -> DataFrame:
        """The last copy with no mention of buckets, for results: what others do with them (a union
        of two, say) is then planned like any table."""
        return copy.sparkSession.read.schema(copy.schema).parquet(self._paths[-1])

    def __call__(self, df: DataFrame) -> DataFrame:
        path, copy = _written(df, self._key)
        self._paths.append(path)
        if len(self._paths) > 2:
            _remove(df.sparkSession, self._paths.pop(0))
        return copy


def _copies_read(df: DataFrame) -> set[str]:
    return {found[1] for file in df.inputFiles() if (found := _COPY.search(file))}


def _written(df: DataFrame, key: str | None = None) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    name = f"cut-{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    if key is None:
        df.write.parquet(path)
    else:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(_table(path))
    if _owners.stack:
        _owners.stack[-1][name] = path
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    return path, spark.read.schema(df.schema).parquet(path) if key is None else spark.table(_table(path))


def _table(path: str) -> str:
    """Catalog name of a bucketed copy."""
    return path.rsplit("/", 1)[-1].replace("-", "_")


def _remove(spark: SparkSession, path: str) -> None:
    if spark.catalog.tableExists(_table(path)):
        spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
    place, system = _place(spark, path)
    system.delete(place, True)
    system.cancelDeleteOnExit(place)


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())
