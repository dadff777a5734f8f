"""Run queries against DuckDB: ``python tests/oracle_check.py <folder> [name ...]``."""

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402


def open_tables(folder):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((value is None, value if value is not None else 0) for value in row)


def mismatch(spark, con, folder, name):
    """None if both sides agree on names and values, else what differs."""
    frame = contract.queries()[name](spark, folder)
    names = sorted(frame.columns)
    ours = sorted((tuple(r) for r in frame.select(*names).collect()), key=_key)
    answer = con.sql(contract.oracle_sql()[name])
    if sorted(answer.columns) != names:
        return f"columns {names} against {sorted(answer.columns)}"
    theirs = sorted(answer.select(*[f'"{n}"' for n in names]).fetchall(), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            same = math.isclose(x, y, rel_tol=1e-12) if isinstance(x, float) and y is not None else x == y
            if not same:
                return f"{a} against {b}"
    return None


def main():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tripweave-check-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    con = open_tables(folder)
    failed = 0
    for name in sys.argv[2:] or contract.oracle_sql():
        start = time.time()
        try:
            problem = mismatch(spark, con, folder, name)
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:24s} {time.time() - start:6.1f}s  {problem or 'ok'}", flush=True)
    sys.exit(failed > 0)


if __name__ == "__main__":
    main()
