"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sent to all tasks at most.
SENT = 100_000

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; a temporary one only where all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = chosen.get() if chosen.isDefined() else None
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="microflow-tables-"))
    return _own[0]


def _clean() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that several branches of a plan read; it outlives lost executors and goes when the driver exits."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/microflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, name: str) -> DataFrame:
    """df, a row per instrument, as a table that goes to all tasks when joined; one of more than SENT rows is joined by a shuffle.

    A shuffle by a few instruments would gather all rows in as many tasks, on however many machines.
    """
    table = written(df, name)
    return F.broadcast(table) if table.count() <= SENT else table
