"""A sink that holds each batch once, and stored rows replayed through a stream in several runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microflow.sources.shared import folder

#: Rows that one run of a replay takes.
PIECE_ROWS = 4_000_000
_PIECE = "_replay_piece"
_STATE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def logged(spark: SparkSession, path: str) -> list[int]:
    """The batches that the sink's log holds."""
    fs, p = _store(spark, f"{path}/_log")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []


def log(spark: SparkSession, path: str, batch: int) -> None:
    """A batch counts from here on; the entry is one file, so it is there or not."""
    fs, p = _store(spark, f"{path}/_log/{batch}")
    fs.create(p, True).close()


def write_batch(df: DataFrame, path: str, batch: int, split: list[str]) -> None:
    """A batch as a folder of its own, then its entry in the log. A batch that is in the log already is left alone."""
    spark = df.sparkSession
    if batch not in logged(spark, path):
        out = df.write.mode("overwrite")
        (out.partitionBy(*split) if split else out).parquet(f"{path}/sink_batch={batch}")
        log(spark, path, batch)


def exactly_once(stream: DataFrame, path: str, checkpoint: str, split: list[str] | None = None):
    """The running query that writes a stream to `path`; split: columns that part it into tables, such as `late`.

    A batch that a crash has left half written isn't in the log: the restarted query runs it again under its number and
    writes over it. One that was logged before the crash is skipped. So each row is there once, whatever the moment of the crash.
    """
    spark = stream.sparkSession
    with_state(spark)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: write_batch(df, path, n, split or [])).start()


def with_state(spark: SparkSession) -> None:
    """Keyed state with timers and maps lives in this store."""
    spark.conf.set(_STATE, _ROCKS)


def committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all batches in the log."""
    found = [f"{path}/sink_batch={n}" for n in logged(spark, path)]
    return spark.read.schema(schema).option("basePath", path).parquet(*found).drop("sink_batch") if found else spark.createDataFrame([], schema)


def replayed(events: DataFrame, order: str, build: Callable[[DataFrame], DataFrame], pieces: int = 3, after: tuple[DataFrame, ...] = ()) -> DataFrame:
    """What a streaming plan makes of stored events that arrive in pieces, by `order`, and of the rows `after` them.

    Each piece is a run of its own that goes on from the checkpoint, as after a restart. There are more pieces if they would
    have more than PIECE_ROWS rows, so what a run holds doesn't grow with the table. All are cut in one pass.
    """
    spark = events.sparkSession
    base = f"{folder(spark).rstrip('/')}/microflow/replay-{uuid.uuid4().hex}"
    pieces = max(pieces, -(-events.count() // PIECE_ROWS))
    cuts = sorted(set(events.agg(F.percentile_approx(order, [i / pieces for i in range(1, pieces)])).first()[0] or []))
    number = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(order))) if cuts else F.lit(0)
    # rows without an order come in no piece, unless there is one only
    events.withColumn(_PIECE, F.when(F.col(order).isNotNull() | F.lit(not cuts), number)).write.partitionBy(_PIECE).parquet(f"{base}/cut")
    for i, piece in enumerate([*[None] * (len(cuts) + 1), *after]):
        target, (fs, source) = f"{base}/in/piece={i}", _store(spark, f"{base}/cut/{_PIECE}={i}")
        if piece is None and fs.exists(source):
            fs.mkdirs(_store(spark, f"{base}/in")[1])
            fs.rename(source, _store(spark, target)[1])
        else:
            (events.limit(0) if piece is None else piece).write.parquet(target)
        stream = build(spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{base}/in"))
        schema = stream.schema
        exactly_once(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return committed(spark, f"{base}/out", schema)
