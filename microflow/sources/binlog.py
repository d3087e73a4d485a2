"""Binary event logs as a Spark data source: 32-byte records after a 32-byte header, read by ranges of records."""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the format.
MAGIC, VERSION, RECORD = b"LOB1", 1, 32
HEADER, HEADER_SIZE = "<4sHHqqq", 32
EVENT = np.dtype([("exch_ts_us", "<i8"), ("seq", "<i8"), ("price_ticks", "<i4"), ("qty_lots", "<i4"), ("type", "u1"), ("side", "u1"), ("symbol_id", "u1"), ("flags", "u1"), ("reserved", "<i4")])
SCHEMA = "exch_ts_us long, seq long, price_ticks int, qty_lots int, type short, side short, symbol_id short, flags short"


def check(header: bytes, size: int) -> int:
    """The number of records of a log with this header and size in bytes; raises for anything odd."""
    if len(header) < HEADER_SIZE:
        raise ValueError("the file is shorter than its header")
    magic, version, record, count, _, _ = struct.unpack(HEADER, header[:HEADER_SIZE])
    if magic != MAGIC or version != VERSION or record != RECORD:
        raise ValueError("not a binary event log of this version")
    if (size - HEADER_SIZE) % RECORD:
        raise ValueError("the file ends within a record")
    if count != (size - HEADER_SIZE) // RECORD:
        raise ValueError("the header's count of records isn't the file's")
    return count


def encode(events: np.ndarray) -> bytes:
    """A whole log of these records."""
    ts = events["exch_ts_us"]
    head = struct.pack(HEADER, MAGIC, VERSION, RECORD, len(events), int(ts[0]) if len(ts) else 0, int(ts[-1]) if len(ts) else 0)
    return head + events.astype(EVENT).tobytes()


def _open(path: str):
    """The store of a path or URI and the path within it: local folders, HDFS, S3 and what else pyarrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def _batch(r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[c]).astype(t)) for c, t in _COLUMNS], [c for c, _ in _COLUMNS])


_COLUMNS = (("exch_ts_us", "i8"), ("seq", "i8"), ("price_ticks", "i4"), ("qty_lots", "i4"), ("type", "i2"), ("side", "i2"), ("symbol_id", "i2"), ("flags", "i2"))


class Range(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        super().__init__((path, first, n))
        self.path, self.first, self.n = path, first, n


class Reader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def partitions(self):
        from pyarrow import fs

        store, path = _open(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else sorted((i for i in store.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File and i.base_name[0] not in "._"), key=lambda i: i.path)
        out = []
        for i in found:
            with store.open_input_file(i.path) as f:
                n = check(f.read(HEADER_SIZE), i.size)
            out += [Range(i.path, at, min(self.block, n - at)) for at in range(0, n, self.block)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.n:
            return
        store, _ = _open(self.path)
        with store.open_input_file(partition.path) as f:
            f.seek(HEADER_SIZE + RECORD * partition.first)
            left = partition.n
            while left:
                rows = np.frombuffer(f.read(RECORD * min(left, 65536)), EVENT)
                left -= len(rows)
                yield _batch(rows)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    """Tasks write logs of at most `block` records below _temporary; the commit moves those of the tasks that count into the folder.

    A log is closed with its header once its records are known, so memory is bounded by a block. Files of lost or repeated
    tasks stay below _temporary and go with it.
    """

    def __init__(self, path: str, block: int, overwrite: bool):
        self.path, self.block, self.overwrite = path, block, overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        store, path = _open(self.path)
        name, files, held, n = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", [], [], 0
        store.create_dir(f"{path}/_temporary", recursive=True)

        def close(rows: np.ndarray) -> None:
            files.append(f"{name[:7]}{len(files):06d}-{name[7:]}.bin")
            with store.open_output_stream(f"{path}/_temporary/{files[-1]}") as f:
                f.write(encode(rows))

        for batch in iterator:
            rows = np.zeros(batch.num_rows, EVENT)
            for c, _ in _COLUMNS:
                rows[c] = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            held.append(rows)
            n += len(rows)
            while n >= self.block:
                joined = np.concatenate(held)
                close(joined[: self.block])
                held, n = [joined[self.block :]], n - self.block
        if n:
            close(np.concatenate(held))
        return Written(files)

    def commit(self, messages):
        from pyarrow import fs

        store, path = _open(self.path)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        for f in [f for m in messages if m for f in m.files]:
            store.move(f"{path}/_temporary/{f}", f"{path}/{f}")
        self._clean(store, path)

    def abort(self, messages):
        self._clean(*_open(self.path))

    def _clean(self, store, path):
        from pyarrow import fs

        if store.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_temporary")


class BinaryLog(DataSource):
    """format("binlog"): a log or a folder of them, read by ranges of records and written by a commit; option block: records a range or file.

    Any store that pyarrow opens and all executors reach. Written in the order of the rows of each partition, files named in order of partitions.
    """

    @classmethod
    def name(cls):
        return "binlog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], int(self.options.get("block", 1 << 20)))

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], int(self.options.get("block", 1 << 20)), overwrite)


def scan(spark: SparkSession, paths: str) -> DataFrame:
    """Logs through Spark's own file reader, for any store: path, event_idx within the file and the records' columns.

    A file is one row while it is decoded (a recording hour), so logs are meant to be cut by hour or day.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def decode(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = content.as_buffer()
                check(bytes(data[: HEADER_SIZE]), len(data))
                rows = np.frombuffer(data, EVENT, offset=HEADER_SIZE)
                for at in range(0, len(rows), 65536):
                    r = rows[at : at + 65536]
                    own = _batch(r)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(r)), pa.array(np.arange(at, at + len(r))), *own.columns], ["path", "event_idx", *own.schema.names])

    return files.mapInArrow(decode, "path string, event_idx long, " + SCHEMA)


def write(events: DataFrame, path: str, block: int = 1 << 20) -> None:
    """events as a folder of logs in order of symbol_id, time and seq: sorted over all tasks, so that none holds an instrument or a day."""
    spark = events.sparkSession
    spark.dataSource.register(BinaryLog)
    order = ["symbol_id", "exch_ts_us", "seq"]
    rows = events.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", "))])
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.format("binlog").mode("overwrite").option("block", block).option("path", path).save()


def read(spark: SparkSession, path: str, block: int = 1 << 20) -> DataFrame:
    spark.dataSource.register(BinaryLog)
    return spark.read.format("binlog").option("block", block).load(path)
