"""Shared helpers: tables in the shared folder, and vectorised hashing of words inside tasks."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_GIVE_BACK = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []

#: ASCII white space of the text contracts: 0x20 and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir of the session, else the context's checkpoint folder.

    A temporary folder serves only where driver and executors are one process (tests); on a cluster without a shared
    folder this is an error, as other machines would not see what an executor writes.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = chosen.get() if chosen.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="microflow-shared-"))
        found = _own_dir[0]
    return found


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return


def drop(*frames: DataFrame | None) -> None:
    """Remove tables that `written` made and nothing reads any more."""
    for frame in frames:
        if path := getattr(frame, "_microflow_path", None):
            _delete(frame.sparkSession, path)


def free(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has, for a column of our own beside theirs."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str):
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there and a lost executor costs nothing.

    The shuffle files of the write are given back at its end, as nothing reads them again. `drop` removes the table
    before the driver's exit does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/microflow/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_GIVE_BACK, None)
    spark.conf.set(_GIVE_BACK, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_GIVE_BACK) if before is None else spark.conf.set(_GIVE_BACK, before)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._microflow_path = path
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """rows with `out`, their place from 0 on within the group, in ascending order with nulls first.

    Rows are sorted over all tasks; what a task holds of a group is counted, and the counts of the tasks before are
    added. So no task holds a group, and a hot one is spread like all others.
    """
    part, pos, first, before, n = (free(x, rows) for x in ("part", "pos", "first", "before", "n"))
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    laid = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(part, F.spark_partition_id()).withColumn(pos, F.monotonically_increasing_id())
    laid = written(laid, "numbered")
    runs = laid.groupBy(*group, part).agg(F.min(pos).alias(first), F.count("*").alias(n))
    past = Window.partitionBy(*(group or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(g).alias(f"{g}__") for g in group], F.col(part).alias("part__"), first, F.coalesce(F.sum(n).over(past), F.lit(0)).alias(before))
    on = F.col(part) == F.col("part__")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"{g}__"))
    return laid.join(runs, on).select(*rows.columns, (F.col(pos) - F.col(first) + F.col(before)).alias(out))


# --- hashing of byte strings in numpy -------------------------------------------------------------------------------

_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_TABLE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n at least."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _B), ("down", _BINV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with hash(data[i:j]) = (P[j] - P[i]) * base**-i... up to one factor; see `span_hash`."""
    _, down = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * down[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand (lengths are mixed in)."""
    up, _ = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * up[start] + (end - start).astype(np.uint64) * _MIX2)


_LONG_WORD = 256
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand.

    Eight bytes at a time go through a scrambling that depends on all bytes before; words over _LONG_WORD bytes by BLAKE2.
    """
    size = end - start
    out = mix64(size.astype(np.uint64) * _MIX2 + _B)
    if not len(size):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))
    some, at, left = np.flatnonzero((size > 0) & (size <= _LONG_WORD)), start, size
    while len(some):
        piece = eights[at[some]] & _MASKS[np.minimum(left[some], 8)]
        out[some] = mix64((out[some] ^ piece) * _B)
        at, left = at + 8, left - 8
        some = some[left[some] > 0]
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def word_hashes(texts: list[bytes], chunk: int = 1 << 21):
    """For runs of documents of about `chunk` bytes: (first, last, document of each word, its hash, start, end).

    Words are runs of bytes other than ASCII white space, A-Z lowered. One long document is a run of its own.
    """
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size == 0 or size + len(texts[to]) <= chunk):
            size += len(texts[to]) + 1
            to += 1
        joined = b"\n".join(texts[at:to]).translate(_LOWER)
        data = np.frombuffer(joined, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _IS_WORD[data]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter((len(t) + 1 for t in texts[at:to]), np.int64, to - at)
        ends = np.cumsum(lengths)
        doc = np.searchsorted(ends, start, side="right")
        yield at, to, doc, word_hash(data, start, end), start, end
        at = to


def as_bytes(column) -> list[bytes]:
    """An Arrow string or binary column as bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
