"""Exact deduplication by an extendible-hash index kept as tables in the shared folder."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microflow.llm.common import SPACE, col, drop, table, written

#: Directories up to this many cells are broadcast; larger ones are joined by shuffle.
BROADCAST_CELLS = 1 << 16
_TOP = 9223372036854775807
_STEP = "20000000000000000000"


def normalised(text):
    """The text without ASCII white space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def _prefix(key, depth: int):
    """The first `depth` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(cell, bucket) for every cell of the directory, and the directory's depth.

    The directory is doubled as long as a cell is overfull with several keys, whose next bits part them; a key of its
    own can't be split and its chain stays in one bucket. A bucket has the smallest local depth at which it isn't
    overfull, so cells of a thin region share one bucket. keys: one row per entry.
    """
    n = keys.count()
    depth = min(64, max(1, math.ceil(math.log2(max(2, n / capacity)))))
    while True:
        cells = keys.groupBy(_prefix(F.col("key"), depth).alias("cell")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        if depth == 64 or not cells.where((F.col("n") > capacity) & (F.col("lo") < F.col("hi"))).limit(1).count():
            break
        depth += 1
    nodes = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")).withColumn("node", F.expr(f"shiftrightunsigned(cell, {depth} - d)"))
    full = nodes.groupBy("d", "node").agg(F.sum("n").alias("full"))
    local = nodes.join(full, ["d", "node"]).where((F.col("full") <= capacity) | (F.col("d") == depth)).groupBy("cell").agg(F.min("d").alias("d"))
    # a bucket's name: its bits with a leading one, so that different depths never share a name
    return local.select("cell", F.expr(f"shiftleft(1L, d) + shiftrightunsigned(cell, {depth} - d)").alias("bucket")), depth


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 200_000) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are equal without ASCII white space. Of each group the longest original text (code points),
    then the smallest id stays. Null text counts as empty; a null id sorts last; rows that repeat an id are kept or
    dropped together. Other columns are ignored, whatever their names. An empty table gives an empty result.

    Tasks first fold copies by (64-bit key, SHA-256, bytes), so a hot group leaves a row per task and its bytes are
    compared in the grouping; this is the only time that texts are shuffled. The folded entries are inserted into the
    index: the directory gives each its bucket, an owner task takes a range of buckets and numbers the chain of entries
    that share a key. Documents look their entry up by bucket, key and SHA-256. Should two texts ever share both, the
    lookup compares the bytes.
    """
    base = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("t")).select("id", F.length("t").alias("n"), normalised(F.col("t")).alias("norm"))
    keyed = base.select("id", "n", "norm", F.xxhash64("norm").alias("key"), F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"))
    # larger is better: code points first, then the smaller id; null ids are worst
    rank = F.expr(f"cast(n as decimal(38,0)) * {_STEP} + coalesce({_TOP} - cast(id as decimal(38,0)) + 1, 0)").cast("decimal(38,0)")
    folded = keyed.groupBy("key", "sha", "norm").agg(F.count("*").alias("size"), F.max(rank).alias("best"))
    entries = written(folded.select("key", "sha", "size", "best"), "dedup-entries")
    cells, depth = directory(entries.select("key"), capacity)
    cells = written(cells, "dedup-directory")

    def owned(rows: DataFrame) -> DataFrame:
        return rows.withColumn("cell", _prefix(F.col("key"), depth)).join(F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells, "cell").drop("cell")

    own = Window.partitionBy("bucket", "key")
    index = owned(entries).repartitionByRange(F.col("bucket")).withColumn("chain", F.row_number().over(own.orderBy("sha", "best")))
    best = F.expr(f"cast({_TOP} - (best % {_STEP}) + 1 as decimal(38,0))")
    index = index.select("bucket", "key", "sha", "chain", "size", "best", F.when(F.expr(f"best % {_STEP} > 0"), best.cast("long")).alias("keep_id"))
    index = written(index, "dedup-index")
    drop(entries)
    if not index.where("chain > 1").groupBy("bucket", "key", "sha").count().where("count > 1").limit(1).count():
        found = owned(keyed.select("id", "key", "sha")).join(index, ["bucket", "key", "sha"])
    else:
        same = index.join(folded.select("key", "sha", "size", "best", "norm"), ["key", "sha", "size", "best"])
        found = owned(keyed.select("id", "key", "sha", "norm")).join(same, ["bucket", "key", "sha", "norm"])
    return found.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept, text_sha256
FROM n"""
