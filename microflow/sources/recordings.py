"""Recordings as files: ordered lines, health of a folder, and fixed-format CSV output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microflow.functions.grid import format_double
from microflow.operators.report import missing_hours


def ordered_lines(spark: SparkSession, paths: str | list[str], stream: str = "") -> DataFrame:
    """(file, ln, stream, arrival, value): lines of text files with their number in the file, and in the stream that it is part of.

    Files of any size are read by ranges of bytes (gzipped ones as a whole, but line by line); a first pass counts the lines
    of each range, and the counts of the ranges before give a line its number. Blank lines keep their number, CR before LF goes. stream: pattern on
    the path whose group 1 names a file's stream, one for all files if empty; a stream's files follow each other by name.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    name = F.regexp_extract("file", stream, 1) if stream else F.lit("")
    # a row per range of bytes
    blocks = lines.groupBy("file", "block").agg(F.min("pos").alias("first"), F.count("*").alias("n")).withColumn("stream", name)
    past = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumns({"in_file": past("file"), "in_stream": past("stream")}).drop("n")
    here = F.col("pos") - F.col("first")
    return lines.join(blocks, ["file", "block"]).select("file", (here + F.col("in_file")).alias("ln"), "stream", (here + F.col("in_stream")).alias("arrival"), F.regexp_replace("value", "\r$", "").alias("value"))


def write_lines(lines: DataFrame, folder: str, by: list[str], gzip: bool = False) -> None:
    """lines (ln, value and the columns of `by`) as text files in folders by=..., each in order of ln and by one task."""
    out = lines.repartition(*by).sortWithinPartitions(*by, "ln").select(*by, "value").write.partitionBy(*by).option("lineSep", "\n")
    (out.option("compression", "gzip") if gzip else out).text(folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, modified, symbol, hour): the files of a recording folder SYMBOL/YYYY-MM-DDTHH..., without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    stamp = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2}T\d{2})[^/]*$", 1)
    return found.withColumn("symbol", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn("hour", F.when(stamp != "", F.to_timestamp(F.concat(stamp, F.lit(":00:00")))))


def health(listing: DataFrame, tiny: int = 1024) -> DataFrame:
    """Per symbol: hours present, hours missing in between, tiny files, bytes, and the newest file's time."""
    dated = listing.where("hour is not null").withColumn("symbol_id", F.col("symbol")).withColumn("n", F.floor(F.unix_seconds("hour") / 3600))
    gone = missing_hours(dated.select("symbol_id", F.col("n").alias("hour"))).groupBy("symbol_id").agg(F.count("*").alias("hours_missing"))
    out = dated.groupBy("symbol_id").agg(F.count_distinct("n").alias("hours"), F.count_if(F.col("bytes") < tiny).alias("tiny_files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("newest"))
    return out.join(gone, "symbol_id", "left").withColumn("hours_missing", F.coalesce("hours_missing", F.lit(0))).withColumnRenamed("symbol_id", "symbol")


def runway_days(listing: DataFrame, free_bytes: int) -> DataFrame:
    """How many days of recording still fit: free bytes over mean bytes per day."""
    day = F.to_date("hour")
    return listing.where("hour is not null").agg((F.lit(float(free_bytes)) / (F.sum("bytes") / F.count_distinct(day))).alias("days"))


def stale(listing: DataFrame, now, seconds: int = 600) -> DataFrame:
    """Symbols whose newest file is older than `seconds` at `now` (a timestamp column)."""
    return listing.groupBy("symbol").agg(F.max("modified").alias("newest")).where(F.unix_seconds(now) - F.unix_seconds("newest") > seconds)


def as_text(df: DataFrame, digits: int = 10) -> DataFrame:
    """Columns as the CSV contract writes them: doubles with fixed digits, booleans as 1 and 0."""
    show = {"double": lambda c: format_double(F.col(c), digits), "boolean": lambda c: F.col(c).cast("int").cast("string")}
    return df.select(*[show.get(t, lambda c: F.col(c).cast("string"))(c).alias(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, digits: int = 10) -> None:
    as_text(df, digits).write.option("header", True).option("emptyValue", "").csv(path)


def read_runs(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """All CSV files of one name pattern below a folder as one table, with the columns of the schema.

    Empty files, files without the schema's header and compressed ones that break off are skipped, or give what can be read of them.
    """
    kinds = [(f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], schema).schema.fields]
    text = ", ".join(f"`{n}` string" for n, _ in kinds)
    rows = spark.read.schema(text).option("header", False).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("ignoreCorruptFiles", True).csv(folder).withColumn("_file", F.col("_metadata.file_path"))
    head = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(n) for n, _ in kinds])
    whole = rows.where(head).select("_file").distinct()
    return rows.where(~head).join(whole, "_file", "left_semi").select(*[F.col(n).try_cast(t).alias(n) for n, t in kinds])
