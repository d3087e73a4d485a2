from pyspark.sql import functions as F

from microflow import queries
from microflow.operators import sync
from microflow.sources.adapters import market_events
from microflow.streaming import streams

SF = "/root/testdata/sf0.001"


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_gaps_batch_and_stream_agree(spark, tmp_path):
    rows = queries.messages(spark, SF).cache()
    n = rows.agg(F.max("ln")).first()[0]
    for i, (a, z) in enumerate([(0, n // 3), (n // 3, n // 2), (n // 2, n)]):  # three arrivals
        rows.where(f"ln > {a} and ln <= {z}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = run(spark, streams.gaps(stream), "gaps")
    expect = sync.gaps(sync.synchronised(rows)).select("symbol_id", "ln", "expected", "got")
    assert got.count() == expect.count() > 0 and got.exceptAll(expect).count() == 0


def test_windows(spark, tmp_path):
    md = market_events(spark, SF).withColumn("ts", F.timestamp_micros("ts_us"))
    md.write.parquet(str(tmp_path / "md"))
    stream = spark.readStream.schema(md.schema).parquet(str(tmp_path / "md"))
    got = run(spark, streams.counters(stream), "counters", "complete")
    assert got.agg(F.sum("n")).first()[0] == md.count()
    batch = queries.QUERIES["event_counters"](spark, SF).select("symbol_id", (F.col("minute5") * 300_000_000).alias("start_us"), "n", "n_trades", "volume")
    assert got.exceptAll(batch).count() == 0
    flow = run(spark, streams.sliding_flow(stream), "flow", "complete")
    assert flow.agg(F.sum("volume")).first()[0] == 6 * md.where("type = 1").agg(F.sum("qty")).first()[0]


def test_recordings_stream(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"t":1,"c":"depth","s":"X","d":{"E":1}}\nbroken\n')
    got = run(spark, streams.recordings(spark, str(tmp_path)), "lines")
    assert sorted(r.malformed for r in got.collect()) == [False, True]


def test_gaps_go_on_after_a_restart(spark, tmp_path):
    rows = queries.messages(spark, SF).cache()
    n = rows.agg(F.max("ln")).first()[0]
    for i, (a, z) in enumerate([(0, n // 2), (n // 2, n)]):
        rows.where(f"ln > {a} and ln <= {z}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = streams.gaps(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    expect = sync.gaps(sync.synchronised(rows)).select("symbol_id", "ln", "expected", "got")
    assert got.count() == expect.count() > 0 and got.exceptAll(expect).count() == 0
