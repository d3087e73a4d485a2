"""Keyed state, timers and sinks of streams, held against their batch twins over random triggers and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from microflow.operators import book, rolling, sync
from microflow.streaming import books, order, sinks

from .test_pieces import MD, as_events, broken_snapshots, plain_book


@pytest.fixture(autouse=True)
def state(spark):
    sinks.with_state(spark)


def feed(spark, path, pieces, schema, build, name="out"):
    """Each piece of rows as a trigger, each in a query of its own that goes on from the checkpoint."""
    for i, rows in enumerate(pieces):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{i:03d}")
        stream = build(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/in"))
        sinks.exactly_once(stream, f"{path}/{name}", f"{path}/state").awaitTermination()
    return sinks.committed(spark, f"{path}/{name}", stream.schema)


def cut(rows, rng, n):
    at = sorted(rng.sample(range(1, len(rows)), n - 1))
    return [rows[a:z] for a, z in zip([0, *at], [*at, len(rows)])]


def test_live_book_over_restarts(spark, tmp_path):
    rng = random.Random(11)
    plain, rows = {}, []
    for symbol in (1, 2):
        own = broken_snapshots(symbol, 150)
        plain[symbol] = plain_book(own)
        rows += [(symbol, i, i * 1000, k, s, p, q, 0) for i, (k, s, p, q) in enumerate(own)]
    rows.sort(key=lambda r: r[1])
    got = feed(spark, str(tmp_path), cut(rows, rng, 3), MD, books.touch).collect()
    assert len(got) == 300
    for r in got:
        assert (r.best_bid, r.best_ask, r.bid_qty, r.ask_qty) == plain[r.symbol_id][r.idx]
    md = as_events(spark, broken_snapshots(1, 150))
    assert {(r.idx, r.mid_x2) for r in got if r.symbol_id == 1} == {(r.idx, r.mid_x2) for r in book.bbo(md).collect()}


def test_timers_of_shuffled_triggers(spark, tmp_path):
    rng = random.Random(12)
    rows = [(s, 5_000_123 + s * 777 + rng.randrange(40_000_000)) for s in (1, 2, 3) for _ in range(60)]
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(8_000_000))
    pieces = [*cut(late, rng, 3), [(9, 10**9)], [(9, 10**9 + 1)]]  # another instrument moves the watermark on
    got = feed(spark, str(tmp_path), pieces, "symbol_id long, ts_us long", lambda s: books.ticks(s, 700_000, "10 seconds")).where("symbol_id < 9")
    want = sync.timers(spark.createDataFrame(rows, "symbol_id long, ts_us long"), 700_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_go_to_a_table_of_their_own(spark, tmp_path):
    rng = random.Random(13)
    rows = [(s, rng.randrange(10_000), n, rng.choice([0, 1]), rng.choice([0, 1, None]), 100, n) for s in (1, 2) for n in range(200)]
    pieces = cut(sorted(rows, key=lambda r: r[1] + rng.randrange(2500)), rng, 4)
    beats = [(s, 10**9, None, None, None, None, None) for s in (1, 2)]
    schema = "symbol_id long, ts_us long, seq long, type long, side long, price long, qty long"
    got = feed(spark, str(tmp_path), [*pieces, beats], schema, lambda s: order.ordered(s, 1000)).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(rows, key=str)  # kept and late are the input
    top, late = {}, set()
    for piece in pieces:
        late |= {(r[0], r[2]) for r in piece if r[0] in top and r[1] < top[r[0]] - 1000}
        for r in piece:
            top[r[0]] = max(top.get(r[0], 0), r[1])
    assert {(r.symbol_id, r.seq) for r in got if r.late} == late and 0 < len(late) < 200
    for s in (1, 2):
        kept = sorted((r for r in got if r.symbol_id == s and not r.late), key=lambda r: r.idx)
        assert [r.idx for r in kept] == list(range(len(kept)))
        assert [(r.ts_us, r.type != 1, r.seq) for r in kept] == sorted((r.ts_us, r.type != 1, r.seq) for r in kept)


def test_live_volatility(spark, tmp_path):
    rng = random.Random(14)
    ts, rows = 86_400_000_000 - 30_000_000, []
    for idx in range(400):
        ts += rng.randrange(400_000)
        rows.append((1 + idx % 2, ts, idx, 20_000 + rng.randrange(8)))
    schema = "symbol_id long, ts_us long, idx long, mid_x2 long"
    got = feed(spark, str(tmp_path), cut(rows, rng, 3), schema, lambda s: order.volatility(s, 1_000_000, 5_000_000))
    obs = spark.createDataFrame(rows, schema).withColumn("day", F.floor(F.col("ts_us") / 86_400_000_000).cast("long"))
    want = rolling.sigma(rolling.spaced(obs, 1_000_000), 5_000_000)
    show = lambda df: sorted((r.symbol_id, r.idx, r.n, round(r.sigma, 9)) for r in df.select("symbol_id", "idx", "n", "sigma").collect())
    assert show(got) == show(want)


@pytest.mark.parametrize("crash", ["half written", "before its entry", "after its entry"])
def test_sink_holds_each_row_once(spark, tmp_path, monkeypatch, crash):
    path, schema = str(tmp_path), "n long"
    for i in range(2):
        spark.range(i * 100, i * 100 + 100).selectExpr("id as n").coalesce(1).write.parquet(f"{path}/in/{i}")
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{path}/in").withColumn("late", F.col("n") % 7 == 0)
    real = sinks.log

    def fails(spark, at, batch):
        if batch == 1:
            if crash == "half written":
                spark.range(5).selectExpr("id as n").write.mode("overwrite").parquet(f"{at}/sink_batch=1")
            if crash == "after its entry":
                real(spark, at, batch)
            raise RuntimeError("killed")
        real(spark, at, batch)

    monkeypatch.setattr(sinks, "log", fails)
    with pytest.raises(Exception):
        sinks.exactly_once(read(), f"{path}/out", f"{path}/state", ["late"]).awaitTermination()
    monkeypatch.undo()
    if crash != "after its entry":
        assert sinks.committed(spark, f"{path}/out", schema).count() == 100
    sinks.exactly_once(read(), f"{path}/out", f"{path}/state", ["late"]).awaitTermination()
    got = sinks.committed(spark, f"{path}/out", "n long, late boolean")
    assert sorted(r.n for r in got.collect()) == list(range(200)) and got.where("late").count() == 29
