import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from microflow.functions import decode, grid, quotes
from microflow.operators import book, calibrate, ledger, markout, queue, report, rolling, sync
from microflow.sources import binlog, recordings

MD = "symbol_id long, idx long, ts_us long, seq long, type int, side int, price long, qty long"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_grid(spark):
    rows = [("99999.99", 9999999), ("7403.89", 740389), ("0.005", 1), ("-0.005", -1), ("1e3", None), ("abc", None), ("3", 300), ("3.", 300)]
    df = spark.createDataFrame(rows, "s string, e long").withColumn("got", grid.parse_fixed(F.col("s"), 2))
    assert all(r.got == r.e for r in df.collect())
    assert tuple(one(spark, grid.to_grid(F.lit("0.5"), 0.001), grid.to_grid(F.lit(1e9), 0.001), grid.to_grid(F.lit(-2.5), 1.0))) == (500, None, -3)
    assert grid.cash_per_tick_lot(0.01, 0.001) == 1000 and grid.cash_per_tick_lot(0.01, 0.00001) == 10
    for tick, lot in ((0.01, 1e-9), (0, 0.001), (0.01, -1)):
        with pytest.raises(ValueError):
            grid.cash_per_tick_lot(tick, lot)
    fees = [(20_000_000_000, 0, 0), (20_000_000_000, 20, 4_000_000), (20_000_000_000, 100, 20_000_000), (20_000_000_000, -5, -1_000_000), (50_000, 1, 1), (50_000, -1, -1)]
    df = spark.createDataFrame(fees, "n long, t long, e long").withColumn("got", grid.fee(F.col("n"), F.col("t")))
    assert all(r.got == r.e for r in df.collect())
    with pytest.raises(ValueError):
        grid.fee_to_tenths(0.25)


def test_dates_and_formats(spark):
    days = [(0, "1970-01-01"), (86399, "1970-01-01"), (86400, "1970-01-02"), (1785283200, "2026-07-29"), (1709164800, "2024-02-29")]
    for s, d in days:
        assert one(spark, grid.utc_date(F.lit(s * 1_000_000)))[0] == d
    assert one(spark, grid.utc_day(F.lit(-500_000)))[0] == 0
    shown = [(1.5, 4, "1.5000"), (-1e-9, 6, "0.000000"), (1 / 3, 10, "0.3333333333"), (math.inf, 4, "inf"), (math.nan, 4, "nan")]
    for x, n, e in shown:
        assert one(spark, grid.format_double(F.lit(x), n))[0] == e
    assert one(spark, grid.sanitise(F.lit("a.b-c d/e")))[0] == "a_b_c_d_e"


def messages(spark, rows):
    out = [(0, i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, "symbol_id long, ln long, kind string, first_id long, final_id long, prev_id long")


def s(n):
    return ("snapshot", None, n, None)


def d(a, b, prev=None):
    return ("depth", a, b, prev)


@pytest.mark.parametrize(
    "rows,expect",
    [
        ([d(10, 12)], {"n_presync": 1, "n_kept": 0}),
        ([s(100), d(90, 95)], {"n_stale": 1, "n_gaps": 0}),
        ([s(100), d(99, 105)], {"n_gaps": 0, "n_dirty": 0}),
        ([s(100), d(150, 160)], {"n_gaps": 1, "n_dirty": 1}),
        ([s(100), d(101, 105), d(106, 110), d(200, 205)], {"n_gaps": 1, "n_dirty": 1, "n_accepted": 3}),
        ([s(100), d(101, 105, 100), d(106, 110, 105), d(111, 115, 999)], {"n_gaps": 1}),
        ([s(100), d(500, 505), s(600)], {"n_resyncs": 1, "n_dirty": 1}),
    ],
)
def test_sync(spark, rows, expect):
    rows_ = sync.synchronised(messages(spark, rows))
    got = sync.statistics(rows_).first().asDict()
    assert {k: got[k] for k in expect} == expect
    if rows[-1] == d(200, 205):
        gap = sync.gaps(rows_).first()
        assert (gap.expected, gap.got) == (111, 200)
    if rows[-1] == d(111, 115, 999):
        assert "futures" in sync.gaps(rows_).first().reason


def events(spark, rows):
    """rows: (ts, type, side, price, qty) of one instrument, in order."""
    return spark.createDataFrame([(0, i, r[0], i, *r[1:]) for i, r in enumerate(rows)], MD)


def test_book(spark):
    opening = [(0, 0, 0, 10000, 50), (0, 0, 0, 9999, 80), (0, 0, 0, 9998, 120), (0, 0, 1, 10001, 40), (0, 0, 1, 10002, 90), (0, 0, 1, 10003, 150), (1, 1, 1, 10000, 5), (2, 0, 0, 10000, 0)]
    md = events(spark, opening)
    at = md.where("idx = 5")
    for n, bid in ((0, 50), (1, 130), (2, 250), (50, 250)):
        assert book.depth_within(md, at, n).first().bid_depth == bid
    rows = {r.idx: r for r in book.bbo(md).collect()}
    assert rows[0].mid_x2 is None and rows[5].mid_x2 == rows[6].mid_x2 == 20001 and rows[7].best_bid == 9999
    assert [r.n for r in book.level_counts(md).where("side = 0").orderBy("idx").collect()][:4] == [1, 2, 3, 2]
    assert book.violations(book.bbo(events(spark, [(0, 0, 0, 105, 1), (0, 0, 1, 100, 1)]))).count() == 1
    w = one(spark, book.imbalance(F.lit(30), F.lit(10)), book.weighted_mid(F.lit(100), F.lit(102), F.lit(0.75)), book.imbalance(F.lit(None).cast("long"), F.lit(None).cast("long")))
    assert tuple(w) == (0.75, 101.5, 0.5)


def random_market(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < 0.3:
            side = rng.randint(0, 1)
            rows.append((i * 1000 + rng.randint(0, 900), 1, side, 10001 if side == 0 else 10000, rng.randint(1, 40)))
        else:
            side = rng.randint(0, 1)
            off = rng.randint(0, 4)
            rows.append((i * 1000 + rng.randint(0, 900), 0, side, 10000 - off if side == 0 else 10001 + off, rng.choice([0, rng.randint(1, 60)])))
    return rows


def test_book_against_dict(spark):
    rows = random_market(3, 700)
    got = {r.idx: r for r in book.bbo(events(spark, rows)).collect()}
    state = {0: {}, 1: {}}
    for i, (_, kind, side, price, qty) in enumerate(rows):
        if kind == 0:
            state[side].pop(price, None)
            if qty > 0:
                state[side][price] = qty
        b, a = max(state[0], default=None), min(state[1], default=None)
        assert (got[i].best_bid, got[i].best_ask, got[i].bid_qty, got[i].ask_qty) == (b, a, state[0].get(b), state[1].get(a))


def order(spark, ahead, qty=10):
    return spark.createDataFrame([("o", 0, -1, 0, 0, 10000, qty, ahead)], "order_id string, symbol_id long, idx long, ts_us long, side int, price long, qty long, ahead long")


def follow(spark, ahead, rows, model="PESS", horizon=3_600_000_000):
    return queue.follow(order(spark, ahead), events(spark, rows), model, horizon).first()


def test_queue(spark):
    r = follow(spark, 30, [(1, 1, 1, 10000, 35)])
    assert (r.filled, r.ahead_end) == (5, 0)
    r = follow(spark, 30, [(1, 0, 0, 10000, 50), (2, 1, 1, 10000, 50)])
    assert (r.filled, r.behind_end, r.first_fill_us) == (10, 10, 2)
    for model, expect in (("PESS", (30, 0)), ("OPT", (15, 15)), ("PROP", (20, 10))):
        r = follow(spark, 30, [(1, 0, 0, 10000, 45), (2, 0, 0, 10000, 30)], model)
        assert (r.ahead_end, r.behind_end, r.cancels) == (*expect, 15)
    r = follow(spark, 30, [(1, 0, 0, 10000, 40), (2, 0, 0, 10000, 15)])
    assert (r.ahead_end, r.behind_end) == (15, 0)
    r = follow(spark, 50, [(1, 0, 0, 10000, 65), (2, 1, 1, 10000, 20), (3, 0, 0, 10000, 45)])
    assert (r.ahead_end, r.behind_end, r.explained, r.cancels) == (30, 15, 20, 0)
    r = follow(spark, 60, [(1, 1, 1, 10000, 20), (10_000_000, 0, 0, 10000, 50)])
    assert (r.expired, r.cancels) == (20, 10)
    with pytest.raises(ValueError):
        follow(spark, 1, [(1, 1, 1, 10000, 1)], "BEST")


TRACE = [(120_000, 0, 0, 10000, 65), (300_000, 1, 1, 10000, 20), (305_000, 0, 0, 10000, 45), (420_000, 0, 0, 10000, 30), (600_000, 1, 1, 10000, 35), (650_000, 0, 0, 10000, 0), (3_000_000, 0, 0, 9998, 10)]


def test_worked_trace(spark):
    for model, fill in (("PESS", 5), ("OPT", 10), ("PROP", 10)):
        r = follow(spark, 50, TRACE, model, 3_600_000_000)
        assert r.filled == fill and r.first_fill_us == 600_000
    assert (r := follow(spark, 50, TRACE)).explained == 50 and r.cancels == 15 and r.expired == 0
    touch = queue.touch_fills(order(spark, 50), events(spark, TRACE), 3_600_000_000).collect()
    assert [(t.t_us, t.fill) for t in touch] == [(300_000, 10)]


def test_models_are_ordered(spark):
    md = events(spark, random_market(9, 900))
    orders = queue.placed(queue.probes(book.bbo(md), 20_000, [1, 2], 15), book.levels(md))
    filled = {m: queue.follow(orders, md, m, 200_000).agg(F.sum("filled")).first()[0] for m in queue.MODELS}
    touch = queue.touch_fills(orders, md, 200_000).agg(F.sum("fill")).first()[0]
    assert filled["PESS"] <= filled["PROP"] <= filled["OPT"] <= touch


def test_cross(spark):
    o = order(spark, 0)
    best = lambda ask: spark.createDataFrame([(0, 5, 7, 9999, ask)], "symbol_id long, idx long, ts_us long, best_bid long, best_ask long")
    assert queue.cross_fills(o, best(10000), 1000).first().cross_idx == 5
    assert queue.cross_fills(o, best(10001), 1000).count() == 0


def test_ledger(spark):
    rng = random.Random(2)
    fills, marks, mid = [], [], 20001
    for i in range(400):
        mid += rng.randint(-3, 3)
        (fills if rng.random() < 0.5 else marks).append((0, i * 1000, i, rng.randint(0, 1), 10000 + rng.randint(-3, 3), rng.randint(1, 9), mid, rng.random() < 0.8))
    f = spark.createDataFrame(fills, "symbol_id long, ts_us long, seq long, side int, price long, qty long, mid_x2 long, maker boolean")
    m = spark.createDataFrame([(r[0], r[1], r[2], r[6]) for r in marks], "symbol_id long, ts_us long, seq long, mid_x2 long")
    rows = ledger.running(f, m, 100_000)
    assert rows.count() == 400 and rows.where("residual_x2 <> 0").count() == 0
    buy = spark.createDataFrame([(0, 0, 0, 0, 10000, 10, 20000, True)], f.schema)
    last = ledger.running(buy, spark.createDataFrame([(0, 1, 1, 20020)], m.schema), 100_000, maker_tenths=0).orderBy(F.desc("seq")).first()
    assert last.inventory_x2 == 10 * 20 * 100_000 and last.equity_x2 == last.inventory_x2
    days = ledger.daily(rows.withColumn("ts_us", F.col("seq") * 3_600_000_000))
    assert days.count() > 10 and days.where("residual_x2 <> 0").count() == 0


def test_markouts(spark):
    marks = lambda *m: spark.createDataFrame([(0, int(t * 1e6), i, x) for i, (t, x) in enumerate(m)], "symbol_id long, ts_us long, idx long, mid_x2 long")
    fill = lambda side, px, qty, mid: spark.createDataFrame([(0, 1, 0, side, px, qty, mid)], "symbol_id long, fill_id long, ts_us long, side int, price long, qty long, mid_x2 long")
    r = markout.priced(markout.samples(fill(0, 10000, 5, 20001), marks((0, 20001), (1, 20000)), [1_000_000])).first()
    assert r.resolved and (r.edge_x2, r.adverse_x2, r.markout_x2) == (5, -5, 0)
    assert markout.samples(fill(0, 10000, 10, 20000), marks((0, 20000), (2, 20100)), [1_000_000]).first().mid_x2_at == 20000
    got = markout.samples(fill(0, 10000, 10, 20000), marks((0, 20000), (2, 19990)), [1_000_000, 60_000_000, 1_000_000]).orderBy("horizon_us").collect()
    assert [(g.resolved, g.mid_x2_at) for g in got] == [(True, 20000), (False, None)]
    tie = markout.samples(fill(0, 10000, 1, 20000), marks((0, 20000), (1, 20002), (1, 20004)), [1_000_000]).first()
    assert tie.mid_x2_at == 20002  # the first mark exactly then


def test_rolling(spark):
    obs = spark.createDataFrame([(0, 0, i * 1_000_000, i, 20000 + i % 2) for i in range(300)], "symbol_id long, day long, ts_us long, idx long, mid_x2 long")
    assert rolling.sigma(rolling.spaced(obs, 1_000_000), 300_000_000).orderBy(F.desc("idx")).first().sigma == pytest.approx(0.5)
    dense = spark.createDataFrame([(0, 0, i * 1000, i, i) for i in range(99)] + [(0, 0, 1_000_000, 99, 5)], obs.schema)
    assert [r.idx for r in rolling.spaced(dense, 1_000_000).collect()] == [0, 99]
    t = spark.createDataFrame([(0, 0, 0, 0, 100), (0, 1, 100_000, 1, 100), (0, 2, 10_000_000, 1, 7)], "symbol_id long, idx long, ts_us long, side int, qty long")
    assert [r.imbalance for r in rolling.flow(t, 2_000_000).orderBy("idx").collect()] == [1.0, 0.0, -1.0]
    assert [r.pulled for r in rolling.pulls(rolling.flow(t, 2_000_000), 0.6, 50_000).orderBy("idx").collect()] == [1, None, 0]


def test_quotes(spark):
    lit = F.lit
    r = one(spark, quotes.inventory_premium(lit(1e-5), lit(8.0), lit(60.0)), quotes.markup(lit(1e-5), lit(0.035)))
    assert r[0] == pytest.approx(0.0384) and r[1] == pytest.approx(1 / 0.035, rel=2e-2) or r[1] == pytest.approx(28.57, rel=1e-2)
    z = one(spark, quotes.stationary_quotes(lit(100.0), lit(0.0), lit(1e-3), lit(0.1), lit(1.0), lit(2.0)).alias("z")).z
    assert z.bid_delta == pytest.approx(z.ask_delta)
    assert one(spark, quotes.reservation_quotes(lit(1.0), lit(0.0), lit(0.0), lit(1.0), lit(1.0), lit(1.0)))[0] is None
    bid, ask = quotes.passive(lit(105), lit(95), lit(100), lit(101))
    assert tuple(one(spark, bid, ask)) == (100, 101)
    assert one(spark, quotes.has_edge(lit(10000), lit(10002.0), lit(20), lit(0)), quotes.has_edge(lit(10000), lit(10002.5), lit(20), lit(0)))[:] == (False, True)


def test_calibration(spark):
    points = spark.createDataFrame([(0, i, 2.0 * math.exp(-0.3 * i)) for i in range(1, 9)] + [(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.5)], "symbol_id long, delta int, rate double")
    got = {r.symbol_id: r for r in calibrate.fit(points, "symbol_id").collect()}
    assert got[0].k == pytest.approx(0.3) and got[0].a == pytest.approx(2.0) and got[0].r2 == pytest.approx(1.0) and got[0].ok
    assert got[1].r2 == 0.0 and not got[2].ok


def test_reports(spark):
    bins = {q: one(spark, report.fraction_bin(F.lit(q)))[0] for q in (0.0, 0.1, 0.1000001, 0.7, 1.0, 1.5)}
    assert bins == {0.0: 0, 0.1: 0, 0.1000001: 1, 0.7: 6, 1.0: 9, 1.5: None}
    curve = spark.createDataFrame([(0, 0.0, 10.0), (0, 1.0, 5.0), (0, 2.0, -5.0), (1, 0.0, 1.0), (1, 1.0, 1.0)], "symbol_id long, fee double, pnl double")
    got = {r.symbol_id: r.break_even for r in report.break_even(curve, "symbol_id").collect()}
    assert got[0] == 1.5 and math.isnan(got[1])
    days = spark.createDataFrame([(0, "d%02d" % i, float(i % 5)) for i in range(30)] + [(1, "d00", 2.0)], "symbol_id long, date string, pnl double")
    rows = {r.symbol_id: r for r in report.bootstrap(days, ["symbol_id"], "date", "pnl", resamples=200).collect()}
    assert rows[0].low < rows[0].estimate == 2.0 < rows[0].high and rows[1].low == rows[1].high == 2.0
    ratio = {r.symbol_id: r.sharpe for r in report.sharpe(days, "pnl", "symbol_id").collect()}
    assert ratio[0] > 0 and math.isnan(ratio[1])
    hours = spark.createDataFrame([(0, 1), (0, 4), (1, 7)], "symbol_id long, hour long")
    assert sorted((r.symbol_id, r.hour) for r in report.missing_hours(hours).collect()) == [(0, 2), (0, 3)]
    assert report.grid(spark, a=[1, 2], b=["x"], c=[1.0, 2.0, 3.0]).count() == 6


def test_resampling_runs():
    rng = np.random.default_rng(1)
    runs = [np.mean(np.diff(report.stationary_indices(500, 3.0, rng, 20), axis=1) % 500 == 1)]
    assert 0.6 < np.mean(runs) < 0.73  # two of three steps follow on


LINES = [
    '{"t":1722240000123456,"c":"aggTrade","s":"BTCUSDT","d":{"T":1000,"a":42,"p":"100.00","q":"0.5","m":true}}',
    '{"t":2,"c":"aggTrade","s":"BTCUSDT","d":{"stream":"x","data":{"T":1000,"a":43,"p":"100.00","q":"0.5","m":false}}}\r',
    '{"t":3,"c":"trade","s":"BTCUSDT","d":{"T":1000,"a":44,"p":"100.00","q":"0.5"}}',
    '{"t":4,"c":"depth","s":"BTCUSDT","d":{"E":1568014460893,"U":1,"u":9,"b":[["7403.89","0.002"],["7403.90","0.000"]],"a":[["7405.96","3.340"]]}}',
    '{"t":5,"c":"depthUpdate","s":"BTCUSDT","d":{"E":2000,"T":1500,"U":1,"u":2,"pu":0,"b":[],"a":[]}}',
    '{"t":555,"c":"snapshot","s":"BTCUSDT","d":{"lastUpdateId":1027024,"bids":[["4.00","1"],["3.99","2"]],"asks":[["4.01","3"]]}}',
    '{"t":6,"c":"bookTicker","s":"BTCUSDT","d":{"u":400900217,"b":"100.00","B":"31.21","a":"100.02","A":"40.66"}}',
    '{"t":7,"c":"depth","s":"BTC',
    "",
]


def test_decode(spark):
    rows = decode.envelopes(spark.createDataFrame([(x,) for x in LINES], "value string"))
    assert rows.count() == 8 and rows.where("malformed").count() == 1
    t = {r.trade_id: r for r in decode.trades(rows, 0.01, 0.001).collect()}
    assert (t[42].side, t[42].price, t[42].qty, t[42].ts_us) == (1, 10000, 500, 1_000_000) and t[43].side == 0 and t[44].malformed
    u = decode.depth_updates(rows)
    levels = decode.level_events(u, 0.01, 0.001).orderBy("t", "pos").collect()
    assert [(r.side, r.price, r.qty) for r in levels] == [(0, 740389, 2), (0, 740390, 0), (1, 740596, 3340)] and levels[0].ts_us == 1568014460893000
    assert u.where("t = 5").first().ts_us == 1_500_000 and u.where("t = 5").first().prev_id == 0
    snap = decode.snapshots(rows, 0.01, 0.001).orderBy("pos").collect()
    assert [r.kind for r in snap] == ["begin", "level", "level", "level", "end"] and {r.ts_us for r in snap} == {555}
    tick = decode.tickers(rows, 0.01, 0.001).first()
    assert (tick.best_bid, tick.best_ask) == (10000, 10002)


def test_binary_log(spark, tmp_path):
    rows = np.zeros(1000, binlog.EVENT)
    rows["exch_ts_us"], rows["seq"], rows["price_ticks"], rows["side"] = np.arange(1000) * 10, np.arange(1000), 10000 - np.arange(1000) % 7, np.arange(1000) % 2
    path = tmp_path / "x.bin"
    path.write_bytes(binlog.encode(rows))
    spark.dataSource.register(binlog.BinaryLog)
    df = spark.read.format("binlog").option("block", 300).load(str(path))
    assert df.rdd.getNumPartitions() == 4 and df.count() == 1000 and df.agg(F.sum("seq")).first()[0] == 499500
    again = binlog.scan(spark, str(path))
    assert again.drop("path", "event_idx").exceptAll(df).count() == 0
    for block in (100, 1 << 20):  # a log of several files, and back
        binlog.write(df, str(tmp_path / "logs"), block)
        assert not (tmp_path / "logs" / "_temporary").exists() and len(list((tmp_path / "logs").iterdir())) >= 1000 // block
        back = binlog.read(spark, str(tmp_path / "logs"), 70)
        assert back.count() == 1000 and back.exceptAll(df).count() == 0
    for bad in (b"", path.read_bytes()[:-1], b"XXXX" + path.read_bytes()[4:]):
        with pytest.raises(ValueError):
            binlog.check(bad[:32], len(bad))


def test_recordings(spark, tmp_path):
    for hour, size in (("2026-01-01T00", 2000), ("2026-01-01T03", 10)):
        (tmp_path / "BTC").mkdir(exist_ok=True)
        (tmp_path / "BTC" / f"{hour}.jsonl").write_text("x" * size)
    listing = recordings.files(spark, str(tmp_path))
    r = recordings.health(listing).first()
    assert (r.symbol, r.hours, r.hours_missing, r.tiny_files, r.bytes) == ("BTC", 2, 2, 1, 2010)
    assert recordings.runway_days(listing, 20100).first().days == 10.0
    (tmp_path / "lines.txt").write_text("a\r\n\nb")
    got = recordings.ordered_lines(spark, str(tmp_path / "lines.txt")).orderBy("ln").collect()
    assert [(g.ln, g.value) for g in got] == [(0, "a"), (1, ""), (2, "b")]
    for d, n in (("s=1", 5000), ("s=2", 300)):  # files in many ranges of bytes
        (tmp_path / "big" / d).mkdir(parents=True)
        for part in range(2):
            (tmp_path / "big" / d / f"{part}.txt").write_text("".join(f"{d} {part} {i}\r\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    rows = recordings.ordered_lines(spark, str(tmp_path / "big"), r"/(s=\d)/").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    at = {"s=1": 5000, "s=2": 300}
    assert len(rows) == 10600 and all(r.value == f"{r.stream} {r.arrival // at[r.stream]} {r.ln}" and r.arrival % at[r.stream] == r.ln for r in rows)
    runs = tmp_path / "runs"
    runs.mkdir()
    for name, text in (("a", "x,y\n1,2.5\n"), ("b", ""), ("c", "other,head\n7,7\n"), ("d", "x,y\n"), ("e", "x,y\n3,\n")):
        (runs / f"{name}.csv").write_text(text)
    (runs / "f.csv.gz").write_bytes(b"not gzip")
    assert sorted(map(tuple, recordings.read_runs(spark, str(runs), "*.csv*", "x long, y double").collect()), key=str) == [(1, 2.5), (3, None)]
    df = spark.createDataFrame([(1, -0.0, True, "x,y")], "a long, b double, c boolean, d string").coalesce(1)
    recordings.write_csv(df, str(tmp_path / "run" / "fills"))
    text = "".join(p.read_text() for p in (tmp_path / "run" / "fills").glob("*.csv"))
    assert text == 'a,b,c,d\n1,0.0000000000,1,"x,y"\n'


def test_config(spark, tmp_path):
    from microflow.functions import config

    run = config.Run(strategy="S0_touch", queue="optimistic", maker_fee_bp=-0.5)
    assert run.fill_model == "TOUCH" and run.queue == "OPT" and run.row()["maker_tenths"] == -5 and run.run_id == "S0_touch_OPT__0_5_50_0_1"
    for bad in ({"strategy": "S9"}, {"queue": "best"}, {"gamma": 0}, {"horizons_s": (2.0, 1.0)}, {"horizons_s": ()}, {"toxicity_threshold": 1.5}, {"maker_fee_bp": 0.25}, {"volatility_window_s": 0.5}, {"probe_depths": (0,)}):
        with pytest.raises(ValueError):
            config.Run(**bad)
    assert config.cells(spark, [run, config.Run()]).where("fill_model = 'QUEUE'").count() == 1
    (tmp_path / "c.json").write_text('{"k": 1.0, "A": 2.0, "combined": {"k": 0.3, "A": 0.8}}')
    (tmp_path / "d.json").write_text('{"k": -1.0, "A": 2.0}')
    got = config.calibration(spark.read.json(str(tmp_path), schema=config.CALIBRATION)).collect()
    assert [tuple(r) for r in got] == [(0.3, 0.8)] and "run_id" in run.manifest()


def snapshot_events(spark, rows):
    """rows: (type, side, price, qty) of one instrument; types 2, 3 and 4 begin, fill and end a snapshot."""
    out, ended = [], 0
    for i, (kind, side, price, qty) in enumerate(rows):
        ended += kind == 4
        out.append((0, i, ended, i * 10, i, kind, side, price, qty))
    return spark.createDataFrame(out, "symbol_id long, idx long, epoch long, ts_us long, seq long, type int, side int, price long, qty long")


def test_snapshots_replace_the_book(spark):
    begin, end = (2, None, None, None), (4, None, None, None)
    rows = [begin, (3, 0, 10000, 50), (3, 1, 10001, 40), end, (0, 0, 9950, 5), (1, 1, 10000, 9), begin, (3, 0, 10100, 7), (3, 0, 10099, 0), (3, 1, 10102, 8), (0, 0, 10000, 60), end, (0, 0, 10100, 0), begin, (3, 0, 1, 1)]
    md = snapshot_events(spark, rows)
    got = {r.idx: (r.best_bid, r.best_ask, r.bid_qty) for r in book.bbo(md).collect()}
    assert got[2] == (None, None, None) and got[3] == (10000, 10001, 50) == got[9]  # staged levels aren't seen
    assert got[10] == (10000, 10001, 60) and got[11] == (10100, 10102, 7)
    assert got[12] == got[14] == (None, 10102, None)  # 9950 and 10000 went, 10099 never came, the last one never ended
    assert book.compare(book.bbo(md), book.bbo_by_intervals(md, md)).count() == 0
    assert {r.price for r in book.levels(md).where("to_idx > 14").collect()} == {10102}


def test_histories_in_stretches(spark):
    from microflow.operators import windows

    rng = random.Random(4)
    rows = [(k, i // 7, i, rng.choice([None, rng.randint(-5, 5)])) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, part long, i long, v long")
    v = F.col("v")
    got = {(r.k, r.i): r for r in windows.carried(df, ["k"], "part", ["i"], sums={"s": v, "s0": v}, maxes={"m": v}, lasts={"l": v}, lags={"g": F.col("i")}, exclusive=("s0",)).collect()}
    for k in range(3):
        seen = []
        for _, _, i, x in [r for r in rows if r[0] == k]:
            r, before = got[k, i], list(seen)
            seen += [x] if x is not None else []
            assert (r.s or 0, r.s0 or 0, r.m, r.l) == (sum(seen), sum(before), max(seen, default=None), seen[-1] if seen else None)
            assert r.g == (i - 1 if i else None)
    times = spark.createDataFrame([(0, int(t)) for t in (0, 86_399e6, 86_400e6, 86_500e6, 200_000e6)], "k long, ts_us long")
    near = windows.trailing(times, ["k"], 3_600_000_000, {"n": F.count("*")})
    assert [r.n for r in near.orderBy("ts_us").collect()] == [1, 1, 2, 3, 1]


def test_conversion(spark):
    from microflow.plans import convert

    line = lambda t, c, d, s="BTC": '{"t":%d,"c":"%s","s":"%s","d":%s}' % (t, c, s, d)
    depth = lambda first, last, b: '{"E":1,"T":%d,"U":%d,"u":%d,"a":[["100.01","0.%d"]],"b":[["100.00","0.%d"]]}' % (last, first, last, b, b)
    lines = [line(1, "depth", depth(1, 5, 1)), line(2, "snapshot", '{"lastUpdateId":100,"bids":[["99.99","0.5"]],"asks":[]}'), line(3, "depth", depth(99, 105, 2)), line(4, "depth", depth(200, 205, 3)), "", "{broken", line(5, "trade", '{"T":205,"a":1,"p":"100.00","q":"0.1","m":true}'), line(6, "depth", depth(1, 2, 1), "ETH"), line(7, "snapshot", '{"lastUpdateId":300,"bids":[],"asks":[]}'), line(8, "depth", '{"E":1,"b":[],"a":[]}'), line(9, "bookTicker", '{"u":1,"b":"1","B":"1","a":"2","A":"1"}')]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "ln long, value string")
    names = spark.createDataFrame([("BTC", 7)], "symbol string, symbol_id long")
    events, synced = convert.convert(df, names, 0.01, 0.1)
    rows = events.orderBy("idx").collect()
    assert [(r.type, r.side, r.price, r.qty, r.dirty) for r in rows if r.type in (0, 1)] == [(0, 1, 10001, 2, False), (0, 0, 10000, 2, False), (1, 1, 10000, 1, True), (0, 1, 10001, 3, True), (0, 0, 10000, 3, True)]
    s = {r.symbol_id: r for r in convert.statistics(df, names, 0.01, 0.1).collect()}
    assert (s[7].n_presync, s[7].n_gaps, s[7].n_resyncs, s[7].n_malformed, s[7].n_depth, s[7].n_tickers, s[7].n_dirty) == (1, 1, 1, 1, 4, 1, 3)
    assert (s[None].n_malformed, s[None].n_wrong_symbol) == (1, 1)
    assert convert.gap_log(synced, names).first().value.startswith('{"t":205000,')
    with pytest.raises(Exception, match="repeated"):
        convert.instruments(names.unionByName(names)).collect()


def test_report_rules(spark):
    curve = spark.createDataFrame([(0, 0.0, 5.0), (0, 1.0, 0.0), (1, 0.0, 0.0), (1, 1.0, -1.0)], "symbol_id long, fee double, pnl double")
    got = {r.symbol_id: r.break_even for r in report.break_even(curve, "symbol_id").collect()}
    assert got[0] == 1.0 and math.isnan(got[1])
    ranks = spark.createDataFrame([(0, float(i)) for i in range(10)], "k long, x double")
    assert report.lower_rank(ranks, "x", 0.9, "k").first().x == 8.0
    pairs = spark.createDataFrame([(0, "a", 1.0, 2.0), (0, "b", 2.0, None)], "k long, date string, x double, y double")
    with pytest.raises(Exception, match="same length"):
        report.bootstrap(pairs, ["k"], "date", "x", "y", resamples=10).collect()
    days = spark.createDataFrame([(0, "a", 1.0), (0, "b", math.nan), (0, "c", 3.0), (0, "d", math.inf)], "k long, date string, pnl double")
    assert report.sharpe(days, "pnl", "k").first().n_days == 2
    r = report.bootstrap(days, ["k"], "date", "pnl", resamples=50).first()
    assert r.n == 2 and r.estimate == 2.0 and r.stderr >= 0
    probes = spark.createDataFrame([(0, 10, True, True), (0, 10, False, True), (0, 10, True, False)], "k long, horizon_us long, hit boolean, whole boolean")
    assert tuple(queue.fill_rates(probes, "k").first()) == (0, 10, 2, 0.5)
