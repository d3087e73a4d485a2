"""Registered queries through streams and files: events replayed in runs, recorder files, binary logs, run tables, paired reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microflow.functions import decode, grid
from microflow.operators import book, ledger, queue, report, sync
from microflow.plans import convert
from microflow.queries import _TOUCHED, REST_US, SAMPLE_US, SQL, SQL_BOOK, SQL_CURVE, SQL_MD, WINDOW_US, book_ledger, fee_curve, market, messages, query, resting, sql_queue
from microflow.recorder_queries import LOT, SQL_SNAP_BOOK, TICK, converted
from microflow.sources import binlog, recordings
from microflow.sources.adapters import CASH, SQL_LINES, TRADE, instrument_table, symbol_lines
from microflow.sources.shared import folder, written
from microflow.streaming import books, order, sinks, streams


def _same(name: str, columns: str, other: str, wrap: str = "{}"):
    """A query with the SQL of another one."""

    def register(plan):
        query(name, columns, "")(plan)
        SQL[name] = wrap.format(SQL[other])
        return plan

    return register


def _place(spark: SparkSession, name: str) -> str:
    return f"{folder(spark).rstrip('/')}/microflow/{name}-{uuid.uuid4().hex}"


def _beats(events: DataFrame, n: int = 2) -> tuple[DataFrame, ...]:
    """Rows of an instrument -1, each a day after all before: they move the watermark on."""
    end = events.agg(F.max("ts_us").alias("end"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields if f.name not in ("symbol_id", "ts_us")]
    return tuple(end.select(F.lit(-1).cast(events.schema["symbol_id"].dataType).alias("symbol_id"), (F.col("end") + k * 86_400_000_000).alias("ts_us"), *none).select(*events.columns) for k in range(1, n + 1))


# --- streams ----------------------------------------------------------------------------------------------------------


@query("stream_touch", "symbol_id:l idx:l best_bid:l best_ask:l bid_qty:l ask_qty:l mid_x2:l", SQL_SNAP_BOOK + ";SELECT * FROM best")
def stream_touch(spark, sf_dir):
    """The live book of converted events with their snapshots, over restarts (ST7, B02)."""
    return sinks.replayed(written(converted(spark, sf_dir), "converted"), "ts_us", books.touch)


@_same("stream_ticks", "symbol_id:l n:l first_us:l last_us:l", "timer_ticks")
def stream_ticks(spark, sf_dir):
    """Timers that fire by the watermark (ST8, T08)."""
    md = market(spark, sf_dir).select("symbol_id", "ts_us")
    ticks = sinks.replayed(md, "ts_us", lambda s: books.ticks(s, 60_000_000), after=_beats(md)).where("symbol_id >= 0")
    return ticks.groupBy("symbol_id").agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@_same("stream_sigma", "symbol_id:l idx:l n:l sigma:d", "rolling_sigma")
def stream_sigma(spark, sf_dir):
    """Volatility from a ring of spaced returns (ST5, W01, W02)."""
    mids = written(book.bbo(market(spark, sf_dir)).where("mid_x2 is not null").select("symbol_id", "ts_us", "idx", "mid_x2"), "mids")
    return sinks.replayed(mids, "ts_us", lambda s: order.volatility(s, SAMPLE_US, WINDOW_US))


@_same("stream_counters", "symbol_id:l minute5:l n:l n_trades:l volume:l", "event_counters")
def stream_counters(spark, sf_dir):
    """Counters of tumbling windows, each given out once the watermark has closed it (ST2, ST4)."""
    md = market(spark, sf_dir).select("symbol_id", "ts_us", "type", "qty").withColumn("ts", F.timestamp_micros("ts_us"))
    beats = [b.withColumn("ts", F.timestamp_micros("ts_us")) for b in _beats(md)]
    out = sinks.replayed(md, "ts_us", streams.counters, after=tuple(beats)).where("symbol_id >= 0")
    return out.withColumn("minute5", F.expr("start_us div 300000000"))


@_same("stream_gaps", "symbol_id:l ln:l expected:l got:l", "sync_gaps", "SELECT symbol_id, ln, expected, got FROM ({}) g")
def stream_gaps(spark, sf_dir):
    """Breaks in the update sequence with keyed state, over restarts (ST7, ST9)."""
    return sinks.replayed(written(messages(spark, sf_dir), "messages"), "ln", streams.gaps)


@query("stream_order", "symbol_id:l idx:l ts_us:l seq:l type:l late:b", SQL_MD + ";SELECT symbol_id, idx, ts_us, seq, type, false AS late FROM md")
def stream_order(spark, sf_dir):
    """Events that arrive up to five minutes late, put in replay order by a buffer of ten (ST3, T04, O01)."""
    md = market(spark, sf_dir).drop("idx").withColumn("arrival", F.col("ts_us") + F.pmod(F.xxhash64("seq"), F.lit(300_000_000)))
    # a heartbeat of every instrument closes its buffer
    ends = md.groupBy("symbol_id").agg((F.max("ts_us") + 86_400_000_000).alias("ts_us"))
    beats = ends.select(*[F.col(f.name) if f.name in ends.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in md.schema.fields])
    return sinks.replayed(md, "arrival", lambda s: order.ordered(s, 600_000_000), after=(beats,))


@query("arrival_delay", "symbol_id:l n:l sketched:b", SQL_LINES + ";SELECT symbol_id, count(*) AS n, true AS sketched FROM messages WHERE kind <> 'snapshot' GROUP BY 1")
def arrival_delay(spark, sf_dir):
    """Receive time after exchange time: quantiles from hourly sketches, merged, and whether all are within the sketch's bound of the exact ranks (ST1)."""
    known = convert.known_lines(symbol_lines(spark, sf_dir).select("ln", "value"), instrument_table(spark)).where("not malformed and not wrong_symbol")
    both = decode.depth_updates(known).select("symbol_id", "t", "ts_us").unionByName(decode.trades(known, TICK, LOT).select("symbol_id", "t", "ts_us"))
    rows = written(both.select("symbol_id", F.expr("t div 3600000000").alias("hour"), (F.col("t") - F.col("ts_us")).alias("delay_us")), "delays")
    hourly = report.delay_sketches(rows, ["symbol_id", "hour"])
    found = written(report.merged_delays(hourly, ["symbol_id"]).withColumnRenamed("delay_us", "at"), "delay-quantiles")
    ranks = rows.join(found, "symbol_id").groupBy("symbol_id", "n", "share").agg(F.avg((F.col("delay_us") < F.col("at")).cast("double")).alias("below"), F.avg((F.col("delay_us") <= F.col("at")).cast("double")).alias("to"))
    # a sketch of the default size is within 1.7 % at 99 % confidence; twice that leaves no doubt
    return ranks.groupBy("symbol_id", "n").agg(F.min((F.col("below") <= F.col("share") + 0.034) & (F.col("to") >= F.col("share") - 0.034)).alias("sketched"))


# --- files ------------------------------------------------------------------------------------------------------------


@_same("file_depth", "symbol_id:l ln:l pos:l ts_us:l first_id:l final_id:l prev_id:l side:l price:l qty:l", "decode_depth")
def file_depth(spark, sf_dir):
    """Depth lines out of recorder files, plain and gzipped, numbered over an instrument's files."""
    place = _place(spark, "recorder")
    lines = written(symbol_lines(spark, sf_dir).withColumn("part", F.format_string("%06d", F.expr("ln div 8192"))), "symbol-lines")
    for gzip in (False, True):
        recordings.write_lines(lines.where((F.col("symbol_id") % 2 == 1) == gzip), f"{place}/{'packed' if gzip else 'plain'}", ["symbol_id", "part"], gzip)
    read = recordings.ordered_lines(spark, [f"{place}/plain", f"{place}/packed"], r"symbol_id=(\d+)/")
    known = convert.known_lines(read.select((F.col("arrival") + 1).alias("ln"), "value"), instrument_table(spark)).where("not malformed and not wrong_symbol")
    return decode.level_events(decode.depth_updates(known), TICK, LOT)


@query("binary_log", "symbol_id:l ts_us:l seq:l type:l side:l price:l qty:l", SQL_MD + ";SELECT symbol_id, ts_us, seq, type, side, price, qty FROM md")
def binary_log(spark, sf_dir):
    """Events written as binary logs and read back by ranges of records."""
    place = _place(spark, "logs")
    md = market(spark, sf_dir)
    binlog.write(md.select(F.col("ts_us").alias("exch_ts_us"), "seq", F.col("price").alias("price_ticks"), F.col("qty").alias("qty_lots"), "type", "side", "symbol_id", F.lit(0).alias("flags")), place, 20_000)
    return binlog.read(spark, place, 5_000).select("symbol_id", F.col("exch_ts_us").alias("ts_us"), "seq", "type", "side", F.col("price_ticks").alias("price"), F.col("qty_lots").alias("qty"))


@_same("run_files", "symbol_id:l date:s n_fills:l notional:l spread_x2:l inventory_x2:l fees_x2:l end_inventory:l change_x2:l residual_x2:l", "pnl_daily")
def run_files(spark, sf_dir):
    """Daily profit written as the CSV files of runs and read back as one table, past files that aren't run tables."""
    place, days = _place(spark, "runs"), ledger.daily(book_ledger(spark, sf_dir))
    names = ["symbol_id", "date", "n_fills", "notional", "spread_x2", "inventory_x2", "fees_x2", "end_inventory", "change_x2", "residual_x2"]
    days = days.select(*names)
    recordings.write_csv(days.repartition("symbol_id"), f"{place}/days")
    spark.range(1).select(F.lit("not,a,table").alias("value")).write.text(f"{place}/other")
    return recordings.read_runs(spark, place, "part-*", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in days.schema.fields))


@query("decode_tickers", "symbol_id:l update_id:l best_bid:l bid_qty:l best_ask:l ask_qty:l", SQL_BOOK + ";SELECT symbol_id, idx AS update_id, best_bid, bid_qty, best_ask, ask_qty FROM best WHERE mid_x2 IS NOT NULL")
def decode_tickers(spark, sf_dir):
    """Best prices as ticker lines, classified by their keys and decoded."""
    best = book.bbo(market(spark, sf_dir)).where("mid_x2 is not null")
    price, qty = (lambda c: F.format_string("%d.%02d", F.expr(f"{c} div 100"), F.col(c) % 100)), (lambda c: F.format_string("%d.%d", F.expr(f"{c} div 10"), F.col(c) % 10))
    payload = F.to_json(F.struct(F.col("idx").alias("u"), price("best_bid").alias("b"), qty("bid_qty").alias("B"), price("best_ask").alias("a"), qty("ask_qty").alias("A")))
    lines = best.select("symbol_id", payload.alias("d"), "ts_us").select("symbol_id", F.concat(F.lit('{"t":'), "ts_us", F.lit(',"c":"'), decode.classify(F.col("d")), F.lit('","s":"SYM"'), F.lit(',"d":'), "d", F.lit("}")).alias("value"))
    return decode.tickers(decode.envelopes(lines), TICK, LOT)


# --- order and pairs --------------------------------------------------------------------------------------------------


@query("timeline", "symbol_id:l step:l ts_us:l kind:l seq:l", SQL_MD + """,
spans AS (SELECT symbol_id, min(ts_us) AS lo, max(ts_us) AS hi FROM md GROUP BY 1),
line AS (SELECT symbol_id, ts_us, 0 AS kind, idx AS seq FROM md UNION ALL SELECT symbol_id, ts_us + 50000, 1, idx FROM md WHERE type = 1
  UNION ALL SELECT symbol_id, lo + k * 3600000000, 2, lo + k * 3600000000 FROM (SELECT symbol_id, lo, unnest(range(1, (hi - lo) // 3600000000 + 1)) AS k FROM spans))
;SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY ts_us, kind, seq) AS step FROM line""")
def timeline(spark, sf_dir):
    """Market events, actions 50 ms after each print, and hourly timers in one order."""
    md = market(spark, sf_dir)
    events = md.select("symbol_id", "ts_us", F.col("idx").alias("seq"))
    actions = md.where(F.col("type") == TRADE).select("symbol_id", (F.col("ts_us") + 50_000).alias("ts_us"), F.col("idx").alias("seq"))
    ticks = sync.timers(md, 3_600_000_000).withColumn("seq", F.col("ts_us"))
    return sync.timeline(events, actions, ticks)


@query("fee_report", "place:l symbol_id:l fee:d pnl:l", SQL_CURVE + ";SELECT row_number() OVER (ORDER BY fee, pnl DESC, symbol_id) AS place, symbol_id, fee, pnl FROM curve")
def fee_report(spark, sf_dir):
    """Profit in the order of a report: by fee, best first."""
    return report.ordered(fee_curve(spark, sf_dir), "fee", F.col("pnl").desc(), "symbol_id")


_GAIN = "(1 - 2 * side) * (mid_x2 - 2 * price) * {n} * 100000 - 2 * CAST(sign(price * {n} * 100000 * fee_tenths) AS BIGINT) * ((abs(price * {n} * 100000 * fee_tenths) + 50000) // 100000)"


@query("profit_gap", "date:s fee_tenths:l latency_us:l n_touch:l n_queue:l pnl_touch:l pnl_queue:l gap:l", sql_queue("PESS") + _TOUCHED + f""",
lots AS (SELECT order_id, CAST(sum(fill) AS BIGINT) AS lots FROM touched GROUP BY 1),
both_models AS (SELECT strftime(make_timestamp(CAST(ts_us AS BIGINT)), '%Y-%m-%d') AS date, fee_tenths, side, price, mid_x2, coalesce(lots, 0) AS t, filled AS q FROM followed LEFT JOIN lots USING (order_id) CROSS JOIN (SELECT unnest([0, 20]) AS fee_tenths))
;SELECT date, fee_tenths, 0 AS latency_us, count(*) FILTER (t > 0) AS n_touch, count(*) FILTER (q > 0) AS n_queue, sum({_GAIN.format(n="t")}) AS pnl_touch, sum({_GAIN.format(n="q")}) AS pnl_queue, sum({_GAIN.format(n="t")}) - sum({_GAIN.format(n="q")}) AS gap FROM both_models GROUP BY 1, 2""")
def profit_gap(spark, sf_dir):
    """What the touch rule earns more than the queue model, paired by date, fee and latency."""
    orders, md, _ = resting(spark, sf_dir)
    keys = ["date", "fee_tenths", "latency_us"]

    def days(lots: DataFrame) -> DataFrame:
        rows = orders.join(lots, "order_id", "left").withColumn("lots", F.coalesce("lots", F.lit(0).cast("long"))).withColumn("fee_tenths", F.explode(F.lit([0, 20])))
        gain = grid.sign(F.col("side")) * (F.col("mid_x2") - 2 * F.col("price")) * F.col("lots") * CASH - 2 * grid.fee(grid.notional(F.col("price"), F.col("lots"), CASH), F.col("fee_tenths").cast("long"))
        return rows.groupBy(grid.utc_date(F.col("ts_us")).alias("date"), "fee_tenths", F.lit(0).alias("latency_us")).agg(F.struct(F.count_if(F.col("lots") > 0).alias("n"), F.sum(gain).alias("pnl")).alias("x"))

    touch = days(queue.touch_fills(orders, md, REST_US).groupBy("order_id").agg(F.sum("fill").alias("lots")))
    waited = days(queue.follow(orders, md, "PESS", REST_US).select("order_id", F.col("filled").alias("lots")))
    out = report.paired(touch, waited, keys, "x")
    return out.select(*keys, F.col("x_touch.n").alias("n_touch"), F.col("x_queue.n").alias("n_queue"), F.col("x_touch.pnl").alias("pnl_touch"), F.col("x_queue.pnl").alias("pnl_queue"), (F.col("x_touch.pnl") - F.col("x_queue.pnl")).alias("gap"))
