"""Registered queries from recorder lines on: decoding, conversion, the book after snapshots, clean calibration, full reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microflow.functions import decode, grid
from microflow.operators import book, calibrate, ledger, markout, report
from microflow.plans import convert
from microflow.queries import BUCKET_US, DEEPEST, SQL_DAILY, SQL_HAZARD, SQL_MESSAGES, SQL_SAMPLES, book_ledger, hazard, priced_samples, query, resting, sql_probes
from microflow.queries import DEPTHS as PROBE_DEPTHS
from microflow.sources.adapters import SQL_LINES, TRADE, instrument_table, market_events, recorder_lines
from microflow.sources.shared import written

TICK, LOT = 0.01, 0.1

SQL_SYNCED = SQL_LINES + ",\n" + SQL_MESSAGES[SQL_MESSAGES.index("epochs AS") :]

_BID_FIRST = "(p = 0) = (event_id % 2 = 0)"
SQL_CONVERTED = SQL_SYNCED + f""",
raw_events AS (
  SELECT symbol_id, ln, p AS pos, ms_us AS ts_us, final_id AS seq, 'depth' AS kind, CASE WHEN {_BID_FIRST} THEN 0 ELSE 1 END AS side, CASE WHEN {_BID_FIRST} THEN 10000 - off ELSE 10001 + off END AS price, CASE WHEN {_BID_FIRST} THEN k ELSE (k + event_id) % 7 END AS qty, dirty
  FROM synced CROSS JOIN (SELECT unnest([0, 1]) AS p) WHERE accepted
  UNION ALL SELECT symbol_id, ln, 0, ms_us, event_id, 'trade', CASE WHEN sold THEN 1 ELSE 0 END, CASE WHEN sold THEN 10000 ELSE 10001 END, k + 1, dirty FROM synced WHERE kind = 'trade'
  UNION ALL SELECT symbol_id, ln, p, ts_us, final_id, CASE p WHEN 0 THEN 'begin' WHEN 7 THEN 'end' ELSE 'level' END, CASE WHEN p IN (0, 7) THEN NULL WHEN p < 4 THEN 0 ELSE 1 END, CASE WHEN p IN (0, 7) THEN NULL WHEN p < 4 THEN 10001 - off - p ELSE 9997 + off + p END, CASE WHEN p IN (0, 7) THEN NULL WHEN p < 4 THEN k + p - 1 ELSE k + p - 4 END, dirty
  FROM synced CROSS JOIN (SELECT unnest(range(8)) AS p) WHERE kind = 'snapshot'),
md AS (SELECT *, CASE kind WHEN 'depth' THEN 0 WHEN 'trade' THEN 1 WHEN 'begin' THEN 2 WHEN 'level' THEN 3 ELSE 4 END AS type,
  row_number() OVER (PARTITION BY symbol_id ORDER BY ts_us, CASE kind WHEN 'begin' THEN 0 WHEN 'level' THEN 1 WHEN 'end' THEN 2 WHEN 'trade' THEN 3 ELSE 4 END, ln, pos) - 1 AS idx FROM raw_events)"""

SQL_SNAP_BOOK = SQL_CONVERTED + """,
ended AS (SELECT symbol_id, idx AS e FROM md WHERE type = 4),
last AS (SELECT symbol_id, max(idx) + 1 AS end_idx FROM md GROUP BY 1),
ups AS (SELECT symbol_id, side, price, qty, idx, idx AS f FROM md WHERE type = 0
  UNION ALL SELECT l.symbol_id, l.side, l.price, l.qty, l.idx, min(e) AS f FROM md l JOIN ended ON ended.symbol_id = l.symbol_id AND e > l.idx WHERE l.type = 3 AND l.qty > 0 GROUP BY 1, 2, 3, 4, 5),
following AS (SELECT ups.*, lead(f) OVER (PARTITION BY symbol_id, side, price ORDER BY f, idx) AS next_f FROM ups),
spans AS (SELECT symbol_id, side, price, qty, f AS from_idx, least(coalesce(next_f, end_idx), coalesce((SELECT min(e) FROM ended WHERE ended.symbol_id = following.symbol_id AND e > f), end_idx)) AS to_idx FROM following JOIN last USING (symbol_id) WHERE qty > 0),
live AS (SELECT p.symbol_id, p.idx, s.side, s.price, s.qty FROM md p JOIN spans s ON p.symbol_id = s.symbol_id AND s.from_idx <= p.idx AND p.idx < s.to_idx),
best AS (SELECT p.symbol_id, p.idx, p.ts_us, p.dirty, max(CASE WHEN side = 0 THEN price END) AS best_bid, min(CASE WHEN side = 1 THEN price END) AS best_ask,
  arg_max(qty, price) FILTER (WHERE side = 0) AS bid_qty, arg_min(qty, price) FILTER (WHERE side = 1) AS ask_qty, max(CASE WHEN side = 0 THEN price END) + min(CASE WHEN side = 1 THEN price END) AS mid_x2
  FROM (SELECT symbol_id, idx, ts_us, dirty FROM md) p LEFT JOIN live l ON p.symbol_id = l.symbol_id AND p.idx = l.idx GROUP BY 1, 2, 3, 4)"""


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as they would lie in files."""
    return written(recorder_lines(spark, sf_dir), "recorded")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.known_lines(recorded(spark, sf_dir), instrument_table(spark)).where("not malformed and not wrong_symbol")


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.convert(recorded(spark, sf_dir), instrument_table(spark), TICK, LOT)[0]


@query("decode_depth", "symbol_id:l ln:l pos:l ts_us:l first_id:l final_id:l prev_id:l side:l price:l qty:l", SQL_LINES + f""";SELECT symbol_id, ln, p AS pos, ms_us AS ts_us, first_id, final_id, prev_id, CASE WHEN {_BID_FIRST} THEN 0 ELSE 1 END AS side, CASE WHEN {_BID_FIRST} THEN 10000 - off ELSE 10001 + off END AS price, CASE WHEN {_BID_FIRST} THEN k ELSE (k + event_id) % 7 END AS qty FROM messages CROSS JOIN (SELECT unnest([0, 1]) AS p) WHERE kind = 'depth'""")
def decode_depth(spark, sf_dir):
    """Depth lines of a recorder as level changes, sides in the order of the payload's keys."""
    return decode.level_events(decode.depth_updates(known(spark, sf_dir)), TICK, LOT)


@query("decode_trades", "symbol_id:l ln:l ts_us:l trade_id:l side:l price:l qty:l", SQL_LINES + """;SELECT symbol_id, ln, ms_us AS ts_us, event_id AS trade_id, CASE WHEN sold THEN 1 ELSE 0 END AS side, CASE WHEN sold THEN 10000 ELSE 10001 END AS price, k + 1 AS qty FROM messages WHERE kind = 'trade'""")
def decode_trades(spark, sf_dir):
    """Prints with their aggressor."""
    return decode.trades(known(spark, sf_dir), TICK, LOT)


@query("decode_snapshots", "symbol_id:l ln:l pos:l kind:s ts_us:l final_id:l side:l price:l qty:l", SQL_LINES + """;SELECT symbol_id, ln, p AS pos, CASE p WHEN 0 THEN 'begin' WHEN 7 THEN 'end' ELSE 'level' END AS kind, ts_us, final_id, CASE WHEN p IN (0, 7) THEN NULL WHEN p < 4 THEN 0 ELSE 1 END AS side,
  CASE WHEN p IN (0, 7) THEN NULL WHEN p < 4 THEN 10001 - off - p ELSE 9997 + off + p END AS price, CASE WHEN p IN (0, 7) THEN NULL WHEN p < 4 THEN k + p - 1 ELSE k + p - 4 END AS qty FROM messages CROSS JOIN (SELECT unnest(range(8)) AS p) WHERE kind = 'snapshot'""")
def decode_snapshots(spark, sf_dir):
    """Snapshots as begin, level and end rows."""
    return decode.snapshots(known(spark, sf_dir), TICK, LOT)


@query("convert_events", "symbol_id:l idx:l ts_us:l seq:l type:l side:l price:l qty:l dirty:b resync:b", SQL_CONVERTED + ";SELECT symbol_id, idx, ts_us, seq, type, side, price, qty, dirty, type >= 2 AS resync FROM md")
def convert_events(spark, sf_dir):
    """Recorder lines to market events in replay order."""
    return converted(spark, sf_dir)


@query("convert_range", "symbol_id:l n:l n_dirty:l first_us:l last_us:l", SQL_CONVERTED + ";SELECT symbol_id, count(*) AS n, count(*) FILTER (dirty) AS n_dirty, min(ts_us) AS first_us, max(ts_us) AS last_us FROM raw_events WHERE ts_us BETWEEN 1704672000000000 AND 1705881600000000 GROUP BY 1")
def convert_range(spark, sf_dir):
    """A conversion with an inclusive time range, applied after the sequence protocol."""
    rows, _ = convert.convert(recorded(spark, sf_dir), instrument_table(spark), TICK, LOT, 1704672000000000, 1705881600000000)
    return rows.groupBy("symbol_id").agg(F.count("*").alias("n"), F.count_if("dirty").alias("n_dirty"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


_COUNTS = "n_lines n_malformed n_wrong_symbol n_depth n_trades n_tickers n_snapshots n_presync n_stale n_gaps n_resyncs n_events n_dirty first_us last_us".split()


@query("convert_stats", "symbol_id:l " + " ".join(f"{c}:l" for c in _COUNTS), SQL_CONVERTED + """,
read AS (SELECT CASE WHEN NOT malformed AND NOT wrong THEN symbol_id END AS symbol_id, count(*) AS n_lines, count(*) FILTER (malformed) AS n_malformed, count(*) FILTER (wrong) AS n_wrong_symbol, count(*) FILTER (kind = 'depth' AND NOT malformed AND NOT wrong) AS n_depth, count(*) FILTER (kind = 'trade' AND NOT malformed AND NOT wrong) AS n_trades, 0 AS n_tickers, count(*) FILTER (kind = 'snapshot' AND NOT malformed AND NOT wrong) AS n_snapshots FROM lines GROUP BY 1),
dropped AS (SELECT symbol_id, count(*) FILTER (kind = 'depth' AND epoch = 0) AS n_presync, count(*) FILTER (kind = 'depth' AND epoch > 0 AND NOT accepted) AS n_stale, count(*) FILTER (gap) AS n_gaps, count(*) FILTER (resynced) AS n_resyncs FROM synced GROUP BY 1),
made AS (SELECT symbol_id, count(*) AS n_events, count(*) FILTER (dirty) AS n_dirty, min(ts_us) AS first_us, max(ts_us) AS last_us FROM md GROUP BY 1)
;SELECT r.*, coalesce(n_presync, 0) AS n_presync, coalesce(n_stale, 0) AS n_stale, coalesce(n_gaps, 0) AS n_gaps, coalesce(n_resyncs, 0) AS n_resyncs, coalesce(n_events, 0) AS n_events, coalesce(n_dirty, 0) AS n_dirty, first_us, last_us FROM read r LEFT JOIN dropped d USING (symbol_id) LEFT JOIN made m USING (symbol_id)""")
def convert_stats(spark, sf_dir):
    """All fifteen counters of a conversion, broken and foreign lines in a row of their own."""
    return convert.statistics(recorded(spark, sf_dir), instrument_table(spark), TICK, LOT)


@query("gap_log", "symbol_id:l ln:l value:s", SQL_SYNCED + """;SELECT symbol_id, ln, '{"t":' || CASE kind WHEN 'depth' THEN ms_us ELSE ts_us END || ',"iso":"' || strftime(make_timestamp(ms_us), '%Y-%m-%dT%H:%M:%SZ') || '","symbol":"SYM' || symbol_id || '","reason":"' || CASE WHEN earlier = 0 THEN 'first update doesn''t bracket the snapshot' WHEN futures AND prev_id IS NOT NULL THEN 'futures: pu doesn''t match' ELSE 'spot: U doesn''t follow' END
  || '","expected":' || CASE WHEN earlier > 0 AND futures AND prev_id IS NOT NULL THEN last ELSE last + 1 END || ',"got":' || CASE WHEN earlier > 0 AND futures AND prev_id IS NOT NULL THEN prev_id ELSE first_id END || '}' AS value FROM synced WHERE gap""")
def gap_log(spark, sf_dir):
    """The sidecar log of breaks."""
    _, synced = convert.convert(recorded(spark, sf_dir), instrument_table(spark), TICK, LOT)
    return convert.gap_log(synced, instrument_table(spark))


@query("book_after_snapshot", "symbol_id:l idx:l best_bid:l best_ask:l bid_qty:l ask_qty:l mid_x2:l", SQL_SNAP_BOOK + ";SELECT * FROM best")
def book_after_snapshot(spark, sf_dir):
    """The book of converted events: each snapshot replaces it at its end."""
    return book.bbo(written(converted(spark, sf_dir), "converted"))


@query("dual_book", "symbol_id:l n:l n_first:l n_second:l", SQL_SNAP_BOOK + ";SELECT symbol_id, count(*) AS n, 0 AS n_first, 0 AS n_second FROM best GROUP BY 1")
def dual_book(spark, sf_dir):
    """Two reconstructions of the book, by ordered passes and by intervals: the events after which best prices, numbers of levels or any level differ."""
    md = written(converted(spark, sf_dir), "converted")
    one, two = book.bbo(md, whole=True), book.bbo_by_intervals(md, md, whole=True)
    off = book.compare(one, two).groupBy("symbol_id").agg(F.count_if(F.col("only_in") == "first").alias("a"), F.count_if(F.col("only_in") == "second").alias("b"))
    rows = md.groupBy("symbol_id").agg(F.count("*").alias("n")).join(off, "symbol_id", "left")
    return rows.select("symbol_id", "n", F.coalesce("a", F.lit(0)).alias("n_first"), F.coalesce("b", F.lit(0)).alias("n_second"))


@query("hazard_clean", "symbol_id:l delta:l seconds:d bid_hits:l ask_hits:l rate:d", SQL_SNAP_BOOK + f""",
mids AS (SELECT symbol_id, ts_us // {BUCKET_US} AS slot, arg_min(mid_x2, idx) AS mid_x2 FROM best WHERE mid_x2 IS NOT NULL AND NOT dirty GROUP BY 1, 2),
prints AS (SELECT symbol_id, ts_us // {BUCKET_US} AS slot, min(CASE WHEN side = 1 THEN price END) AS sold, max(CASE WHEN side = 0 THEN price END) AS bought FROM md WHERE type = 1 AND NOT dirty GROUP BY 1, 2)
;SELECT *, (bid_hits + ask_hits) / 2.0 / seconds AS rate FROM (SELECT symbol_id, delta, count(*) * {BUCKET_US / 1e6} AS seconds, count(*) FILTER (mid_x2 / 2.0 - sold >= delta) AS bid_hits, count(*) FILTER (bought - mid_x2 / 2.0 >= delta) AS ask_hits
  FROM mids LEFT JOIN prints USING (symbol_id, slot) CROSS JOIN (SELECT unnest(range(1, {DEEPEST + 1})) AS delta) GROUP BY 1, 2)""")
def hazard_clean(spark, sf_dir):
    """Arrival rates without the stretches in which the book is known to be wrong."""
    md = written(converted(spark, sf_dir), "converted")
    best = book.bbo(md).join(md.select("symbol_id", "idx", "dirty"), ["symbol_id", "idx"])
    return calibrate.hazard_points(md, best, BUCKET_US, DEEPEST)


@query("hazard_refit", "symbol_id:l k:d a:d r2:d n:l ok:b", SQL_HAZARD + """;SELECT symbol_id, -regr_slope(ln(rate), CAST(delta AS DOUBLE)) AS k, exp(regr_intercept(ln(rate), CAST(delta AS DOUBLE))) AS a, CASE WHEN var_pop(ln(rate)) = 0 THEN 0 ELSE regr_r2(ln(rate), CAST(delta AS DOUBLE)) END AS r2, count(*) AS n,
  count(*) >= 2 AND regr_slope(ln(rate), CAST(delta AS DOUBLE)) IS NOT NULL AS ok FROM hazard WHERE rate > 0 GROUP BY 1""")
def hazard_refit(spark, sf_dir):
    """The fit over all points with hits, as reports make it."""
    return calibrate.fit(hazard(spark, sf_dir), "symbol_id", near=DEEPEST)


SQL_FULL_DAILY = SQL_DAILY + SQL_SAMPLES[SQL_SAMPLES.index(",\ndue AS") :] + """,
nearest AS (SELECT symbol_id, arg_min(adverse, off) AS adverse FROM (SELECT symbol_id, abs(CAST(horizon_us AS BIGINT) - 10000000) * 10 + CASE WHEN horizon_us > 10000000 THEN 1 ELSE 0 END AS off, avg(10000.0 * adverse_x2 / notional) AS adverse FROM priced WHERE resolved GROUP BY 1, 2) GROUP BY 1),""" + sql_probes(PROBE_DEPTHS)[sql_probes(PROBE_DEPTHS).index("placed_at AS") :] + """,
quotes AS (SELECT symbol_id, strftime(make_timestamp(CAST(ts_us AS BIGINT)), '%Y-%m-%d') AS date, count(*) AS n FROM probes GROUP BY 1, 2)"""


@query("pnl_daily_table", "run_id:s strategy:s symbol:s queue_assumption:s maker_fee_bp:d latency_in_ms:l latency_out_ms:l seed:l date:s spread_capture:d inventory_pnl:d fees:d total:d equity_change:d identity_residual_x2:l adverse_selection_10s_bp:d fills:l quotes_placed:l notional_traded:d dirty_events:l", SQL_FULL_DAILY + """;SELECT 'S0_touch_PESS_2_0_50_1' AS run_id, 'S0_touch' AS strategy, 'SYM' || d.symbol_id AS symbol, 'PESS' AS queue_assumption, 2.0 AS maker_fee_bp, 50 AS latency_in_ms, 50 AS latency_out_ms, 1 AS seed, d.date, spread_x2 / 2e8 AS spread_capture, inventory_x2 / 2e8 AS inventory_pnl, -fees_x2 / 2e8 AS fees, (spread_x2 + inventory_x2 - fees_x2) / 2e8 AS total, change_x2 / 2e8 AS equity_change,
  change_x2 - (spread_x2 + inventory_x2 - fees_x2) AS identity_residual_x2, coalesce(adverse, 0) AS adverse_selection_10s_bp, n_fills AS fills, coalesce(q.n, 0) AS quotes_placed, d.notional / 1e8 AS notional_traded, 0 AS dirty_events FROM daily d LEFT JOIN nearest USING (symbol_id) LEFT JOIN quotes q ON q.symbol_id = d.symbol_id AND q.date = d.date""")
def pnl_daily_table(spark, sf_dir):
    """The daily profit table with all its columns, adverse selection at the horizon nearest to ten seconds."""
    days = ledger.daily(book_ledger(spark, sf_dir))
    near = markout.nearest(markout.summary(priced_samples(spark, sf_dir), "symbol_id", "horizon_us"), 10_000_000, "symbol_id")
    orders = resting(spark, sf_dir)[0]
    placed = orders.groupBy("symbol_id", grid.utc_date(F.col("ts_us")).alias("date")).agg(F.count("*").alias("quotes_placed"))
    tags = {"run_id": "S0_touch_PESS_2_0_50_1", "strategy": "S0_touch", "queue_assumption": "PESS", "maker_fee_bp": 2.0, "latency_in_ms": 50, "latency_out_ms": 50, "seed": 1}
    return ledger.daily_table(days, near.select("symbol_id", "adverse_bp"), placed, tags).withColumn("symbol", F.concat(F.lit("SYM"), "symbol_id"))


@query("axis_limits", "depth:l low:l high:l", SQL_SAMPLES + """;SELECT side AS depth, min(least(mid_x2, coalesce(mid_x2_at, mid_x2))) AS low, max(greatest(mid_x2, coalesce(mid_x2_at, mid_x2))) AS high FROM priced GROUP BY 1""")
def axis_limits(spark, sf_dir):
    """Smallest and largest value over both of two paired series."""
    return report.axis_limits(priced_samples(spark, sf_dir), "mid_x2", "mid_x2_at", "side").withColumnRenamed("side", "depth")


@query("instrument_counts", "symbol:s n:l", """;SELECT 'SYM' || user_id % 4 AS symbol, count(*) AS n FROM events WHERE user_id % 4 IN (0, 2) GROUP BY 1""")
def instrument_counts(spark, sf_dir):
    """Events by instrument name through the checked dimension, for those of a wanted list that are there."""
    names = convert.instruments(instrument_table(spark))
    rows = market_events(spark, sf_dir).join(names, "symbol_id").groupBy("symbol").agg(F.count("*").alias("n"))
    return report.wanted(rows, "symbol", ["SYM2", "SYM0", "SYM9"])


@query("conversions", "symbol_id:l turnover:d lots:d", """;SELECT user_id % 4 AS symbol_id, sum(CASE WHEN event_type IN ('error', 'click') THEN 100.0 ELSE 100.01 END * (CAST(json_extract(props, '$.k') AS BIGINT) + 1) * 0.1) AS turnover, sum((CAST(json_extract(props, '$.k') AS BIGINT) + 1) * 0.1) AS lots FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1""")
def conversions(spark, sf_dir):
    """Grid numbers back to prices, quantities and money."""
    rows = market_events(spark, sf_dir).where(F.col("type") == TRADE)
    return rows.groupBy("symbol_id").agg(F.sum(grid.to_price(F.col("price"), TICK) * grid.to_qty(F.col("qty"), LOT)).alias("turnover"), F.sum(grid.to_qty(F.col("qty"), LOT)).alias("lots"))
