"""Registered queries of the market-data operators, each with the SQL that its result is checked against.

Every query is a pair: a plan over the operators, and the same question as plain SQL. Columns are brought to one type
on both sides (long, double rounded to six digits, string, boolean).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microflow.functions import grid, quotes
from microflow.operators import book, calibrate, ledger, markout, queue, report, rolling, sync
from microflow.operators.windows import as_of, carried
from microflow.sources.adapters import CASH, SQL_MD, TRADE, market_events
from microflow.sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HORIZONS = [1_000_000, 10_000_000, 60_000_000, 600_000_000]
_TYPES = {"l": ("long", "BIGINT"), "d": ("double", "DOUBLE"), "s": ("string", "VARCHAR"), "b": ("boolean", "BOOLEAN")}

SQL_BOOK = SQL_MD + """,
ends AS (SELECT symbol_id, max(idx) + 1 AS end_idx FROM md GROUP BY 1),
updates AS (SELECT symbol_id, side, price, qty, idx AS from_idx, lead(idx) OVER (PARTITION BY symbol_id, side, price ORDER BY idx) AS next_idx FROM md WHERE type = 0),
spans AS (SELECT u.symbol_id, side, price, qty, from_idx, coalesce(next_idx, end_idx) AS to_idx FROM updates u JOIN ends USING (symbol_id) WHERE qty > 0),
live AS (SELECT p.symbol_id, p.idx, s.side, s.price, s.qty FROM md p JOIN spans s ON p.symbol_id = s.symbol_id AND s.from_idx <= p.idx AND p.idx < s.to_idx),
best AS (SELECT p.symbol_id, p.idx, p.ts_us, max(CASE WHEN side = 0 THEN price END) AS best_bid, min(CASE WHEN side = 1 THEN price END) AS best_ask,
  arg_max(qty, price) FILTER (WHERE side = 0) AS bid_qty, arg_min(qty, price) FILTER (WHERE side = 1) AS ask_qty,
  max(CASE WHEN side = 0 THEN price END) + min(CASE WHEN side = 1 THEN price END) AS mid_x2
  FROM (SELECT symbol_id, idx, ts_us FROM md) p LEFT JOIN live l ON p.symbol_id = l.symbol_id AND p.idx = l.idx GROUP BY 1, 2, 3),
marks AS (SELECT * FROM (SELECT *, lag(mid_x2) OVER (PARTITION BY symbol_id ORDER BY idx) AS before FROM best WHERE mid_x2 IS NOT NULL) WHERE before IS NULL OR before <> mid_x2)"""

SQL_FILLS = SQL_BOOK + """,
fills AS (SELECT t.symbol_id, t.idx AS fill_id, t.ts_us, 1 - t.side AS side, t.price, t.qty, b.mid_x2 FROM md t JOIN best b ON t.symbol_id = b.symbol_id AND t.idx = b.idx WHERE t.type = 1 AND b.mid_x2 IS NOT NULL)"""

SQL_SAMPLES = SQL_FILLS + f""",
due AS (SELECT f.*, h.h AS horizon_us, f.ts_us + h.h AS due_us FROM fills f CROSS JOIN (SELECT unnest({HORIZONS}) AS h) h),
at_due AS (SELECT symbol_id, ts_us, arg_min(mid_x2, idx) AS first_mid FROM marks GROUP BY 1, 2),
before_due AS (SELECT symbol_id, ts_us, arg_max(mid_x2, idx) AS last_mid FROM marks GROUP BY 1, 2),
last_marks AS (SELECT symbol_id, max(ts_us) AS last_us FROM marks GROUP BY 1),
sampled AS (SELECT d.*, d.due_us <= m.last_us AS resolved, CASE WHEN d.due_us <= m.last_us THEN coalesce(e.first_mid, p.last_mid) END AS mid_x2_at
  FROM due d JOIN last_marks m USING (symbol_id) LEFT JOIN at_due e ON e.symbol_id = d.symbol_id AND e.ts_us = d.due_us
  ASOF LEFT JOIN before_due p ON p.symbol_id = d.symbol_id AND p.ts_us < d.due_us),
priced AS (SELECT *, CASE WHEN resolved THEN (1 - 2 * side) * (mid_x2 - 2 * price) * qty ELSE 0 END AS edge_x2,
  CASE WHEN resolved THEN (1 - 2 * side) * (mid_x2_at - mid_x2) * qty ELSE 0 END AS adverse_x2, 2 * price * qty AS notional FROM sampled)"""

SQL_MESSAGES = """
ranked AS (SELECT user_id % 4 AS symbol_id, event_id, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS ln FROM events),
messages AS (SELECT symbol_id, ln, ts_us, event_id % 2 = 0 AS even, CASE WHEN event_id % 251 = 0 THEN 'snapshot' WHEN event_id % 5 = 4 THEN 'trade' ELSE 'depth' END AS kind,
  ln * 10 - 9 + CASE WHEN event_id % 97 = 0 THEN 5 ELSE 0 END AS first_id,
  CASE WHEN event_id % 251 <> 0 AND event_id % 5 = 4 THEN NULL WHEN event_id % 89 = 0 THEN ln * 10 - 100 ELSE ln * 10 END AS final_id,
  CASE WHEN symbol_id < 2 AND event_id % 251 <> 0 THEN ln * 10 - 10 + CASE WHEN event_id % 97 = 0 THEN 5 ELSE 0 END END AS prev_id FROM ranked),
epochs AS (SELECT *, sum(CASE WHEN kind = 'snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol_id ORDER BY ln) AS epoch FROM messages),
lasts AS (SELECT *, max(final_id) OVER (PARTITION BY symbol_id, epoch ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM epochs),
taken AS (SELECT *, coalesce(kind = 'depth' AND epoch > 0 AND final_id > last, false) AS accepted FROM lasts),
counted AS (SELECT *, coalesce(sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (PARTITION BY symbol_id, epoch ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
  (SELECT arg_min(t.prev_id IS NOT NULL, t.ln) FROM taken t WHERE t.accepted AND t.symbol_id = taken.symbol_id) AS futures FROM taken),
gapped AS (SELECT *, accepted AND NOT CASE WHEN earlier = 0 THEN first_id <= last + 1 AND final_id >= last + 1 WHEN futures AND prev_id IS NOT NULL THEN prev_id = last ELSE first_id = last + 1 END AS gap FROM counted),
flagged AS (SELECT *, coalesce(bool_or(gap) OVER (PARTITION BY symbol_id, epoch ORDER BY ln), false) AS dirty FROM gapped),
synced AS (SELECT *, kind = 'snapshot' AND coalesce(lag(dirty) OVER (PARTITION BY symbol_id ORDER BY ln), false) AS resynced FROM flagged)"""


def query(name: str, columns: str, sql: str):
    """Registers a plan with its columns ("name:type ...") and its SQL."""
    spec = [c.split(":") for c in columns.split()]

    def wrap(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = plan(spark, sf_dir)
            return out.select(*[(F.round(F.col(c).cast("double"), 6) if t == "d" else F.col(c).cast(_TYPES[t][0])).alias(c) for c, t in spec])

        run.__name__, run.__doc__ = name, plan.__doc__
        QUERIES[name] = run
        if sql:
            cols = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" if t == "d" else f"CAST({c} AS {_TYPES[t][1]}) AS {c}" for c, t in spec)
            head, _, tail = sql.rpartition(";")
            SQL[name] = (f"WITH {head} " if head else "") + f"SELECT {cols} FROM ({tail}) q"
        return plan

    return wrap


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- grid, money, dates -----------------------------------------------------------------------------------------------


@query("scalar_grid", "l_suppkey:l n:l price_ticks:l price_by_double:l qty_lots:l", """;SELECT l_suppkey, count(*) AS n, sum(CAST(round(CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(28,10)) * 100, 0) AS BIGINT)) AS price_ticks,
  sum(CAST(round(l_extendedprice * (1.0 / 0.01)) AS BIGINT)) AS price_by_double, sum(CAST(round(l_quantity * (1.0 / 0.001)) AS BIGINT)) AS qty_lots FROM lineitem GROUP BY 1""")
def scalar_grid(spark, sf_dir):
    """Decimal text and doubles on the integer grid."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", grid.parse_fixed(F.col("l_extendedprice").cast("string"), 2).alias("p"), grid.to_grid(F.col("l_extendedprice"), 0.01).alias("d"), grid.to_grid(F.col("l_quantity"), 0.001).alias("q"))
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("p").alias("price_ticks"), F.sum("d").alias("price_by_double"), F.sum("q").alias("qty_lots"))


@query("fee_notional", "symbol_id:l tenths:l notional:l fees:l", SQL_MD + """;SELECT symbol_id, tenths, sum(price * qty * 100000) AS notional,
  sum(CAST(sign(price * qty * 100000 * tenths) AS BIGINT) * ((abs(price * qty * 100000 * tenths) + 50000) // 100000)) AS fees FROM md CROSS JOIN (SELECT unnest([0, 20, 100, -5]) AS tenths) WHERE type = 1 GROUP BY 1, 2""")
def fee_notional(spark, sf_dir):
    """Exact notional and fees, rounded half away from zero per print."""
    rows = market_events(spark, sf_dir).where(F.col("type") == TRADE).withColumn("amount", grid.notional(F.col("price"), F.col("qty"), CASH)).withColumn("tenths", F.explode(F.lit([0, 20, 100, -5])))
    return rows.groupBy("symbol_id", "tenths").agg(F.sum("amount").alias("notional"), F.sum(grid.fee(F.col("amount"), F.col("tenths").cast("long"))).alias("fees"))


@query("utc_day_counts", "symbol_id:l day:l date:s n:l", """;SELECT user_id % 4 AS symbol_id, epoch_us(ts) // 86400000000 AS day, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def utc_day_counts(spark, sf_dir):
    """Events per UTC day number and date."""
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("symbol_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rows.groupBy("symbol_id", grid.utc_day(F.col("t")).alias("day"), grid.utc_date(F.col("t")).alias("date")).agg(F.count("*").alias("n"))


@query("queue_fractions", "l_suppkey:l fraction:d", """;SELECT l_suppkey, sum(CASE WHEN l_linenumber + l_partkey % 7 = 0 THEN 0 ELSE CAST(l_linenumber AS DOUBLE) / (l_linenumber + l_partkey % 7) END) AS fraction FROM lineitem GROUP BY 1""")
def queue_fractions(spark, sf_dir):
    """Share of a level ahead of an order, 0 for an empty level."""
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(grid.queue_fraction(F.col("l_linenumber"), F.col("l_partkey") % 7, F.lit(0))).alias("fraction"))


# --- sequence protocol, order -----------------------------------------------------------------------------------------


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change stream with update ids, breaks, stale updates and snapshots at fixed places; symbols 0 and 1 have previous ids."""
    e = read(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 4).alias("symbol_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.floor(F.col("event_id") / sync.STRETCH).alias("part"))
    rows = carried(rows, ["symbol_id"], "part", ["event_id"], sums={"ln": F.lit(1)})
    at = lambda n: F.col("event_id") % n == 0
    kind = F.when(at(251), "snapshot").when(F.col("event_id") % 5 == 4, "trade").otherwise("depth")
    skip = F.when(at(97), 5).otherwise(0)
    final = F.when(kind == "trade", None).when(at(89), F.col("ln") * 10 - 100).otherwise(F.col("ln") * 10)
    return rows.select("symbol_id", "ln", "ts_us", kind.alias("kind"), (F.col("ln") * 10 - 9 + skip).alias("first_id"), final.alias("final_id"), F.when((F.col("symbol_id") < 2) & ~at(251), F.col("ln") * 10 - 10 + skip).alias("prev_id"))


@query("sync_gaps", "symbol_id:l ln:l ts_us:l expected:l got:l reason:s", SQL_MESSAGES + """;SELECT symbol_id, ln, ts_us, CASE WHEN earlier > 0 AND futures AND prev_id IS NOT NULL THEN last ELSE last + 1 END AS expected, CASE WHEN earlier > 0 AND futures AND prev_id IS NOT NULL THEN prev_id ELSE first_id END AS got,
  CASE WHEN earlier = 0 THEN 'first update doesn''t bracket the snapshot' WHEN futures AND prev_id IS NOT NULL THEN 'futures: pu doesn''t match' ELSE 'spot: U doesn''t follow' END AS reason FROM synced WHERE gap""")
def sync_gaps(spark, sf_dir):
    """Breaks in the update sequence."""
    return sync.gaps(sync.synchronised(messages(spark, sf_dir)))


@query("sync_stats", "symbol_id:l n_messages:l n_snapshots:l n_accepted:l n_stale:l n_presync:l n_gaps:l n_resyncs:l n_dirty:l n_kept:l", SQL_MESSAGES + """;SELECT symbol_id, count(*) AS n_messages, count(*) FILTER (kind = 'snapshot') AS n_snapshots, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (kind = 'depth' AND epoch > 0 AND NOT accepted) AS n_stale,
  count(*) FILTER (kind = 'depth' AND epoch = 0) AS n_presync, count(*) FILTER (gap) AS n_gaps, count(*) FILTER (resynced) AS n_resyncs, count(*) FILTER (dirty AND (accepted OR kind <> 'depth')) AS n_dirty, count(*) FILTER (accepted OR kind <> 'depth') AS n_kept FROM synced GROUP BY 1""")
def sync_stats(spark, sf_dir):
    """Counters of a conversion."""
    return sync.statistics(sync.synchronised(messages(spark, sf_dir)))


@query("gaps_by_reason", "symbol_id:l reason:s n:l", SQL["sync_gaps"].replace("WITH ", "", 1).rpartition(" SELECT CAST(symbol_id")[0] + ";SELECT symbol_id, reason, count(*) AS n FROM (SELECT CAST(symbol_id" + SQL["sync_gaps"].rpartition(" SELECT CAST(symbol_id")[2] + ") GROUP BY 1, 2")
def gaps_by_reason(spark, sf_dir):
    """Counts of gaps."""
    return sync_gaps(spark, sf_dir).groupBy("symbol_id", "reason").agg(F.count("*").alias("n"))


@query("recorder_breaks", "symbol_id:l ln:l expected:l got:l", SQL_MESSAGES + """;SELECT symbol_id, ln, expected, got FROM (SELECT symbol_id, ln, CASE WHEN prev_id IS NOT NULL THEN b ELSE b + 1 END AS expected, coalesce(prev_id, first_id) AS got, b FROM
  (SELECT *, lag(final_id) OVER (PARTITION BY symbol_id, ln // 1000 ORDER BY ln) AS b FROM messages WHERE kind = 'depth')) WHERE b IS NOT NULL AND got <> expected""")
def recorder_breaks(spark, sf_dir):
    """Breaks as a recorder logs them, connections of 1000 messages."""
    return sync.recorder_gaps(messages(spark, sf_dir).withColumn("connection", F.floor(F.col("ln") / 1000)))


@query("replay_order", "symbol_id:l idx:l seq:l ts_us:l type:l price:l qty:l", SQL_MD + ";SELECT symbol_id, idx, seq, ts_us, type, price, qty FROM md")
def replay_order(spark, sf_dir):
    """The total order of replay: time, then prints before updates, then arrival."""
    return market_events(spark, sf_dir)


@query("monotone_visibility", "symbol_id:l idx:l visible_us:l", SQL_MD + ";SELECT symbol_id, idx, max(ts_us + 50000 + seq % 7 * 10000) OVER (PARTITION BY symbol_id ORDER BY idx) AS visible_us FROM md")
def monotone_visibility(spark, sf_dir):
    """When events become visible under a varying delay, never out of order."""
    return sync.visibility(market(spark, sf_dir), F.lit(50000) + F.col("seq") % 7 * 10000)


@query("timer_ticks", "symbol_id:l n:l first_us:l last_us:l", SQL_MD + """;SELECT symbol_id, (max(ts_us) - min(ts_us)) // 60000000 AS n, min(ts_us) + 60000000 AS first_us, min(ts_us) + (max(ts_us) - min(ts_us)) // 60000000 * 60000000 AS last_us FROM md GROUP BY 1""")
def timer_ticks(spark, sf_dir):
    """Timers from a period after the first event."""
    return sync.timers(market(spark, sf_dir), 60_000_000).groupBy("symbol_id").agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market events as a table, for plans that read them more than once."""
    return written(market_events(spark, sf_dir), "market")


# --- book -------------------------------------------------------------------------------------------------------------


@query("bbo", "symbol_id:l idx:l best_bid:l best_ask:l bid_qty:l ask_qty:l mid_x2:l", SQL_BOOK + ";SELECT * FROM best")
def bbo(spark, sf_dir):
    """Best prices and quantities after every event."""
    return book.bbo(market(spark, sf_dir))


@query("depth_within_5", "symbol_id:l idx:l bid_depth:l ask_depth:l", SQL_BOOK + """,
tops AS (SELECT *, max(price) OVER (PARTITION BY symbol_id, idx, side) AS hi, min(price) OVER (PARTITION BY symbol_id, idx, side) AS lo FROM live )
;SELECT p.symbol_id, p.idx, coalesce(sum(qty) FILTER (side = 0 AND hi - price <= 5), 0) AS bid_depth, coalesce(sum(qty) FILTER (side = 1 AND price - lo <= 5), 0) AS ask_depth FROM (SELECT symbol_id, idx FROM md) p LEFT JOIN tops t ON p.symbol_id = t.symbol_id AND p.idx = t.idx GROUP BY 1, 2""")
def depth_within_5(spark, sf_dir):
    """Quantity within five ticks of the touch after every event."""
    md = market(spark, sf_dir)
    return book.depth_within(md, md, 5)


@query("imbalance_wmid", "symbol_id:l idx:l imbalance:d weighted_mid:d spread:l", SQL_BOOK + """,
shares AS (SELECT *, CASE WHEN coalesce(bid_qty, 0) + coalesce(ask_qty, 0) = 0 THEN 0.5 ELSE CAST(coalesce(bid_qty, 0) AS DOUBLE) / (coalesce(bid_qty, 0) + coalesce(ask_qty, 0)) END AS imbalance FROM best)
;SELECT symbol_id, idx, imbalance, imbalance * best_ask + (1 - imbalance) * best_bid AS weighted_mid, best_ask - best_bid AS spread FROM shares WHERE mid_x2 IS NOT NULL""")
def imbalance_wmid(spark, sf_dir):
    """Top imbalance, weighted mid and spread."""
    rows = book.bbo(market(spark, sf_dir)).where("mid_x2 is not null").withColumn("imbalance", book.imbalance(F.col("bid_qty"), F.col("ask_qty")))
    return rows.withColumn("weighted_mid", book.weighted_mid(F.col("best_bid"), F.col("best_ask"), F.col("imbalance"))).withColumn("spread", F.col("best_ask") - F.col("best_bid"))


@query("book_invariants", "n_events:l n_violations:l n_one_sided:l", SQL_BOOK + ";SELECT count(*) AS n_events, count(*) FILTER (best_bid >= best_ask OR bid_qty <= 0 OR ask_qty <= 0) AS n_violations, count(*) FILTER (mid_x2 IS NULL) AS n_one_sided FROM best")
def book_invariants(spark, sf_dir):
    """How often the book is crossed or empty on a side."""
    best = book.bbo(market(spark, sf_dir))
    return best.agg(F.count("*").alias("n_events"), F.count_if(F.expr("best_bid >= best_ask or bid_qty <= 0 or ask_qty <= 0")).alias("n_violations"), F.count_if(F.col("mid_x2").isNull()).alias("n_one_sided"))


@query("level_lifetimes", "symbol_id:l side:l price:l n:l events_alive:l max_qty:l", SQL_BOOK + ";SELECT symbol_id, side, price, count(*) AS n, sum(to_idx - from_idx) AS events_alive, max(qty) AS max_qty FROM spans GROUP BY 1, 2, 3")
def level_lifetimes(spark, sf_dir):
    """How long levels hold their quantities."""
    return book.levels(market(spark, sf_dir)).groupBy("symbol_id", "side", "price").agg(F.count("*").alias("n"), F.sum(F.col("to_idx") - F.col("from_idx")).alias("events_alive"), F.max("qty").alias("max_qty"))


@query("level_counts", "symbol_id:l side:l idx:l n:l", SQL_BOOK + """,
steps AS (SELECT symbol_id, side, idx, sum(d) AS d FROM (SELECT symbol_id, side, from_idx AS idx, 1 AS d FROM spans UNION ALL SELECT symbol_id, side, to_idx, -1 FROM spans) GROUP BY 1, 2, 3)
;SELECT symbol_id, side, idx, sum(d) OVER (PARTITION BY symbol_id, side ORDER BY idx) AS n FROM steps""")
def level_counts(spark, sf_dir):
    """Live levels per side over time."""
    return book.level_counts(market(spark, sf_dir))


@query("mid_changes", "symbol_id:l idx:l ts_us:l mid_x2:l", SQL_BOOK + ";SELECT symbol_id, idx, ts_us, mid_x2 FROM marks")
def mid_changes(spark, sf_dir):
    """Moments at which the mid moves."""
    return book.mid_changes(book.bbo(market(spark, sf_dir)))


# --- estimators -------------------------------------------------------------------------------------------------------

SAMPLE_US, WINDOW_US = 60_000_000, 1_800_000_000


@query("rolling_sigma", "symbol_id:l idx:l n:l sigma:d", SQL_BOOK.replace("raw_events AS", "RECURSIVE raw_events AS", 1) + f""",
obs AS MATERIALIZED (SELECT symbol_id, ts_us // 86400000000 AS day, ts_us, idx, mid_x2, row_number() OVER (PARTITION BY symbol_id, ts_us // 86400000000 ORDER BY ts_us, idx) AS r FROM best WHERE mid_x2 IS NOT NULL),
nexts AS MATERIALIZED (SELECT a.symbol_id, a.day, a.r, min(b.r) AS nxt FROM obs a LEFT JOIN obs b ON a.symbol_id = b.symbol_id AND a.day = b.day AND b.ts_us >= a.ts_us + {SAMPLE_US} GROUP BY 1, 2, 3),
chain AS (SELECT symbol_id, day, CAST(1 AS BIGINT) AS r FROM obs WHERE r = 1 UNION ALL SELECT c.symbol_id, c.day, n.nxt FROM chain c JOIN nexts n ON c.symbol_id = n.symbol_id AND c.day = n.day AND c.r = n.r WHERE n.nxt IS NOT NULL),
kept AS (SELECT o.*, pow((o.mid_x2 - lag(o.mid_x2) OVER w) / 2.0, 2) AS d2, (o.ts_us - lag(o.ts_us) OVER w) / 1e6 AS dt FROM obs o JOIN chain USING (symbol_id, day, r) WINDOW w AS (PARTITION BY o.symbol_id, o.day ORDER BY o.ts_us))
;SELECT symbol_id, idx, count(d2) OVER t AS n, sqrt(coalesce(sum(d2) OVER t / sum(dt) OVER t, 0)) AS sigma FROM kept WINDOW t AS (PARTITION BY symbol_id, day ORDER BY ts_us RANGE BETWEEN {WINDOW_US} PRECEDING AND CURRENT ROW)""")
def rolling_sigma(spark, sf_dir):
    """Volatility from greedily spaced mids over a trailing window, per instrument and day."""
    best = book.bbo(market(spark, sf_dir)).where("mid_x2 is not null").withColumn("day", grid.utc_day(F.col("ts_us")))
    return rolling.sigma(rolling.spaced(best, SAMPLE_US), WINDOW_US)


@query("flow_imbalance", "symbol_id:l idx:l volume:l net:l imbalance:d", SQL_MD + f""";SELECT symbol_id, idx, sum(qty) OVER w AS volume, sum(CASE side WHEN 0 THEN qty ELSE -qty END) OVER w AS net, CAST(sum(CASE side WHEN 0 THEN qty ELSE -qty END) OVER w AS DOUBLE) / sum(qty) OVER w AS imbalance
  FROM md WHERE type = 1 WINDOW w AS (PARTITION BY symbol_id ORDER BY ts_us RANGE BETWEEN {WINDOW_US} PRECEDING AND CURRENT ROW)""")
def flow_imbalance(spark, sf_dir):
    """Signed share of aggressive volume over a trailing window."""
    return rolling.flow(market(spark, sf_dir).where(F.col("type") == TRADE), WINDOW_US)


@query("toxicity_pulls", "symbol_id:l idx:l trigger_us:l pulled:l", SQL_MD + f""",
flow AS (SELECT symbol_id, idx, ts_us, CAST(sum(CASE side WHEN 0 THEN qty ELSE -qty END) OVER w AS DOUBLE) / sum(qty) OVER w AS imbalance FROM md WHERE type = 1 WINDOW w AS (PARTITION BY symbol_id ORDER BY ts_us RANGE BETWEEN {WINDOW_US} PRECEDING AND CURRENT ROW)),
hits AS (SELECT *, last_value(CASE WHEN abs(imbalance) >= 0.6 THEN ts_us END IGNORE NULLS) OVER o AS trigger_us, last_value(CASE WHEN abs(imbalance) >= 0.6 THEN CASE WHEN imbalance > 0 THEN 1 ELSE 0 END END IGNORE NULLS) OVER o AS trigger_side FROM flow WINDOW o AS (PARTITION BY symbol_id ORDER BY ts_us, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
;SELECT symbol_id, idx, trigger_us, CASE WHEN ts_us < trigger_us + 600000000 THEN trigger_side END AS pulled FROM hits""")
def toxicity_pulls(spark, sf_dir):
    """The quote side that one-sided flow pulls, and since when."""
    return rolling.pulls(rolling.flow(market(spark, sf_dir).where(F.col("type") == TRADE), WINDOW_US), 0.6, 600_000_000)


# --- fills, ledger, markouts ------------------------------------------------------------------------------------------


def fills_and_marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every print as a fill of the resting side at its mid, and the moves of the mid. Both read one written table."""
    md = market(spark, sf_dir)
    trade = F.when(F.col("type") == TRADE, F.struct("side", "price", "qty"))
    best = book.bbo(md).where("mid_x2 is not null").join(md.select("symbol_id", "idx", trade.alias("t")), ["symbol_id", "idx"])
    best = written(best.select("symbol_id", "idx", "ts_us", "mid_x2", "t"), "mids")
    fills = best.where("t is not null").select("symbol_id", F.col("idx").alias("fill_id"), "ts_us", (1 - F.col("t.side")).alias("side"), "t.price", "t.qty", "mid_x2")
    return fills, written(book.mid_changes(best.drop("t")), "marks")


def book_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills, marks = fills_and_marks(spark, sf_dir)
    return ledger.running(fills.withColumn("seq", F.col("fill_id")).withColumn("maker", F.lit(True)), marks.withColumn("seq", F.col("idx")), CASH)


SQL_LEDGER = SQL_FILLS + """,
line AS (SELECT symbol_id, ts_us, fill_id AS seq, 1 AS is_fill, CASE side WHEN 0 THEN qty ELSE -qty END AS bought, price * qty * 100000 AS amount, side, price, qty, mid_x2 FROM fills
  UNION ALL SELECT symbol_id, ts_us, idx, 0, 0, 0, NULL, NULL, 0, mid_x2 FROM marks),
costed AS (SELECT *, CASE is_fill WHEN 1 THEN (amount * 20 + 50000) // 100000 ELSE 0 END AS fee, CASE is_fill WHEN 1 THEN (1 - 2 * side) * (mid_x2 - 2 * price) * qty * 100000 ELSE 0 END AS spread FROM line),
held AS (SELECT *, sum(bought) OVER w AS inventory, lag(mid_x2) OVER (PARTITION BY symbol_id ORDER BY ts_us, seq, is_fill) AS mid_before FROM costed WINDOW w AS (PARTITION BY symbol_id ORDER BY ts_us, seq, is_fill)),
moved AS (SELECT *, coalesce((inventory - bought) * (mid_x2 - mid_before) * 100000, 0) AS moved FROM held),
book_rows AS (SELECT *, sum(-2 * sign(bought) * amount - 2 * fee) OVER w AS cash_x2, sum(spread) OVER w AS spread_x2, sum(moved) OVER w AS inventory_x2, sum(2 * fee) OVER w AS fees_x2 FROM moved WINDOW w AS (PARTITION BY symbol_id ORDER BY ts_us, seq, is_fill)),
ledger AS (SELECT *, cash_x2 + inventory * mid_x2 * 100000 AS equity_x2 FROM book_rows)"""


@query("ledger_running", "symbol_id:l seq:l is_fill:l inventory:l cash_x2:l spread_x2:l inventory_x2:l fees_x2:l equity_x2:l", SQL_LEDGER + ";SELECT * FROM ledger")
def ledger_running(spark, sf_dir):
    """Inventory, cash and the parts of profit after every fill and mark."""
    return book_ledger(spark, sf_dir)


@query("identity_residual", "symbol_id:l n:l n_off:l worst:l", SQL_LEDGER + ";SELECT symbol_id, count(*) AS n, count(*) FILTER (equity_x2 <> spread_x2 + inventory_x2 - fees_x2) AS n_off, max(abs(equity_x2 - (spread_x2 + inventory_x2 - fees_x2))) AS worst FROM ledger GROUP BY 1")
def identity_residual(spark, sf_dir):
    """Equity is always exactly the sum of its parts."""
    return book_ledger(spark, sf_dir).groupBy("symbol_id").agg(F.count("*").alias("n"), F.count_if(F.col("residual_x2") != 0).alias("n_off"), F.max(F.abs("residual_x2")).alias("worst"))


SQL_DAILY = SQL_LEDGER + """,
days AS (SELECT symbol_id, strftime(make_timestamp(CAST(ts_us AS BIGINT)), '%Y-%m-%d') AS date, sum(spread) AS spread_x2, sum(moved) AS inventory_x2, sum(2 * fee) AS fees_x2, sum(is_fill) AS n_fills, sum(amount) AS notional,
  arg_max(inventory, struct_pack(t := ts_us, s := seq, f := is_fill)) AS end_inventory, arg_max(equity_x2, struct_pack(t := ts_us, s := seq, f := is_fill)) AS end_equity_x2 FROM ledger GROUP BY 1, 2),
daily AS (SELECT *, end_equity_x2 - coalesce(lag(end_equity_x2) OVER (PARTITION BY symbol_id ORDER BY date), 0) AS change_x2 FROM days)"""


@query("pnl_daily", "symbol_id:l date:s n_fills:l notional:l spread_x2:l inventory_x2:l fees_x2:l end_inventory:l change_x2:l residual_x2:l", SQL_DAILY + ";SELECT *, change_x2 - (spread_x2 + inventory_x2 - fees_x2) AS residual_x2 FROM daily")
def pnl_daily(spark, sf_dir):
    """Daily profit by part, with the change of equity over the day."""
    return ledger.daily(book_ledger(spark, sf_dir))


@query("sharpe_daily", "symbol_id:l n_days:l sharpe:d", SQL_DAILY + ";SELECT symbol_id, count(*) AS n_days, CASE WHEN count(*) >= 2 AND stddev_samp(change_x2) > 0 THEN avg(change_x2) / stddev_samp(change_x2) * sqrt(365) ELSE 'nan'::DOUBLE END AS sharpe FROM (SELECT symbol_id, CAST(change_x2 AS DOUBLE) AS change_x2 FROM daily) GROUP BY 1")
def sharpe_daily(spark, sf_dir):
    """Annualised ratio of daily profit to its spread."""
    return report.sharpe(ledger.daily(book_ledger(spark, sf_dir)).withColumn("pnl", F.col("change_x2").cast("double")), "pnl", "symbol_id")


@query("inventory_path", "symbol_id:l fill_id:l inventory:l", SQL_FILLS + ";SELECT symbol_id, fill_id, sum(CASE side WHEN 0 THEN qty ELSE -qty END) OVER (PARTITION BY symbol_id ORDER BY ts_us, fill_id) AS inventory FROM fills")
def inventory_path(spark, sf_dir):
    """Cumulative signed quantity over fills."""
    fills, _ = fills_and_marks(spark, sf_dir)
    own = Window.partitionBy("symbol_id").orderBy("ts_us", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    return fills.withColumn("inventory", F.sum(grid.sign(F.col("side")) * F.col("qty")).over(own))


def priced_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills, marks = fills_and_marks(spark, sf_dir)
    return markout.priced(markout.samples(fills, marks, HORIZONS))


@query("markout_samples", "symbol_id:l fill_id:l horizon_us:l side:l resolved:b mid_x2_at:l edge_x2:l adverse_x2:l markout_x2:l", SQL_SAMPLES + ";SELECT *, edge_x2 + adverse_x2 AS markout_x2 FROM priced")
def markout_samples(spark, sf_dir):
    """Every fill at every horizon with the mid in force then."""
    return priced_samples(spark, sf_dir)


_MEANS = "count(*) FILTER (resolved) AS n_resolved, count(*) FILTER (NOT resolved) AS n_unresolved, coalesce(avg(10000.0 * edge_x2 / notional) FILTER (resolved), 0) AS edge_bp, coalesce(avg(10000.0 * adverse_x2 / notional) FILTER (resolved), 0) AS adverse_bp, coalesce(avg(10000.0 * (edge_x2 + adverse_x2) / notional) FILTER (resolved), 0) AS markout_bp"


@query("markout_summary", "horizon_us:l n_resolved:l n_unresolved:l edge_bp:d adverse_bp:d markout_bp:d", SQL_SAMPLES + f";SELECT horizon_us, {_MEANS} FROM priced GROUP BY 1")
def markout_summary(spark, sf_dir):
    """Markouts per horizon."""
    return markout.summary(priced_samples(spark, sf_dir), "horizon_us")


@query("markout_curve", "symbol_id:l side:s horizon_us:l n_resolved:l n_unresolved:l edge_bp:d adverse_bp:d markout_bp:d", SQL_SAMPLES + f";SELECT symbol_id, CASE side WHEN 0 THEN 'BID' ELSE 'ASK' END AS side, horizon_us, {_MEANS} FROM priced GROUP BY 1, 2, 3")
def markout_curve(spark, sf_dir):
    """Markouts per instrument, side and horizon (A09, A10): the flagship."""
    rows = priced_samples(spark, sf_dir).withColumn("side", grid.side_name(F.col("side")))
    return markout.summary(rows, "symbol_id", "side", "horizon_us")


# --- queue position, fills of resting orders --------------------------------------------------------------------------

EVERY_US, DEPTHS, ORDER_QTY, REST_US = 6 * 3_600_000_000, [1, 2, 3, 5], 20, 1_800_000_000

def sql_probes(depths: list[int]) -> str:
    return SQL_BOOK + f""",
placed_at AS (SELECT *, CASE WHEN coalesce(bid_qty, 0) + coalesce(ask_qty, 0) = 0 THEN 0.5 ELSE CAST(bid_qty AS DOUBLE) / (bid_qty + ask_qty) END AS imbalance FROM best WHERE mid_x2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id, ts_us // {EVERY_US} ORDER BY idx) = 1),
probes AS (SELECT symbol_id, idx, ts_us, side, depth, CASE side WHEN 0 THEN best_bid - (depth - 1) ELSE best_ask + (depth - 1) END AS price, {ORDER_QTY} AS qty, mid_x2, imbalance, symbol_id || '-' || idx || '-' || side || '-' || depth AS order_id
  FROM placed_at CROSS JOIN (SELECT unnest([0, 1]) AS side) CROSS JOIN (SELECT unnest({depths}) AS depth))"""


SQL_PROBES = sql_probes(DEPTHS)


def resting(spark: SparkSession, sf_dir: str, depths: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    md = market(spark, sf_dir)
    best = written(book.bbo(md), "best")
    return written(queue.placed(queue.probes(best, EVERY_US, depths or DEPTHS, ORDER_QTY), book.levels(md)), "orders"), md, best


def sql_queue(model: str) -> str:
    """The fold of one model as a recursion over each order's events."""
    n = "least(cancel, a + b)"
    share = f"CASE WHEN a + b = 0 THEN 0 ELSE least(a, (2 * {n} * a + a + b) // (2 * (a + b))) END"
    ahead, behind = {
        "PESS": ("greatest(a - greatest(cancel - b, 0), 0)", "greatest(b - cancel, 0)"),
        "OPT": ("greatest(a - cancel, 0)", "greatest(b - greatest(cancel - a, 0), 0)"),
        "PROP": (f"a - ({share})", f"greatest(b - ({n} - ({share})), 0)"),
    }[model]
    on, trade = "rem > 0", "t = 1"
    return SQL_PROBES.replace("raw_events AS", "RECURSIVE raw_events AS", 1) + f""",
placed AS (SELECT p.*, coalesce(s.qty, 0) AS ahead FROM probes p LEFT JOIN spans s ON p.symbol_id = s.symbol_id AND p.side = s.side AND p.price = s.price AND s.from_idx <= p.idx AND p.idx < s.to_idx),
own AS MATERIALIZED (SELECT p.order_id, row_number() OVER (PARTITION BY p.order_id ORDER BY m.idx) AS r, m.idx, m.ts_us, m.type AS t, m.qty AS q FROM placed p JOIN md m ON m.symbol_id = p.symbol_id AND m.price = p.price AND CASE m.type WHEN 1 THEN 1 - m.side ELSE m.side END = p.side AND m.idx > p.idx AND m.ts_us <= p.ts_us + {REST_US}),
states AS (SELECT order_id, CAST(0 AS BIGINT) AS r, CAST(ahead AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(qty AS BIGINT) AS rem, CAST(ahead AS BIGINT) AS v, CAST(0 AS BIGINT) AS c, CAST(-1000000000000000 AS BIGINT) AS g, CAST(0 AS BIGINT) AS f, CAST(NULL AS BIGINT) AS w, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS z FROM placed
  UNION ALL SELECT order_id, r, CASE WHEN {on} AND {trade} THEN greatest(a - q, 0) WHEN {on} AND cancel > 0 THEN {ahead} ELSE a END, CASE WHEN {on} AND {trade} THEN greatest(b - past, 0) WHEN {on} THEN CASE WHEN cancel > 0 THEN {behind} ELSE b END + greatest(q - v, 0) ELSE b END,
    CASE WHEN {on} AND {trade} THEN rem - fill ELSE rem END, CASE WHEN {on} AND NOT {trade} THEN q ELSE v END, CASE WHEN {on} AND {trade} THEN fresh + q WHEN {on} THEN fresh - used ELSE c END, CASE WHEN {on} AND {trade} THEN ts_us ELSE g END,
    CASE WHEN {on} AND {trade} THEN f + fill ELSE f END, CASE WHEN {on} AND {trade} AND fill > 0 THEN coalesce(w, ts_us) ELSE w END, CASE WHEN {on} AND NOT {trade} THEN k + used ELSE k END, CASE WHEN {on} AND NOT {trade} THEN x + cancel ELSE x END, CASE WHEN {on} THEN z + c - fresh ELSE z END
  FROM (SELECT *, greatest(v - q, 0) - used AS cancel FROM (SELECT *, least(greatest(v - q, 0), fresh) AS used FROM (SELECT s.*  EXCLUDE (r), o.r, o.ts_us, o.t, o.q, CASE WHEN o.ts_us - s.g > 250000 THEN 0 ELSE s.c END AS fresh, least(greatest(o.q - s.a, 0), s.rem) AS fill, greatest(o.q - s.a - s.rem, 0) AS past FROM states s JOIN own o ON o.order_id = s.order_id AND o.r = s.r + 1)))),
followed AS (SELECT p.*, l.a AS ahead_end, l.b AS behind_end, l.f AS filled, l.w AS first_fill_us, l.k AS explained, l.x AS cancels, l.z AS expired FROM placed p JOIN (SELECT order_id, unnest(arg_max(struct_pack(a, b, f, w, k, x, z), r)) FROM states GROUP BY 1) l USING (order_id))"""


def _followed(model: str):
    def plan(spark, sf_dir):
        orders, md, _ = resting(spark, sf_dir)
        return queue.follow(orders, md, model, REST_US)

    plan.__doc__ = f"Queue position and fills of probe orders under the {model} model of cancels (Q01 to Q08, Q10)."
    return plan


_FOLLOWED = "order_id:s symbol_id:l side:l depth:l price:l ahead:l ahead_end:l behind_end:l filled:l first_fill_us:l explained:l cancels:l expired:l"
for _model in queue.MODELS:
    query(f"queue_{_model.lower()}", _FOLLOWED, sql_queue(_model) + ";SELECT * FROM followed")(_followed(_model))


@query("probe_placement", "order_id:s ahead:l price:l", SQL_PROBES + ";SELECT order_id, p.price, coalesce(s.qty, 0) AS ahead FROM probes p LEFT JOIN spans s ON p.symbol_id = s.symbol_id AND p.side = s.side AND p.price = s.price AND s.from_idx <= p.idx AND p.idx < s.to_idx")
def probe_placement(spark, sf_dir):
    """Probe orders on both sides at several depths and the quantity ahead of them."""
    return resting(spark, sf_dir)[0]


@query("queue_stats", "depth:l placements:l filled_orders:l filled_lots:l explained:l cancels:l expired:l residual:d", sql_queue("PESS") + """;SELECT depth, count(*) AS placements, count(*) FILTER (filled > 0) AS filled_orders, sum(filled) AS filled_lots, sum(explained) AS explained, sum(cancels) AS cancels, sum(expired) AS expired, CASE WHEN sum(explained) + sum(expired) = 0 THEN 0 ELSE CAST(sum(expired) AS DOUBLE) / (sum(explained) + sum(expired)) END AS residual FROM followed GROUP BY 1""")
def queue_stats(spark, sf_dir):
    """Totals of the pessimistic model per depth; residual: share of print credit that expired unseen (Q10)."""
    rows = _followed("PESS")(spark, sf_dir)
    out = rows.groupBy("depth").agg(F.count("*").alias("placements"), F.count_if(F.col("filled") > 0).alias("filled_orders"), F.sum("filled").alias("filled_lots"), F.sum("explained").alias("explained"), F.sum("cancels").alias("cancels"), F.sum("expired").alias("expired"))
    return out.withColumn("residual", F.coalesce(F.try_divide(F.col("expired"), F.col("explained") + F.col("expired")), F.lit(0.0)))


_TOUCHED = f""",
met AS (SELECT p.order_id, p.symbol_id, p.side, p.depth, p.price, t.idx AS t_idx, t.ts_us AS t_us, p.qty, t.qty AS t_qty, coalesce(sum(t.qty) OVER (PARTITION BY order_id ORDER BY t.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM probes p JOIN md t ON t.symbol_id = p.symbol_id AND t.type = 1 AND t.side = 1 - p.side AND t.idx > p.idx AND t.ts_us <= p.ts_us + {REST_US} AND CASE p.side WHEN 0 THEN t.price <= p.price ELSE t.price >= p.price END),
touched AS (SELECT *, greatest(least(t_qty, qty - before), 0) AS fill FROM met)"""
_SQL_TOUCH = SQL_PROBES + _TOUCHED


@query("touch_fills", "order_id:s t_idx:l t_us:l fill:l", _SQL_TOUCH + ";SELECT * FROM touched WHERE fill > 0")
def touch_fills(spark, sf_dir):
    """Fills under the touch rule."""
    orders, md, _ = resting(spark, sf_dir)
    return queue.touch_fills(orders, md, REST_US)


@query("touch_vs_queue", "depth:l touch_lots:l queue_lots:l ratio:d", sql_queue("PESS") + _TOUCHED + """,
lots AS (SELECT order_id, sum(fill) AS lots FROM touched GROUP BY 1)
;SELECT depth, sum(coalesce(lots, 0)) AS touch_lots, sum(filled) AS queue_lots, CASE WHEN sum(filled) = 0 THEN 0 ELSE CAST(sum(coalesce(lots, 0)) AS DOUBLE) / sum(filled) END AS ratio FROM followed LEFT JOIN lots USING (order_id) GROUP BY 1""")
def touch_vs_queue(spark, sf_dir):
    """How much more the touch rule fills than the queue model."""
    orders, md, _ = resting(spark, sf_dir)
    touch = orders.join(queue.touch_fills(orders, md, REST_US).groupBy("order_id").agg(F.sum("fill").alias("lots")), "order_id", "left").select("order_id", "depth", F.coalesce("lots", F.lit(0)).alias("lots"))
    waited = queue.follow(orders, md, "PESS", REST_US).select("order_id", "depth", F.col("filled").alias("lots"))
    out = report.paired(touch, waited, ["order_id", "depth"], "lots").groupBy("depth").agg(F.sum("lots_touch").alias("touch_lots"), F.sum("lots_queue").alias("queue_lots"))
    return out.withColumn("ratio", F.coalesce(F.try_divide(F.col("touch_lots").cast("double"), F.col("queue_lots").cast("double")), F.lit(0.0)))


INSIDE = [1, 0, -1, -3, -6]


@query("cross_fills", "order_id:s cross_idx:l cross_us:l", sql_probes(INSIDE) + f""";SELECT order_id, min(b.idx) AS cross_idx, min(b.ts_us) AS cross_us FROM probes p JOIN best b ON b.symbol_id = p.symbol_id AND b.idx > p.idx AND b.ts_us <= p.ts_us + {REST_US} AND CASE p.side WHEN 0 THEN b.best_ask <= p.price ELSE b.best_bid >= p.price END GROUP BY 1""")
def cross_fills(spark, sf_dir):
    """Orders, some of them better than the touch, that the opposite touch reaches."""
    orders, _, best = resting(spark, sf_dir, INSIDE)
    return queue.cross_fills(orders, best, REST_US)


SQL_OUTCOMES = sql_queue("PESS") + f""",
outcomes AS (SELECT f.*, h.h AS horizon_us, coalesce(first_fill_us - ts_us <= h.h, false) AS hit, coalesce(first_fill_us - ts_us, -1) AS time_to_fill_us, CASE WHEN ahead + qty = 0 THEN 0 ELSE CAST(ahead AS DOUBLE) / (ahead + qty) END AS queue_fraction, ts_us + h.h <= end_us AS whole
  FROM followed f JOIN (SELECT symbol_id, max(ts_us) AS end_us FROM md GROUP BY 1) e USING (symbol_id) CROSS JOIN (SELECT unnest([60000000, 600000000, {REST_US}]) AS h) h)"""

SQL_SIGMA = f""",
obs AS MATERIALIZED (SELECT symbol_id, ts_us // 86400000000 AS day, ts_us, idx, mid_x2, row_number() OVER (PARTITION BY symbol_id, ts_us // 86400000000 ORDER BY ts_us, idx) AS r FROM best WHERE mid_x2 IS NOT NULL),
nexts AS MATERIALIZED (SELECT a.symbol_id, a.day, a.r, min(b.r) AS nxt FROM obs a LEFT JOIN obs b ON a.symbol_id = b.symbol_id AND a.day = b.day AND b.ts_us >= a.ts_us + {SAMPLE_US} GROUP BY 1, 2, 3),
chain AS (SELECT symbol_id, day, CAST(1 AS BIGINT) AS r FROM obs WHERE r = 1 UNION ALL SELECT c.symbol_id, c.day, n.nxt FROM chain c JOIN nexts n ON c.symbol_id = n.symbol_id AND c.day = n.day AND c.r = n.r WHERE n.nxt IS NOT NULL),
kept AS (SELECT o.*, pow((o.mid_x2 - lag(o.mid_x2) OVER w) / 2.0, 2) AS d2, (o.ts_us - lag(o.ts_us) OVER w) / 1e6 AS dt FROM obs o JOIN chain USING (symbol_id, day, r) WINDOW w AS (PARTITION BY o.symbol_id, o.day ORDER BY o.ts_us)),
vol AS (SELECT symbol_id, idx, sqrt(coalesce(sum(d2) OVER t / sum(dt) OVER t, 0)) AS sigma FROM kept WINDOW t AS (PARTITION BY symbol_id, day ORDER BY ts_us RANGE BETWEEN {WINDOW_US} PRECEDING AND CURRENT ROW))"""


def probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, md, _ = resting(spark, sf_dir)
    ends = md.groupBy("symbol_id").agg(F.max("ts_us").alias("end_us"))
    return queue.outcomes(queue.follow(orders, md, "PESS", REST_US), [60_000_000, 600_000_000, REST_US], ends)


def volatility(best: DataFrame) -> DataFrame:
    """symbol_id, ts_us, idx, sigma at each spaced observation."""
    two = best.where("mid_x2 is not null").withColumn("day", grid.utc_day(F.col("ts_us")))
    return rolling.sigma(rolling.spaced(two, SAMPLE_US), WINDOW_US).select("symbol_id", "ts_us", "idx", "sigma")


@query("probe_outcomes", "order_id:s horizon_us:l hit:b time_to_fill_us:l whole:b", SQL_OUTCOMES + ";SELECT * FROM outcomes")
def probe_outcomes(spark, sf_dir):
    """Each probe at each horizon (Q16)."""
    return probe_rows(spark, sf_dir)


@query("probe_table", "order_id:s date:s side:s depth:l horizon_us:l queue_fraction:d imbalance:d sigma:d filled:b time_to_fill_us:l", SQL_OUTCOMES + SQL_SIGMA + """;SELECT o.order_id, strftime(make_timestamp(CAST(o.ts_us AS BIGINT)), '%Y-%m-%d') AS date, CASE side WHEN 0 THEN 'BID' ELSE 'ASK' END AS side, depth, horizon_us, queue_fraction, imbalance, sigma, hit AS filled, CASE WHEN hit THEN time_to_fill_us ELSE -1 END AS time_to_fill_us FROM outcomes o ASOF LEFT JOIN vol ON vol.symbol_id = o.symbol_id AND vol.idx <= o.idx""")
def probe_table(spark, sf_dir):
    """The probes table with the features of each probe's moment."""
    orders, md, best = resting(spark, sf_dir)
    rows = as_of(queue.follow(orders, md, "PESS", REST_US).drop("fills"), volatility(best), ["symbol_id"], ["sigma"])
    rows = queue.outcomes(rows, [60_000_000, 600_000_000, REST_US])
    return rows.select("order_id", grid.utc_date(F.col("ts_us")).alias("date"), grid.side_name(F.col("side")).alias("side"), "depth", "horizon_us", "queue_fraction", "imbalance", "sigma", F.col("hit").alias("filled"), F.when(F.col("hit"), F.col("time_to_fill_us")).otherwise(-1).alias("time_to_fill_us"))


@query("fills_table", "order_id:s fill_us:l fill_idx:l date:s side:s price:d qty:d mid:d ahead:l queue_fraction:d ahead_at_fill:l behind_at_fill:l fill_fraction:d cause:s imbalance_at_fill:d sigma_at_fill:d", sql_queue("PESS") + SQL_SIGMA + """,
moves AS (SELECT order_id, r, a, b, f, lag(a) OVER w AS a0, lag(b) OVER w AS b0, lag(rem) OVER w AS rem0, lag(f) OVER w AS f0 FROM states WINDOW w AS (PARTITION BY order_id ORDER BY r)),
filled AS (SELECT p.symbol_id, p.order_id, p.side, p.price, p.qty, p.ahead, m.f - m.f0 AS lots, m.a AS a, m.b AS b, o.q - m.a0 - m.rem0 > 0 AS through, o.ts_us AS fill_us, o.idx AS fill_idx FROM moves m JOIN own o USING (order_id, r) JOIN placed p USING (order_id) WHERE m.f > m.f0)
;SELECT f.order_id, fill_us, fill_idx, strftime(make_timestamp(CAST(fill_us AS BIGINT)), '%Y-%m-%d') AS date, CASE f.side WHEN 0 THEN 'BID' ELSE 'ASK' END AS side, f.price * 0.01 AS price, lots * 0.1 AS qty, b.mid_x2 * 0.005 AS mid, ahead, CAST(ahead AS DOUBLE) / (ahead + f.qty) AS queue_fraction, f.a AS ahead_at_fill, f.b AS behind_at_fill, CAST(ahead AS DOUBLE) / (ahead + lots) AS fill_fraction,
  CASE WHEN through THEN 'traded_through' ELSE 'queue_consumed' END AS cause, CASE WHEN coalesce(b.bid_qty, 0) + coalesce(b.ask_qty, 0) = 0 THEN 0.5 ELSE CAST(coalesce(b.bid_qty, 0) AS DOUBLE) / (coalesce(b.bid_qty, 0) + coalesce(b.ask_qty, 0)) END AS imbalance_at_fill, sigma AS sigma_at_fill
  FROM filled f JOIN best b ON b.symbol_id = f.symbol_id AND b.idx = f.fill_idx ASOF LEFT JOIN vol ON vol.symbol_id = f.symbol_id AND vol.idx <= f.fill_idx""")
def fills_table(spark, sf_dir):
    """The fills table of the pessimistic model: where each fill stood in its queue, why it filled, and the market then."""
    orders, md, best = resting(spark, sf_dir)
    rows = queue.fills(queue.follow(orders, md, "PESS", REST_US)).select("symbol_id", "order_id", "side", "price", "qty", "ahead", "queue_fraction", "fill_us", F.col("fill_us").alias("ts_us"), F.col("fill_idx").alias("idx"), "fill_idx", "fill_qty", "ahead_at_fill", "behind_at_fill", "fill_fraction", "cause")
    now = best.select("symbol_id", "idx", F.col("mid_x2").alias("mid_then"), book.imbalance(F.col("bid_qty"), F.col("ask_qty")).alias("imbalance_at_fill"))
    rows = as_of(rows.join(now, ["symbol_id", "idx"]), volatility(best), ["symbol_id"], ["sigma"])
    return rows.select("order_id", "fill_us", "fill_idx", grid.utc_date(F.col("fill_us")).alias("date"), grid.side_name(F.col("side")).alias("side"), grid.to_price(F.col("price"), 0.01).alias("price"), grid.to_qty(F.col("fill_qty"), 0.1).alias("qty"), grid.to_price(F.col("mid_then"), 0.005).alias("mid"), "ahead", "queue_fraction", "ahead_at_fill", "behind_at_fill", "fill_fraction", "cause", "imbalance_at_fill", F.col("sigma").alias("sigma_at_fill"))


@query("fill_surface", "depth:l b0:d b1:d b2:d b3:d b4:d b5:d b6:d b7:d b8:d b9:d", SQL_OUTCOMES + """,
binned AS (SELECT depth, CAST(hit AS INT) AS hit, CAST(ahead AS DOUBLE) / (ahead + qty) AS f FROM outcomes WHERE horizon_us = """ + str(REST_US) + """)
;SELECT depth, """ + ", ".join(f"avg(hit) FILTER (f {'>=' if i == 0 else '>'} {report.EDGES[i]!r}::DOUBLE AND f <= {report.EDGES[i + 1]!r}::DOUBLE) AS b{i}" for i in range(10)) + " FROM binned GROUP BY 1")
def fill_surface(spark, sf_dir):
    """Fill probability by depth and queue fraction at the longest horizon."""
    out = report.fill_surface(probe_rows(spark, sf_dir).where(F.col("horizon_us") == REST_US))
    return out.select("depth", *[F.col(str(i)).alias(f"b{i}") for i in range(10)])


@query("probe_monotone", "horizon_us:l n:l fill_rate:d falls:b", SQL_OUTCOMES + """,
rates AS (SELECT horizon_us, count(*) FILTER (whole) AS n, coalesce(avg(CAST(hit AS INT)) FILTER (whole), 0) AS fill_rate FROM outcomes GROUP BY 1)
;SELECT *, coalesce(fill_rate < lag(fill_rate) OVER (ORDER BY horizon_us) - 1e-9, false) AS falls FROM rates""")
def probe_monotone(spark, sf_dir):
    """Fill rates per horizon over probes with the whole horizon, and whether one is below the one before."""
    rates = queue.fill_rates(probe_rows(spark, sf_dir))
    own = Window.partitionBy(F.lit(0)).orderBy("horizon_us")  # a row per horizon
    return rates.withColumn("falls", F.coalesce(F.col("fill_rate") < F.lag("fill_rate").over(own) - 1e-9, F.lit(False)))


# --- calibration, quotes ----------------------------------------------------------------------------------------------

BUCKET_US, DEEPEST = 60_000_000, 12

SQL_HAZARD = SQL_BOOK + f""",
mids AS (SELECT symbol_id, ts_us // {BUCKET_US} AS slot, arg_min(mid_x2, idx) AS mid_x2 FROM best WHERE mid_x2 IS NOT NULL GROUP BY 1, 2),
prints AS (SELECT symbol_id, ts_us // {BUCKET_US} AS slot, min(CASE WHEN side = 1 THEN price END) AS sold, max(CASE WHEN side = 0 THEN price END) AS bought FROM md WHERE type = 1 GROUP BY 1, 2),
hazard AS (SELECT *, (bid_hits + ask_hits) / 2.0 / seconds AS rate FROM (SELECT symbol_id, delta, count(*) * {BUCKET_US / 1e6} AS seconds, count(*) FILTER (mid_x2 / 2.0 - sold >= delta) AS bid_hits, count(*) FILTER (bought - mid_x2 / 2.0 >= delta) AS ask_hits
  FROM mids LEFT JOIN prints USING (symbol_id, slot) CROSS JOIN (SELECT unnest(range(1, {DEEPEST + 1})) AS delta) GROUP BY 1, 2))"""


def hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = market(spark, sf_dir)
    return calibrate.hazard_points(md, book.bbo(md), BUCKET_US, DEEPEST)


@query("hazard_points", "symbol_id:l delta:l seconds:d bid_hits:l ask_hits:l rate:d", SQL_HAZARD + ";SELECT * FROM hazard")
def hazard_points(spark, sf_dir):
    """How often prints reach a distance from the mid."""
    return hazard(spark, sf_dir)


@query("hazard_fit", "symbol_id:l k:d a:d r2:d n:l ok:b", SQL_HAZARD + """;SELECT symbol_id, -regr_slope(ln(rate), CAST(delta AS DOUBLE)) AS k, exp(regr_intercept(ln(rate), CAST(delta AS DOUBLE))) AS a, CASE WHEN var_pop(ln(rate)) = 0 THEN 0 ELSE regr_r2(ln(rate), CAST(delta AS DOUBLE)) END AS r2, count(*) AS n,
  count(*) >= 2 AND regr_slope(ln(rate), CAST(delta AS DOUBLE)) IS NOT NULL AS ok FROM hazard WHERE rate > 0 AND delta <= 10 GROUP BY 1""")
def hazard_fit(spark, sf_dir):
    """Exponential fit of arrival rates."""
    return calibrate.fit(hazard(spark, sf_dir), "symbol_id")


_QUOTE_INPUTS = """
inputs AS (SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 'nan'::DOUBLE ELSE 10000 + user_id % 50 / 4.0 END AS mid, event_id % 21 - 10 AS q, CASE WHEN event_id % 31 = 0 THEN 0.0 ELSE (event_id % 7 + 1) * 1e-3 END AS gamma, CASE WHEN event_id % 43 = 0 THEN 1e-300 ELSE (user_id % 5 + 1) * 0.05 END AS k, CAST(floor(abs(value)) AS BIGINT) % 9 / 2.0 AS sigma FROM events)"""


def quote_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    n = F.col("event_id")
    gamma = F.when(n % 31 == 0, 0.0).otherwise((n % 7 + 1) * 1e-3)
    return e.select("event_id", F.when(n % 41 == 0, float("nan")).otherwise(10000 + F.col("user_id") % 50 / 4.0).alias("mid"), (n % 21 - 10).alias("q"), gamma.alias("gamma"), F.when(n % 43 == 0, 1e-300).otherwise((F.col("user_id") % 5 + 1) * 0.05).alias("k"), (F.floor(F.abs("value")).cast("long") % 9 / 2.0).alias("sigma"))


@query("as_quotes", "event_id:l bid:d ask:d bid_ticks:l ask_ticks:l", _QUOTE_INPUTS + """,
solved AS (SELECT *, mid - q * gamma * sigma * sigma * 60 AS r, gamma * sigma * sigma * 60 + 2 / gamma * ln(1 + gamma / k) AS s FROM inputs WHERE gamma > 0 AND NOT isnan(mid))
;SELECT event_id, r - s / 2 AS bid, r + s / 2 AS ask, floor(r - s / 2) AS bid_ticks, ceil(r + s / 2) AS ask_ticks FROM inputs LEFT JOIN solved USING (event_id)""")
def as_quotes(spark, sf_dir):
    """Quotes around the reservation price, rounded outward."""
    rows = quote_inputs(spark, sf_dir).withColumn("z", quotes.reservation_quotes(F.col("mid"), F.col("q"), F.col("gamma"), F.col("k"), F.col("sigma"), F.lit(60.0)))
    low, high = quotes.outward(F.col("z.bid"), F.col("z.ask"))
    return rows.select("event_id", "z.bid", "z.ask", low.alias("bid_ticks"), high.alias("ask_ticks"))


@query("glft_quotes", "event_id:l bid:d ask:d bid_delta:d ask_delta:d", _QUOTE_INPUTS + """,
powers AS (SELECT *, (1 + k / gamma) * ln(1 + gamma / k) AS p FROM inputs WHERE gamma > 0 AND NOT isnan(mid)),
solved AS (SELECT *, 1 / gamma * ln(1 + gamma / k) AS base, CASE WHEN k > 1e-100 THEN sqrt(sigma * sigma * gamma / (2 * greatest(k, 1e-100) * 0.8) * exp(least(p, 100))) ELSE 0 END AS skew FROM powers),
deltas AS (SELECT *, greatest(base + (2 * q + 1) / 2.0 * skew, 0) AS bid_delta, greatest(base - (2 * q - 1) / 2.0 * skew, 0) AS ask_delta FROM solved)
;SELECT event_id, d.mid - bid_delta AS bid, d.mid + ask_delta AS ask, bid_delta, ask_delta FROM inputs LEFT JOIN deltas d USING (event_id)""")
def glft_quotes(spark, sf_dir):
    """Stationary quote distances, none below zero."""
    rows = quote_inputs(spark, sf_dir).withColumn("z", quotes.stationary_quotes(F.col("mid"), F.col("q"), F.col("gamma"), F.col("k"), F.lit(0.8), F.col("sigma")))
    return rows.select("event_id", "z.bid", "z.ask", "z.bid_delta", "z.ask_delta")


@query("passive_quotes", "symbol_id:l idx:l bid:l ask:l floor_bid:l floor_ask:l", SQL_BOOK + """,
wanted AS (SELECT *, CAST(floor(mid_x2 / 2.0 - 1 + idx % 5) AS BIGINT) AS b, CAST(ceil(mid_x2 / 2.0 + 1 - idx % 3) AS BIGINT) AS a FROM best WHERE mid_x2 IS NOT NULL)
;SELECT symbol_id, idx, least(b, best_ask - 1) AS bid, greatest(a, best_bid + 1) AS ask, least(least(b, best_bid), best_ask - 1) AS floor_bid, greatest(greatest(a, best_ask), best_bid + 1) AS floor_ask FROM wanted""")
def passive_quotes(spark, sf_dir):
    """Quotes that never cross, and never go inside the touch."""
    rows = book.bbo(market(spark, sf_dir)).where("mid_x2 is not null")
    mid = F.col("mid_x2") / 2.0
    b, a = quotes.outward(mid - 1 + F.col("idx") % 5, mid + 1 - F.col("idx") % 3)
    bid, ask = quotes.passive(b, a, F.col("best_bid"), F.col("best_ask"))
    fb, fa = quotes.tick_floor(b, a, F.col("best_bid"), F.col("best_ask"))
    return rows.select("symbol_id", "idx", bid.alias("bid"), ask.alias("ask"), fb.alias("floor_bid"), fa.alias("floor_ask"))


@query("min_edge_rate", "symbol_id:l fee_tenths:l n:l passing:l", SQL_FILLS + """;SELECT symbol_id, fee_tenths, count(*) AS n, count(*) FILTER (CASE side WHEN 0 THEN mid_x2 / 2.0 - price ELSE price - mid_x2 / 2.0 END > fee_tenths * 1e-5 * price) AS passing FROM fills CROSS JOIN (SELECT unnest([-5, 0, 2, 5, 20]) AS fee_tenths) GROUP BY 1, 2""")
def min_edge_rate(spark, sf_dir):
    """Fills whose distance from the mid is more than the fee."""
    fills, _ = fills_and_marks(spark, sf_dir)
    rows = fills.withColumn("fee_tenths", F.explode(F.lit([-5, 0, 2, 5, 20])))
    passing = quotes.has_edge(F.col("price"), F.col("mid_x2") / 2.0, F.col("fee_tenths"), F.col("side"))
    return rows.groupBy("symbol_id", "fee_tenths").agg(F.count("*").alias("n"), F.count_if(passing).alias("passing"))


# --- reports ----------------------------------------------------------------------------------------------------------

FEES = [-50, -20, -5, 0, 2, 5, 20, 50, 100]

SQL_CURVE = SQL_FILLS + f""",
curve AS (SELECT symbol_id, CAST(fee AS DOUBLE) AS fee, sum((1 - 2 * side) * (mid_x2 - 2 * price) * qty * 100000) AS spread_x2, sum(2 * CAST(sign(price * qty * 100000 * fee) AS BIGINT) * ((abs(price * qty * 100000 * fee) + 50000) // 100000)) AS fees_x2, spread_x2 - fees_x2 AS pnl FROM fills CROSS JOIN (SELECT unnest({FEES}) AS fee) GROUP BY 1, 2)"""


def fee_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread captured less fees, per instrument and fee in tenths of a basis point."""
    fills, _ = fills_and_marks(spark, sf_dir)
    rows = fills.withColumn("fee", F.explode(F.lit(FEES)))
    gain = grid.sign(F.col("side")) * (F.col("mid_x2") - 2 * F.col("price")) * F.col("qty") * CASH
    cost = 2 * grid.fee(grid.notional(F.col("price"), F.col("qty"), CASH), F.col("fee").cast("long"))
    return rows.groupBy("symbol_id", F.col("fee").cast("double").alias("fee")).agg(F.sum(gain).alias("spread_x2"), F.sum(cost).alias("fees_x2")).withColumn("pnl", F.col("spread_x2") - F.col("fees_x2"))


@query("pnl_by_fee", "symbol_id:l fee:d spread_x2:l fees_x2:l pnl:l", SQL_CURVE + ";SELECT * FROM curve")
def pnl_by_fee(spark, sf_dir):
    """Profit by fee and its parts."""
    return fee_curve(spark, sf_dir)


@query("break_even_fee", "symbol_id:l break_even:d", SQL_CURVE + """,
steps AS (SELECT *, lag(fee) OVER w AS fee0, lag(pnl) OVER w AS pnl0 FROM curve WINDOW w AS (PARTITION BY symbol_id ORDER BY fee)),
crossings AS (SELECT symbol_id, fee, fee0 + (fee - fee0) * CAST(pnl0 AS DOUBLE) / CAST(pnl0 - pnl AS DOUBLE) AS x FROM steps WHERE pnl0 > 0 AND pnl <= 0 OR pnl0 < 0 AND pnl >= 0)
;SELECT c.symbol_id, coalesce(arg_min(x.x, x.fee), 'nan'::DOUBLE) AS break_even FROM (SELECT DISTINCT symbol_id FROM curve) c LEFT JOIN crossings x USING (symbol_id) GROUP BY 1""")
def break_even_fee(spark, sf_dir):
    """The fee at which profit turns."""
    return report.break_even(fee_curve(spark, sf_dir), "symbol_id")


@query("matrix_grid", "strategy:s queue:s fee_bp:d latency_ms:l run_id:s", """;SELECT *, replace(replace(replace(replace(concat_ws('_', strategy, queue, CAST(fee_bp AS VARCHAR), CAST(latency_ms AS VARCHAR), '1'), '.', '_'), '-', '_'), ' ', '_'), '/', '_') AS run_id
  FROM (SELECT unnest(['S0_touch', 'S0_queue', 'S1', 'S2_AS', 'S2_GLFT', 'S3']) AS strategy) CROSS JOIN (SELECT unnest(['PESS', 'PROP', 'OPT']) AS queue) CROSS JOIN (SELECT unnest([-0.5, 0.0, 1.0, 2.0, 5.0, 10.0]::DOUBLE[]) AS fee_bp) CROSS JOIN (SELECT unnest([10, 50, 100]) AS latency_ms)""")
def matrix_grid(spark, sf_dir):
    """The cells of a parameter sweep with their names."""
    cells = report.grid(spark, strategy=["S0_touch", "S0_queue", "S1", "S2_AS", "S2_GLFT", "S3"], queue=["PESS", "PROP", "OPT"], fee_bp=[-0.5, 0.0, 1.0, 2.0, 5.0, 10.0], latency_ms=[10, 50, 100])
    return cells.withColumn("run_id", grid.sanitise(grid.run_id(F.col("strategy"), F.col("queue"), F.col("fee_bp").cast("string"), F.col("latency_ms").cast("string"), F.lit("1"))))


@query("spread_scout", "symbol_id:l n:l median_mid_x2:d median_bp:d p90_bp:d median_ticks:d tick:l median_top:d wide:b", SQL_BOOK + """,
ok AS (SELECT *, best_ask - best_bid AS spread, 20000.0 * (best_ask - best_bid) / mid_x2 AS bp, least(bid_qty, ask_qty) * mid_x2 / 2.0 AS top FROM best WHERE best_bid > 0 AND best_ask > best_bid)
;SELECT symbol_id, count(*) AS n, median(mid_x2) AS median_mid_x2, median(bp) AS median_bp, list_sort(list(bp))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS p90_bp, median(spread) / min(spread) AS median_ticks, min(spread) AS tick, median(top) AS median_top, median(bp) >= 2 AND median(spread) / min(spread) >= 3 AS wide FROM ok GROUP BY 1""")
def spread_scout(spark, sf_dir):
    """Which instruments are wide enough to quote."""
    return report.spread_scout(book.bbo(market(spark, sf_dir)))


@query("missing_hours", "symbol_id:l hour:l", """present AS (SELECT DISTINCT user_id % 4 AS symbol_id, epoch_us(ts) // 3600000000 AS hour FROM events),
spans AS (SELECT symbol_id, min(hour) AS lo, max(hour) AS hi FROM present GROUP BY 1)
;SELECT s.symbol_id, h.hour FROM (SELECT symbol_id, unnest(range(lo, hi + 1)) AS hour FROM spans) h JOIN spans s USING (symbol_id) ANTI JOIN present p ON p.symbol_id = h.symbol_id AND p.hour = h.hour""")
def missing_hours(spark, sf_dir):
    """Hours without a recording between an instrument's first and last."""
    e = read(spark, sf_dir, "events")
    return report.missing_hours(e.select((F.col("user_id") % 4).alias("symbol_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour")))


@query("last_gaps", "symbol_id:l ln:l", SQL_MESSAGES + ";SELECT symbol_id, ln FROM synced WHERE gap QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY ln DESC) <= 10")
def last_gaps(spark, sf_dir):
    """The last ten breaks of each instrument's log, in its order."""
    rows = sync.synchronised(messages(spark, sf_dir)).where("gap")
    return rows.groupBy("symbol_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list("ln"))), 1, 10).alias("x")).select("symbol_id", F.explode("x").alias("ln"))


@query("event_counters", "symbol_id:l minute5:l n:l n_trades:l volume:l", SQL_MD + ";SELECT symbol_id, ts_us // 300000000 AS minute5, count(*) AS n, count(*) FILTER (type = 1) AS n_trades, coalesce(sum(qty) FILTER (type = 1), 0) AS volume FROM md GROUP BY 1, 2")
def event_counters(spark, sf_dir):
    """Counters per instrument and five minutes."""
    md = market_events(spark, sf_dir)
    trade = F.col("type") == TRADE
    return md.groupBy("symbol_id", F.floor(F.col("ts_us") / 300_000_000).alias("minute5")).agg(F.count("*").alias("n"), F.count_if(trade).alias("n_trades"), F.coalesce(F.sum(F.when(trade, F.col("qty"))), F.lit(0)).alias("volume"))


@query("bootstrap_daily", "symbol_id:l n:l estimate:d low:d high:d", "")
def bootstrap_daily(spark, sf_dir):
    """Bootstrap interval of mean daily profit."""
    days = ledger.daily(book_ledger(spark, sf_dir)).withColumn("pnl", F.col("change_x2").cast("double"))
    return report.bootstrap(days, ["symbol_id"], "date", "pnl")


@query("strategy_sweep", "symbol_id:l strategy:s latency_us:l model:s fee_tenths:l n_orders:l n_fills:l lots:l notional:l edge_x2:l markout_x2:l fees_x2:l pnl_x2:l", "")
def strategy_sweep(spark, sf_dir):
    """Quoting rules under three queue models, two latencies and two fees, open loop."""
    from microflow.plans import evaluate

    return evaluate.evaluate(market(spark, sf_dir), evaluate.default_cells(spark), 6 * 3_600_000_000)


@query("matrix_summary", "strategy:s model:s latency_us:l fee_tenths:l n:l n_orders:l n_fills:l lots:l notional:l edge_x2:l markout_x2:l fees_x2:l pnl_x2:l mean_edge_x2:d estimate:d low:d high:d stderr:d", "")
def matrix_summary(spark, sf_dir):
    """The sweep summed by its four keys, with bootstrap intervals of the daily profit."""
    from microflow.plans import evaluate

    return evaluate.matrix_summary(market(spark, sf_dir), evaluate.default_cells(spark), 6 * 3_600_000_000)
