"""Market events out of the test tables: each event becomes a book update or a print of one of four instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microflow.operators.windows import carried, day_of

DEPTH, TRADE, BEGIN, LEVEL, END = 0, 1, 2, 3, 4
BID, ASK = 0, 1
#: Cash units (1e-8) of a tick times a lot of the instruments here: tick 0.01, lot 0.1.
CASH = 100_000

#: The same events for the SQL that results are checked against.
SQL_MD = """
raw_events AS (SELECT user_id % 4 AS symbol_id, epoch_us(ts) AS ts_us, event_id AS seq, event_type AS et,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) % 16 AS off FROM events),
sided AS (SELECT *, CASE WHEN et IN ('purchase', 'error') THEN 1 ELSE 0 END AS type,
  CASE et WHEN 'purchase' THEN 0 WHEN 'view' THEN 0 WHEN 'error' THEN 1 WHEN 'click' THEN 1 ELSE seq % 2 END AS side FROM raw_events),
md AS (SELECT symbol_id, row_number() OVER (PARTITION BY symbol_id ORDER BY ts_us, CASE type WHEN 1 THEN 3 ELSE 4 END, seq) - 1 AS idx,
  ts_us, seq, type, side,
  CASE WHEN type = 1 THEN CASE side WHEN 0 THEN 10001 ELSE 10000 END WHEN side = 0 THEN 10000 - off ELSE 10001 + off END AS price,
  CASE WHEN type = 1 THEN k + 1 WHEN et = 'signup' THEN 0 ELSE k END AS qty FROM sided)"""


def market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol_id, idx (replay order), ts_us, seq, type, side, price (ticks), qty (lots; 0 deletes a level)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, seq = F.col("event_type"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    off = F.floor("value").cast("long") % 16
    side = F.when(kind.isin("purchase", "view"), 0).when(kind.isin("error", "click"), 1).otherwise(seq % 2).cast("int")
    trade = kind.isin("purchase", "error")
    raw = e.select(
        (F.col("user_id") % 4).alias("symbol_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        seq.alias("seq"),
        F.when(trade, TRADE).otherwise(DEPTH).alias("type"),
        side.alias("side"),
        F.when(trade, F.when(side == BID, 10001).otherwise(10000)).when(side == BID, 10000 - off).otherwise(10001 + off).cast("long").alias("price"),
        F.when(trade, k + 1).when(kind == "signup", 0).otherwise(k).cast("long").alias("qty"),
    )
    raw = raw.withColumn("day", day_of("ts_us")).withColumn("rank", F.when(F.col("type") == TRADE, 3).otherwise(4))
    rows = carried(raw, ["symbol_id"], "day", ["ts_us", "rank", "seq"], sums={"place": F.lit(1)})
    return rows.select("symbol_id", (F.col("place") - 1).cast("long").alias("idx"), "ts_us", "seq", "type", "side", "price", "qty")


#: Recorder lines for the SQL: arrival order, ids, and what each line says. Every 211th line is cut short, every 199th another's.
SQL_LINES = """
lines AS (SELECT *, strlen(CAST(k AS VARCHAR)) AS digits, CASE WHEN event_id % 251 = 0 THEN 'snapshot' WHEN event_id % 5 = 4 THEN 'trade' ELSE 'depth' END AS kind, event_id % 211 = 7 AS malformed, event_id % 211 <> 7 AND event_id % 199 = 3 AS wrong,
  ts_us // 1000 * 1000 AS ms_us, ln * 10 - 9 + CASE WHEN event_id % 97 = 0 THEN 5 ELSE 0 END AS u_first
  FROM (SELECT user_id % 4 AS symbol_id, event_id, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS ln, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) % 16 AS off, event_type IN ('error', 'click') AS sold FROM events)),
messages AS (SELECT *, CASE WHEN kind = 'depth' THEN u_first END AS first_id, CASE WHEN kind = 'trade' THEN NULL WHEN kind = 'depth' AND event_id % 89 = 0 THEN ln * 10 - 100 ELSE ln * 10 END AS final_id,
  CASE WHEN kind = 'depth' AND symbol_id < 2 THEN ln * 10 - 10 + CASE WHEN event_id % 97 = 0 THEN 5 ELSE 0 END END AS prev_id FROM lines WHERE NOT malformed AND NOT wrong)"""


def recorder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as lines of recorders (ln, value): depth with breaks, stale updates and either order of sides, trades, snapshots, broken lines."""
    return symbol_lines(spark, sf_dir).select("ln", "value")


def symbol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recorder_lines with the instrument whose recorder wrote them (symbol_id)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("symbol_id", F.col("user_id") % 4).withColumn("part", F.floor(F.col("event_id") / 65_536))
    e = carried(e, ["symbol_id"], "part", ["event_id"], sums={"ln": F.lit(1)})
    n, k, ln = F.col("event_id"), F.get_json_object("props", "$.k").cast("long"), F.col("ln")
    off, ts = F.floor("value").cast("long") % 16, F.unix_micros(F.col("ts").cast("timestamp"))
    price = lambda ticks: F.format_string('"%d.%02d"', F.floor(ticks / 100).cast("long"), (ticks % 100).cast("long"))
    qty = lambda lots: F.format_string('"%d.%d"', F.floor(lots / 10).cast("long"), (lots % 10).cast("long"))
    pair = lambda p, q: F.concat(F.lit("["), price(p), F.lit(","), qty(q), F.lit("]"))
    ms, skip = F.floor(ts / 1000).cast("string"), F.when(n % 97 == 0, 5).otherwise(0)
    bids, asks = F.concat(F.lit('"b":['), pair(10000 - off, k), F.lit("]")), F.concat(F.lit('"a":['), pair(10001 + off, (k + n) % 7), F.lit("]"))
    prev = F.when(F.col("symbol_id") < 2, F.concat(F.lit(',"pu":'), ln * 10 - 10 + skip)).otherwise(F.lit(""))
    final = F.when(n % 89 == 0, ln * 10 - 100).otherwise(ln * 10)
    depth = F.concat(F.lit('{"e":"depthUpdate","E":'), ms, F.lit(',"T":'), ms, F.lit(',"U":'), ln * 10 - 9 + skip, F.lit(',"u":'), final, prev, F.lit(","), F.when(n % 2 == 1, F.concat(asks, F.lit(","), bids)).otherwise(F.concat(bids, F.lit(","), asks)), F.lit("}"))
    sold = F.col("event_type").isin("error", "click")
    trade = F.concat(F.lit('{"e":"aggTrade","T":'), ms, F.lit(',"a":'), n, F.lit(',"p":'), price(F.when(sold, 10000).otherwise(10001)), F.lit(',"q":'), qty(k + 1), F.lit(',"m":'), sold.cast("string"), F.lit("}"))
    side = lambda name, first, step: F.concat(F.lit(f'"{name}":['), F.concat_ws(",", *[pair(first + step * j, k + j) for j in range(3)]), F.lit("]"))
    snap = F.concat(F.lit('{"lastUpdateId":'), ln * 10, F.lit(","), side("bids", 10000 - off, -1), F.lit(","), side("asks", 10001 + off, 1), F.lit("}"))
    kind = F.when(n % 251 == 0, "snapshot").when(n % 5 == 4, "trade").otherwise("depth")
    name = F.when((n % 199 == 3) & (n % 211 != 7), F.lit("OTHER")).otherwise(F.concat(F.lit("SYM"), F.col("symbol_id")))
    line = F.concat(F.lit('{"t":'), ts, F.lit(',"c":"'), kind, F.lit('","s":"'), name, F.lit('","d":'), F.when(kind == "snapshot", snap).when(kind == "trade", trade).otherwise(depth), F.lit("}"))
    return e.select("symbol_id", "ln", F.when(n % 211 == 7, F.left(line, F.lit(60))).otherwise(line).alias("value"))


def instrument_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"SYM{i}", i) for i in range(4)], "symbol string, symbol_id long")
