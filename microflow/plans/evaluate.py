"""Open-loop evaluation of quoting rules over a grid of cells, as one plan: quotes, resting orders, fills, profit.

A rule quotes at every timer from what is visible then; the quote rests until the next timer. Nothing an order does
changes later quotes, so every (cell, order) is independent and a sweep is a join, not a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microflow.functions import grid as money
from microflow.functions import quotes
from microflow.operators import book, markout, queue, rolling, sync
from microflow.operators.report import bootstrap
from microflow.operators.windows import carried, day_of
from microflow.sources.adapters import ASK, BID, CASH, TRADE
from microflow.sources.shared import written

STRATEGIES = ("S0", "S1", "S2_AS", "S2_GLFT", "S3")


def features(md: DataFrame, best: DataFrame, period_us: int, sample_us: int, window_us: int, toxic: float = 0.6) -> DataFrame:
    """The book, volatility and last toxic trigger that are known at each timer: the last values at or before it."""
    two = best.where("mid_x2 is not null").withColumn("share", book.imbalance(F.col("bid_qty"), F.col("ask_qty")))
    vol = rolling.sigma(rolling.spaced(two.withColumn("day", money.utc_day(F.col("ts_us"))), sample_us), window_us)
    pulls = rolling.pulls(rolling.flow(md.where(F.col("type") == TRADE), window_us), toxic, 0)
    ticks = sync.timers(md, period_us)
    line = two.select("symbol_id", "ts_us", "idx", F.lit(0).alias("kind"), F.struct("best_bid", "best_ask", "mid_x2", "share").alias("b"))
    line = line.unionByName(vol.select("symbol_id", "ts_us", "idx", F.lit(0).alias("kind"), "sigma"), allowMissingColumns=True)
    line = line.unionByName(pulls.select("symbol_id", "ts_us", "idx", F.lit(0).alias("kind"), "trigger_us", "trigger_side"), allowMissingColumns=True)
    line = line.unionByName(ticks.select("symbol_id", "ts_us", F.lit(None).cast("long").alias("idx"), F.lit(1).alias("kind")), allowMissingColumns=True)
    line = line.withColumn("day", day_of("ts_us")).select("symbol_id", "ts_us", "day", "kind", "idx", F.col("b").alias("b0"), F.col("sigma").alias("sigma0"), F.when(F.col("trigger_us").isNotNull(), F.struct("trigger_us", "trigger_side")).alias("t0"))
    known = carried(line, ["symbol_id"], "day", ["ts_us", "kind", "idx"], lasts={"b": F.col("b0"), "sigma": F.col("sigma0"), "t": F.col("t0")}).where("kind = 1 and b is not null")
    return known.select("symbol_id", "ts_us", "b.*", "sigma", "t.trigger_us", "t.trigger_side")


def quoted(known: DataFrame, cells: DataFrame, spread: float = 1.0, gamma: float = 1e-4, k: float = 0.3, a: float = 0.8, pull_us: int = 600_000_000) -> DataFrame:
    """A bid and an ask per cell (strategy ...) and timer; null where the rule doesn't quote.

    S0 joins the touch; S1 stands a fixed distance from the mid; S2 solves for the distance from volatility, without
    inventory, and stays outside the touch; S3 is S1 around the weighted mid and pulls, for pull_us from a trigger, the
    side that toxic flow runs over.
    """
    rows = known.crossJoin(F.broadcast(cells))  # cells are a few literal rows
    s, bb, ba = F.col("strategy"), F.col("best_bid"), F.col("best_ask")
    mid = F.col("mid_x2") / 2.0
    fair = F.when(s == "S3", book.weighted_mid(bb, ba, F.col("share"))).otherwise(mid)
    zero = F.lit(0.0)
    gl = quotes.stationary_quotes(mid, zero, F.lit(gamma), F.lit(k), F.lit(a), F.col("sigma"))
    av = quotes.reservation_quotes(mid, zero, F.lit(gamma), F.lit(k), F.col("sigma"), F.lit(60.0))
    low = F.when(s == "S2_AS", av["bid"]).when(s == "S2_GLFT", gl["bid"]).otherwise(fair - spread)
    high = F.when(s == "S2_AS", av["ask"]).when(s == "S2_GLFT", gl["ask"]).otherwise(fair + spread)
    low, high = quotes.outward(low, high)
    inside = quotes.passive(low, high, bb, ba)
    outside = quotes.tick_floor(low, high, bb, ba)
    bid = F.when(s == "S0", bb).when(s.startswith("S2"), outside[0]).otherwise(inside[0])
    ask = F.when(s == "S0", ba).when(s.startswith("S2"), outside[1]).otherwise(inside[1])
    pulled = lambda side: (s == "S3") & F.coalesce((F.col("ts_us") < F.col("trigger_us") + pull_us) & (F.col("trigger_side") == side), F.lit(False))
    pulled_bid, pulled_ask = pulled(BID), pulled(ASK)
    return rows.withColumn("bid", F.when(~pulled_bid, bid)).withColumn("ask", F.when(~pulled_ask, ask))


def orders(rows: DataFrame, md: DataFrame, spans: DataFrame, qty: int, cell_cols: list[str]) -> DataFrame:
    """The quotes as resting orders, in force latency_us after the decision, with what is ahead of them then."""
    side = F.explode(F.array(F.struct(F.lit(BID).alias("side"), F.col("bid").alias("price")), F.struct(F.lit(ASK).alias("side"), F.col("ask").alias("price")))).alias("o")
    o = rows.select("symbol_id", *cell_cols, (F.col("ts_us") + F.col("latency_us")).alias("ts_us"), "mid_x2", side).where("o.price is not null").select("symbol_id", *cell_cols, "ts_us", "mid_x2", "o.side", "o.price")
    times = o.select("symbol_id", "ts_us").distinct()
    line = md.groupBy("symbol_id", "ts_us").agg(F.max("idx").alias("i")).withColumn("kind", F.lit(0)).unionByName(times.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    at = carried(line.withColumn("day", day_of("ts_us")), ["symbol_id"], "day", ["ts_us", "kind"], lasts={"idx": F.col("i")}).where("kind = 1 and idx is not null").select("symbol_id", "ts_us", "idx")
    o = o.join(at, ["symbol_id", "ts_us"]).withColumn("order_id", F.concat_ws("-", "symbol_id", *cell_cols, "ts_us", "side")).withColumn("qty", F.lit(qty).cast("long"))
    return queue.placed(o, spans)


def fills_of(md: DataFrame, cells: DataFrame, period_us: int, qty: int = 20, horizon_us: int = 60_000_000, sample_us: int = 60_000_000, window_us: int = 1_800_000_000) -> tuple[DataFrame, DataFrame]:
    """(orders followed to their end, fills with markouts) of all cells (strategy, model, latency_us) over a table of market events."""
    cell_cols = ["strategy", "latency_us"]
    best, spans = written(book.bbo(md), "best"), book.levels(md)
    known = features(md, best, period_us, sample_us, window_us)
    placed = written(orders(quoted(known, cells.select(*cell_cols).distinct()), md, spans, qty, cell_cols), "placed")
    # rules often quote the same price: what becomes of an order is followed once, not once a cell
    keys = ["symbol_id", "side", "price", "idx", "ts_us"]
    apart = placed.select(*keys, "qty", "ahead").distinct().withColumn("order_id", F.concat_ws("-", *keys))
    followed = queue.follow_models(apart, md, period_us).drop("order_id", "qty", "ahead", "fills")
    # cells are a few literal rows
    done = written(placed.join(followed, keys).join(F.broadcast(cells), ["strategy", "latency_us", "model"], "left_semi"), "followed")
    fills = done.where("filled > 0").select("symbol_id", *cell_cols, "model", "order_id", F.col("first_fill_us").alias("ts_us"), "side", "price", F.col("filled").alias("qty"), "mid_x2")
    marked = markout.priced(markout.samples(fills, book.mid_changes(best), [horizon_us]))
    return done, marked


def profits(done: DataFrame, marked: DataFrame, by: list[str], fees_tenths: tuple[int, ...]) -> DataFrame:
    """Per group and fee: orders, fills, spread captured, markout, fees and profit (x2 units); groups without a fill have zeros."""
    amount = money.notional(F.col("price"), F.col("qty"), CASH)
    got = marked.withColumn("fee_tenths", F.explode(F.lit(list(fees_tenths)))).groupBy(*by, "fee_tenths").agg(
        F.count("*").alias("n_fills"), F.sum("qty").alias("lots"), F.sum(amount).alias("notional"), F.sum("edge_x2").alias("edge_x2"), F.sum("markout_x2").alias("markout_x2"), F.sum(2 * money.fee(amount, F.col("fee_tenths").cast("long"))).alias("fees_x2"),
    )
    n = done.groupBy(*by).agg(F.count("*").alias("n_orders")).withColumn("fee_tenths", F.explode(F.lit(list(fees_tenths))))
    out = n.join(got, [*by, "fee_tenths"], "left")
    numbers = ["n_fills", "lots", "notional", "edge_x2", "markout_x2", "fees_x2"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in numbers})
    return out.withColumn("pnl_x2", F.col("markout_x2") * CASH - F.col("fees_x2"))


def evaluate(md: DataFrame, cells: DataFrame, period_us: int, fees_tenths: tuple[int, ...] = (0, 20), **options) -> DataFrame:
    """profits() per instrument, cell and fee. Trajectories don't depend on the fee, so all fees share them."""
    done, marked = fills_of(md, cells, period_us, **options)
    return profits(done, marked, ["symbol_id", "strategy", "latency_us", "model"], fees_tenths)


def matrix_summary(md: DataFrame, cells: DataFrame, period_us: int, fees_tenths: tuple[int, ...] = (0, 20), **options) -> DataFrame:
    """Per strategy, queue model, latency and fee: sums over all days and instruments, and the mean daily profit with its interval.

    A day is the day an order was placed; its profit is that of all instruments.
    """
    day = money.utc_date(F.col("ts_us")).alias("date")
    done, marked = fills_of(md, cells, period_us, **options)
    keys = ["strategy", "model", "latency_us", "fee_tenths"]
    days = profits(done.select("*", day), marked.select("*", day), ["strategy", "model", "latency_us", "date"], fees_tenths)
    days = written(days.withColumn("pnl", F.col("pnl_x2").cast("double")), "matrix-days")
    total = days.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_orders", "n_fills", "lots", "notional", "edge_x2", "markout_x2", "fees_x2", "pnl_x2")], F.avg(F.when(F.col("n_fills") > 0, F.col("edge_x2") / F.col("n_fills"))).alias("mean_edge_x2"))
    return total.join(bootstrap(days, keys, "date", "pnl"), keys)


def default_cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, m, lat) for s in STRATEGIES for m in queue.MODELS for lat in (50_000, 1_000_000)], "strategy string, model string, latency_us long")
