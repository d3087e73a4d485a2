"""Running inventory, cash and profit in exact integers, with their decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from microflow.functions.grid import fee, notional, sign, to_cash, utc_date, x2_to_cash
from microflow.operators.windows import carried, day_of


def running(fills: DataFrame, marks: DataFrame, cash: int, maker_tenths: int = 20, taker_tenths: int = 50, keys: tuple[str, ...] = ("symbol_id",)) -> DataFrame:
    """One row per fill and mark in time order with the ledger after it; money in doubled 1e-8 units (x2).

    fills: keys, ts_us, seq, side (0 bought), price, qty, mid_x2, maker. marks: keys, ts_us, seq, mid_x2. A fill
    marks the book at its mid first, then changes the inventory. Columns: inventory, cash_x2, spread_x2 (mid against price), inventory_x2
    (inventory held while the mid moved), fees_x2, equity_x2, residual_x2: equity less the three parts, always 0.
    """
    f = fills.select(*keys, "ts_us", "seq", F.lit(1).alias("is_fill"), "side", "price", "qty", "mid_x2", "maker")
    m = marks.select(*keys, "ts_us", "seq", F.lit(0).alias("is_fill"), "mid_x2")
    line = m.unionByName(f, allowMissingColumns=True)
    order = ["ts_us", "seq", "is_fill"]
    bought = F.coalesce(sign(F.col("side")) * F.col("qty"), F.lit(0)).cast("long")
    amount = F.coalesce(notional(F.col("price"), F.col("qty"), cash), F.lit(0))
    rate = F.when(F.coalesce("maker", F.lit(True)), maker_tenths).otherwise(taker_tenths).cast("long")
    rows = line.withColumn("bought", bought).withColumn("amount", amount).withColumn("fee", F.when(F.col("is_fill") == 1, fee(F.col("amount"), rate)).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("spread", F.when(F.col("is_fill") == 1, sign(F.col("side")) * (F.col("mid_x2") - 2 * F.col("price")) * F.col("qty") * cash).otherwise(F.lit(0).cast("long")))
    rows = carried(rows.withColumn("day", day_of("ts_us")), list(keys), "day", order, sums={"inventory": F.col("bought")}, lags={"mid_before": F.col("mid_x2")})
    held = F.col("inventory") - F.col("bought")
    rows = rows.withColumn("moved", F.coalesce(held * (F.col("mid_x2") - F.col("mid_before")) * cash, F.lit(0)))
    paid = 2 * F.coalesce(sign(F.col("side")), F.lit(0)) * F.col("amount")
    rows = carried(rows, list(keys), "day", order, sums={"cash_x2": -paid - 2 * F.col("fee"), "spread_x2": F.col("spread"), "inventory_x2": F.col("moved"), "fees_x2": 2 * F.col("fee")}).drop("day", "mid_before")
    rows = rows.withColumn("equity_x2", F.col("cash_x2") + F.col("inventory") * F.col("mid_x2") * cash)
    return rows.withColumn("residual_x2", F.col("equity_x2") - (F.col("spread_x2") + F.col("inventory_x2") - F.col("fees_x2")))


def daily(rows: DataFrame, keys: tuple[str, ...] = ("symbol_id",)) -> DataFrame:
    """Per day: sums of the parts, fills, notional, end inventory, and the change of equity from the day before's end."""
    day = rows.withColumn("date", utc_date(F.col("ts_us")))
    last = F.struct("ts_us", "seq", "is_fill")
    out = day.groupBy(*keys, "date").agg(
        F.sum("spread").alias("spread_x2"), F.sum("moved").alias("inventory_x2"), F.sum(2 * F.col("fee")).alias("fees_x2"), F.sum("is_fill").alias("n_fills"), F.sum("amount").alias("notional"), F.max_by("inventory", last).alias("end_inventory"), F.max_by("equity_x2", last).alias("end_equity_x2"),
    )
    before = F.lag("end_equity_x2").over(Window.partitionBy(*keys).orderBy("date"))
    out = out.withColumn("change_x2", F.col("end_equity_x2") - F.coalesce(before, F.lit(0)))
    return out.withColumn("residual_x2", F.col("change_x2") - (F.col("spread_x2") + F.col("inventory_x2") - F.col("fees_x2")))


def daily_table(days: DataFrame, adverse: DataFrame, quotes: DataFrame, tags: dict, dirty: DataFrame | None = None) -> DataFrame:
    """daily() as the report's table: money as numbers, the run's tags, quotes and dirty events per day.

    adverse: symbol_id, adverse_bp. quotes, dirty: symbol_id, date and quotes_placed or dirty_events; days without are 0.
    """
    rows = days.join(adverse, "symbol_id", "left").join(quotes, ["symbol_id", "date"], "left")
    rows = rows.join(dirty, ["symbol_id", "date"], "left") if dirty is not None else rows.withColumn("dirty_events", F.lit(0))
    total = F.col("spread_x2") + F.col("inventory_x2") - F.col("fees_x2")
    return rows.select(
        "symbol_id", "date", *[F.lit(v).alias(k) for k, v in tags.items()], x2_to_cash(F.col("spread_x2")).alias("spread_capture"), x2_to_cash(F.col("inventory_x2")).alias("inventory_pnl"), x2_to_cash(-F.col("fees_x2")).alias("fees"), x2_to_cash(total).alias("total"), x2_to_cash(F.col("change_x2")).alias("equity_change"),
        (F.col("change_x2") - total).alias("identity_residual_x2"), F.coalesce("adverse_bp", F.lit(0.0)).alias("adverse_selection_10s_bp"), F.col("n_fills").alias("fills"), F.coalesce("quotes_placed", F.lit(0)).alias("quotes_placed"), to_cash(F.col("notional")).alias("notional_traded"), F.coalesce("dirty_events", F.lit(0)).alias("dirty_events"),
    )
