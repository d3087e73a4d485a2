"""Arrival intensity by distance from the mid, and its exponential fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microflow.sources.adapters import BID, TRADE


def hazard_points(md: DataFrame, best: DataFrame, bucket_us: int, deepest: int) -> DataFrame:
    """(symbol_id, delta, seconds, bid_hits, ask_hits, rate): buckets in which prints reached delta ticks from the mid.

    A bucket counts if it has a two-sided mid; the first of these is its reference. The deepest print that sold hits bids
    up to its distance below the mid, the highest that bought hits asks. Times are exchange times. Rows of a `dirty` column,
    where md or best has one, move the book but count neither as prints nor as mids.
    """
    slot = F.floor(F.col("ts_us") / bucket_us)
    md, best = (x.where(~F.col("dirty")) if "dirty" in x.columns else x for x in (md, best))
    mids = best.where("mid_x2 is not null").groupBy("symbol_id", slot.alias("slot")).agg(F.min_by("mid_x2", "idx").alias("mid_x2"))
    prints = md.where(F.col("type") == TRADE).groupBy("symbol_id", slot.alias("slot")).agg(F.min(F.when(F.col("side") != BID, F.col("price"))).alias("sold"), F.max(F.when(F.col("side") == BID, F.col("price"))).alias("bought"))
    rows = mids.join(prints, ["symbol_id", "slot"], "left").select("symbol_id", (F.col("mid_x2") / 2.0 - F.col("sold")).alias("down"), (F.col("bought") - F.col("mid_x2") / 2.0).alias("up"))
    rows = rows.withColumn("delta", F.explode(F.sequence(F.lit(1), F.lit(deepest))))
    out = rows.groupBy("symbol_id", "delta").agg((F.count("*") * (bucket_us / 1e6)).alias("seconds"), F.count_if(F.col("down") >= F.col("delta")).alias("bid_hits"), F.count_if(F.col("up") >= F.col("delta")).alias("ask_hits"))
    return out.withColumn("rate", (F.col("bid_hits") + F.col("ask_hits")) / 2.0 / F.col("seconds"))


def fit(points: DataFrame, *keys: str, near: int = 10) -> DataFrame:
    """ln rate = ln a - k delta over positive rates up to `near` ticks: k, a, r2 and n; ok with two points and a spread of deltas."""
    used = points.where((F.col("rate") > 0) & (F.col("delta") <= near)).withColumn("y", F.log("rate"))
    d = F.col("delta").cast("double")
    out = used.groupBy(*keys).agg(F.regr_slope("y", d).alias("slope"), F.regr_intercept("y", d).alias("icept"), F.regr_r2("y", d).alias("r2"), F.count("*").alias("n"), F.var_pop("y").alias("spread"))
    flat = F.coalesce(F.col("spread") == 0, F.lit(True))
    return out.select(*keys, (-F.col("slope")).alias("k"), F.exp("icept").alias("a"), F.when(flat, 0.0).otherwise(F.col("r2")).alias("r2"), "n", ((F.col("n") >= 2) & F.col("slope").isNotNull()).alias("ok"))
