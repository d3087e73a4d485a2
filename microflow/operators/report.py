"""Report tables over runs: pivots, totals, break-even points, scouting, health of recordings, bootstrap intervals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The right-closed edges of the ten bins of queue fraction.
EDGES = [i / 10 for i in range(11)]


def fraction_bin(q):
    """Number of the bin [0, 0.1], (0.1, 0.2] ... that holds q, from 0; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(10)):
        out = F.when(q <= EDGES[i + 1], i).otherwise(out)
    return F.when((q >= 0) & (q <= 1), out)


def fill_surface(outcomes: DataFrame) -> DataFrame:
    """Share of filled probes by depth (rows) and bin of queue fraction (columns)."""
    rows = outcomes.withColumn("bin", fraction_bin(F.coalesce(F.try_divide(F.col("ahead").cast("double"), (F.col("ahead") + F.col("qty")).cast("double")), F.lit(0.0))))
    return rows.groupBy("depth").pivot("bin", list(range(10))).agg(F.avg(F.col("hit").cast("double")))


def break_even(curve: DataFrame, *keys: str) -> DataFrame:
    """The fee at which profit first crosses zero along rising fees, by linear interpolation; NaN without a crossing.

    curve: keys, fee, pnl.
    """
    own = Window.partitionBy(*keys).orderBy("fee") if keys else Window.partitionBy(F.lit(0)).orderBy("fee")
    rows = curve.withColumn("fee0", F.lag("fee").over(own)).withColumn("pnl0", F.lag("pnl").over(own))
    # from a side of zero onto it or over it; a curve that starts at zero hasn't crossed
    crossing = (F.col("pnl0") > 0) & (F.col("pnl") <= 0) | (F.col("pnl0") < 0) & (F.col("pnl") >= 0)
    at = F.col("fee0") + (F.col("fee") - F.col("fee0")) * F.col("pnl0") / (F.col("pnl0") - F.col("pnl"))
    return rows.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(crossing, at), F.when(crossing, F.col("fee"))), F.lit(float("nan"))).alias("break_even"))


def finite(value):
    """The value, null where it isn't finite."""
    x = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def sharpe(days: DataFrame, value: str, *keys: str) -> DataFrame:
    """Annualised by the root of 365, over finite values; NaN with fewer than two days or no spread."""
    x = finite(F.col(value).cast("double"))
    sd = F.stddev_samp(x)
    return days.groupBy(*keys).agg(F.count(x).alias("n_days"), F.when((F.count(x) >= 2) & (sd > 0), F.avg(x) / sd * math.sqrt(365)).otherwise(F.lit(float("nan"))).alias("sharpe"))


def lower_rank(rows: DataFrame, column: str, share: float, *keys: str) -> DataFrame:
    """keys and the value at index int(share * (n - 1)) of a group's sorted values, from counts of distinct values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_to", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    return ranked.where(F.col("_to") > (share * (F.col("_all") - 1)).cast("long")).groupBy(*keys).agg(F.min(column).alias(column))


def spread_scout(best: DataFrame, least_bp: float = 2.0, least_ticks: float = 3.0) -> DataFrame:
    """Spread statistics per instrument over two-sided, uncrossed moments, and whether they are wide enough to quote.

    The tick is inferred: the smallest spread seen. p90_bp is a value that was seen, at index int(0.9 (n - 1)).
    """
    rows = best.where("best_bid > 0 and best_ask > best_bid").withColumn("spread", F.col("best_ask") - F.col("best_bid")).withColumn("bp", 20000.0 * F.col("spread") / F.col("mid_x2")).withColumn("top", F.least("bid_qty", "ask_qty") * F.col("mid_x2") / 2.0)
    out = rows.groupBy("symbol_id").agg(F.count("*").alias("n"), F.percentile("mid_x2", 0.5).alias("median_mid_x2"), F.percentile("bp", 0.5).alias("median_bp"), F.percentile("spread", 0.5).alias("median_spread"), F.min("spread").alias("tick"), F.percentile("top", 0.5).alias("median_top"))
    out = out.join(lower_rank(rows, "bp", 0.9, "symbol_id").withColumnRenamed("bp", "p90_bp"), "symbol_id").withColumn("median_ticks", F.col("median_spread") / F.col("tick")).drop("median_spread")
    return out.withColumn("wide", (F.col("median_bp") >= least_bp) & (F.col("median_ticks") >= least_ticks))


def missing_hours(present: DataFrame) -> DataFrame:
    """(symbol_id, hour): hours between an instrument's first and last without a recording; present: symbol_id, hour (number)."""
    span = present.groupBy("symbol_id").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    return span.select("symbol_id", F.explode(F.sequence("lo", "hi")).alias("hour")).join(present.select("symbol_id", "hour").distinct(), ["symbol_id", "hour"], "left_anti")


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Every combination of the axes' values, out of one row of lists: a chain of cross joins would multiply the tables' partitions."""
    out = spark.createDataFrame([tuple(axes.values())], list(axes))
    for name in axes:
        out = out.withColumn(name, F.explode(name))
    return out


def paired(one: DataFrame, other: DataFrame, on: list[str], value: str, suffixes: tuple[str, str] = ("_touch", "_queue")) -> DataFrame:
    """Rows of two strategies with the same key, side by side; keys that repeat meet in every combination."""
    return one.select(*on, F.col(value).alias(value + suffixes[0])).join(other.select(*on, F.col(value).alias(value + suffixes[1])), on)


def stationary_indices(n: int, block: float, rng: np.random.Generator, resamples: int) -> np.ndarray:
    """Resamples (rows) of the stationary bootstrap: runs of geometric length with mean `block`, wrapping around."""
    jump = rng.random((resamples, n)) < 1.0 / max(1.0, block)
    jump[:, 0] = True
    start = rng.integers(0, n, (resamples, n))
    at = np.arange(n)
    begin = np.maximum.accumulate(np.where(jump, at, 0), axis=1)
    return (np.take_along_axis(start, begin, 1) + at - begin) % n


STATISTICS = {
    "mean": lambda x: x.mean(axis=-1),
    "sharpe": lambda x: np.divide(x.mean(axis=-1), sd, out=np.full(np.shape(sd), math.nan), where=sd > 0) * math.sqrt(365) if np.ndim(sd := x.std(axis=-1, ddof=1)) else (x.mean() / sd * math.sqrt(365) if sd > 0 else math.nan),
}


def _interval(values: np.ndarray, other: np.ndarray | None, statistic: str, block: float, resamples: int, level: float, seed: int) -> dict:
    stat = STATISTICS[statistic]
    keep = np.isfinite(values) if other is None else np.isfinite(values) & np.isfinite(other)
    values = values[keep]
    other = other[keep] if other is not None else None
    point = lambda i: stat(values[i]) - (stat(other[i]) if other is not None else 0.0)
    n, empty = len(values), {"estimate": math.nan, "low": math.nan, "high": math.nan, "stderr": math.nan}
    if n == 0:
        return {"n": 0} | empty
    if n == 1 and other is None:
        one = float(values[0]) if statistic == "mean" else math.nan
        return {"n": 1, "estimate": one, "low": one, "high": one, "stderr": 0.0}
    rng = np.random.default_rng(seed)
    drawn = np.concatenate([np.atleast_1d(point(stationary_indices(n, block, rng, min(1000, resamples - k)))) for k in range(0, resamples, 1000)])
    low, high = np.quantile(drawn, [(1 - level) / 2, (1 + level) / 2])
    return {"n": n, "estimate": float(point(np.arange(n))), "low": low, "high": high, "stderr": float(np.std(drawn, ddof=1)) if len(drawn) > 1 else math.nan}


def bootstrap(days: DataFrame, keys: list[str], order: str, value: str, other: str | None = None, statistic: str = "mean", block: float = 3.0, resamples: int = 10_000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """keys, n, estimate, low, high, stderr: stationary block bootstrap per group; with `other`, of the paired difference.

    A group is one run's daily values. Values that aren't finite are left out, pairs if either isn't; a pair of series of
    unequal lengths (nulls in one where the other has values) is an error. Resamples without a statistic make the
    interval NaN.
    """
    if other:
        alone = F.col(value).isNull() != F.col(other).isNull()
        days = days.withColumn(value, F.when(alone, F.raise_error(F.lit("paired series must have the same length")).cast("double")).otherwise(F.col(value)))
    schema = ", ".join([f"`{k}` {days.schema[k].dataType.simpleString()}" for k in keys] + ["n long", "estimate double", "low double", "high double", "stderr double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = _interval(pdf[value].to_numpy(float), pdf[other].to_numpy(float) if other else None, statistic, block, resamples, level, seed)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | out])

    return days.groupBy(*keys).applyInPandas(run, schema)


def axis_limits(rows: DataFrame, one: str, other: str, *keys: str) -> DataFrame:
    """Smallest and largest value over two series of a paired table, nulls left out."""
    return rows.groupBy(*keys).agg(F.least(F.min(one), F.min(other)).alias("low"), F.greatest(F.max(one), F.max(other)).alias("high"))


def wanted(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """The rows whose name is in a list; names of the list that aren't there give nothing."""
    return rows.where(F.col(column).isin(names))


def ordered(report: DataFrame, *by) -> DataFrame:
    """A report in order, with the place of each row from 1 on; for reports of a row a cell, day or horizon, not for events."""
    return report.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by))).orderBy("place")


def delay_sketches(rows: DataFrame, keys: list[str], delay: str = "delay_us") -> DataFrame:
    """keys with n and a quantile sketch of the delay: a row a group, that can be stored and merged with others later."""
    return rows.groupBy(*keys).agg(F.count(delay).alias("n"), F.kll_sketch_agg_bigint(F.col(delay).cast("long")).alias("sketch"))


def merged_delays(sketches: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """keys with n and the quantiles of all delays that the sketches have seen, as (share, delay_us)."""
    out = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return out.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(s)).alias("delay_us")) for s in shares])).alias("q")).select(*keys, "n", "q.*")
