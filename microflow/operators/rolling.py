"""Estimators over trailing time: volatility from spaced observations, signed flow, and what it triggers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from microflow.operators.windows import carried, day_of, trailing


#: Spacings that one stretch of observations covers.
SPACINGS = 256


def _next(ts: np.ndarray, sample_us: int) -> np.ndarray:
    """For each observation the next one that may be kept after it; len(ts) for none."""
    return np.maximum(np.searchsorted(ts, ts + sample_us, side="left"), np.arange(1, len(ts) + 1))


def _exits(t: pa.Table, sample_us: int, span_us: int, keys: list[str]) -> pa.Table:
    """A stretch as a table of entry and exit: if it is entered at a time up to `upto`, its last kept observation is at `last`."""
    ts = np.sort(t["ts_us"].to_numpy())
    nxt, last = _next(ts, sample_us), ts.copy()
    for i in range(len(ts) - 1, -1, -1):
        if nxt[i] < len(ts):
            last[i] = last[nxt[i]]
    near = ts <= ts[np.searchsorted(ts, ts[0] // span_us * span_us + sample_us, side="left").clip(max=len(ts) - 1)]
    ts, last = ts[near], last[near]
    ends = np.append(last[1:] != last[:-1], True)  # a row for each run of entries with one exit is enough
    return pa.table({k: t[k].slice(0, 1).combine_chunks().take(pa.array(np.zeros(ends.sum(), np.int64))) for k in keys} | {"upto": pa.array(ts[ends]), "last": pa.array(last[ends])})


def spaced(rows: DataFrame, sample_us: int, keys: tuple[str, ...] = ("symbol_id", "day"), value: str = "mid_x2") -> DataFrame:
    """Greedy down-sampling: a group's first observation, then each that comes sample_us or more after the last one kept.

    A group is an instrument's day, or its whole history. It is cut into stretches of SPACINGS spacings. Where a stretch is entered decides
    where it is left, so each is first reduced to a table of entries and exits, of a row per distinct exit; these are composed in
    order, which tells each stretch its entry, and then all stretches are sampled side by side. No task holds a group.
    """
    used = rows.select(*keys, "ts_us", "idx", F.col(value))
    if sample_us <= 0:
        return used
    span_us = SPACINGS * sample_us
    cut = used.select("*", F.floor(F.col("ts_us") / span_us).cast("long").alias("stretch"))
    by, kinds = [*keys, "stretch"], {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    exits = cut.select(*by, "ts_us").groupBy(*by).applyInArrow(lambda t: _exits(t, sample_us, span_us, by), ", ".join(f"{k} {kinds[k]}" for k in by) + ", upto long, last long")
    tables = exits.groupBy(*keys, "stretch").agg(F.array_sort(F.collect_list(F.struct("upto", "last"))).alias("x"))
    tables = tables.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("stretch", "x"))).alias("t"))
    # need: the first time that may be kept; a stretch whose observations all come before it hands it on
    low = "cast(-9000000000000000000 as bigint)"
    exit_ = f"get(filter(s.x, e -> e.upto >= a.need), 0).last + {sample_us}"
    step = f"struct(concat(a.found, array(struct(s.stretch as stretch, a.need as need))) as found, coalesce({exit_}, a.need) as need)"
    start = f"struct(cast(array() as array<struct<stretch:bigint,need:bigint>>) as found, {low} as need)"
    entries = tables.select(*keys, F.explode(F.expr(f"aggregate(t, {start}, (a, s) -> {step}, a -> a.found)")).alias("e")).select(*keys, "e.stretch", "e.need")

    names = used.columns

    def keep(t: pa.Table) -> pa.Table:
        ts, idx = t["ts_us"].to_numpy(), t["idx"].to_numpy()
        order = np.lexsort((idx, ts))
        ts, kept = ts[order], []
        nxt, at = _next(ts, sample_us), int(np.searchsorted(ts, t["need"][0].as_py(), side="left"))
        while at < len(ts):
            kept.append(at)
            at = int(nxt[at])
        return t.select(names).take(pa.array(order[kept], pa.int64()))

    return cut.join(entries, by).groupBy(*by).applyInArrow(keep, used.schema)


def sigma(kept: DataFrame, window_us: int, keys: tuple[str, ...] = ("symbol_id", "day"), value: str = "mid_x2") -> DataFrame:
    """kept with n (returns in the window), variance per second and sigma, in ticks: squared moves over elapsed time.

    A return counts if its end is at most window_us before the row.
    """
    own = Window.partitionBy(*keys).orderBy("ts_us")
    rows = kept.withColumn("d2", F.pow((F.col(value) - F.lag(value).over(own)) / 2.0, 2)).withColumn("dt", (F.col("ts_us") - F.lag("ts_us").over(own)) / 1e6)
    over = own.rangeBetween(-window_us, 0)
    rows = rows.withColumn("n", F.count("d2").over(over)).withColumn("variance", F.coalesce(F.try_divide(F.sum("d2").over(over), F.sum("dt").over(over)), F.lit(0.0)))
    return rows.withColumn("sigma", F.sqrt("variance")).drop("d2", "dt")


def flow(trades: DataFrame, window_us: int, keys: tuple[str, ...] = ("symbol_id",)) -> DataFrame:
    """trades with volume and imbalance: signed over total aggressive lots of the trailing window, both ends included."""
    signed = F.when(F.col("side") == 0, F.col("qty")).otherwise(-F.col("qty"))
    rows = trailing(trades, list(keys), window_us, {"volume": F.sum("qty"), "net": F.sum(signed)})
    return rows.withColumn("imbalance", F.coalesce(F.try_divide(F.col("net").cast("double"), F.col("volume").cast("double")), F.lit(0.0)))


def pulls(flowing: DataFrame, threshold: float, pull_us: int, keys: tuple[str, ...] = ("symbol_id",)) -> DataFrame:
    """flow() with the quote side that is pulled at each trade, if any: the latest trigger's, for pull_us from it."""
    hit = F.abs("imbalance") >= threshold
    last = F.when(hit, F.struct(F.col("ts_us").alias("t"), F.when(F.col("imbalance") > 0, 1).otherwise(0).alias("s")))
    rows = carried(flowing.withColumn("day", day_of("ts_us")), list(keys), "day", ["ts_us", "idx"], lasts={"trigger": last})
    rows = rows.withColumn("trigger_us", F.col("trigger.t")).withColumn("trigger_side", F.col("trigger.s")).drop("trigger", "day")
    return rows.withColumn("pulled", F.when(F.col("ts_us") < F.col("trigger_us") + pull_us, F.col("trigger_side")))
