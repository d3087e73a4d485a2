"""Streaming twins of batch operators: windowed counters, sliding flow, and gaps with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from microflow.functions.decode import envelopes

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def recordings(spark: SparkSession, folder: str, max_files: int = 24) -> DataFrame:
    """Recorder lines as they arrive in a folder of hourly files, decoded; malformed lines are flagged, not dropped."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder)
    return envelopes(lines)


def counters(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events, prints and volume per instrument and tumbling window; rows later than `late` are left out.

    events: symbol_id, ts (timestamp), type, qty.
    """
    trade = F.col("type") == 1
    out = events.withWatermark("ts", late).groupBy("symbol_id", F.window("ts", width)).agg(F.count("*").alias("n"), F.count_if(trade).alias("n_trades"), F.coalesce(F.sum(F.when(trade, F.col("qty"))), F.lit(0)).alias("volume"))
    return out.select("symbol_id", F.unix_micros("window.start").alias("start_us"), "n", "n_trades", "volume")


def sliding_flow(events: DataFrame, width: str = "30 minutes", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Signed share of aggressive volume per instrument and sliding window."""
    signed = F.when(F.col("side") == 0, F.col("qty")).otherwise(-F.col("qty"))
    out = events.where("type = 1").withWatermark("ts", late).groupBy("symbol_id", F.window("ts", width, step)).agg(F.sum("qty").alias("volume"), F.sum(signed).alias("net"))
    return out.select("symbol_id", F.unix_micros("window.start").alias("start_us"), "volume", "net", F.coalesce(F.try_divide(F.col("net").cast("double"), F.col("volume").cast("double")), F.lit(0.0)).alias("imbalance"))


STATE = "synced boolean, last long, accepted long, dirty boolean, futures boolean"
GAPS = "symbol_id long, ln long, expected long, got long"


_NONE = np.iinfo(np.int64).min + 1


def _gaps(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The closed form of operators.sync on a trigger's rows; what went before is the state that epoch 0 begins with."""
    synced, last, accepted, dirty, futures = state.get if state.exists else (False, 0, 0, False, None)
    rows = pd.concat(list(parts)).sort_values("ln", ignore_index=True)
    number = lambda c: rows[c].astype("Int64").fillna(_NONE).to_numpy(np.int64)
    snap, depth = (rows.kind == "snapshot").to_numpy(), (rows.kind == "depth").to_numpy()
    first, final, prev, has_prev = number("first_id"), number("final_id"), number("prev_id"), rows.prev_id.notna().to_numpy()
    epoch = np.cumsum(snap)
    known = (epoch > 0) | bool(synced)
    start = np.where((epoch == 0) & bool(synced), last, _NONE)
    top = pd.Series(np.where(snap | depth & known, final, _NONE)).groupby(epoch).cummax()
    before = np.maximum(top.groupby(epoch).shift(fill_value=_NONE).to_numpy(np.int64), start)
    new = depth & known & (final > before)
    earlier = pd.Series(new.astype(np.int64)).groupby(epoch).cumsum().to_numpy() - new + np.where(epoch == 0, accepted, 0)
    if futures is None and new.any():
        futures = bool(has_prev[new.argmax()])
    follow = bool(futures) & has_prev & (earlier > 0)
    good = np.where(earlier == 0, (first <= before + 1) & (final >= before + 1), np.where(follow, prev == before, first == before + 1))
    gap = new & ~good
    now = epoch == epoch[-1]
    if known[-1]:
        begun = epoch[-1] > 0
        last = int(max(top[now].max(), _NONE if begun or not synced else last))
        accepted = int(new[now].sum()) + (0 if begun else accepted)
        dirty = bool(gap[now].any()) or (dirty and not begun)
    state.update((bool(known[-1]), last, accepted, dirty, futures))
    expected, got = np.where(follow, before, before + 1), np.where(follow, prev, first)
    yield pd.DataFrame({"symbol_id": np.full(int(gap.sum()), int(key[0])), "ln": rows.ln.to_numpy(np.int64)[gap], "expected": expected[gap], "got": got[gap]})


def gaps(messages: DataFrame) -> DataFrame:
    """Breaks of the update sequence per instrument, across micro-batches; state is five values per instrument.

    messages as for operators.sync.synchronised; within a trigger rows are put in arrival order, and triggers are
    expected to follow arrival.
    """
    return messages.groupBy("symbol_id").applyInPandasWithState(_gaps, GAPS, STATE, "append", GroupStateTimeout.NoTimeout)
