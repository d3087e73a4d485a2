"""The order book and timers of live instruments, as keyed state: price levels, a staged snapshot, the next tick."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from microflow.operators.book import Sides
from microflow.sources.adapters import BEGIN, DEPTH, END, LEVEL

TOUCH = "symbol_id long, idx long, ts_us long, best_bid long, best_ask long, bid_qty long, ask_qty long, mid_x2 long"
#: Events that are held as Python objects at once.
BATCH = 65_536
TICKS = "symbol_id long, ts_us long"


class _Book(StatefulProcessor):
    """Levels by side and price; those of an open snapshot beside them until its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        level, qty = "side int, price long", "qty long"
        self.live, self.staged = handle.getMapState("live", level, qty), handle.getMapState("staged", level, qty)
        self.open = handle.getValueState("open", "open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = [_numbers(part) for part in rows]
        idx, *events = (np.concatenate(c) for c in zip(*columns))
        del columns
        order = np.argsort(idx, kind="stable")
        before = {(int(k[0]), int(k[1])): int(v[0]) for k, v in self.live.iterator()}
        staged = {(int(k[0]), int(k[1])): int(v[0]) for k, v in self.staged.iterator()}
        held, is_open = dict(staged), bool(self.open.exists() and self.open.get()[0])
        book = Sides(before)
        for at in range(0, len(order), BATCH):
            some, out = order[at : at + BATCH], []
            for i, ts, kind, side, price, qty, ok in zip(idx[some].tolist(), *(c[some].tolist() for c in events)):
                if kind == BEGIN:
                    staged, is_open = {}, True
                elif kind == END and is_open:
                    book, staged, is_open = Sides(staged), {}, False
                elif ok and kind == LEVEL and is_open:
                    if qty > 0:
                        staged[side, price] = qty
                elif ok and (kind == DEPTH or kind == LEVEL and qty > 0):
                    book.put(side, price, qty)
                out.append((int(key[0]), i, ts, *book.touch()))
            made = pd.DataFrame(out, columns=["symbol_id", "idx", "ts_us", "best_bid", "best_ask", "bid_qty", "ask_qty"]).astype("Int64")
            yield made.assign(mid_x2=made.best_bid + made.best_ask)
        _save(self.live, before, book.levels())
        _save(self.staged, held, staged)
        self.open.update((is_open,))


def _numbers(events: pd.DataFrame) -> list[np.ndarray]:
    """idx, ts_us, type, side, price and qty as plain numbers, -1 for null, and whether side and price are there."""
    columns = [events[c].astype("Int64").fillna(-1).to_numpy(np.int64) for c in ("idx", "ts_us", "type", "side", "price", "qty")]
    return [*columns, (events["price"].notna() & events["side"].notna()).to_numpy()]


def _save(state, before: dict, now: dict) -> None:
    """Only what has changed is written."""
    for k in before.keys() - now.keys():
        state.removeKey(k)
    for k, v in now.items():
        if before.get(k) != v:
            state.updateValue(k, (v,))


def touch(events: DataFrame) -> DataFrame:
    """book.bbo() of a stream: best prices and quantities after each event, whatever the triggers.

    events: symbol_id, idx, ts_us, type, side, price, qty. Within a trigger rows are put in order of idx, and triggers are
    expected to follow it; an instrument's events of a trigger are held as plain arrays, some 60 bytes each. State is an entry a level, so an instrument's book is read once a trigger and only
    changed levels are written; it survives a restart from the query's checkpoint.
    """
    rows = events.select("symbol_id", "idx", "ts_us", F.col("type").cast("int").alias("type"), F.col("side").cast("int").alias("side"), F.col("price").cast("long").alias("price"), F.col("qty").cast("long").alias("qty"))
    return rows.groupBy("symbol_id").transformWithStateInPandas(_Book(), TOUCH, "append", "none")


class _Ticks(StatefulProcessor):
    """First and last event so far, and the tick that comes next; a timer stands at it."""

    def __init__(self, period_us: int):
        self.period_us = period_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long, next long, fired boolean")

    def _plan(self, first: int, last: int, nxt: int, fired: bool) -> None:
        """Remembers the next tick and sets the only timer to it, if an event has reached it."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(t))
        if nxt <= last:
            self.handle.registerTimer(-(-nxt // 1000))
        self.seen.update((first, last, nxt, fired))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = [(int(p["ts_us"].min()), int(p["ts_us"].max())) for p in rows if len(p)]
        lo, hi = min(a for a, _ in spans), max(z for _, z in spans)
        first, last, nxt, fired = self.seen.get() if self.seen.exists() else (lo, hi, lo + self.period_us, False)
        if not fired and lo < first:  # an earlier first event, within the lateness
            first, nxt = lo, lo + self.period_us
        self._plan(first, max(last, hi), nxt, fired)
        yield pd.DataFrame({"symbol_id": [], "ts_us": []}, dtype="int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, nxt, fired = self.seen.get()
        until = min(last, timerValues.getCurrentWatermarkInMs() * 1000)
        n = max(0, (until - nxt) // self.period_us + 1)
        self._plan(first, last, nxt + n * self.period_us, fired or n > 0)
        for at in range(0, n, 65536):
            ts = nxt + np.arange(at, min(n, at + 65536), dtype=np.int64) * self.period_us
            yield pd.DataFrame({"symbol_id": np.full(len(ts), int(key[0]), np.int64), "ts_us": ts})


def ticks(events: DataFrame, period_us: int, late: str = "10 minutes") -> DataFrame:
    """sync.timers() of a stream: ticks fire by registered timers, once the watermark has passed them.

    events: symbol_id and ts_us, in any order that `late` allows; later ones are left out. A tick beyond an instrument's last event waits for
    its next one. All that a watermark has passed fires at once, so a jump in time costs one call, not one a tick.
    """
    rows = events.select("symbol_id", "ts_us", F.timestamp_micros("ts_us").alias("at")).withWatermark("at", late)
    return rows.groupBy("symbol_id").transformWithStateInPandas(_Ticks(period_us), TICKS, "append", "eventTime")
