"""Late rows and trailing volatility of live instruments, as keyed state with eviction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from microflow.sources.adapters import BEGIN, DEPTH, END, LEVEL, TRADE

_EVENT = ("ts_us", "seq", "type", "side", "price", "qty")
ORDERED = "symbol_id long, " + ", ".join(f"{c} long" for c in _EVENT) + ", idx long, late boolean"
_RANK = {BEGIN: 0, LEVEL: 1, END: 2, TRADE: 3, DEPTH: 4}


def _whole(x) -> int | None:
    return None if x is None or x != x else int(x)


class _Ordered(StatefulProcessor):
    """Events that may still be overtaken, the latest time so far, and how many have gone on."""

    def __init__(self, late_us: int):
        self.late_us = late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", ", ".join(f"{c} long" for c in _EVENT))
        self.seen = handle.getValueState("seen", "top long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come = [tuple(map(_whole, r)) for p in rows for r in p[list(_EVENT)].itertuples(index=False)]
        top, n = self.seen.get() if self.seen.exists() else (None, 0)
        closed = None if top is None else top - self.late_us
        events = [r for r in come if r[1] is not None]  # a row without seq only tells the time
        late = [r for r in events if closed is not None and r[0] < closed]
        held = [tuple(map(_whole, r)) for r in self.held.get()] if self.held.exists() else []
        held += [r for r in events if closed is None or r[0] >= closed]
        top = max([r[0] for r in come] + ([] if top is None else [top]))
        ready = sorted((r for r in held if r[0] < top - self.late_us), key=lambda r: (r[0], _RANK[r[2]], r[1]))
        keep = [r for r in held if r[0] >= top - self.late_us]
        self.held.put(keep) if keep else self.held.clear()
        self.seen.update((top, n + len(ready)))
        out = [(int(key[0]), *r, n + i, False) for i, r in enumerate(ready)] + [(int(key[0]), *r, None, True) for r in late]
        yield pd.DataFrame(out, columns=["symbol_id", *_EVENT, "idx", "late"]).astype({"symbol_id": "int64"} | {c: "Int64" for c in (*_EVENT, "idx")} | {"late": "bool"})


def ordered(events: DataFrame, late_us: int) -> DataFrame:
    """Events that come out of order, in replay order with idx, once late_us have passed; later ones with late = true and no idx.

    events: symbol_id, ts_us, seq, type, side, price, qty. An instrument is complete up to late_us before the latest time it has
    shown in earlier triggers; what comes for a time before that is late and goes on at once, for a table of its own
    (`sinks.exactly_once` splits by `late`). So nothing is lost: kept, late and held rows are the input. A row without seq is a
    heartbeat that only moves the time on. State holds late_us of an instrument's events.
    """
    rows = events.select("symbol_id", *[F.col(c).cast("long").alias(c) for c in _EVENT])
    return rows.groupBy("symbol_id").transformWithStateInPandas(_Ordered(late_us), ORDERED, "append", "none")


SIGMA = "symbol_id long, day long, ts_us long, idx long, mid_x2 long, n long, variance double, sigma double"


class _Sigma(StatefulProcessor):
    """The last kept observation and the ring of returns that the window still holds."""

    def __init__(self, sample_us: int, window_us: int):
        self.sample_us, self.window_us = sample_us, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts_us long, mid_x2 long")
        self.ring = handle.getListState("ring", "ts_us long, d2 double, dt double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["ts_us", "idx"])
        last = self.last.get() if self.last.exists() else None
        ring, out = [tuple(r) for r in self.ring.get()] if self.ring.exists() else [], []
        for ts, idx, mid in zip(seen["ts_us"].tolist(), seen["idx"].tolist(), seen["mid_x2"].tolist()):
            if last is not None and ts - last[0] < self.sample_us:
                continue
            if last is not None:
                ring.append((ts, ((mid - last[1]) / 2.0) ** 2, (ts - last[0]) / 1e6))
            ring = [r for r in ring if r[0] >= ts - self.window_us]
            last, time = (ts, mid), sum(r[2] for r in ring)
            variance = sum(r[1] for r in ring) / time if time else 0.0
            out.append((*map(int, key), ts, idx, mid, len(ring), variance, variance**0.5))
        self.last.update(last)
        self.ring.put(ring) if ring else self.ring.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SIGMA.split(", ")])


def volatility(mids: DataFrame, sample_us: int, window_us: int) -> DataFrame:
    """rolling.sigma(rolling.spaced(mids)) of a stream of two-sided mids (symbol_id, ts_us, idx, mid_x2), per instrument and day.

    Triggers are expected to follow the time of an instrument. State is a ring of at most window over spacing returns; what leaves the window is evicted.
    """
    day = F.floor(F.col("ts_us") / 86_400_000_000).cast("long").alias("day")
    rows = mids.select("symbol_id", day, "ts_us", "idx", F.col("mid_x2").cast("long").alias("mid_x2"))
    return rows.groupBy("symbol_id", "day").transformWithStateInPandas(_Sigma(sample_us, window_us), SIGMA, "append", "none")
