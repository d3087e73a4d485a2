"""The order book as a change stream: levels as intervals, and what the book looks like at chosen events."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from microflow.operators.windows import carried, day_of
from microflow.sources.adapters import ASK, BEGIN, BID, DEPTH, END, LEVEL
from microflow.sources.shared import sent, written

#: Events of an instrument that one ordered pass covers.
CHUNK = 4096
#: Events of an instrument that are joined with the levels alive among them.
JOINED = 256


def snapshots(md: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, ends): md's updates and levels with epoch, the snapshots ended up to them, and ctl, the last begin or end before them.

    ends: symbol_id, begin, ended, epoch of each whole snapshot, from its last begin to its end; an end without an open
    snapshot is none.
    """
    marks = md.where(F.col("type").isin(BEGIN, END)).withColumn("stretch", F.floor(F.col("idx") / (16 * CHUNK)))
    marks = carried(marks.select("symbol_id", "stretch", "idx", "type"), ["symbol_id"], "stretch", ["idx"], lags={"was": F.col("type")})
    whole = marks.where((F.col("type") == END) & (F.col("was") == BEGIN))
    rows = md.where(F.col("type").isin(DEPTH, LEVEL, BEGIN)).drop("epoch").unionByName(whole.select("symbol_id", "idx", "type"), allowMissingColumns=True)
    rows = carried(rows.withColumn("stretch", F.floor(F.col("idx") / (16 * CHUNK))), ["symbol_id"], "stretch", ["idx"], sums={"epoch": (F.col("type") == END).cast("int")}, lasts={"ctl": F.when(F.col("type").isin(BEGIN, END), F.struct("type", "idx"))}, exclusive=("ctl",))
    rows = written(rows.withColumn("epoch", F.coalesce("epoch", F.lit(0))).drop("stretch"), "staged")
    return rows, rows.where(F.col("type") == END).select("symbol_id", F.col("ctl.idx").alias("begin"), F.col("idx").alias("ended"), "epoch")


def levels(md: DataFrame) -> DataFrame:
    """(symbol_id, side, price, qty, from_idx, to_idx): each quantity a level has held, and while which events.

    An update replaces the level's quantity; zero or less deletes it. Prints don't move the book. A snapshot (rows of
    type BEGIN, LEVEL and END; md then has a column `epoch`) is staged: at its end it replaces both sides at once, until
    then the old book stands. Each begin empties what is staged, so one that never ends has no effect; an end without a
    begin has none either, and a level outside a snapshot is an update. Levels of a snapshot without a quantity are
    ignored. to_idx is exclusive; what is alive at the end ends one past the instrument's last event. Null prices or sides make
    no level.
    """
    last = sent(md.groupBy("symbol_id").agg((F.max("idx") + 1).alias("end_idx")), "ends")
    if "epoch" in md.columns:
        rows, ends = snapshots(md)
        level = F.col("type") == LEVEL
        rows = rows.where(F.col("price").isNotNull() & F.col("side").isNotNull() & ((F.col("type") == DEPTH) | level & (F.col("qty") > 0)))
        staged = level & F.coalesce(F.col("ctl.type") == BEGIN, F.lit(False))
        rows = rows.withColumn("begin", F.when(staged, F.col("ctl.idx"))).drop("ctl")
        now = rows.where("begin is null").withColumn("from_idx", F.col("idx"))
        then = rows.where("begin is not null").drop("epoch").join(ends, ["symbol_id", "begin"]).withColumnRenamed("ended", "from_idx")
        rows = now.unionByName(then).join(ends.select("symbol_id", (F.col("epoch") - 1).alias("epoch"), "ended"), ["symbol_id", "epoch"], "left")
    else:
        rows = md.where((F.col("type") == DEPTH) & F.col("price").isNotNull() & F.col("side").isNotNull()).withColumns({"epoch": F.lit(0), "from_idx": F.col("idx"), "ended": F.lit(None).cast("long")})
    own = Window.partitionBy("symbol_id", "side", "price", "epoch").orderBy("from_idx", "idx")
    spans = rows.withColumn("next_idx", F.lead("from_idx").over(own)).where("qty > 0").join(last, "symbol_id")
    spans = spans.select("symbol_id", "side", "price", F.col("qty").cast("long").alias("qty"), F.col("from_idx").cast("long").alias("from_idx"), F.least("next_idx", "ended", "end_idx").cast("long").alias("to_idx"))
    return spans.where("from_idx < to_idx")


class _Side:
    """Quantities by price, and the best price by a heap whose dead entries are skipped."""

    def __init__(self, sign: int):
        self.sign, self.qty, self.heap = sign, {}, []

    def put(self, price: int, qty: int) -> None:
        if qty > 0:
            if price not in self.qty:
                heappush(self.heap, self.sign * price)
            self.qty[price] = qty
        else:
            self.qty.pop(price, None)

    def best(self):
        while self.heap:
            price = self.sign * self.heap[0]
            if price in self.qty:
                return price
            heappop(self.heap)
        return None


class Sides:
    """Both sides of a book."""

    def __init__(self, levels: dict | None = None):
        self.sides = (_Side(-1), _Side(1))
        for (side, price), qty in (levels or {}).items():
            self.put(side, price, qty)

    def put(self, side: int, price: int, qty: int) -> None:
        self.sides[side].put(price, qty)

    def touch(self) -> tuple:
        """Best bid and ask, and their quantities; None where a side is empty."""
        b, a = self.sides[0].best(), self.sides[1].best()
        return b, a, self.sides[0].qty.get(b), self.sides[1].qty.get(a)

    def levels(self) -> dict:
        return {(k, price): qty for k, side in enumerate(self.sides) for price, qty in side.qty.items()}


_FOUND = ("best_bid", "best_ask", "bid_qty", "ask_qty", "bid_depth", "ask_depth")
#: Of a whole book: the number of levels of a side, and the sum of their names, which stands for every price and quantity.
_WHOLE = ("n_bids", "n_asks", "bids", "asks")


def _names(price: np.ndarray, qty: np.ndarray) -> np.ndarray:
    """64-bit names of levels; sums of names are taken modulo 2**64."""
    x = price.astype(np.int64).view(np.uint64)
    for y in (qty.astype(np.int64).view(np.uint64), np.uint64(0)):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = (x ^ (x >> np.uint64(31))) + y * np.uint64(0x9E3779B97F4A7C15)
    return x


def _signed(x: int) -> int:
    return ((x + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


def book_at(md: DataFrame, points: DataFrame | None = None, ticks: int = 0, whole: bool = False) -> DataFrame:
    """(symbol_id, idx, ts_us, best_bid, best_ask, bid_qty, ask_qty, bid_depth, ask_depth) after each point (symbol_id, idx, ts_us).

    Depths: lots within `ticks` of the best price of a side, inclusive; 0 for an empty side or ticks below 0. whole: also
    n_bids, n_asks, bids and asks, numbers of levels and names of all levels of a side.

    An instrument's events are cut into chunks. A chunk gets the levels that are alive at its start and the changes within
    it, and passes over them in order: the work is one step a change and point, and chunks are tasks of their own.
    """
    points = md if points is None else points
    spans = levels(md)
    first, last = f"from_idx div {CHUNK}", f"(to_idx - 1) div {CHUNK}"
    # a level's beginning and its end, and in each run of 1024 chunks the starts of the later ones that it lives to see
    runs = spans.select("symbol_id", F.col("side").cast("int").alias("side"), F.col("price").cast("long").alias("price"), "qty", "from_idx", "to_idx", F.posexplode(F.expr(f"sequence({first} div 1024, {last} div 1024)")).alias("run", "k"))
    starts = f"filter(sequence(greatest({first} + 1, k * 1024), greatest({first} + 1, k * 1024, least({last}, k * 1024 + 1023))), c -> c <= {last})"
    edges = "if(run = 0, array(struct(from_idx as idx, 2 as order, qty as qty), struct(to_idx as idx, 1 as order, 0L as qty)), cast(array() as array<struct<idx:bigint,order:int,qty:bigint>>))"
    steps = f"concat({edges}, transform({starts}, c -> struct(c * {CHUNK} as idx, 0 as order, qty as qty)))"
    rows = runs.select("symbol_id", "side", "price", F.explode(F.expr(steps)).alias("x")).select("symbol_id", F.expr(f"x.idx div {CHUNK}").alias("chunk"), "x.idx", "x.order", "side", "price", "x.qty")
    asked = points.select("symbol_id", F.expr(f"idx div {CHUNK}").alias("chunk"), "idx", F.lit(3).alias("order"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("price"), F.col("ts_us").cast("long").alias("qty"))
    rows = rows.unionByName(asked)

    def walk(t: pa.Table) -> pa.Table:
        order, idx = t["order"].to_numpy(), t["idx"].to_numpy()
        by = np.lexsort((order, idx))
        book, out, named, sums = Sides(), [], ({}, {}), [0, 0]
        bids, asks = (side.qty for side in book.sides)
        prices, quantities = t["price"].to_numpy()[by], t["qty"].to_numpy()[by]
        names = _names(prices, quantities).tolist() if whole else [0] * len(by)
        for i, k, side, price, qty, name in zip(idx[by].tolist(), order[by].tolist(), t["side"].to_numpy()[by].tolist(), prices.tolist(), quantities.tolist(), names):
            if k < 3:
                book.put(side, price, qty)
                if whole:
                    sums[side] -= named[side].pop(price, 0)
                    if qty > 0:
                        named[side][price] = name
                        sums[side] += name
                continue
            b, a, *best = book.touch()
            deep = range(ticks + 1)
            every = (len(bids), len(asks), *map(_signed, sums)) if whole else ()
            out.append((i, qty, b, a, *best, 0 if b is None else sum(bids.get(b - j, 0) for j in deep), 0 if a is None else sum(asks.get(a + j, 0) for j in deep), *every))
        cols = list(zip(*out)) or [()] * len(made)
        return pa.table({"symbol_id": pa.array([t["symbol_id"][0].as_py()] * len(out), pa.int64())} | {n: pa.array(c, pa.int64()) for n, c in zip(made, cols)})

    made = ("idx", "ts_us", *_FOUND, *(_WHOLE if whole else ()))
    schema = ", ".join(f"{c} long" for c in ("symbol_id", *made))
    return rows.groupBy("symbol_id", "chunk").applyInArrow(walk, schema)


def bbo(md: DataFrame, points: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(symbol_id, idx, ts_us, best_bid, best_ask, bid_qty, ask_qty, mid_x2) after each event; null where a side is empty.

    whole: before mid_x2 also n_bids, n_asks, bids and asks of book_at().
    """
    return book_at(md, points, whole=whole).drop("bid_depth", "ask_depth").withColumn("mid_x2", F.col("best_bid") + F.col("best_ask"))


def depth_within(md: DataFrame, points: DataFrame, ticks: int) -> DataFrame:
    """(symbol_id, idx, bid_depth, ask_depth): lots within `ticks` of the best price of each side, inclusive; 0 for an empty side."""
    return book_at(md, points, ticks).select("symbol_id", "idx", "bid_depth", "ask_depth")


def live(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Each point (symbol_id, idx) with every level alive after that event: rows are points times levels.

    Both sides are cut into pieces of JOINED events, so the range join is an equi-join on (symbol_id, piece).
    """
    cut = spans.withColumn("piece", F.explode(F.sequence(F.floor(F.col("from_idx") / JOINED), F.floor((F.col("to_idx") - 1) / JOINED))))
    at = points.select("symbol_id", "idx", F.floor(F.col("idx") / JOINED).alias("piece"))
    return at.join(cut, ["symbol_id", "piece"]).where("from_idx <= idx and idx < to_idx").select("symbol_id", "idx", "side", "price", "qty")


def bbo_by_intervals(md: DataFrame, points: DataFrame, whole: bool = False) -> DataFrame:
    """bbo() at the points by the levels' intervals alone: the second reconstruction of a dual run, for `compare`.

    Points and levels meet in chunks. There each level covers the points within its interval, worse prices before better
    ones, and what covers a point last is its best: a slice a level, no row a point and level. whole: levels that don't
    come out best count too, in running sums of their number and names over the points.
    """
    cut = levels(md).withColumn("chunk", F.explode(F.expr(f"sequence(from_idx div {CHUNK}, (to_idx - 1) div {CHUNK})")))
    cut = cut.select("symbol_id", "chunk", F.col("side").cast("int").alias("side"), F.col("price").cast("long").alias("price"), "qty", "from_idx", "to_idx")
    at = points.select("symbol_id", F.expr(f"idx div {CHUNK}").alias("chunk"), "idx", F.col("ts_us").cast("long").alias("ts_us"))

    def cover(p: pa.Table, t: pa.Table) -> pa.Table:
        p = p.sort_by("idx")
        idx, side, price, qty = p["idx"].to_numpy(), t["side"].to_numpy(), t["price"].to_numpy(), t["qty"].to_numpy()
        starts, ends = (np.searchsorted(idx, t[c].to_numpy(), side="left") for c in ("from_idx", "to_idx"))
        names = _names(price, qty)
        out = {}

        def running(values: np.ndarray, mine: np.ndarray) -> np.ndarray:
            steps = np.zeros(len(idx) + 1, np.uint64)
            np.add.at(steps, starts[mine], values[mine])
            np.subtract.at(steps, ends[mine], values[mine])
            return np.cumsum(steps, dtype=np.uint64)[:-1].view(np.int64)

        for which, by in (("bid", np.lexsort((qty, price))), ("ask", np.lexsort((-qty, -price)))):
            by = by[side[by] == (BID if which == "bid" else ASK)]
            if whole:
                out |= {f"n_{which}s": pa.array(running(np.ones(len(side), np.uint64), by)), f"{which}s": pa.array(running(names, by))}
            top = np.full(len(idx), -1)
            for k, a, z in zip(by.tolist(), starts[by].tolist(), ends[by].tolist()):
                top[a:z] = k
            none = top < 0
            for name, values in (("best_" + which, price), (which + "_qty", qty)):
                out[name] = pa.array(np.where(none, 0, np.append(values, 0)[top]), pa.int64(), mask=none)
        return pa.table({c: p[c] for c in ("symbol_id", "idx", "ts_us")} | {c: out[c] for c in made})

    made = (*_FOUND[:4], *(_WHOLE if whole else ()))
    schema = ", ".join(f"{c} long" for c in ("symbol_id", "idx", "ts_us", *made))
    out = at.withColumn("symbol_id", F.col("symbol_id").cast("long")).groupBy("symbol_id", "chunk").cogroup(cut.withColumn("symbol_id", F.col("symbol_id").cast("long")).groupBy("symbol_id", "chunk")).applyInArrow(cover, schema)
    return out.withColumn("mid_x2", F.col("best_bid") + F.col("best_ask"))


def level_counts(md: DataFrame) -> DataFrame:
    """(symbol_id, side, idx, n): live levels of a side after each of its updates, as a running sum of births and deaths."""
    spans = levels(md)
    steps = spans.select("symbol_id", "side", F.col("from_idx").alias("idx"), F.lit(1).alias("d")).unionByName(spans.select("symbol_id", "side", F.col("to_idx").alias("idx"), F.lit(-1).alias("d")))
    steps = steps.groupBy("symbol_id", "side", "idx").agg(F.sum("d").alias("d"))
    steps = steps.withColumn("chunk", F.floor(F.col("idx") / (16 * CHUNK)))
    return carried(steps, ["symbol_id", "side"], "chunk", ["idx"], sums={"n": F.col("d")}).select("symbol_id", "side", "idx", "n")


def imbalance(bid_qty, ask_qty):
    """Bid share of the quantity at the touch; one half without any."""
    return F.coalesce(F.try_divide(bid_qty, F.coalesce(bid_qty, F.lit(0)) + F.coalesce(ask_qty, F.lit(0))), F.lit(0.5))


def weighted_mid(best_bid, best_ask, share):
    """Mid in ticks, nearer to the side with less quantity."""
    return share * best_ask + (1 - share) * best_bid


def violations(best: DataFrame) -> DataFrame:
    """Events after which the book is crossed or locked, or holds a quantity that isn't positive."""
    return best.where("best_bid >= best_ask or bid_qty <= 0 or ask_qty <= 0")


def compare(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that only one of two reconstructions of the book has, and which one; each is computed once."""
    n = F.sum("_side")
    both = one.withColumn("_side", F.lit(1)).union(other.withColumn("_side", F.lit(-1))).groupBy(*one.columns).agg(n.alias("_n")).where("_n <> 0")
    return both.select(*one.columns, F.when(F.col("_n") > 0, "first").otherwise("second").alias("only_in"), F.explode(F.expr("array_repeat(0, cast(abs(_n) as int))")).alias("_n")).drop("_n")


def mid_changes(best: DataFrame) -> DataFrame:
    """The first two-sided event of each instrument and those at which the mid moves."""
    rows = best.where("mid_x2 is not null").withColumn("day", day_of("ts_us"))
    rows = carried(rows, ["symbol_id"], "day", ["ts_us", "idx"], lags={"before": F.col("mid_x2")})
    return rows.where("before is null or before <> mid_x2").drop("before", "day")
