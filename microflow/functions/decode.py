"""Recorder lines to market events: JSON envelopes and payloads, decoded with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microflow.functions.grid import parse_fixed, power_of_ten, to_grid

ENVELOPE = "t long, c string, s string, d string, _bad string"
DEPTH = "E long, T long, pu long, b array<array<string>>, a array<array<string>>"
TRADE = "T long, E long, a long, p string, q string, m boolean"
SNAPSHOT = "lastUpdateId long, E long, T long, bids array<array<string>>, asks array<array<string>>"


def channel(name: Column) -> Column:
    """Names and aliases of channels; null for others."""
    return F.when(name.isin("depth", "depthUpdate"), "depth").when(name.isin("aggTrade", "trade"), "trade").when(name.isin("bookTicker"), "ticker").when(name.isin("snapshot", "depthSnapshot"), "snapshot")


def classify(payload: Column) -> Column:
    """The channel of a bare payload, by its event name or the four keys of a ticker."""
    e = F.get_json_object(payload, "$.e")
    ticker = F.get_json_object(payload, "$.b").isNotNull() & F.get_json_object(payload, "$.B").isNotNull() & F.get_json_object(payload, "$.a").isNotNull() & F.get_json_object(payload, "$.A").isNotNull()
    return F.when(e == "depthUpdate", "depth").when(e == "aggTrade", "aggTrade").when(ticker, "bookTicker").otherwise("unknown")


def envelopes(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with t, channel, symbol, payload and malformed; blank lines are dropped.

    A combined stream's payload is its inner data, if "stream" is the first key. Malformed: no JSON, no integer t, no
    channel or symbol name, no payload.
    """
    rows = lines.withColumn("_line", F.regexp_replace(value, "\r$", "")).where(F.trim("_line") != "")
    e = F.from_json("_line", ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("_e", e)
    inner = F.when(F.col("_e.d").rlike(r'^\s*\{\s*"stream"'), F.get_json_object("_e.d", "$.data"))
    bad = F.col("_e").isNull() | F.col("_e._bad").isNotNull() | F.col("_e.t").isNull() | F.col("_e.c").isNull() | F.col("_e.s").isNull() | F.col("_e.d").isNull()
    return rows.select(*lines.columns, F.col("_e.t").alias("t"), channel(F.col("_e.c")).alias("channel"), F.col("_e.s").alias("symbol"), F.coalesce(inner, F.col("_e.d")).alias("payload"), bad.alias("malformed"))


def _price_qty(tick: float, lot: float):
    """Level numbers: by digits for powers of ten, by double otherwise."""
    p, q = power_of_ten(tick), power_of_ten(lot)
    price = (lambda x: parse_fixed(x, p)) if p is not None else (lambda x: to_grid(x, tick).cast("long"))
    qty = (lambda x: parse_fixed(x, q)) if q is not None else (lambda x: to_grid(x, lot).cast("long"))
    return price, qty


def _field(name: str) -> Column:
    """A field whose name differs from another's in case only."""
    return F.get_json_object("payload", f"$.{name}")


def _millis(*columns: Column) -> Column:
    """The first positive time, in microseconds."""
    return F.coalesce(*[F.when(c > 0, c) for c in columns]) * 1000


def depth_updates(rows: DataFrame) -> DataFrame:
    """Depth payloads with ts_us, first_id, final_id, prev_id, bids and asks; malformed without ids or time."""
    d = rows.where("channel = 'depth' and not malformed").withColumn("_d", F.from_json("payload", DEPTH))
    out = d.withColumn("ts_us", _millis(F.col("_d.T"), F.col("_d.E"))).withColumns({"first_id": _field("U").cast("long"), "final_id": _field("u").cast("long"), "prev_id": F.col("_d.pu"), "bids": F.col("_d.b"), "asks": F.col("_d.a"), "asks_first": F.array_position(F.json_object_keys("payload"), "a").between(F.lit(1), F.array_position(F.json_object_keys("payload"), "b") - 1)}).drop("_d")
    return out.withColumn("malformed", F.col("ts_us").isNull() | F.col("first_id").isNull() | F.col("final_id").isNull())


def level_events(updates: DataFrame, tick: float, lot: float) -> DataFrame:
    """One row per level of depth updates: side, price, qty and pos, the sides in the order of the payload's keys.

    Numbers that don't parse give null.
    """
    price, qty = _price_qty(tick, lot)
    pair = lambda side: lambda x: F.struct(F.lit(side).alias("side"), F.get(x, 0).alias("p"), F.get(x, 1).alias("q"))
    empty = F.array().cast("array<array<string>>")
    bids, asks = F.transform(F.coalesce("bids", empty), pair(0)), F.transform(F.coalesce("asks", empty), pair(1))
    both = F.when(F.col("asks_first"), F.concat(asks, bids)).otherwise(F.concat(bids, asks))
    rows = updates.select("*", F.posexplode(both).alias("pos", "_x")).drop("bids", "asks", "asks_first")
    return rows.withColumns({"side": F.col("_x.side"), "price": price(F.col("_x.p")), "qty": qty(F.col("_x.q"))}).drop("_x")


def trades(rows: DataFrame, tick: float, lot: float) -> DataFrame:
    """Prints with ts_us, trade_id, side of the aggressor (seller if the buyer was the maker), price and qty."""
    d = rows.where("channel = 'trade' and not malformed").withColumn("_d", F.from_json("payload", TRADE))
    out = d.withColumns({"ts_us": _millis(F.col("_d.T"), F.col("_d.E")), "trade_id": F.col("_d.a"), "side": F.when(F.col("_d.m"), 1).when(~F.col("_d.m"), 0), "price": to_grid(F.col("_d.p"), tick), "qty": to_grid(F.col("_d.q"), lot)}).drop("_d")
    return out.withColumn("malformed", F.col("side").isNull() | F.col("price").isNull() | F.col("qty").isNull())


def tickers(rows: DataFrame, tick: float, lot: float) -> DataFrame:
    """Best prices and quantities as the exchange sends them; they are counted and compared, not replayed."""
    d = rows.where("channel = 'ticker' and not malformed")
    return d.withColumns({"update_id": _field("u").cast("long"), "best_bid": to_grid(_field("b"), tick), "bid_qty": to_grid(_field("B"), lot), "best_ask": to_grid(_field("a"), tick), "ask_qty": to_grid(_field("A"), lot)})


def snapshots(rows: DataFrame, tick: float, lot: float) -> DataFrame:
    """Snapshot payloads as begin, level and end rows; without a time of their own they take the line's."""
    d = rows.where("channel = 'snapshot' and not malformed").withColumn("_d", F.from_json("payload", SNAPSHOT)).where("_d.lastUpdateId > 0")
    d = d.withColumns({"ts_us": F.coalesce(_millis(F.col("_d.T"), F.col("_d.E")), F.col("t")), "final_id": F.col("_d.lastUpdateId")})
    empty = F.array().cast("array<array<string>>")
    row = lambda kind, side: lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(side).cast("int").alias("side"), F.get(x, 0).alias("p"), F.get(x, 1).alias("q"))
    edge = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("side"), F.lit(None).cast("string").alias("p"), F.lit(None).cast("string").alias("q")))
    parts = F.concat(edge("begin"), F.transform(F.coalesce("_d.bids", empty), row("level", 0)), F.transform(F.coalesce("_d.asks", empty), row("level", 1)), edge("end"))
    price, qty = _price_qty(tick, lot)
    out = d.select("*", F.posexplode(parts).alias("pos", "_x")).drop("_d")
    return out.withColumns({"kind": F.col("_x.kind"), "side": F.col("_x.side"), "price": price(F.col("_x.p")), "qty": qty(F.col("_x.q"))}).drop("_x")


def decoded(rows: DataFrame, tick: float, lot: float) -> DataFrame:
    """rows of `envelopes`, each parsed once: kind, ts_us, first_id, final_id, prev_id, seq, parts and broken.

    kind: depth, trade, snapshot or ticker, null for a line that isn't any. parts: the events that the line makes, in order, as (kind, side,
    price, qty). broken: a payload of a known kind that lacks what its kind needs; it has no parts. The payload is read once as a map of
    names to text, so names that differ in case only stay apart, and the order of its sides is that of the keys.
    """
    price, qty = _price_qty(tick, lot)
    known = ~F.col("malformed") & F.col("channel").isin("depth", "trade", "snapshot")
    rows = rows.withColumn("_m", F.when(known, F.from_json("payload", "map<string,string>")))
    text = lambda k: F.try_element_at("_m", F.lit(k))
    number = lambda k: text(k).try_cast("long")
    levels = lambda k, kind, side: F.transform(F.coalesce(F.from_json(text(k), "array<array<string>>"), F.array().cast("array<array<string>>")), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(side).alias("side"), price(F.get(x, 0)).alias("price"), qty(F.get(x, 1)).alias("qty")))
    edge = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("side"), F.lit(None).cast("long").alias("price"), F.lit(None).cast("long").alias("qty")))
    place = lambda k: F.array_position(F.map_keys("_m"), k)
    asks_first = place("a").between(F.lit(1), place("b") - 1)
    side = F.when(text("m") == "true", 1).when(text("m") == "false", 0)
    p, q = to_grid(text("p"), tick).cast("long"), to_grid(text("q"), lot).cast("long")
    own = _millis(number("T"), number("E"))
    channel, depth, trade, snapshot = F.col("channel"), F.col("channel") == "depth", F.col("channel") == "trade", F.col("channel") == "snapshot"
    whole = F.when(depth, own.isNotNull() & number("U").isNotNull() & number("u").isNotNull()).when(trade, side.isNotNull() & p.isNotNull() & q.isNotNull()).when(snapshot, F.coalesce(number("lastUpdateId") > 0, F.lit(False)))
    rows = rows.withColumn("broken", F.coalesce(known & ~whole, F.lit(False))).withColumns({
        "kind": F.when(~F.col("malformed"), channel), "ts_us": F.when(snapshot, F.coalesce(own, F.col("t"))).otherwise(own),
        "first_id": F.when(depth, number("U")), "final_id": F.when(depth, number("u")).when(snapshot, number("lastUpdateId")), "prev_id": F.when(depth, number("pu")),
        "seq": F.when(depth, number("u")).when(trade, number("a")).when(snapshot, number("lastUpdateId")),
    })
    bids, asks = levels("b", "depth", 0), levels("a", "depth", 1)
    parts = F.when(depth & asks_first, F.concat(asks, bids)).when(depth, F.concat(bids, asks))
    parts = parts.when(trade, F.array(F.struct(F.lit("trade").alias("kind"), side.alias("side"), p.alias("price"), q.alias("qty"))))
    parts = parts.when(snapshot, F.concat(edge("begin"), levels("bids", "level", 0), levels("asks", "level", 1), edge("end")))
    return rows.withColumn("parts", F.when(~F.col("broken"), parts)).drop("_m")
