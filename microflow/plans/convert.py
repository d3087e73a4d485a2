"""From recorder lines to market events in one plan: decode, sequence protocol, flags, replay order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microflow.functions import decode
from microflow.operators import sync
from microflow.sources.adapters import BEGIN, DEPTH, END, LEVEL, TRADE
from microflow.sources.shared import sent, written

_TYPES = {"begin": BEGIN, "level": LEVEL, "end": END, "trade": TRADE, "depth": DEPTH}


def instruments(table: DataFrame) -> DataFrame:
    """The instrument dimension (symbol, symbol_id), checked: an error if a symbol or an id occurs twice or is null."""
    twice = lambda c: F.count("*").over(_by(c)) > 1
    bad = twice("symbol") | twice("symbol_id") | F.col("symbol").isNull() | F.col("symbol_id").isNull()
    wrong = F.raise_error(F.concat(F.lit("instrument is repeated or null: "), F.coalesce("symbol", F.lit("null"))))
    return table.select(F.when(bad, wrong.cast("string")).otherwise(F.col("symbol")).alias("symbol"), "symbol_id")


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def known_lines(lines: DataFrame, dimension: DataFrame) -> DataFrame:
    """Decoded envelopes (ln, t, channel, payload, malformed) with symbol_id and wrong_symbol, true where it isn't in the dimension.

    Lines of other instruments stay, flagged, for the counters. A channel that isn't known makes a line malformed.
    """
    rows = decode.envelopes(lines)
    rows = rows.withColumn("malformed", F.col("malformed") | F.col("channel").isNull())
    out = rows.join(sent(instruments(dimension), "instruments"), "symbol", "left")
    return out.withColumn("wrong_symbol", ~F.col("malformed") & F.col("symbol_id").isNull())


def parsed(lines: DataFrame, dimension: DataFrame, tick: float, lot: float) -> DataFrame:
    """known_lines, decoded, as a table: everything below reads it, and no line is parsed twice."""
    known = decode.decoded(known_lines(lines, dimension), tick, lot)
    return written(known.select("ln", "symbol_id", "malformed", "wrong_symbol", "broken", "channel", "kind", "ts_us", "first_id", "final_id", "prev_id", "seq", "parts"), "lines")


def messages(lines: DataFrame) -> DataFrame:
    """One row per line for operators.sync: symbol_id, ln, ts_us, kind, first_id, final_id, prev_id; lines that don't parse are left out."""
    mine = lines.where("not malformed and not wrong_symbol and not broken and kind in ('depth', 'trade', 'snapshot')")
    return mine.select("symbol_id", "ln", "ts_us", "kind", "first_id", "final_id", "prev_id")


def convert(lines: DataFrame, dimension: DataFrame, tick: float, lot: float, from_us: int = 0, to_us: int = 0, depth_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, synced messages) of recorder lines (ln: arrival order, value: the line).

    events: symbol_id, idx (replay order), epoch (snapshots ended so far), ts_us, seq, type, side, price, qty, dirty (after a
    break until the next snapshot), resync (part of a snapshot). Dropped: depth before an instrument's first snapshot or not
    newer than what was applied; times out of the inclusive range (0: no bound), after the protocol has seen them.
    """
    return converted(parsed(lines, dimension, tick, lot), from_us, to_us, depth_first)


def converted(lines: DataFrame, from_us: int = 0, to_us: int = 0, depth_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """convert() of `parsed` lines."""
    synced = written(sync.synchronised(messages(lines)), "synced")
    kept = synced.where("accepted or kind <> 'depth'").select("symbol_id", "ln", "dirty")
    mine = lines.where("not malformed and not wrong_symbol and not broken").select("symbol_id", "ln", "ts_us", "seq", "parts")
    flagged = sync.in_range(mine.join(kept, ["symbol_id", "ln"]), from_us, to_us)
    rows = flagged.select("symbol_id", "ln", "ts_us", "seq", "dirty", F.posexplode("parts").alias("pos", "x")).select("symbol_id", "ln", "pos", "ts_us", "seq", "dirty", "x.*")
    ordered = sync.replay_order(written(rows, "flagged"), depth_first)
    code = F.lit(None).cast("int")
    for name, n in _TYPES.items():
        code = F.when(F.col("kind") == name, n).otherwise(code)
    out = ordered.select("symbol_id", "idx", "epoch", "ts_us", "seq", code.alias("type"), "side", "price", "qty", "dirty", F.col("kind").isin("begin", "level", "end").alias("resync"))
    return out, synced


def statistics(lines: DataFrame, dimension: DataFrame, tick: float, lot: float, from_us: int = 0, to_us: int = 0) -> DataFrame:
    """Counters of a conversion per instrument (symbol_id; null for lines that belong to none), the whole set of fifteen.

    lines, malformed, wrong_symbol; messages by channel; dropped before the first snapshot and as stale; gaps, resyncs
    (snapshots that end a dirty stretch); events emitted and dirty, first and last time.
    """
    table = parsed(lines, dimension, tick, lot)
    of = lambda c: F.count_if(~F.col("malformed") & ~F.col("wrong_symbol") & (F.col("channel") == c))
    read = table.groupBy("symbol_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("malformed") | ~F.col("wrong_symbol") & F.col("broken")).alias("n_malformed"), F.count_if("wrong_symbol").alias("n_wrong_symbol"), of("depth").alias("n_depth"), of("trade").alias("n_trades"), of("ticker").alias("n_tickers"), of("snapshot").alias("n_snapshots"))
    events, synced = converted(table, from_us, to_us)
    dropped = synced.groupBy("symbol_id").agg(F.count_if("presync").alias("n_presync"), F.count_if("stale").alias("n_stale"), F.count_if("gap").alias("n_gaps"), F.count_if("resynced").alias("n_resyncs"))
    made = events.groupBy("symbol_id").agg(F.count("*").alias("n_events"), F.count_if("dirty").alias("n_dirty"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    same = lambda a, b: F.col(f"{a}.symbol_id").eqNullSafe(F.col(f"{b}.symbol_id"))
    out = read.alias("r").join(dropped.alias("d"), same("r", "d"), "left").join(made.alias("m"), same("r", "m"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("r.symbol_id", "n_lines", "n_malformed", "n_wrong_symbol", "n_depth", "n_trades", "n_tickers", "n_snapshots", *[zero(c) for c in ("n_presync", "n_stale", "n_gaps", "n_resyncs", "n_events", "n_dirty")], "first_us", "last_us")


def gap_log(synced: DataFrame, names: DataFrame) -> DataFrame:
    """Breaks as lines of a sidecar file, JSON with t, iso, symbol, reason, expected and got; names: symbol, symbol_id."""
    rows = sync.gaps(synced).join(names, "symbol_id")
    iso = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select("symbol_id", "ln", F.to_json(F.struct(F.col("ts_us").alias("t"), iso.alias("iso"), "symbol", "reason", "expected", "got")).alias("value"))
