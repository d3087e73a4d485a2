"""Sequence continuity of a change stream: snapshots, gaps, dirty stretches and what is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from microflow.operators.windows import carried, day_of
from microflow.sources.shared import sent, written

#: Messages of an instrument that one window takes together.
STRETCH = 65_536


def _epochs(messages: DataFrame) -> DataFrame:
    """messages with epoch, last (the greatest id before the row since its snapshot) and base (that snapshot's id).

    A segmented scan in stretches: within one, windows restart at each snapshot. What a stretch hands on is the number of its
    snapshots and the greatest id since the last one; this composes over a row per stretch, whatever the length of an epoch.
    """
    snap = F.col("kind") == "snapshot"
    final = F.when(snap | (F.col("kind") == "depth"), F.col("final_id"))
    rows = messages.withColumn("_stretch", F.floor(F.col("ln") / STRETCH))
    here = Window.partitionBy("symbol_id", "_stretch").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_part", F.count_if(snap).over(here))
    own = Window.partitionBy("symbol_id", "_stretch", "_part").orderBy("ln")
    rows = rows.withColumn("_top", F.max(final).over(own.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_base", F.max(F.when(snap, F.col("final_id"))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("symbol_id", "_stretch").agg(F.max("_part").alias("n"), F.max(F.struct("_part", final.alias("top"))).alias("end"), F.max_by("_base", F.when(snap, F.col("ln"))).alias("base"))
    over = Window.partitionBy("symbol_id").orderBy("_stretch")
    to_here, past = over.rowsBetween(Window.unboundedPreceding, 0), over.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("run", F.count_if(F.col("n") > 0).over(to_here))
    ends = ends.withColumn("top", F.max("end.top").over(Window.partitionBy("symbol_id", "run").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.select("symbol_id", "_stretch", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_epochs"), F.lag("top").over(over).alias("_past_top"), F.last("base", ignorenulls=True).over(past).alias("_past_base"))
    rows, goes_on = rows.join(ends, ["symbol_id", "_stretch"]), F.col("_part") == 0
    last = F.when(goes_on, F.greatest("_top", "_past_top")).otherwise(F.col("_top"))
    return rows.select(*messages.columns, (F.col("_part") + F.col("_epochs")).alias("epoch"), last.alias("last"), F.when(goes_on, F.col("_past_base")).otherwise(F.col("_base")).alias("base"))


def synchronised(messages: DataFrame) -> DataFrame:
    """messages with epoch, last, accepted, first, gap, dirty, resynced, stale and presync, in closed form.

    messages: symbol_id, ln (arrival order), kind ('snapshot', 'depth' or other), first_id, final_id (snapshots have one), prev_id
    (null on the spot dialect). A snapshot begins an epoch; the first diff accepted in it must bracket the next id, later ones
    follow on: by prev_id where the symbol's first accepted diff has one, by first_id otherwise. From a gap on,
    rows are dirty until the next snapshot. Every accepted final id exceeds all before it in its epoch, so the running
    maximum is the last accepted id, and a diff is an epoch's first while that is still the snapshot's. No task holds more
    than a stretch of messages; an epoch's first gap is a row of a small table.
    """
    snap, depth = F.col("kind") == "snapshot", F.col("kind") == "depth"
    rows = _epochs(messages)
    rows = rows.withColumn("accepted", F.coalesce(depth & (F.col("epoch") > 0) & (F.col("final_id") > F.col("last")), F.lit(False)))
    # written once, as three branches read it from here on
    rows = written(rows.withColumn("first", F.coalesce(F.col("last") == F.col("base"), F.lit(False))).drop("base"), "accepted")
    dialect = rows.where("accepted").groupBy("symbol_id").agg(F.min_by(F.col("prev_id").isNotNull(), "ln").alias("futures"))
    rows = rows.join(sent(dialect, "dialect"), "symbol_id", "left")
    follows = F.when(F.col("first"), (F.col("first_id") <= F.col("last") + 1) & (F.col("final_id") >= F.col("last") + 1)).when(F.col("futures") & F.col("prev_id").isNotNull(), F.col("prev_id") == F.col("last")).otherwise(F.col("first_id") == F.col("last") + 1)
    rows = rows.withColumn("gap", F.col("accepted") & ~follows)
    broken = written(rows.where("gap").groupBy("symbol_id", "epoch").agg(F.min("ln").alias("broken_ln")), "broken")
    rows = rows.join(broken, ["symbol_id", "epoch"], "left").withColumn("dirty", F.coalesce(F.col("ln") >= F.col("broken_ln"), F.lit(False))).drop("broken_ln")
    # a snapshot resynchronises if the epoch before it ended dirty
    ended = broken.select("symbol_id", (F.col("epoch") + 1).alias("epoch"), F.lit(True).alias("was_dirty"))
    rows = rows.join(ended, ["symbol_id", "epoch"], "left").withColumn("resynced", snap & F.coalesce("was_dirty", F.lit(False))).drop("was_dirty")
    return rows.withColumn("stale", depth & (F.col("epoch") > 0) & ~F.col("accepted")).withColumn("presync", depth & (F.col("epoch") == 0))


def gaps(rows: DataFrame) -> DataFrame:
    """One row per gap: what was expected and what came, and the message's time if it has one (ts_us)."""
    reason = F.when(F.col("first"), "first update doesn't bracket the snapshot").when(F.col("futures") & F.col("prev_id").isNotNull(), "futures: pu doesn't match").otherwise("spot: U doesn't follow")
    got = F.when(~F.col("first") & F.col("futures") & F.col("prev_id").isNotNull(), F.col("prev_id")).otherwise(F.col("first_id"))
    expected = F.when(~F.col("first") & F.col("futures") & F.col("prev_id").isNotNull(), F.col("last")).otherwise(F.col("last") + 1)
    time = ["ts_us"] if "ts_us" in rows.columns else []
    return rows.where("gap").select("symbol_id", "ln", *time, expected.alias("expected"), got.alias("got"), reason.alias("reason"))


def statistics(rows: DataFrame) -> DataFrame:
    """Counters of a conversion, one row per symbol."""
    kept = F.col("accepted") | ~F.col("kind").isin("depth")
    return rows.groupBy("symbol_id").agg(
        F.count("*").alias("n_messages"), F.count_if(F.col("kind") == "snapshot").alias("n_snapshots"), F.count_if("accepted").alias("n_accepted"), F.count_if("stale").alias("n_stale"), F.count_if("presync").alias("n_presync"), F.count_if("gap").alias("n_gaps"),
        F.count_if("resynced").alias("n_resyncs"), F.count_if(kept & F.col("dirty")).alias("n_dirty"), F.count_if(kept).alias("n_kept"),
    )


def in_range(rows: DataFrame, from_us: int = 0, to_us: int = 0) -> DataFrame:
    """Rows with a time in the inclusive range, 0 for no bound; to be applied after the windows above."""
    out = rows
    if from_us:
        out = out.where(F.col("ts_us") >= from_us)
    return out.where(F.col("ts_us") <= to_us) if to_us else out


def recorder_gaps(messages: DataFrame) -> DataFrame:
    """Breaks between neighbouring messages as a recorder logs them, without any repair; a reconnect starts anew."""
    rows = messages.where("kind = 'depth'").withColumn("stretch", F.floor(F.col("ln") / STRETCH))
    rows = carried(rows, ["symbol_id", "connection"], "stretch", ["ln"], lags={"before": F.col("final_id")})
    expected = F.when(F.col("prev_id").isNotNull(), F.col("before")).otherwise(F.col("before") + 1)
    got = F.coalesce("prev_id", "first_id")
    return rows.withColumn("expected", expected).withColumn("got", got).where("before is not null and got <> expected").select("symbol_id", "ln", "expected", "got")


def replay_order(events: DataFrame, depth_first: bool = False) -> DataFrame:
    """events (symbol_id, ts_us, kind, ln, pos) with idx, by time, then kind, then arrival, and epoch, the snapshots ended up to it."""
    rank = F.when(F.col("kind") == "begin", 0).when(F.col("kind") == "level", 1).when(F.col("kind") == "end", 2).when(F.col("kind") == "trade", 4 if depth_first else 3).otherwise(3 if depth_first else 4)
    rows = events.withColumn("day", day_of("ts_us")).withColumn("rank", rank)
    rows = carried(rows, ["symbol_id"], "day", ["ts_us", "rank", "ln", "pos"], sums={"place": F.lit(1), "epoch": (F.col("kind") == "end").cast("int")})
    return rows.withColumn("idx", (F.col("place") - 1).cast("long")).drop("day", "rank", "place")


def visibility(events: DataFrame, delay_us) -> DataFrame:
    """events with visible_us: when they arrive, never before an earlier one has."""
    rows = events.withColumn("day", day_of("ts_us"))
    return carried(rows, ["symbol_id"], "day", ["idx"], maxes={"visible_us": F.col("ts_us") + delay_us}).drop("day")


def timers(events: DataFrame, period_us: int) -> DataFrame:
    """Timer ticks per symbol: from a period after the first event to the last event."""
    span = events.groupBy("symbol_id").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")).withColumn("n", F.expr(f"(hi - lo) div {period_us}")).where("n > 0")
    # runs of ticks first, dealt to many tasks, so that no array holds a history
    runs = span.select("symbol_id", "lo", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {STRETCH})")).alias("run")).repartition("symbol_id", "run")
    return runs.select("symbol_id", "lo", F.explode(F.expr(f"sequence(run * {STRETCH} + 1, least(n, (run + 1) * {STRETCH}))")).alias("k")).select("symbol_id", (F.col("lo") + F.col("k") * period_us).alias("ts_us"))


def timeline(market: DataFrame, actions: DataFrame, ticks: DataFrame) -> DataFrame:
    """One order of market events, actions and timers: by time, then market before action before timer, then seq."""
    parts = [x.select("symbol_id", "ts_us", F.lit(k).alias("kind"), "seq") for k, x in enumerate((market, actions, ticks))]
    line = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return carried(line.withColumn("day", day_of("ts_us")), ["symbol_id"], "day", ["ts_us", "kind", "seq"], sums={"step": F.lit(1)}).drop("day")
