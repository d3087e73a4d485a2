"""Queue position of resting orders that don't influence the market, as folds over their level's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from microflow.operators.book import imbalance
from microflow.operators.windows import as_of, carried
from microflow.sources.adapters import ASK, BID, TRADE
from microflow.sources.shared import written

#: Events of an instrument that one window takes together.
STRETCH = 65_536
_LAST = 9_223_372_036_854_775_807
MODELS = ("PESS", "OPT", "PROP")
#: How long a print may explain a later decrease of its level.
CREDIT_US = 250_000


def probes(best: DataFrame, every_us: int, depths: list[int], qty: int) -> DataFrame:
    """Orders at the first two-sided moment of each time bucket of every_us: both sides, `depth` - 1 ticks behind the touch.

    They carry the imbalance of the touch at their moment.
    """
    two = best.where(F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull()).withColumn("imbalance", imbalance(F.col("bid_qty"), F.col("ask_qty")))
    cols = ["symbol_id", "idx", "ts_us", "best_bid", "best_ask", "mid_x2", "imbalance"]
    at = two.groupBy("symbol_id", F.floor(F.col("ts_us") / every_us).alias("slot")).agg(F.min_by(F.struct(*cols), "idx").alias("x")).select("x.*")
    side = F.explode(F.array(F.lit(BID), F.lit(ASK))).alias("side")
    rows = at.select(*cols, side).select("*", F.explode(F.lit(depths)).alias("depth"))
    price = F.when(F.col("side") == BID, F.col("best_bid") - (F.col("depth") - 1)).otherwise(F.col("best_ask") + (F.col("depth") - 1))
    return rows.select("symbol_id", "idx", "ts_us", "side", "depth", price.alias("price"), F.lit(qty).cast("long").alias("qty"), "mid_x2", "imbalance", F.concat_ws("-", "symbol_id", "idx", "side", "depth").alias("order_id"))


def placed(orders: DataFrame, spans: DataFrame) -> DataFrame:
    """orders with `ahead`, the quantity that their level holds when they join it: the level's last one, if it still stands."""
    keys = ["symbol_id", "side", "price"]
    held = spans.select(*keys, F.col("from_idx").alias("idx"), F.lit(0).alias("_late"), F.struct("qty", "to_idx").alias("_held"))
    asked = orders.select(*keys, "idx", F.lit(1).alias("_late"), F.struct(*orders.columns).alias("_order"))
    line = held.unionByName(asked, allowMissingColumns=True).withColumn("_part", F.floor(F.col("idx") / STRETCH))
    seen = carried(line, keys, "_part", ["idx", "_late"], lasts={"_last": F.col("_held")}).where("_late = 1")
    ahead = F.when(F.col("idx") < F.col("_last.to_idx"), F.col("_last.qty"))
    return seen.select("_order.*", F.coalesce(ahead, F.lit(0)).cast("long").alias("ahead"))


def _cancel(model: str, c: str) -> tuple[str, str]:
    """What is ahead and behind after c lots of cancels."""
    if model == "PESS":  # from behind first
        return f"greatest(s.a - greatest({c} - s.b, 0L), 0L)", f"greatest(s.b - {c}, 0L)"
    if model == "OPT":  # from ahead first
        return f"greatest(s.a - {c}, 0L)", f"greatest(s.b - greatest({c} - s.a, 0L), 0L)"
    # in proportion; an inexact share is rounded to nearest, where the sequential simulation draws
    front = f"if(s.a + s.b = 0, 0L, least(s.a, (2L * least({c}, s.a + s.b) * s.a + s.a + s.b) div (2L * (s.a + s.b))))"
    return f"s.a - {front}", f"greatest(s.b - (least({c}, s.a + s.b) - {front}), 0L)"


def _step(model: str) -> str:
    """One event of the level: a print (t = 1) of q lots, or an update to q lots.

    State: a ahead, b behind, r remaining, v the level's last visible quantity, c credit of prints not yet seen in the
    level and g when it was given, f filled lots and w when first, k levels' lots explained by prints, x cancels, z credit
    expired; l: each fill with its time, lots and what is then ahead and behind.
    """
    fresh = f"if(e.ts_us - s.g > {CREDIT_US}L, 0L, s.c)"
    fill = "least(greatest(e.q - s.a, 0L), s.r)"
    over = "greatest(e.q - s.a - s.r, 0L)"
    trade = f"struct(greatest(s.a - e.q, 0L) as a, greatest(s.b - {over}, 0L) as b, s.r - {fill} as r, s.v as v, {fresh} + e.q as c, e.ts_us as g, s.f + {fill} as f, coalesce(s.w, if({fill} > 0, e.ts_us, null)) as w, s.k as k, s.x as x, s.z + s.c - {fresh} as z, if({fill} > 0, concat(s.l, array(struct(e.ts_us as ts_us, e.idx as idx, {fill} as lots, greatest(s.a - e.q, 0L) as ahead, greatest(s.b - {over}, 0L) as behind, {over} > 0 as through))), s.l) as l)"
    down = "greatest(s.v - e.q, 0L)"
    used = f"least({down}, {fresh})"
    cancel = f"({down} - {used})"
    ahead, behind = _cancel(model, cancel)
    update = f"struct(if({cancel} > 0, {ahead}, s.a) as a, if({cancel} > 0, {behind}, s.b) + greatest(e.q - s.v, 0L) as b, s.r as r, e.q as v, {fresh} - {used} as c, s.g as g, s.f as f, s.w as w, s.k + {used} as k, s.x + {cancel} as x, s.z + s.c - {fresh} as z, s.l as l)"
    return f"if(s.r = 0, s, if(e.t = {TRADE}, {trade}, {update}))"


def follow(orders: DataFrame, md: DataFrame, model: str, horizon_us: int) -> DataFrame:
    """orders (with ahead) after horizon_us of their level's events: ahead_end, behind_end, filled, first_fill_us, explained, cancels, expired.

    Only prints at exactly the order's price on its side count, and updates of its level. Each order is a fold of its
    own events, so any number of orders and instruments runs side by side; a fold holds one order's horizon.
    """
    if model not in MODELS:
        raise ValueError(f"unknown queue model {model!r}")
    return follow_models(orders, md, horizon_us, (model,)).drop("model")


def follow_models(orders: DataFrame, md: DataFrame, horizon_us: int, models: tuple[str, ...] = MODELS) -> DataFrame:
    """follow() under several models at once: a row per order and `model`, from one gathering of the events."""
    hit = F.when(F.col("type") == TRADE, 1 - F.col("side")).otherwise(F.col("side"))
    bucket = F.floor(F.col("ts_us") / horizon_us)
    events = md.select("symbol_id", hit.alias("side"), "price", F.struct("idx", "ts_us", F.col("type").alias("t"), F.col("qty").alias("q")).alias("e"), bucket.alias("bucket"))
    # an order's horizon touches two buckets of that length
    o = orders.select("order_id", "symbol_id", "side", "price", "idx", "ts_us", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    met = o.join(events, ["symbol_id", "side", "price", "bucket"]).where((F.col("e.idx") > F.col("idx")) & (F.col("e.ts_us") <= F.col("ts_us") + horizon_us))
    mine = met.groupBy("order_id").agg(F.array_sort(F.collect_list("e")).alias("events"))
    start = "struct(ahead as a, 0L as b, qty as r, ahead as v, 0L as c, cast(-1e15 as bigint) as g, 0L as f, cast(null as bigint) as w, 0L as k, 0L as x, 0L as z, cast(array() as array<struct<ts_us:bigint,idx:bigint,lots:bigint,ahead:bigint,behind:bigint,through:boolean>>) as l)"
    none = "cast(array() as array<struct<idx:bigint,ts_us:bigint,t:int,q:bigint>>)"
    ends = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(f"aggregate(events, {start}, (s, e) -> {_step(m)})").alias("s")) for m in models])
    folded = orders.join(mine, "order_id", "left").withColumn("events", F.expr(f"coalesce(events, {none})")).withColumn("x", F.explode(ends))
    out = {"ahead_end": "a", "behind_end": "b", "filled": "f", "first_fill_us": "w", "explained": "k", "cancels": "x", "expired": "z", "fills": "l"}
    return folded.select(*orders.columns, F.col("x.model").alias("model"), *[F.col(f"x.s.{c}").alias(name) for name, c in out.items()])


#: Events of an instrument in a leaf of the price index, and children of a node above.
LEAF, FAN = 256, 16


def reached(orders: DataFrame, points: DataFrame, ends: DataFrame, horizon_us: int) -> DataFrame:
    """orders with the points that reach their price within the horizon, as p_idx and p, until what they need is met for sure.

    orders: order_id, symbol_id, side, price, idx, ts_us and need. points: symbol_id, side (of the orders that they meet), idx, price, lots and p
    (a struct of what is wanted). A bid is reached at or below its price, an ask at or above. ends: symbol_id, ts_us, idx of all events.

    The points are indexed by the best price, with its lots, of each run of LEAF events and of FAN nodes below. Orders descend from a level at which
    few nodes cover their horizon, only into nodes that reach their price, and not beyond those whose best points
    meet their need. So an order is joined with the points of a leaf or two a fill, not of its whole horizon.
    """
    sign = F.when(F.col("side") == BID, 1).otherwise(-1)
    p = points.withColumn("key", sign * F.col("price"))
    due = orders.select("symbol_id", "order_id", (F.col("ts_us") + horizon_us).alias("ts_us"), F.lit(_LAST).alias("idx"))
    until = as_of(due, ends.select("symbol_id", "ts_us", "idx", F.col("idx").alias("until")), ["symbol_id"], ["until"]).select("order_id", "until")
    o = orders.join(until, "order_id").where(F.col("until") > F.col("idx")).select("order_id", "symbol_id", "side", (sign * F.col("price")).alias("limit"), (F.col("idx") + 1).alias("from"), "until", "need")
    o = written(o, "horizons")
    widest = o.agg(F.max(F.col("until") - F.col("from"))).first()[0] or 0
    size = LEAF
    while widest // size > FAN:
        size *= FAN
    nodes = f"sequence(from div {size}, until div {size})"
    while True:
        index = p.groupBy("symbol_id", "side", F.expr(f"idx div {size}").alias("node")).agg(F.min("key").alias("best"), F.min_by("lots", "key").alias("sure"))
        seen = o.select("*", F.explode(F.expr(nodes)).alias("node")).join(index, ["symbol_id", "side", "node"]).where("best <= limit")
        whole = (F.col("node") * size >= F.col("from")) & ((F.col("node") + 1) * size - 1 <= F.col("until"))
        before = Window.partitionBy("order_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        seen = seen.withColumn("met", F.coalesce(F.sum(F.when(whole, F.col("sure")).otherwise(0)).over(before), F.lit(0))).where("met < need").drop("met", "best", "sure")
        if size == LEAF:
            break
        o, size = written(seen.select("order_id", "symbol_id", "side", "limit", "from", "until", "need", F.col("node").alias("above")), "descent"), size // FAN
        nodes = f"sequence(greatest(above * {FAN}, from div {size}), least(above * {FAN} + {FAN - 1}, until div {size}))"
    leaves = p.select("symbol_id", "side", F.expr(f"idx div {LEAF}").alias("node"), F.col("idx").alias("p_idx"), "key", "p")
    hit = seen.join(leaves, ["symbol_id", "side", "node"]).where("p_idx >= from and p_idx <= until and key <= limit").select("order_id", "p_idx", "p")
    return orders.join(hit, "order_id")


def touch_fills(orders: DataFrame, md: DataFrame, horizon_us: int) -> DataFrame:
    """Fills under the touch rule: any print at or through the price fills what remains, up to its quantity."""
    prints = md.where((F.col("type") == TRADE) & (F.col("qty") > 0)).select("symbol_id", (1 - F.col("side")).alias("side"), "idx", "price", F.col("qty").alias("lots"), F.struct("ts_us", "qty").alias("p"))
    met = reached(orders.withColumn("need", F.col("qty")), prints, md, horizon_us).select("order_id", "symbol_id", "side", "price", "qty", F.col("p_idx").alias("t_idx"), F.col("p.ts_us").alias("t_us"), F.col("p.qty").alias("t_qty"))
    before = F.coalesce(F.sum("t_qty").over(Window.partitionBy("order_id").orderBy("t_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fill = F.greatest(F.least(F.col("t_qty"), F.col("qty") - before), F.lit(0))
    return met.withColumn("fill", fill).where("fill > 0").select("order_id", "symbol_id", "side", "price", "t_idx", "t_us", "fill")


def cross_fills(orders: DataFrame, best: DataFrame, horizon_us: int) -> DataFrame:
    """The first event within the horizon at which the opposite touch reaches an order: it fills whole, at its limit."""
    touch = lambda side, price: best.where(F.col(price).isNotNull()).select("symbol_id", F.lit(side).alias("side"), "idx", F.col(price).alias("price"), F.lit(1).alias("lots"), F.struct("ts_us").alias("p"))
    met = reached(orders.withColumn("need", F.lit(1)), touch(BID, "best_ask").unionByName(touch(ASK, "best_bid")), best, horizon_us)
    return met.groupBy("order_id").agg(F.min("p_idx").alias("cross_idx"), F.min("p.ts_us").alias("cross_us"))


def fills(followed: DataFrame) -> DataFrame:
    """One row per fill of the orders: their columns, fill_us, fill_idx, fill_qty, ahead_at_fill, behind_at_fill, cause, and fractions.

    queue_fraction: ahead over ahead and the order at its placement; fill_fraction: ahead over ahead and the fill.
    """
    rows = followed.select("*", F.explode("fills").alias("x")).drop("fills")
    out = rows.withColumns({"fill_us": F.col("x.ts_us"), "fill_idx": F.col("x.idx"), "fill_qty": F.col("x.lots"), "ahead_at_fill": F.col("x.ahead"), "behind_at_fill": F.col("x.behind"), "cause": F.when(F.col("x.through"), "traded_through").otherwise("queue_consumed")}).drop("x")
    part = lambda c: F.coalesce(F.try_divide(F.col("ahead").cast("double"), (F.col("ahead") + F.col(c)).cast("double")), F.lit(0.0))
    return out.withColumn("queue_fraction", part("qty")).withColumn("fill_fraction", part("fill_qty"))


def outcomes(followed: DataFrame, horizons_us: list[int], run_end: DataFrame | None = None) -> DataFrame:
    """Each probe at each horizon: filled in time, the time to fill (-1 if not filled), its queue fraction, and whole.

    run_end: symbol_id, end_us. whole: the run lasted to the probe's horizon, so that its outcome counts in fill rates.
    """
    hs = sorted(set(horizons_us))
    rows = followed.withColumn("horizon_us", F.explode(F.lit(hs)))
    wait = F.col("first_fill_us") - F.col("ts_us")
    rows = rows.withColumn("hit", F.coalesce(wait <= F.col("horizon_us"), F.lit(False))).withColumn("time_to_fill_us", F.coalesce(wait, F.lit(-1).cast("long")))
    rows = rows.withColumn("queue_fraction", F.coalesce(F.try_divide(F.col("ahead").cast("double"), (F.col("ahead") + F.col("qty")).cast("double")), F.lit(0.0)))
    if run_end is None:
        return rows.withColumn("whole", F.lit(True))
    return rows.join(run_end, "symbol_id").withColumn("whole", F.col("ts_us") + F.col("horizon_us") <= F.col("end_us")).drop("end_us")


def fill_rates(rows: DataFrame, *keys: str) -> DataFrame:
    """Share of probes filled within each horizon, over those whose whole horizon was observed; 0 where none was."""
    return rows.groupBy(*keys, "horizon_us").agg(F.count_if("whole").alias("n"), F.coalesce(F.avg(F.when(F.col("whole"), F.col("hit").cast("double"))), F.lit(0.0)).alias("fill_rate"))
