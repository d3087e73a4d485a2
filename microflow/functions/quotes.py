"""Quoting formulas as column expressions: optimal distances, clamps, floors and the edge test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(gamma: Column, k: Column, sigma: Column, fair: Column | None = None) -> Column:
    """Whether the closed forms are defined for these inputs."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((gamma > 0) & (k > 0) & (sigma >= 0) & finite(gamma) & finite(k) & finite(sigma) & (finite(fair) if fair is not None else F.lit(True)), F.lit(False))


def markup(gamma: Column, k: Column) -> Column:
    return F.lit(1.0) / gamma * F.log1p(gamma / k)


def inventory_premium(gamma: Column, sigma: Column, horizon: Column) -> Column:
    return gamma * sigma * sigma * horizon


def reservation_quotes(mid: Column, inventory: Column, gamma: Column, k: Column, sigma: Column, horizon: Column) -> Column:
    """struct(bid, ask, reservation, spread) in ticks, null for unusable inputs."""
    risk = inventory_premium(gamma, sigma, horizon)
    centre = mid - inventory * risk
    spread = risk + 2.0 * markup(gamma, k)
    return F.when(usable(gamma, k, sigma, mid), F.struct((centre - spread / 2).alias("bid"), (centre + spread / 2).alias("ask"), centre.alias("reservation"), spread.alias("spread")))


def skew_coefficient(gamma: Column, k: Column, a: Column, sigma: Column) -> Column:
    """0 for unusable inputs and where it would overflow."""
    inner = sigma * sigma * gamma / (2.0 * k * a) * F.exp((1.0 + k / gamma) * F.log1p(gamma / k))
    return F.when(usable(gamma, k, sigma) & (a > 0) & (inner > 0) & (inner < float("inf")), F.sqrt(inner)).otherwise(F.lit(0.0))


def stationary_quotes(mid: Column, inventory: Column, gamma: Column, k: Column, a: Column, sigma: Column) -> Column:
    """struct(bid, ask, bid_delta, ask_delta): distances of the long-horizon problem, none below zero."""
    base, skew = markup(gamma, k), skew_coefficient(gamma, k, a, sigma)
    bid = F.greatest(base + (2.0 * inventory + 1.0) / 2.0 * skew, F.lit(0.0))
    ask = F.greatest(base - (2.0 * inventory - 1.0) / 2.0 * skew, F.lit(0.0))
    return F.when(usable(gamma, k, sigma, mid) & (a > 0), F.struct((mid - bid).alias("bid"), (mid + ask).alias("ask"), bid.alias("bid_delta"), ask.alias("ask_delta")))


def outward(bid: Column, ask: Column) -> tuple[Column, Column]:
    return F.floor(bid).cast("long"), F.ceil(ask).cast("long")


def passive(bid: Column, ask: Column, best_bid: Column, best_ask: Column) -> tuple[Column, Column]:
    """Prices that don't cross the touch."""
    return F.least(bid, best_ask - 1), F.greatest(ask, best_bid + 1)


def tick_floor(bid: Column, ask: Column, best_bid: Column, best_ask: Column) -> tuple[Column, Column]:
    """Never inside the touch, then passive."""
    return passive(F.least(bid, best_bid), F.greatest(ask, best_ask), best_bid, best_ask)


def has_edge(price: Column, fair: Column, fee_tenths: Column, side: Column) -> Column:
    """Whether the distance to fair value is more than the fee."""
    edge = F.when(side == 0, fair - price).otherwise(price - fair)
    return edge > fee_tenths * 1e-5 * price
