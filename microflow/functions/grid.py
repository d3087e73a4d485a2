"""Prices, quantities and money on an integer grid, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def power_of_ten(step: float) -> int | None:
    """n if step is 10**-n for n from 0 to 12."""
    for n in range(13):
        if abs(step * 10**n - 1) < 1e-9:
            return n
    return None


def cash_per_tick_lot(tick: float, lot: float) -> int:
    """Money units (1e-8) of one tick times one lot; raises unless it's a whole number of 1 at least."""
    if not (tick > 0 and lot > 0):
        raise ValueError("tick and lot sizes must be positive")
    exact = tick * lot * 1e8
    if round(exact) < 1 or abs(exact - round(exact)) > 1e-6 * exact:
        raise ValueError(f"{tick} x {lot} isn't a whole number of 1e-8 units")
    return round(exact)


def parse_fixed(text: Column, digits: int) -> Column:
    """A decimal text in units of 10**-digits; the first dropped digit of 5 or more rounds away from zero. Exponents: null."""
    plain = F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), text)
    return F.round(plain.cast("decimal(38,18)") * F.lit(10**digits).cast("decimal(20,0)"), 0).cast("long")


def to_grid(value: Column, step: float) -> Column:
    """A double in whole steps, half away from zero; null beyond 32 bits."""
    n = F.round(value.cast("double") * F.lit(1.0 / step), 0)
    return F.when(n.between(-(2**31), 2**31 - 1), n.cast("int"))


def notional(price: Column, qty: Column, cash: int) -> Column:
    return price.cast("long") * qty.cast("long") * F.lit(cash).cast("long")


def fee(amount: Column, tenths_bp: Column) -> Column:
    """amount * tenths_bp / 100000, half away from zero."""
    n = (amount * tenths_bp).cast("long")
    whole = F.floor((F.abs(n) + 50000) / F.lit(100000).cast("decimal(6,0)")).cast("long")
    return F.when(n >= 0, whole).otherwise(-whole)


def to_price(ticks: Column, tick: float) -> Column:
    return ticks.cast("double") * F.lit(tick)


def to_qty(lots: Column, lot: float) -> Column:
    return lots.cast("double") * F.lit(lot)


def to_cash(units: Column) -> Column:
    """Money units of 1e-8 as a number."""
    return units.cast("double") / 1e8


def x2_to_cash(units_x2: Column) -> Column:
    """Doubled money units of 1e-8 as a number."""
    return units_x2.cast("double") / 2e8


def fee_to_tenths(bp: float) -> int:
    """Basis points in tenths; raises for a finer fee."""
    out = round(bp * 10)
    if abs(out - bp * 10) > 1e-9:
        raise ValueError("fees have a resolution of 0.1 bp")
    return out


def opposite(side: Column) -> Column:
    return 1 - side


def sign(side: Column) -> Column:
    return 1 - 2 * side


def side_name(side: Column) -> Column:
    return F.when(side == 0, "BID").when(side == 1, "ASK")


def consumed_side(aggressor: Column) -> Column:
    """The resting side that a print takes from."""
    return 1 - aggressor


def queue_fraction(ahead: Column, behind: Column, remaining: Column) -> Column:
    return F.coalesce(F.try_divide(ahead.cast("double"), (ahead + behind + remaining).cast("double")), F.lit(0.0))


def utc_day(ts_us: Column) -> Column:
    """Day number; microseconds are first cut to seconds toward zero, so the last instant before 1970 is day 0."""
    seconds = F.when(ts_us >= 0, F.floor(ts_us / 1_000_000)).otherwise(F.ceil(ts_us / 1_000_000))
    return F.floor(seconds / 86400).cast("long")


def utc_date(ts_us: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), utc_day(ts_us).cast("int")), "yyyy-MM-dd")


def format_double(x: Column, digits: int) -> Column:
    """Fixed digits; no minus before a zero; inf and nan by name."""
    shown = F.format_string(f"%.{digits}f", x)
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(F.regexp_replace(shown, r"^-(0(\.0+)?)$", "$1"))


def sanitise(name: Column) -> Column:
    return F.translate(name, ".- /", "____")


def run_id(strategy: Column, queue: Column, fee_bp: Column, latency_ms: Column, seed: Column) -> Column:
    return F.concat_ws("_", strategy, queue, fee_bp, latency_ms, seed)


def seconds_to_us(x: Column) -> Column:
    return F.round(x * 1_000_000).cast("long")


def millis_to_us(x: Column) -> Column:
    return F.round(x * 1000).cast("long")


def hour_stamp(ts_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(ts_us), "yyyy-MM-dd'T'HH")


def human_bytes(n: Column) -> Column:
    out = F.format_string("%.1f TB", n / 1024.0**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024.0**power)).otherwise(out)
    return out
