"""Running values over long histories without a task that holds a whole history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def day_of(ts_us) -> Column:
    """The bucket of a time that `carried` and `trailing` cut histories by."""
    return F.floor(F.col(ts_us) / DAY_US) if isinstance(ts_us, str) else F.floor(ts_us / DAY_US)


def carried(rows: DataFrame, keys: list[str], bucket: str, order: list[str], sums: dict | None = None, maxes: dict | None = None, lasts: dict | None = None, lags: dict | None = None, exclusive: tuple[str, ...] = ()) -> DataFrame:
    """rows with a column per name: what has added up over the history of its keys, in ascending order, up to the row.

    sums, maxes, lasts (last value that isn't null): up to and with the row, or without it if named in `exclusive`.
    lags: the value of the row before. bucket: a column that never falls along the order, such as the day.

    Each bucket is accumulated in a window of its own; what a bucket ends with is carried on by a window over one row
    per bucket. So the largest task holds a bucket, however long the history, and the rows are shuffled once. rows is read
    twice, so steps that build on each other should go through a written table. Rows whose keys or bucket are null have no
    place in a history and are left out.
    """
    sums, maxes, lasts, lags = sums or {}, maxes or {}, lasts or {}, lags or {}
    own = Window.partitionBy(*keys, bucket).orderBy(*order)
    to_here, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    fold = {n: (F.sum, c) for n, c in sums.items()} | {n: (F.max, c) for n, c in maxes.items()} | {n: (lambda x: F.last(x, ignorenulls=True), c) for n, c in lasts.items()}
    inner = {f"_in_{n}": f(c).over(to_here) for n, (f, c) in fold.items()} | {f"_ex_{n}": fold[n][0](fold[n][1]).over(before) for n in exclusive}
    inner |= {f"_in_{n}": c for n, c in lags.items()} | {f"_ex_{n}": F.lag(c).over(own) for n, c in lags.items()}
    wide = rows.withColumns(inner)
    at = F.struct(*order)
    ends = wide.groupBy(*keys, bucket).agg(*[F.max_by(f"_in_{n}", at).alias(f"_end_{n}") for n in [*fold, *lags]])
    past = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = {n: F.sum for n in sums} | {n: F.max for n in maxes}
    ends = ends.select(*keys, bucket, *[carry.get(n, lambda x: F.last(x, ignorenulls=True))(f"_end_{n}").over(past).alias(f"_past_{n}") for n in [*fold, *lags]])
    out = wide.join(ends, [*keys, bucket])
    made = {}
    for n in [*fold, *lags]:
        here, then = F.col(f"_ex_{n}" if n in exclusive or n in lags else f"_in_{n}"), F.col(f"_past_{n}")
        if n in sums:
            made[n] = F.when(here.isNotNull() | then.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(then, F.lit(0)))
        elif n in maxes:
            made[n] = F.greatest(here, then)
        else:
            made[n] = F.coalesce(here, then)
    return out.select(*rows.columns, *[c.alias(n) for n, c in made.items()])


def trailing(rows: DataFrame, keys: list[str], window_us: int, columns: dict, ts: str = "ts_us") -> DataFrame:
    """rows with aggregates over the window_us before each row and its own time, both ends included.

    columns: name to an aggregate column. Histories are cut into stretches of a day, or of the window if that is longer; the
    rows that a later stretch looks back on are copied to it, so stretches are tasks of their own.
    """
    span = max(DAY_US, window_us)
    here = F.floor(F.col(ts) / span)
    copies = F.when(F.col(ts) >= (here + 1) * span - window_us, F.array(here, here + 1)).otherwise(F.array(here))
    cut = rows.withColumn("_stretch", F.explode(copies)).withColumn("_own", F.col("_stretch") == here)
    over = Window.partitionBy(*keys, "_stretch").orderBy(ts).rangeBetween(-window_us, 0)
    return cut.withColumns({n: c.over(over) for n, c in columns.items()}).where("_own").drop("_stretch", "_own")


def as_of(points: DataFrame, values: DataFrame, keys: list[str], columns: list[str], order: tuple[str, str] = ("ts_us", "idx")) -> DataFrame:
    """points with the columns of the last row of values at or before each, in the order of two columns; null before the first."""
    ts, idx = order
    v = values.select(*keys, ts, idx, F.lit(0).alias("_late"), F.struct(*columns).alias("_v"))
    p = points.select(*keys, ts, idx, F.lit(1).alias("_late"), F.struct(*points.columns).alias("_p"))
    line = v.unionByName(p, allowMissingColumns=True).withColumn("_day", day_of(ts))
    seen = carried(line, keys, "_day", [ts, idx, "_late"], lasts={"_last": F.col("_v")}).where("_late = 1")
    return seen.select("_p.*", *[F.col(f"_last.{c}").alias(c) for c in columns])
