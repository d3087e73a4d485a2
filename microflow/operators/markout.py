"""Markouts: how the mid moves after a fill, sampled at horizons by an as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from microflow.operators.windows import carried, day_of
from microflow.sources.shared import sent


def samples(fills: DataFrame, marks: DataFrame, horizons_us: list[int]) -> DataFrame:
    """Each fill at each horizon with the mid then in force: columns of fills, horizon_us, due_us, mid_x2_at, resolved.

    fills: symbol_id, fill_id, ts_us ...; marks: symbol_id, ts_us, idx, mid_x2. A sample due strictly between marks
    takes the mid before it, one due exactly at marks takes the first of these; without a mark at or after the due
    time it stays unresolved. Repeated horizons count once.
    """
    cols = fills.columns
    due = fills.withColumn("horizon_us", F.explode(F.lit(sorted(set(horizons_us))))).withColumn("due_us", F.col("ts_us") + F.col("horizon_us"))
    last = marks.groupBy("symbol_id").agg(F.max("ts_us").alias("last_us"))
    # one timeline: at equal times the first mark (0) stands before the samples (1), the other marks (2) after them
    first = Window.partitionBy("symbol_id", "ts_us").orderBy("idx")
    m = marks.select("symbol_id", F.col("ts_us").alias("t"), F.when(F.row_number().over(first) == 1, 0).otherwise(2).alias("kind"), "idx", "mid_x2")
    d = due.select("symbol_id", F.col("due_us").alias("t"), F.lit(1).alias("kind"), F.struct(*[F.col(c) for c in [*cols, "horizon_us", "due_us"]]).alias("s"))
    line = m.unionByName(d, allowMissingColumns=True)
    line = carried(line.withColumn("day", day_of("t")), ["symbol_id"], "day", ["t", "kind", "idx"], lasts={"at": F.col("mid_x2")})
    seen = line.where("kind = 1").select("s.*", "at")
    out = seen.join(sent(last, "last-marks"), "symbol_id", "left").withColumn("resolved", F.coalesce((F.col("due_us") <= F.col("last_us")) & F.col("at").isNotNull(), F.lit(False)))
    return out.select(*cols, "horizon_us", "due_us", F.when(F.col("resolved"), F.col("at")).alias("mid_x2_at"), "resolved")


def priced(sampled: DataFrame) -> DataFrame:
    """samples() with edge_x2, adverse_x2 and markout_x2 in half ticks times lots: edge + adverse = markout.

    A fill has side (0 bought, 1 sold), price, qty and mid_x2 at the fill; unresolved samples have zeros.
    """
    sign = 1 - 2 * F.col("side")
    qty = F.col("qty")
    edge = sign * (F.col("mid_x2") - 2 * F.col("price")) * qty
    adverse = sign * (F.col("mid_x2_at") - F.col("mid_x2")) * qty
    zero = F.lit(0).cast("long")
    return sampled.withColumn("edge_x2", F.when(F.col("resolved"), edge).otherwise(zero)).withColumn("adverse_x2", F.when(F.col("resolved"), adverse).otherwise(zero)).withColumn("markout_x2", F.col("edge_x2") + F.col("adverse_x2"))


def basis_points(value_x2, notional_x2):
    return F.coalesce(F.try_divide(10000.0 * value_x2, notional_x2), F.lit(0.0))


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and mean basis points per group; means are over resolved samples, 0 without any."""
    notional = 2 * F.col("price") * F.col("qty")
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("resolved"), basis_points(F.col(c), notional))), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.count_if("resolved").alias("n_resolved"), F.count_if(~F.col("resolved")).alias("n_unresolved"), mean("edge_x2").alias("edge_bp"), mean("adverse_x2").alias("adverse_bp"), mean("markout_x2").alias("markout_bp"))


def nearest(summary_rows: DataFrame, horizon_us: int, *keys: str) -> DataFrame:
    """Per group the summary of the horizon nearest to one, of those with resolved samples; of two as near, the shorter."""
    off = F.struct(F.abs(F.col("horizon_us") - horizon_us), "horizon_us")
    some = summary_rows.where("n_resolved > 0").withColumn("_row", F.struct(*summary_rows.columns))
    return some.groupBy(*keys).agg(F.min_by("_row", off).alias("_row")).select("_row.*")
