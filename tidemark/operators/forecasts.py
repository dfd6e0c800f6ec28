"""Forecast points, their bounds and their resolution against prices that come later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Price bands and their ticks: fixed values of the exchange's rule. (below, tick); the last has no upper end.
TICKS = ((20, 0.01), (50, 0.02), (100, 0.05), (250, 0.1), (500, 0.25), (1000, 0.5), (2500, 1.0), (None, 2.5))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once however often it is used: prices are built from prices, step by step."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def price_tick(price: Column) -> Column:
    out = F.lit(None)
    for below, tick in reversed(TICKS):
        out = F.lit(tick) if below is None else F.when(price < below, tick).otherwise(out)
    return out


def round_to_tick(price: Column, how: str = "nearest") -> Column:
    """In decimals, half up."""

    def rounded(p: Column) -> Column:
        tick = price_tick(p).cast("decimal(18,6)")
        return ({"nearest": F.round, "floor": F.floor, "ceil": F.ceil}[how](p.cast("decimal(18,6)") / tick) * tick).cast("double")

    return let(price, rounded)


def bounded(price: Column, before: Column, band: float = 0.10) -> Column:
    """Within the daily band around the price before (itself on a tick), on a tick."""

    def within(b: Column) -> Column:
        held = F.greatest(b["low"], F.least(b["high"], b["price"]))
        return F.greatest(b["low"], F.least(b["high"], round_to_tick(held)))

    def band_of(base: Column) -> Column:
        return F.struct(round_to_tick(base * (1 - band), "ceil").alias("low"), round_to_tick(base * (1 + band), "floor").alias("high"), price.alias("price"))

    return let(let(round_to_tick(before), band_of), within)


def trend_label(expected: Column, vol: Column, horizon: Column, cost: float = 0.0) -> Column:
    limit = F.greatest(F.lit(0.005), F.lit(cost), 0.25 * vol * F.sqrt(horizon))
    return F.when(expected > limit, "UP").when(expected < -limit, "DOWN").otherwise("FLAT")


def next_days(last: DataFrame, days: DataFrame, n: int) -> DataFrame:
    """symbol, horizon, target_date: the n trading days after each last_date, by places in the calendar (a row a day)."""
    placed = days.select("Date", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("Date")).alias("place"))
    at = last.join(placed, last["last_date"] == placed["Date"]).select("symbol", "place")
    wanted = at.select("symbol", F.posexplode(F.sequence(F.col("place") + 1, F.col("place") + n)).alias("h", "place"))
    return wanted.join(placed, "place").select("symbol", (F.col("h") + 1).alias("horizon"), F.col("Date").alias("target_date"))


def forecast_points(last: DataFrame, target_days: DataFrame, daily: float) -> DataFrame:
    """A constant daily return rolled forward from last_close."""
    return last.join(target_days, "symbol").withColumn("pred_close", F.col("last_close") * F.pow(F.lit(1 + daily), F.col("horizon")))


def roll_forward(last: DataFrame, steps: int, band: float = 0.10) -> DataFrame:
    """last(symbol, last_close, expected): each step's price is bounded by the one before; a fold within the row."""
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array("last_close"), lambda p, _: F.concat(p, F.array(bounded(F.element_at(p, -1) * (1 + F.col("expected")), F.element_at(p, -1), band))))
    return last.select("symbol", F.posexplode(F.slice(path, 2, steps)).alias("h", "pred_close")).select("symbol", (F.col("h") + 1).alias("horizon"), "pred_close")


def resolve(points: DataFrame, bars: DataFrame) -> DataFrame:
    """Points whose days, and all before them, have an actual close; return against the previous actual."""
    actual = bars.select("symbol", F.col("Date").alias("target_date"), F.col("Close").alias("actual_close"))
    w = Window.partitionBy("symbol").orderBy("horizon")
    out = points.join(actual, ["symbol", "target_date"], "left")
    out = out.withColumns({"_ok": F.min(F.col("actual_close").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_before": F.coalesce(F.lag("actual_close").over(w), F.col("last_close"))}).where("_ok = 1")
    return out.withColumns({"actual_return": F.col("actual_close") / F.col("_before") - 1, "abs_error": F.abs(F.col("pred_close") - F.col("actual_close")), "direction_correct": F.signum(F.col("pred_close") - F.col("last_close")) == F.signum(F.col("actual_close") - F.col("_before"))}).drop("_ok", "_before")


def accuracy(resolved: DataFrame) -> DataFrame:
    e = F.col("abs_error")
    return resolved.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mae"), (100 * F.avg(e / F.col("actual_close"))).alias("mape"), (100 * F.avg(F.col("direction_correct").cast("double"))).alias("dir_acc"))


def carry_forward(series: DataFrame, n: int = 20) -> DataFrame:
    """series(series, Date, value): the last value plus the mean of the last n - 1 changes."""
    w = Window.partitionBy("series").orderBy("Date")
    recent = series.withColumns({"_d": F.col("value") - F.lag("value").over(w), "_k": F.row_number().over(Window.partitionBy("series").orderBy(F.desc("Date")))}).where(F.col("_k") < n)
    return recent.groupBy("series").agg((F.max_by("value", "Date") + F.coalesce(F.avg("_d"), F.lit(0.0))).alias("next_value"))


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """stored with fresh rows in place of those of the same keys."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)
