"""Joins of daily and monthly series onto dates and bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import full, over_time, ratio


def fill_forward(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Last known value of each column. Without keys the table is one series, a row a day."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def base_series(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two daily series on Date, forward-filled."""
    joined = a.join(b, "Date", "full_outer")
    return fill_forward(joined, [c for c in joined.columns if c != "Date"])


def add_series(base: DataFrame, series: list[DataFrame]) -> DataFrame:
    """Left joins of more daily series, each forward-filled over base's dates."""
    joined = reduce(lambda x, s: x.join(s, "Date", "left"), series, base)
    return fill_forward(joined, [c for s in series for c in s.columns if c != "Date"])


def lag_release(monthly: DataFrame, days: int) -> DataFrame:
    return monthly.withColumn("Date", F.date_add("Date", days))


def merge_monthly(base: DataFrame, monthly: DataFrame, lag_days: int, exact: bool = True) -> DataFrame:
    """Monthly values known `lag_days` later. exact: only if that day is in base, else the value is lost; otherwise the latest
    release on or before each date counts (backward as-of, by union and fill)."""
    values = [c for c in monthly.columns if c != "Date"]
    late = lag_release(monthly, lag_days)
    if exact:
        return fill_forward(base.join(late, "Date", "left"), values)
    days = base.select("Date").withColumn("_own", F.lit(True))
    every = fill_forward(days.join(late, "Date", "full_outer"), values).where("_own").drop("_own")
    return base.join(every, "Date", "left")


def merge_macro(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """Macro columns onto each symbol's bars by date, forward-filled within the symbol."""
    return fill_forward(bars.join(macro, "Date", "left"), [c for c in macro.columns if c != "Date"], "symbol")


def monthly_rate(monthly: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("Date")
    return monthly.withColumns({f"{value}_level": F.col(value), f"{value}_change": F.col(value) - F.lag(value).over(w)})


def monthly_index(monthly: DataFrame, value: str) -> DataFrame:
    """Month on month and twelve rows back."""
    w = Window.partitionBy(F.lit(0)).orderBy("Date")
    return monthly.withColumns({f"{value}_mom": ratio(F.col(value), F.lag(value, 1).over(w)) - 1, f"{value}_yoy": ratio(F.col(value), F.lag(value, 12).over(w)) - 1})


def daily_changes(series: DataFrame, columns: list[str], n: int = 7) -> DataFrame:
    """Return of each column, its n-row volatility, and its distance from the n-row mean. series has a `symbol` key."""
    w = over_time()
    out = series.withColumns({f"{c}_ret": ratio(F.col(c), F.lag(c).over(w)) - 1 for c in columns})
    return out.withColumns({**{f"{c}_vol{n}": full(F.stddev_samp(f"{c}_ret"), F.col(f"{c}_ret"), n) for c in columns}, **{f"{c}_rel{n}": ratio(F.col(c), full(F.avg(c), F.col(c), n)) - 1 for c in columns}})


def staleness(series: DataFrame, today, limit_days: int) -> DataFrame:
    """Per series: its last date and whether it is older than the limit. today: a date column or literal."""
    return series.groupBy("series").agg(F.max("Date").alias("last_date")).withColumn("stale", F.col("last_date").isNull() | (F.datediff(today, "last_date") > limit_days))


#: Days of history before the wanted range: for daily windows, and for twelve months of monthly values. Fixed values.
BEFORE_DAILY, BEFORE_MONTHLY = 90, 395


def canonical_series(raw: DataFrame, key: str, aliases: list[str]) -> DataFrame:
    """Date and key of a series whose values stand under one or more old names: the first non-null alias that is there (else the first of all
    value columns), as a number; rows without one go; of rows that repeat a date the last by `seq`, or the largest value without it, stays."""
    values = [c for c in raw.columns if c not in ("Date", "seq")]
    named = [a for a in aliases if a in values] or values
    value = F.coalesce(*[F.col(f"`{c}`").try_cast("double") for c in named]) if named else F.lit(None).cast("double")
    order = F.max_by("v", "seq") if "seq" in raw.columns else F.max("v")
    return raw.withColumn("v", value).where("v is not null").groupBy("Date").agg(order.alias(key))


def in_range(series: DataFrame, start: str, end: str, before: int) -> DataFrame:
    """Rows from `before` days ahead of start up to end; the comparison goes to the scan."""
    return series.where(F.col("Date").between(F.date_sub(F.lit(start).cast("date"), before), F.lit(end).cast("date")))


def macro_matrix(
    base: tuple[DataFrame | None, DataFrame | None], others: list[DataFrame], rate: DataFrame | None, prices: DataFrame | None, start: str, end: str, rate_lag: int = 1, price_lag: int = 15
) -> DataFrame | None:
    """All macro columns by date from start to end; None if a base series is missing.

    Monthly features are made at their own frequency, dated by their release, and met on the exact day, filled forward; both base series give
    the dates; the others join them. Then each daily series gets its return, 7-row volatility and distance from the 7-row mean. Columns of the
    rate: rate, rate_change; of prices: mom, yoy; of both: real_rate.
    """
    if base[0] is None or base[1] is None:
        return None
    daily = base_series(*(in_range(b, start, end, BEFORE_DAILY) for b in base))
    if others:
        daily = add_series(daily, [in_range(o, start, end, BEFORE_DAILY) for o in others])
    names = [c for c in daily.columns if c != "Date"]
    monthly = []
    if rate is not None:
        value = rate.columns[-1]
        made = monthly_rate(in_range(rate, start, end, BEFORE_MONTHLY).withColumnRenamed(value, "rate"), "rate")
        monthly.append((made.select("Date", "rate", "rate_change"), rate_lag))
    if prices is not None:
        value = prices.columns[-1]
        made = monthly_index(in_range(prices, start, end, BEFORE_MONTHLY).withColumnRenamed(value, "p"), "p")
        monthly.append((made.select("Date", F.col("p_mom").alias("mom"), F.col("p_yoy").alias("yoy")), price_lag))
    for table, lag in monthly:
        daily = merge_monthly(daily, table, lag)
    if len(monthly) == 2:
        daily = daily.withColumn("real_rate", F.col("rate") - F.col("yoy"))
    made = daily_changes(daily.withColumn("symbol", F.lit("macro")), names).drop("symbol")  # a row a day
    return made.where(F.col("Date") >= F.lit(start).cast("date"))
