"""Checks of bars and universes: each gives rows that name what is wrong, by symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import over_time
from tidemark.operators.features import returns

LARGE, EXTREME = 0.30, 0.50


def with_gaps(bars: DataFrame) -> DataFrame:
    return bars.withColumn("gap", F.datediff("Date", F.lag("Date").over(over_time())))


def survivorship(bars: DataFrame, short_days: int = 730, gap_days: int = 10) -> DataFrame:
    out = with_gaps(bars).groupBy("symbol").agg(F.datediff(F.max("Date"), F.min("Date")).alias("span_days"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"))
    return out.withColumns({"short_history": F.col("span_days") < short_days, "gap_found": F.col("max_gap") > gap_days})


def choose_close(bars: DataFrame, limit: float = 10.0) -> DataFrame:
    """Adjusted close where a symbol's adjustments are believable, else the raw one; with a trust score."""
    off = F.abs(F.col("Adj_Close") / F.nullif(F.col("Close"), F.lit(0.0)) - 1)
    trust = bars.groupBy("symbol").agg((F.coalesce(F.bool_or(F.col("Adj_Close") <= 0), F.lit(False)) | (F.coalesce(F.max(off), F.lit(0.0)) > limit)).alias("distrusted"), (1 - F.least(F.coalesce(F.avg(off), F.lit(0.0)), F.lit(limit)) / limit).alias("trust_score"))
    return bars.join(trust, "symbol").withColumn("Close", F.when(F.col("distrusted"), F.col("Close")).otherwise(F.coalesce("Adj_Close", "Close")))


def coverage(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Whether the universe lists a symbol from its first bar to its last."""
    span = bars.groupBy("symbol").agg(F.min("Date").alias("first"), F.max("Date").alias("last"))
    listed = universe.select(F.upper("Symbol").alias("_s"), "Listed_Date", "Delisted_Date")
    ok = (F.col("Listed_Date") <= F.col("first")) & (F.col("Delisted_Date").isNull() | (F.col("Delisted_Date") >= F.col("last")))
    status = F.when(F.col("_s").isNull(), "not_found").when(ok, "covered").otherwise("not_listed_for_full_period")
    return span.join(listed, F.upper("symbol") == F.col("_s"), "left").withColumn("status", status).drop("_s")


def corporate_actions(bars: DataFrame, threshold: float = LARGE, universe: DataFrame | None = None) -> DataFrame:
    if universe is not None:
        bars = bars.join(universe.select(F.col("Symbol").alias("symbol")), "symbol", "left_semi")
    big = returns(bars).where(F.abs("logret") >= threshold)
    return big.select("symbol", "Date", "logret", F.when(F.abs("logret") >= EXTREME, "extreme").otherwise("large").alias("severity"), F.when(F.col("logret") < 0, "split_or_fall").otherwise("merge_or_rise").alias("note"))


def recent_anomaly(symbols: DataFrame, actions: DataFrame, today: Column, days: int = 252) -> DataFrame:
    recent = actions.where(F.col("Date") >= F.date_sub(today, days)).select("symbol").distinct().withColumn("anomaly", F.lit(True))
    return symbols.join(recent, "symbol", "left").withColumn("anomaly", F.coalesce("anomaly", F.lit(False)))


def history_bucket(days: Column) -> Column:
    return F.when(days.isNull(), "missing").when(days >= 3652.5, "long").when(days >= 1826.25, "mid").otherwise("short")


def audit(bars: DataFrame) -> DataFrame:
    """One aggregate over gaps and returns, beside the newest date of all."""
    newest = bars.agg(F.max("Date").alias("newest"))
    out = with_gaps(returns(bars)).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"),
        (F.count(F.lit(1)) - F.count_distinct("Date")).alias("duplicate_dates"), F.count_if(F.col("Volume") == 0).alias("zero_volume"),
        F.count_if(F.col("Close").isNull()).alias("null_close"), F.count_if(F.col("Close") <= 0).alias("nonpositive_close"),
        F.max("gap").alias("max_gap"), F.count_if(F.abs("logret") >= LARGE).alias("anomalies"), F.max(F.abs("logret")).alias("max_abs_logret"),
    )
    out = out.crossJoin(F.broadcast(newest)).withColumns({"span_days": F.datediff("last_date", "first_date"), "days_behind": F.datediff("newest", "last_date")})  # one row
    return out.withColumn("history", history_bucket(F.col("span_days"))).drop("newest")


def training_window(bars: DataFrame, years: int, least: int) -> DataFrame:
    """The last years of a symbol if they hold enough rows, else all of it."""
    whole = Window.partitionBy("symbol")
    out = bars.withColumn("_in", F.col("Date") >= F.add_months(F.max("Date").over(whole), -12 * years))
    out = out.withColumn("window_status", F.when(F.count_if("_in").over(whole) >= least, "window").otherwise("all"))
    return out.where((F.col("window_status") == "all") | F.col("_in")).drop("_in")


def freshness(bars: DataFrame, limit: int, days: DataFrame | None = None) -> DataFrame:
    """Trading days after each symbol's last bar; days(Date): the calendar, else the dates on which anything traded."""
    days = (days if days is not None else bars.select("Date").distinct()).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("Date")))  # a row a day
    top = days.agg(F.max("place").alias("top"))
    last = bars.groupBy("symbol").agg(F.max("Date").alias("last_date"))
    # the calendar's place of the last bar: the latest day on or before it
    at = last.join(days.select(F.col("Date").alias("last_date"), "place"), "last_date", "left")
    out = at.crossJoin(F.broadcast(top)).withColumn("days_behind", (F.col("top") - F.coalesce("place", F.lit(0))).cast("long"))  # one row
    return out.select("symbol", "last_date", "days_behind", (F.col("days_behind") > limit).alias("stale"))


def missing_outputs(required: DataFrame, present: DataFrame) -> DataFrame:
    """Per run the required outputs that are not there, joined with bars."""
    return required.join(present, ["run_id", "output"], "left_anti").groupBy("run_id").agg(F.concat_ws("|", F.array_sort(F.collect_list("output"))).alias("missing"))


def universe_changes(bars: DataFrame, universe: DataFrame, today: Column, active_days: int = 30) -> DataFrame:
    """The universe after a sync: found symbols are added, dates and status refreshed, entries made by hand kept."""
    span = bars.groupBy(F.col("symbol").alias("Symbol")).agg(F.min("Date").alias("_first"), F.max("Date").alias("_last"))
    out = universe.join(span, "Symbol", "full_outer")
    status = F.when(F.col("_last").isNull(), F.col("Status")).when(F.datediff(today, "_last") <= active_days, "Active").otherwise("Inactive")
    return out.withColumns({"Listed_Date": F.coalesce("_first", "Listed_Date"), "Status": status, "Source": F.coalesce("Source", F.lit("auto-discovered"))}).drop("_first", "_last")


def backfill_sector(universe: DataFrame, lookup: DataFrame, only_blank: bool = True) -> DataFrame:
    known = F.nullif(F.trim("Sector"), F.lit(""))
    found = lookup.select("Symbol", F.col("Sector").alias("_sector"))
    pick = F.coalesce(known, F.col("_sector"), F.lit("Unknown")) if only_blank else F.coalesce(F.col("_sector"), known, F.lit("Unknown"))
    return universe.join(found, "Symbol", "left").withColumn("Sector", pick).drop("_sector")
