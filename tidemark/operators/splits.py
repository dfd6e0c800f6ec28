"""Time-ordered splits as fold tables and range joins; nothing at t sees t + 1."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """rn from 1 in date order, n rows, per key."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"rn": F.row_number().over(w.orderBy("Date")), "n": F.count(F.lit(1)).over(w)})


def single_split(df: DataFrame, test_ratio: float = 0.2) -> DataFrame:
    return numbered(df, "symbol").withColumn("role", F.when(F.col("rn") <= F.floor(F.col("n") * (1 - test_ratio)), "train").otherwise("test")).drop("rn", "n")


def final_holdout(df: DataFrame, rows: int, least: int) -> DataFrame:
    """The last `rows` rows of a symbol are held out where at least `least` others remain."""
    return numbered(df, "symbol").withColumn("role", F.when((F.col("n") - F.col("rn") < rows) & (F.col("n") - rows >= least), "holdout").otherwise("selection")).drop("rn", "n")


def walk_forward_bounds(df: DataFrame, splits: int, test: int, min_train: int, embargo: int = 0, max_train: int | None = None) -> DataFrame:
    """Fold bounds per symbol (row numbers, inclusive), counted back from the end; as many folds as leave min_train rows."""
    size = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    fit = F.least(F.lit(splits), F.floor((F.col("n") - min_train - embargo) / test)).cast("int")
    folds = size.withColumn("k", fit).where("k >= 1").select("symbol", "n", "k", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("fold"))
    start = F.col("n") - (F.col("k") - F.col("fold") + 1) * test + 1
    train_end = start - embargo - 1
    train_start = F.lit(1) if max_train is None else F.greatest(F.lit(1), train_end - max_train + 1)
    return folds.select("symbol", "fold", train_start.cast("long").alias("train_start"), train_end.alias("train_end"), start.alias("test_start"), (start + test - 1).alias("test_end"))


def assign_folds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each row once for every fold it takes part in, with its role; an equi-join on symbol, then the ranges."""
    rows = numbered(df, "symbol").drop("n")
    joined = rows.join(bounds, "symbol").withColumn("role", F.when(F.col("rn").between(F.col("train_start"), F.col("train_end")), "train").when(F.col("rn").between(F.col("test_start"), F.col("test_end")), "test"))
    return joined.where("role is not null").drop("train_start", "train_end", "test_start", "test_end")


def protocol(folded: DataFrame) -> DataFrame:
    """Rows and dates of each role by symbol and fold."""
    return folded.groupBy("symbol", "fold").pivot("role", ["train", "test"]).agg(F.count(F.lit(1)).alias("rows"), F.min("Date").alias("first"), F.max("Date").alias("last"))


def purged_kfold(df: DataFrame, k: int = 5, purge: int = 5, embargo: int = 5) -> DataFrame:
    """fold and role of every row: test by equal parts of the rows, train outside [start - purge, end + embargo)."""
    rows = numbered(df, "symbol")
    folds = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size = F.floor(F.col("n") / k)
    start = F.col("fold") * size
    end = F.when(F.col("fold") == k - 1, F.col("n")).otherwise(start + size)
    at = F.col("rn") - 1
    role = F.when((at >= start) & (at < end), "test").when((at < start - purge) | (at >= end + embargo), "train")
    return folds.withColumn("role", role).where("role is not null").drop("rn", "n")


def combinatorial_folds(df: DataFrame, groups: int = 6, test_groups: int = 2, purge: int = 5, embargo: int = 5) -> DataFrame:
    """All choices of test groups; a row trains where it is outside every test group's purged range."""
    table = [(i, list(c)) for i, c in enumerate(combinations(range(groups), test_groups))]
    choices = F.broadcast(df.sparkSession.createDataFrame(table, "fold int, tests array<int>"))  # C(groups, test_groups) rows
    rows = numbered(df, "symbol").withColumn("at", F.col("rn") - 1).withColumn("grp", F.least(F.lit(groups - 1), F.floor(F.col("at") / F.floor(F.col("n") / groups))).cast("int"))
    size = F.floor(F.col("n") / groups)

    def touched(g):
        end = F.when(g == groups - 1, F.col("n")).otherwise((g + 1) * size)
        return (F.col("at") >= g * size - purge) & (F.col("at") < end + embargo)

    role = F.when(F.array_contains("tests", F.col("grp")), "test").when(~F.exists("tests", touched), "train")
    return rows.crossJoin(choices).withColumn("role", role).where("role is not null").drop("rn", "n", "at", "grp", "tests")


def pooled_folds(panel: DataFrame, window: int = 21, folds: int = 5, embargo: int = 10, min_train_days: int = 365, reserve: int = 0) -> DataFrame:
    """Walk-forward windows over the calendar of the panel, newest last: fold, test_start, test_end, train_end.

    embargo and window are positions in the list of dates, min_train_days calendar days. One row a date is ordered, as few as the calendar has.
    """
    days = panel.select("Date").distinct().withColumns({"rn": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("Date")), "n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    ends = days.select("Date", "rn", "n").withColumn("back", F.col("n") - F.col("rn") + 1)
    wanted = panel.sparkSession.range(1, folds + 1).select(F.col("id").cast("int").alias("back_fold"))
    span = ends.select("Date", "rn", "n").crossJoin(F.broadcast(wanted))  # folds rows
    low, high = F.col("n") - (F.col("back_fold") + reserve) * window + 1, F.col("n") - (F.col("back_fold") + reserve - 1) * window
    table = span.groupBy("back_fold").agg(
        F.min("Date").alias("first_date"), F.max(F.when(F.col("rn") == low, F.col("Date"))).alias("test_start"),
        F.max(F.when(F.col("rn") == high, F.col("Date"))).alias("test_end"), F.max(F.when(F.col("rn") == low - embargo - 1, F.col("Date"))).alias("train_end"),
    )
    table = table.where(F.col("test_start").isNotNull() & F.col("train_end").isNotNull() & (F.datediff("train_end", "first_date") >= min_train_days))
    return table.select((F.lit(folds) - F.col("back_fold") + 1).cast("int").alias("fold"), "test_start", "test_end", "train_end")


def assign_pooled(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows by fold and role; a training row's target must be known before the test starts."""
    joined = panel.crossJoin(F.broadcast(folds))  # a handful of folds
    role = F.when(F.col("Date").between(F.col("test_start"), F.col("test_end")), "test").when((F.col("Date") <= F.col("train_end")) & (F.col("target_date") < F.col("test_start")), "train")
    return joined.withColumn("role", role).where("role is not null")


def rolling_holdout(predictions: DataFrame, window: int = 60, step: int = 20, least: int = 3) -> DataFrame:
    """Per symbol over windows of rows: gain sum(sign(pred) * y); their median, positive share and interquartile range; only with enough windows."""
    rows = numbered(predictions, "symbol")
    # a row at position p lies in the windows that start at multiples of step in (p - window, p]
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - window) / step))
    at = rows.withColumn("w", F.explode(F.sequence(first.cast("long"), F.floor((F.col("rn") - 1) / step))))
    at = at.where(F.col("w") * step + window <= F.col("n"))
    gain = at.groupBy("symbol", "w").agg(F.sum(F.signum("y_pred") * F.col("y_true")).alias("gain"))
    q = F.percentile("gain", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = gain.groupBy("symbol").agg(F.count(F.lit(1)).alias("windows"), q.alias("q"), F.avg((F.col("gain") > 0).cast("double")).alias("positive_share"))
    return out.where(F.col("windows") >= least).select("symbol", "windows", F.col("q")[1].alias("median_gain"), "positive_share", (F.col("q")[2] - F.col("q")[0]).alias("iqr"))
