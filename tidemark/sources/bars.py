"""Daily bars of a symbol: derived from trades, read from files, and kept clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import table

BAR_COLUMNS = ["symbol", "Date", "Open", "High", "Low", "Close", "Volume"]


def bars_from_trades(trades: DataFrame) -> DataFrame:
    """trades(symbol, Date, price, quantity, seq) to one bar a symbol and day; one shuffle, combined on the map side."""
    return trades.groupBy("symbol", "Date").agg(
        F.min_by("price", "seq").alias("Open"), F.max("price").alias("High"), F.min("price").alias("Low"),
        F.max_by("price", "seq").alias("Close"), F.sum("quantity").alias("Volume"),
    )


def table_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of part brands: a line item is a trade at its unit price."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    trades = items.join(parts, items["l_partkey"] == parts["p_partkey"]).select(
        "symbol", F.to_date("l_shipdate").alias("Date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )
    return bars_from_trades(trades)


def parse_dates(value: Column) -> Column:
    """ISO first, then day-first with slashes or dots; null where none fits."""
    text = F.trim(value)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")).otherwise(
        F.coalesce(F.try_to_date(text, "dd/MM/yyyy"), F.try_to_date(text, "dd.MM.yyyy"))
    )


def date_format_of(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), "iso").when(value.rlike(r"^\d{2}/\d{2}/\d{4}"), "dd/mm/YYYY").when(value.rlike(r"^\d{2}\.\d{2}\.\d{4}"), "dd.mm.YYYY").otherwise("unknown")


def read_bar_files(spark: SparkSession, path: str, renames: dict[str, str] | None = None, sep: str = ",") -> DataFrame:
    """All files of a folder in one scan, as strings first; the symbol is the file's name. renames: header to bar column."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    raw = raw.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.csv", 1)).withColumnsRenamed(renames or {})
    number = {c: F.col(c).try_cast("double") for c in ("Open", "High", "Low", "Close", "Adj_Close", "Volume") if c in raw.columns}
    return raw.withColumns({"Date": parse_dates(F.col("Date")), **number}).where(F.col("Date").isNotNull())


def write_report(df: DataFrame, path: str, columns: list[str], digits: int = 4) -> None:
    """Preferred columns that exist, numbers rounded, booleans as Yes and No, with semicolons."""
    kinds = dict(df.dtypes)
    keep = [c for c in columns if c in kinds]
    shown = [F.when(F.col(c), "Yes").otherwise("No").alias(c) if kinds[c] == "boolean" else F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in keep]
    df.select(shown).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def traded(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("Volume") > 0)


def latest_rows(bars: DataFrame) -> DataFrame:
    """Newest date and close of each symbol."""
    return bars.groupBy("symbol").agg(F.max("Date").alias("last_date"), F.max_by("Close", "Date").alias("last_close"))


def new_rows(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Offered rows newer than the symbol's last stored date, one a date (the last offered by `seq`)."""
    last = stored.groupBy("symbol").agg(F.max("Date").alias("_last"))
    fresh = offered.join(last, "symbol", "left").where(F.col("_last").isNull() | (F.col("Date") > F.col("_last"))).drop("_last")
    newest = Window.partitionBy("symbol", "Date").orderBy(F.desc("seq"))
    return fresh.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")


def update_status(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Per symbol: rows_added and status (updated, up_to_date)."""
    added = new_rows(stored, offered).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows_added"))
    every = stored.select("symbol").union(offered.select("symbol")).distinct()
    out = every.join(added, "symbol", "left").withColumn("rows_added", F.coalesce("rows_added", F.lit(0)))
    return out.withColumn("status", F.when(F.col("rows_added") > 0, "updated").otherwise("up_to_date"))


def stored_rows_win(stored: DataFrame, refetched: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which a stored row beats a re-read one of the same keys."""
    both = stored.withColumn("_p", F.lit(0)).unionByName(refetched.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy(*keys).orderBy("_p")
    return both.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_p", "_k")


def conform(df: DataFrame, schema: list[tuple[str, str]], fallbacks: dict[str, str] | None = None) -> DataFrame:
    """df with exactly the stored columns; unknown ones null, or the fallback's value."""
    pick = []
    for name, kind in schema:
        source = name if name in df.columns else (fallbacks or {}).get(name)
        pick.append((F.col(source) if source in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(pick)


def calendar(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """One row a day: closed at weekends and on holidays(Date, Note); overrides(Date, Is_Trading_Day, Note) win."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("Date"))
    out = days.withColumns({"Is_Trading_Day": F.weekday("Date") < 5, "Note": F.lit(None).cast("string")})
    if holidays is not None:
        out = out.join(holidays.select("Date", F.col("Note").alias("_n"), F.lit(True).alias("_h")), "Date", "left")
        out = out.select("Date", (F.col("Is_Trading_Day") & F.col("_h").isNull()).alias("Is_Trading_Day"), F.col("_n").alias("Note"))
    if overrides is not None:
        over = overrides.select("Date", F.col("Is_Trading_Day").alias("_t"), F.col("Note").alias("_m"))
        out = out.join(over, "Date", "left").select("Date", F.coalesce("_t", "Is_Trading_Day").alias("Is_Trading_Day"), F.coalesce("_m", "Note").alias("Note"))
    return out


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report as text columns, whether its separator is a semicolon or a comma, with or without a byte order mark. The header says which."""
    first = spark.read.text(path).limit(1).collect()
    sep = ";" if first and ";" in first[0][0] else ","
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


#: Names under which date and close are found, in order of preference, whatever their case.
DATE_NAMES, CLOSE_NAMES = ("date", "tarih"), ("close", "kapanış", "kapanis", "adj_close", "adj close")


def close_series(raw: DataFrame) -> DataFrame:
    """Date and Close of a table whose columns have one of the known names; rows without a date or a close go."""
    by = {c.strip().lower(): c for c in reversed(raw.columns)}
    found = [next((by[n] for n in names if n in by), None) for names in (DATE_NAMES, CLOSE_NAMES)]
    if None in found:
        raise ValueError(f"no {'date' if found[0] is None else 'close'} among {raw.columns}")
    kinds = dict(raw.dtypes)
    day = F.col(f"`{found[0]}`") if kinds[found[0]] == "date" else parse_dates(F.col(f"`{found[0]}`").cast("string"))
    return raw.select(day.alias("Date"), F.col(f"`{found[1]}`").try_cast("double").alias("Close")).where("Date is not null and Close is not null")
