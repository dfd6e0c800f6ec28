"""Streams with state by key: recursive features, silence by timer, and results that are recomputed for the keys a batch has touched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.functions.averages import FEATURES, SIZE, empty, step
from tidemark.operators.forecasts import resolve
from tidemark.streaming.bars import _exists as exists


class RecursiveFeatures(StatefulProcessor):
    """The exponential and Wilder features of each new bar of a symbol. State: the averages (a few numbers, whatever the history) and the last
    date; bars up to that date are late and dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.averages = handle.getValueState("averages", "numbers array<double>, last date")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values("Date", kind="stable").drop_duplicates("Date", keep="last")
        state, last = empty(1), None
        if self.averages.exists():
            numbers, last = self.averages.get()
            state = np.array([np.nan if x is None else x for x in numbers]).reshape(SIZE, 1)
            data = data[data["Date"] > last]
        if not len(data):
            return
        found = [step(state, *(np.array([x]) for x in bar)) for bar in data[["High", "Low", "Close"]].to_numpy(float)]
        self.averages.update(([float(x) for x in state[:, 0]], data["Date"].iloc[-1]))
        out = pd.DataFrame({c: [f[c][0] for f in found] for c in FEATURES})
        out.insert(0, "Date", data["Date"].to_numpy())
        out.insert(0, "symbol", key[0])
        yield out

    def close(self) -> None:
        pass


def recursive_features(bars: DataFrame) -> DataFrame:
    """symbol, Date and the recursive features of a stream of bars(symbol, Date, High, Low, Close), as the batch form gives them over the whole
    history; needs the RocksDB state store."""
    schema = "symbol string, Date date, " + ", ".join(f"{c} double" for c in FEATURES)
    return bars.select("symbol", "Date", "High", "Low", "Close").groupBy("symbol").transformWithStateInPandas(RecursiveFeatures(), schema, outputMode="Append", timeMode="None")


DAY = 24 * 3600 * 1000


class Silence(StatefulProcessor):
    """A key whose newest bar is more than `days` behind the stream's time is reported once; its next bar arms it again. State: the newest time
    and the timer that waits for it."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ms long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(x.timestamp() * 1000) for part in rows for x in part["ts"])
        if self.newest.exists():
            before, timer = self.newest.get()
            if newest <= before:
                return
            if timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        timer = newest + (self.days + 1) * DAY
        self.handle.registerTimer(timer)
        self.newest.update((newest, timer))
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0]
        silent = (expiredTimerInfo.getExpiryTimeInMs() - newest) // DAY
        yield pd.DataFrame({"symbol": [key[0]], "last_date": [pd.Timestamp(newest, unit="ms").date()], "silent_days": [int(silent)]})

    def close(self) -> None:
        pass


def silent_symbols(bars: DataFrame, days: int = 10, delay: str = "0 seconds") -> DataFrame:
    """symbol, last_date, silent_days: a row for each time that a symbol of a stream of bars(symbol, Date) falls silent for more than `days`,
    as the other symbols' bars move time on; needs the RocksDB state store."""
    timed = bars.select("symbol", F.col("Date").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return timed.groupBy("symbol").transformWithStateInPandas(Silence(days), "symbol string, last_date date, silent_days int", outputMode="Append", timeMode="EventTime")


def refresh_touched(
    stream: DataFrame, store: str, results: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str, keys: tuple[str, ...] = ("symbol", "Date")
) -> StreamingQuery:
    """Keep results, a table by symbol, as compute(all rows that have come) gives them, by recomputing only the symbols of each batch.

    A batch first writes its rows under its own number, so a batch that runs twice replaces itself; of rows with the same keys the newest
    batch's counts. Then the touched symbols' rows are read, from their own partitions only, and their partitions of the results replaced.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = batch.columns
        landed = batch.groupBy(*keys).agg(F.max_by(F.struct(*name), F.xxhash64(*name)).alias("r")).select("r.*", F.lit(number).cast("long").alias("batch"))
        landed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "batch").parquet(store)
        stored = spark.read.schema(landed.schema).parquet(store)
        touched = stored.where(F.col("batch") == number).select("symbol").distinct()
        rows = stored.where(F.col("batch") <= number).join(touched, "symbol", "left_semi")
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*name), "batch").alias("r")).select("r.*")
        compute(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(results)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resolve_as_they_come(closes: DataFrame, points: Callable[[SparkSession], DataFrame], store: str, results: str, checkpoint: str) -> StreamingQuery:
    """Open forecast points resolved as closes come. Closes of earlier batches are kept, so that a prefix of a symbol's points that ends in one
    batch goes on in the next."""
    return refresh_touched(closes, store, results, lambda rows: resolve(points(rows.sparkSession).join(rows.select("symbol").distinct(), "symbol", "left_semi"), rows), checkpoint)


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that refresh_touched keeps; empty before its first batch."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
