"""Structured Streaming twins: ingest, overlap re-reads, positions with state, resolution, staleness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators.forecasts import resolve
from tidemark.sources.bars import new_rows


def ingest(offered: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append offered rows newer than each symbol's last stored date; later ones of the past are dropped. offered: a stream of bars with seq."""

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.schema(batch.drop("seq").schema).option("recursiveFileLookup", True).parquet(store) if _exists(spark, store) else spark.createDataFrame([], batch.drop("seq").schema)
        new_rows(stored, batch).drop("seq").write.mode("append").parquet(store)

    return offered.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_seen(series: DataFrame, delay: str = "60 days") -> DataFrame:
    """The first row seen of each (series, Date) within the overlap that sources re-read; series has an event time ts."""
    return series.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["series", "Date"])


def tumbling(events: DataFrame, width: str = "21 days", slide: str | None = None) -> DataFrame:
    """Counts and sums of value by window and key; slide gives overlapping windows."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", width).groupBy(span.alias("w"), "key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("key", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", gap).groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Position(StatefulProcessor):
    """A set-reset switch a key: in above buy, out below -sell; state: the position."""

    def __init__(self, buy: float, sell: float):
        self.buy, self.sell = buy, sell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", "position int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.position.get()[0] if self.position.exists() else 0
        data = pd.concat(list(rows)).sort_values("Date")
        out = []
        for p in data["y_pred"]:
            held = 1 if p > self.buy else 0 if p < -self.sell else held
            out.append(held)
        self.position.update((held,))
        yield pd.DataFrame({"symbol": key[0], "Date": data["Date"].to_numpy(), "position": pd.array(out, "int32")})

    def close(self) -> None:
        pass


def positions(predictions: DataFrame, buy: float, sell: float) -> DataFrame:
    """Positions of a stream of predictions(symbol, Date, y_pred); needs the RocksDB state store."""
    return predictions.groupBy("symbol").transformWithStateInPandas(Position(buy, sell), "symbol string, Date date, position int", outputMode="Append", timeMode="None")


def resolve_points(closes: DataFrame, open_points: Callable[[], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Resolve open forecast points as closes come: each batch joins the points, a contiguous prefix a symbol resolves."""
    return closes.writeStream.foreachBatch(lambda batch, _: sink(resolve(open_points(), batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
