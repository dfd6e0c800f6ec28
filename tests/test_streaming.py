"""Streams give what the batch form gives."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators.backtest import hysteresis
from tidemark.streaming import bars as S


def test_ingest_drops_late_rows(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "symbol string, Date date, Close double, seq int"
    for k, rows in enumerate([[("A", "2024-01-02", 1.0, 1), ("A", "2024-01-03", 2.0, 1), ("A", "2024-01-03", 3.0, 2)], [("A", "2024-01-01", 9.0, 1), ("A", "2024-01-04", 4.0, 1), ("B", "2023-01-01", 5.0, 1)]]):
        spark.createDataFrame(rows, "symbol string, Date string, Close double, seq int").withColumn("Date", F.to_date("Date")).coalesce(1).write.mode("append").parquet(source)
        S.ingest(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "check")).awaitTermination()
    got = sorted((r["symbol"], str(r["Date"]), r["Close"]) for r in spark.read.parquet(store).collect())
    assert got == [("A", "2024-01-02", 1.0), ("A", "2024-01-03", 3.0), ("A", "2024-01-04", 4.0), ("B", "2023-01-01", 5.0)]


def test_positions_match_batch(spark, tmp_path):
    rows = [(f"S{k}", pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=i), (((i * 37 + k * 11) % 21) - 10) / 100) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "Date", "y_pred"])).withColumn("Date", F.to_date("Date"))
    want = {(r["symbol"], r["Date"]): r["position"] for r in hysteresis(df.withColumn("model", F.lit("m")), 0.05, 0.04).collect()}
    source = str(tmp_path / "in")
    df.coalesce(1).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = S.positions(spark.readStream.schema(df.schema).parquet(source), 0.05, 0.04)
    q = out.writeStream.format("memory").queryName("positions").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["symbol"], r["Date"]): r["position"] for r in spark.table("positions").collect()} == want


def test_windows(spark, tmp_path):
    events = spark.createDataFrame([("a", f"2024-01-0{1 + i} 00:00:00", float(i)) for i in range(6)], "key string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    got = {(r["key"], str(r["start"])): r["n"] for r in S.tumbling(events, "3 days").collect()}
    assert sum(got.values()) == 6 and len(got) >= 2
    assert S.sessions(events, "2 days").collect()[0]["n"] == 6
