"""Streams with state over several batches and restarts against one batch over everything."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_recursive import bars_of, frames
from tidemark.operators import features
from tidemark.operators.boards import drift_tiers
from tidemark.operators.forecasts import resolve
from tidemark.streaming import state


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def run(stream, tmp_path, name="out"):
    """All that is there, then an end: the next call goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start().awaitTermination()


def test_recursive_features_over_batches_and_a_restart(rocks, tmp_path):
    spark = rocks
    bars = bars_of(spark, frames(symbols=3, days=90))
    source = str(tmp_path / "in")
    edges = ["1900-01-01", "2020-01-20", "2020-02-25", "2020-03-02", "2100-01-01"]
    for a, b in zip(edges, edges[1:], strict=False):
        part = bars.where((F.col("Date") >= a) & (F.col("Date") < b))
        late = bars.where((F.col("Date") < a) & (F.col("symbol") == "S01")).withColumn("Close", F.lit(1e6))  # seen before: dropped
        part.unionByName(late).coalesce(1).write.mode("append").parquet(source)
        run(state.recursive_features(spark.readStream.schema(bars.schema).parquet(source)), tmp_path)  # each a query that restarts
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["symbol", "Date"]).reset_index(drop=True)
    want = features.recursive_features(bars).toPandas().sort_values(["symbol", "Date"]).reset_index(drop=True)
    assert len(got) == len(want) == 90 + 87 + 84
    pd.testing.assert_frame_equal(got[features.RECURSIVE], want[features.RECURSIVE], rtol=1e-9, atol=1e-10)


def test_a_silent_symbol_is_reported_once_and_armed_again(rocks, tmp_path):
    spark, source, day = rocks, str(tmp_path / "in"), datetime.date(2024, 1, 1)

    def land(rows):
        spark.createDataFrame([(s, day + datetime.timedelta(days=n)) for s, n in rows], "symbol string, Date date").coalesce(1).write.mode("append").parquet(source)
        run(state.silent_symbols(spark.readStream.schema("symbol string, Date date").parquet(source)), tmp_path)
        return sorted((r["symbol"], (r["last_date"] - day).days) for r in spark.read.schema("symbol string, last_date date, silent_days int").parquet(str(tmp_path / "out")).collect())

    assert land([("A", 0), ("B", 0)]) == []
    assert land([("B", 10)]) == []  # ten days are not over ten
    assert land([("B", 11)]) == [("A", 0)]  # no bar of A came: its timer fired
    assert land([("B", 30)]) == [("A", 0)]  # once only
    assert land([("A", 31), ("B", 33)]) == [("A", 0)]  # armed again
    assert land([("A", 25), ("B", 41)]) == [("A", 0)]  # an older bar changes nothing
    assert land([("B", 43)]) == [("A", 0), ("A", 31)]


def test_touched_symbols_are_recomputed(spark, tmp_path):
    bars = bars_of(spark, frames(symbols=4, days=200))
    source, store, results = (str(tmp_path / x) for x in ("in", "store", "results"))
    seen = []

    def compute(rows):
        seen.append(sorted(r["symbol"] for r in rows.select("symbol").distinct().collect()))
        return drift_tiers(rows)

    last = datetime.date(2020, 6, 20)
    parts = [bars.where(F.col("Date") < last), bars.where((F.col("Date") >= last) & (F.col("symbol") == "S02")), bars.where((F.col("Date") >= last) & (F.col("symbol") != "S02"))]
    parts.append(bars.where((F.col("Date") == last) & (F.col("symbol") == "S00")).withColumn("Close", F.col("Close") * 3))  # a correction
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        state.refresh_touched(spark.readStream.schema(bars.schema).parquet(source), store, results, compute, str(tmp_path / "check")).awaitTermination()
    assert seen == [["S00", "S01", "S02", "S03"], ["S02"], ["S00", "S01", "S03"], ["S00"]]
    fixed = F.when((F.col("Date") == last) & (F.col("symbol") == "S00"), F.col("Close") * 3).otherwise(F.col("Close"))
    want = drift_tiers(bars.withColumn("Close", fixed))
    columns = ["symbol", "reason", "psi_max", "tier"]
    got = state.read_results(spark, results, want.schema).select(columns).toPandas().sort_values("symbol").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want.select(columns).toPandas().sort_values("symbol").reset_index(drop=True), check_dtype=False)


def test_points_resolve_in_a_prefix_across_batches(spark, tmp_path):
    day = datetime.date(2024, 3, 1)
    points = spark.createDataFrame([(s, h, day + datetime.timedelta(days=h), 10.0 + h, 10.0) for s in "AB" for h in range(1, 5)], "symbol string, horizon int, target_date date, pred_close double, last_close double")
    schema = "symbol string, Date date, Close double"
    closes = lambda rows: spark.createDataFrame([(s, day + datetime.timedelta(days=h), c) for s, h, c in rows], schema)
    source, store, results = (str(tmp_path / x) for x in ("in", "store", "results"))
    batches = [[("A", 1, 11.0), ("A", 3, 12.0), ("B", 2, 9.0)], [("A", 2, 10.5)], [("B", 1, 10.2), ("A", 9, 1.0)]]
    sizes = []
    for k, rows in enumerate(batches):
        closes(rows).coalesce(1).write.mode("append").parquet(source)
        state.resolve_as_they_come(spark.readStream.schema(schema).parquet(source), lambda s: points, store, results, str(tmp_path / "check")).awaitTermination()
        want = resolve(points, closes([r for b in batches[: k + 1] for r in b]))
        got = state.read_results(spark, results, want.schema)
        key = ["symbol", "horizon", "actual_close", "actual_return", "abs_error", "direction_correct"]
        assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
        sizes.append(got.count())
    assert sizes == [1, 3, 5]
