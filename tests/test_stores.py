"""Stores under repeated batches and several writers; bars from a provider."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import provider, stores
from tidemark.sources.stores import Store

SCORES = "run_id long, symbol string, peer_percentile double"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCORES)


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_or_replace_and_repeated_batches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", SCORES, ("run_id", "symbol"))
    assert store.read().count() == 0 and store.compact() is None
    assert store.commit(rows(spark, (1, "A", 5.0), (1, "B", 6.0)), "first") == 1
    assert store.commit(rows(spark, (1, "B", 7.0), (2, "A", 8.0)).withColumn("extra", F.lit(1)), "second") == 2
    assert store.commit(rows(spark, (1, "B", 99.0)), "first") is None  # a batch that runs again
    assert content(store.read()) == [(1, "A", 5.0), (1, "B", 7.0), (2, "A", 8.0)] and store.history().count() == 4
    assert store.compact() == 3 and store.history().count() == 3 and store.commit(rows(spark, (9, "x", 0.0)), "second") is None
    assert store.commit(rows(spark, (2, "A", 1.0))) == 4
    again = Store(spark, f"file://{tmp_path}/s", SCORES, ("run_id", "symbol"))
    assert content(again.read()) == [(1, "A", 5.0), (1, "B", 7.0), (2, "A", 1.0)]
    assert [(r["symbol"], r["place"]) for r in stores.latest_run(again.read()).collect()] == [("A", 1)]


def test_rows_without_a_manifest_do_not_count(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", SCORES)
    store._write(rows(spark, (1, "lost", 1.0)))  # a writer that died before its manifest
    store.commit(rows(spark, (1, "A", 1.0)))
    store.commit(rows(spark, (1, "A", 1.0)))
    assert content(store.read()) == [(1, "A", 1.0)] * 2  # a log keeps both


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    a, b = (Store(spark, path, SCORES, ("run_id", "symbol")) for _ in range(2))
    calls = []

    def next_run(known):
        calls.append(known.count())
        if len(calls) == 1:  # the other writer commits between what this one read and its own commit
            assert b.commit(rows(spark, (1, "B", 1.0))) == 1
        top = known.agg(F.coalesce(F.max("run_id"), F.lit(0)).alias("m")).first()["m"]
        return rows(spark, (top + 1, "A", 1.0))

    assert a.commit(next_run) == 2 and calls == [0, 1]
    assert content(a.read()) == content(b.read()) == [(1, "B", 1.0), (2, "A", 1.0)]
    # a plain commit goes on to the next number; a compaction that comes second gives up
    assert not a._claim(2, {"number": 2, "tokens": [], "rows": [], "whole": True}) and a.commit(rows(spark, (3, "C", 1.0))) == 3
    assert [m["number"] for m in b.manifests()] == [1, 2, 3]


def test_versions_of_models(spark, tmp_path):
    catalogue = stores.model_catalogue(spark, f"file://{tmp_path}/c")
    entry = lambda *names: spark.createDataFrame([(n, ["x"], {"rmse": 1.0}, f"/m/{k}", datetime.datetime(2024, 1, 1 + k)) for k, n in enumerate(names)], "model_name string, features array<string>, metrics map<string,double>, model_path string, registered_at timestamp")
    stores.register_models(catalogue, entry("ridge", "ridge", "forest"), "t1")
    stores.register_models(catalogue, entry("ridge", "gru"), "t2")
    assert stores.register_models(catalogue, entry("ridge"), "t2") is None
    got = sorted((r["model_name"], r["version"], r["model_path"]) for r in catalogue.read().collect())
    assert got == [("forest", 1, "/m/2"), ("gru", 1, "/m/1"), ("ridge", 1, "/m/0"), ("ridge", 2, "/m/1"), ("ridge", 3, "/m/0")]


def test_run_log(spark, tmp_path):
    log = stores.run_log(spark, f"file://{tmp_path}/l")
    at = datetime.datetime(2024, 1, 1)
    for k, (digest, note) in enumerate([("h1", "old"), ("h1", "new"), ("N/A", "none")]):
        log.commit(spark.createDataFrame([("m", at, digest, {"k": str(k)}, {"mae": float(k)}, ["a", "b"], {"note": note})], stores.RUNS), f"run{k}")
    assert log.read().count() == 3 and [tuple(r) for r in stores.dataset_metadata(log).collect()] == [("h1", {"note": "new"})]


def test_exports_replace_their_own_mode(spark, tmp_path):
    p = spark.createDataFrame([("m", 1.0), ("n", 2.0)], "model string, y double")
    for mode, df in (("single_split", p), ("walk_forward", p), ("single_split", p.where("model = 'm'").withColumn("y", F.lit(9.0)))):
        stores.export_results(df, df, f"file://{tmp_path}/e", mode)
    got = spark.read.parquet(f"file://{tmp_path}/e/predictions")
    assert sorted((r["validation_mode"], r["model"], r["y"]) for r in got.collect()) == [("single_split", "m", 9.0), ("single_split", "n", 2.0), ("walk_forward", "m", 1.0), ("walk_forward", "n", 2.0)]


class Counting(provider.Provider):
    """A provider that says in its volumes what it was asked for."""

    def symbols(self):
        return ["A", "B", "C"]

    def download(self, symbol, start, end):
        yield (max(start, datetime.date(2024, 1, 1)), 1.0, 1.0, 1.0, 1.0, float(end.toordinal() - start.toordinal()))


def test_bars_from_a_provider(spark, tmp_path):
    for s in ("AAA", "BBB", "CCC"):
        (tmp_path / f"{s}.csv").write_text("﻿Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,100\n2024-01-03,,x,1,2.5,\nbad,1,1,1,1,1\n2024-01-04,3,3,3,3,3\n")
    provider.register(spark)
    bars = spark.read.format("provider_bars").option("path", f"file://{tmp_path}").load()
    assert bars.count() == 9 and bars.rdd.getNumPartitions() == 3
    two = bars.where("symbol = 'AAA' and Date < date'2024-01-04'").orderBy("Date")
    assert [tuple(r)[1:] for r in two.collect()] == [(datetime.date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 100.0), (datetime.date(2024, 1, 3), None, None, 1.0, 2.5, None)]
    assert bars.where("symbol = 'AAA' and Date < date'2024-01-04'").rdd.getNumPartitions() == 1  # the filter reached the provider: one symbol is read
    asked = spark.read.format("provider_bars").option("provider", "tests.test_stores:Counting").option("end", "2024-02-10").load()
    got = asked.where("symbol in ('A', 'C') and Date >= date'2024-02-01' and Date <= date'2024-02-05' and Close > 0").collect()
    assert {(r["symbol"], r["Volume"]) for r in got} == {("A", 4.0), ("C", 4.0)}
    assert asked.where("symbol = 'A' and symbol = 'B'").count() == 0 and asked.where("Close > 5").count() == 0


def test_filters_that_are_taken():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

    reader = provider.ProviderReader({"provider": "tests.test_stores:Counting"})
    left = [GreaterThan(("Close",), 5.0)]
    filters = [EqualTo(("symbol",), "A"), In(("symbol",), ("A", "B")), GreaterThan(("Date",), datetime.date(2024, 1, 1)), LessThan(("Date",), datetime.date(2024, 1, 9)), *left]
    assert list(reader.pushFilters(filters)) == left
    assert (reader.only, reader.start, reader.end) == ({"A"}, datetime.date(2024, 1, 2), datetime.date(2024, 1, 8)) and [p.symbol for p in reader.partitions()] == ["A"]
    with pytest.raises(NotImplementedError):
        provider.Provider({}).symbols()
