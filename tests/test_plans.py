"""Every query against its SQL twin on the smallest tables, and rules that a twin does not show."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, splits, xsection
from tidemark.plans.registry import ORACLES, QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def tidy(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        pd.testing.assert_frame_equal(tidy(got), tidy(duck.execute(ORACLES[name]).df()), check_dtype=False, rtol=1e-7, atol=2e-6)
    else:
        assert len(got)


def test_flagship_has_rows(spark):
    assert flagship(spark, SF, min_names=3).count() == 1


def bars(spark, symbols=3, days=260, bump=None):
    rows = []
    for k in range(symbols):
        close = 100.0 + k
        for i in range(days):
            close *= 1 + (((i * 7919 + k * 104729) % 201) - 100) / 5000
            c = close * (10 if bump is not None and i > bump else 1)
            rows.append((f"S{k}", pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=i), c * 0.99, c * 1.02, c * 0.98, c, 1000.0 + (i * 37 + k) % 500))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "Date", "Open", "High", "Low", "Close", "Volume"])).withColumn("Date", F.to_date("Date"))


def test_past_features_ignore_the_future(spark):
    build = lambda b: features.volatility(features.money_flow(features.chaikin(features.moving_averages(b))))
    cut = pd.Timestamp("2020-06-01").date()
    a, b = (build(bars(spark, bump=x)).where(F.col("Date") < cut).drop("Open").toPandas().sort_values(["symbol", "Date"]).reset_index(drop=True) for x in (None, 200))
    pd.testing.assert_frame_equal(a, b)


def test_recursive_features_match_pandas(spark):
    b = bars(spark, symbols=2)
    got = features.recursive_features(b).where("symbol = 'S1'").toPandas().sort_values("Date").reset_index(drop=True)
    close = b.where("symbol = 'S1'").toPandas().sort_values("Date")["Close"].reset_index(drop=True)
    want = close / close.ewm(span=12, adjust=False, min_periods=12).mean() - 1
    pd.testing.assert_series_equal(got["EMA_12_rel"], want, check_names=False)
    assert got["RSI_14"].dropna().between(0, 100).all()


def test_training_rows_know_their_target_before_the_test(spark):
    p = features.causal_columns(bars(spark, days=700)).select("symbol", "Date", "target_date")
    folded = splits.assign_pooled(p, splits.pooled_folds(p, min_train_days=200))
    assert folded.where("role = 'train' and target_date >= test_start").count() == 0
    assert folded.select("fold").distinct().count() == 5


def test_purged_folds_keep_their_distance(spark):
    folded = splits.purged_kfold(bars(spark, symbols=1).select("symbol", "Date"), k=4, purge=3, embargo=7).toPandas()
    for _, f in folded.groupby("fold"):
        days = pd.to_datetime(f["Date"])
        test, train = days[f.role == "test"], days[f.role == "train"]
        assert (train[train < test.min()].max() < test.min() - pd.Timedelta(days=3)) if (train < test.min()).any() else True
        assert (train[train > test.max()].min() > test.max() + pd.Timedelta(days=7)) if (train > test.max()).any() else True


def test_buckets_match_equal_share_cuts(spark):
    for n in (7, 20, 23, 50):
        pdf = pd.DataFrame({"symbol": [f"S{i:03d}" for i in range(n)], "v": [(i * 31) % n for i in range(n)], "k": 1})
        got = spark.createDataFrame(pdf).withColumn("b", xsection.bucket("v", 5, "k")).toPandas().sort_values("symbol")["b"].tolist()
        want = (pd.qcut(pdf["v"].rank(method="first"), 5, labels=False) + 1).tolist()
        assert got == want


def test_entry_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) - set(e.queries()))"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0 and done.stdout.strip().endswith("set()"), done.stderr
