"""Recursive forecasts, their states and newest rows against plain loops over whole series."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import averages
from tidemark.operators import features, recursive
from tidemark.operators.forecasts import bounded
from tidemark.operators.recursive import LinearModel, Series, TreeModel


def frames(symbols=20, days=260, seed=3):
    r = np.random.default_rng(seed)
    out = {}
    for k in range(symbols):
        n = days - 3 * k
        close = (5.0 + 40 * k) * np.exp(np.cumsum(r.normal(0, 0.02, n)))
        spread = close * r.uniform(0.001, 0.03, n)
        dates = [datetime.date(2020, 1, 1) + datetime.timedelta(days=int(i)) for i in range(3 * k, days)]
        out[f"S{k:02d}"] = pd.DataFrame({"Date": dates, "Open": close, "High": close + spread, "Low": close - spread, "Close": close, "Volume": r.integers(0, 900, n).astype(float)})
    return out


def bars_of(spark, data):
    return spark.createDataFrame(pd.concat([f.assign(symbol=s) for s, f in data.items()]), "Date date, Open double, High double, Low double, Close double, Volume double, symbol string")


def newest(frame):
    """All features of a frame's last row, from scratch by pandas."""
    f, c = features._recursive(frame.copy()), frame["Close"]
    out = {n: f[n].iloc[-1] for n in features.RECURSIVE}
    for k in (7, 14, 21, 50):
        out[f"EMA_{k}_rel"] = (c / c.ewm(span=k, adjust=False, min_periods=k).mean() - 1).iloc[-1]
        out[f"SMA_{k}_rel"] = (c / c.rolling(k).mean() - 1).iloc[-1]
    m = c.rolling(200).mean().iloc[-1]
    out["Market_Regime_SMA200"] = 0.0 if np.isnan(m) else 1.0 if c.iloc[-1] > m else -1.0
    out |= {f"STD_{k}_rel": c.rolling(k).std().iloc[-1] / c.iloc[-1] for k in (14, 21)}
    mean, sd = c.rolling(20).mean().iloc[-1], c.rolling(20).std(ddof=0).iloc[-1]
    out |= {"BB_width": 4 * sd / mean, "BB_upper_rel": (mean + 2 * sd) / c.iloc[-1] - 1, "BB_lower_rel": (mean - 2 * sd) / c.iloc[-1] - 1}
    v = frame["Volume"].rolling(20).sum().iloc[-1]
    out["OBV_Norm_20"] = (np.sign(c.diff()).fillna(0) * frame["Volume"]).rolling(20).sum().iloc[-1] / v
    out["VWAP_20_rel"] = c.iloc[-1] / (((frame["High"] + frame["Low"] + c) / 3 * frame["Volume"]).rolling(20).sum().iloc[-1] / v) - 1
    steps = np.log(c / c.shift())
    return out | {"ret": c.iloc[-1] / c.iloc[-2] - 1, "logret": steps.iloc[-1]} | {f"logret_lag_{k}": steps.iloc[-1 - k] for k in range(1, 6)}


ALL = [*averages.FEATURES, *recursive.WINDOWED]


def test_newest_features_of_many_series():
    data = frames()
    series = Series(*([f[c].tolist() for f in data.values()] for c in ("Open", "High", "Low", "Close", "Volume")))
    got = series.features()
    assert set(ALL) == set(got)
    for k, f in enumerate(data.values()):
        want = newest(f)
        for n in ALL:
            assert got[n][k] == pytest.approx(want[n], rel=1e-9, abs=1e-11), (k, n)


def plain_path(spark, frame, model, horizon, extra):
    frame, out = frame.copy(), []
    for h in range(1, horizon + 1):
        now = newest(frame) | extra
        x = np.array([[now[f] for f in model.features]])
        before = frame["Close"].iloc[-1]
        raw = before * np.exp(np.clip(model.predict(x)[0], -1, 1))
        prices = [raw, *(before * np.exp(np.clip(q[0], -1, 1)) for q in model.quantiles(x).values())]
        # the DataFrame form of the bounds
        done = spark.createDataFrame([(float(p), float(before)) for p in prices], "p double, b double").select(bounded(F.col("p"), F.col("b"))).collect()
        out.append((h, raw, *(r[0] for r in done)))
        row = frame.iloc[-1].copy()
        row["Close"] = done[0][0]
        frame = pd.concat([frame, row.to_frame().T], ignore_index=True).astype({c: float for c in ("Open", "High", "Low", "Close", "Volume")})
    return out


def test_recursive_path_equals_a_plain_loop(spark):
    data = frames()
    names = ("EMA_12_rel", "SMA_21_rel", "RSI_14", "MACD_diff", "STD_14_rel", "logret_lag_2", "OBV_Norm_20", "ADX_14", "rate")
    model = LinearModel(names, (-0.4, 0.3, 0.0004, 2.0, -0.5, 0.6, 0.01, -0.0003, 0.5), 0.004, residuals={0.1: -0.03, 0.5: 0.001, 0.9: 0.3})
    bars = bars_of(spark, data).withColumn("rate", F.lit(0.01))
    got = recursive.roll_forward_recursive(bars, model, horizon=4, extra=["rate"]).orderBy("symbol", "horizon").collect()
    assert len(got) == 4 * len(data) and any(r["p90_close"] == r["upper_band"] for r in got)
    for s in ("S00", "S07", "S19"):
        own = [r for r in got if r["symbol"] == s]
        for r, (h, raw, close, p10, p50, p90) in zip(own, plain_path(spark, data[s], model, 4, {"rate": 0.01}), strict=True):
            assert r["horizon"] == h and r["raw_predicted_close"] == pytest.approx(raw, rel=1e-9)
            assert (r["bounded_predicted_close"], r["p10_close"], r["p50_close"], r["p90_close"]) == pytest.approx((close, p10, p50, p90), abs=1e-9)
            assert r["lower_band"] <= r["p10_close"] <= r["bounded_predicted_close"] <= r["p90_close"] <= r["upper_band"]
    short = recursive.roll_forward_recursive(bars.where("symbol = 'S00'").limit(10), model, extra=["rate"])
    assert short.count() == 0 and recursive.roll_forward_recursive(bars.limit(0), model, extra=["rate"]).count() == 0
    with pytest.raises(ValueError, match="rate"):
        recursive.roll_forward_recursive(bars, model)


def test_bounds_alike_in_columns_and_arrays(spark):
    r = np.random.default_rng(1)
    before = np.concatenate([np.round(r.uniform(0.5, 3000, 400), 2), [20.0, 50.0, 19.995, 2500.0, 22.23]])
    price = before * r.uniform(0.8, 1.25, len(before))
    low, high, _ = recursive.price_band(before)
    rows = spark.createDataFrame(list(zip(range(len(before)), price.tolist(), before.tolist(), strict=True)), "k int, p double, b double")
    want = [r[1] for r in rows.select("k", bounded(F.col("p"), F.col("b"))).orderBy("k").collect()]
    assert recursive.bound(price, low, high) == pytest.approx(want, abs=1e-9)
    # hand values: 19.90 rounds to itself, band 17.91 to 21.89, whose tick is 0.02 from 20 on
    assert recursive.price_band(np.array([19.9])) == (pytest.approx([17.91]), pytest.approx([21.88]), pytest.approx([0.01]))


def test_trees_as_arrays_predict_as_spark_does(spark):
    from pyspark.ml.feature import VectorAssembler

    from tidemark.operators.ensembles import estimators

    r = np.random.default_rng(5)
    x = r.normal(size=(400, 3))
    rows = spark.createDataFrame([(*map(float, v), float(np.sin(v[0]) + v[1] * v[2])) for v in x], "a double, b double, c double, target double")
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    for name in ("boosting", "forest"):
        fitted = estimators()[name]().fit(rows)
        want = fitted.transform(rows).select("a", "b", "c", "y_pred").collect()
        got = TreeModel.of(fitted, ["a", "b", "c"]).predict(np.array([[w["a"], w["b"], w["c"]] for w in want]))
        assert got == pytest.approx([w["y_pred"] for w in want], abs=1e-9)


def test_newest_rows_to_targets(spark):
    rows = spark.createDataFrame([("A", 1, 1.0, 2.0), ("A", 2, 3.0, 9.0), ("A", 3, 4.0, None), ("B", 1, None, 1.0), ("C", 7, -50.0, 0.0)], "symbol string, Date int, x double, y double")
    model = LinearModel(("x", "y"), (2.0, -1.0), 0.5, center=(1.0, 1.0), scale=(2.0, 4.0), clip=3.0, residuals={0.1: -1.0})
    got = {r["symbol"]: r for r in recursive.latest_targets(rows, model).collect()}
    assert set(got) == {"A", "C"} and got["A"]["Date"] == 2
    assert got["A"]["target"] == pytest.approx(0.5 + 2 * 1 - 2) and got["A"]["p10_target"] == pytest.approx(-0.5)
    assert got["C"]["target"] == pytest.approx(0.5 + 2 * -3 + 0.25)
    assert got["A"]["target"] == pytest.approx(model.predict(np.array([[3.0, 9.0]]))[0])
    assert [r["sequence"] for r in recursive.latest_features(rows, ["x", "y"], 2).collect()] == [[[1.0, 2.0], [3.0, 9.0]]]
    with pytest.raises(ValueError, match="missing features"):
        recursive.latest_features(rows, ["x", "z"])


def test_appended_bars_get_the_features_of_a_whole_run(spark):
    data = frames(symbols=4, days=320)
    bars = bars_of(spark, data).withColumn("rate", F.lit(2.0))
    day = datetime.date(2020, 11, 10)
    derive = lambda b: features.recursive_features(features.volatility(features.moving_averages(b)))
    derived = [*features.RECURSIVE, "SMA_50_rel", "BB_width", "STD_14_rel"]
    stored = derive(bars.where(F.col("Date") < day)).withColumn("note", F.lit("kept"))
    fresh = bars.where((F.col("Date") >= day) & (F.col("symbol") != "S02"))
    got = recursive.rederive(stored, fresh, derive, derived, 250).toPandas().sort_values(["symbol", "Date"]).reset_index(drop=True)
    want = derive(bars).where((F.col("Date") >= day) & (F.col("symbol") != "S02")).toPandas().sort_values(["symbol", "Date"]).reset_index(drop=True)
    assert len(got) == len(want) > 10 and (got["rate"] == 2.0).all()
    pd.testing.assert_frame_equal(got[derived], want[derived], rtol=1e-6, atol=1e-7)
