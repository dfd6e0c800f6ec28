"""Rules with values computed by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import boards as T
from tidemark.operators import metrics as M
from tidemark.operators import runs as R
from tidemark.operators import selection as L
from tidemark.operators import xsection as X


def one(df, column):
    return [r[column] for r in df.collect()]


def test_composite(spark):
    rows = [(0.8, 5.0, 60.0, 55.0, 0.0, 10.0), (1.2, 5.0, 60.0, 55.0, 0.0, 10.0), (0.5, 30.0, 100.0, 100.0, None, 200.0)]
    df = spark.createDataFrame(rows, "rmse_ratio double, dir_acc_gain double, dir_acc double, hit_rate double, sharpe_excess double, neutral_rate double")
    # 0.30 * 100 + 0.25 * 70 + 0.20 * 60 + 0.15 * 55 + 0.10 * 50 - 1.5; capped; 30 + 25 + 20 + 15 + 5 - 15
    assert one(L.composite(df), "composite") == [71.25, 49.0, 80.0]
    lead = df.limit(1).withColumn("can_lead", F.lit(False))
    assert one(L.composite(lead), "composite") == [49.0]


def test_peers_and_tendency(spark):
    rows = [(f"S{k:02d}", "2024-01-02", float(k)) for k in range(20)] + [(f"S{k:02d}", "2024-01-03", float(k)) for k in range(5)]
    df = spark.createDataFrame(rows, "symbol string, d string, y_pred double").withColumn("Date", F.to_date("d"))
    out = {(r["symbol"], str(r["Date"])): r for r in L.trend_tendency(X.peer_scores(df)).collect()}
    top = out["S19", "2024-01-02"]
    assert (top["peer_percentile"], top["peer_score"], top["peer_label"], top["trend_label"], top["trend_prob_up"]) == (97.5, 0.95, "outperform", "up", 0.541)
    low = out["S00", "2024-01-02"]
    assert (low["peer_percentile"], low["peer_label"], low["trend_label"], low["trend_expected_return"]) == (2.5, "underperform", "down", -0.0066)
    thin = out["S04", "2024-01-03"]
    assert (thin["peer_label"], thin["trend_label"], thin["trend_prob_up"]) == ("unknown", "uncertain", None)


def test_peer_confidence(spark):
    rows = [(True, False, 20, "inline", 1.2), (True, False, 20, "inline", 0.5), (True, False, 20, "inline", 0.2), (True, False, 20, "inline", None), (False, True, 20, "inline", 2.0), (True, True, 20, "inline", 2.0), (True, False, 5, "unknown", 2.0)]
    df = spark.createDataFrame(rows, "tradable boolean, stale boolean, universe_size int, peer_label string, icir double").coalesce(1)
    got = [(r["confidence_label"], r["confidence_reasons"], r["confidence_warnings"]) for r in X.peer_confidence(df).collect()]
    assert got == [("high", ["icir_high"], []), ("medium", ["icir_medium"], []), ("low", ["icir_low"], []), ("low", [], ["icir_unknown"]), ("low", [], ["not_tradable"]), ("low", [], ["stale"]), ("low", [], ["thin_universe"])]


def test_regimes(spark):
    def regime(closes):
        rows = [("A", k, float(c)) for k, c in enumerate(closes)]
        df = spark.createDataFrame(rows, "symbol string, k int, Close double").withColumn("Date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")))
        return one(T.regime_context(df).orderBy(F.desc("Date")).limit(1), "regime")[0]

    assert regime(range(100, 400)) == "bull" and regime(range(400, 100, -1)) == "bear"
    assert regime(range(100, 170)) == "bull" and regime(range(100, 140)) == "uncertain"
    assert regime([100.0] * 300) == "sideways"


def test_drawdown_starts_at_the_curve(spark):
    df = spark.createDataFrame([("A", "m", k, e) for k, e in enumerate([0.8, 0.9, 0.45, 0.6])], "symbol string, model string, k int, net_equity double").withColumn("Date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")))
    assert one(M.drawdown(df), "max_drawdown") == [pytest.approx(-0.5)]


def test_deflated_sharpe(spark):
    returns = [0.01, -0.005, 0.02, 0.0, 0.01]
    df = spark.createDataFrame([("A", "m", x) for x in returns] + [("B", "m", 0.1), ("B", "m", 0.2)], "symbol string, model string, net_return double")
    got = {r["symbol"]: r for r in T.deflated_sharpe(df, 10).collect()}
    mean = sum(returns) / 5
    sr = mean / math.sqrt(sum((x - mean) ** 2 for x in returns) / 5) * math.sqrt(252)
    error = math.sqrt((1 + 0.5 * sr * sr) / 5)
    deflated = sr - math.sqrt(2 * math.log(10)) * error
    assert got["A"]["deflated"] == pytest.approx(deflated)
    assert got["A"]["score"] == pytest.approx(100 * 0.5 * (1 + math.erf(deflated / error / math.sqrt(2))))
    assert (got["B"]["deflated"], got["B"]["score"]) == (0.0, 0.0)


def test_diagnosis(spark):
    rows = [(0.1, 0.2, 5, -1.0, True, 9, 0.3, 5, 0.1), (0.2, 0.1, 6, 1.0, False, 5, 0.3, 6, 0.2), (0.1, 0.1, 9, None, False, 0, 0.0, 9, 0.1)]
    df = spark.createDataFrame(rows, "total_return double, buyhold_return double, trade_count int, sharpe double, rejected boolean, alternative_trades int, alternative_net double, current_trades int, current_net double").coalesce(1)
    assert one(T.diagnosis(df), "diagnosis") == ["underperform_buyhold,insufficient_trades,model_signal_weak,rejected_no_trade,gate_too_strict", "ok", "underperform_buyhold"]


def test_trial_scores_and_choice(spark):
    assert one(spark.range(1).select(L.risk_adjusted_score(F.lit(0.2), F.lit(0.1), F.lit(6.0), F.lit(-0.3)).alias("s")), "s") == [pytest.approx(0.07 + 0.025 + 0.25 + 0.105)]
    rows = [(1, 0.5, 0.2, 1.0, -0.1, 60, 0.4, True, True), (2, 0.6, 0.3, 1.0, -0.1, 60, 0.5, True, False), (3, 0.9, 0.9, 1.0, -0.1, 9, 0.9, False, True), (4, 0.0, 0.0, 0.0, 0.0, 0, 0.1, False, False)]
    df = spark.createDataFrame(rows, "trial long, net double, excess double, sharpe double, drawdown double, trades long, score double, enough_trades boolean, oos_passed boolean")
    df = df.withColumns({"eval_excess": F.lit(0.1), "eval_sharpe": F.lit(0.1)})
    got = {r["trial"]: (r["place"], r["choice"]) for r in L.choose_trial(df).collect()}
    assert got == {1: (1, "confirmed"), 2: (2, "enough_trades"), 3: (3, "traded"), 4: (4, "none")}


def test_position_machine(spark):
    """Entry, shortest holding time, profit taking, cooldown, emergency stop: by hand."""
    steps = [(0.05, 0.0), (0.05, 0.01), (0.05, 0.02), (0.05, 0.03), (0.05, 0.0), (0.05, 0.0), (0.05, 0.0), (0.05, -0.2), (-0.9, 0.0)]
    rows = [("A", "m", k, p, r, 0.01, 0.01, 0.002) for k, (p, r) in enumerate(steps)]
    df = spark.createDataFrame(rows, "symbol string, model string, k int, y_pred double, ret double, rolling_vol double, entry_threshold double, exit_threshold double").withColumn("Date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")))
    got = [(r["decision"], r["risk_state"], r["recommendation"]) for r in L.professional_signals(df).orderBy("k").collect()]
    assert got == [
        ("BUY", "entry_ok", "BUY"), ("HOLD", "min_hold", "HOLD"), ("HOLD", "min_hold", "HOLD"), ("EXIT", "take_profit", "SELL"), ("NO_TRADE", "cooldown", "HOLD"), ("NO_TRADE", "cooldown", "HOLD"),
        ("BUY", "entry_ok", "BUY"), ("EXIT", "stop_loss", "SELL"), ("NO_TRADE", "cooldown", "SELL"),
    ]


def test_gates(spark):
    df = spark.createDataFrame([(60.0, 1.0, 60.0, False), (51.0, 1.07, 60.0, False), (47.0, 1.2, 44.0, True)], "dir_acc double, rmse_ratio double, composite double, is_benchmark boolean").coalesce(1)
    assert one(B.soft_gate(df), "threshold_multiplier") == [1.0, 1.25, 1.75]
    assert one(B.quality_block(df), "block_reason") == [None, "quality_dir_acc", "benchmark_only"]


def test_pruned_columns(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k + 1, float((k * 7919) % 13), float(-k)) for k in range(60)], "a double, b double, c double, d double")
    # a, b and d are one another up to sign: all have the same mean correlation up to rounding, so one of them stays, beside c
    kept = L.prune_correlated(df, ["a", "b", "c", "d"], 0.95)
    assert len(kept) == 2 and "c" in kept and kept[0] != "c"
