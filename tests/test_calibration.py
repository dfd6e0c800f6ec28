"""The position machine over many settings, grids, and the whole calibration against plain Python."""

import datetime
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration as K
from tidemark.operators import selection as L

ROWS = "symbol string, model string, Date date, y_pred double, ret double, rolling_vol double, regime double, volatility_multiplier double, realized_return double, dir_acc double, rmse_ratio double, composite double, is_benchmark boolean, set string"


def series(seed=1, symbols=("A", "B"), models=("m1", "m2"), bars=120):
    r = np.random.default_rng(seed)
    out = []
    for s, m in itertools.product(symbols, models):
        ret = r.normal(0, 0.02, bars + 1)
        good = 0.6 if s == "A" else -0.4
        for k in range(bars):
            out.append((s, m, datetime.date(2020, 1, 1) + datetime.timedelta(days=k), float(good * ret[k + 1] + r.normal(0, 0.01)), float(ret[k]), float(abs(r.normal(0.02, 0.004))), float(r.integers(-1, 2)), float(r.choice([0.85, 1.0, 1.25])),
                        float(ret[k + 1]), 51.0 if m == "m1" else 47.0, 1.07 if s == "A" else 1.0, 46.0 if m == "m2" else 60.0, False, "calibration" if k < 80 else "evaluation"))
    return out


def plain(spark, frame, c):
    """One series under one setting through the row-at-a-time machine and a plain equity loop."""
    top = frame.iloc[0]
    weak = [top.dir_acc < 48 or top.dir_acc < c["min_dir_acc"], top.rmse_ratio > c["max_rmse_ratio"], top.composite < c["min_composite"]]
    far = [top.dir_acc < 48, top.rmse_ratio >= 1.10, top.composite < 45]
    quality = max([c["multiplier"], *(1.75 if f else 1.25 for w, f in zip(weak, far, strict=True) if w)]) if c["gate"] == "soft" else c["multiplier"]
    names = {k: c[k] for k in ("entry_cost", "exit_cost", "entry_vol", "exit_vol", "min_hold", "max_hold", "take_vol", "stop_vol", "cooldown", "min_entry")}
    rows = spark.createDataFrame(frame)
    thresholds = L.signal_thresholds(rows.drop("volatility_multiplier"), rows.select("symbol", "model", "Date", F.col("volatility_multiplier").alias("multiplier")), quality=float(quality), **names)
    found = L.professional_signals(thresholds, **names).orderBy("Date").toPandas()
    position = found["position"].to_numpy()
    if c["gate"] == "hard" and (top.dir_acc < c["min_dir_acc"] or weak[1] or weak[2]):
        position = position * 0
    equity, peak, fall, net, trades = 1.0, 0.0, 0.0, [], 0
    for k, (p, r) in enumerate(zip(position, found["realized_return"], strict=True)):
        before = position[k - 1] if k else 0
        sides = abs(p - before) + (p if k == len(position) - 1 else 0)
        net.append(p * r - sides * 0.0015)
        trades += p > before
        equity *= 1 + net[-1]
        peak = max(peak, equity)
        fall = min(fall, equity / peak - 1)
    sd = np.std(net)
    return equity - 1, np.prod(1 + found["realized_return"]) - 1, np.mean(net) / sd * 252**0.5 if sd > 0 else 0.0, fall, int(trades)


CONFIGS = {
    1: K.settings(), 2: K.settings(entry_vol=0.1, entry_cost=0.5, max_hold=5, min_hold=2, cooldown=0), 3: K.settings(stop_vol=0.3, take_vol=0.5, min_entry=0.002),
    4: K.settings(gate="hard", min_dir_acc=50.0), 5: K.settings(gate="hard", min_composite=40.0, min_dir_acc=40.0, max_rmse_ratio=1.2), 6: K.settings(gate="off", multiplier=0.6),
}


def test_all_settings_in_one_pass_equal_one_by_one(spark):
    rows = series()
    got = {(r["symbol"], r["model"], r["trial"]): r for r in K.run_settings(spark.createDataFrame(rows, ROWS).repartition(5), CONFIGS).collect()}
    assert len(got) == 4 * len(CONFIGS)
    data = pd.DataFrame(rows, columns=[x.split(" ")[0] for x in ROWS.split(", ")])
    for (s, m), frame in data.groupby(["symbol", "model"]):
        for k, c in CONFIGS.items():
            r = got[s, m, k]
            want = plain(spark, frame, c) if (s, k) in {("A", 1), ("B", 2), ("A", 3), ("B", 4), ("A", 5), ("B", 6)} else None
            if want:
                assert (r["net_return"], r["buyhold_return"], r["sharpe"], r["max_drawdown"], r["trade_count"]) == pytest.approx(want, rel=1e-9, abs=1e-12), (s, m, k)
    assert got["A", "m2", 1]["quality_multiplier"] == 1.75 and got["A", "m1", 1]["quality_multiplier"] == 1.25 and got["A", "m1", 6]["quality_multiplier"] == 0.6
    assert got["B", "m2", 4]["blocked_dir_acc"] == 120 and got["B", "m2", 4]["trade_count"] == 0 and got["A", "m1", 4]["blocked_rmse"] == 120
    assert sum(r["trade_count"] for r in got.values()) > 50


def test_modes_and_settings(spark):
    rows = [("A", "m", datetime.date(2020, 1, d + 1), p, 0.0, 0.01, 0.0, 1.0, r, None, None, None, None, "x") for d, (p, r) in enumerate([(0.0, 0.1), (0.3, 0.1), (-0.1, 0.1), (-0.3, 0.1), (0.1, -0.5)])]
    df = spark.createDataFrame(rows, ROWS)
    got = {r["trial"]: r for r in K.run_settings(df, {"s": K.settings(mode="simple", buy=0.2, sell=0.2), "l": K.settings(mode="legacy"), "r": K.settings(mode="rejected")}).collect()}
    assert got["s"]["net_return"] == pytest.approx((1.1 - 0.0015) * 1.1 * (1 - 0.0015) - 1) and got["s"]["exposure"] == 40
    assert got["l"]["net_return"] == pytest.approx((1.1 - 0.0015) * (1 - 0.0015) * (0.5 - 0.003) - 1) and got["l"]["trade_count"] == 2
    assert got["r"]["net_return"] == 0 and got["r"]["sharpe"] == 0
    assert K.run_settings(df.limit(0), CONFIGS).count() == 0
    for bad in ({"entry_vol": -1}, {"mode": "x"}, {"nothing": 1}, {"min_dir_acc": 101}, {"min_hold": 30}):
        with pytest.raises(ValueError):
            K.settings(**bad)


def test_sampled_grids():
    values = K.grid_values(K.settings(entry_vol=0.4))
    assert values["entry_vol"] == [0.1, 0.15, 0.2, 0.25, 0.3, 0.4] and 52.0 in values["min_dir_acc"]
    widest = max(map(len, values.values()))
    for cap in (widest, 20, 64):
        trials = K.sample_trials(values, cap)
        assert len(trials) == len(set(trials)) == cap and K.coverage(values, trials) == "complete"
        assert trials == K.sample_trials(dict(values), cap) and K.sample_trials(values, cap, seed=1) != trials
    few = K.sample_trials(values, 2)
    assert K.coverage(values, few).startswith("missing:entry_cost=") and K.coverage(values, []).count("=") == 7
    more = K.expansion(values, trials)
    assert len(more) == 64 and not set(more) & set(trials) and K.coverage(values, more) == "complete"
    small = {"a": [1, 2], "b": [1, 2, 3]}
    assert K.sample_trials(small, 99) == sorted(itertools.product([1, 2], [1, 2, 3])) and K.sample_trials(small, 3, exclude=itertools.product([1], [1, 2, 3])) == [(2, 1), (2, 2), (2, 3)]
    assert K.expansion(small, list(itertools.product([1, 2], [1, 2, 3]))) == []
    # greedy: no combination left out adds more new values than the next one taken
    seen = set()
    for taken in K.sample_trials(values, widest):
        gain = len(set(enumerate(taken)) - seen)
        assert gain == max(len(set(enumerate(p)) - seen) for p in itertools.product(*values.values()))
        seen |= set(enumerate(taken))


def test_calibration_chooses_confirms_and_rejects(spark):
    df = spark.createDataFrame(series(seed=3, bars=200), ROWS)
    df = df.withColumn("set", F.when(F.col("Date") < "2020-04-30", "calibration").otherwise("evaluation"))
    values = {"entry_vol": [0.05, 0.4], "entry_cost": [0.2, 3.0], "stop_vol": [0.5, 1.0]}
    report = K.calibrate(df, cap=4, values=values, min_trades=4).toPandas()
    trials = K.sample_trials(values, 4)
    assert K.coverage(values, trials) == "complete" and set(report.grid_size) == {8}
    for s in ("A", "B"):
        own = report[report.symbol == s].sort_values("place")
        assert sorted(own["rank"]) == list(range(1, len(own) + 1)) and (own.executed_trials == len(own)).all()
        assert own.adaptive_expanded.nunique() == 1 and len(own) == (8 if own.adaptive_expanded.iloc[0] else 4)
        # each trial's numbers are the means over the symbol's models
        for row in own.itertuples():
            c = K.settings(entry_vol=row.entry_vol, entry_cost=row.entry_cost, stop_vol=row.stop_vol)
            runs = K.run_settings(df.where((F.col("symbol") == s) & (F.col("set") == "calibration")), {1: c}).toPandas()
            assert row.net == pytest.approx(runs.net_return.mean()) and row.trades == runs.trade_count.sum() and row.enough_trades == (row.trades >= 6)
            break
        good = own[own.enough_trades & (own.excess > 0) & own.oos_passed]
        assert (own.status == ("applied" if len(good) else "rejected_no_valid_oos_trial")).all() and own.active.sum() == (len(good) > 0)
        if len(good):
            assert own[own.active].iloc[0].trial == own.iloc[0].trial
    assert not report[report.symbol == "A"].rejected.any() and report[report.symbol == "B"].rejected.all()
    stage = K.stage_backtests(df.where("set = 'evaluation'"), K.calibrate(df, cap=4, values=values, min_trades=4), "holdout").toPandas()
    assert len(stage) == 4 and (stage.stage == "holdout").all() and set(stage[stage.symbol == "B"].effective_mode) == {"rejected_no_trade"}
    assert (stage[stage.symbol == "B"].trade_count == 0).all() and stage[stage.symbol == "A"].trade_count.sum() > 0
    best = report[(report.symbol == "A") & report.active].iloc[0]
    direct = K.run_settings(df.where("set = 'evaluation' and symbol = 'A'"), {1: K.settings(entry_vol=best.entry_vol, entry_cost=best.entry_cost, stop_vol=best.stop_vol)}).toPandas()
    assert sorted(stage[stage.symbol == "A"].net_return) == pytest.approx(sorted(direct.net_return))


def test_five_hundred_trials(spark):
    values = K.grid_values()
    trials = K.sample_trials(values, 500)
    configs = {k: K.settings(**dict(zip(values, p, strict=True))) for k, p in enumerate(trials, 1)}
    out = K.run_settings(spark.createDataFrame(series(), ROWS), configs)
    assert out.count() == 2000 and out.where("net_return is null or sharpe is null").count() == 0


def test_scenarios_and_policies(spark):
    df = spark.createDataFrame(series(), ROWS).withColumn("sector_strength", F.lit(-1.0))
    shadows = K.shadow_backtests(df).toPandas()
    assert set(shadows.shadow_mode) == {"simple_current", "professional_current", "professional_soft_gate", "legacy_directional"} and len(shadows) == 16
    hard = shadows[shadows.shadow_mode == "professional_current"]
    assert (hard.gate_mode == "hard").all() and (hard.trade_count == 0).all() and (hard.blocked_dir_acc == 120).all()  # 51 and 47 are below 52
    counts = {k: g.sort_values(["symbol", "model"]).trade_count.tolist() for k, g in shadows.groupby("shadow_mode")}
    assert counts["simple_current"] == counts["legacy_directional"] != counts["professional_soft_gate"]  # both thresholds of a switch at 0: the sign
    found = K.policy_backtests(df).toPandas()
    assert set(found.policy) == set(K.POLICIES) and (found[found.policy == "V4"].trade_count == 0).all()  # nothing confirms an entry
    band = found[found.policy == "V3"]
    assert (band.trades_in_band == band.trade_count.between(8, 20)).all() and found[found.policy != "V3"].trades_in_band.isna().all()
    assert K.policy_settings("V3")["max_hold"] == 15 and K.policy_settings("V2")["multiplier"] == 0.85 and K.policy_settings("V0")["mode"] == "simple"
