"""Macro matrix, pooled studies, scopes, explanations, answers and odd files by hand values and plain loops."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import explain as J
from tidemark.operators import leaderboard as Z
from tidemark.operators import macro as A
from tidemark.operators import studies as G
from tidemark.sources import bars as B

day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def series(spark, name, pairs):
    return spark.createDataFrame([(day(n), v) for n, v in pairs], f"Date date, {name} double")


def test_macro_matrix(spark):
    fx, index = series(spark, "fx", [(k, 10.0 + k) for k in range(0, 40, 2)]), series(spark, "idx", [(k, 100.0) for k in range(1, 40, 2)])
    rate = series(spark, "rate", [(0, 30.0), (31, 40.0)])
    got = A.macro_matrix((fx, index), [series(spark, "vix", [(11, 7.0)])], rate, None, str(day(10)), str(day(35))).orderBy("Date").collect()
    assert [r["Date"] for r in got] == [day(n) for n in range(10, 36)] and "mom" not in got[0].asDict()
    assert got[0]["fx"] == 20.0 and got[1]["fx"] == 20.0 and got[1]["fx_ret"] == 0 and got[2]["fx_ret"] == pytest.approx(0.1) and got[0]["vix"] is None and got[25]["vix"] == 7.0
    # a release is known a day later, and met on that very day only
    by = {r["Date"]: r["rate"] for r in got}
    assert by[day(31)] == 30.0 and by[day(32)] == 40.0 and got[-1]["rate_change"] == 10.0
    assert A.macro_matrix((fx, None), [], None, None, "2024-01-01", "2024-02-01") is None
    both = A.macro_matrix((fx, index), [], rate, series(spark, "cpi", [(0, 100.0), (15, 110.0)]), str(day(0)), str(day(39)))
    last = both.orderBy(F.desc("Date")).first()
    assert last["mom"] == pytest.approx(0.1) and last["yoy"] is None and last["real_rate"] is None


def test_canonical_series_and_ranges(spark):
    raw = spark.createDataFrame([(day(1), None, "2.5", 1), (day(1), "3", "9", 2), (day(2), "x", None, 3), (day(3), "", "4", 4)], "Date date, `XU100.IS` string, XU100 string, seq int")
    got = sorted(tuple(r) for r in A.canonical_series(raw, "BIST", ["BIST", "XU100.IS", "XU100"]).collect())
    assert got == [(day(1), 3.0), (day(3), 4.0)]
    assert [tuple(r) for r in A.canonical_series(spark.createDataFrame([(day(1), 5)], "Date date, anything int"), "VIX", ["^VIX"]).collect()] == [(day(1), 5.0)]
    assert A.in_range(series(spark, "v", [(k, 1.0) for k in range(0, 200)]), str(day(100)), str(day(150)), 90).count() == 141


def test_pooled_fits_by_fold_equal_numpy(spark):
    r = np.random.default_rng(2)
    rows = [(f"S{k % 5}", day(k // 5), fold, "train" if k < 150 else "test", *map(float, r.normal(size=2)), float(r.normal())) for fold in (1, 2) for k in range(200)]
    df = spark.createDataFrame(rows, "symbol string, Date date, fold int, role string, a double, b double, target double")
    got = {(x["fold"], x["symbol"], x["Date"]): x["y_pred"] for x in G.pooled_predictions(df.repartition(4), ["a", "b"], "target").collect()}
    assert len(got) == 100
    for fold in (1, 2):
        own = [x for x in rows if x[2] == fold]
        x, y = (np.array([t[i:j] for t in own if t[3] == "train"]) for i, j in ((4, 6), (6, 7)))
        w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + np.eye(2), (x - x.mean(0)).T @ (y[:, 0] - y.mean()))
        for t in own[150:]:
            assert got[fold, t[0], t[1]] == pytest.approx(y.mean() + (np.array(t[4:6]) - x.mean(0)) @ w)


def test_ic_study_has_three_variants(spark):
    r = np.random.default_rng(4)
    rows = [(f"S{s}", day(k), float(x), float(x + 0.3 * r.normal())) for k in range(60) for s, x in enumerate(r.normal(size=9))]
    panel = spark.createDataFrame(rows, "symbol string, Date date, x double, target double")
    assign = lambda p: p.withColumns({"fold": F.lit(1), "role": F.when(F.col("Date") < day(40), "train").otherwise("test")})
    got = {x["variant"]: x for x in G.ic_study(panel, assign, ["x"], 8).collect()}
    assert set(got) == {"absolute", "rank_target", "rank_target_rank_features"} and all(x["n_days"] == 20 and x["ic_mean"] > 0.8 for x in got.values()) and got["rank_target_rank_features"]["features"] == 3


def test_scopes(spark):
    specs = spark.createDataFrame([("ridge", "linear", "candidate", True, True), ("gru", "deep", "candidate", False, False), ("zero", "naive", "benchmark", False, True), ("lgbm", "tree", "candidate", True, False)], "model string, category string, role string, default_candidate boolean, available boolean")
    names = lambda **o: sorted(r["model"] for r in G.resolve_candidates(specs, **o).collect())
    assert names() == ["lgbm", "ridge"] and names(selected=["gru", "zero", "x"]) == ["gru"] and names(disabled=["ridge"]) == ["lgbm"] and names(require_available=True) == ["ridge"]
    rows = spark.createDataFrame([(m,) for m in ("ridge", "gru", "zero", "Ensemble Inverse RMSE", "Ensemble Equal Weight", "new")], "model string")
    got = {r["model"]: (r["report_group"], r["reportable"], r["family"]) for r in G.scoped(rows, specs, specs.where("model = 'ridge'")).collect()}
    assert got == {"ridge": ("candidate", True, "linear"), "gru": ("comparison", False, "deep"), "zero": ("benchmark", True, "naive"), "Ensemble Inverse RMSE": ("candidate", True, "ensemble"), "Ensemble Equal Weight": ("ensemble", False, "ensemble"), "new": ("comparison", False, "unknown")}
    with pytest.raises(ValueError, match="holdout rows must not be calibrated on: 1 "):
        G.guard_scope(spark.createDataFrame([("A", 1), ("A", 2)], "symbol string, Date int"), spark.createDataFrame([("A", 2), ("B", 1)], "symbol string, Date int"))
    windows = spark.createDataFrame([("A", 3, "m", 60.0, 0.2, 0.1), ("A", 5, "m", 60.0, 0.2, 0.15), ("A", 5, "n", 55.0, 0.9, 0.9), ("A", 8, "m", None, 9.0, None)], "symbol string, window_years int, model string, composite double, net_return double, holdout_net_return double")
    best = G.window_choice(windows).where("chosen").collect()
    assert len(best) == 1 and best[0]["window_years"] == 5 and best[0]["model"] == "m" and best[0]["holdout_gap"] == pytest.approx(0.05)
    plan = spark.createDataFrame([("A", "m", p) for p in ("V0", "V1", "V2")], "symbol string, model string, policy string")
    bad = plan.where("policy = 'V1'").withColumn("error", F.lit("boom"))
    status = lambda **o: [r["status"] for r in G.matrix_status(plan, plan.where("policy = 'V0'"), bad, **o).orderBy("policy").collect()]
    assert status() == ["skipped", "error", "planned"] and status(resume=False) == ["ok", "error", "planned"]


def test_backfill_and_unmatched(spark):
    log = spark.createDataFrame([("A", "r", "m", "wf", 1.0, 2.0), ("A", "r", "n", "wf", 1.0, 2.0)], "symbol string, run_id string, model string, validation_mode string, net double, ratio double")
    reports = spark.createDataFrame([("A", "r", "m", "wf", None, None), ("B", "r", "m", "wf", 5.0, 5.0)], log.schema)
    done, unmatched = G.backfill_metrics(log, reports, ["net", "ratio"], kept=["ratio"])
    assert sorted((r["model"], r["net"], r["ratio"]) for r in done.collect()) == [("m", None, 2.0), ("n", 1.0, 2.0)] and [r["symbol"] for r in unmatched.collect()] == ["B"]


def test_reasons(spark):
    rows = [("S", "m", day(k), d, s, e, 0.02) for k, (d, s, e) in enumerate([("BUY", "entry_ok", 0.1), ("HOLD", "min_hold", 0.1), ("HOLD", "in_position", 0.1), ("HOLD", "in_position", 0.2), ("EXIT", "stop_loss", 0.1), ("EXIT", "weak_signal", 0.1), ("NO_TRADE", "cooldown", 0.1), ("NO_TRADE", "below_threshold", 0.01), ("NO_TRADE", "below_threshold", None)])]
    df = spark.createDataFrame(rows, "symbol string, model string, Date date, decision string, risk_state string, expected_return double, entry_threshold double")
    got = [r["reason"] for r in J.signal_reasons(df).orderBy("Date").collect()]
    assert got[1].startswith("Kept: the shortest") and got[2].startswith("Kept: the forecast") and got[4] == J.LEAVING["stop_loss"] and got[5].startswith("Left: the forecast") and got[6] == J.STAYING_OUT["cooldown"]
    assert got[7] == "Not traded: the forecast 0.010000 does not pass the threshold 0.020000." and got[8].endswith("not enough.")
    top = J.signal_summary(df, 2).orderBy("place").collect()
    assert [(r["feature"], r["days"], round(r["contribution"], 4)) for r in top] == [("Signal_in_position", 2, 0.2222), ("Signal_below_threshold", 2, -0.2222)] and top[0]["reason"].startswith("2 days: Kept")


def test_explanations_by_family(spark):
    preds = spark.createDataFrame([("A", m, day(k), v) for m in ("lin", "tree", "zero") for k, v in ((0, 1.0), (1, -0.5))], "symbol string, model string, Date date, y_pred double")
    families = spark.createDataFrame([("lin", "linear"), ("tree", "trees")], "model string, family string")
    table = spark.createDataFrame([("A", "lin", f, c) for f, c in (("x", 0.1), ("y", -0.7), ("z", 0.3))] + [("A", "zero", "x", 9.0)], "symbol string, model string, feature string, contribution double")
    got = {(r["model"], r["place"]): (r["method"], r["feature"], r["reason"]) for r in J.explain(preds, families, {"linear": table}, 2).collect()}
    assert got == {("lin", 1): ("linear", "y", "y moves the forecast down"), ("lin", 2): ("linear", "z", "z moves the forecast up"), ("tree", 1): ("rule_based", "Model_Summary", "tree expects the price to go down"), ("zero", 1): ("rule_based", "Model_Summary", "zero expects the price to go down")}
    folds = spark.createDataFrame([("A", "m", 1, "x", 0.2), ("A", "m", 2, "x", 0.4), ("A", "m", 1, "y", 0.5)], "symbol string, model string, fold int, feature string, importance double")
    assert [(r["feature"], r["folds"]) for r in J.fold_importance(folds).orderBy("place").collect()] == [("y", 1), ("x", 2)] and J.fold_importance(folds, 1).count() == 1


def test_flags_and_answers(spark):
    symbols = spark.createDataFrame([("A",), ("B",)], "symbol string")
    out = J.quality_flags(symbols, spark.createDataFrame([("A", True)], "symbol string, anomaly boolean"), spark.createDataFrame([("A", False, False), ("B", False, True)], "symbol string, short_history boolean, gap_found boolean"), spark.createDataFrame([("A", "f", 0.1), ("A", "g", 0.3)], "symbol string, feature string, psi double"), F.lit(1.5))
    got = {r["symbol"]: r for r in out.collect()}
    assert got["A"]["psi_high"] and got["A"]["psi_scores"] == {"f": 0.1, "g": 0.3} and got["A"]["corporate_action_anomaly"] and not got["B"]["psi_high"] and got["B"]["survivorship_warning"] and got["B"]["psi_max"] == 0 and got["B"]["clip_rate"] == 1.5

    best = spark.createDataFrame([(s, "m", 56.0, 0.9, 0.6, "ok", "eligible", 70.0) for s in "ABCD"], "symbol string, model string, dir_acc double, rmse_ratio double, stability double, diagnosis string, eligibility string, composite double")
    paths = spark.createDataFrame([(s, 0.02, "UP", 1.0) for s in "ABC"], "symbol string, path_return double, label string, agreement double")
    fresh = spark.createDataFrame([("A", day(1), False), ("B", day(1), False), ("C", day(0), True)], "symbol string, last_date date, stale boolean")
    drift = spark.createDataFrame([("A", 0.01, "stable"), ("B", 0.2, "moderate_drift"), ("D", 0.5, "major_drift")], "symbol string, psi_max double, tier string")
    peers = spark.createDataFrame([("A", "strong", 90.0)], "symbol string, peer_label string, peer_percentile double")
    got = {r["symbol"]: r for r in J.answers(best, paths, fresh, drift, peers, Z.confidence).collect()}
    good = ["direction above 55", "error below the benchmark", "steady folds", "models agree"]
    assert got["A"]["confidence"]["label"] == "high" and got["A"]["confidence"]["reasons"] == good and got["A"]["status"] == "ready" and got["A"]["peer"]["peer_label"] == "strong"
    assert got["B"]["confidence"]["label"] == "medium" and got["B"]["confidence"]["warnings"] == ["data_drift_moderate:psi=0.200"] and got["B"]["peer"]["peer_label"] is None
    assert got["C"]["confidence"]["label"] == "low" and got["C"]["confidence"]["reasons"] == ["stale_data"] and got["C"]["status"] == "stale"
    assert got["D"]["confidence"]["label"] == "low" and got["D"]["confidence"]["warnings"] == ["data_drift_major:psi=0.500"] and got["D"]["status"] == "no_forecast"


def test_odd_reports_and_close_columns(spark, tmp_path):
    for k, text in enumerate(("﻿Model;Net_Return\nm;0,5\n", "Model,Net_Return\nm,0.5\n")):
        (tmp_path / f"{k}.csv").write_text(text)
        got = B.read_report(spark, f"file://{tmp_path}/{k}.csv")
        assert got.columns == ["Model", "Net_Return"] and got.select(Z.number(F.col("Net_Return"))).first()[0] == 0.5
    raw = spark.createDataFrame([("05.02.2024", "x", "1.5"), ("2024-02-06", "2.5", "9"), ("?", "3", "3")], "TARIH string, `Kapanış` string, Adj_Close string")
    assert [tuple(r) for r in B.close_series(raw).collect()] == [(datetime.date(2024, 2, 6), 2.5)]
    with pytest.raises(ValueError, match="no close"):
        B.close_series(raw.drop("Kapanış", "Adj_Close"))


def test_metrics_by_symbol(spark):
    rows = [("A", 1, 0.1, 0.2), ("A", 1, -0.1, 0.2), ("A", 2, 0.3, 0.001), ("A", 2, 0.3, 0.4), ("B", 1, 0.1, 0.0)]
    got = {r["symbol"]: r for r in G.per_symbol_metrics(spark.createDataFrame(rows, "symbol string, fold int, y_true double, y_pred double"), 4, 0.01).collect()}
    a = got["A"]
    assert (a["n_oos"], a["n_folds"], a["base_rate"], a["positive_fold_ratio"], a["reliable"]) == (4, 2, 75.0, 1.0, True)
    assert a["dir_acc"] == pytest.approx(200 / 3) and a["edge"] == pytest.approx(200 / 3 - 75) and got["B"]["dir_acc"] is None and not got["B"]["reliable"]


def test_bootstrap_interval(spark):
    from tidemark.operators.selection import bootstrap_sharpe

    r = np.random.default_rng(0)
    x = r.normal(0.001, 0.01, 500)
    df = spark.createDataFrame([("A", "m", day(k), float(v)) for k, v in enumerate(x)] + [("B", "m", day(k), 0.0) for k in range(5)], "symbol string, model string, Date date, net_return double")
    one, two = ({t["symbol"]: (t["low"], t["high"]) for t in bootstrap_sharpe(d).collect()} for d in (df, df.repartition(3)))
    assert one == two and one["B"] == (0.0, 0.0)
    sharpe = x.mean() / x.std() * 252**0.5
    error = (252 / 500) ** 0.5
    assert one["A"][0] == pytest.approx(sharpe - 1.96 * error, abs=0.25) and one["A"][1] == pytest.approx(sharpe + 1.96 * error, abs=0.25)
