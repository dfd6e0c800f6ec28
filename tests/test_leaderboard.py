"""Rules of leaderboards, confidence, sectors, histories and forecasts of members by hand values."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import leaderboard as Z
from tidemark.operators import runs as R


def test_reliability_classes_and_ranks(spark):
    rows = [
        # model, wf, final, hold, trades, sharpe, missing -> class
        ("stable", "0,12", "0,10", "0,04", "9", "1,1", "", "stable"),
        ("lost", 0.2, -0.01, 0.0, 12, -0.1, "", "unstable"),
        ("gap", 0.5, 0.25, 0.3, 30, 0.5, "", "unstable"),
        ("near_gap", 0.49, 0.25, 0.3, 30, 0.5, "", "research_candidate"),
        ("defends", 0.01, 0.02, 0.1, 8, 0.3, "", "defensive"),
        ("clone", 0.2, 0.1005, 0.1, 1, 1.0, "", "invalid"),
        ("one_trade", 0.2, 0.5, 0.1, 1, 1.0, "", "invalid"),
        ("no_trades", 0.2, 0.5, 0.1, None, 1.0, "", "invalid"),
        ("many", 0.2, 0.3, 0.1, 21, 1.0, "", "research_candidate"),
        ("bad_before", -0.2, 0.3, 0.1, 20, 1.0, "", "research_candidate"),
        ("lacks", 0.2, 0.3, 0.1, 20, 1.0, "run_manifest.json", "incomplete"),
        ("text", "x", 0.3, 0.1, 20, 1.0, None, "research_candidate"),
    ]
    text = [tuple(None if v is None else str(v) for v in r[:-2]) + (r[-2],) for r in rows]
    df = spark.createDataFrame([("S", "r1", *r) for r in text], "symbol string, run_id string, model string, wf_net string, final_net string, final_buyhold string, final_trades string, final_sharpe string, missing string")
    got = {r["model"]: r for r in Z.run_rows(df).collect()}
    assert {m: r["reliability"] for m, r in got.items()} == {r[0]: r[-1] for r in rows}
    assert got["stable"]["gap"] == pytest.approx(0.02) and got["stable"]["excess"] == pytest.approx(0.06) and got["clone"]["benchmark_clone"] and not got["one_trade"]["benchmark_clone"]
    assert got["lacks"]["prediction_rank"] is None and got["gap"]["prediction_rank"] == 1 and got["text"]["prediction_rank"] == 11 and got["lost"]["prediction_rank"] == 3
    # by excess, then by the net return
    assert [got[m]["trading_rank"] for m in ("one_trade", "no_trades", "many", "bad_before", "text", "stable", "clone")] == [1, 1, 3, 3, 3, 6, 7]

    out = Z.run_rows(df.withColumn("model", F.when(F.col("model") == "many", "Ensemble Equal").when(F.col("model") == "gap", "GRU v2").otherwise("GRU"))).withColumns({"sector": F.when(F.col("reliability") == "invalid", "bank"), "history_bucket": F.lit("mid_history")})
    by = {r["sector"]: r for r in Z.class_summary(out, "sector").collect()}
    assert by["bank"]["invalid_count"] == by["bank"]["run_rows"] == 3 and by["bank"]["incomplete_invalid_rate"] == 1 and by["bank"]["repeated_families"] == "GRU:3"
    assert by["unknown"]["run_rows"] == 9 and by["unknown"]["incomplete_invalid_rate"] == pytest.approx(0.111111) and by["unknown"]["repeated_families"] == "GRU:8" and by["unknown"]["history_buckets"] == "mid_history:9"
    history = Z.class_summary(out, "history_bucket").collect()[0]
    assert history["families"] == "Ensemble:1|GRU:11" and history["top_family"] == "GRU" and history["symbols"] == 1
    report = Z.decision_report(out)
    assert "- Run rows: 12" in report and "First ranked complete row: S / GRU / invalid / mid_history." in report and "- Incomplete or invalid rows: 4" in report
    assert "No run-level rows" in Z.decision_report(out.limit(0))


def test_history_and_universe(spark):
    day = datetime.date
    bars = spark.createDataFrame([("AAA", day(2010, 1, 1)), ("AAA", day(2020, 6, 1)), ("BBB", day(2015, 1, 1)), ("BBB", day(2020, 6, 1)), ("CCC", day(2019, 1, 1))], "symbol string, Date date")
    universe = spark.createDataFrame([(" aaa", "Bank", "XBANK"), ("BBB", " ", "XUSIN"), ("CCC", None, None), ("DDD", "x", None)], "symbol string, sector string, sector_index string")
    got = {r["symbol"]: r for r in Z.universe_check(bars, universe).collect()}
    assert [got[s]["history_bucket"] for s in ("AAA", "BBB", "CCC", "DDD")] == ["long_history", "mid_history", "short_history", "missing_data"]
    assert got["AAA"]["long_enough"] and got["BBB"]["sector"] == "XUSIN" and got["CCC"]["sector"] is None and not got["DDD"]["present"]
    assert got["AAA"]["history_years"] == 10.4148 and got["AAA"]["data_history_warning"] == "" and got["DDD"]["data_history_warning"].startswith("CSV missing")
    assert spark.range(1).select(Z.history_bucket(F.lit(None).cast("double"), looked=False)).first()[0] == "unknown"


def test_sector_lookup(spark):
    symbols = spark.createDataFrame([("akb.is",), ("THY",), ("ZZZ",), (None,)], "symbol string")
    universe = spark.createDataFrame([("AKB", "Bank", "xbank.is"), ("THY.IS", "Air", "XAIR"), ("AKB", "Bank", "XZZZ")], "symbol string, sector string, sector_index string")
    got = {r["symbol"]: tuple(r)[1:] for r in Z.sector_mapping(symbols, universe, ["XBANK", "XUSIN"], "MARKET").collect()}
    assert got == {
        "AKB": ("Bank", "XBANK", "matched", "matched_universe_sector_index", "XBANK_Return"), "THY": ("Air", "MARKET", "fallback", "missing_or_unsupported_sector_index", "MARKET_Return"),
        "ZZZ": (None, "MARKET", "fallback", "symbol_not_found", "MARKET_Return"), "": (None, "MARKET", "fallback", "symbol_not_found", "MARKET_Return"),
    }


def test_confidence(spark):
    base = {"eligibility": "eligible", "stale": False, "dir_acc": 56.0, "rmse_ratio": 0.9, "psi_high": False, "corporate_action": False, "degraded": False, "diagnosis": "ok", "stability": 0.6, "rolling_ratio": 0.8, "agreement": 1.0, "regime_misaligned": False}
    cases = [
        ({}, "high", None, []), ({"stability": None, "rmse_ratio": None, "agreement": None, "rolling_ratio": None}, "high", None, []), ({"dir_acc": None}, "medium", None, []),
        ({"dir_acc": 54.9}, "medium", None, []), ({"rmse_ratio": 1.0}, "low", "rmse_ratio", []), ({"dir_acc": 49.9, "rmse_ratio": 2.0, "stale": True}, "low", "stale_data", []),
        ({"eligibility": "low_trades", "stale": True}, "low", "eligibility", []), ({"psi_high": True, "degraded": True}, "low", "psi", []), ({"corporate_action": True}, "low", "corporate_action", []), ({"degraded": True, "stability": -1.0}, "low", "degraded", []),
        ({"diagnosis": "ok, model_signal_weak,gate_too_strict"}, "medium", None, ["diagnosis: gate_too_strict, model_signal_weak"]), ({"stability": -0.2, "agreement": 0.4}, "medium", None, ["stability", "agreement"]),
        ({"stability": 0.2}, "medium", None, []), ({"agreement": 0.7}, "medium", None, []), ({"rolling_ratio": 0.4, "regime_misaligned": True}, "medium", None, ["rolling_ratio", "regime"]),
    ]
    kinds = ", ".join(f"{k} {'string' if k in ('eligibility', 'diagnosis') else 'boolean' if isinstance(v, bool) else 'double'}" for k, v in base.items())
    df = spark.createDataFrame([(k, *(base | change).values()) for k, (change, *_) in enumerate(cases)], "k int, " + kinds)
    got = {r["k"]: (r["confidence"], r["block"], r["soft_reasons"]) for r in Z.confidence(df).collect()}
    assert got == {k: tuple(want) for k, (_, *want) in enumerate(cases)}


def test_newest_runs_by_time(spark):
    day = lambda n: datetime.date(2024, 1, n)
    rows = [("A", "r9", "m", day(1), 90.0, 60.0, 1.0, 0.5), ("A", "r1", "m", day(5), 50.0, 50.0, 0.0, -0.5), ("A", "r2", "m", day(4), 70.0, 54.0, 2.0, 0.0), ("A", "r2", "n", day(4), None, None, None, None), ("A", None, "m", day(9), 1.0, 1.0, 1.0, 1.0)]
    got = Z.newest_runs(spark.createDataFrame(rows, "symbol string, run_id string, model string, trained_at date, composite double, dir_acc double, sharpe double, stability double"), 2).orderBy("place").collect()
    assert tuple(got[0])[1:] == ("m", 2, 60.0, 52.0, 1.0, -0.25, -0.5, 1, 1) and got[1]["model"] == "n" and got[1]["run_count"] == 1


def test_signal_sets(spark):
    def sets(n):
        rows = Z.signal_sets(spark.createDataFrame([(k,) for k in range(n)] * 2 + [(None,)], "fold int")).orderBy("fold").collect()
        return "".join(r["set"][0] for r in rows), {r["status"] for r in rows}

    assert sets(3) == ("eee", {"skipped_insufficient_folds"}) and sets(4) == ("ceee", {"applied"}) and sets(5) == ("cceee", {"applied"}) and sets(12) == ("c" * 8 + "e" * 4, {"applied"})


def test_combined_members_average_bounded_closes(spark):
    rows = [("A", "x", h, 100.0, c, r) for h, c, r in ((1, 104.0, 0.04), (2, 106.0, 0.02), (3, 108.0, 0.02))] + [("A", "y", h, 100.0, c, r) for h, c, r in ((1, 102.0, 0.02), (2, 98.0, -0.04))] + [("A", "z", h, 100.0, 90.0, -0.1) for h in (1, 2, 3)]
    points = spark.createDataFrame(rows, "symbol string, model string, horizon int, last_close double, bounded_close double, predicted_return double")
    weights = spark.createDataFrame([("x", 0.75), ("y", 0.25), ("z", -3.0)], "model string, weight double")
    take = lambda **o: [(r["horizon"], r["raw_close"], r["pred_close"]) for r in R.combine_members(points, o.pop("w", weights), **o).orderBy("horizon").collect()]
    # as long as the shortest; 103.5 and 104 on ticks of 0.1
    assert take() == [(1, pytest.approx(103.5), pytest.approx(103.5)), (2, pytest.approx(104.0), pytest.approx(104.0))]
    # two of three agree: over 0.6; at 0.7 the close before stands
    assert take(gated=True) == take() and take(gated=True, least_agreement=0.7) == [(1, 100.0, 100.0), (2, 100.0, 100.0)]
    none = spark.createDataFrame([("x", -1.0)], "model string, weight double")
    assert take(w=none)[0] == (1, pytest.approx(296 / 3), pytest.approx(98.65))  # equal weights; below 100 a tick is 0.05


def test_realized_volatility_and_threshold(spark):
    import numpy as np

    closes = [100 * 1.01 ** (k * k % 7) for k in range(30)]
    rows = [("A", datetime.date(2024, 1, 1) + datetime.timedelta(days=k), c) for k, c in enumerate(closes)] + [("B", datetime.date(2024, 1, 1) + datetime.timedelta(days=k), c) for k, c in enumerate(closes[:20])]
    got = {r["symbol"]: r["vol20"] for r in R.realized_volatility(spark.createDataFrame(rows, "symbol string, Date date, Close double")).collect()}
    assert got["A"] == pytest.approx(np.diff(np.log(closes))[-20:].std()) and got["B"] == 0


def test_live_accuracy_marks_the_newest_run(spark):
    day = lambda n: datetime.date(2024, 3, n)
    runs = spark.createDataFrame([("A", 1, day(1)), ("A", 2, day(9)), ("B", 3, day(1)), ("C", 4, day(1))], "symbol string, run int, run_at date")
    resolved = spark.createDataFrame([("A", day(2), True, 1.0), ("A", day(10), False, 2.0), ("A", day(11), False, 4.0), ("B", day(10), True, 1.0), ("B", day(11), False, 1.0)], "symbol string, resolved_at date, direction_correct boolean, abs_error double")
    got = R.rolling_accuracy(runs, resolved, F.lit("2024-03-20").cast("date"), 12)
    assert {r["symbol"]: (r["n"], r["dir_acc"], r["mae"], r["status"]) for r in got.collect()} == {"A": (2, 0.0, 3.0, "degraded"), "B": (2, 50.0, 1.0, "healthy"), "C": (0, None, None, "healthy")}
    assert {(r["symbol"], r["run"]): r["live_status"] for r in R.mark_degraded(runs, got).collect()} == {("A", 1): "healthy", ("A", 2): "degraded", ("B", 3): "healthy", ("C", 4): "healthy"}


def test_clip_report_is_one_rate(spark):
    rows = [("train", datetime.date(2020, 1, k + 1), 5.0 if k == 0 else 0.1, None if k == 1 else 0.2) for k in range(5)] + [("test", datetime.date(2020, 2, 1), -5.0, 0.0)]
    r = R.clip_report(spark.createDataFrame(rows, "role string, Date date, a_z double, b_z double"), ["a", "b"]).first()
    assert r["train_clip_rate_pct"] == pytest.approx(100 / 9) and r["test_clip_rate_pct"] == 50 and r["warning"].endswith("(50.000% vs 11.111%).") and str(r["scaler_fit_end"]) == "2020-01-05"
