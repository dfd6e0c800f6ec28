"""Queries over model choice, grids, scaling and attributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import metrics as M
from tidemark.operators import selection as L
from tidemark.operators import splits as S
from tidemark.operators import studies as G
from tidemark.operators import xsection as X
from tidemark.plans.backtests import FORECAST, TRADES, curve, trade_log
from tidemark.plans.common import MODELS, PANEL, model_rows, panel, rounded

COLUMNS = ["liq_log", "vol", "ret"]


def scored(s, d, *more):
    """Metrics of each symbol and model (and fold) with what the composite needs; momentum is the benchmark."""
    keys = ["symbol", *more]
    rows = model_rows(s, d).withColumn("fold", F.year("Date"))
    m = M.forecast_metrics(rows, "symbol", "model", *more)
    base = m.where("model = 'momentum'").select(*keys, F.col("rmse").alias("base_rmse"), F.col("dir_acc").alias("base_dir_acc"))
    out = m.join(base, keys)
    return L.composite(out.withColumns({
        "rmse_ratio": F.col("rmse") / F.col("base_rmse"), "dir_acc_gain": F.col("dir_acc") - F.col("base_dir_acc"), "sharpe_excess": F.col("sharpe") - F.col("buyhold_sharpe"),
    }))


def experiments(s, d):
    """One logged row a symbol, model and year, at its last date."""
    log = trade_log(s, d).groupBy("symbol", "model", F.year("entry_date").alias("fold")).agg(F.count(F.lit(1)).alias("trade_count"))
    at = model_rows(s, d).groupBy("symbol", "model", F.year("Date").alias("fold")).agg(F.max("Date").alias("trained_at"))
    keys = ["symbol", "model", "fold"]
    out = scored(s, d, "fold").join(log, keys, "left").join(at, keys).fillna(0, ["trade_count"]).withColumn("is_candidate", F.col("model") != "momentum")
    return L.eligibility(out).withColumn("id", F.col("fold"))


SPLIT = "1999-01-01"


def trial_grid(s):
    return L.grid(s, {"buy": [0.02, 0.05, 0.1], "sell": [0.02, 0.05]})


def trials(s, d):
    full = trial_grid(s)
    rows = model_rows(s, d)
    found = L.summarize_trials(L.trial_runs(rows.where(F.col("Date") < SPLIT), full), 50)
    later = L.confirm_trials(L.summarize_trials(L.trial_runs(rows.where(F.col("Date") >= SPLIT), full), 50), 50)
    return L.choose_trial(found.join(later, "trial")).join(full, "trial")


def shown(columns):
    return lambda s, d: rounded(trials(s, d).select("buy", "sell", *columns))


def signals(s, d):
    """The position machine over the market's regime of the day (close of all bars against its 200-day mean)."""
    risk = B.rolling_risk(model_rows(s, d))
    w = Window.partitionBy(F.lit(0)).orderBy("Date").rowsBetween(-199, 0)
    market = model_rows(s, d).where("model = 'reversal'").groupBy("Date").agg(F.avg("Close").alias("m"))  # a row a day
    regime = market.select("Date", F.when(F.count("m").over(w) >= 200, F.signum(F.col("m") - F.avg("m").over(w))).otherwise(0.0).alias("regime"))
    rows = L.signal_thresholds(risk.join(regime, "Date"), L.expanding_volatility_multiplier(risk))
    return rounded(L.professional_signals(rows).drop("ret", "rolling_vol", "Close", "realized_return", "y_true"))


def scaled(s, d):
    rows = panel(s, d).withColumn("role", F.when(F.col("Date") < "1999-01-01", "train").otherwise("test"))
    return L.scale(rows, COLUMNS, "robust").groupBy("role").agg(*[F.avg(F.abs(f"{c}_z")).alias(f"{c}_size") for c in COLUMNS], *[F.avg((F.abs(f"{c}_z") >= 5).cast("double")).alias(f"{c}_clipped") for c in COLUMNS])


def oos(s, d):
    """Ridge on the pooled panel by purged walk-forward, then the daily rank correlation of its predictions."""
    p = X.cross_sectional_features(panel(s, d), COLUMNS, ("rank",))
    folded = S.assign_pooled(p, S.pooled_folds(p, folds=5))
    found = G.pooled_predictions(folded, [f"{c}_csr" for c in COLUMNS], "target").withColumn("y_true", F.col("target"))
    return X.ic_summary(X.daily_rank_ic(found, 8))


def contributions_rows(s, d):
    return L.linear_contributions(panel(s, d).where("vol is not null and ret is not null"), {"liq_log": 0.5, "vol": -2.0, "ret": 1.0})


def contributions(s, d):
    return L.top_features(contributions_rows(s, d), 3)


CLIP = "greatest(0.0, least(100.0, {}))"


def scored_sql(more: str = "") -> str:
    """CTEs up to c: the score of each symbol and model (and fold)."""
    by = f"symbol{', ' + more if more else ''}"
    return f"""WITH {MODELS}, f AS (SELECT *, CAST(year(dt) AS INT) AS fold FROM models), m AS (SELECT {by}, model, {FORECAST}, max(dt) AS trained_at FROM f GROUP BY {by}, model),
b AS (SELECT {by}, rmse AS base_rmse, dir_acc AS base_dir FROM m WHERE model = 'momentum'), j AS (SELECT m.*, rmse / base_rmse AS rr, dir_acc - base_dir AS gain FROM m JOIN b USING ({by})),
t AS (SELECT *, 0.30 * least(100.0, 100 / greatest(coalesce(rr, 1), 1e-8)) + 0.25 * {CLIP.format('50 + 4 * gain')} + 0.20 * {CLIP.format('dir_acc')} + 0.15 * {CLIP.format('hit_rate')}
  + 0.10 * coalesce((tanh((sharpe - buyhold_sharpe) / 1.5) + 1) * 50, 50) - least(15, 0.15 * neutral_rate) AS total FROM j),
c AS (SELECT *, round(greatest(0, CASE WHEN greatest(coalesce(rr, 1), 1e-8) > 1 THEN least(total, 49.0) ELSE total END), 4) AS composite FROM t)"""


SCORED = scored_sql()
BEST = f"""{scored_sql('fold')}, {TRADES.removeprefix(MODELS).lstrip(', ')}, tc AS (SELECT symbol, model, CAST(year(entry_date) AS INT) AS fold, count(*) AS trade_count FROM log GROUP BY 1, 2, 3),
x AS (SELECT c.*, CASE WHEN model = 'momentum' THEN 'not_candidate' WHEN rr > 1 THEN 'benchmark_failed' WHEN coalesce(trade_count, 0) < 8 THEN 'low_trades' ELSE 'eligible' END AS reason FROM c LEFT JOIN tc USING (symbol, model, fold)),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY reason = 'eligible' DESC, composite DESC NULLS LAST, trained_at DESC, fold DESC) AS k FROM x)
SELECT symbol, model, fold, reason = 'eligible' AS eligible, reason, composite, CAST(trained_at AS VARCHAR) AS trained_at FROM k WHERE k = 1"""


def runs_sql(name: str, when: str) -> str:
    """CTEs that end in one row a trial: means over its series."""
    p = "PARTITION BY buy, sell, symbol, model ORDER BY dt"
    prod = lambda x, w: f"CASE WHEN min(1 + {x}) {w} <= 0 THEN 0 ELSE exp(sum(ln(CASE WHEN 1 + {x} > 0 THEN 1 + {x} END)) {w}) END"
    w = f"OVER ({p} ROWS UNBOUNDED PRECEDING)"
    return f"""{name}0 AS (SELECT models.*, buy, sell, CASE WHEN y_pred > buy THEN 1 WHEN y_pred < -sell THEN 0 END AS mk FROM models, grid WHERE {when}),
{name}1 AS (SELECT *, coalesce(last_value(mk IGNORE NULLS) {w}, 0) AS pos FROM {name}0),
{name}2 AS (SELECT *, pos - coalesce(lag(pos) OVER ({p}), 0) AS step, CASE WHEN lead(dt) OVER ({p}) IS NULL THEN pos ELSE 0 END AS closing FROM {name}1),
{name}3 AS (SELECT *, pos * rr - (abs(step) + closing) * 15 / 1e4 AS net FROM {name}2), {name}4 AS (SELECT *, {prod('net', w)} AS eq FROM {name}3),
{name}5 AS (SELECT *, eq / greatest(max(eq) {w}, 1e-12) - 1 AS fall FROM {name}4),
{name}6 AS (SELECT buy, sell, symbol, model, arg_max(eq, dt) - 1 AS net, {prod('rr', '')} - 1 AS hold, coalesce(avg(net) / nullif(stddev_pop(net), 0) * sqrt(252), 0) AS sharpe, min(fall) AS drawdown, sum(greatest(step, 0)) AS trades FROM {name}5 GROUP BY 1, 2, 3, 4),
{name} AS (SELECT buy, sell, count(*) AS series, avg(net) AS net, avg(hold) AS hold, avg(net - hold) AS excess, avg(drawdown) AS drawdown, avg(sharpe) AS sharpe, CAST(sum(trades) AS BIGINT) AS trades, count(CASE WHEN net > hold THEN 1 END) AS beats_hold FROM {name}6 GROUP BY 1, 2)"""


TRIALS = f"""WITH {MODELS}, grid AS (SELECT * FROM (SELECT unnest([0.02, 0.05, 0.1])::DOUBLE AS buy) CROSS JOIN (SELECT unnest([0.02, 0.05])::DOUBLE AS sell)), {runs_sql('cal', f"dt < DATE '{SPLIT}'")}, {runs_sql('ev', f"dt >= DATE '{SPLIT}'")},
s1 AS (SELECT cal.*, 0.35 * cal.net + 0.25 * cal.excess + 0.25 * greatest(-1, least(1, cal.sharpe / 3)) + 0.15 * (1 + cal.drawdown) AS score, cal.trades >= 50 AS enough_trades, ev.excess AS eval_excess, ev.sharpe AS eval_sharpe, ev.trades AS eval_trades,
  concat_ws(',', CASE WHEN ev.excess <= 0 THEN 'eval_excess_return_below_min' END, CASE WHEN ev.sharpe <= 0 THEN 'eval_sharpe_below_min' END, CASE WHEN ev.trades < 50 THEN 'eval_trade_count_below_min' END) AS reject_reason FROM cal JOIN ev USING (buy, sell)),
s2 AS (SELECT *, reject_reason = '' AS oos_passed, CASE WHEN enough_trades AND excess > 0 AND reject_reason = '' THEN 0 WHEN enough_trades THEN 1 WHEN trades > 0 THEN 2 ELSE 3 END AS t FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY t, CASE WHEN t = 2 THEN trades END DESC NULLS LAST, score DESC, CASE WHEN t = 0 THEN eval_excess END DESC NULLS LAST, CASE WHEN t = 0 THEN eval_sharpe END DESC NULLS LAST, excess DESC, net DESC) AS place,
  ['confirmed', 'enough_trades', 'traded', 'none'][t + 1] AS choice FROM s2)"""

PLANS = {
    "e15_composite": (lambda s, d: rounded(scored(s, d).select("symbol", "model", "rmse_ratio", "composite")), f"{SCORED} SELECT symbol, model, round(rr, 6) AS rmse_ratio, round(composite, 6) AS composite FROM c"),
    "e26_leaderboard": (lambda s, d: rounded(L.leaderboard(scored(s, d), 10).select("symbol", "model", "composite")), f"{SCORED} SELECT symbol, model, round(composite, 6) AS composite FROM c ORDER BY composite DESC NULLS LAST, symbol, model LIMIT 10"),
    "e30_best_models": (lambda s, d: rounded(L.best_models(experiments(s, d)).select("symbol", "model", "fold", "eligible", "reason", "composite", F.col("trained_at").cast("string").alias("trained_at"))), BEST),
    "h5_professional_signals": (signals, None),
    "h8_volatility_multiplier": (
        lambda s, d: L.expanding_volatility_multiplier(B.rolling_risk(model_rows(s, d))),
        f"""WITH {MODELS}, v AS (SELECT symbol, model, dt, coalesce(nullif(stddev_samp(ret) OVER (PARTITION BY symbol, model ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0), 1e-6) AS v FROM models),
        q AS (SELECT *, count(*) OVER w AS n, quantile_cont(v, 0.33) OVER w AS lo, quantile_cont(v, 0.67) OVER w AS hi FROM v WINDOW w AS (PARTITION BY symbol, model ORDER BY dt ROWS UNBOUNDED PRECEDING))
        SELECT symbol, model, dt AS "Date", CASE WHEN n < 10 THEN 1.0 WHEN v <= lo THEN 0.85 WHEN v >= hi THEN 1.25 ELSE 1.0 END::DOUBLE AS multiplier FROM q""",
    ),
    "h24_grid_trials": (
        shown(["series", "net", "hold", "excess", "drawdown", "sharpe", "trades", "beats_hold", "score"]),
        f"""{TRIALS} SELECT buy, sell, series, round(net, 6) AS net, round(hold, 6) AS hold, round(excess, 6) AS excess, round(drawdown, 6) AS drawdown, round(sharpe, 6) AS sharpe, trades, beats_hold, round(score, 6) AS score FROM s3""",
    ),
    "h26_confirmation": (
        shown(["eval_excess", "eval_sharpe", "eval_trades", "reject_reason", "oos_passed"]),
        f"{TRIALS} SELECT buy, sell, round(eval_excess, 6) AS eval_excess, round(eval_sharpe, 6) AS eval_sharpe, eval_trades, reject_reason, oos_passed FROM s3",
    ),
    "h27_choice": (shown(["choice", "place"]), f"{TRIALS} SELECT buy, sell, choice, CAST(place AS INT) AS place FROM s3"),
    "h25_expansion": (
        lambda s, d: L.should_expand(trials(s, d), complete=True),
        f"""{TRIALS}, b AS (SELECT enough_trades AS e, excess AS x, sharpe AS h FROM s3 WHERE place = 1), a AS (SELECT count(*) AS n, count(CASE WHEN enough_trades THEN 1 END) AS valid FROM s3)
        SELECT n, valid, NOT e OR x <= 0 OR h <= 0 OR valid < greatest(1, ceil(n * 0.15)) AS expand FROM a, b""",
    ),
    "h28_quality_thresholds": (
        lambda s, d: L.quality_thresholds(scored(s, d, "fold").where("model <> 'momentum'")),
        f"""{scored_sql('fold')}, q AS (SELECT count(*) AS n, quantile_cont(dir_acc, 0.25) AS d, quantile_cont(rr, 0.75) AS r, quantile_cont(composite, 0.25) AS k FROM c WHERE model <> 'momentum')
        SELECT n AS fold_rows, round(CASE WHEN n >= 3 THEN greatest(52.0, d) ELSE 52.0 END, 2) AS min_dir_acc, round(CASE WHEN n >= 3 THEN least(1.05, r) ELSE 1.05 END, 4) AS max_rmse_ratio,
          round(CASE WHEN n >= 3 THEN greatest(30.0, k) ELSE 50.0 END, 4) AS min_composite, CASE WHEN n >= 3 THEN 'applied' ELSE 'skipped_insufficient_calibration_folds' END AS status FROM q""",
    ),
    "e29_eligibility": (
        lambda s, d: experiments(s, d).select("symbol", "model", "fold", "reason", "eligible"),
        BEST[: BEST.rindex("k AS (SELECT")].rstrip().rstrip(",") + " SELECT symbol, model, fold, reason, reason = 'eligible' AS eligible FROM x",
    ),
    "c26_codes": (
        lambda s, d: L.codes(panel(s, d).select("symbol", "Date", "sector"), "symbol", "symbol_id").groupBy("symbol", "symbol_id").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {PANEL}, k AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS symbol_id FROM (SELECT DISTINCT symbol FROM panel)) SELECT symbol, symbol_id, count(*) AS n FROM panel JOIN k USING (symbol) GROUP BY 1, 2",
    ),
    "c30_scaling": (
        lambda s, d: rounded(scaled(s, d)),
        f"""WITH {PANEL}, t AS (SELECT *, CASE WHEN dt < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS role FROM panel), q AS (SELECT """
        + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_i" for c in COLUMNS)
        + " FROM t WHERE role = 'train'), z AS (SELECT role, "
        + ", ".join(f"greatest(-5, CASE WHEN {c} IS NOT NULL THEN least(5, ({c} - {c}_m) / CASE WHEN {c}_i > 0 THEN {c}_i ELSE 1 END) END) AS {c}_0, {c} AS {c}_raw" for c in COLUMNS)
        + " FROM t, q) SELECT role, "
        + ", ".join(f"round(avg(abs(CASE WHEN {c}_raw IS NOT NULL THEN {c}_0 END)), 6) AS {c}_size, round(avg(CASE WHEN {c}_raw IS NOT NULL THEN CASE WHEN abs({c}_0) >= 5 THEN 1.0 ELSE 0 END END), 6) AS {c}_clipped" for c in COLUMNS)
        + " FROM z GROUP BY role",
    ),
    "g8_out_of_sample": (lambda s, d: rounded(oos(s, d)), None),
    "g11_bootstrap_sharpe": (lambda s, d: rounded(L.bootstrap_sharpe(curve(s, d).select("symbol", "model", "Date", "net_return"))), None),
    "j19_top_features": (
        lambda s, d: rounded(contributions(s, d).drop("direction")),
        f"""WITH {PANEL}, p AS (SELECT * FROM panel WHERE vol IS NOT NULL AND ret IS NOT NULL), a AS (SELECT avg(liq_log) AS l0, avg(vol) AS v0, avg(ret) AS r0 FROM p),
        k AS (SELECT 'liq_log' AS feature, (liq_log - l0) * 0.5 AS x FROM p, a UNION ALL SELECT 'vol', (vol - v0) * -2 FROM p, a UNION ALL SELECT 'ret', ret - r0 FROM p, a), f AS (SELECT feature, avg(abs(x)) AS importance FROM k GROUP BY feature)
        SELECT feature, round(importance, 6) AS importance, row_number() OVER (ORDER BY importance DESC, feature) AS place, round(importance / sum(importance) OVER (), 6) AS share FROM f""",
    ),
}
