"""Queries over forecasts, signals, curves and trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import ensembles as E
from tidemark.operators import metrics as M
from tidemark.plans.common import MODELS, model_rows, rounded

BUY, SELL = 0.05, 0.05
P = "PARTITION BY symbol, model ORDER BY dt"


def run(x):
    return f"CASE WHEN min(1 + {x}) OVER w <= 0 THEN 0 ELSE exp(sum(ln(CASE WHEN 1 + {x} > 0 THEN 1 + {x} END)) OVER w) END"


def whole(x):
    return f"CASE WHEN min(1 + {x}) <= 0 THEN 0 ELSE exp(sum(ln(CASE WHEN 1 + {x} > 0 THEN 1 + {x} END))) END"


POSITIONS = (
    MODELS
    + f""", mk AS (SELECT *, CASE WHEN y_pred > {BUY} THEN 1 WHEN y_pred < -{SELL} THEN 0 END AS mark FROM models),
ps AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER ({P} ROWS UNBOUNDED PRECEDING), 0) AS pos FROM mk),
ev AS (SELECT *, coalesce(lag(pos) OVER ({P}), 0) AS prev, lead(dt) OVER ({P}) IS NULL AS is_last FROM ps),
e2 AS (SELECT *, CAST(prev = 0 AND pos = 1 AS INT) AS entry, CAST(prev = 1 AND pos = 0 AS INT) AS xit, CAST(is_last AND pos = 1 AS INT) AS forced FROM ev),
curve AS (SELECT *, (entry + xit + forced) * 10 / 1e4 AS com, (entry + xit + forced) * 5 / 1e4 AS slip, pos * rr AS gross, pos * rr - (entry + xit + forced) * 15 / 1e4 AS net FROM e2),
eq AS (SELECT *, {run('gross')} AS geq, {run('net')} AS neq, {run('rr')} AS beq FROM curve WINDOW w AS ({P} ROWS UNBOUNDED PRECEDING))"""
)
TRADES = f"""{POSITIONS}, tr AS (SELECT *, sum(entry) OVER ({P} ROWS UNBOUNDED PRECEDING) AS tid FROM eq),
log AS (SELECT symbol, model, tid AS trade_id, min(dt) AS entry_date, max(dt) AS exit_date, count(CASE WHEN pos = 1 THEN 1 END) AS holding_bars,
  {whole('CASE WHEN pos = 1 THEN gross END')} - 1 AS gross_return, {whole('net')} - 1 AS net_return, CASE WHEN max(xit) = 1 THEN 'signal' ELSE 'end_of_data' END AS exit_reason
  FROM tr WHERE (pos = 1 OR xit = 1) AND tid > 0 GROUP BY 1, 2, 3)"""


def curve(s, d):
    return B.equity_curve(B.hysteresis(model_rows(s, d), BUY, SELL))


def trade_log(s, d):
    return B.trades(curve(s, d))


def metrics(s, d):
    return M.forecast_metrics(model_rows(s, d), "symbol", "model")


FORECAST = """count(*) AS n, avg(abs(c * (y_pred - y_true))) AS mae, sqrt(avg((c * (y_pred - y_true)) ** 2)) AS rmse,
avg(abs((c * (1 + y_true) - c * (1 + y_pred)) / CASE WHEN c * (1 + y_true) = 0 THEN 1e-10 ELSE c * (1 + y_true) END)) AS mape,
avg(abs(y_pred - y_true)) AS return_mae, sqrt(avg((y_pred - y_true) ** 2)) AS return_rmse, 100 * avg(CASE WHEN sign(y_pred) = sign(y_true) THEN 1.0 ELSE 0 END) AS dir_acc,
coalesce(100 * avg(CASE WHEN y_pred <> 0 THEN CASE WHEN sign(y_pred) * y_true > 0 THEN 1.0 ELSE 0 END END), 0) AS hit_rate, 100 * avg(CASE WHEN y_pred = 0 THEN 1.0 ELSE 0 END) AS neutral_rate,
avg(sign(y_pred) * y_true) / nullif(stddev_pop(sign(y_pred) * y_true), 0) * sqrt(252) AS sharpe, avg(y_true) / nullif(stddev_pop(y_true), 0) * sqrt(252) AS buyhold_sharpe"""
NAMES = ("mae", "rmse", "mape", "return_mae", "return_rmse", "dir_acc", "hit_rate", "neutral_rate", "sharpe", "buyhold_sharpe")
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in NAMES)
FOLD = "CAST(year(dt) AS INT)"


def fold_rows(s, d):
    return M.forecast_metrics(model_rows(s, d).withColumn("fold", F.year("Date")), "symbol", "model", "fold")


WEIGHTS = f"WITH {MODELS}, m AS (SELECT model, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(sign(y_pred) * y_true) / nullif(stddev_samp(sign(y_pred) * y_true), 0) AS sr, stddev_samp(sign(y_pred) * y_true) AS vol FROM models GROUP BY model)"
PLANS = {
    "e1_forecast_metrics": (lambda s, d: rounded(metrics(s, d)), f"WITH {MODELS}, m AS (SELECT symbol, model, {FORECAST} FROM models GROUP BY 1, 2) SELECT symbol, model, n, {ROUNDED} FROM m"),
    "g10_fold_metrics": (lambda s, d: rounded(fold_rows(s, d)), f"WITH {MODELS}, m AS (SELECT symbol, model, {FOLD} AS fold, {FORECAST} FROM models GROUP BY 1, 2, 3) SELECT symbol, model, fold, n, {ROUNDED} FROM m"),
    "e2_quantile_metrics": (
        lambda s, d: rounded(M.quantile_metrics(model_rows(s, d).withColumns({"q_low": F.col("y_pred") - 0.1, "q_high": F.col("y_pred") + 0.1}), 0.1, 0.9, "model")),
        f"""WITH {MODELS}, q AS (SELECT model, y_true AS y, y_pred - 0.1 AS a, y_pred + 0.1 AS b FROM models)
        SELECT model, round(avg(greatest(0.1 * (y - a), (0.1 - 1) * (y - a))), 6) AS pinball_low, round(avg(greatest(0.9 * (y - b), (0.9 - 1) * (y - b))), 6) AS pinball_high, round(avg(CASE WHEN y BETWEEN a AND b THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(b - a), 6) AS width,
          round(avg(b - a + CASE WHEN y < a THEN 2 / 0.2 * (a - y) WHEN y > b THEN 2 / 0.2 * (y - b) ELSE 0 END), 6) AS winkler FROM q GROUP BY model""",
    ),
    "h4_hysteresis": (
        lambda s, d: rounded(B.hysteresis(model_rows(s, d), BUY, SELL).select("symbol", "model", "Date", "position", "decision")),
        f"""WITH {POSITIONS} SELECT symbol, model, dt AS "Date", pos AS position, CASE WHEN prev = 0 AND pos = 1 THEN 'BUY' WHEN prev = 1 AND pos = 0 THEN 'EXIT' WHEN pos = 1 THEN 'HOLD' ELSE 'NO_TRADE' END AS decision FROM e2""",
    ),
    "h6_rolling_risk": (
        lambda s, d: rounded(B.rolling_risk(model_rows(s, d)).select("symbol", "model", "Date", "rolling_vol")),
        f"""WITH {MODELS} SELECT symbol, model, dt AS "Date", round(coalesce(nullif(stddev_samp(ret) OVER ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0), 1e-6), 6) AS rolling_vol FROM models""",
    ),
    "h15_equity_curve": (
        lambda s, d: rounded(curve(s, d).select("symbol", "model", "Date", "gross_return", "net_return", *[F.log(F.nullif(F.col(c), F.lit(0.0))).alias(f"log_{c}") for c in ("gross_equity", "net_equity", "buyhold_equity")])),
        f"""WITH {POSITIONS} SELECT symbol, model, dt AS "Date", round(gross, 6) AS gross_return, round(net, 6) AS net_return, round(ln(nullif(geq, 0)), 6) AS log_gross_equity, round(ln(nullif(neq, 0)), 6) AS log_net_equity, round(ln(nullif(beq, 0)), 6) AS log_buyhold_equity FROM eq""",
    ),
    "h17_orders": (
        lambda s, d: B.orders(curve(s, d)),
        f"""WITH {POSITIONS} SELECT symbol, model, dt AS "Date", CASE WHEN entry = 1 THEN 'BUY' WHEN xit = 1 OR forced = 1 THEN 'SELL' ELSE 'HOLD' END AS "order", prev AS previous_position, pos AS new_position FROM e2""",
    ),
    "h18_trades": (lambda s, d: rounded(trade_log(s, d)), f"WITH {TRADES} SELECT symbol, model, CAST(trade_id AS BIGINT) AS trade_id, entry_date, exit_date, holding_bars, round(gross_return, 6) AS gross_return, round(net_return, 6) AS net_return, exit_reason FROM log"),
    "e4_drawdown": (
        lambda s, d: rounded(M.drawdown(curve(s, d))),
        f"WITH {POSITIONS}, pk AS (SELECT *, greatest(1e-12, max(neq) OVER ({P} ROWS UNBOUNDED PRECEDING)) AS peak FROM eq) SELECT symbol, model, round(min(neq / peak - 1), 6) AS max_drawdown FROM pk GROUP BY 1, 2",
    ),
    "e5_tail_risk": (
        lambda s, d: rounded(M.tail_risk(curve(s, d))),
        f"WITH {POSITIONS}, q AS (SELECT symbol, model, quantile_cont(net, 0.05) AS var FROM eq GROUP BY 1, 2) SELECT symbol, model, round(max(var), 6) AS var, round(avg(CASE WHEN net <= var THEN net END), 6) AS cvar FROM eq JOIN q USING (symbol, model) GROUP BY 1, 2",
    ),
    "e7_backtest_summary": (
        lambda s, d: rounded(M.backtest_summary(curve(s, d), trade_log(s, d)).select("symbol", "model", "bars", F.log(F.nullif(1 + F.col("total_return"), F.lit(0.0))).alias("log_total"), F.log(F.nullif(1 + F.col("buyhold_return"), F.lit(0.0))).alias("log_buyhold"), "volatility", "sharpe", "exposure", "turnover", "max_drawdown", "trade_count", "win_rate")),
        f"""WITH {TRADES}, pk AS (SELECT *, greatest(1e-12, max(neq) OVER ({P} ROWS UNBOUNDED PRECEDING)) AS peak FROM eq), lg AS (SELECT symbol, model, count(*) AS trade_count, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM log GROUP BY 1, 2),
        m AS (SELECT symbol, model, count(*) AS bars, arg_max(neq, dt) - 1 AS total_return, arg_max(beq, dt) - 1 AS buyhold_return, stddev_pop(net) * sqrt(252) AS volatility, avg(net) / nullif(stddev_pop(net), 0) * sqrt(252) AS sharpe, avg(pos) AS exposure, CAST(sum(entry + xit + forced) AS BIGINT) AS turnover, min(neq / peak - 1) AS max_drawdown FROM pk GROUP BY 1, 2)
        SELECT symbol, model, bars, round(ln(nullif(1 + total_return, 0)), 6) AS log_total, round(ln(nullif(1 + buyhold_return, 0)), 6) AS log_buyhold, round(volatility, 6) AS volatility, round(sharpe, 6) AS sharpe, round(exposure, 6) AS exposure, turnover, round(max_drawdown, 6) AS max_drawdown, coalesce(trade_count, 0) AS trade_count, round(win_rate, 6) AS win_rate FROM m LEFT JOIN lg USING (symbol, model)""",
    ),
    "e9_trade_stats": (
        lambda s, d: rounded(M.trade_stats(trade_log(s, d))),
        f"""WITH {TRADES} SELECT symbol, model, count(*) AS trade_count, round(avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(net_return), 6) AS avg_trade, round(avg(holding_bars), 6) AS avg_holding,
        round(sum(CASE WHEN net_return > 0 THEN net_return END) / nullif(-sum(CASE WHEN net_return < 0 THEN net_return END), 0), 6) AS profit_factor, round(avg(CASE WHEN net_return > 0 THEN net_return END), 6) AS avg_win, round(avg(CASE WHEN net_return < 0 THEN net_return END), 6) AS avg_loss FROM log GROUP BY 1, 2""",
    ),
    "e11_losing_streak": (
        lambda s, d: M.losing_streak(trade_log(s, d)),
        f"""WITH {TRADES}, l AS (SELECT *, CAST(net_return < 0 AS INT) AS lost FROM log), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, model ORDER BY trade_id) - sum(lost) OVER (PARTITION BY symbol, model ORDER BY trade_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
        k AS (SELECT symbol, model, count(*) AS k FROM r WHERE lost = 1 GROUP BY symbol, model, run), a AS (SELECT DISTINCT symbol, model FROM log) SELECT a.symbol, a.model, coalesce(max(k), 0) AS max_losing_streak FROM a LEFT JOIN k USING (symbol, model) GROUP BY 1, 2""",
    ),
    "e14_against_benchmark": (
        lambda s, d: rounded(M.against_benchmark(metrics(s, d).select("symbol", "model", "rmse", "mae", "dir_acc"), ["momentum", "reversal"])),
        f"""WITH {MODELS}, m AS (SELECT symbol, model, {FORECAST} FROM models GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rmse, mae, dir_acc DESC, model) AS k FROM m),
        b AS (SELECT symbol, model AS benchmark, rmse AS brmse, dir_acc AS bdir FROM k WHERE k = 1)
        SELECT m.symbol, model, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(dir_acc, 6) AS dir_acc, benchmark, round(brmse, 6) AS benchmark_rmse, round(bdir, 6) AS benchmark_dir_acc, round(rmse / nullif(brmse, 0), 6) AS rmse_ratio, round(dir_acc - bdir, 6) AS dir_acc_gain FROM m LEFT JOIN b USING (symbol)""",
    ),
    "e19_stability": (
        lambda s, d: rounded(M.stability(fold_rows(s, d))),
        f"WITH {MODELS}, m AS (SELECT symbol, model, {FOLD} AS fold, {FORECAST} FROM models GROUP BY 1, 2, 3) SELECT symbol, model, round(avg(CASE WHEN sharpe > 0 THEN 1.0 WHEN sharpe IS NOT NULL THEN 0 END) - 0.5 * stddev_pop(sharpe), 6) AS stability_score FROM m GROUP BY 1, 2",
    ),
    "j1_naive_baselines": (
        lambda s, d: rounded(E.naive_baselines(model_rows(s, d).where("model = 'momentum'"), "1999-01-01")),
        f"""WITH {MODELS}, t AS (SELECT symbol, arg_max(y_true, dt) AS last_value, avg(y_true) AS drift FROM models WHERE model = 'momentum' AND dt < DATE '1999-01-01' GROUP BY symbol), x AS (SELECT symbol, dt, y_true FROM models WHERE model = 'momentum' AND dt >= DATE '1999-01-01')
        SELECT symbol, dt AS "Date", round(y_true, 6) AS y_true, round(last_value, 6) AS naive_last, 0.0 AS naive_zero, round(drift, 6) AS naive_drift FROM x JOIN t USING (symbol)""",
    ),
    "j6_autoregression": (
        lambda s, d: rounded(E.autoregression(model_rows(s, d).where("model = 'momentum'").select("symbol", "Date", "ret"), 3)),
        f"""WITH {MODELS}, r AS (SELECT symbol, dt, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY dt) AS prev FROM models WHERE model = 'momentum'), f AS (SELECT symbol, regr_slope(ret, prev) AS phi, regr_intercept(ret, prev) AS c, arg_max(ret, dt) AS last FROM r GROUP BY symbol),
        h AS (SELECT *, CAST(unnest(generate_series(1, 3)) AS INT) AS step FROM f) SELECT symbol, step, round(phi, 6) AS phi, round(c * (1 - phi ** step) / (1 - phi) + phi ** step * last, 6) AS y_pred FROM h""",
    ),
    "j9_inverse_rmse_weights": (lambda s, d: rounded(E.weights(model_rows(s, d), "inverse_rmse")), f"{WEIGHTS} SELECT model, round((1 / rmse) / sum(1 / rmse) OVER (), 6) AS weight FROM m"),
    "j10_sharpe_weights": (lambda s, d: rounded(E.weights(model_rows(s, d), "sharpe")), f"{WEIGHTS} SELECT model, round(CASE WHEN sum(greatest(sr, 0)) OVER () > 0 THEN greatest(sr, 0) / sum(greatest(sr, 0)) OVER () ELSE 1.0 / count(*) OVER () END, 6) AS weight FROM m"),
    "j11_risk_parity_weights": (lambda s, d: rounded(E.weights(model_rows(s, d), "risk_parity")), f"{WEIGHTS} SELECT model, round((1 / vol) / sum(1 / vol) OVER (), 6) AS weight FROM m"),
    "j14_cash_gate": (
        lambda s, d: rounded(E.cash_gate(model_rows(s, d), 0.6, 0.01).select("symbol", "Date", "agreement", "gated")),
        f"""WITH {MODELS} SELECT symbol, dt AS "Date", round(greatest(count(CASE WHEN y_pred > 0 THEN 1 END), count(CASE WHEN y_pred < 0 THEN 1 END)) / count(*)::DOUBLE, 6) AS agreement,
        round(CASE WHEN greatest(count(CASE WHEN y_pred > 0 THEN 1 END), count(CASE WHEN y_pred < 0 THEN 1 END)) / count(*)::DOUBLE >= 0.6 AND abs(avg(y_pred)) >= 0.01 THEN avg(y_pred) ELSE 0 END, 6) AS gated FROM models GROUP BY symbol, dt""",
    ),
}
