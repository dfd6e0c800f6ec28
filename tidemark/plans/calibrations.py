"""Queries over backtests of many settings: modes, scenarios, policies, calibration and the backtests of a stage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import calibration as K
from tidemark.operators import selection as L
from tidemark.plans.common import MODELS, model_rows, rounded
from tidemark.plans.selections import scored
from tidemark.session import written

#: These prices move by hundreds of percent a day: returns and forecasts are shrunk so that equities stay within what six digits hold.
SHRINK = 0.01
UNTIL = "2000-01-01"


def rows(s, d):
    """Predictions with what the position machine needs; the metrics are those of the years before UNTIL."""
    shrunk = model_rows(s, d).withColumns({c: F.col(c) * SHRINK for c in ("ret", "realized_return", "y_pred")})
    risk = B.rolling_risk(shrunk)
    w = Window.partitionBy(F.lit(0)).orderBy("Date").rowsBetween(-199, 0)
    market = shrunk.where("model = 'reversal'").groupBy("Date").agg(F.avg("Close").alias("m"))  # a row a day
    regime = market.select("Date", F.when(F.count("m").over(w) >= 200, F.signum(F.col("m") - F.avg("m").over(w))).otherwise(0.0).alias("regime"))
    volatility = L.expanding_volatility_multiplier(risk).withColumnRenamed("multiplier", "volatility_multiplier")
    metrics = scored(s, d).select("symbol", "model", "dir_acc", "rmse_ratio", "composite")
    out = risk.join(regime, "Date").join(volatility, ["symbol", "model", "Date"]).join(metrics, ["symbol", "model"])
    return out.withColumns({"is_benchmark": F.lit(False), "set": F.when(F.col("Date") < UNTIL, "calibration").otherwise("evaluation")})


def report(predictions):
    """Each symbol's trials: three values of the stop, two of most others, a dozen trials at first."""
    values = {"min_dir_acc": [48.0, 52.0], "entry_vol": [0.1, 0.25], "entry_cost": [1.5, 2.0], "min_entry": [0.0, 0.002], "max_hold": [5, 20], "take_vol": [1.0, 2.0], "stop_vol": [0.75, 1.25, 2.0]}
    return K.calibrate(predictions, cap=12, values=values)


def stage(s, d):
    predictions = written(rows(s, d), "predictions")
    return rounded(K.stage_backtests(predictions.where("set = 'evaluation'"), report(predictions), "evaluation"))


def modes(s, d):
    configs = {"simple": K.settings(mode="simple", buy=0.0005, sell=0.001), "legacy": K.settings(mode="legacy"), "rejected": K.settings(mode="rejected")}
    out = K.run_settings(rows(s, d), configs, "mode")
    return rounded(out.select("symbol", "model", "mode", F.log1p("net_return").alias("log_net"), F.log1p("buyhold_return").alias("log_hold"), "sharpe", "max_drawdown", "trade_count", "exposure"))


def policies(s, d):
    strength = F.col("y_pred") - F.avg("y_pred").over(Window.partitionBy("model", "Date"))
    return rounded(K.policy_backtests(rows(s, d).withColumn("sector_strength", strength)))


PLANS = {
    "h16_modes": (
        modes,
        f"""WITH {MODELS}, b AS (SELECT symbol, model, dt, {SHRINK} * y_pred AS p, {SHRINK} * rr AS r FROM models),
        k AS (SELECT *, CASE WHEN p > 0.0005 THEN 1 WHEN p < -0.001 THEN 0 END AS mark FROM b),
        q AS (SELECT symbol, model, dt, r, unnest(['simple', 'legacy', 'rejected']) AS mode, unnest([coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY symbol, model ORDER BY dt), 0), CAST(p > 0 AS INT), 0]) AS pos FROM k),
        e AS (SELECT *, coalesce(lag(pos) OVER w, 0) AS before, lead(dt) OVER w IS NULL AS final FROM q WINDOW w AS (PARTITION BY symbol, model, mode ORDER BY dt)),
        n AS (SELECT *, pos * r - (abs(pos - before) + CASE WHEN final THEN pos ELSE 0 END) * 0.0015 AS net FROM e),
        g AS (SELECT *, sum(ln(1 + net)) OVER (PARTITION BY symbol, model, mode ORDER BY dt) AS lg FROM n),
        f AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY symbol, model, mode ORDER BY dt)) - 1 AS fall FROM g)
        SELECT symbol, model, mode, round(arg_max(lg, dt), 6) AS log_net, round(sum(ln(1 + r)), 6) AS log_hold, round(CASE WHEN stddev_pop(net) > 0 THEN avg(net) / stddev_pop(net) * sqrt(252) ELSE 0 END, 6) AS sharpe,
          round(min(fall), 6) AS max_drawdown, CAST(sum(CASE WHEN pos > before THEN 1 ELSE 0 END) AS BIGINT) AS trade_count, round(100 * avg(pos), 6) AS exposure FROM f GROUP BY 1, 2, 3""",
    ),
    "h19_shadow_backtests": (lambda s, d: rounded(K.shadow_backtests(rows(s, d))), None),
    "h30_policy_backtests": (policies, None),
    "h33_calibration": (lambda s, d: rounded(report(written(rows(s, d), "predictions"))), None),
    "h31_stage_backtests": (stage, None),
}
