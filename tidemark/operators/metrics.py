"""Metrics of forecasts, curves and trades, and the tables that rank models by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.backtest import KEYS, running

YEAR = 252


def sharpe(r: Column, rf: float | None = 0.0) -> Column:
    """Annualised, by population deviation; null without a risk-free rate or variation."""
    if rf is None:
        return F.lit(None).cast("double")
    return (F.avg(r) - rf / YEAR) / F.nullif(F.stddev_pop(r), F.lit(0.0)) * (YEAR**0.5)


def sortino(r: Column, rf: float = 0.0) -> Column:
    return (F.avg(r) - rf / YEAR) / F.nullif(F.stddev_pop(F.when(r < 0, r)), F.lit(0.0)) * (YEAR**0.5)


def forecast_metrics(predictions: DataFrame, *keys: str) -> DataFrame:
    """Errors of predicted returns as prices (against Close) and as returns; MAPE as a share; direction (equal signs, 0 with 0 counts), hit
    rate of the rows with a direction and neutral rate in percent; Sharpe of sign(pred) * y."""
    p, y, close = F.col("y_pred"), F.col("y_true"), F.col("Close")
    e = p - y
    true = F.when(close * (1 + y) == 0, 1e-10).otherwise(close * (1 + y))
    same = (F.signum(p) == F.signum(y)).cast("double")
    won = F.when(p != 0, (F.signum(p) * y > 0).cast("double"))
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(close * e)).alias("mae"), F.sqrt(F.avg(F.pow(close * e, 2))).alias("rmse"),
        F.avg(F.abs((true - close * (1 + p)) / true)).alias("mape"), F.avg(F.abs(e)).alias("return_mae"), F.sqrt(F.avg(e * e)).alias("return_rmse"),
        (100 * F.avg(same)).alias("dir_acc"), F.coalesce(100 * F.avg(won), F.lit(0.0)).alias("hit_rate"),
        (100 * F.avg((p == 0).cast("double"))).alias("neutral_rate"), sharpe(F.signum(p) * y).alias("sharpe"), sharpe(y).alias("buyhold_sharpe"),
    )


def quantile_metrics(predictions: DataFrame, low: float, high: float, *keys: str) -> DataFrame:
    """Pinball loss of q_low and q_high, coverage, width and Winkler score of their interval."""
    y, a, b = F.col("y_true"), F.col("q_low"), F.col("q_high")

    def pinball(q: float, x: Column) -> Column:
        return F.avg(F.greatest(q * (y - x), (q - 1) * (y - x)))

    alpha = 1 - (high - low)
    winkler = (b - a) + F.when(y < a, 2 / alpha * (a - y)).when(y > b, 2 / alpha * (y - b)).otherwise(0.0)
    return predictions.groupBy(*keys).agg(pinball(low, a).alias("pinball_low"), pinball(high, b).alias("pinball_high"), F.avg(y.between(a, b).cast("double")).alias("coverage"), F.avg(b - a).alias("width"), F.avg(winkler).alias("winkler"))


def drawdown(curve: DataFrame, equity: str = "net_equity") -> DataFrame:
    """Deepest fall from the running maximum of the curve itself, by series."""
    return curve.withColumn("_peak", F.greatest(F.max(equity).over(running(*KEYS)), F.lit(1e-12))).groupBy(*KEYS).agg(F.min(F.col(equity) / F.col("_peak") - 1).alias("max_drawdown"))


def tail_risk(curve: DataFrame, share: float = 0.05) -> DataFrame:
    """Value at risk by linear quantile, and the mean at or below it."""
    var = curve.groupBy(*KEYS).agg(F.percentile("net_return", F.lit(share)).alias("var"))
    return curve.join(var, list(KEYS)).groupBy(*KEYS).agg(F.max("var").alias("var"), F.avg(F.when(F.col("net_return") <= F.col("var"), F.col("net_return"))).alias("cvar"))


def backtest_summary(curve: DataFrame, trade_log: DataFrame) -> DataFrame:
    """One row a series: returns, risk, exposure, costs and trades."""
    r = F.col("net_return")
    last = lambda c: F.max_by(c, "Date")
    # one pass over the curve: the peak is a window column, the tail a sorted array of each series' worst returns
    peak = F.greatest(F.max("net_equity").over(running(*KEYS)), F.lit(1e-12))
    main = curve.withColumn("_fall", F.col("net_equity") / peak - 1).groupBy(*KEYS).agg(
        F.min("_fall").alias("max_drawdown"), F.percentile("net_return", F.lit(0.05)).alias("var"), F.collect_list("net_return").alias("_returns"),
        F.count(F.lit(1)).alias("bars"), (last("net_equity") - 1).alias("total_return"), (last("buyhold_equity") - 1).alias("buyhold_return"),
        (F.stddev_pop(r) * YEAR**0.5).alias("volatility"), sharpe(r).alias("sharpe"), sortino(r).alias("sortino"),
        F.avg("position").alias("exposure"), F.sum(F.col("entry") + F.col("exit") + F.col("forced_exit")).alias("turnover"),
        F.sum("commission").alias("commission_drag"), F.sum("slippage").alias("slippage_drag"),
        (F.sum(F.greatest(r, F.lit(0.0))) / F.nullif(F.sum(F.greatest(-r, F.lit(0.0))), F.lit(0.0))).alias("omega"),
        (F.avg(r - F.col("realized_return")) / F.nullif(F.stddev_pop(r - F.col("realized_return")), F.lit(0.0)) * YEAR**0.5).alias("information_ratio"),
    )
    main = main.withColumn("cagr", F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), YEAR / F.col("bars")) - 1))
    below = F.filter("_returns", lambda x: x <= F.col("var"))
    main = main.withColumn("cvar", F.aggregate(below, F.lit(0.0), lambda t, x: t + x) / F.size(below)).drop("_returns")
    out = main.join(trade_stats(trade_log), list(KEYS), "left")
    return out.withColumns({"calmar": F.col("cagr") / F.nullif(F.abs("max_drawdown"), F.lit(0.0)), "recovery_factor": F.col("total_return") / F.nullif(F.abs("max_drawdown"), F.lit(0.0))}).fillna(0, ["trade_count"])


def trade_stats(log: DataFrame) -> DataFrame:
    r = F.col("net_return")
    gain, loss = F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))
    return log.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_trade"), F.avg("holding_bars").alias("avg_holding"),
        (gain / F.nullif(loss, F.lit(0.0))).alias("profit_factor"), F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"),
    )


def losing_streak(log: DataFrame) -> DataFrame:
    """Longest run of losing trades."""
    w = Window.partitionBy(*KEYS).orderBy("trade_id")
    lost = log.withColumn("lost", (F.col("net_return") < 0).cast("int"))
    runs = lost.withColumn("run", F.row_number().over(w) - F.sum("lost").over(w)).where("lost = 1").groupBy(*KEYS, "run").agg(F.count(F.lit(1)).alias("k"))
    found = runs.groupBy(*KEYS).agg(F.max("k").alias("max_losing_streak"))
    return log.select(*KEYS).distinct().join(found, list(KEYS), "left").fillna(0, ["max_losing_streak"])


def worst_fold(folds: DataFrame) -> DataFrame:
    w = Window.partitionBy("model").orderBy("net_return", "sharpe", "max_drawdown", "fold")
    return folds.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def stability(folds: DataFrame) -> DataFrame:
    """Share of folds with a positive Sharpe less half the deviation."""
    return folds.groupBy("symbol", "model").agg((F.avg((F.col("sharpe") > 0).cast("double")) - 0.5 * F.stddev_pop("sharpe")).alias("stability_score"))


def against_benchmark(metrics: DataFrame, baselines: list[str]) -> DataFrame:
    """Each symbol's best baseline (rmse, mae, dir_acc, then the order given) and every model relative to it."""
    place = F.array_position(F.array(*[F.lit(b) for b in baselines]), F.col("model"))
    w = Window.partitionBy("symbol").orderBy("rmse", "mae", F.desc("dir_acc"), place)
    best = metrics.where(F.col("model").isin(baselines)).withColumn("_k", F.row_number().over(w)).where("_k = 1").select("symbol", F.col("model").alias("benchmark"), F.col("rmse").alias("benchmark_rmse"), F.col("dir_acc").alias("benchmark_dir_acc"))
    return metrics.join(best, "symbol", "left").withColumns({"rmse_ratio": F.col("rmse") / F.nullif(F.col("benchmark_rmse"), F.lit(0.0)), "dir_acc_gain": F.col("dir_acc") - F.col("benchmark_dir_acc")})


def leaders(metrics: DataFrame) -> DataFrame:
    """Order and gap to the leader within a symbol: eligible first, then composite, then rmse."""
    w = Window.partitionBy("symbol").orderBy(F.desc("eligible"), F.desc_nulls_last("composite"), "rmse", "model")
    return metrics.withColumns({"place": F.row_number().over(w), "rmse_gap": F.col("rmse") - F.first("rmse").over(w)})
