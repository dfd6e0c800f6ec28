"""Tables of runs: leaderboard rows and summaries, forecasts by several members, live accuracy, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.forecasts import bounded


def target_session(stamps: DataFrame, days: DataFrame, hour: int = 19) -> DataFrame:
    """The session that a time of the day asks for: its own date from `hour` on, else the day before; kept only on trading days."""
    d = F.to_date("ts")
    out = stamps.withColumn("Date", F.when(F.hour("ts") >= hour, d).otherwise(F.date_sub(d, 1)))
    return out.join(days.where("Is_Trading_Day").select("Date"), "Date", "left_semi")


def supervised(rows: DataFrame, h: int = 1) -> DataFrame:
    """rows(symbol, role, Date, Close): the close h rows ahead within the role, its date and the close before; a role's last h rows fall away."""
    w = Window.partitionBy("symbol", "role").orderBy("Date")
    out = rows.withColumns({"y": F.lead("Close", h).over(w), "realized_date": F.lead("Date", h).over(w), "prev_close": F.col("Close"), "decision_date": F.col("Date")})
    return out.where("realized_date is not null")


def lookback_index(rows: DataFrame, window: int) -> DataFrame:
    """Of each row with a full past of so many rows: the date on which it begins."""
    w = Window.partitionBy("symbol").orderBy("Date")
    past = w.rowsBetween(-(window - 1), 0)
    out = rows.withColumns({"rows_back": F.count(F.lit(1)).over(past), "first_date": F.min("Date").over(past)})
    return out.where(F.col("rows_back") == window).select("symbol", "Date", "first_date")


def clip_report(scaled: DataFrame, columns: list[str], limit: float = 5.0, least: float = 1.0) -> DataFrame:
    """One row of scaled(role, Date, `<column>_z` of every column): the share of clipped values by role over all columns in percent, the dates
    that the scaler was fitted and tested on, and a warning where the test's share is at least `least` and above the train's."""
    z = [F.col(f"{c}_z") for c in columns]
    clipped, known = (sum((F.coalesce(f(x), F.lit(0)) for x in z[1:]), F.coalesce(f(z[0]), F.lit(0))) for f in (lambda x: (F.abs(x) >= limit).cast("int"), lambda x: x.isNotNull().cast("int")))

    def of(role: str, value: Column) -> Column:
        return F.when(F.col("role") == role, value)

    rate = {r: F.coalesce(100 * F.sum(of(r, clipped)) / F.nullif(F.sum(of(r, known)), F.lit(0)), F.lit(0.0)) for r in ("train", "test")}
    out = scaled.agg(
        *[rate[r].alias(f"{r}_clip_rate_pct") for r in rate], F.min(of("train", F.col("Date"))).alias("scaler_fit_start"), F.max(of("train", F.col("Date"))).alias("scaler_fit_end"),
        F.min(of("test", F.col("Date"))).alias("test_start"), F.max(of("test", F.col("Date"))).alias("test_end"),
    )
    high = (F.col("test_clip_rate_pct") >= least) & (F.col("test_clip_rate_pct") > F.col("train_clip_rate_pct"))
    text = F.format_string("distribution_shift_warning: test clip rate is high relative to train (%.3f%% vs %.3f%%).", "test_clip_rate_pct", "train_clip_rate_pct")
    return out.withColumns({"clip_low": F.lit(-limit), "clip_high": F.lit(limit), "warning": F.when(high, text).otherwise("")})


def risk_free(monthly: DataFrame) -> DataFrame:
    """One row: the newest rate as a fraction (percent if over 1), null outside (0, 5)."""
    raw = F.max_by("rate", "Date")
    rate = F.when(raw > 1, raw / 100).otherwise(raw)
    return monthly.where("rate is not null").agg(rate.alias("r")).select(F.when((F.col("r") > 0) & (F.col("r") < 5), F.col("r")).alias("risk_free_rate"))


def attach_backtest(metrics: DataFrame, summary: DataFrame) -> DataFrame:
    """Five backtest fields on the metric rows of each symbol and model."""
    return metrics.join(summary.select("symbol", "model", "total_return", "buyhold_return", "max_drawdown", "trade_count", "win_rate"), ["symbol", "model"], "left")


def horizon_metrics(rows: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Error and direction of y_pred against target_<h> of each horizon, by symbol and model."""
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}").alias("y")) for h in horizons])
    long = rows.select("symbol", "model", "y_pred", F.explode(pairs).alias("x")).select("symbol", "model", "y_pred", "x.*").where("y is not null")
    e = F.col("y_pred") - F.col("y")
    return long.groupBy("symbol", "model", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (100 * F.avg((F.signum("y_pred") == F.signum("y")).cast("double"))).alias("dir_acc")
    )


def stability_objective(folds: DataFrame) -> DataFrame:
    """-(mean fold Sharpe - half its deviation) of each model; lower is better."""
    return folds.groupBy("symbol", "model").agg((-(F.avg("sharpe") - 0.5 * F.stddev_pop("sharpe"))).alias("objective"))


def agreement(predictions: DataFrame, main: str) -> DataFrame:
    """Per symbol the share of the other models whose newest prediction has the main model's sign."""
    last = predictions.groupBy("symbol", "model").agg(F.max_by("y_pred", "Date").alias("p"))
    own = last.where(F.col("model") == main).select("symbol", F.col("p").alias("own"))
    joined = last.where(F.col("model") != main).join(own, "symbol")
    return joined.groupBy("symbol").agg(F.count(F.lit(1)).alias("members"), F.avg((F.signum("p") == F.signum("own")).cast("double")).alias("agreement"))


def feature_stability(importances: DataFrame, k: int) -> DataFrame:
    """importances(fold, feature, importance): share of the folds in which a feature is among the k largest by size, and its mean."""
    n = importances.agg(F.count_distinct("fold").alias("folds"))
    ranked = importances.withColumn("at", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc(F.abs("importance")), "feature")))
    out = ranked.groupBy("feature").agg(F.count_if(F.col("at") <= k).alias("times"), F.avg("importance").alias("mean_importance"))
    return out.crossJoin(F.broadcast(n)).select("feature", (F.col("times") / F.col("folds")).alias("stability"), "mean_importance")  # one row


def drivers(contributions: DataFrame, k: int) -> DataFrame:
    """The k strongest positive and negative mean contributions, joined in order."""
    mean = contributions.groupBy("feature").agg(F.avg("contribution").alias("c")).where("c <> 0").withColumn("side", F.when(F.col("c") > 0, "positive").otherwise("negative"))
    top = mean.withColumn("at", F.row_number().over(Window.partitionBy("side").orderBy(F.desc(F.abs("c")), "feature"))).where(F.col("at") <= k)
    return top.groupBy("side").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("at", "feature"))), lambda x: x["feature"])).alias("features"))


def signal_summary(signals: DataFrame) -> DataFrame:
    """How often each decision came with each risk state, and its share of the model's rows."""
    counts = signals.groupBy("model", "decision", "risk_state").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("model")))


def combine_members(points: DataFrame, weights: DataFrame, gated: bool = False, least_agreement: float = 0.6, band: float = 0.10) -> DataFrame:
    """points(symbol, model, horizon, last_close, bounded_close, predicted_return) of several members to one path, as long as the shortest.

    A step's close is the mean of the members' bounded closes by weights(model, weight), negative ones as 0, equal where they sum to 0. If
    gated, the close before stands where too few members agree on the sign of the return. Each step is bounded by the one before: a fold within
    the row.
    """
    members = points.groupBy("symbol", "model").agg(F.count(F.lit(1)).alias("n")).join(weights, "model", "left")
    own = Window.partitionBy("symbol")
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    share = F.when(F.sum(w).over(own) > 0, w / F.sum(w).over(own)).otherwise(1 / F.count(F.lit(1)).over(own))
    members = members.select("symbol", "model", share.alias("share"), F.min("n").over(own).alias("shortest"))
    r = F.col("predicted_return")
    joined = points.join(members, ["symbol", "model"]).where(F.col("horizon") <= F.col("shortest"))
    agreement = F.greatest(F.count_if(r > 0), F.count_if(r < 0)) / F.count(F.lit(1))
    step = joined.groupBy("symbol", "horizon").agg(F.sum(F.col("share") * F.col("bounded_close")).alias("mean"), agreement.alias("agreement"), F.max("last_close").alias("last_close"))
    rows = step.groupBy("symbol").agg(F.max("last_close").alias("last_close"), F.array_sort(F.collect_list(F.struct("horizon", "mean", "agreement"))).alias("steps"))
    start = F.array(F.struct(F.col("last_close").alias("raw"), F.col("last_close").alias("close")))

    def move(path: Column, x: Column) -> Column:
        before = F.element_at(path, -1)["close"]
        raw = F.when(F.lit(gated) & (x["agreement"] < least_agreement), before).otherwise(x["mean"])
        return F.concat(path, F.array(F.struct(raw.alias("raw"), bounded(raw, before, band).alias("close"))))

    path = F.aggregate("steps", start, move)
    out = rows.select("symbol", F.posexplode(F.arrays_zip(F.col("steps").alias("s"), F.slice(path, 2, F.size("steps")).alias("c"), F.slice(path, 1, F.size("steps")).alias("b"))).alias("i", "z"))
    return out.select(
        "symbol", F.col("z.s.horizon").alias("horizon"), F.col("z.s.agreement").alias("agreement"), F.col("z.c.raw").alias("raw_close"), F.col("z.c.close").alias("pred_close"), (F.col("z.c.close") / F.col("z.b.close") - 1).alias("predicted_return")
    )


def choose_forecaster(experiments: DataFrame, baselines: list[str]) -> DataFrame:
    """Per symbol the best model by score; a baseline gives way to the best of the others."""
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("composite"), F.desc("trained_at"), "model")
    first = F.struct((~F.col("model").isin(baselines)).alias("ok"), F.col("model").alias("m"))
    out = experiments.withColumn("k", F.row_number().over(w)).withColumn("x", first)
    per = out.groupBy("symbol").agg(F.min_by("model", "k").alias("best"), F.min_by("model", F.when(F.col("x.ok"), F.col("k"))).alias("trainable"))
    return per.select("symbol", "best", F.coalesce("trainable", "best").alias("chosen"), (F.col("best").isin(baselines) & F.col("trainable").isNotNull()).alias("replaced"))


def realized_volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """symbol, vol20: the population deviation of the last n log returns; 0 for symbols of n closes or fewer."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("Date"))
    rows = bars.where("Close is not null").withColumns({"k": F.row_number().over(newest), "r": F.log(F.col("Close") / F.lead("Close").over(newest)), "m": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    return rows.where(F.col("k") <= n).groupBy("symbol").agg(F.when(F.max("m") > n, F.stddev_pop("r")).otherwise(0.0).alias("vol20"))


def forecast_runs(points: DataFrame, volatility: DataFrame, cost: float = 0.003) -> DataFrame:
    """points(symbol, horizon, last_close, pred_close): one saved run a symbol, with the whole path's return, its threshold and label."""
    end = points.groupBy("symbol").agg(F.max("horizon").alias("steps"), (F.max_by("pred_close", "horizon") / F.max("last_close") - 1).alias("path_return"))
    limit = F.greatest(F.lit(0.005), F.lit(cost), 0.25 * F.col("vol20") * F.sqrt("steps"))
    out = end.join(volatility, "symbol").withColumn("threshold", limit)
    return out.withColumn("label", F.when(F.col("path_return") > F.col("threshold"), "UP").when(F.col("path_return") < -F.col("threshold"), "DOWN").otherwise("FLAT"))


def history(resolved: DataFrame, limit: int) -> DataFrame:
    """The newest runs of each symbol with their points nested in order and their accuracy."""
    point = F.struct("horizon", "target_date", "pred_close", "actual_close")
    runs = resolved.groupBy("symbol", "run").agg(F.array_sort(F.collect_list(point)).alias("points"), F.avg("abs_error").alias("mae"), (100 * F.avg(F.col("direction_correct").cast("double"))).alias("dir_acc"))
    return runs.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("run")))).where(F.col("k") <= limit)


def rolling_accuracy(runs: DataFrame, resolved: DataFrame, now: Column, days: int = 60, least: float = 50.0) -> DataFrame:
    """Accuracy of each symbol's points resolved within so many days before now, over all its runs, and its status: degraded below the limit,
    healthy otherwise, also where nothing is resolved. runs(symbol, run, run_at), resolved(symbol, resolved_at, direction_correct, abs_error)."""
    recent = resolved.where(F.col("resolved_at") >= F.date_sub(now, days))
    found = recent.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(F.col("direction_correct").cast("double"))).alias("dir_acc"), F.avg("abs_error").alias("mae"))
    out = runs.select("symbol").distinct().join(found, "symbol", "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "status": F.when(F.col("dir_acc") < least, "degraded").otherwise("healthy")})


def mark_degraded(runs: DataFrame, accuracy: DataFrame) -> DataFrame:
    """runs with live_status degraded on the newest run of each degraded symbol."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("run_at"), F.desc("run")))
    out = runs.withColumn("_k", newest).join(accuracy.select("symbol", "status"), "symbol", "left")
    return out.withColumn("live_status", F.when((F.col("_k") == 1) & (F.col("status") == "degraded"), "degraded").otherwise("healthy")).drop("_k", "status")
