"""Why a signal stood, a trade ended and a model predicted: texts and tables from decisions and contributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a risk state means, and why a decision was taken in it.
READABLE = {
    "benchmark_only": "benchmark model, not traded", "quality_dir_acc": "direction below the trading limit", "quality_rmse": "error above the benchmark's", "quality_composite": "overall score too low",
    "below_threshold": "forecast below the entry threshold", "cooldown": "waiting after an exit", "min_hold": "shortest holding time", "take_profit": "profit target", "stop_loss": "loss limit",
    "max_hold": "longest holding time", "weak_signal": "forecast has weakened", "entry_ok": "entry threshold passed", "in_position": "position kept",
}
HOLDING = {"min_hold": "Kept: the shortest holding time has not passed."}
LEAVING = {"take_profit": "Left at the profit target.", "stop_loss": "Left at the loss limit.", "max_hold": "Left at the longest holding time."}
STAYING_OUT = {
    "benchmark_only": "Not traded: the model is a benchmark.", "quality_dir_acc": "Not traded: its direction is below the limit.", "quality_rmse": "Not traded: its error is above the benchmark's.",
    "quality_composite": "Not traded: its score is too low.", "cooldown": "Not traded: waiting after the last exit.",
}


def by_state(texts: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])[F.col("risk_state")], otherwise)


def decision_reason() -> Column:
    """The reason of a row(decision, risk_state, expected_return, entry_threshold)."""
    weak = F.when(
        F.col("expected_return").isNotNull() & F.col("entry_threshold").isNotNull(),
        F.format_string("Not traded: the forecast %.6f does not pass the threshold %.6f.", "expected_return", "entry_threshold"),
    ).otherwise("Not traded: the signal is not enough.")
    d = F.col("decision")
    out = F.when(d == "BUY", "Bought: the forecast passes costs and volatility.").when(d == "HOLD", by_state(HOLDING, F.lit("Kept: the forecast is above the exit threshold.")))
    return out.when(d == "EXIT", by_state(LEAVING, F.lit("Left: the forecast fell below the exit threshold."))).when(d == "NO_TRADE", by_state(STAYING_OUT, weak))


def signal_reasons(signals: DataFrame) -> DataFrame:
    """signals with the reason of each decision."""
    return signals.withColumn("reason", decision_reason())


def signal_summary(signals: DataFrame, top: int = 5) -> DataFrame:
    """Per symbol and model the most frequent pairs of decision and risk state: their share, signed (kept or bought above 0), with the first
    day's reason."""
    keys = ["symbol", "model"]
    rows = signal_reasons(signals)
    counts = rows.groupBy(*keys, "decision", "risk_state").agg(F.count(F.lit(1)).alias("days"), F.min_by("reason", "Date").alias("reason"))
    whole = Window.partitionBy(*keys)
    share = F.col("days") / F.sum("days").over(whole)
    out = counts.withColumns({"importance": share, "place": F.row_number().over(whole.orderBy(F.desc("days"), "decision", "risk_state"))}).where(F.col("place") <= top)
    return out.withColumns({
        "feature": F.concat(F.lit("Signal_"), "risk_state"), "readable": by_state(READABLE, F.col("risk_state")),
        "contribution": F.when(F.col("decision").isin("BUY", "HOLD"), F.col("importance")).otherwise(-F.col("importance")), "reason": F.concat(F.col("days").cast("string"), F.lit(" days: "), "reason"),
    })


def trade_explanations(trades: DataFrame) -> DataFrame:
    """trades(model, net_return, exit_reason, ...) with outcome and a sentence."""
    outcome = F.when(F.col("net_return") > 0, "gain").when(F.col("net_return") < 0, "loss").otherwise("even")
    out = trades.withColumn("outcome", outcome)
    return out.withColumn("explanation", F.concat("model", F.lit(" closed with a "), "outcome", F.lit(" after "), F.col("holding_bars").cast("string"), F.lit(" bars; exit: "), "exit_reason"))


def fold_importance(importances: DataFrame, top: int | None = None) -> DataFrame:
    """importances(symbol, model, fold, feature, importance): the mean over the folds in which the model has it, how many these are, and the
    place."""
    out = importances.groupBy("symbol", "model", "feature").agg(F.avg("importance").alias("importance"), F.count(F.lit(1)).alias("folds"))
    w = Window.partitionBy("symbol", "model").orderBy(F.desc_nulls_last("importance"), "feature")
    out = out.withColumn("place", F.row_number().over(w))
    return out if top is None else out.where(F.col("place") <= top)


def explain(predictions: DataFrame, families: DataFrame, contributions: dict[str, DataFrame], top: int = 3) -> DataFrame:
    """The newest prediction of each symbol and model explained by its family: the strongest contributions where the family has a table of them
    (family -> symbol, model, feature, contribution), else one rule-based row. Columns: symbol, model, method, place, feature, contribution, reason.
    """
    newest = predictions.groupBy("symbol", "model").agg(F.max_by("y_pred", "Date").alias("y_pred")).join(F.broadcast(families), "model", "left")
    newest = newest.withColumn("family", F.coalesce("family", F.lit("rule_based")))
    direction = F.when(F.col("y_pred") > 0, "up").when(F.col("y_pred") < 0, "down").otherwise("level")
    parts = []
    for family, table in contributions.items():
        w = Window.partitionBy("symbol", "model").orderBy(F.desc(F.abs("contribution")), "feature")
        best = table.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
        own = newest.where(F.col("family") == family).join(best, ["symbol", "model"])
        reason = F.concat("feature", F.lit(" moves the forecast "), F.when(F.col("contribution") >= 0, "up").otherwise("down"))
        parts.append(own.select("symbol", "model", F.lit(family).alias("method"), "place", "feature", "contribution", reason.alias("reason")))
    ruled = newest.where(~F.col("family").isin(list(contributions))) if contributions else newest
    text = F.concat("model", F.lit(" expects the price to go "), direction)
    out = ruled.select("symbol", "model", F.lit("rule_based").alias("method"), F.lit(1).alias("place"), F.lit("Model_Summary").alias("feature"), F.col("y_pred").alias("contribution"), text.alias("reason"))
    for p in parts:
        out = out.unionByName(p)
    return out


def quality_flags(symbols: DataFrame, anomalies: DataFrame, survivors: DataFrame, drift: DataFrame, clip_rate: Column, least_days: int = 730, limit: float = 0.25) -> DataFrame:
    """One row a symbol: anomaly (anomalies: symbol, anomaly), short or broken history (survivors of quality.survivorship), PSI by feature (drift:
    symbol, feature, psi), its maximum and whether it is over the limit, and the clip rate."""
    worst = drift.groupBy("symbol").agg(F.max("psi").alias("psi_max"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "psi")))).alias("psi_scores"))
    broken = survivors.select("symbol", (F.col("short_history") | F.col("gap_found")).alias("survivorship_warning"))
    out = symbols.select("symbol").distinct().join(anomalies.select("symbol", F.col("anomaly").alias("corporate_action_anomaly")), "symbol", "left").join(broken, "symbol", "left").join(worst, "symbol", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumns({
        "corporate_action_anomaly": no(F.col("corporate_action_anomaly")), "survivorship_warning": no(F.col("survivorship_warning")), "psi_max": F.coalesce("psi_max", F.lit(0.0)), "psi_high": no(F.col("psi_max") > limit), "clip_rate": clip_rate,
    })


def answers(best: DataFrame, forecasts: DataFrame, freshness: DataFrame, drift: DataFrame, peers: DataFrame, confident) -> DataFrame:
    """One nested row a symbol: model, forecast, performance, freshness, drift, confidence with reasons and warnings, peer, status.

    best(symbol, model, dir_acc, rmse_ratio, stability, diagnosis, eligibility, composite), forecasts(symbol, path_return, label, agreement),
    freshness(symbol, last_date, stale), drift(symbol, psi_max, tier), peers(symbol, peer_label, peer_percentile); any of them may lack a symbol
    that best has. confident is leaderboard.confidence. Moderate drift takes high to medium; good numbers are named where confidence is not low.
    """
    out = best.join(forecasts, "symbol", "left").join(freshness, "symbol", "left").join(drift, "symbol", "left").join(peers, "symbol", "left")
    nothing = F.lit(None).cast("boolean")
    rows = out.withColumns({
        "psi_high": F.coalesce(F.col("tier") == "major_drift", F.lit(False)), "corporate_action": nothing, "degraded": nothing, "rolling_ratio": F.lit(None).cast("double"), "regime_misaligned": nothing,
    })
    rows = confident(rows)
    moderate = F.coalesce(F.col("tier") == "moderate_drift", F.lit(False))
    label = F.when(moderate & (F.col("confidence") == "high"), "medium").otherwise(F.col("confidence"))
    good = F.array_compact(F.array(
        F.when(F.col("dir_acc") >= 55, F.lit("direction above 55")), F.when(F.col("rmse_ratio") < 1, F.lit("error below the benchmark")), F.when(F.col("stability") >= 0.5, F.lit("steady folds")), F.when(F.col("agreement") >= 5 / 7, F.lit("models agree")),
    ))
    reasons = F.when(F.col("block").isNotNull(), F.array("block")).otherwise(F.concat("soft_reasons", good))
    warnings = F.array_compact(F.array(F.when(F.coalesce("stale", F.lit(False)), F.lit("stale_data")), F.when(moderate, F.format_string("data_drift_moderate:psi=%.3f", "psi_max")), F.when(F.col("psi_high"), F.format_string("data_drift_major:psi=%.3f", "psi_max"))))
    status = F.when(F.col("label").isNull(), "no_forecast").when(F.coalesce("stale", F.lit(False)), "stale").otherwise("ready")
    return rows.select(
        "symbol", F.struct("model", "composite").alias("model"), F.struct("path_return", "label", "agreement").alias("forecast"), F.struct("dir_acc", "rmse_ratio", "stability").alias("performance"),
        F.struct("last_date", "stale").alias("freshness"), F.struct("tier", "psi_max").alias("drift"), F.struct(label.alias("label"), reasons.alias("reasons"), warnings.alias("warnings")).alias("confidence"),
        F.struct("peer_label", "peer_percentile").alias("peer"), status.alias("status"),
    )


def table_counts(spark, tables: dict[str, DataFrame | None], expected: Sequence[str]) -> DataFrame:
    """table, rows, missing of the expected tables; those that are not there have no rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items() if df is not None]
    names = spark.createDataFrame([(n,) for n in expected], "table string")
    for k, p in enumerate(parts):
        found = p if k == 0 else found.unionByName(p)
    out = names.join(found, "table", "left") if parts else names.withColumn("rows", F.lit(None).cast("long"))
    return out.withColumn("missing", F.col("rows").isNull())
