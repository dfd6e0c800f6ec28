"""Tables that rank, label and explain: leaderboards, diagnoses, drift, regime, peer tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import full, last_rows, over_time
from tidemark.operators.features import drift_features
from tidemark.operators.selection import trend_tendency
from tidemark.operators.xsection import composite_icir, peer_confidence


def feature_group(name: Column) -> Column:
    """Group of a feature by its name."""
    rules = (("momentum", "(?i)rsi|macd|stoch|mom|mfi|cmf|adx"), ("trend", "(?i)sma|ema|regime"), ("volatility", "(?i)std|bb_|natr|atr|vol$|tr_rel"), ("volume", "(?i)obv|vwap|volume|liq"), ("lag", "(?i)lag"), ("calendar", "(?i)day|month|quarter|event"), ("macro", "(?i)rate|cpi|market|turnover"))
    out = F.when(F.lit(False), "")
    for group, pattern in rules:
        out = out.when(name.rlike(pattern), group)
    return out.otherwise("other")


def json_series(rows: DataFrame, text: str, dates: tuple[str, ...] = ("Tarih", "Date")) -> DataFrame:
    """JSON items to (Date text, value): a date key, the first other key's value, comma decimals; blanks and dashes go."""
    pairs = F.filter(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: ~e["key"].isin(*dates))
    value = F.regexp_replace(F.get(pairs, F.lit(0))["value"], ",", ".").try_cast("double")
    day = F.coalesce(*[F.get_json_object(text, f"$.{d}") for d in dates])
    return rows.withColumns({"item_date": day, "item_value": value}).where(F.col("item_value").isNotNull())


def drift_tiers(bars: DataFrame, recent: int = 30, before: int = 252, bins: int = 3) -> DataFrame:
    """Per symbol the largest stability index of the drift features, the last rows against those before, with its tier and, where there is
    none, the reason."""
    names = ["logret", "range_rel", "dlog_volume"]
    whole = Window.partitionBy("symbol")
    rows = drift_features(bars).withColumns({"_k": F.row_number().over(whole.orderBy(F.desc("Date"))), "_n": F.count(F.lit(1)).over(whole)})
    short = F.when(F.col("_n") < recent + before // 4, "insufficient_history").when(F.col("_n") < 2 * recent, "insufficient_train_window")
    state = bars.select("symbol").distinct().join(rows.groupBy("symbol").agg(F.max("_n").alias("_n")), "symbol", "left")
    state = state.select("symbol", F.when(F.col("_n").isNull(), "insufficient_history").otherwise(short).alias("reason"))
    rows = rows.where((F.col("_k") <= recent + before) & short.isNull())
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])
    long = rows.select("symbol", (F.col("_k") <= recent).alias("new"), F.explode(pairs).alias("x")).select("symbol", "new", "x.*")
    size = Window.partitionBy("symbol", "feature")
    low, high = F.min("value").over(size), F.max("value").over(size)
    place = F.floor((F.col("value") - low) / F.nullif(high - low, F.lit(0.0)) * bins).cast("int") + 1
    placed = long.withColumn("bin", F.least(F.lit(bins), F.coalesce(place, F.lit(1))))
    counts = placed.groupBy("symbol", "feature", "bin").agg(F.count_if("new").alias("h"), F.count_if(~F.col("new")).alias("t"))
    every = counts.select("symbol", "feature").distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins)))).join(counts, ["symbol", "feature", "bin"], "left")
    t, h = (F.when(F.coalesce(c, F.lit(0)) > 0, F.col(c) / F.sum(c).over(size)).otherwise(1e-4) for c in ("t", "h"))
    found = every.withColumn("part", (h - t) * F.log(h / t)).groupBy("symbol", "feature").agg(F.greatest(F.lit(0.0), F.sum("part")).alias("psi"))
    out = state.join(found.groupBy("symbol").agg(F.max("psi").alias("psi_max")), "symbol", "left")
    tier = F.when(F.col("psi_max").isNull(), "unavailable").when(F.col("psi_max") < 0.1, "stable").when(F.col("psi_max") < 0.25, "moderate_drift").otherwise("major_drift")
    return out.withColumn("tier", tier)


def regime_context(bars: DataFrame) -> DataFrame:
    """Bull, bear, sideways or uncertain from the close against its 50- and 200-row means and from the slope of the last 20 closes over their
    mean; without 200 rows from the shorter mean and the slope alone."""
    close, slope = F.col("Close"), F.col("slope")
    n = F.row_number().over(over_time()).cast("double")
    out = bars.withColumns({"_n": n, "_s": full(F.avg("Close"), close, 50), "_l": full(F.avg("Close"), close, 200)})
    w = last_rows(20)
    out = out.withColumn("slope", F.when(F.count("Close").over(w) >= 20, F.regr_slope("Close", "_n").over(w) / (F.avg("Close").over(w) + 1e-9)))
    s, long = F.col("_s"), F.col("_l")
    brief = F.when((close > s) & (slope > 0), "bull").when((close <= s) & (slope < 0), "bear").otherwise("uncertain")
    whole = F.when((close > s) & (close > long) & (s > long) & (slope > 0), "bull").when((close <= s) & (close <= long) & (s <= long) & (slope < 0), "bear")
    whole = whole.when(F.abs(slope) < 0.001, "sideways").otherwise("uncertain")
    return out.withColumn("regime", F.when(s.isNull(), "uncertain").when(long.isNull(), brief).otherwise(whole)).drop("_n", "_s", "_l")


def strength_against(bars: DataFrame, index: DataFrame, rows: int = 60, least: int = 5, limit: float = 0.02) -> DataFrame:
    """Whether a symbol's return over its last `rows` rows is above or below the index's over its own; inline where either has few rows.
    index(Date, index_close): one row a date; each is told as of the symbol's newest date."""

    def last_of(df: DataFrame, value: str, *keys: str) -> DataFrame:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("Date"))
        kept = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= rows)
        found = kept.groupBy(*keys).agg((F.max_by(value, "Date") / F.min_by(value, "Date") - 1).alias(f"{value}_return"), F.count(F.lit(1)).alias(f"{value}_rows"))
        return found

    both = last_of(bars, "Close", "symbol").crossJoin(F.broadcast(last_of(index, "index_close")))  # one row
    gap = F.col("Close_return") - F.col("index_close_return")
    enough = F.least("Close_rows", "index_close_rows") >= least
    label = F.when(enough & (gap > limit), "outperforming").when(enough & (gap < -limit), "underperforming").otherwise("inline")
    return both.select("symbol", gap.alias("return_gap"), label.alias("relative_strength"))


def alignment(regime: Column, direction: Column) -> Column:
    """Whether a forecast goes with the market's regime."""
    up, down = direction > 0, direction < 0
    return F.when(((regime == "bull") & up) | ((regime == "bear") & down), "aligned").when(((regime == "bull") & down) | ((regime == "bear") & up), "misaligned").otherwise("neutral")


def normal_cdf(x: Column) -> Column:
    """The one function that Spark lacks, as a pandas UDF; it sees a row a series."""

    def cdf(v: pd.Series) -> pd.Series:
        return v.map(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))), na_action="ignore")

    return F.pandas_udf(cdf, "double")(x)


def deflated_sharpe(curve: DataFrame, trials: int) -> DataFrame:
    """Per series: annual Sharpe less what the best of so many trials shows by chance, in standard errors of a Sharpe, and the percentage of a
    normal distribution below what is left; 0 under three rows."""
    r = F.col("net_return")
    sr = F.coalesce(F.avg(r) / F.nullif(F.stddev_pop(r), F.lit(0.0)) * math.sqrt(252), F.lit(0.0))
    out = curve.groupBy("symbol", "model").agg(F.count(r).alias("n"), sr.alias("sr"))
    error = F.sqrt(F.greatest(F.lit(1e-12), (1 + 0.5 * F.col("sr") * F.col("sr")) / F.col("n")))
    luck = math.sqrt(2 * math.log(trials)) if trials > 1 else 0.0
    few = F.col("n") < 3
    out = out.withColumns({"error": error, "deflated": F.when(few, 0.0).otherwise(F.col("sr") - luck * error)})
    return out.withColumn("score", F.when(few, 0.0).otherwise(100 * normal_cdf(F.col("deflated") / F.col("error"))))


def diagnosis(summary: DataFrame, min_trades: int = 6) -> DataFrame:
    """Labels of what is wrong with a backtest, joined by commas, or ok. Optional columns: rejected (the calibration found no trial), and
    current_trades, current_net, alternative_trades, alternative_net (the same model under its own and under laxer gates)."""
    found = [
        F.when(F.col("total_return") <= F.col("buyhold_return"), F.lit("underperform_buyhold")),
        F.when(F.col("trade_count") < min_trades, F.lit("insufficient_trades")),
        F.when(F.col("sharpe") <= 0, F.lit("model_signal_weak")),
    ]
    if "rejected" in summary.columns:
        found.append(F.when(F.col("rejected"), F.lit("rejected_no_trade")))
    if "alternative_trades" in summary.columns:
        better = F.col("current_net").isNull() | (F.col("alternative_net") > F.col("current_net"))
        found.append(F.when((F.col("alternative_trades") > F.col("current_trades")) & better, F.lit("gate_too_strict")))
    labels = F.array_compact(F.array(*found))
    return summary.withColumn("diagnosis", F.when(F.size(labels) == 0, "ok").otherwise(F.concat_ws(",", labels)))


def gate_diagnostics(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per model and threshold how many predictions would buy, their share and the median prediction."""
    long = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return long.groupBy("model", "threshold").agg(F.count_if(F.col("y_pred") > F.col("threshold")).alias("would_buy"), F.avg((F.col("y_pred") > F.col("threshold")).cast("double")).alias("share"), F.percentile("y_pred", F.lit(0.5)).alias("median_pred"))


def sector_summary(board: DataFrame) -> DataFrame:
    """Per sector: symbols, reliable rows, mean gap and the models seen, most frequent first."""
    counts = board.groupBy("sector", "model").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.groupBy("sector").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "model"))), lambda x: x["model"])).alias("models"))
    return board.groupBy("sector").agg(F.count_distinct("symbol").alias("symbols"), F.count_if(F.col("composite") >= 50).alias("strong"), F.avg("composite").alias("mean_composite")).join(seen, "sector")


def peer_table(scores: DataFrame, segments: DataFrame, ic_by: dict[str, DataFrame], weights: dict[str, float], floor: float) -> DataFrame:
    """Scores (with `stale`) with segments, blended segment ICIR, gates, confidence and trend. ic_by: column of segments to segment_ic() rows."""
    out = scores.join(segments, "symbol", "left")
    for column, table in ic_by.items():
        out = out.join(table.select(F.col("segment").alias(column), F.col("icir").alias(f"icir_{column}")), column, "left")
    out = composite_icir(out, {f"icir_{c}": w for c, w in weights.items()})
    out = peer_confidence(out.withColumn("tradable", F.coalesce(F.col("liq_med") >= floor, F.lit(False))))
    return trend_tendency(out)


def residual_quantiles(train: DataFrame, test: DataFrame, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Quantile forecasts of test rows: the point forecast plus quantiles of each symbol's training residuals, in order."""
    q = train.groupBy("symbol").agg(F.percentile(F.col("y_true") - F.col("y_pred"), F.array(*[F.lit(s) for s in shares])).alias("_q"))
    out = test.join(q, "symbol")
    ordered = F.array_sort(F.transform("_q", lambda x: x + F.col("y_pred")))
    return out.withColumns({f"q_{int(s * 100)}": F.get(ordered, F.lit(i)) for i, s in enumerate(shares)}).drop("_q")


def stacker_weights(predictions: DataFrame, models: list[str], alpha: float = 1.0) -> DataFrame:
    """Ridge of y_true on the models' predictions without intercept, negatives to 0, summing to 1. Sums of products by Spark, a k x k solve here."""
    import numpy as np

    wide = predictions.groupBy("symbol", "Date").pivot("model", models).agg(F.first("y_pred")).join(predictions.groupBy("symbol", "Date").agg(F.first("y_true").alias("_y")), ["symbol", "Date"]).na.drop()
    k = len(models)
    sums = wide.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(models) for j, b in enumerate(models) if i <= j], *[F.sum(F.col(a) * F.col("_y")).alias(f"y_{i}") for i, a in enumerate(models)]).first()
    gram = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    w = np.maximum(np.linalg.solve(gram + alpha * np.eye(k), [sums[f"y_{i}"] or 0.0 for i in range(k)]), 0)
    w = w / w.sum() if w.sum() > 0 else np.full(k, 1 / k)
    return predictions.sparkSession.createDataFrame([(m, float(x)) for m, x in zip(models, w, strict=True)], "model string, weight double")
