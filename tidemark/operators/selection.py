"""Scores, eligibility and choice of models; scaling, codes and pruning of features; parameter grids; attributions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import percentile
from tidemark.operators.backtest import recommendation

#: Fixed values of the score, and of the calibrated trend (chance of a rise and mean return by quintile).
WEIGHTS = {"error": 0.30, "relative_direction": 0.25, "direction": 0.20, "hit": 0.15, "sharpe": 0.10}
QUINTILE_PROB_UP = (0.435, 0.487, 0.509, 0.519, 0.541)
QUINTILE_EXPECTED_RETURN = (-0.0066, 0.0032, 0.0050, 0.0062, 0.0090)


def composite(metrics: DataFrame) -> DataFrame:
    """0 to 100 from error and direction against the benchmark, direction, hits (both in percent) and Sharpe excess (unknown: 50), less a
    penalty for neutral rows; 49 at most when worse than the benchmark or not eligible to lead (column `can_lead`, where there is one)."""

    def clip(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))

    ratio = F.greatest(F.coalesce("rmse_ratio", F.lit(1.0)), F.lit(1e-8))
    parts = {
        "error": F.least(F.lit(100.0), 100 / ratio),
        "relative_direction": clip(50 + 4 * F.coalesce("dir_acc_gain", F.lit(0.0))),
        "direction": clip(F.coalesce("dir_acc", F.lit(0.0))),
        "hit": clip(F.coalesce("hit_rate", F.lit(0.0))),
        "sharpe": F.coalesce((F.tanh(F.col("sharpe_excess") / 1.5) + 1) * 50, F.lit(50.0)),
    }
    total = reduce(lambda a, b: a + b, [w * parts[k] for k, w in WEIGHTS.items()])
    total = total - F.least(F.lit(15.0), 0.15 * F.coalesce("neutral_rate", F.lit(0.0)))
    capped = ratio > 1
    if "can_lead" in metrics.columns:
        capped = capped | ~F.coalesce("can_lead", F.lit(True))
    return metrics.withColumn("composite", F.round(F.greatest(F.lit(0.0), F.when(capped, F.least(total, F.lit(49.0))).otherwise(total)), 4))


def eligibility(metrics: DataFrame, min_trades: int = 8) -> DataFrame:
    reason = F.when(~F.col("is_candidate"), "not_candidate").when(F.col("rmse_ratio") > 1, "benchmark_failed").when(F.col("trade_count") < min_trades, "low_trades").otherwise("eligible")
    return metrics.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "eligible")


def best_models(experiments: DataFrame) -> DataFrame:
    """Per symbol the best logged model: eligible first, then score, time, id."""
    w = Window.partitionBy("symbol").orderBy(F.desc("eligible"), F.desc_nulls_last("composite"), F.desc("trained_at"), F.desc("id"))
    return experiments.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def leaderboard(experiments: DataFrame, n: int) -> DataFrame:
    return experiments.orderBy(F.desc_nulls_last("composite"), "symbol", "model").limit(n)


def trend_tendency(peers: DataFrame, high: float = 70.0, low: float = 30.0, min_universe: int = 15) -> DataFrame:
    """Quintile of the percentile, its calibrated chance of a rise and expected return, and a band label; none in a thin universe."""
    p = F.col("peer_percentile")
    known = (F.coalesce("universe_size", F.lit(0)) >= min_universe) & p.isNotNull()
    q = F.greatest(F.lit(0), F.least(F.lit(4), F.floor(p / 20).cast("int")))
    band = F.when(~known, "uncertain").when(p >= high, "up").when(p <= low, "down").otherwise("flat")
    chance, expected = (F.when(known, F.get(F.array(*[F.lit(x) for x in fixed]), q)) for fixed in (QUINTILE_PROB_UP, QUINTILE_EXPECTED_RETURN))
    return peers.withColumns({"trend_label": band, "trend_prob_up": chance, "trend_expected_return": expected})


def codes(panel: DataFrame, column: str, out: str) -> DataFrame:
    """Dense codes of the sorted distinct labels, from 0."""
    labels = panel.select(column).where(F.col(column).isNotNull()).distinct()
    coded = labels.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(column)) - 1)  # a row a label
    return panel.join(coded, column, "left")


def scale(rows: DataFrame, columns: list[str], how: str = "robust", limit: float = 5.0) -> DataFrame:
    """Scaled by what the training rows (role = 'train') show; robust values are clipped. One aggregate row joins back."""
    train = F.col("role") == "train"
    stats = []
    for c in columns:
        x = F.when(train, F.col(c))
        pair = {"robust": (percentile(x, 0.5), percentile(x, 0.75) - percentile(x, 0.25)), "standard": (F.avg(x), F.stddev_pop(x)), "minmax": (F.min(x), F.max(x) - F.min(x))}[how]
        stats += [pair[0].alias(f"_{c}_at"), pair[1].alias(f"_{c}_by")]
    one = rows.agg(*stats)
    out = rows.crossJoin(F.broadcast(one))  # one row
    for c in columns:
        z = (F.col(c) - F.col(f"_{c}_at")) / F.when(F.col(f"_{c}_by") > 0, F.col(f"_{c}_by")).otherwise(1.0)
        out = out.withColumn(f"{c}_z", F.when(z.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), z))) if how == "robust" else z).drop(f"_{c}_at", f"_{c}_by")
    return out


def prune_correlated(rows: DataFrame, columns: list[str], threshold: float) -> list[str]:
    """Of each group of columns connected by |correlation| above the threshold, the one with the least mean |correlation| stays.

    One pass of pairwise aggregates over the rows; the k x k graph is the driver's.
    """
    pairs = list(combinations(columns, 2))
    found = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    size = {p: abs(found[f"{p[0]}|{p[1]}"] or 0.0) for p in pairs}
    group = {c: {c} for c in columns}
    for (a, b), r in size.items():
        if r > threshold and group[a] is not group[b]:
            merged = group[a] | group[b]
            for c in merged:
                group[c] = merged
    mean = {c: np.mean([r for p, r in size.items() if c in p]) if len(columns) > 1 else 0.0 for c in columns}
    return [c for c in columns if c == min(group[c], key=lambda x: (mean[x], columns.index(x)))]


def grid(spark, values: dict[str, list]) -> DataFrame:
    """Every combination of the values, with a trial number that depends on the combination alone."""
    out = spark.range(1).select(*[F.array(*[F.lit(v) for v in vs]).alias(k) for k, vs in values.items()])
    for k in values:
        out = out.withColumn(k, F.explode(k))
    return out.withColumn("trial", F.xxhash64(*values))


def trial_runs(rows: DataFrame, trials: DataFrame, cost_bps: float = 15) -> DataFrame:
    """Each trial (buy, sell) as a switch on every series, one row a trial and series: compounded net and buy-and-hold return, annual Sharpe,
    drawdown of the curve, and entries. The grid is the parallel axis."""
    both = rows.crossJoin(F.broadcast(trials))  # a bounded grid
    keys = ["trial", "symbol", "model"]
    w = Window.partitionBy(*keys).orderBy("Date")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("y_pred") > F.col("buy"), 1).when(F.col("y_pred") < -F.col("sell"), 0)
    out = both.withColumn("_m", mark).withColumn("position", F.coalesce(F.last("_m", ignorenulls=True).over(past), F.lit(0)))
    before = F.coalesce(F.lag("position").over(w), F.lit(0))
    closing = F.when(F.lead("Date").over(w).isNull(), F.col("position")).otherwise(0)
    out = out.withColumns({"sides": F.abs(F.col("position") - before) + closing, "entry": F.greatest(F.col("position") - before, F.lit(0))})
    out = out.withColumn("net", F.col("position") * F.col("realized_return") - F.col("sides") * cost_bps / 1e4)
    grown = F.when(F.min(1 + F.col("net")).over(past) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.when(F.col("net") > -1, 1 + F.col("net")))).over(past)))
    out = out.withColumn("_equity", grown).withColumn("_fall", F.col("_equity") / F.greatest(F.max("_equity").over(past), F.lit(1e-12)) - 1)
    sharpe = F.coalesce(F.avg("net") / F.nullif(F.stddev_pop("net"), F.lit(0.0)) * 252**0.5, F.lit(0.0))
    held = F.col("realized_return")
    hold = F.when(F.min(1 + held) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.when(held > -1, 1 + held)))))
    return out.groupBy(*keys).agg((F.max_by("_equity", "Date") - 1).alias("net_return"), (hold - 1).alias("buyhold_return"), sharpe.alias("sharpe"), F.min("_fall").alias("max_drawdown"), F.sum("entry").alias("trade_count"))


def risk_adjusted_score(net: Column, excess: Column, sharpe: Column, drawdown: Column) -> Column:
    return 0.35 * net + 0.25 * excess + 0.25 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sharpe / 3)) + 0.15 * (1 + drawdown)


def summarize_trials(runs: DataFrame, min_trades: int | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a trial (of each key): means over its series, trades in all, and the risk-adjusted score. min_trades: a number, or an aggregate."""
    least = F.max(F.lit(min_trades)) if isinstance(min_trades, int) else min_trades
    out = runs.groupBy(*keys, "trial").agg(
        least.alias("_least"),
        F.count(F.lit(1)).alias("series"), F.avg("net_return").alias("net"), F.avg("buyhold_return").alias("hold"), F.avg(F.col("net_return") - F.col("buyhold_return")).alias("excess"),
        F.avg("max_drawdown").alias("drawdown"), F.avg("sharpe").alias("sharpe"), F.sum("trade_count").alias("trades"), F.count_if(F.col("net_return") > F.col("buyhold_return")).alias("beats_hold"),
    )
    score = risk_adjusted_score(F.col("net"), F.col("excess"), F.col("sharpe"), F.col("drawdown"))
    return out.withColumns({"score": score, "enough_trades": F.col("trades") >= F.col("_least")}).drop("_least")


def confirm_trials(evaluated: DataFrame, min_trades: int | Column, min_excess: float = 0.0, min_sharpe: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Out-of-sample summaries of trials with the reasons that reject them, joined by commas."""
    rules = (F.col("excess") <= min_excess, "eval_excess_return_below_min"), (F.col("sharpe") <= min_sharpe, "eval_sharpe_below_min"), (F.col("trades") < min_trades, "eval_trade_count_below_min")
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))
    names = {c: f"eval_{c}" for c in ("net", "hold", "excess", "sharpe", "drawdown", "trades")}
    return evaluated.select(*keys, "trial", *[F.col(c).alias(n) for c, n in names.items()], F.concat_ws(",", reasons).alias("reject_reason"), (F.size(reasons) == 0).alias("oos_passed"))


def choose_trial(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Trials in order of choice: confirmed ones with enough trades and excess first, then those with enough trades, then those that traded."""
    confirmed = F.col("enough_trades") & (F.col("excess") > 0) & F.coalesce("oos_passed", F.lit(False))
    tier = F.when(confirmed, 0).when(F.col("enough_trades"), 1).when(F.col("trades") > 0, 2).otherwise(3)

    def only(when: Column, c: str) -> Column:
        return F.desc_nulls_last(F.when(when, F.col(c)))

    t = F.col("_t")
    order = [t, only(t == 2, "trades"), F.desc_nulls_last("score"), only(t == 0, "eval_excess"), only(t == 0, "eval_sharpe"), only(t == 0, "drawdown")]
    order += [F.desc_nulls_last(c) for c in ("excess", "net", "drawdown", "trades")]
    w = Window.partitionBy(*(keys or (F.lit(0),))).orderBy(*order, "trial")  # a row a trial
    return rows.withColumn("_t", tier).withColumns({"place": F.row_number().over(w), "choice": F.element_at(F.array(*[F.lit(x) for x in ("confirmed", "enough_trades", "traded", "none")]), F.col("_t") + 1)}).drop("_t")


def should_expand(rows: DataFrame, complete: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (a key): whether the grid is to be expanded, from the summaries and the first in order of choice."""
    best = F.min_by(F.struct("enough_trades", "excess", "sharpe"), "place")
    one = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("enough_trades").alias("valid"), best.alias("b"))
    weak = (F.col("n") == 0) | F.lit(not complete) | ~F.col("b.enough_trades") | (F.col("b.excess") <= 0) | (F.col("b.sharpe") <= 0)
    few = F.col("valid") < F.greatest(F.lit(1), F.ceil(F.col("n") * 0.15))
    return one.select(*keys, "n", "valid", (weak | few).alias("expand"))


def quality_thresholds(folds: DataFrame, least_rows: int = 3) -> DataFrame:
    """One row: direction floor (25 % quantile, 52 at least), error ceiling (75 % quantile, 1.05 at most), score floor (25 %, 30 at least);
    the defaults 52, 1.05 and 50 where there are too few fold rows."""
    q = {c: F.percentile(c, F.lit(share)) for c, share in (("dir_acc", 0.25), ("rmse_ratio", 0.75), ("composite", 0.25))}
    n = F.count(F.lit(1))
    enough = n >= least_rows
    return folds.agg(
        n.alias("fold_rows"), F.round(F.when(enough, F.greatest(F.lit(52.0), q["dir_acc"])).otherwise(52.0), 2).alias("min_dir_acc"),
        F.round(F.when(enough, F.least(F.lit(1.05), q["rmse_ratio"])).otherwise(1.05), 4).alias("max_rmse_ratio"),
        F.round(F.when(enough, F.greatest(F.lit(30.0), q["composite"])).otherwise(50.0), 4).alias("min_composite"),
        F.when(enough, "applied").otherwise("skipped_insufficient_calibration_folds").alias("status"),
    )


#: Settings of the position machine: fixed default values.
PROFESSIONAL = {
    "entry_cost": 2.0, "exit_cost": 1.0, "entry_vol": 0.25, "exit_vol": 0.05, "min_hold": 3, "max_hold": 20, "take_vol": 1.5, "stop_vol": 1.0,
    "cooldown": 2, "min_entry": 0.0, "quality": 1.0, "emergency_stop": True, "commission_bps": 10.0, "slippage_bps": 5.0,
}


def signal_thresholds(rows: DataFrame, volatility: DataFrame, **settings) -> DataFrame:
    """rows(symbol, model, Date, y_pred, ret, rolling_vol, regime) with the entry and exit thresholds: costs or volatility, whichever is more,
    times the quality, regime and volatility multipliers. volatility: symbol, model, Date, multiplier."""
    c = PROFESSIONAL | settings
    cost = (c["commission_bps"] + c["slippage_bps"]) / 1e4
    out = rows.join(volatility.withColumnRenamed("multiplier", "volatility_multiplier"), ["symbol", "model", "Date"])
    base = F.greatest(F.lit(cost * c["entry_cost"]), F.col("rolling_vol") * c["entry_vol"], F.lit(c["min_entry"]))
    regime = F.when(F.col("regime") > 0, 0.85).when(F.col("regime") < 0, 1.25).otherwise(1.0)
    out = out.withColumns({"base_entry_threshold": base, "regime_multiplier": regime})
    out = out.withColumn("final_multiplier", F.lit(c["quality"]) * F.col("regime_multiplier") * F.col("volatility_multiplier"))
    out = out.withColumn("entry_threshold", F.col("base_entry_threshold") * F.col("final_multiplier"))
    out = out.withColumn("exit_threshold", F.greatest(F.lit(cost * c["exit_cost"]), F.col("rolling_vol") * c["exit_vol"]))
    return out.withColumn("signal_strength", F.col("y_pred") / F.greatest("entry_threshold", F.lit(1e-12)))


DECIDED = "decision string, risk_state string, position int, holding_bars int, trade_return double, take_profit double, stop_loss double, cooldown_remaining int"


def professional_signals(rows: DataFrame, **settings) -> DataFrame:
    """The path-dependent position machine over signal_thresholds(); one series a group, in date order.

    A position gains what was observed after its entry. Checks while holding, in order: emergency stop, shortest holding time, profit
    taking, stop loss, longest holding time, forecast under the exit threshold. After an exit the series waits.
    """
    c = PROFESSIONAL | settings
    floor = (c["commission_bps"] + c["slippage_bps"]) / 1e4 * c["entry_cost"]

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("Date").reset_index(drop=True)
        entered, gain, wait, out = None, 1.0, 0, []
        columns = zip(df["y_pred"], df["ret"].fillna(0.0), df["rolling_vol"], df["entry_threshold"], df["exit_threshold"], strict=True)
        for i, (expected, ret, vol, enter, leave) in enumerate(columns):
            waiting, held, earned, take, stop = wait, 0, 0.0, None, None
            if entered is not None:
                gain *= 1 + ret
                held, earned = i - entered, gain - 1
                take, stop = max(c["take_vol"] * vol, floor), -max(c["stop_vol"] * vol, floor)
                stopped = earned <= stop
                if stopped and c["emergency_stop"]:
                    state = "stop_loss"
                elif held < c["min_hold"]:
                    state = "min_hold"
                elif earned >= take:
                    state = "take_profit"
                elif stopped:
                    state = "stop_loss"
                elif held >= c["max_hold"]:
                    state = "max_hold"
                else:
                    state = "weak_signal" if expected < leave else "in_position"
                decision = "HOLD" if state in ("min_hold", "in_position") else "EXIT"
                if decision == "EXIT":
                    entered, wait = None, c["cooldown"]
            elif wait > 0:
                decision, state, wait = "NO_TRADE", "cooldown", wait - 1
            elif expected > enter:
                decision, state, entered, gain = "BUY", "entry_ok", i, 1.0
                take, stop = max(c["take_vol"] * vol, floor), -max(c["stop_vol"] * vol, floor)
            else:
                decision, state = "NO_TRADE", "below_threshold"
            out.append((decision, state, int(entered is not None), held, earned, take, stop, waiting))
        found = pd.DataFrame(out, columns=[x.split(" ")[0] for x in DECIDED.split(", ")])
        found = found.astype({"position": "int32", "holding_bars": "int32", "cooldown_remaining": "int32", "take_profit": "float64", "stop_loss": "float64"})
        return pd.concat([df, found], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.groupBy("symbol", "model").applyInPandas(run, f"{schema}, {DECIDED}")
    return out.withColumn("recommendation", recommendation(F.col("decision"), F.col("y_pred"), F.col("entry_threshold")))


def expanding_volatility_multiplier(rows: DataFrame, window: int = 20) -> DataFrame:
    """0.85, 1 or 1.25 by where volatility stands among the quantiles of the history so far; one series a group, kept sorted by insertion."""
    import bisect

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("Date")
        past: list[float] = []
        out = []
        for v in df["rolling_vol"]:
            bisect.insort(past, v)
            if len(past) < max(5, window // 2):
                out.append(1.0)
                continue
            low, high = (_quantile(past, q) for q in (0.33, 0.67))
            out.append(0.85 if v <= low else 1.25 if v >= high else 1.0)
        return pd.DataFrame({"symbol": df["symbol"].to_numpy(), "model": df["model"].to_numpy(), "Date": df["Date"].to_numpy(), "multiplier": out})

    return rows.select("symbol", "model", "Date", "rolling_vol").groupBy("symbol", "model").applyInPandas(run, "symbol string, model string, Date date, multiplier double")


def _quantile(ordered: list[float], q: float) -> float:
    at = q * (len(ordered) - 1)
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


def linear_contributions(rows: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """(x - mean) * coefficient in long form."""
    means = rows.agg(*[F.avg(c).alias(f"_{c}") for c in coefficients])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.col(f"_{c}")) * b).alias("contribution")) for c, b in coefficients.items()])
    return rows.crossJoin(F.broadcast(means)).select("symbol", "Date", F.explode(parts).alias("x")).select("symbol", "Date", "x.feature", "x.contribution")  # one row


def top_features(contributions: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k features with the largest mean |contribution|, their direction and share."""
    found = contributions.groupBy(*keys, "feature").agg(F.avg(F.abs("contribution")).alias("importance"), F.avg("contribution").alias("mean"))
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    out = found.withColumns({"place": F.row_number().over(every.orderBy(F.desc("importance"), "feature")), "share": F.col("importance") / F.nullif(F.sum("importance").over(every), F.lit(0.0))})
    return out.where(F.col("place") <= k).withColumn("direction", F.when(F.col("mean") >= 0, "up").otherwise("down")).drop("mean")


def bootstrap_sharpe(returns: DataFrame, replicates: int = 1000, seed: int = 7, at_once: int = 50) -> DataFrame:
    """95 % interval of each series' Sharpe over resamples: a row counts in a replicate as often as a seeded Poisson(1) draw says.

    One grouped pass: a series, as long as its calendar, is held once; draws are made for `at_once` replicates together and summed as products
    of matrices. The draws depend on the seed and the series' name only.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.sort_values("Date", kind="stable")["net_return"].to_numpy(float)
        draw = np.random.default_rng([seed, *"|".join(map(str, key)).encode()])
        found = []
        for first in range(0, replicates, at_once):
            times = draw.poisson(1.0, (min(at_once, replicates - first), len(r)))
            n, s, q = times.sum(1), times @ r, times @ (r * r)
            mean = s / np.maximum(n, 1)
            spread = np.sqrt(np.maximum(q / np.maximum(n, 1) - mean * mean, 0.0))
            found.append(np.divide(mean * 252**0.5, spread, out=np.zeros(len(n)), where=spread > 0))
        low, high = np.quantile(np.concatenate(found), [0.025, 0.975])
        return pd.DataFrame({"symbol": [key[0]], "model": [key[1]], "low": [low], "high": [high]})

    few = returns.where("net_return is not null").select("symbol", "model", "Date", F.col("net_return").cast("double").alias("net_return"))
    return few.groupBy("symbol", "model").applyInPandas(run, "symbol string, model string, low double, high double")
