"""Backtests of many signal settings at once, and the calibration that chooses among them.

A series of predictions is held once; all settings (trials of a grid, scenarios, policies) are arrays over which the position machine runs bar by
bar, so a grid of hundreds of trials is one grouped pass over the series, not a copy of them a trial. Grids are made of a few parameter values and
stay small whatever the data; results are one row a series and setting.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.selection import choose_trial, confirm_trials, should_expand, summarize_trials

#: Settings of a signal: fixed default values.
DEFAULTS: dict[str, float | int | str] = {
    "mode": "professional", "gate": "soft", "buy": 0.0, "sell": 0.0, "entry_cost": 2.0, "exit_cost": 1.0, "entry_vol": 0.25, "exit_vol": 0.05,
    "min_hold": 3, "max_hold": 20, "take_vol": 1.5, "stop_vol": 1.0, "cooldown": 2, "min_entry": 0.0, "multiplier": 1.0,
    "min_dir_acc": 52.0, "max_rmse_ratio": 1.05, "min_composite": 50.0,
}
COSTS = (10.0, 5.0)
#: Fixed values of the soft gate: far-off limits of direction, error and score, and the multipliers of a weak and of a far-off metric.
FAR, WEAK = {"dir_acc": 48.0, "rmse_ratio": 1.10, "composite": 45.0}, (1.25, 1.75)
#: Scenarios of the shadow backtests: name -> settings. Fixed values.
SHADOWS = {
    "simple_current": {"mode": "simple", "gate": "soft"},
    "professional_current": {"mode": "professional", "gate": "hard"},
    "professional_soft_gate": {"mode": "professional", "gate": "soft"},
    "legacy_directional": {"mode": "legacy", "gate": "soft"},
}
#: Policies of signal research: what they ask for beside the defaults. Fixed values.
POLICIES = {
    "V0": {"mode": "simple"},
    "V1": {"mode": "professional"},
    "V2": {"mode": "professional", "min_entry": 0.001, "multiplier": 0.85, "calibrated": True},
    "V3": {"mode": "professional", "max_hold": 15, "cooldown": 1, "calibrated": True, "trades": (8, 20), "exposure": (25, 70)},
    "V4": {"mode": "professional", "min_entry": 0.001, "needs": "sector_strength"},
}
RESULTS = (
    "net_return double, buyhold_return double, sharpe double, max_drawdown double, trade_count long, exposure double, would_buy long, blocked_dir_acc long, "
    "blocked_rmse long, blocked_composite long, below_threshold long, quality_multiplier double, regime_multiplier double, volatility_multiplier double, final_multiplier double"
)


def settings(**changes) -> dict:
    """The defaults with changes; an unknown name or a value out of range is an error."""
    if unknown := set(changes) - set(DEFAULTS):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = DEFAULTS | changes
    if min(out[k] for k in DEFAULTS if k not in ("mode", "gate", "min_dir_acc", "min_composite")) < 0 or not 0 <= out["min_dir_acc"] <= 100:
        raise ValueError(f"settings out of range: {changes}")
    if out["mode"] not in ("professional", "simple", "legacy", "rejected") or out["gate"] not in ("soft", "hard", "off") or out["max_hold"] < out["min_hold"]:
        raise ValueError(f"settings do not fit: {changes}")
    return out


def policy_settings(policy: str) -> dict:
    return settings(**{k: v for k, v in POLICIES[policy].items() if k in DEFAULTS})


def machine(x: dict[str, np.ndarray], c: dict[str, np.ndarray], quality: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (bars by settings) of the professional mode, and on how many bars a free series stayed out for want of a strong forecast.

    A position gains what is observed after its entry. It ends at an emergency stop at once; from the shortest holding time on at the profit
    target, the stop, the longest holding time or a forecast under the exit threshold. Then the series waits.
    """
    bars, n = len(x["y_pred"]), len(quality)
    positions, below = np.zeros((bars, n), np.int8), np.zeros(n, np.int64)
    held, entered, gain, wait = np.zeros(n, bool), np.zeros(n, np.int64), np.ones(n), np.zeros(n, np.int64)
    floor = cost * c["entry_cost"]
    for i in range(bars):
        expected, vol = x["y_pred"][i], x["rolling_vol"][i]
        enter = np.maximum(np.maximum(cost * c["entry_cost"], vol * c["entry_vol"]), c["min_entry"]) * (quality * x["regime_multiplier"][i] * x["volatility_multiplier"][i])
        leave = np.maximum(cost * c["exit_cost"], vol * c["exit_vol"])
        gain = np.where(held, gain * (1 + x["ret"][i]), gain)
        earned, age = gain - 1, i - entered
        stopped = earned <= -np.maximum(c["stop_vol"] * vol, floor)
        done = (earned >= np.maximum(c["take_vol"] * vol, floor)) | (age >= c["max_hold"]) | (expected < leave)
        out = held & (stopped | (done & (age >= c["min_hold"])))
        free = ~held & (wait == 0)
        into = free & (expected > enter)
        below += free & ~into
        wait = np.where(out, c["cooldown"], np.where(~held & (wait > 0), wait - 1, wait))
        entered, gain = np.where(into, i, entered), np.where(into, 1.0, gain)
        held = (held & ~out) | into
        positions[i] = held
    return positions, below


def gates(metrics: dict[str, float], benchmark: bool, c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each setting the reason for which the hard gate stops a model ("" if none) and the multiplier that the soft gate asks for."""
    known = {k: v if v is not None else np.nan for k, v in metrics.items()}
    weak = {"dir_acc": known["dir_acc"] < c["min_dir_acc"], "rmse_ratio": known["rmse_ratio"] > c["max_rmse_ratio"], "composite": known["composite"] < c["min_composite"]}
    far = {"dir_acc": known["dir_acc"] < FAR["dir_acc"], "rmse_ratio": known["rmse_ratio"] >= FAR["rmse_ratio"], "composite": known["composite"] < FAR["composite"]}
    hard, soft = c["gate"] == "hard", c["gate"] == "soft"
    multiplier = c["multiplier"].astype(float)
    for k, mild in weak.items():
        bad = mild | (far[k] if k == "dir_acc" else False)
        multiplier = np.where(soft & bad, np.maximum(multiplier, np.where(far[k], WEAK[1], WEAK[0])), multiplier)
    reason = np.full(len(multiplier), "benchmark_only" if benchmark else "", dtype=object)
    for k, name in (("dir_acc", "quality_dir_acc"), ("rmse_ratio", "quality_rmse"), ("composite", "quality_composite")):
        reason = np.where(hard & weak[k] & (reason == ""), name, reason)
    return reason, np.round(multiplier, 6)


def backtest_all(frame: pd.DataFrame, c: dict[str, np.ndarray], costs: tuple[float, float] = COSTS) -> pd.DataFrame:
    """One row a setting of the backtest of one series, in date order, under all settings c (arrays of one length)."""
    cost = sum(costs) / 1e4
    frame = frame.sort_values("Date", kind="stable")
    x = {k: frame[k].to_numpy(float) for k in ("y_pred", "ret", "rolling_vol", "regime", "volatility_multiplier", "realized_return")}
    x["ret"] = np.nan_to_num(x["ret"])
    x["regime_multiplier"] = np.select([x["regime"] > 0, x["regime"] < 0], [0.85, 1.25], 1.0)
    metrics = {k: frame[k].iloc[0] for k in ("dir_acc", "rmse_ratio", "composite")}
    professional = np.isin(c["mode"], ["professional"])
    reason, quality = gates(metrics, bool(frame["is_benchmark"].iloc[0]), c)
    n = len(quality)
    position, below = np.zeros((len(frame), n), np.int8), np.zeros(n, np.int64)
    if professional.any():
        own = {k: v[professional] for k, v in c.items()}
        position[:, professional], below[professional] = machine(x, own, quality[professional], cost)
    for k in np.flatnonzero(c["mode"] == "simple"):
        mark = np.select([x["y_pred"] > c["buy"][k], x["y_pred"] < -c["sell"][k]], [1.0, 0.0], np.nan)
        position[:, k] = pd.Series(mark).ffill().fillna(0.0).to_numpy()
    legacy = c["mode"] == "legacy"
    position[:, legacy] = (x["y_pred"] > 0)[:, None]
    blocked = professional & (reason != "")
    position[:, blocked], below[blocked] = 0, 0
    before = np.vstack([np.zeros((1, n), np.int8), position[:-1]])
    entry, moved = (position > before), np.abs(position - before).astype(float)
    moved[-1] += position[-1]
    net = position * x["realized_return"][:, None] - moved * cost
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        grown = np.cumsum(np.log(np.where(net <= -1, 0.0, 1 + net)), axis=0)  # all lost: minus infinity from there on
        fall = np.nan_to_num(np.exp(grown - np.maximum.accumulate(grown, axis=0)) - 1, nan=-1.0).min(0)
        final_net = np.expm1(grown[-1])
    hold = np.prod(np.where(x["realized_return"] <= -1, 0.0, 1 + x["realized_return"]))
    sd = net.std(0)
    stage = np.where(professional, quality, 1.0)
    regime, volatility = (np.where(professional, v.mean(), 1.0) for v in (x["regime_multiplier"], x["volatility_multiplier"]))
    final = np.where(professional, quality * (x["regime_multiplier"] * x["volatility_multiplier"]).mean(), 1.0)
    return pd.DataFrame({
        "net_return": final_net, "buyhold_return": hold - 1, "sharpe": np.divide(net.mean(0) * 252**0.5, sd, out=np.zeros(n), where=sd > 0), "max_drawdown": fall,
        "trade_count": entry.sum(0), "exposure": 100 * position.mean(0), "would_buy": entry.sum(0),
        **{f"blocked_{k}": np.where(blocked & (reason == f"quality_{k}"), len(frame), 0) for k in ("dir_acc", "rmse", "composite")},
        "below_threshold": below, "quality_multiplier": stage, "regime_multiplier": regime, "volatility_multiplier": volatility, "final_multiplier": final,
    })


def arrays(configs: Sequence[dict]) -> dict[str, np.ndarray]:
    return {k: np.array([c[k] for c in configs], dtype=object if isinstance(DEFAULTS[k], str) else float) for k in DEFAULTS}


NEEDED = ["y_pred", "ret", "rolling_vol", "regime", "volatility_multiplier", "realized_return", "dir_acc", "rmse_ratio", "composite"]


def run_settings(rows: DataFrame, configs: dict[int | str, dict], name: str = "trial", keys: Sequence[str] = ("symbol", "model"), costs: tuple[float, float] = COSTS) -> DataFrame:
    """keys, the setting's name and its results, for every series of rows and every setting; a grouped pass, the series held once.

    rows have keys, Date, the columns of NEEDED and is_benchmark. A series that cannot be run is left out. configs are few.
    """
    c, labels, kind = arrays(list(configs.values())), list(configs), "long" if all(isinstance(k, int) for k in configs) else "string"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = backtest_all(frame, c, costs)
        for k, (column, value) in enumerate([*zip(keys, key, strict=True), (name, labels)]):
            out.insert(k, column, value)
        return out

    few = rows.select(*keys, "Date", *[F.col(c).cast("double").alias(c) for c in NEEDED], F.coalesce("is_benchmark", F.lit(False)).alias("is_benchmark"))
    few = few.where("y_pred is not null and rolling_vol is not null and realized_return is not null").na.fill({"regime": 0.0, "volatility_multiplier": 1.0})
    shape = ", ".join([*(f"`{k}` {few.schema[k].dataType.simpleString()}" for k in keys), f"{name} {kind}", RESULTS])
    return few.groupBy(*keys).applyInPandas(run, shape)


def grid_values(base: dict | None = None) -> dict[str, list]:
    """The values of the seven calibrated parameters: fixed ones, and the base setting's own."""
    base = base or settings()
    fixed = {
        "min_dir_acc": [48.0, 50.0], "entry_vol": [0.10, 0.15, 0.20, 0.25, 0.30], "entry_cost": [1.5, 2.0, 2.5], "min_entry": [0.0, 0.001, 0.002],
        "max_hold": [10, 15, 20], "take_vol": [1.0, 1.5, 2.0], "stop_vol": [0.75, 1.0, 1.25],
    }
    return {k: sorted({*v, base[k]}) for k, v in fixed.items()}


def draw(seed: int, params: tuple) -> int:
    """A place in the seeded order of combinations, a function of the combination alone."""
    return zlib.crc32(repr((seed, params)).encode()) << 32 | zlib.crc32(repr((params, seed)).encode())


def sample_trials(values: dict[str, list], cap: int, seed: int = 42, exclude: Iterable[tuple] = ()) -> list[tuple]:
    """At most cap combinations of the values: first those that add most values not yet covered, then the rest in seeded order; of equal gains
    the first in that order. The same whatever else runs."""
    left = set(itertools.product(*values.values())) - set(exclude)
    if cap >= len(left):
        return sorted(left)
    order = sorted(left, key=lambda p: (draw(seed, p), p))
    chosen: list[tuple] = []
    taken: set[tuple] = set()
    open_ = {(k, v) for p in order for k, v in enumerate(p)}
    while open_ and len(chosen) < cap:
        best = max(order, key=lambda p: -1 if p in taken else sum((k, v) in open_ for k, v in enumerate(p)))
        chosen.append(best)
        taken.add(best)
        open_ -= set(enumerate(best))
    return chosen + [p for p in order if p not in taken][: cap - len(chosen)]


def coverage(values: dict[str, list], trials: Iterable[tuple]) -> str:
    """`complete`, or the values that no trial has."""
    seen = [set(column) for column in zip(*trials, strict=True)] or [set()] * len(values)
    gone = {k: [v for v in vs if v not in s] for (k, vs), s in zip(values.items(), seen, strict=True)}
    missing = [f"{k}={v}" for k, v in sorted(gone.items()) if v]
    return "complete" if not missing else "missing:" + "; ".join(missing)


def expansion(values: dict[str, list], trials: Sequence[tuple], seed: int = 42) -> list[tuple]:
    """A second sample, of the combinations not tried, up to twice as many or 128 in all."""
    size = reduce(lambda n, v: n * len(v), values.values(), 1)
    return sample_trials(values, min(size, max(2 * len(trials), 128)) - len(trials), seed + 1, trials)


def calibrate(rows: DataFrame, base: dict | None = None, cap: int = 64, seed: int = 42, min_trades: int = 6, min_excess: float = 0.0, min_sharpe: float = 0.0, values: dict[str, list] | None = None) -> DataFrame:
    """The report of each symbol's calibration: one row a trial with its parameters, calibration and evaluation summaries, reasons, rank, whether
    it is active, and what was sampled.

    rows as for run_settings, with set: calibration or evaluation. Benchmarks take no part. Trials of the grid run on the calibration rows;
    symbols whose best trial is weak, or whose grid is not covered, run an expansion besides; all trials run on the evaluation rows. The best
    confirmed trial is active; a symbol without one is rejected and may not trade.
    """
    base = settings(**{k: v for k, v in (base or {}).items()}) | {"gate": "soft"}
    values = values or grid_values(base)
    first = sample_trials(values, cap, seed)
    more = expansion(values, first, seed)
    number = {p: k for k, p in enumerate([*first, *more], 1)}
    as_settings = lambda some: {number[p]: base | dict(zip(values, p, strict=True)) for p in some}
    rows = rows.where(~F.coalesce("is_benchmark", F.lit(False)))
    enough = rows.groupBy("symbol").agg(F.greatest(F.lit(min_trades), 3 * F.count_distinct("model")).alias("least_trades"))

    def summaries(part: DataFrame, trials: list[tuple]) -> DataFrame:
        runs = run_settings(part, as_settings(trials), keys=("symbol", "model", "set")).join(enough, "symbol")
        return summarize_trials(runs, F.max("least_trades"), ("symbol", "set"))

    one = summaries(rows, first)
    known = one.where("set = 'calibration'").drop("set")
    ranked = choose_trial(known.withColumns({"oos_passed": F.lit(None).cast("boolean"), **{c: F.lit(None).cast("double") for c in ("eval_excess", "eval_sharpe")}}), ("symbol",))
    wider = should_expand(ranked, coverage(values, first) == "complete", ("symbol",)).select("symbol", F.col("expand").alias("adaptive_expanded"))
    both = one
    if more:
        both = both.unionByName(summaries(rows.join(wider.where("adaptive_expanded").select("symbol"), "symbol", "left_semi"), more))
    found, seen = (both.where(F.col("set") == x).drop("set") for x in ("calibration", "evaluation"))
    confirmed = confirm_trials(seen.join(enough, "symbol"), F.col("least_trades"), min_excess, min_sharpe, ("symbol",))
    table = found.join(confirmed, ["symbol", "trial"], "left").withColumns({
        "reject_reason": F.coalesce("reject_reason", F.lit("oos_skipped_no_evaluation_inputs")), "oos_passed": F.coalesce("oos_passed", F.lit(False)),
    })
    chosen = choose_trial(table, ("symbol",))
    best = Window.partitionBy("symbol")
    rank = best.orderBy(F.desc("enough_trades"), *[F.desc_nulls_last(c) for c in ("score", "excess", "net", "drawdown", "trades")], "trial")
    active = (F.col("place") == 1) & (F.col("choice") == "confirmed")
    chosen = chosen.withColumns({"rank": F.row_number().over(rank), "active": active, "rejected": ~F.max(active).over(best)}).join(wider, "symbol")
    grid = rows.sparkSession.createDataFrame([(k, *map(float, p)) for p, k in number.items()], ", ".join(["trial long", *(f"{k} double" for k in values)]))
    size = reduce(lambda n, v: n * len(v), values.values(), 1)
    done = F.when(F.col("adaptive_expanded"), len(number)).otherwise(len(first))
    status = F.when(F.col("adaptive_expanded"), coverage(values, number)).otherwise(coverage(values, first))
    return chosen.join(F.broadcast(grid), "trial").withColumns({
        "status": F.when(F.col("rejected"), "rejected_no_valid_oos_trial").otherwise("applied"), "sampler": F.lit("adaptive_stratified"), "seed": F.lit(seed), "grid_size": F.lit(size),
        "executed_trials": done, "coverage_status": status,
    })


def stage_backtests(rows: DataFrame, report: DataFrame, stage: str, base: dict | None = None, costs: tuple[float, float] = COSTS) -> DataFrame:
    """Every model of a stage under its symbol's active trial, none trading where calibration rejected them: results, protocol columns and the
    effective mode. report: calibrate()'s; its parameters go to the rows of their symbol."""
    base = settings(**(base or {}))
    names = [k for k in grid_values(base) if k in report.columns]
    picked = report.groupBy("symbol").agg(F.max("rejected").alias("rejected"), *[F.max(F.when(F.col("active"), F.col(k))).alias(f"set_{k}") for k in names])
    both = rows.join(picked, "symbol")
    columns = ["Date", *NEEDED, "is_benchmark", "rejected", *[f"set_{k}" for k in names]]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        top = frame.iloc[0]
        own = base | ({"mode": "rejected"} if top["rejected"] else {k: top[f"set_{k}"] for k in names})
        out = backtest_all(frame, arrays([own]), costs)
        out.insert(0, "effective_mode", "rejected_no_trade" if top["rejected"] else own["mode"])
        for k, (column, value) in enumerate(zip(("symbol", "model"), key, strict=True)):
            out.insert(k, column, value)
        return out

    few = both.select("symbol", "model", *columns).where("y_pred is not null and rolling_vol is not null and realized_return is not null")
    few = few.na.fill({"regime": 0.0, "volatility_multiplier": 1.0, "is_benchmark": False})
    out = few.groupBy("symbol", "model").applyInPandas(run, f"symbol string, model string, effective_mode string, {RESULTS}")
    protocol = {"stage": stage, "execution_lag": "decision_applies_to_aligned_next_bar_return", "transaction_costs": f"commission_bps={costs[0]:g}; slippage_bps={costs[1]:g}"}
    return out.withColumns({k: F.lit(v) for k, v in protocol.items()})


def shadow_backtests(rows: DataFrame, scenarios: dict[str, dict] | None = None) -> DataFrame:
    """Every model under each scenario: mode, gate and the results."""
    configs = {k: settings(**v) for k, v in (scenarios or SHADOWS).items()}
    out = run_settings(rows, configs, "shadow_mode")
    pick = lambda f: F.create_map(*[F.lit(x) for k, c in configs.items() for x in (k, c[f])])[F.col("shadow_mode")]
    return out.withColumns({"signal_mode": pick("mode"), "gate_mode": pick("gate")})


def policy_backtests(rows: DataFrame, policies: Sequence[str] = tuple(POLICIES)) -> DataFrame:
    """Every model under each policy's settings, and whether its trades and exposure lie in the policy's band (null: it has none). Rows of a
    policy that needs a feature confirm entries by it: where it is not above 0 (column of that name), no forecast counts."""
    parts = []
    for needs in sorted({POLICIES[p].get("needs", "") for p in policies}):
        own = {p: policy_settings(p) for p in policies if POLICIES[p].get("needs", "") == needs}
        part = rows.withColumn("y_pred", F.when(F.col(needs) > 0, F.col("y_pred")).otherwise(F.least(F.lit(0.0), F.col("y_pred")))) if needs else rows
        parts.append(run_settings(part, own, "policy"))
    out = reduce(DataFrame.unionByName, parts)

    def band(key: str, value: str):
        inside = F.lit(None).cast("boolean")
        for p in policies:
            if key in POLICIES[p]:
                inside = F.when(F.col("policy") == p, F.col(value).between(*POLICIES[p][key])).otherwise(inside)
        return inside

    return out.withColumns({"trades_in_band": band("trades", "trade_count"), "exposure_in_band": band("exposure", "exposure")})
