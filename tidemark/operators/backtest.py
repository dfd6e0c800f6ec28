"""Signals, positions, costs, equity and trades. A decision at t earns the aligned next-bar return of the same row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import last_rows, over_time

KEYS = ("symbol", "model")


def running(*keys: str):
    return Window.partitionBy(*keys).orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)


def expected_return(mode: str, pred: Column, close: Column) -> Column:
    """A prediction as a simple return."""
    return {"price": pred / close - 1, "return": pred, "log_return": F.expm1(pred)}[mode]


def long_flat(df: DataFrame) -> DataFrame:
    return df.withColumn("position", (F.col("y_pred") > 0).cast("int"))


def hysteresis(df: DataFrame, buy: float, sell: float) -> DataFrame:
    """Position of a set-reset switch: in above buy, out below -sell, else as before; and the decision it took."""
    if buy < 0 or sell < 0:
        raise ValueError("thresholds must not be negative")
    mark = F.when(F.col("y_pred") > buy, 1).when(F.col("y_pred") < -sell, 0)
    out = df.withColumn("_mark", mark).withColumn("position", F.coalesce(F.last("_mark", ignorenulls=True).over(running(*KEYS)), F.lit(0)))
    before = F.coalesce(F.lag("position").over(over_time(*KEYS)), F.lit(0))
    decision = F.when((before == 0) & (F.col("position") == 1), "BUY").when((before == 1) & (F.col("position") == 0), "EXIT").when(F.col("position") == 1, "HOLD").otherwise("NO_TRADE")
    return out.withColumn("decision", decision).drop("_mark")


def rolling_risk(df: DataFrame, n: int = 20) -> DataFrame:
    """Rolling deviation of past returns, from two rows on; null and 0 become 1e-6."""
    sd = F.stddev_samp("ret").over(last_rows(n, *KEYS))
    return df.withColumn("rolling_vol", F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(1e-6)))


def regime_multiplier(regime: Column) -> Column:
    return F.when(regime > 0, 0.85).when(regime < 0, 1.25).otherwise(1.0)


def recommendation(decision: Column, expected: Column, threshold: Column) -> Column:
    """BUY on entry, SELL on exit or on a forecast far below zero without a position, else HOLD."""
    falls = (decision == "NO_TRADE") & (expected < -F.abs(threshold))
    return F.when(decision == "BUY", "BUY").when((decision == "EXIT") | falls, "SELL").otherwise("HOLD")


def quality_block(df: DataFrame) -> DataFrame:
    """Hard gate on the model's metrics: why it may not trade, null if it may."""
    rules = (F.col("dir_acc") < 52, "quality_dir_acc"), (F.col("rmse_ratio") > 1.05, "quality_rmse"), (F.col("composite") < 50, "quality_composite")
    reason = F.when(F.col("is_benchmark"), "benchmark_only")
    for bad, name in rules:
        reason = reason.when(bad, name)
    return df.withColumn("block_reason", reason)


def blocked(df: DataFrame) -> DataFrame:
    """Rows of a blocked model: no trade anywhere, with the reason as risk state."""
    stop = F.col("block_reason").isNotNull()
    return df.withColumns({
        "decision": F.when(stop, "NO_TRADE").otherwise(F.col("decision")), "position": F.when(stop, 0).otherwise(F.col("position")),
        "risk_state": F.when(stop, F.col("block_reason")).otherwise(F.col("risk_state")),
    })


def soft_gate(df: DataFrame) -> DataFrame:
    """The largest threshold multiplier that a weak metric asks for (1.25, or 1.75 where it is far off), with all reasons."""
    weak = {
        "dir_acc": (F.col("dir_acc") < 52, F.col("dir_acc") < 48),
        "rmse_ratio": (F.col("rmse_ratio") > 1.05, F.col("rmse_ratio") >= 1.10),
        "composite": (F.col("composite") < 50, F.col("composite") < 45),
    }
    steps = [F.when(mild & far, 1.75).when(mild, 1.25).otherwise(1.0) for mild, far in weak.values()]
    reasons = [F.when(mild, F.lit(f"weak_{name}")) for name, (mild, _) in weak.items()]
    return df.withColumns({"threshold_multiplier": F.greatest(*steps), "gate_reasons": F.array_compact(F.array(*reasons))})


def events(df: DataFrame) -> DataFrame:
    """entry, exit (of the position before) and forced exit on a series' last bar."""
    before = F.coalesce(F.lag("position").over(over_time(*KEYS)), F.lit(0))
    last = F.lead("Date").over(over_time(*KEYS)).isNull()
    return df.withColumns({"entry": ((before == 0) & (F.col("position") == 1)).cast("int"), "exit": ((before == 1) & (F.col("position") == 0)).cast("int"), "forced_exit": (last & (F.col("position") == 1)).cast("int")})


def equity_curve(df: DataFrame, commission_bps: float = 10, slippage_bps: float = 5) -> DataFrame:
    """df(position, realized_return by row) with costs, gross and net returns and compounded equity, and buy-and-hold beside it."""
    out = events(df)
    sides = F.col("entry") + F.col("exit") + F.col("forced_exit")
    out = out.withColumns({"commission": sides * commission_bps / 1e4, "slippage": sides * slippage_bps / 1e4})
    out = out.withColumn("gross_return", F.col("position") * F.col("realized_return"))
    out = out.withColumn("net_return", F.col("gross_return") - F.col("commission") - F.col("slippage"))
    return out.withColumns({f"{name}_equity": compounded(value) for name, value in (("gross", "gross_return"), ("net", "net_return"), ("buyhold", "realized_return"))})


def compounded(value: str) -> Column:
    """Running product of 1 + value; a loss of everything stays at 0."""
    growth = 1 + F.col(value)
    w = running(*KEYS)
    return F.when(F.min(growth).over(w) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.when(growth > 0, growth))).over(w)))


def product(value: Column) -> Column:
    """Aggregate product of 1 + value; 0 once everything is lost."""
    return F.when(F.min(1 + value) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.when(value > -1, 1 + value)))))


def orders(curve: DataFrame) -> DataFrame:
    before = F.coalesce(F.lag("position").over(over_time(*KEYS)), F.lit(0))
    order = F.when(F.col("entry") == 1, "BUY").when((F.col("exit") == 1) | (F.col("forced_exit") == 1), "SELL").otherwise("HOLD")
    return curve.select("symbol", "model", "Date", order.alias("order"), before.alias("previous_position"), F.col("position").alias("new_position"))


def trades(curve: DataFrame) -> DataFrame:
    """One row a trade: entries number the trades; gross leaves the exit row out, net takes it in."""
    w = running(*KEYS)
    part = curve.withColumn("trade_id", F.sum("entry").over(w)).where("position = 1 or exit = 1").where("trade_id > 0")
    held = F.col("position") == 1
    out = part.groupBy(*KEYS, "trade_id").agg(
        F.min("Date").alias("entry_date"), F.max("Date").alias("exit_date"), F.count_if(held).alias("holding_bars"),
        product(F.when(held, F.col("gross_return"))).alias("_g"), product(F.col("net_return")).alias("_n"),
        F.max("exit").alias("closed"),
    )
    return out.select(*KEYS, "trade_id", "entry_date", "exit_date", "holding_bars", (F.col("_g") - 1).alias("gross_return"), (F.col("_n") - 1).alias("net_return"), F.when(F.col("closed") == 1, "signal").otherwise("end_of_data").alias("exit_reason"))
