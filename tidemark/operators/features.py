"""Features over a symbol's own past: projections over row windows, all in one shuffle by symbol."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import full, last_rows, over_time, percentile, ratio



def returns(bars: DataFrame) -> DataFrame:
    before = F.lag("Close").over(over_time())
    return bars.withColumns({"ret": ratio(F.col("Close"), before) - 1, "logret": F.log(ratio(F.col("Close"), before))})


def moving_averages(bars: DataFrame, spans: tuple[int, ...] = (7, 14, 21, 50)) -> DataFrame:
    """close / mean - 1 over each span."""
    return bars.withColumns({f"SMA_{n}_rel": ratio(F.col("Close"), full(F.avg("Close"), F.col("Close"), n)) - 1 for n in spans})


def market_regime(bars: DataFrame, n: int = 200) -> DataFrame:
    """1 above the long mean, -1 below or at it, 0 before it exists."""
    mean = full(F.avg("Close"), F.col("Close"), n)
    return bars.withColumn("Market_Regime_SMA200", F.when(mean.isNull(), 0).when(F.col("Close") > mean, 1).otherwise(-1))


def volatility(bars: DataFrame, n: int = 20, sds: float = 2.0) -> DataFrame:
    """Sample deviations over 14 and 21 rows relative to close; bands of population deviations."""
    close = F.col("Close")
    mean, sd = full(F.avg("Close"), close, n), full(F.stddev_pop("Close"), close, n)
    return bars.withColumns(
        {**{f"STD_{k}_rel": full(F.stddev_samp("Close"), close, k) / close for k in (14, 21)}, "BB_width": ratio(2 * sds * sd, mean), "BB_upper_rel": (mean + sds * sd) / close - 1, "BB_lower_rel": (mean - sds * sd) / close - 1}
    )


def true_range(bars: DataFrame) -> DataFrame:
    before = F.lag("Close").over(over_time())
    return bars.withColumn("TR", F.greatest(F.col("High") - F.col("Low"), F.abs(F.col("High") - before), F.abs(F.col("Low") - before)))


def money_flow(bars: DataFrame, n: int = 14) -> DataFrame:
    """Money-flow index: 100 - 100 / (1 + inflow / outflow) of typical price times volume."""
    out = bars.withColumn("tp", (F.col("High") + F.col("Low") + F.col("Close")) / 3)
    out = out.withColumn("_up", F.signum(F.col("tp") - F.lag("tp").over(over_time())))
    flow = F.col("tp") * F.col("Volume")
    out = out.withColumns({"_in": F.when(F.col("_up") > 0, flow).otherwise(0.0), "_out": F.when(F.col("_up") < 0, flow).otherwise(0.0)})
    up, down = F.sum("_in").over(last_rows(n)), F.sum("_out").over(last_rows(n))
    ready = F.count("_up").over(last_rows(n)) >= n
    return out.withColumn("MFI", F.when(ready, 100 * ratio(up, up + down))).drop("_up", "_in", "_out", "tp")


def chaikin(bars: DataFrame, n: int = 20) -> DataFrame:
    place = F.coalesce(ratio(2 * F.col("Close") - F.col("Low") - F.col("High"), F.col("High") - F.col("Low")), F.lit(0.0))
    out = bars.withColumn("_mfv", place * F.col("Volume"))
    return out.withColumn("CMF", ratio(full(F.sum("_mfv"), F.col("_mfv"), n), F.sum("Volume").over(last_rows(n)))).drop("_mfv")


def volume_features(bars: DataFrame, n: int = 20) -> DataFrame:
    out = bars.withColumn("_signed", F.coalesce(F.signum(F.col("Close") - F.lag("Close").over(over_time())), F.lit(0.0)) * F.col("Volume"))
    out = out.withColumn("_tpv", (F.col("High") + F.col("Low") + F.col("Close")) / 3 * F.col("Volume"))
    total = F.sum("Volume").over(last_rows(n))
    vwap = ratio(full(F.sum("_tpv"), F.col("_tpv"), n), total)
    return out.withColumns({"OBV_Norm_20": ratio(full(F.sum("_signed"), F.col("_signed"), n), total), "VWAP_20_rel": ratio(F.col("Close"), vwap) - 1}).drop("_signed", "_tpv")


def lags(bars: DataFrame, value: str = "logret", k: int = 5) -> DataFrame:
    return bars.withColumns({f"{value}_lag_{i}": F.lag(value, i).over(over_time()) for i in range(1, k + 1)})


def calendar_features(bars: DataFrame) -> DataFrame:
    """Monday is 0; quarter-end week: within five days of the quarter's last day."""
    quarter_end = F.date_sub(F.add_months(F.trunc("Date", "quarter"), 3), 1)
    left = F.datediff(quarter_end, "Date")
    return bars.withColumns({"day_of_week": F.weekday("Date"), "day_of_month": F.dayofmonth("Date"), "days_to_month_end": F.datediff(F.last_day("Date"), "Date"), "days_to_quarter_end": left, "quarter_end_week": (left <= 5).cast("int")})


def days_to_event(bars: DataFrame, events: DataFrame, none: int = 365) -> DataFrame:
    """Days to the next event on or after each date. Dates and events in one order; a backward scan fills the next event in."""
    from pyspark.sql import Window

    days = bars.select("Date").distinct().withColumn("_e", F.lit(None).cast("date")).union(events.select("Date", F.col("Date").alias("_e")))
    # one row a calendar day, so the single ordered partition is as small as the calendar
    days = days.groupBy("Date").agg(F.max("_e").alias("_e"))
    ahead = Window.orderBy("Date").rowsBetween(0, Window.unboundedFollowing)
    known = days.select("Date", F.first("_e", ignorenulls=True).over(ahead).alias("_next"))
    return bars.join(known, "Date", "left").withColumn("days_to_event", F.coalesce(F.datediff("_next", "Date"), F.lit(none))).drop("_next")


def stochastic(bars: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    low, high = full(F.min("Low"), F.col("Low"), n), full(F.max("High"), F.col("High"), n)
    out = bars.withColumn("Stoch_K", 100 * ratio(F.col("Close") - low, high - low))
    return out.withColumn("Stoch_D", full(F.avg("Stoch_K"), F.col("Stoch_K"), smooth))


def relative_momentum(bars: DataFrame, market: DataFrame, n: int = 60) -> DataFrame:
    """n-row momentum of the name and of market(Date, market_ret), compounded over the name's own rows; and their difference."""
    out = bars.join(market, "Date", "left").withColumn("_m", F.log1p(F.coalesce("market_ret", F.lit(0.0))))
    out = out.withColumns({"mom": ratio(F.col("Close"), F.lag("Close", n).over(over_time())) - 1, "market_mom": F.when(F.count("_m").over(last_rows(n)) >= n, F.expm1(F.sum("_m").over(last_rows(n))))})
    return out.withColumn("rel_mom", F.col("mom") - F.col("market_mom")).drop("_m")


def relative_strength(bars: DataFrame, market: DataFrame) -> DataFrame:
    return returns(bars).join(market, "Date", "left").withColumn("RS_market", F.col("ret") - F.col("market_ret"))


def market_return(bars: DataFrame) -> DataFrame:
    """Mean close return of a date."""
    return returns(bars).groupBy("Date").agg(F.avg("ret").alias("market_ret"))


def causal_columns(bars: DataFrame, h: int = 5, n: int = 63, least: int = 5) -> DataFrame:
    """Forward h-row log return and its date; median turnover and volatility over the past n rows."""
    out = returns(bars).withColumn("_turnover", F.col("Close") * F.col("Volume"))
    return out.withColumns(
        {"target": F.log(ratio(F.lead("Close", h).over(over_time()), F.col("Close"))), "target_date": F.lead("Date", h).over(over_time()), "liq_log": F.log1p(full(percentile(F.col("_turnover"), 0.5), F.col("_turnover"), n, least=least)), "vol": full(F.stddev_samp("logret"), F.col("logret"), n, least=least)}
    ).drop("_turnover")


def targets(bars: DataFrame, mode: str = "log_return", horizons: tuple[int, ...] = (1, 3, 5, 10), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One target a horizon over each series of the keys: price, return or log_return."""
    if bad := [h for h in horizons if h <= 0]:
        raise ValueError(f"horizons must be positive: {bad}")
    later = {h: F.lead("Close", h).over(over_time(*keys)) for h in horizons}
    form = {"price": lambda x: x, "return": lambda x: ratio(x, F.col("Close")) - 1, "log_return": lambda x: F.log(ratio(x, F.col("Close")))}[mode]
    return bars.withColumns({f"target_{h}": form(x) for h, x in later.items()})


def drift_features(bars: DataFrame) -> DataFrame:
    """Return, range and change of the log of a non-zero volume; rows that lack one of them are dropped."""
    logged = F.log(F.nullif(F.col("Volume").cast("double"), F.lit(0.0)))
    out = returns(bars).withColumns({"range_rel": ratio(F.col("High") - F.col("Low"), F.col("Close")), "_v": logged})
    out = out.withColumn("dlog_volume", F.col("_v") - F.lag("_v").over(over_time())).drop("_v")
    return out.where("logret is not null and range_rel is not null and dlog_volume is not null")


def sequences(df: DataFrame, columns: list[str], steps: int) -> DataFrame:
    """The last `steps` rows as one array of arrays; rows with a shorter past are left out."""
    w = last_rows(steps)
    return df.withColumn("sequence", F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w)).where(F.size("sequence") == steps)


def reconstruct(df: DataFrame, mode: str, pred: str = "y_pred", prev: str = "prev_close") -> DataFrame:
    """A predicted target back to a price."""
    p, c = F.col(pred), F.col(prev)
    return df.withColumn("pred_price", {"price": p, "return": c * (1 + F.greatest(F.lit(-0.95), F.least(F.lit(5.0), p))), "log_return": c * F.exp(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p)))}[mode])


RECURSIVE = ["EMA_12_rel", "RSI_14", "MACD", "MACD_signal", "MACD_diff", "NATR_14", "ADX_14"]


def _recursive(df: pd.DataFrame) -> pd.DataFrame:
    """Exponential and Wilder averages of one symbol, in date order."""
    df = df.sort_values("Date").reset_index(drop=True)
    close, high, low = df["Close"], df["High"], df["Low"]

    def ema(x: pd.Series, n: int) -> pd.Series:
        return x.ewm(span=n, adjust=False, min_periods=n).mean()

    def wilder(x: pd.Series, n: int) -> pd.Series:
        return x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()

    change = close.diff()
    up, down = wilder(change.clip(lower=0), 14), wilder(-change.clip(upper=0), 14)
    spread = pd.concat([high - low, (high - close.shift()).abs(), (low - close.shift()).abs()], axis=1).max(axis=1)
    atr = wilder(spread, 14)
    rise, fall = high.diff(), -low.diff()
    plus = 100 * wilder(rise.where((rise > fall) & (rise > 0), 0.0), 14) / atr
    minus = 100 * wilder(fall.where((fall > rise) & (fall > 0), 0.0), 14) / atr
    line = ema(close, 12) - ema(close, 26)
    signal = ema(line, 9)
    df["EMA_12_rel"] = close / ema(close, 12) - 1
    df["RSI_14"] = 100 * up / (up + down)
    df["MACD"], df["MACD_signal"], df["MACD_diff"] = line / close, signal / close, (line - signal) / close
    df["NATR_14"] = atr / close
    df["ADX_14"] = wilder((100 * (plus - minus).abs() / (plus + minus)), 14)
    return df


def recursive_features(bars: DataFrame) -> DataFrame:
    """The features that need each row's predecessor's result: one Arrow-fed pass a symbol, bounded by its number of days."""
    keep = [f for f in bars.schema.fields if f.name not in RECURSIVE]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{c} double" for c in RECURSIVE])
    return bars.select([f.name for f in keep]).groupBy("symbol").applyInPandas(_recursive, schema)
