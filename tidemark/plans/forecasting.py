"""Queries over recursive forecasts, newest rows and re-derived features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import over_time
from tidemark.operators import features as C
from tidemark.operators import recursive as R
from tidemark.plans.common import BARS, PANEL, panel, rounded
from tidemark.plans.serving import SPLIT
from tidemark.sources.bars import table_bars

#: What the recursive forecast predicts from.
DRIVERS = ("SMA_14_rel", "SMA_50_rel", "STD_14_rel", "logret", "logret_lag_1")
APPENDED = "2001-06-01"


def recursive(s, d):
    """Five bounded closes a symbol with quantiles, by a ridge model of the next bar fitted on the bars before SPLIT."""
    past = table_bars(s, d).where(F.col("Date") < SPLIT)
    rows = C.lags(C.volatility(C.moving_averages(C.returns(past)))).withColumn("next", F.lead("logret").over(over_time()))
    model = R.fit_linear(rows, DRIVERS, "next")
    return rounded(R.recursive_points(past, table_bars(s, d).select("Date").distinct(), model, horizon=5))


def newest(s, d):
    """Targets of each symbol's newest row by fixed weights, scaled by fixed centres and clipped."""
    model = R.LinearModel(("ret", "liq_log", "vol"), (0.5, -0.25, 2.0), 0.01, (0.0, 10.0, 0.5), (0.5, 2.0, 0.25), 3.0, {0.1: -0.2, 0.9: 0.3})
    return rounded(R.latest_targets(panel(s, d), model))


def derive(bars):
    return C.volatility(C.moving_averages(bars))


def appended(s, d):
    bars = table_bars(s, d)
    stored = derive(bars.where(F.col("Date") < APPENDED))
    names = ["SMA_7_rel", "SMA_50_rel", "STD_14_rel", "BB_width"]
    return rounded(R.rederive(stored, bars.where(F.col("Date") >= APPENDED), derive, names, 50).select("symbol", "Date", "Close", *names))


def mean_sql(n: int) -> str:
    return f"CASE WHEN count(c) OVER w{n} >= {n} THEN avg(c) OVER w{n} END"


PLANS = {
    "k6_recursive_forecast": (recursive, None),
    "k16_latest_targets": (
        newest,
        f"""WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k FROM panel WHERE ret IS NOT NULL AND liq_log IS NOT NULL AND vol IS NOT NULL),
        t AS (SELECT symbol, dt, 0.01 + 0.5 * greatest(-3, least(3, ret / 0.5)) - 0.25 * greatest(-3, least(3, (liq_log - 10) / 2)) + 2 * greatest(-3, least(3, (vol - 0.5) / 0.25)) AS target FROM k WHERE k = 1)
        SELECT symbol, dt AS "Date", round(target, 6) AS target, round(target - 0.2, 6) AS p10_target, round(target + 0.3, 6) AS p90_target FROM t""",
    ),
    "c29_rederived": (
        appended,
        f"""WITH {BARS}, f AS (SELECT symbol, dt, c, c / nullif({mean_sql(7)}, 0) - 1 AS s7, c / nullif({mean_sql(50)}, 0) - 1 AS s50, CASE WHEN count(c) OVER w14 >= 14 THEN stddev_samp(c) OVER w14 END / c AS s14,
          CASE WHEN count(c) OVER w20 >= 20 THEN 4 * stddev_pop(c) OVER w20 / nullif(avg(c) OVER w20, 0) END AS bb FROM bars
          WINDOW {", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (7, 14, 20, 50))})
        SELECT symbol, dt AS "Date", round(c, 6) AS "Close", round(s7, 6) AS "SMA_7_rel", round(s50, 6) AS "SMA_50_rel", round(s14, 6) AS "STD_14_rel", round(bb, 6) AS "BB_width" FROM f WHERE dt >= DATE '{APPENDED}'""",
    ),
}
