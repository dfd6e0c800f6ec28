"""Queries over forecasts to come, their resolution, and stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import forecasts as K
from tidemark.plans.common import BARS, rounded
from tidemark.sources.bars import latest_rows, table_bars

SPLIT = "1999-06-01"
TICK = "CASE WHEN p < 20 THEN 0.01 WHEN p < 50 THEN 0.02 WHEN p < 100 THEN 0.05 WHEN p < 250 THEN 0.1 WHEN p < 500 THEN 0.25 WHEN p < 1000 THEN 0.5 WHEN p < 2500 THEN 1.0 ELSE 2.5 END"


def points(s, d):
    """Five points a symbol from its last bar before SPLIT, a constant drift as prediction."""
    past = table_bars(s, d).where(F.col("Date") < SPLIT)
    days = table_bars(s, d).select("Date").distinct()
    return K.forecast_points(latest_rows(past), K.next_days(latest_rows(past), days, 5), 0.01)


POINTS = f"""{BARS}, lastb AS (SELECT symbol, max(dt) AS last_date, arg_max(c, dt) AS last_close FROM bars WHERE dt < DATE '{SPLIT}' GROUP BY symbol), days AS (SELECT dt, row_number() OVER (ORDER BY dt) AS place FROM (SELECT DISTINCT dt FROM bars)),
pts AS (SELECT symbol, last_date, last_close, CAST(d2.place - d1.place AS INT) AS horizon, d2.dt AS target_date, last_close * power(1.01, d2.place - d1.place) AS pred FROM lastb JOIN days d1 ON d1.dt = last_date JOIN days d2 ON d2.place > d1.place AND d2.place <= d1.place + 5)"""
RESOLVED = f"""{POINTS}, j AS (SELECT pts.*, bars.c AS actual FROM pts LEFT JOIN bars ON bars.symbol = pts.symbol AND bars.dt = target_date),
r AS (SELECT *, min(CASE WHEN actual IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY horizon ROWS UNBOUNDED PRECEDING) AS ok, coalesce(lag(actual) OVER (PARTITION BY symbol ORDER BY horizon), last_close) AS before FROM j),
res AS (SELECT *, abs(pred - actual) AS abs_error, sign(actual - before) = 1 AS up FROM r WHERE ok = 1)"""


def resolved(s, d):
    return K.resolve(points(s, d), table_bars(s, d))


PLANS = {
    "k1_next_days": (
        lambda s, d: K.next_days(latest_rows(table_bars(s, d).where(F.col("Date") < SPLIT)), table_bars(s, d).select("Date").distinct(), 5),
        f"WITH {POINTS} SELECT symbol, horizon, target_date FROM pts",
    ),
    "k2_price_ticks": (
        lambda s, d: rounded(table_bars(s, d).select("symbol", "Date", K.price_tick(F.col("Close")).alias("tick"))),
        f'WITH {BARS} SELECT symbol, dt AS "Date", CAST({TICK.replace("p <", "c <")} AS DOUBLE) AS tick FROM bars',
    ),
    "k5_forecast_points": (
        lambda s, d: rounded(points(s, d).select("symbol", "horizon", "target_date", "pred_close")),
        f"WITH {POINTS} SELECT symbol, horizon, target_date, round(pred, 6) AS pred_close FROM pts",
    ),
    "k13_resolve": (
        lambda s, d: rounded(resolved(s, d).select("symbol", "horizon", "target_date", "actual_close", "abs_error", "actual_return")),
        f"WITH {RESOLVED} SELECT symbol, horizon, target_date, round(actual, 6) AS actual_close, round(abs_error, 6) AS abs_error, round(actual / before - 1, 6) AS actual_return FROM res",
    ),
    "k14_run_accuracy": (
        lambda s, d: rounded(K.accuracy(resolved(s, d))),
        f"""WITH {RESOLVED} SELECT symbol, count(*) AS n, round(sqrt(avg((pred - actual) ** 2)), 6) AS rmse, round(avg(abs_error), 6) AS mae, round(100 * avg(abs_error / actual), 6) AS mape, round(100 * avg(CASE WHEN up THEN 1.0 ELSE 0 END), 6) AS dir_acc FROM res GROUP BY symbol""",
    ),
}
