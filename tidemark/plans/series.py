"""Queries over features of a symbol's own past, macro joins and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import macro as M
from tidemark.operators import splits as S
from tidemark.plans.common import BARS, PANEL, panel, prediction_panel, rounded
from tidemark.session import table
from tidemark.sources.bars import table_bars


def feature(build, *columns):
    return lambda s, d: rounded(build(table_bars(s, d)).select("symbol", "Date", *columns))


def rows_sql(columns: dict[str, str], more: str = "", source: str = "rets") -> str:
    picked = ", ".join(f'round({x}, 6) AS "{name}"' if not x.startswith("=") else f'{x[1:]} AS "{name}"' for name, x in columns.items())
    return f'WITH {BARS}{more} SELECT symbol, dt AS "Date", {picked} FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY dt)'


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


DRIFT = """, drift0 AS (SELECT *, (h - l) / nullif(c, 0) AS range_rel, ln(nullif(v, 0)) - lag(ln(nullif(v, 0))) OVER (PARTITION BY symbol ORDER BY dt) AS dlog_volume FROM rets),
drift AS (SELECT * FROM drift0 WHERE logret IS NOT NULL AND range_rel IS NOT NULL AND dlog_volume IS NOT NULL)"""


def gated(agg: str, value: str, n: int) -> str:
    return f"CASE WHEN count({value}) {over(n)} >= {n} THEN {agg} {over(n)} END"


def orders_by_day(s, d):
    return table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("Date")).agg(F.sum("o_totalprice").alias("turnover"), F.count(F.lit(1)).cast("double").alias("n_orders"))


def events_of(s, d):
    return table(s, d, "orders").where("o_totalprice > 350000").select(F.to_date("o_orderdate").alias("Date")).distinct()


def monthly(s, d):
    return table(s, d, "orders").groupBy(F.to_date(F.trunc(F.to_date("o_orderdate"), "month")).alias("Date")).agg(F.avg("o_totalprice").alias("level"))


def g2(s, d):
    bars = table_bars(s, d).select("symbol", "Date", "Close")
    folded = S.assign_folds(bars, S.walk_forward_bounds(bars, splits=6, test=21, min_train=63, embargo=5))
    return folded.groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))


def g7(s, d):
    p = panel(s, d).select("symbol", "Date", "target_date")
    return S.assign_pooled(p, S.pooled_folds(p)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))


MARKET = ", mkt AS (SELECT dt, avg(ret) AS market_ret FROM rets GROUP BY dt)"
#: The recursive averages, a bar at a time for all symbols together: each is alpha times the new value and the rest of the old one.
RECURSION = f"""WITH RECURSIVE {BARS}, q AS (SELECT *, row_number() OVER w AS rn, c - lag(c) OVER w AS chg, h - lag(h) OVER w AS rise, lag(l) OVER w - l AS fall, greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
x AS (SELECT symbol, dt, rn, c, greatest(chg, 0) AS gain, greatest(-chg, 0) AS loss, coalesce(tr, h - l) AS tr, CASE WHEN rise > fall AND rise > 0 THEN rise ELSE 0.0 END AS pd, CASE WHEN fall > rise AND fall > 0 THEN fall ELSE 0.0 END AS md FROM q),
a AS (
  SELECT symbol, dt, rn, c, c AS e12, c AS e26, NULL::DOUBLE AS line, NULL::DOUBLE AS sig, NULL::DOUBLE AS up, NULL::DOUBLE AS dn, tr AS atr, pd AS pl, md AS mi, NULL::DOUBLE AS adx FROM x WHERE rn = 1
  UNION ALL
  SELECT symbol, dt, rn, c, e12, e26, line, CASE WHEN rn < 26 THEN NULL WHEN rn = 26 THEN line ELSE 0.8 * sig + 0.2 * line END, up, dn, atr, pl, mi,
    CASE WHEN rn < 14 THEN NULL WHEN rn = 14 THEN dx ELSE 13.0 / 14 * adx + 1.0 / 14 * dx END
  FROM (
    SELECT *, CASE WHEN rn >= 26 THEN e12 - e26 END AS line, 100 * abs(pl - mi) / nullif(pl + mi, 0) AS dx FROM (
      SELECT x.symbol, x.dt, x.rn, x.c, 11.0 / 13 * a.e12 + 2.0 / 13 * x.c AS e12, 25.0 / 27 * a.e26 + 2.0 / 27 * x.c AS e26, a.sig, a.adx,
        CASE WHEN x.rn = 2 THEN gain ELSE 13.0 / 14 * a.up + 1.0 / 14 * gain END AS up, CASE WHEN x.rn = 2 THEN loss ELSE 13.0 / 14 * a.dn + 1.0 / 14 * loss END AS dn,
        13.0 / 14 * a.atr + 1.0 / 14 * x.tr AS atr, 13.0 / 14 * a.pl + 1.0 / 14 * x.pd AS pl, 13.0 / 14 * a.mi + 1.0 / 14 * x.md AS mi
      FROM a JOIN x ON x.symbol = a.symbol AND x.rn = a.rn + 1)))
SELECT symbol, dt AS "Date", round(CASE WHEN rn >= 12 THEN c / e12 - 1 END, 6) AS "EMA_12_rel", round(CASE WHEN rn >= 15 THEN 100 * up / nullif(up + dn, 0) END, 6) AS "RSI_14", round(line / c, 6) AS "MACD",
  round(CASE WHEN rn >= 34 THEN sig / c END, 6) AS "MACD_signal", round(CASE WHEN rn >= 34 THEN (line - sig) / c END, 6) AS "MACD_diff", round(CASE WHEN rn >= 14 THEN atr / c END, 6) AS "NATR_14", round(CASE WHEN rn >= 27 THEN adx END, 6) AS "ADX_14" FROM a"""


PLANS = {
    "c1_returns": (feature(X.returns, "ret", "logret"), rows_sql({"ret": "ret", "logret": "logret"})),
    "c2_moving_averages": (feature(X.moving_averages, *[f"SMA_{n}_rel" for n in (7, 14, 21, 50)]), rows_sql({f"SMA_{n}_rel": f"c / ({gated('avg(c)', 'c', n)}) - 1" for n in (7, 14, 21, 50)})),
    "c3_market_regime": (feature(X.market_regime, "Market_Regime_SMA200"), rows_sql({"Market_Regime_SMA200": f"=CASE WHEN count(c) {over(200)} < 200 THEN 0 WHEN c > avg(c) {over(200)} THEN 1 ELSE -1 END"})),
    "c4_volatility": (
        feature(X.volatility, "STD_14_rel", "STD_21_rel", "BB_width", "BB_upper_rel", "BB_lower_rel"),
        rows_sql({"STD_14_rel": f"({gated('stddev_samp(c)', 'c', 14)}) / c", "STD_21_rel": f"({gated('stddev_samp(c)', 'c', 21)}) / c", "BB_width": f"4 * ({gated('stddev_pop(c)', 'c', 20)}) / ({gated('avg(c)', 'c', 20)})", "BB_upper_rel": f"(({gated('avg(c)', 'c', 20)}) + 2 * ({gated('stddev_pop(c)', 'c', 20)})) / c - 1", "BB_lower_rel": f"(({gated('avg(c)', 'c', 20)}) - 2 * ({gated('stddev_pop(c)', 'c', 20)})) / c - 1"}),
    ),
    "c5_true_range": (
        lambda s, d: rounded(X.true_range(table_bars(s, d)).select("symbol", "Date", (F.col("TR") / F.col("Close")).alias("TR_rel"))),
        rows_sql({"TR_rel": "greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) / c"}),
    ),
    "c8_money_flow": (
        feature(X.money_flow, "MFI"),
        rows_sql({"MFI": f"CASE WHEN count(up) {over(14)} >= 14 THEN 100 * sum(CASE WHEN up > 0 THEN tp * v ELSE 0 END) {over(14)} / nullif(sum(CASE WHEN up > 0 THEN tp * v ELSE 0 END) {over(14)} + sum(CASE WHEN up < 0 THEN tp * v ELSE 0 END) {over(14)}, 0) END"}, ", t AS (SELECT *, (h + l + c) / 3 AS tp, sign((h + l + c) / 3 - lag((h + l + c) / 3) OVER (PARTITION BY symbol ORDER BY dt)) AS up FROM rets)", "t"),
    ),
    "c10_chaikin": (
        feature(X.chaikin, "CMF"),
        rows_sql({"CMF": f"({gated('sum(mfv)', 'mfv', 20)}) / nullif(sum(v) {over(20)}, 0)"}, ", t AS (SELECT *, coalesce((2 * c - l - h) / nullif(h - l, 0), 0) * v AS mfv FROM rets)", "t"),
    ),
    "c11_volume_features": (
        feature(X.volume_features, "OBV_Norm_20", "VWAP_20_rel"),
        rows_sql({"OBV_Norm_20": f"({gated('sum(sv)', 'sv', 20)}) / nullif(sum(v) {over(20)}, 0)", "VWAP_20_rel": f"c / nullif(({gated('sum(tpv)', 'tpv', 20)}) / nullif(sum(v) {over(20)}, 0), 0) - 1"}, ", t AS (SELECT *, coalesce(sign(c - lag(c) OVER (PARTITION BY symbol ORDER BY dt)), 0) * v AS sv, (h + l + c) / 3 * v AS tpv FROM rets)", "t"),
    ),
    "c13_lags": (feature(lambda b: X.lags(X.returns(b)), *[f"logret_lag_{i}" for i in range(1, 6)]), rows_sql({f"logret_lag_{i}": f"lag(logret, {i}) OVER w" for i in range(1, 6)})),
    "c14_calendar_features": (
        feature(X.calendar_features, "day_of_week", "day_of_month", "days_to_month_end", "days_to_quarter_end", "quarter_end_week"),
        rows_sql({"day_of_week": "=CAST(isodow(dt) - 1 AS INT)", "day_of_month": "=CAST(day(dt) AS INT)", "days_to_month_end": "=CAST(last_day(dt) - dt AS INT)", "days_to_quarter_end": "=CAST(CAST(date_trunc('quarter', dt) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) - dt AS INT)", "quarter_end_week": "=CAST(CAST(date_trunc('quarter', dt) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) - dt <= 5 AS INT)"}),
    ),
    "c15_days_to_event": (
        lambda s, d: X.days_to_event(table_bars(s, d).select("symbol", "Date"), events_of(s, d)),
        f"""WITH {BARS}, ev AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS e FROM orders WHERE o_totalprice > 350000)
        SELECT symbol, dt AS "Date", CAST(coalesce((SELECT min(e) FROM ev WHERE e >= dt) - dt, 365) AS INT) AS days_to_event FROM bars""",
    ),
    "c16_stochastic": (
        feature(X.stochastic, "Stoch_K", "Stoch_D"),
        rows_sql({"Stoch_K": "k", "Stoch_D": gated("avg(k)", "k", 3)}, f", t AS (SELECT *, 100 * (c - ({gated('min(l)', 'l', 14)})) / nullif(({gated('max(h)', 'h', 14)}) - ({gated('min(l)', 'l', 14)}), 0) AS k FROM rets)", "t"),
    ),
    "c17_relative_momentum": (
        lambda s, d: rounded(X.relative_momentum(table_bars(s, d), X.market_return(table_bars(s, d))).select("symbol", "Date", "mom", "market_mom", "rel_mom")),
        rows_sql({"mom": "c / lag(c, 60) OVER w - 1", "market_mom": f"({gated('sum(m)', 'm', 60).replace('THEN', 'THEN exp(').replace(' END', ') - 1 END')})", "rel_mom": f"c / lag(c, 60) OVER w - 1 - ({gated('sum(m)', 'm', 60).replace('THEN', 'THEN exp(').replace(' END', ') - 1 END')})"}, MARKET + ", t AS (SELECT rets.*, ln(1 + coalesce(market_ret, 0)) AS m FROM rets LEFT JOIN mkt USING (dt))", "t"),
    ),
    "c18_relative_strength": (
        lambda s, d: rounded(X.relative_strength(table_bars(s, d), X.market_return(table_bars(s, d))).select("symbol", "Date", "RS_market")),
        rows_sql({"RS_market": "ret - market_ret"}, MARKET + ", t AS (SELECT * FROM rets LEFT JOIN mkt USING (dt))", "t"),
    ),
    "c22_causal_columns": (
        lambda s, d: rounded(panel(s, d).select("symbol", "Date", "target", "target_date", "liq_log", "vol", "sector")),
        f'WITH {PANEL} SELECT symbol, dt AS "Date", round(target, 6) AS target, target_date, round(liq_log, 6) AS liq_log, round(vol, 6) AS vol, sector FROM panel',
    ),
    "c24_targets": (feature(X.targets, *[f"target_{h}" for h in (1, 3, 5, 10)]), rows_sql({f"target_{h}": f"ln(lead(c, {h}) OVER w / c)" for h in (1, 3, 5, 10)})),
    "c25_drift_features": (feature(X.drift_features, "range_rel", "dlog_volume"), rows_sql({"range_rel": "range_rel", "dlog_volume": "dlog_volume"}, DRIFT, "drift")),
    "c32_sequences": (
        lambda s, d: rounded(X.sequences(X.returns(table_bars(s, d)).where("ret is not null"), ["ret"], 5).select("symbol", "Date", F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0]).alias("sequence_sum"))),
        f"""WITH {BARS}, t AS (SELECT symbol, dt, sum(ret) {over(5)} AS z, count(*) {over(5)} AS k FROM rets WHERE ret IS NOT NULL) SELECT symbol, dt AS "Date", round(z, 6) AS sequence_sum FROM t WHERE k = 5""",
    ),
    "h1_recursive_features": (feature(X.recursive_features, *X.RECURSIVE), RECURSION),
    "f1_base_series": (
        lambda s, d: rounded(M.base_series(orders_by_day(s, d).select("Date", "turnover"), X.market_return(table_bars(s, d)))),
        f"""WITH {BARS}{MARKET}, o AS (SELECT CAST(o_orderdate AS DATE) AS dt, sum(o_totalprice) AS turnover FROM orders GROUP BY 1), j AS (SELECT coalesce(o.dt, mkt.dt) AS dt, turnover, market_ret FROM o FULL JOIN mkt ON o.dt = mkt.dt)
        SELECT dt AS "Date", round(last_value(turnover IGNORE NULLS) OVER w, 6) AS turnover, round(last_value(market_ret IGNORE NULLS) OVER w, 6) AS market_ret FROM j WINDOW w AS (ORDER BY dt ROWS UNBOUNDED PRECEDING)""",
    ),
    "f2_merge_macro": (
        lambda s, d: rounded(M.merge_macro(table_bars(s, d).select("symbol", "Date", "Close"), orders_by_day(s, d))),
        f"""WITH {BARS}, o AS (SELECT CAST(o_orderdate AS DATE) AS dt, sum(o_totalprice) AS turnover, CAST(count(*) AS DOUBLE) AS n_orders FROM orders GROUP BY 1)
        SELECT symbol, dt AS "Date", round(c, 6) AS "Close", round(last_value(turnover IGNORE NULLS) OVER w, 6) AS turnover, last_value(n_orders IGNORE NULLS) OVER w AS n_orders FROM bars LEFT JOIN o USING (dt) WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)""",
    ),
    "f4_release_lag": (
        lambda s, d: rounded(M.merge_monthly(orders_by_day(s, d).select("Date", "n_orders"), monthly(s, d), 15)),
        """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS dt, CAST(count(*) AS DOUBLE) AS n_orders FROM orders GROUP BY 1), m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) + 15 AS dt, avg(o_totalprice) AS level FROM orders GROUP BY 1)
        SELECT dt AS "Date", n_orders, round(last_value(level IGNORE NULLS) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING), 6) AS level FROM o LEFT JOIN m USING (dt)""",
    ),
    "f4_release_asof": (
        lambda s, d: rounded(M.merge_monthly(orders_by_day(s, d).select("Date", "n_orders"), monthly(s, d), 15, exact=False)),
        """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS dt, CAST(count(*) AS DOUBLE) AS n_orders FROM orders GROUP BY 1), m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) + 15 AS dt, avg(o_totalprice) AS level FROM orders GROUP BY 1)
        SELECT o.dt AS "Date", n_orders, round(level, 6) AS level FROM o ASOF LEFT JOIN m ON o.dt >= m.dt""",
    ),
    "c19_monthly_index": (
        lambda s, d: rounded(M.monthly_index(monthly(s, d), "level")),
        """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS dt, avg(o_totalprice) AS level FROM orders GROUP BY 1)
        SELECT dt AS "Date", round(level, 6) AS level, round(level / lag(level) OVER w - 1, 6) AS level_mom, round(level / lag(level, 12) OVER w - 1, 6) AS level_yoy FROM m WINDOW w AS (ORDER BY dt)""",
    ),
    "g1_single_split": (
        lambda s, d: S.single_split(table_bars(s, d)).groupBy("symbol", "role").agg(F.count(F.lit(1)).alias("n"), F.min("Date").alias("first_date")),
        f"""WITH {BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
        SELECT symbol, CASE WHEN rn <= floor(n * (1 - 0.2)) THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(dt) AS first_date FROM t GROUP BY 1, 2""",
    ),
    "g2_walk_forward": (
        g2,
        f"""WITH {BARS}, t AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
        k AS (SELECT symbol, max(n) AS n, least(6, CAST(floor((max(n) - 68) / 21.0) AS INT)) AS k FROM t GROUP BY symbol), f AS (SELECT symbol, n, k, CAST(unnest(generate_series(1, k)) AS INT) AS fold FROM k WHERE k >= 1),
        b AS (SELECT symbol, fold, n - (k - fold + 1) * 21 + 1 AS ts FROM f), j AS (SELECT t.symbol, dt, fold, CASE WHEN rn <= ts - 6 THEN 'train' WHEN rn BETWEEN ts AND ts + 20 THEN 'test' END AS role FROM t JOIN b USING (symbol))
        SELECT symbol, fold, role, count(*) AS n, min(dt) AS first_date, max(dt) AS last_date FROM j WHERE role IS NOT NULL GROUP BY 1, 2, 3""",
    ),
    "g5_purged_kfold": (
        lambda s, d: S.purged_kfold(table_bars(s, d).select("symbol", "Date")).groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("n")),
        f"""WITH {BARS}, t AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars), f AS (SELECT *, CAST(unnest(generate_series(0, 4)) AS INT) AS fold FROM t),
        b AS (SELECT *, fold * (n // 5) AS a, CASE WHEN fold = 4 THEN n ELSE (fold + 1) * (n // 5) END AS z FROM f), r AS (SELECT symbol, fold, CASE WHEN pos >= a AND pos < z THEN 'test' WHEN pos < a - 5 OR pos >= z + 5 THEN 'train' END AS role FROM b)
        SELECT symbol, fold, role, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY 1, 2, 3""",
    ),
    "g6_combinatorial_folds": (lambda s, d: S.combinatorial_folds(table_bars(s, d).select("symbol", "Date")).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n")), None),
    "g7_pooled_folds": (
        g7,
        f"""WITH {PANEL}, days AS (SELECT dt, row_number() OVER (ORDER BY dt) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT dt FROM panel)), b AS (SELECT unnest(generate_series(1, 5)) AS back),
        f AS (SELECT back, min(dt) AS d0, max(CASE WHEN rn = n - back * 21 + 1 THEN dt END) AS ts, max(CASE WHEN rn = n - (back - 1) * 21 THEN dt END) AS te, max(CASE WHEN rn = n - back * 21 + 1 - 11 THEN dt END) AS tr FROM days, b GROUP BY back),
        j AS (SELECT CAST(6 - back AS INT) AS fold, dt, CASE WHEN dt BETWEEN ts AND te THEN 'test' WHEN dt <= tr AND target_date < ts THEN 'train' END AS role FROM panel, f WHERE ts IS NOT NULL AND tr IS NOT NULL AND tr - d0 >= 365)
        SELECT fold, role, count(*) AS n, min(dt) AS first_date, max(dt) AS last_date FROM j WHERE role IS NOT NULL GROUP BY 1, 2""",
    ),
    "g9_rolling_holdout": (
        lambda s, d: rounded(S.rolling_holdout(prediction_panel(s, d))),
        f"""WITH {PANEL}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM preds), w AS (SELECT symbol, unnest(generate_series(0, (max(n) - 60) // 20)) AS w FROM t GROUP BY symbol HAVING max(n) >= 60),
        g AS (SELECT symbol, w, sum(sign(y_pred) * y_true) AS gain FROM w JOIN t USING (symbol) WHERE rn > w * 20 AND rn <= w * 20 + 60 GROUP BY 1, 2)
        SELECT symbol, count(*) AS windows, round(quantile_cont(gain, 0.5), 6) AS median_gain, round(avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0 END), 6) AS positive_share, round(quantile_cont(gain, 0.75) - quantile_cont(gain, 0.25), 6) AS iqr FROM g GROUP BY symbol HAVING count(*) >= 3""",
    ),
}
