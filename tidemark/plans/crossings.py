"""Queries across the symbols of a date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import xsection as X
from tidemark.operators.selection import trend_tendency
from tidemark.plans.common import PANEL, average_rank_sql, panel, prediction_panel, rounded

NAMES = 8
SUMMARY = "round(avg(ic), 6) AS ic_mean, round(stddev_pop(ic), 6) AS ic_std, round(avg(ic) / nullif(stddev_pop(ic), 0), 6) AS icir, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), 6) AS pct_positive, count(*) AS n_days"


def ic_sql(keys: str, least: int, source: str = "preds") -> str:
    return f""", ranked AS (SELECT *, {average_rank_sql('y_pred', keys)} AS rp, {average_rank_sql('y_true', keys)} AS rt FROM {source}),
    daily AS (SELECT {keys}, round(corr(rp, rt), 9) AS ic, count(DISTINCT symbol) AS n FROM ranked GROUP BY {keys} HAVING count(DISTINCT symbol) >= {least} AND stddev_pop(rp) > 0 AND stddev_pop(rt) > 0)"""


SEGMENTS = """, per AS (SELECT symbol, quantile_cont(liq_log, 0.5) AS liq_med, quantile_cont(vol, 0.5) AS vol_med, arg_min(sector, dt) AS sector FROM panel GROUP BY symbol),
segs AS (SELECT *, CAST(greatest(1, ceil((row_number() OVER (ORDER BY liq_med, symbol) - 1) * 5 / nullif(count(*) OVER () - 1, 0)::DOUBLE)) AS INT) AS liq_bucket,
  CAST(greatest(1, ceil((row_number() OVER (ORDER BY vol_med, symbol) - 1) * 5 / nullif(count(*) OVER () - 1, 0)::DOUBLE)) AS INT) AS vol_bucket FROM per)"""


def segment_query(column):
    def run(s, d):
        p = panel(s, d)
        preds = prediction_panel(s, d).select("symbol", "Date", "y_pred", "y_true")
        return rounded(X.segment_ic(preds, X.symbol_segments(p), column, min_names=3).withColumn("segment", F.col("segment").cast("string")))

    sql = f"""WITH {PANEL}{SEGMENTS}, seg AS (SELECT preds.symbol, dt, y_pred, y_true, segs.{column} AS segment FROM preds JOIN segs USING (symbol)){ic_sql('segment, dt', 3, 'seg')},
    sm AS (SELECT segment, {SUMMARY} FROM daily GROUP BY segment), sz AS (SELECT {column} AS segment, count(DISTINCT symbol) AS n_symbols FROM segs GROUP BY 1)
    SELECT CAST(segment AS VARCHAR) AS segment, n_symbols, ic_mean, ic_std, icir, pct_positive, coalesce(n_days, 0) AS n_days FROM sz LEFT JOIN sm USING (segment)"""
    return run, sql


def halves(s, d):
    p = panel(s, d).select("liq_log", "vol", "target", F.when(F.col("Date") < "1998-06-01", "train").otherwise("holdout").alias("part"))
    return rounded(X.psi(p, ["liq_log", "vol", "target"]))


def daily_scores(s, d):
    return rounded(X.peer_scores(prediction_panel(s, d).select("symbol", "Date", "y_pred")))


def tendencies(s, d):
    scores = X.peer_scores(prediction_panel(s, d).select("symbol", "Date", "y_pred"))
    return rounded(trend_tendency(scores).select("symbol", "Date", "trend_label", "trend_prob_up", "trend_expected_return"))


PEERS = f"""WITH {PANEL}, r AS (SELECT symbol, dt, y_pred, count(*) OVER (PARTITION BY dt) AS n, {average_rank_sql('y_pred', 'dt')} AS k FROM preds),
p AS (SELECT *, 2 * (k - 0.5) / n - 1 AS score, 100 * (k - 0.5) / n AS pct FROM r)"""
PSI_SQL = f"""WITH {PANEL}, long AS (SELECT CASE WHEN dt < DATE '1998-06-01' THEN 'train' ELSE 'holdout' END AS part, f.feature, f.value FROM panel, (VALUES (1)) x(i), LATERAL (SELECT unnest(['liq_log', 'vol', 'target']) AS feature, unnest([liq_log, vol, target]) AS value) f WHERE f.value IS NOT NULL),
e AS (SELECT feature, min(value) - 1e-9 AS lo, max(value) + 1e-9 AS hi FROM long GROUP BY feature),
c AS (SELECT feature, least(10, CAST(floor((value - lo) / (hi - lo) * 10) AS INT) + 1) AS bin, count(CASE WHEN part = 'train' THEN 1 END) AS t, count(CASE WHEN part = 'holdout' THEN 1 END) AS h FROM long JOIN e USING (feature) GROUP BY 1, 2),
k AS (SELECT e.feature, b.bin, coalesce(t, 0) AS t, coalesce(h, 0) AS h FROM e CROSS JOIN (SELECT unnest(generate_series(1, 10)) AS bin) b LEFT JOIN c ON c.feature = e.feature AND c.bin = b.bin),
s AS (SELECT *, sum(t) OVER (PARTITION BY feature) AS nt, sum(h) OVER (PARTITION BY feature) AS nh FROM k),
q AS (SELECT *, CASE WHEN t > 0 THEN t / nt::DOUBLE ELSE 1e-4 END AS ts, CASE WHEN h > 0 THEN h / nh::DOUBLE ELSE 1e-4 END AS hs FROM s)
SELECT feature, round(CASE WHEN max(nt) >= 20 AND max(nh) >= 20 THEN greatest(0, sum((hs - ts) * ln(hs / ts))) ELSE 0 END, 6) AS psi FROM q GROUP BY feature"""

PLANS = {
    "d1_rank_target": (
        lambda s, d: rounded(X.cross_sectional_target(panel(s, d)).select("symbol", "Date", "target_cs")),
        f"""WITH {PANEL}, t AS (SELECT *, count(*) OVER (PARTITION BY dt) AS n, 2 * ({average_rank_sql('target', 'dt')} - 0.5) / count(*) OVER (PARTITION BY dt) - 1 AS cs FROM panel WHERE target IS NOT NULL)
        SELECT symbol, dt AS "Date", round(cs, 6) AS target_cs FROM t WHERE n >= {NAMES}""",
    ),
    "d1_zscore_target": (
        lambda s, d: rounded(X.cross_sectional_target(panel(s, d), method="zscore").select("symbol", "Date", "target_cs")),
        f"""WITH {PANEL}, t AS (SELECT *, count(*) OVER (PARTITION BY dt) AS n, (target - avg(target) OVER (PARTITION BY dt)) / nullif(stddev_samp(target) OVER (PARTITION BY dt), 0) AS cs FROM panel WHERE target IS NOT NULL)
        SELECT symbol, dt AS "Date", round(cs, 6) AS target_cs FROM t WHERE n >= {NAMES} AND cs IS NOT NULL""",
    ),
    "d2_cross_features": (
        lambda s, d: rounded(X.cross_sectional_features(panel(s, d), ["liq_log", "vol"]).select("symbol", "Date", "liq_log_csr", "liq_log_csz", "vol_csr", "vol_csz")),
        f"""WITH {PANEL} SELECT symbol, dt AS "Date", """
        + ", ".join(f"""round(coalesce(CASE WHEN {c} IS NOT NULL THEN 2 * ({average_rank_sql(c + ' NULLS LAST', 'dt').replace(f'dt, {c} NULLS LAST', f'dt, {c}')} - 0.5) / count(*) OVER (PARTITION BY dt) - 1 END, 0), 6) AS {c}_csr, round(coalesce(({c} - avg({c}) OVER (PARTITION BY dt)) / nullif(stddev_samp({c}) OVER (PARTITION BY dt), 0), 0), 6) AS {c}_csz""" for c in ("liq_log", "vol"))
        + " FROM panel",
    ),
    "d3_percent_rank": (
        lambda s, d: rounded(prediction_panel(s, d).select("symbol", "Date", X.percent_rank("y_pred").alias("pct"))),
        f"""WITH {PANEL} SELECT symbol, dt AS "Date", round({average_rank_sql('y_pred', 'dt')} / count(*) OVER (PARTITION BY dt), 6) AS pct FROM preds""",
    ),
    "d4_rank_blend": (
        lambda s, d: rounded(X.rank_blend(prediction_panel(s, d).withColumn("second", -F.col("vol")).where("second is not null"), "y_pred", "second").select("symbol", "Date", F.col("y_pred").alias("blend"))),
        f"""WITH {PANEL}, p AS (SELECT symbol, dt, y_pred, -vol AS second FROM preds WHERE vol IS NOT NULL)
        SELECT symbol, dt AS "Date", round(0.3 * {average_rank_sql('y_pred', 'dt')} / count(*) OVER (PARTITION BY dt) + 0.7 * {average_rank_sql('second', 'dt')} / count(*) OVER (PARTITION BY dt), 6) AS blend FROM p""",
    ),
    "d5_daily_rank_ic": (lambda s, d: rounded(X.daily_rank_ic(prediction_panel(s, d), NAMES)), f"""WITH {PANEL}{ic_sql('dt', NAMES)} SELECT dt AS "Date", round(ic, 6) AS ic, n FROM daily"""),
    "d5_ic_summary": (lambda s, d: rounded(X.ic_summary(X.daily_rank_ic(prediction_panel(s, d), NAMES))), f"WITH {PANEL}{ic_sql('dt', NAMES)} SELECT {SUMMARY} FROM daily"),
    "d6_dates_apart": (
        lambda s, d: rounded(X.apart(X.daily_rank_ic(prediction_panel(s, d), NAMES), 21)),
        f"""WITH RECURSIVE {PANEL.strip()}{ic_sql('dt', NAMES)}, walk AS (SELECT min(dt) AS dt FROM daily UNION ALL SELECT (SELECT min(dt) FROM daily WHERE dt >= walk.dt + 21) FROM walk WHERE walk.dt IS NOT NULL)
        SELECT walk.dt AS "Date", round(ic, 6) AS ic FROM walk JOIN daily ON daily.dt = walk.dt""",
    ),
    "d7_symbol_segments": (lambda s, d: rounded(X.symbol_segments(panel(s, d))), f"WITH {PANEL}{SEGMENTS} SELECT symbol, round(liq_med, 6) AS liq_med, round(vol_med, 6) AS vol_med, sector, liq_bucket, vol_bucket FROM segs"),
    "d8_segment_ic_liquidity": segment_query("liq_bucket"),
    "d20_segment_ic_volatility": segment_query("vol_bucket"),
    "d20_segment_ic_sector": segment_query("sector"),
    "d11_quintile_grid": (
        lambda s, d: rounded(X.quintile_grid(prediction_panel(s, d))),
        f"""WITH {PANEL}, q AS (SELECT *, count(*) OVER (PARTITION BY dt) AS n, row_number() OVER (PARTITION BY dt ORDER BY y_pred, symbol) AS r FROM preds),
        b AS (SELECT *, CASE WHEN n >= 8 THEN CAST(CAST(greatest(1, ceil((r - 1) * 5 / (n - 1)::DOUBLE)) AS INT) AS VARCHAR) ELSE 'NA' END AS quintile FROM q)
        SELECT coalesce(quintile, 'ALL') AS quintile, count(*) AS n, round(avg(CASE WHEN y_true > 0 THEN 1.0 ELSE 0 END), 6) AS share_up, round(avg(y_true), 6) AS mean_return FROM b GROUP BY ROLLUP (quintile)""",
    ),
    "d12_peer_scores": (
        daily_scores,
        f"""{PEERS} SELECT symbol, dt AS "Date", round(y_pred, 6) AS y_pred, n AS universe_size, round(score, 6) AS peer_score, round(pct, 6) AS peer_percentile,
          CASE WHEN n < 15 THEN 'unknown' WHEN pct >= 70 THEN 'outperform' WHEN pct <= 30 THEN 'underperform' ELSE 'inline' END AS peer_label FROM p""",
    ),
    "d16_trend_tendency": (
        tendencies,
        f"""{PEERS}, q AS (SELECT *, n >= 15 AS known, CAST(least(4, floor(pct / 20)) AS INT) + 1 AS q FROM p)
        SELECT symbol, dt AS "Date", CASE WHEN NOT known THEN 'uncertain' WHEN pct >= 70 THEN 'up' WHEN pct <= 30 THEN 'down' ELSE 'flat' END AS trend_label,
          CASE WHEN known THEN [0.435, 0.487, 0.509, 0.519, 0.541][q]::DOUBLE END AS trend_prob_up, CASE WHEN known THEN [-0.0066, 0.0032, 0.0050, 0.0062, 0.0090][q]::DOUBLE END AS trend_expected_return FROM q""",
    ),
    "d18_psi": (halves, PSI_SQL),
}
