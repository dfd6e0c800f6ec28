"""Queries over leaderboards, drift, regimes, peers and JSON series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import boards as T
from tidemark.operators import metrics as M
from tidemark.operators import xsection as X
from tidemark.plans.backtests import BUY, POSITIONS, SELL, TRADES, curve, fold_rows, trade_log
from tidemark.plans.common import BARS, MODELS, SECTORS, model_rows, panel, prediction_panel, rounded, sectors
from tidemark.plans.selections import SCORED, scored
from tidemark.plans.series import DRIFT, gated, over
from tidemark.session import table
from tidemark.sources.bars import table_bars


def board(s, d):
    return rounded(T.sector_summary(scored(s, d).select("symbol", "model", "composite").join(sectors(s, d), "symbol")))


def fold_curves(s, d):
    """Per model and year the means over symbols of net return, Sharpe and drawdown of the curve within the year."""
    rows = B.hysteresis(model_rows(s, d), BUY, SELL).withColumns({"fold": F.year("Date"), "model_name": F.col("model")})
    within = B.equity_curve(rows.withColumn("model", F.concat_ws("|", "model", "fold"))).withColumn("own", F.col("net_equity"))
    per = within.groupBy("symbol", "model").agg(F.max("model_name").alias("m"), F.max("fold").alias("fold"), (F.max_by("own", "Date") - 1).alias("net_return"), M.sharpe(F.col("net_return")).alias("sharpe"))
    per = per.join(M.drawdown(within, "own"), ["symbol", "model"])
    return per.groupBy(F.col("m").alias("model"), "fold").agg(*[F.avg(x).alias(x) for x in ("net_return", "sharpe", "max_drawdown")])


def peers(s, d):
    """Peers of the newest date that has 15 of them; a symbol is stale whose last bar is over a week older."""
    p, preds = panel(s, d), prediction_panel(s, d).select("symbol", "Date", "y_pred", "y_true")
    segments = X.symbol_segments(p)
    by = {c: X.segment_ic(preds, segments, c, 3) for c in ("liq_bucket", "vol_bucket", "sector")}
    newest = table_bars(s, d).groupBy("symbol").agg(F.max("Date").alias("last_bar"))
    scores = X.peer_scores(X.newest_date(preds, 15).select("symbol", "Date", "y_pred")).join(newest, "symbol")
    scores = scores.withColumn("stale", F.datediff(F.max("last_bar").over(Window.partitionBy("Date")), "last_bar") > 7).drop("last_bar")
    out = T.peer_table(scores, segments, by, {"liq_bucket": 0.5, "vol_bucket": 0.3, "sector": 0.2}, 5.0)
    words = [F.concat_ws("|", f"confidence_{c}").alias(c) for c in ("reasons", "warnings")]
    return rounded(out.select("symbol", "Date", "peer_score", "peer_percentile", "peer_label", "stale", "tradable", "icir", "confidence_label", *words, "trend_label", "trend_prob_up", "trend_expected_return"))


def quantiles(s, d):
    rows = model_rows(s, d).where("model = 'reversal'").select("symbol", "Date", "y_pred", "y_true")
    cut = F.lit("1999-01-01").cast("date")
    return rounded(T.residual_quantiles(rows.where(F.col("Date") < cut), rows.where(F.col("Date") >= cut)).select("symbol", "Date", "q_10", "q_50", "q_90"))


FP = "PARTITION BY symbol, model, fold ORDER BY dt"
FOLDED = f"""{POSITIONS.removeprefix(MODELS).lstrip(', ')}, fy AS (SELECT *, CAST(year(dt) AS INT) AS fold FROM ev),
y2 AS (SELECT *, lag(pos) OVER ({FP}) AS fprev, lead(dt) OVER ({FP}) IS NULL AS flast FROM fy), y3 AS (SELECT *, pos * rr - (CAST(coalesce(fprev, 0) = 0 AND pos = 1 AS INT) + CAST(coalesce(fprev, 0) = 1 AND pos = 0 AS INT) + CAST(flast AND pos = 1 AS INT)) * 15 / 1e4 AS fnet FROM y2),
y4 AS (SELECT *, CASE WHEN min(1 + fnet) OVER w <= 0 THEN 0 ELSE exp(sum(ln(CASE WHEN 1 + fnet > 0 THEN 1 + fnet END)) OVER w) END AS own FROM y3 WINDOW w AS ({FP} ROWS UNBOUNDED PRECEDING)),
y5 AS (SELECT *, own / greatest(max(own) OVER ({FP} ROWS UNBOUNDED PRECEDING), 1e-12) - 1 AS fall FROM y4),
per AS (SELECT symbol, model, fold, arg_max(own, dt) - 1 AS net_return, avg(fnet) / nullif(stddev_pop(fnet), 0) * sqrt(252) AS sharpe, min(fall) AS max_drawdown FROM y5 GROUP BY 1, 2, 3)"""
REGIMES = f"""WITH {BARS}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY dt) AS DOUBLE) AS rn FROM bars),
t AS (SELECT *, {gated('avg(c)', 'c', 50)} AS s, {gated('avg(c)', 'c', 200)} AS l2, CASE WHEN count(c) {over(20)} >= 20 THEN regr_slope(c, rn) {over(20)} / (avg(c) {over(20)} + 1e-9) END AS slope FROM n),
rg AS (SELECT *, CASE WHEN s IS NULL THEN 'uncertain' WHEN l2 IS NULL THEN CASE WHEN c > s AND slope > 0 THEN 'bull' WHEN c <= s AND slope < 0 THEN 'bear' ELSE 'uncertain' END
  WHEN c > s AND c > l2 AND s > l2 AND slope > 0 THEN 'bull' WHEN c <= s AND c <= l2 AND s <= l2 AND slope < 0 THEN 'bear' WHEN abs(slope) < 0.001 THEN 'sideways' ELSE 'uncertain' END AS regime FROM t)"""

PLANS = {
    "a16_json_series": (
        lambda s, d: table(s, d, "events").groupBy(F.to_date("ts").alias("Date")).agg(F.count(F.lit(1)).alias("n")).transform(lambda x: T.json_series(x.withColumn("item", F.to_json(F.struct(F.col("Date").cast("string").alias("Date"), F.concat(F.col("n").cast("string"), F.lit(",5")).alias("N")))), "item")).select("item_date", "item_value"),
        "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS item_date, count(*) + 0.5::DOUBLE AS item_value FROM events GROUP BY 1",
    ),
    "d17_peer_table": (peers, None),
    "d19_drift_tiers": (
        lambda s, d: rounded(T.drift_tiers(table_bars(s, d))),
        f"""WITH {BARS}{DRIFT}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM drift),
        l AS (SELECT symbol, k <= 30 AS new, unnest(['logret', 'range_rel', 'dlog_volume']) AS feature, unnest([logret, range_rel, dlog_volume]) AS v FROM k WHERE k <= 282 AND n >= 93),
        e AS (SELECT *, min(v) OVER (PARTITION BY symbol, feature) AS lo, max(v) OVER (PARTITION BY symbol, feature) AS hi FROM l),
        b AS (SELECT symbol, feature, least(3, coalesce(CAST(floor((v - lo) / nullif(hi - lo, 0) * 3) AS INT) + 1, 1)) AS bin, count(CASE WHEN new THEN 1 END) AS h, count(CASE WHEN NOT new THEN 1 END) AS t FROM e GROUP BY 1, 2, 3),
        g AS (SELECT a.symbol, a.feature, a.bin, coalesce(h, 0) AS h, coalesce(t, 0) AS t FROM (SELECT DISTINCT symbol, feature, unnest([1, 2, 3]) AS bin FROM b) a LEFT JOIN b USING (symbol, feature, bin)),
        s AS (SELECT *, CASE WHEN h > 0 THEN h / sum(h) OVER w ELSE 1e-4 END AS hs, CASE WHEN t > 0 THEN t / sum(t) OVER w ELSE 1e-4 END AS ts FROM g WINDOW w AS (PARTITION BY symbol, feature)),
        f AS (SELECT symbol, feature, greatest(0, sum((hs - ts) * ln(hs / ts))) AS psi FROM s GROUP BY 1, 2), m AS (SELECT symbol, max(psi) AS psi_max FROM f GROUP BY symbol), n AS (SELECT symbol, count(*) AS n FROM drift GROUP BY symbol)
        SELECT a.symbol, CASE WHEN coalesce(n, 0) < 93 THEN 'insufficient_history' END AS reason, round(psi_max, 6) AS psi_max,
          CASE WHEN psi_max IS NULL THEN 'unavailable' WHEN psi_max < 0.1 THEN 'stable' WHEN psi_max < 0.25 THEN 'moderate_drift' ELSE 'major_drift' END AS tier FROM (SELECT DISTINCT symbol FROM bars) a LEFT JOIN n USING (symbol) LEFT JOIN m USING (symbol)""",
    ),
    "e6_deflated_sharpe": (
        lambda s, d: rounded(T.deflated_sharpe(curve(s, d), 10).select("symbol", "model", "n", "sr", "error", "deflated")),
        f"""WITH {POSITIONS}, q AS (SELECT symbol, model, count(net) AS n, coalesce(avg(net) / nullif(stddev_pop(net), 0) * sqrt(252), 0) AS sr FROM eq GROUP BY 1, 2), r AS (SELECT *, sqrt(greatest(1e-12, (1 + 0.5 * sr * sr) / n)) AS error FROM q)
        SELECT symbol, model, n, round(sr, 6) AS sr, round(error, 6) AS error, round(CASE WHEN n < 3 THEN 0 ELSE sr - sqrt(2 * ln(10)) * error END, 6) AS deflated FROM r""",
    ),
    "e6_sharpe_score": (lambda s, d: rounded(T.deflated_sharpe(curve(s, d), 10).select("symbol", "model", "score")), None),
    "e12_worst_fold": (
        lambda s, d: rounded(M.worst_fold(fold_curves(s, d))),
        f"""WITH {MODELS}, {FOLDED}, f AS (SELECT model, fold, avg(net_return) AS net_return, avg(sharpe) AS sharpe, avg(max_drawdown) AS max_drawdown FROM per GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY net_return, sharpe, max_drawdown, fold) AS k FROM f)
        SELECT model, fold, round(net_return, 6) AS net_return, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown FROM k WHERE k = 1""",
    ),
    "e21_sector_summary": (
        board,
        f"""{SCORED}, {SECTORS}, js AS (SELECT c.symbol, model, composite, sector FROM c JOIN sectors USING (symbol)), k AS (SELECT sector, model, count(*) AS n FROM js GROUP BY 1, 2),
        g AS (SELECT sector, string_agg(model, '|' ORDER BY n DESC, model) AS models FROM k GROUP BY 1)
        SELECT sector, count(DISTINCT symbol) AS symbols, count(CASE WHEN composite >= 50 THEN 1 END) AS strong, round(avg(composite), 6) AS mean_composite, any_value(models) AS models FROM js JOIN g USING (sector) GROUP BY sector""",
    ),
    "e24_model_comparison": (
        lambda s, d: rounded(scored(s, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("rmse").alias("avg_rmse"), F.avg("dir_acc").alias("avg_dir_acc"), F.max("composite").alias("best_composite"))),
        f"{SCORED} SELECT model, count(*) AS n, round(avg(rmse), 6) AS avg_rmse, round(avg(dir_acc), 6) AS avg_dir_acc, round(max(composite), 6) AS best_composite FROM c GROUP BY model",
    ),
    "e35_regime_context": (
        lambda s, d: rounded(T.regime_context(table_bars(s, d)).select("symbol", "Date", (F.col("slope") * 100).alias("slope_pct"), "regime")),
        f"""{REGIMES} SELECT symbol, dt AS "Date", round(slope * 100, 6) AS slope_pct, regime FROM rg""",
    ),
    "e35_relative_strength": (
        lambda s, d: rounded(T.strength_against(table_bars(s, d), table_bars(s, d).groupBy("Date").agg(F.avg("Close").alias("index_close")))),
        f"""WITH {BARS}, i AS (SELECT dt, avg(c) AS c FROM bars GROUP BY dt), ik AS (SELECT *, row_number() OVER (ORDER BY dt DESC) AS k FROM i), ir AS (SELECT arg_max(c, dt) / arg_min(c, dt) - 1 AS r, count(*) AS n FROM ik WHERE k <= 60),
        bk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k FROM bars), br AS (SELECT symbol, arg_max(c, dt) / arg_min(c, dt) - 1 AS r, count(*) AS n FROM bk WHERE k <= 60 GROUP BY symbol)
        SELECT symbol, round(br.r - ir.r, 6) AS return_gap, CASE WHEN least(br.n, ir.n) >= 5 AND br.r - ir.r > 0.02 THEN 'outperforming' WHEN least(br.n, ir.n) >= 5 AND br.r - ir.r < -0.02 THEN 'underperforming' ELSE 'inline' END AS relative_strength FROM br, ir""",
    ),
    "e35_alignment": (
        lambda s, d: T.regime_context(table_bars(s, d)).join(prediction_panel(s, d).select("symbol", "Date", "y_pred"), ["symbol", "Date"]).select("symbol", "Date", T.alignment(F.col("regime"), F.col("y_pred")).alias("alignment")),
        f"""{REGIMES}, p AS (SELECT *, -ln(c / lag(c, 5) OVER w) AS y_pred, ln(lead(c, 5) OVER w / c) AS target FROM rg WINDOW w AS (PARTITION BY symbol ORDER BY dt))
        SELECT symbol, dt AS "Date", CASE WHEN (regime = 'bull' AND y_pred > 0) OR (regime = 'bear' AND y_pred < 0) THEN 'aligned' WHEN (regime = 'bull' AND y_pred < 0) OR (regime = 'bear' AND y_pred > 0) THEN 'misaligned' ELSE 'neutral' END AS alignment
        FROM p WHERE y_pred IS NOT NULL AND target IS NOT NULL""",
    ),
    "h20_gate_diagnostics": (
        lambda s, d: rounded(T.gate_diagnostics(model_rows(s, d), [0.01, 0.05, 0.2])),
        f"""WITH {MODELS}, g AS (SELECT unnest([0.01, 0.05, 0.2])::DOUBLE AS threshold) SELECT model, threshold, count(CASE WHEN y_pred > threshold THEN 1 END) AS would_buy, round(avg(CASE WHEN y_pred > threshold THEN 1.0 ELSE 0 END), 6) AS share, round(quantile_cont(y_pred, 0.5), 6) AS median_pred FROM models, g GROUP BY 1, 2""",
    ),
    "h21_diagnosis": (
        lambda s, d: T.diagnosis(M.backtest_summary(curve(s, d), trade_log(s, d))).select("symbol", "model", "diagnosis"),
        f"""WITH {TRADES}, lg AS (SELECT symbol, model, count(*) AS k FROM log GROUP BY 1, 2), m AS (SELECT symbol, model, arg_max(neq, dt) AS n, arg_max(beq, dt) AS b, avg(net) / nullif(stddev_pop(net), 0) AS sr FROM eq GROUP BY 1, 2),
        r AS (SELECT symbol, model, concat_ws(',', CASE WHEN n <= b THEN 'underperform_buyhold' END, CASE WHEN coalesce(k, 0) < 6 THEN 'insufficient_trades' END, CASE WHEN sr <= 0 THEN 'model_signal_weak' END) AS x FROM m LEFT JOIN lg USING (symbol, model))
        SELECT symbol, model, CASE WHEN x = '' THEN 'ok' ELSE x END AS diagnosis FROM r""",
    ),
    "j7_residual_quantiles": (
        quantiles,
        f"""WITH {MODELS}, q AS (SELECT symbol, quantile_cont(y_true - y_pred, [0.1, 0.5, 0.9]) AS q FROM models WHERE model = 'reversal' AND dt < DATE '1999-01-01' GROUP BY symbol)
        SELECT symbol, dt AS "Date", round(y_pred + q[1], 6) AS q_10, round(y_pred + q[2], 6) AS q_50, round(y_pred + q[3], 6) AS q_90 FROM models JOIN q USING (symbol) WHERE model = 'reversal' AND dt >= DATE '1999-01-01'""",
    ),
    "j13_stacker_weights": (
        lambda s, d: rounded(T.stacker_weights(model_rows(s, d), ["momentum", "reversal"])),
        f"""WITH {MODELS}, w AS (SELECT symbol, dt, max(CASE WHEN model = 'momentum' THEN y_pred END) AS x, max(CASE WHEN model = 'reversal' THEN y_pred END) AS z, max(y_true) AS y FROM models GROUP BY 1, 2),
        g AS (SELECT sum(x * x) + 1 AS a, sum(x * z) AS b, sum(z * z) + 1 AS c, sum(x * y) AS p, sum(z * y) AS q FROM w), s AS (SELECT greatest(0, (p * c - q * b) / (a * c - b * b)) AS m, greatest(0, (q * a - p * b) / (a * c - b * b)) AS r FROM g)
        SELECT 'momentum' AS model, round(CASE WHEN m + r > 0 THEN m / (m + r) ELSE 0.5 END, 6) AS weight FROM s UNION ALL SELECT 'reversal', round(CASE WHEN m + r > 0 THEN r / (m + r) ELSE 0.5 END, 6) FROM s""",
    ),
    "l8_pivot": (
        lambda s, d: rounded(fold_rows(s, d).groupBy("fold").pivot("model", ["momentum", "reversal"]).agg(F.avg("dir_acc"))),
        f"""WITH {MODELS}, m AS (SELECT symbol, model, CAST(year(dt) AS INT) AS fold, 100 * avg(CASE WHEN sign(y_pred) = sign(y_true) THEN 1.0 ELSE 0 END) AS a FROM models GROUP BY 1, 2, 3)
        SELECT fold, round(avg(CASE WHEN model = 'momentum' THEN a END), 6) AS momentum, round(avg(CASE WHEN model = 'reversal' THEN a END), 6) AS reversal FROM m GROUP BY fold""",
    ),
}
