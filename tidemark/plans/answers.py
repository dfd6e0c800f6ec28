"""Queries over the macro matrix, pooled studies, scopes, explanations and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import boards as T
from tidemark.operators import explain as J
from tidemark.operators import leaderboard as Z
from tidemark.operators import macro as A
from tidemark.operators import quality as Q
from tidemark.operators import runs as R
from tidemark.operators import selection as L
from tidemark.operators import splits as S
from tidemark.operators import studies as G
from tidemark.plans.backtests import TRADES, trade_log
from tidemark.plans.boards import peers
from tidemark.plans.common import BARS, MODELS, PANEL, model_rows, panel, prediction_panel, rounded
from tidemark.plans.runs import RUNS, UNIVERSE, months, order_days, run_table, universe
from tidemark.plans.selections import experiments, scored, scored_sql, signals
from tidemark.plans.serving import points
from tidemark.session import table
from tidemark.sources.bars import latest_rows, table_bars

START, END = "1997-01-01", "1998-12-31"
C = scored_sql("fold")


def macro(s, d):
    """Mean order price and mean close of the day as base series, traded quantity beside them, order prices of the month as rate and prices."""
    closes = table_bars(s, d).groupBy("Date").agg(F.avg("Close").alias("close"))
    volume = table_bars(s, d).groupBy("Date").agg(F.sum("Volume").alias("volume"))
    return rounded(A.macro_matrix((order_days(s, d, "orders"), closes), [volume], months(s, d), months(s, d), START, END))


def study(s, d):
    def assign(rows):
        return S.assign_pooled(rows, S.pooled_folds(rows, window=63, folds=3, embargo=10))

    return rounded(G.ic_study(panel(s, d).where("ret is not null and vol is not null and liq_log is not null"), assign, ["ret", "vol", "liq_log"]))


def specs(s):
    return s.createDataFrame([("reversal", "contrarian", "candidate", True, True), ("momentum", "trend", "benchmark", False, True)], "model string, category string, role string, default_candidate boolean, available boolean")


def importances(s, d):
    """The size of each feature's correlation with the target, by year."""
    rows = panel(s, d).where("target is not null")
    per = rows.groupBy("symbol", F.year("Date").alias("fold")).agg(*[F.abs(F.corr(c, "target")).alias(c) for c in ("ret", "vol", "liq_log")])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in ("ret", "vol", "liq_log")])
    return per.select("symbol", F.lit("linear").alias("model"), "fold", F.explode(pairs).alias("p")).select("symbol", "model", "fold", "p.*").where("importance is not null")


def explained(s, d):
    """Reversal by its linear contributions, momentum by rule."""
    newest = panel(s, d).where("ret is not null and vol is not null").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("Date")))).where("k = 1")
    pairs = F.array(F.struct(F.lit("ret").alias("feature"), (-F.col("ret")).alias("contribution")), F.struct(F.lit("vol").alias("feature"), (0.5 * F.col("vol")).alias("contribution")))
    linear = newest.select("symbol", F.lit("reversal").alias("model"), F.explode(pairs).alias("p")).select("symbol", "model", "p.*")
    return rounded(J.explain(model_rows(s, d), s.createDataFrame([("reversal", "linear")], "model string, family string"), {"linear": linear}))


def flags(s, d):
    bars = table_bars(s, d)
    anomalies = Q.recent_anomaly(bars.select("symbol").distinct(), Q.corporate_actions(bars), F.lit("2001-12-31").cast("date"), 120)
    drift = T.drift_tiers(bars).where("psi_max is not null").select("symbol", F.lit("largest").alias("feature"), F.col("psi_max").alias("psi"))
    return rounded(J.quality_flags(bars, anomalies, Q.survivorship(bars), drift, F.lit(0.0)).drop("psi_scores"))


def answer_table(s, d):
    best = L.best_models(experiments(s, d)).select("symbol", "model", "dir_acc", "rmse_ratio", (F.col("dir_acc") / 100).alias("stability"), F.lit("ok").alias("diagnosis"), F.col("reason").alias("eligibility"), "composite")
    path = R.forecast_runs(points(s, d), R.realized_volatility(table_bars(s, d).where("Date < '1999-06-01'"))).select("symbol", "path_return", "label", F.lit(0.8).alias("agreement"))
    fresh = Q.freshness(table_bars(s, d), 5).select("symbol", "last_date", "stale")
    drift = T.drift_tiers(table_bars(s, d)).select("symbol", "psi_max", "tier")
    out = J.answers(best, path, fresh, drift, peers(s, d).select("symbol", "peer_label", "peer_percentile"), Z.confidence)
    return rounded(out.select(
        "symbol", "model.model", "forecast.label", "performance.dir_acc", F.col("freshness.last_date").cast("string").alias("seen"), "drift.tier", F.col("confidence.label").alias("confidence"),
        F.concat_ws("|", "confidence.reasons").alias("reasons"), F.concat_ws("|", "confidence.warnings").alias("warnings"), "peer.peer_label", "status",
    ))


def pairs(s, d):
    """Runs of the leaderboard as two reports, of which the final one lacks a model here and there."""
    rows = run_table(s, d)
    models = rows.select("symbol", "run_id", "model")
    wf = rows.select("symbol", "run_id", "model", F.col("wf_net").alias("net"))
    final = rows.where("not (model = 'momentum' and run_id = '1996')").select("symbol", "run_id", "model", F.col("final_net").alias("net"), F.col("final_trades").alias("trades"))
    missing = models.where("run_id = '1997'").select("symbol", "run_id", F.lit("run_manifest.json").alias("missing")).distinct()
    return rounded(G.report_pairs(models, wf, final, missing))


def matrix(s, d):
    rows = run_table(s, d).select("symbol", "model", F.col("run_id").alias("policy"), "reliability")
    return G.matrix_status(rows.drop("reliability"), rows.where("reliability = 'research_candidate' or policy = '1999'"), rows.where("reliability = 'unstable'").withColumn("error", F.lit("unstable")), resume=False)


def backfilled(s, d):
    """Logged years get net return and trades from the runs of one model."""
    log = experiments(s, d).select("symbol", F.col("fold").cast("string").alias("run_id"), "model", F.lit("walk_forward").alias("validation_mode"), F.lit(-1.0).alias("net_return"), F.col("trade_count").cast("double").alias("trade_count"))
    runs = run_table(s, d).where("model = 'reversal'").select("symbol", "run_id", "model", F.lit("walk_forward").alias("validation_mode"), F.col("final_net").alias("net_return"), F.col("final_trades").alias("trade_count"))
    return rounded(G.backfill_metrics(log, runs, ["net_return", "trade_count"], kept=["trade_count"])[0].drop("validation_mode"))


W = "WINDOW w AS (ORDER BY dt ROWS UNBOUNDED PRECEDING)"


def changes_sql(c: str) -> str:
    return f"""round({c}_r, 6) AS {c}_ret, round(CASE WHEN count({c}_r) OVER v >= 7 THEN stddev_samp({c}_r) OVER v END, 6) AS {c}_vol7, round({c} / nullif(CASE WHEN count({c}) OVER v >= 7 THEN avg({c}) OVER v END, 0) - 1, 6) AS {c}_rel7"""


TABLES = ("orders", "lineitem", "part", "absent")

PLANS = {
    "f14_macro_matrix": (
        macro,
        f"""WITH {BARS}, lim AS (SELECT DATE '{START}' AS a, DATE '{END}' AS b), o AS (SELECT CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS orders FROM orders, lim WHERE CAST(o_orderdate AS DATE) BETWEEN a - 90 AND b GROUP BY 1),
        k AS (SELECT dt, avg(c) AS close, sum(v) AS volume FROM bars, lim WHERE dt BETWEEN a - 90 AND b GROUP BY 1),
        j AS (SELECT coalesce(o.dt, k.dt) AS dt, orders, close FROM o FULL JOIN k ON o.dt = k.dt), f AS (SELECT dt, last_value(orders IGNORE NULLS) OVER w AS orders, last_value(close IGNORE NULLS) OVER w AS close FROM j {W}),
        g AS (SELECT f.*, k.volume FROM f LEFT JOIN k USING (dt)), h AS (SELECT dt, orders, close, last_value(volume IGNORE NULLS) OVER w AS volume FROM g {W}),
        mo AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS dt, avg(o_totalprice) / 1e5 AS rate FROM orders GROUP BY 1), ml AS (SELECT mo.* FROM mo, lim WHERE dt BETWEEN a - 395 AND b),
        mr AS (SELECT dt + 1 AS dt, rate, rate - lag(rate) OVER (ORDER BY dt) AS rate_change FROM ml), mp AS (SELECT dt + 15 AS dt, rate / lag(rate) OVER (ORDER BY dt) - 1 AS mom, rate / lag(rate, 12) OVER (ORDER BY dt) - 1 AS yoy FROM ml),
        z AS (SELECT h.*, mr.rate, mr.rate_change, mp.mom, mp.yoy FROM h LEFT JOIN mr USING (dt) LEFT JOIN mp USING (dt)),
        y AS (SELECT dt, orders, close, volume, last_value(rate IGNORE NULLS) OVER w AS rate, last_value(rate_change IGNORE NULLS) OVER w AS rate_change, last_value(mom IGNORE NULLS) OVER w AS mom, last_value(yoy IGNORE NULLS) OVER w AS yoy FROM z {W}),
        x AS (SELECT *, orders / lag(orders) OVER (ORDER BY dt) - 1 AS orders_r, close / lag(close) OVER (ORDER BY dt) - 1 AS close_r, volume / lag(volume) OVER (ORDER BY dt) - 1 AS volume_r FROM y),
        e AS (SELECT dt, round(orders, 6) AS orders, round(close, 6) AS close, round(volume, 6) AS volume, round(rate, 6) AS rate, round(rate_change, 6) AS rate_change, round(mom, 6) AS mom, round(yoy, 6) AS yoy, round(rate - yoy, 6) AS real_rate,
          {changes_sql('orders')}, {changes_sql('close')}, {changes_sql('volume')} FROM x WINDOW v AS (ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
        SELECT dt AS "Date", * EXCLUDE (dt) FROM e WHERE dt >= DATE '{START}'""",
    ),
    "g16_ic_study": (study, None),
    "g8_per_symbol": (
        lambda s, d: rounded(G.per_symbol_metrics(prediction_panel(s, d).withColumn("fold", F.year("Date")), 1000, 0.01)),
        f"""WITH {PANEL}, q AS (SELECT symbol, year(dt) AS fold, y_pred, y_true FROM preds), g AS (SELECT symbol, fold, avg(CASE WHEN abs(y_pred) > 0.01 THEN CASE WHEN sign(y_pred) = sign(y_true) THEN 100.0 ELSE 0 END END) AS a FROM q GROUP BY 1, 2),
        f AS (SELECT symbol, count(*) AS n_folds, avg(CASE WHEN a >= 50 THEN 1.0 WHEN a < 50 THEN 0 END) AS p FROM g GROUP BY 1),
        w AS (SELECT symbol, count(*) AS n, avg(CASE WHEN abs(y_pred) > 0.01 THEN CASE WHEN sign(y_pred) = sign(y_true) THEN 100.0 ELSE 0 END END) AS a, sqrt(avg((y_true - y_pred) ** 2)) AS e, 100 * greatest(avg(CASE WHEN y_true > 0 THEN 1.0 ELSE 0 END), 1 - avg(CASE WHEN y_true > 0 THEN 1.0 ELSE 0 END)) AS b FROM q GROUP BY 1)
        SELECT symbol, n AS n_oos, round(a, 6) AS dir_acc, round(e, 6) AS rmse, round(b, 6) AS base_rate, n_folds, round(p, 6) AS positive_fold_ratio, round(a - b, 6) AS edge, n >= 1000 AS reliable FROM w JOIN f USING (symbol)""",
    ),
    "e13_worst_fold": (
        lambda s, d: rounded(G.worst_fold(scored(s, d, "fold")).select("symbol", "model", "fold", "composite", "rmse")),
        f"{C} SELECT symbol, model, fold, composite, round(rmse, 6) AS rmse FROM c QUALIFY row_number() OVER (PARTITION BY symbol, model ORDER BY composite NULLS LAST, rmse DESC NULLS LAST, fold) = 1",
    ),
    "e17_report_order": (
        lambda s, d: rounded(G.report_order(run_table(s, d).select("symbol", "run_id", "model", F.col("final_net").alias("net_return"), F.col("final_sharpe").alias("sharpe")), ("symbol", "run_id"))),
        f"""{RUNS} SELECT symbol, run_id, model, round(fn, 6) AS net_return, round(sh * sqrt(252), 6) AS sharpe, CAST(row_number() OVER (PARTITION BY symbol, run_id ORDER BY fn DESC NULLS LAST, sh DESC NULLS LAST, model) AS INT) AS place FROM rb""",
    ),
    "e18_best_candidate": (
        lambda s, d: rounded(G.best_candidate(scored(s, d, "fold").withColumns({"is_candidate": F.col("fold") > 1996, "model": F.concat_ws("|", "model", "fold")})).select("symbol", "model", "composite")),
        f"{C} SELECT symbol, model || '|' || fold AS model, composite FROM c WHERE fold > 1996 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY composite DESC NULLS LAST, rmse NULLS LAST, model || '|' || fold) = 1",
    ),
    "e37_scoped": (
        lambda s, d: rounded(G.scoped(scored(s, d), specs(s), G.resolve_candidates(specs(s))).select("symbol", "model", "composite", "family", "report_group", "is_candidate", "reportable")),
        f"""{scored_sql()} SELECT symbol, model, composite, CASE model WHEN 'reversal' THEN 'contrarian' ELSE 'trend' END AS family, CASE model WHEN 'reversal' THEN 'candidate' ELSE 'benchmark' END AS report_group, model = 'reversal' AS is_candidate, true AS reportable FROM c""",
    ),
    "j20_signal_reasons": (lambda s, d: rounded(J.signal_reasons(signals(s, d).withColumn("expected_return", F.col("y_pred"))).select("symbol", "model", "Date", "decision", "risk_state", "reason")), None),
    "j20_signal_summary": (lambda s, d: rounded(J.signal_summary(signals(s, d).withColumn("expected_return", F.col("y_pred")))), None),
    "j20_trade_explanations": (
        lambda s, d: J.trade_explanations(trade_log(s, d)).select("symbol", "model", "trade_id", "outcome", "explanation"),
        f"""WITH {TRADES}, x AS (SELECT *, CASE WHEN net_return > 0 THEN 'gain' WHEN net_return < 0 THEN 'loss' ELSE 'even' END AS outcome FROM log)
        SELECT symbol, model, CAST(trade_id AS BIGINT) AS trade_id, outcome, model || ' closed with a ' || outcome || ' after ' || holding_bars || ' bars; exit: ' || exit_reason AS explanation FROM x""",
    ),
    "j23_fold_importance": (
        lambda s, d: rounded(J.fold_importance(importances(s, d))),
        f"""WITH {PANEL}, y AS (SELECT symbol, year(dt) AS fold, abs(corr(ret, target)) AS a, abs(corr(vol, target)) AS b, abs(corr(liq_log, target)) AS c FROM panel WHERE target IS NOT NULL GROUP BY 1, 2),
        l AS (SELECT symbol, fold, unnest(['ret', 'vol', 'liq_log']) AS feature, unnest([a, b, c]) AS i FROM y), g AS (SELECT symbol, feature, avg(i) AS i, count(*) AS folds FROM l WHERE i IS NOT NULL GROUP BY 1, 2)
        SELECT symbol, 'linear' AS model, feature, round(i, 6) AS importance, folds, CAST(row_number() OVER (PARTITION BY symbol ORDER BY i DESC, feature) AS INT) AS place FROM g""",
    ),
    "j25_explained": (
        explained,
        f"""WITH {PANEL}, {MODELS.replace(BARS, '').strip().lstrip(',')}, n AS (SELECT symbol, arg_max(ret, dt) AS r, arg_max(vol, dt) AS v FROM panel WHERE ret IS NOT NULL AND vol IS NOT NULL GROUP BY 1),
        l AS (SELECT symbol, unnest(['ret', 'vol']) AS feature, unnest([-r, 0.5 * v]) AS contribution FROM n), p AS (SELECT symbol, model, arg_max(y_pred, dt) AS y FROM models GROUP BY 1, 2)
        SELECT l.symbol, 'reversal' AS model, 'linear' AS method, CAST(row_number() OVER (PARTITION BY l.symbol ORDER BY abs(contribution) DESC, feature) AS INT) AS place, feature, round(contribution, 6) AS contribution, feature || ' moves the forecast ' || CASE WHEN contribution >= 0 THEN 'up' ELSE 'down' END AS reason
        FROM l JOIN p ON p.symbol = l.symbol AND p.model = 'reversal'
        UNION ALL SELECT symbol, model, 'rule_based', 1, 'Model_Summary', round(y, 6), model || ' expects the price to go ' || CASE WHEN y > 0 THEN 'up' WHEN y < 0 THEN 'down' ELSE 'level' END FROM p WHERE model = 'momentum'""",
    ),
    "b7_quality_flags": (flags, None),
    "e34_answers": (answer_table, None),
    "f8_both_missing": (
        lambda s, d: G.both_missing(table_bars(s, d).select("symbol"), universe(s, d)),
        f"WITH {BARS}, {UNIVERSE}, a AS (SELECT DISTINCT upper(symbol) AS symbol FROM bars), b AS (SELECT DISTINCT upper(symbol) AS symbol FROM uni) SELECT symbol, 'universe' AS missing FROM a WHERE symbol NOT IN (SELECT symbol FROM b) UNION ALL SELECT symbol, 'data' FROM b WHERE symbol NOT IN (SELECT symbol FROM a)",
    ),
    "f9_report_pairs": (
        pairs,
        f"""{RUNS} SELECT symbol, run_id, model, round(wf, 6) AS wf_net, round(CASE WHEN NOT (model = 'momentum' AND run_id = '1996') THEN fn END, 6) AS final_net, CASE WHEN NOT (model = 'momentum' AND run_id = '1996') THEN tc END AS final_trades,
        concat_ws('|', CASE WHEN run_id = '1997' THEN 'run_manifest.json' END, CASE WHEN model = 'momentum' AND run_id = '1996' THEN 'final_holdout_model_row' END) AS missing FROM rb""",
    ),
    "h29_matrix_status": (
        matrix,
        f"""{RUNS} SELECT symbol, model, run_id AS policy, CASE WHEN reliability = 'unstable' THEN 'unstable' END AS error, CASE WHEN reliability = 'unstable' THEN 'error' WHEN reliability = 'research_candidate' OR run_id = '1999' THEN 'ok' ELSE 'planned' END AS status FROM rb""",
    ),
    "e32_backfilled": (
        backfilled,
        f"""{RUNS}, lg AS (SELECT symbol, model, CAST(year(entry_date) AS VARCHAR) AS run_id, count(*)::DOUBLE AS n FROM (SELECT symbol, model, tid, min(dt) AS entry_date FROM (SELECT *, sum(entry) OVER (PARTITION BY symbol, model ORDER BY dt ROWS UNBOUNDED PRECEDING) AS tid FROM eq) WHERE (pos = 1 OR xit = 1) AND tid > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)
        SELECT symbol, run_id, model, round(CASE WHEN model = 'reversal' THEN fn ELSE -1.0 END, 6) AS net_return, coalesce(CASE WHEN model = 'reversal' THEN tc END, n, 0.0) AS trade_count FROM rb LEFT JOIN lg USING (symbol, run_id, model)""",
    ),
    "e28_table_counts": (
        lambda s, d: J.table_counts(s, {n: table(s, d, n) for n in TABLES[:3]}, TABLES),
        " UNION ALL ".join([f"SELECT '{n}' AS \"table\", count(*) AS rows, false AS missing FROM {n}" for n in TABLES[:3]] + ["SELECT 'absent', NULL, true"]),
    ),
}
