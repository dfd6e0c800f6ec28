"""Queries over runs, forecasts of members, and rules that other plans do not show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import ensembles as E
from tidemark.operators import features as X
from tidemark.operators import forecasts as K
from tidemark.operators import leaderboard as Z
from tidemark.operators import macro as A
from tidemark.operators import quality as Q
from tidemark.operators import runs as R
from tidemark.operators import selection as L
from tidemark.operators import splits as S
from tidemark.plans.backtests import BUY, MODELS, SELL, WEIGHTS, curve, fold_rows
from tidemark.plans.backtests import FORECAST, POSITIONS
from tidemark.plans.common import BARS, PANEL, SECTORS, model_rows, panel, rounded, sectors
from tidemark.plans.selections import COLUMNS, SPLIT, contributions_rows, experiments, scored, scored_sql, signals
from tidemark.plans.series import gated, over
from tidemark.plans.serving import POINTS, RESOLVED, points, resolved
from tidemark.session import table
from tidemark.sources.bars import calendar, latest_rows, table_bars

P = "PARTITION BY symbol ORDER BY dt"
SM = "PARTITION BY symbol, model ORDER BY dt"


def adjusted(s, d):
    """Bars with an adjusted close: the volume-weighted unit price after discount of the day."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
    items = table(s, d, "lineitem").join(table(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    adj = items.groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("Date")).agg(F.avg(price).alias("Adj_Close"))
    return table_bars(s, d).join(adj, ["symbol", "Date"])


ADJUSTED = f"""{BARS}, adj AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS dt, avg(l_extendedprice * (1 - l_discount) / l_quantity) AS a FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
ab AS (SELECT bars.*, a FROM bars JOIN adj USING (symbol, dt))"""


def order_days(s, d, name="value"):
    """A daily series: mean order price of the day."""
    return table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("Date")).agg(F.avg("o_totalprice").alias(name))


def months(s, d):
    month = F.date_trunc("month", "o_orderdate").cast("date")
    return table(s, d, "orders").groupBy(month.alias("Date")).agg((F.avg("o_totalprice") / 1e5).alias("rate"))


MONTHS = "m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS dt, avg(o_totalprice) / 1e5 AS rate FROM orders GROUP BY 1)"


def universe(s, d):
    """Brands and their most frequent type as a universe (some without a sector, one a listing short), and nations, which have no bars."""
    brands = sectors(s, d).where("substr(symbol, -1, 1) in ('1', '3', '5')").select(
        "symbol", F.when(F.substring("symbol", -1, 1) != "5", F.col("sector")).alias("sector"), F.concat(F.lit(" "), F.lower("sector"), F.lit(".is")).alias("sector_index")
    )
    return brands.union(table(s, d, "nation").select(F.concat(F.lit("N_"), "n_name"), F.lit(None).cast("string"), F.lit(None).cast("string")))


UNIVERSE = f"""{SECTORS}, uni AS (SELECT symbol, CASE WHEN right(symbol, 1) <> '5' THEN sector END AS sector, ' ' || lower(sector) || '.is' AS sector_index FROM sectors WHERE right(symbol, 1) IN ('1', '3', '5')
UNION ALL SELECT 'N_' || n_name, NULL, NULL FROM nation)"""


def members(s, d):
    """Steps of each model: its newest prediction, shrinking with the horizon; momentum gives four, reversal five."""
    last = model_rows(s, d).groupBy("symbol", "model").agg(F.max_by("y_pred", "Date").alias("p"), F.max_by("Close", "Date").alias("last_close"))
    steps = F.when(F.col("model") == "momentum", 4).otherwise(5)
    out = last.select("symbol", "model", "last_close", F.explode(F.sequence(F.lit(1), steps)).alias("horizon"), "p").withColumn("predicted_return", F.col("p") / F.col("horizon"))
    return out.withColumn("bounded_close", F.col("last_close") * (1 + F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.col("predicted_return")))))


RUN_DATES = ("1999-03-01", "1999-06-01", "1999-09-01")


def dated_points(s, d):
    """Points of three runs of each symbol, a quarter apart, each from the last bar before its date."""
    out = None
    bars = table_bars(s, d)
    days = bars.select("Date").distinct()
    for k, day in enumerate(RUN_DATES, 1):
        last = latest_rows(bars.where(F.col("Date") < day))
        part = K.forecast_points(last, K.next_days(last, days, 5), 0.01).withColumns({"run": F.lit(k), "run_at": F.lit(day).cast("date")})
        out = part if out is None else out.unionByName(part)
    return out


def dated_runs(s, d):
    """The resolved points of each run, resolved on their own day."""
    parts = [K.resolve(dated_points(s, d).where(F.col("run") == k), table_bars(s, d)) for k in range(1, len(RUN_DATES) + 1)]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("resolved_at", F.col("target_date"))


DATED = f"""{BARS}, cut AS (SELECT * FROM (VALUES {", ".join(f"({k}, DATE '{day}')" for k, day in enumerate(RUN_DATES, 1))}) AS t(run, run_at)), days AS (SELECT dt, row_number() OVER (ORDER BY dt) AS place FROM (SELECT DISTINCT dt FROM bars)),
lastb AS (SELECT symbol, run, run_at, max(dt) AS last_date, arg_max(c, dt) AS last_close FROM bars JOIN cut ON dt < run_at GROUP BY 1, 2, 3),
pts AS (SELECT symbol, run, run_at, last_close, CAST(d2.place - d1.place AS INT) AS horizon, d2.dt AS target_date, last_close * power(1.01, d2.place - d1.place) AS pred FROM lastb JOIN days d1 ON d1.dt = last_date JOIN days d2 ON d2.place > d1.place AND d2.place <= d1.place + 5),
j AS (SELECT pts.*, bars.c AS actual FROM pts LEFT JOIN bars ON bars.symbol = pts.symbol AND bars.dt = target_date),
r AS (SELECT *, min(CASE WHEN actual IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, run ORDER BY horizon ROWS UNBOUNDED PRECEDING) AS ok, coalesce(lag(actual) OVER (PARTITION BY symbol, run ORDER BY horizon), last_close) AS before FROM j),
res AS (SELECT *, abs(pred - actual) AS abs_error, sign(actual - before) = 1 AS up FROM r WHERE ok = 1)"""


def scaled_rows(s, d):
    rows = panel(s, d).withColumn("role", F.when(F.col("Date") < SPLIT, "train").otherwise("test"))
    return L.scale(rows, COLUMNS, "robust")


def run_table(s, d):
    """Years as runs: the first eight months as walk-forward, the last four as final holdout; history up to the year's last bar."""
    first, year = F.month("Date") <= 8, F.year("Date")
    def sum_of(c, early):
        return F.sum(F.when(first if early else ~first, F.col(c)))
    c = curve(s, d)
    late = F.when(~first, F.col("net_return"))
    out = c.groupBy("symbol", "model", year.cast("string").alias("run_id")).agg(
        sum_of("net_return", True).alias("wf_net"), sum_of("net_return", False).alias("final_net"), sum_of("realized_return", False).alias("final_buyhold"), sum_of("entry", False).alias("final_trades"),
        (F.avg(late) / F.nullif(F.stddev_pop(late), F.lit(0.0)) * 252**0.5).alias("final_sharpe"), F.max("Date").alias("last"),
    )
    begun = table_bars(s, d).groupBy("symbol").agg(F.min("Date").alias("begin"))
    out = out.join(begun, "symbol").join(sectors(s, d), "symbol").withColumn("missing", F.when(F.col("final_net").isNull(), "final_holdout_model_row"))
    return Z.run_rows(out.withColumn("history_bucket", Z.history_bucket(F.datediff("last", "begin") / 365.25, long_years=4.0, short_years=2.0)))


RUNS = f"""WITH {POSITIONS}, {SECTORS}, w AS (SELECT symbol, model, CAST(year(dt) AS VARCHAR) AS run_id, sum(CASE WHEN month(dt) <= 8 THEN net END) AS wf, sum(CASE WHEN month(dt) > 8 THEN net END) AS fn, sum(CASE WHEN month(dt) > 8 THEN rr END) AS bh,
  sum(CASE WHEN month(dt) > 8 THEN entry END)::DOUBLE AS tc, avg(CASE WHEN month(dt) > 8 THEN net END) / nullif(stddev_pop(CASE WHEN month(dt) > 8 THEN net END), 0) AS sh, max(dt) AS last FROM eq GROUP BY 1, 2, 3),
h AS (SELECT symbol, min(dt) AS begin FROM bars GROUP BY 1),
x AS (SELECT w.*, sector, wf - fn AS gap, fn - bh AS excess, date_diff('day', begin, last) / 365.25 AS y FROM w JOIN h USING (symbol) JOIN sectors USING (symbol)),
rb AS (SELECT *, CASE WHEN y >= 4 THEN 'long_history' WHEN y >= 2 THEN 'mid_history' ELSE 'short_history' END AS history_bucket, CASE WHEN fn IS NULL THEN 'incomplete' WHEN (tc <= 1 AND abs(excess) <= 0.001) OR tc < 2 THEN 'invalid'
  WHEN tc BETWEEN 8 AND 20 AND excess > 0 AND wf > 0 THEN 'stable' WHEN wf > 0 AND (fn <= 0 OR gap >= 0.25) THEN 'unstable' WHEN tc BETWEEN 8 AND 20 AND fn >= 0 AND sh > 0 AND excess <= 0 THEN 'defensive' ELSE 'research_candidate' END AS reliability FROM x)"""
CLASS_COUNTS = ", ".join(f"count(*) FILTER (reliability = '{c}') AS {c}_count" for c in Z.CLASSES)


TICK = "CASE WHEN {0} < 20 THEN 0.01 WHEN {0} < 50 THEN 0.02 WHEN {0} < 100 THEN 0.05 WHEN {0} < 250 THEN 0.1 WHEN {0} < 500 THEN 0.25 WHEN {0} < 1000 THEN 0.5 WHEN {0} < 2500 THEN 1.0 ELSE 2.5 END"

def on_tick(x: str, how: str) -> str:
    """A price on its tick in SQL, in whole millionths."""
    p, t = f"CAST(round({x} * 1000000) AS BIGINT)", f"CAST(round(1000000 * {TICK.format(x)}) AS BIGINT)"
    steps = {"nearest": f"(2 * {p} + {t}) // (2 * {t})", "floor": f"{p} // {t}", "ceil": f"({p} + {t} - 1) // {t}"}[how]
    return f"({steps} * {t} / 1000000.0)::DOUBLE"


PLANS = {
    "b1_traded": (
        lambda s, d: rounded(Q.with_gaps(table_bars(s, d)).select("symbol", "Date", "gap")),
        f'WITH {BARS} SELECT symbol, dt AS "Date", CAST(date_diff(\'day\', lag(dt) OVER ({P}), dt) AS INT) AS gap FROM bars',
    ),
    "b4_choose_close": (
        lambda s, d: rounded(Q.choose_close(adjusted(s, d), 0.105).select("symbol", "Date", "Close", "distrusted", "trust_score")),
        f"""WITH {ADJUSTED}, t AS (SELECT symbol, coalesce(bool_or(a <= 0), false) OR coalesce(max(abs(a / nullif(c, 0) - 1)), 0) > 0.105 AS bad, 1 - least(coalesce(avg(abs(a / nullif(c, 0) - 1)), 0), 0.105) / 0.105 AS trust FROM ab GROUP BY symbol)
        SELECT symbol, dt AS "Date", round(CASE WHEN bad THEN c ELSE coalesce(a, c) END, 6) AS "Close", bad AS distrusted, round(trust, 6) AS trust_score FROM ab JOIN t USING (symbol)""",
    ),
    "b6_recent_anomaly": (
        lambda s, d: Q.recent_anomaly(table_bars(s, d).select("symbol").distinct(), Q.corporate_actions(table_bars(s, d)), F.lit("2001-12-31").cast("date"), 120),
        f"""WITH {BARS} SELECT symbol, bool_or(abs(logret) >= 0.3 AND dt >= DATE '2001-12-31' - 120) IS TRUE AS anomaly FROM rets GROUP BY symbol""",
    ),
    "b13_universe_check": (
        lambda s, d: rounded(Z.universe_check(table_bars(s, d), universe(s, d), 6.8, 5)),
        f"""WITH {BARS}, {UNIVERSE}, sp AS (SELECT upper(symbol) AS symbol, min(dt) AS f, max(dt) AS l FROM bars GROUP BY 1), h AS (SELECT upper(uni.symbol) AS symbol, coalesce(sector, nullif(trim(sector_index), '')) AS sector, f, l, round(date_diff('day', f, l) / 365.25, 4) AS y FROM uni LEFT JOIN sp ON upper(uni.symbol) = sp.symbol),
        b AS (SELECT *, CASE WHEN y IS NULL THEN 'missing_data' WHEN y >= 6.8 THEN 'long_history' WHEN y >= 5 THEN 'mid_history' ELSE 'short_history' END AS history_bucket FROM h)
        SELECT symbol, sector, f AS first_date, l AS last_date, y AS history_years, f IS NOT NULL AS present, history_bucket, coalesce(y >= 6.8, false) AS long_enough,
        CASE history_bucket {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Z.HISTORY_WARNINGS.items())} END AS data_history_warning FROM b""",
    ),
    "b16_target_session": (
        lambda s, d: R.target_session(table(s, d, "events").select("event_id", "ts"), calendar(s, "2023-12-01", "2024-03-01")).select("event_id", "Date"),
        """WITH t AS (SELECT event_id, CASE WHEN hour(ts) >= 19 THEN CAST(ts AS DATE) ELSE CAST(ts AS DATE) - 1 END AS d FROM events) SELECT event_id, d AS "Date" FROM t WHERE isodow(d) < 6""",
    ),
    "b19_staleness": (
        lambda s, d: A.staleness(table_bars(s, d).select(F.col("symbol").alias("series"), "Date"), F.lit("2001-12-01").cast("date"), 32),
        f"WITH {BARS} SELECT symbol AS series, max(dt) AS last_date, date_diff('day', max(dt), DATE '2001-12-01') > 32 AS stale FROM bars GROUP BY symbol",
    ),
    "c19_monthly_rate": (
        lambda s, d: rounded(A.monthly_rate(months(s, d), "rate")),
        f'WITH {MONTHS} SELECT dt AS "Date", round(rate, 6) AS rate, round(rate, 6) AS rate_level, round(rate - lag(rate) OVER (ORDER BY dt), 6) AS rate_change FROM m',
    ),
    "c20_daily_changes": (
        lambda s, d: rounded(A.daily_changes(order_days(s, d).withColumn("symbol", F.lit("orders")), ["value"]).select("Date", "value_ret", "value_vol7", "value_rel7")),
        """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS v FROM orders GROUP BY 1), r AS (SELECT *, v / lag(v) OVER (ORDER BY dt) - 1 AS r FROM o)
        SELECT dt AS "Date", round(r, 6) AS value_ret, round(CASE WHEN count(r) OVER w >= 7 THEN stddev_samp(r) OVER w END, 6) AS value_vol7, round(v / CASE WHEN count(v) OVER w >= 7 THEN avg(v) OVER w END - 1, 6) AS value_rel7
        FROM r WINDOW w AS (ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    ),
    "c21_real_rate": (
        lambda s, d: rounded(A.monthly_index(months(s, d).withColumn("cpi", F.col("rate")), "cpi").select("Date", (F.col("rate") - F.col("cpi_yoy")).alias("real_rate"))),
        f'WITH {MONTHS} SELECT dt AS "Date", round(rate - (rate / lag(rate, 12) OVER (ORDER BY dt) - 1), 6) AS real_rate FROM m',
    ),
    "c23_price_targets": (
        lambda s, d: rounded(X.targets(table_bars(s, d), "return", (1, 5)).select("symbol", "Date", "target_1", "target_5")),
        f'WITH {BARS} SELECT symbol, dt AS "Date", round(lead(c, 1) OVER w / c - 1, 6) AS target_1, round(lead(c, 5) OVER w / c - 1, 6) AS target_5 FROM bars WINDOW w AS ({P})',
    ),
    "c27_sector_mapping": (
        lambda s, d: Z.sector_mapping(sectors(s, d).select(F.concat(F.lit(" "), F.lower("symbol"), F.lit(".is")).alias("symbol")), universe(s, d), ["SMALL", "LARGE"], "MARKET"),
        f"""WITH {UNIVERSE}, n AS (SELECT upper(symbol) AS symbol, sector, regexp_replace(upper(trim(sector_index)), '\\.IS$', '') AS i FROM uni), a AS (SELECT upper(sectors.symbol) AS symbol, n.sector, i, n.symbol IS NOT NULL AS found FROM sectors LEFT JOIN n ON n.symbol = upper(sectors.symbol)),
        b AS (SELECT *, coalesce(i IN ('SMALL', 'LARGE'), false) AS ok FROM a)
        SELECT symbol, sector, CASE WHEN ok THEN i ELSE 'MARKET' END AS sector_index, CASE WHEN ok THEN 'matched' ELSE 'fallback' END AS status,
        CASE WHEN ok THEN '{Z.MATCHED}' WHEN found THEN '{Z.UNSUPPORTED}' ELSE '{Z.NOT_FOUND}' END AS reason, CASE WHEN ok THEN i ELSE 'MARKET' END || '_Return' AS return_column FROM b""",
    ),
    "c31_clip_warning": (
        lambda s, d: rounded(R.clip_report(scaled_rows(s, d), COLUMNS).withColumns({c: F.col(c).cast("string") for c in ("scaler_fit_start", "scaler_fit_end", "test_start", "test_end")})),
        f"""WITH {PANEL}, t AS (SELECT *, CASE WHEN dt < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS role FROM panel), q AS (SELECT """
        + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_i" for c in COLUMNS)
        + " FROM t WHERE role = 'train'), z AS ("
        + " UNION ALL ".join(f"SELECT role, ({c} - {c}_m) / CASE WHEN {c}_i > 0 THEN {c}_i ELSE 1 END AS z FROM t, q WHERE {c} IS NOT NULL" for c in COLUMNS)
        + """), r AS (SELECT 100 * avg(CASE WHEN role = 'train' THEN CASE WHEN abs(z) >= 5 THEN 1.0 ELSE 0 END END) AS a, 100 * avg(CASE WHEN role = 'test' THEN CASE WHEN abs(z) >= 5 THEN 1.0 ELSE 0 END END) AS b FROM z),
        e AS (SELECT min(dt) FILTER (role = 'train') AS f0, max(dt) FILTER (role = 'train') AS f1, min(dt) FILTER (role = 'test') AS t0, max(dt) FILTER (role = 'test') AS t1 FROM t)
        SELECT round(a, 6) AS train_clip_rate_pct, round(b, 6) AS test_clip_rate_pct, f0::VARCHAR AS scaler_fit_start, f1::VARCHAR AS scaler_fit_end, t0::VARCHAR AS test_start, t1::VARCHAR AS test_end, -5.0::DOUBLE AS clip_low, 5.0::DOUBLE AS clip_high,
        CASE WHEN b >= 1 AND b > a THEN printf('distribution_shift_warning: test clip rate is high relative to train (%.3f%% vs %.3f%%).', b, a) ELSE '' END AS warning FROM r, e""",
    ),
    "c33_lookback_index": (
        lambda s, d: R.lookback_index(table_bars(s, d), 10),
        f"""WITH {BARS}, t AS (SELECT symbol, dt, count(*) {over(10)} AS k, min(dt) {over(10)} AS f FROM bars) SELECT symbol, dt AS "Date", f AS first_date FROM t WHERE k = 10""",
    ),
    "c34_reconstruct": (
        lambda s, d: rounded(X.reconstruct(model_rows(s, d).withColumn("prev_close", F.col("Close")), "log_return").select("symbol", "model", "Date", "pred_price")),
        f"""WITH {MODELS} SELECT symbol, model, dt AS "Date", round(c * exp(greatest(-1.0, least(1.0, y_pred))), 6) AS pred_price FROM models""",
    ),
    "c35_supervised": (
        lambda s, d: rounded(R.supervised(S.single_split(table_bars(s, d)), 3).select("symbol", "role", "Date", F.col("realized_date").cast("string").alias("realized"), "prev_close", "y")),
        f"""WITH {BARS}, n AS (SELECT *, row_number() OVER ({P}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars), r AS (SELECT *, CASE WHEN rn <= floor(n * (1 - 0.2)) THEN 'train' ELSE 'test' END AS role FROM n),
        y AS (SELECT symbol, role, dt, c, lead(dt, 3) OVER w AS rd, lead(c, 3) OVER w AS y FROM r WINDOW w AS (PARTITION BY symbol, role ORDER BY dt))
        SELECT symbol, role, dt AS "Date", CAST(rd AS VARCHAR) AS realized, round(c, 6) AS prev_close, round(y, 6) AS y FROM y WHERE rd IS NOT NULL""",
    ),
    "e20_run_rows": (
        lambda s, d: rounded(run_table(s, d).select("symbol", "model", "run_id", "gap", "excess", "enough_trades", "benchmark_clone", "complete", "reliability", "history_bucket", "prediction_rank", "trading_rank")),
        f"""{RUNS}, k AS (SELECT symbol, model, run_id, rank() OVER (ORDER BY wf DESC NULLS LAST) AS p, rank() OVER (ORDER BY coalesce(excess, -1e9) * 1000 + fn DESC) AS t FROM rb WHERE fn IS NOT NULL)
        SELECT symbol, model, run_id, round(gap, 6) AS gap, round(excess, 6) AS excess, coalesce(tc BETWEEN 8 AND 20, false) AS enough_trades, coalesce(tc <= 1 AND abs(excess) <= 0.001, false) AS benchmark_clone, fn IS NOT NULL AS complete, reliability, history_bucket,
        CAST(p AS INT) AS prediction_rank, CAST(t AS INT) AS trading_rank FROM rb LEFT JOIN k USING (symbol, model, run_id)""",
    ),
    "e21_class_summary": (
        lambda s, d: rounded(Z.class_summary(run_table(s, d), "sector")),
        f"""{RUNS}, f AS (SELECT sector, string_agg(model || ':' || n, '|' ORDER BY model) AS families FROM (SELECT sector, model, count(*) AS n FROM rb GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
        hb AS (SELECT sector, string_agg(history_bucket || ':' || n, '|' ORDER BY history_bucket) AS buckets FROM (SELECT sector, history_bucket, count(*) AS n FROM rb GROUP BY 1, 2) GROUP BY 1),
        t AS (SELECT sector, arg_min(model, (-n, model)) AS top FROM (SELECT sector, model, count(*) AS n FROM rb GROUP BY 1, 2) GROUP BY 1),
        g AS (SELECT sector, count(DISTINCT symbol) AS symbols, count(*) AS run_rows, {CLASS_COUNTS}, round(avg(CASE WHEN reliability IN ('incomplete', 'invalid') THEN 1.0 ELSE 0 END), 6) AS incomplete_invalid_rate, round(avg(gap), 6) AS mean_gap FROM rb GROUP BY 1)
        SELECT g.*, families AS repeated_families, top AS top_family, buckets AS history_buckets FROM g JOIN f USING (sector) JOIN hb USING (sector) JOIN t USING (sector)""",
    ),
    "e22_history_summary": (
        lambda s, d: rounded(Z.class_summary(run_table(s, d), "history_bucket")),
        f"""{RUNS}, f AS (SELECT history_bucket, string_agg(model || ':' || n, '|' ORDER BY model) AS families, arg_min(model, (-n, model)) AS top FROM (SELECT history_bucket, model, count(*) AS n FROM rb GROUP BY 1, 2) GROUP BY 1),
        g AS (SELECT history_bucket, count(DISTINCT symbol) AS symbols, count(*) AS run_rows, {CLASS_COUNTS}, round(avg(CASE WHEN reliability IN ('incomplete', 'invalid') THEN 1.0 ELSE 0 END), 6) AS incomplete_invalid_rate, round(avg(gap), 6) AS mean_gap FROM rb GROUP BY 1)
        SELECT g.*, families, top AS top_family FROM g JOIN f USING (history_bucket)""",
    ),
    "e23_decision_report": (lambda s, d: s.createDataFrame([(Z.decision_report(run_table(s, d)),)], "report string"), None),
    "e25_newest_runs": (
        lambda s, d: rounded(Z.newest_runs(experiments(s, d).withColumns({"run_id": F.col("fold"), "stability": F.col("dir_acc") / 50 - 1}), 3)),
        f"""{scored_sql('fold')}, lt AS (SELECT symbol, fold, max(trained_at) AS t FROM c GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC, fold DESC) AS k FROM lt),
        g AS (SELECT symbol, model, count(*) AS run_count, avg(composite) AS a, avg(dir_acc) AS b, avg(sharpe) AS e, avg(dir_acc / 50 - 1) AS f, min(dir_acc / 50 - 1) AS h, count(*) FILTER (dir_acc / 50 - 1 >= 0) AS steady_runs FROM c JOIN k USING (symbol, fold) WHERE k <= 3 GROUP BY 1, 2)
        SELECT symbol, model, run_count, round(a, 6) AS mean_composite, round(b, 6) AS mean_dir_acc, round(e, 6) AS mean_sharpe, round(f, 6) AS mean_stability, round(h, 6) AS min_stability, steady_runs, CAST(row_number() OVER (PARTITION BY symbol ORDER BY a DESC NULLS LAST, model) AS INT) AS place FROM g""",
    ),
    "e33_confidence": (
        lambda s, d: Z.confidence(scored(s, d, "fold").withColumns({
            "eligibility": F.when(F.col("fold") == 1996, "low_trades"), "stale": F.lit(None).cast("boolean"), "psi_high": F.col("neutral_rate") > 40, "corporate_action": F.lit(False), "degraded": F.col("sharpe") < 0,
            "diagnosis": F.when(F.col("hit_rate") < 60, "ok, gate_too_strict"), "stability": F.col("dir_acc") / 50 - 1, "rolling_ratio": F.col("hit_rate") / 100, "agreement": F.lit(None).cast("double"), "regime_misaligned": F.col("fold") == 1997,
        })).select("symbol", "model", "fold", "confidence", "block", F.concat_ws("|", "soft_reasons").alias("reasons")),
        f"""{scored_sql('fold')}, hb AS (SELECT *, CASE WHEN fold = 1996 THEN 'eligibility' WHEN dir_acc < 50 THEN 'dir_acc' WHEN rr >= 1 THEN 'rmse_ratio' WHEN neutral_rate > 40 THEN 'psi' WHEN sharpe < 0 THEN 'degraded' END AS block,
          concat_ws('|', CASE WHEN hit_rate < 60 THEN 'diagnosis: gate_too_strict' END, CASE WHEN dir_acc / 50 - 1 < -0.1 THEN 'stability' END, CASE WHEN hit_rate / 100 < 0.5 THEN 'rolling_ratio' END, CASE WHEN fold = 1997 THEN 'regime' END) AS reasons FROM c)
        SELECT symbol, model, fold, CASE WHEN block IS NOT NULL THEN 'low' WHEN reasons = '' AND dir_acc >= 55 AND dir_acc / 50 - 1 >= 0.5 AND coalesce(rr < 1, true) THEN 'high' ELSE 'medium' END AS confidence, block, CASE WHEN block IS NULL THEN reasons ELSE '' END AS reasons FROM hb""",
    ),
    "e27_experiments": (
        lambda s, d: rounded(experiments(s, d).where("model = 'reversal'").orderBy(F.desc("trained_at"), "symbol").limit(50).select("symbol", "model", "fold", "composite")),
        f"{scored_sql('fold')} SELECT symbol, model, fold, composite FROM c WHERE model = 'reversal' ORDER BY trained_at DESC, symbol LIMIT 50",
    ),
    "e36_risk_free": (
        lambda s, d: rounded(R.risk_free(months(s, d))),
        f"WITH {MONTHS}, r AS (SELECT arg_max(rate, dt) AS r FROM m WHERE rate IS NOT NULL), f AS (SELECT CASE WHEN r > 1 THEN r / 100 ELSE r END AS r FROM r) SELECT round(CASE WHEN r > 0 AND r < 5 THEN r END, 6) AS risk_free_rate FROM f",
    ),
    "f3_add_series": (
        lambda s, d: rounded(A.add_series(table_bars(s, d).select("Date").distinct(), [order_days(s, d, "orders"), months(s, d)])),
        f"""WITH {BARS}, {MONTHS}, o AS (SELECT CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS v FROM orders GROUP BY 1), d AS (SELECT DISTINCT dt FROM bars), j AS (SELECT d.dt, v, rate FROM d LEFT JOIN o USING (dt) LEFT JOIN m USING (dt))
        SELECT dt AS "Date", round(last_value(v IGNORE NULLS) OVER w, 6) AS orders, round(last_value(rate IGNORE NULLS) OVER w, 6) AS rate FROM j WINDOW w AS (ORDER BY dt ROWS UNBOUNDED PRECEDING)""",
    ),
    "g3_final_holdout": (
        lambda s, d: S.final_holdout(table_bars(s, d), 100, 200).groupBy("symbol", "role").agg(F.count(F.lit(1)).alias("n"), F.min("Date").alias("first_date")),
        f"""WITH {BARS}, n AS (SELECT *, row_number() OVER ({P}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, CASE WHEN n - rn < 100 AND n - 100 >= 200 THEN 'holdout' ELSE 'selection' END AS role, count(*) AS n, min(dt) AS first_date FROM n GROUP BY 1, 2""",
    ),
    "g12_split_sets": (
        lambda s, d: Z.signal_sets(fold_rows(s, d)),
        f"""WITH {MODELS}, f AS (SELECT DISTINCT CAST(year(dt) AS INT) AS fold FROM models), k AS (SELECT fold, row_number() OVER (ORDER BY fold) AS k, count(*) OVER () AS n FROM f)
        SELECT fold, CASE WHEN n > 3 AND k <= greatest(1, least(floor(n * 0.7), n - 3)) THEN 'calibration' ELSE 'evaluation' END AS "set", CASE WHEN n <= 3 THEN 'skipped_insufficient_folds' ELSE 'applied' END AS status, n AS fold_count FROM k""",
    ),
    "g13_stability_objective": (
        lambda s, d: rounded(R.stability_objective(fold_rows(s, d))),
        f"WITH {MODELS}, m AS (SELECT symbol, model, CAST(year(dt) AS INT) AS fold, {FORECAST} FROM models GROUP BY 1, 2, 3) SELECT symbol, model, round(-(avg(sharpe) - 0.5 * stddev_pop(sharpe)), 6) AS objective FROM m GROUP BY 1, 2",
    ),
    "g15_horizons": (
        lambda s, d: rounded(R.horizon_metrics(X.targets(model_rows(s, d), "return", (1, 3, 5), ("symbol", "model")), (1, 3, 5))),
        f"""WITH {MODELS}, t AS (SELECT symbol, model, y_pred, unnest([1, 3, 5]) AS horizon, unnest([lead(c, 1) OVER w / c - 1, lead(c, 3) OVER w / c - 1, lead(c, 5) OVER w / c - 1]) AS y FROM models WINDOW w AS ({SM}))
        SELECT symbol, model, horizon, count(*) AS n, round(sqrt(avg((y_pred - y) ** 2)), 6) AS rmse, round(avg(abs(y_pred - y)), 6) AS mae, round(100 * avg(CASE WHEN sign(y_pred) = sign(y) THEN 1.0 ELSE 0 END), 6) AS dir_acc FROM t WHERE y IS NOT NULL GROUP BY 1, 2, 3""",
    ),
    "h2_expected_return": (
        lambda s, d: rounded(model_rows(s, d).select("symbol", "model", "Date", B.expected_return("log_return", F.col("y_pred"), F.col("Close")).alias("from_log"), B.expected_return("price", F.col("y_pred") * F.col("Close"), F.col("Close")).alias("from_price"))),
        f'WITH {MODELS} SELECT symbol, model, dt AS "Date", round(exp(y_pred) - 1, 6) AS from_log, round(y_pred * c / c - 1, 6) AS from_price FROM models',
    ),
    "h3_long_flat": (
        lambda s, d: B.long_flat(model_rows(s, d)).groupBy("symbol", "model").agg(F.sum("position").alias("held"), F.count(F.lit(1)).alias("n")),
        f"WITH {MODELS} SELECT symbol, model, count(CASE WHEN y_pred > 0 THEN 1 END) AS held, count(*) AS n FROM models GROUP BY 1, 2",
    ),
    "h7_regime_multiplier": (
        lambda s, d: X.market_regime(table_bars(s, d)).select("symbol", "Date", B.regime_multiplier(F.col("Market_Regime_SMA200")).alias("multiplier")),
        f"""WITH {BARS}, t AS (SELECT symbol, dt, c, {gated('avg(c)', 'c', 200)} AS m FROM bars) SELECT symbol, dt AS "Date", CASE WHEN c > m THEN 0.85 WHEN c < m THEN 1.25 ELSE 1.0 END::DOUBLE AS multiplier FROM t""",
    ),
    "h9_recommendation": (
        lambda s, d: B.hysteresis(model_rows(s, d), BUY, SELL).select("symbol", "model", "Date", B.recommendation(F.col("decision"), F.col("y_pred"), F.lit(0.1)).alias("recommendation")),
        f"""WITH {POSITIONS} SELECT symbol, model, dt AS "Date", CASE WHEN prev = 0 AND pos = 1 THEN 'BUY' WHEN prev = 1 AND pos = 0 THEN 'SELL' WHEN pos = 0 AND y_pred < -0.1 THEN 'SELL' ELSE 'HOLD' END AS recommendation FROM e2""",
    ),
    "h10_quality_block": (
        lambda s, d: B.quality_block(scored(s, d).withColumn("is_benchmark", F.col("model") == "momentum")).select("symbol", "model", "block_reason"),
        f"""{scored_sql()} SELECT symbol, model, CASE WHEN model = 'momentum' THEN 'benchmark_only' WHEN dir_acc < 52 THEN 'quality_dir_acc' WHEN rr > 1.05 THEN 'quality_rmse' WHEN composite < 50 THEN 'quality_composite' END AS block_reason FROM c""",
    ),
    "h11_soft_gate": (
        lambda s, d: B.soft_gate(scored(s, d, "fold")).select("symbol", "model", "fold", "threshold_multiplier", F.concat_ws("|", "gate_reasons").alias("reasons")),
        f"""{scored_sql('fold')} SELECT symbol, model, fold, greatest(CASE WHEN dir_acc < 48 THEN 1.75 WHEN dir_acc < 52 THEN 1.25 ELSE 1 END, CASE WHEN rr >= 1.10 THEN 1.75 WHEN rr > 1.05 THEN 1.25 ELSE 1 END, CASE WHEN composite < 45 THEN 1.75 WHEN composite < 50 THEN 1.25 ELSE 1 END)::DOUBLE AS threshold_multiplier,
        concat_ws('|', CASE WHEN dir_acc < 52 THEN 'weak_dir_acc' END, CASE WHEN rr > 1.05 THEN 'weak_rmse_ratio' END, CASE WHEN composite < 50 THEN 'weak_composite' END) AS reasons FROM c""",
    ),
    "h20_signal_summary": (lambda s, d: rounded(R.signal_summary(signals(s, d))), None),
    "j8_combined": (
        lambda s, d: rounded(E.combine(model_rows(s, d), E.weights(model_rows(s, d), "inverse_rmse"))),
        f"""{WEIGHTS}, w AS (SELECT model, (1 / rmse) / sum(1 / rmse) OVER () AS w FROM m) SELECT symbol, dt AS "Date", round(sum(w * y_pred) / sum(w), 6) AS y_pred FROM models JOIN w USING (model) GROUP BY 1, 2""",
    ),
    "j12_category_weights": (
        lambda s, d: rounded(E.category_weights(table(s, d, "part").select(F.col("p_brand").alias("model"), F.substring("p_brand", 1, 7).alias("category")).distinct())),
        """WITH m AS (SELECT DISTINCT p_brand AS model, substr(p_brand, 1, 7) AS category FROM part), n AS (SELECT count(DISTINCT category) AS n FROM m) SELECT model, round(1.0 / (n.n * count(*) OVER (PARTITION BY category)), 6) AS weight FROM m, n""",
    ),
    "j16_agreement": (
        lambda s, d: rounded(R.agreement(model_rows(s, d), "reversal")),
        f"""WITH {MODELS}, l AS (SELECT symbol, model, arg_max(y_pred, dt) AS p FROM models GROUP BY 1, 2), o AS (SELECT symbol, p AS own FROM l WHERE model = 'reversal') SELECT symbol, count(*) AS members, avg(CASE WHEN sign(p) = sign(own) THEN 1.0 ELSE 0 END) AS agreement FROM l JOIN o USING (symbol) WHERE model <> 'reversal' GROUP BY symbol""",
    ),
    "j21_feature_stability": (
        lambda s, d: rounded(R.feature_stability(contributions_rows(s, d).groupBy(F.year("Date").alias("fold"), "feature").agg(F.avg(F.abs("contribution")).alias("importance")), 2)),
        f"""WITH {PANEL}, p AS (SELECT * FROM panel WHERE vol IS NOT NULL AND ret IS NOT NULL), a AS (SELECT avg(liq_log) AS l0, avg(vol) AS v0, avg(ret) AS r0 FROM p),
        k AS (SELECT dt, 'liq_log' AS feature, (liq_log - l0) * 0.5 AS x FROM p, a UNION ALL SELECT dt, 'vol', (vol - v0) * -2 FROM p, a UNION ALL SELECT dt, 'ret', ret - r0 FROM p, a),
        f AS (SELECT year(dt) AS fold, feature, avg(abs(x)) AS i FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY abs(i) DESC, feature) AS pl FROM f)
        SELECT feature, round(count(CASE WHEN pl <= 2 THEN 1 END) / (SELECT count(DISTINCT fold) FROM f)::DOUBLE, 6) AS stability, round(avg(i), 6) AS mean_importance FROM r GROUP BY feature""",
    ),
    "k3_bounded": (
        lambda s, d: rounded(model_rows(s, d).select("symbol", "model", "Date", K.bounded(F.col("Close") * (1 + F.col("y_pred")), F.col("Close")).alias("pred_close"))),
        f"""WITH {MODELS}, a AS (SELECT symbol, model, dt, c * (1 + y_pred) AS p, {on_tick("c", "nearest")} AS base FROM models),
        b AS (SELECT *, base * 0.9::DOUBLE AS lo, base * 1.1::DOUBLE AS hi FROM a), m AS (SELECT *, {on_tick("lo", "ceil")} AS low, {on_tick("hi", "floor")} AS high FROM b),
        r AS (SELECT *, greatest(low, least(high, p)) AS q FROM m)
        SELECT symbol, model, dt AS "Date", round(greatest(low, least(high, {on_tick("q", "nearest")})), 6) AS pred_close FROM r""",
    ),
    "k4_trend_label": (
        lambda s, d: B.rolling_risk(model_rows(s, d)).select("symbol", "model", "Date", K.trend_label(F.col("y_pred"), F.col("rolling_vol"), F.lit(5), 0.003).alias("label")),
        f"""WITH {MODELS}, v AS (SELECT *, coalesce(nullif(stddev_samp(ret) OVER ({SM} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0), 1e-6) AS v FROM models), t AS (SELECT *, greatest(0.005, 0.003, 0.25 * v * sqrt(5)) AS h FROM v)
        SELECT symbol, model, dt AS "Date", CASE WHEN y_pred > h THEN 'UP' WHEN y_pred < -h THEN 'DOWN' ELSE 'FLAT' END AS label FROM t""",
    ),
    "k5_roll_forward": (
        lambda s, d: rounded(K.roll_forward(points(s, d).where("horizon = 1").select("symbol", "last_close", F.lit(0.04).alias("expected")), 5)),
        f"""{("WITH RECURSIVE " + POINTS)}, path(symbol, horizon, close) AS (
          SELECT symbol, 0, last_close FROM lastb
          UNION ALL SELECT symbol, horizon + 1, greatest(low, least(high, {on_tick('q', 'nearest')})) FROM (
            SELECT *, greatest(low, least(high, close * 1.04::DOUBLE)) AS q FROM (
              SELECT *, {on_tick('lo', 'ceil')} AS low, {on_tick('hi', 'floor')} AS high FROM (
                SELECT *, base * 0.9::DOUBLE AS lo, base * 1.1::DOUBLE AS hi FROM (SELECT *, {on_tick('close', 'nearest')} AS base FROM path WHERE horizon < 5)))))
        SELECT symbol, CAST(horizon AS INT) AS horizon, round(close, 6) AS pred_close FROM path WHERE horizon > 0""",
    ),
    "k7_carry_forward": (
        lambda s, d: rounded(K.carry_forward(table_bars(s, d).select(F.col("symbol").alias("series"), "Date", F.col("Close").alias("value")))),
        f"""WITH {BARS}, k AS (SELECT symbol, dt, c, c - lag(c) OVER ({P}) AS d, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k FROM bars) SELECT symbol AS series, round(arg_max(c, dt) + coalesce(avg(d), 0), 6) AS next_value FROM k WHERE k < 20 GROUP BY symbol""",
    ),
    "k8_combined_points": (
        lambda s, d: rounded(R.combine_members(members(s, d), E.weights(model_rows(s, d), "inverse_rmse"), gated=True)),
        f"""{WEIGHTS.replace('WITH', 'WITH RECURSIVE', 1)}, wt AS (SELECT model, (1 / rmse) / sum(1 / rmse) OVER () AS w FROM m), nw AS (SELECT symbol, model, arg_max(y_pred, dt) AS p, arg_max(c, dt) AS lc FROM models GROUP BY 1, 2),
        st AS (SELECT symbol, model, lc, h, p / h AS r, lc * (1 + greatest(-0.05, least(0.05, p / h))) AS bc FROM nw, range(1, 5) AS t(h)),
        ag AS (SELECT symbol, h, sum(w * bc) AS mean, greatest(count(*) FILTER (r > 0), count(*) FILTER (r < 0)) / 2.0 AS agreement, max(lc) AS lc FROM st JOIN wt USING (model) GROUP BY 1, 2),
        path(symbol, h, agreement, raw, close, before) AS (
          SELECT DISTINCT symbol, 0::BIGINT, NULL::DOUBLE, lc, lc, NULL::DOUBLE FROM ag
          UNION ALL SELECT symbol, h, agreement, raw, greatest(low, least(high, {on_tick('q', 'nearest')})), before FROM (
            SELECT *, greatest(low, least(high, raw)) AS q FROM (
              SELECT *, {on_tick('lo', 'ceil')} AS low, {on_tick('hi', 'floor')} AS high FROM (
                SELECT *, base * 0.9::DOUBLE AS lo, base * 1.1::DOUBLE AS hi FROM (
                  SELECT ag.symbol, ag.h, ag.agreement, CASE WHEN ag.agreement < 0.6 THEN path.close ELSE ag.mean END AS raw, path.close AS before, {on_tick('path.close', 'nearest')} AS base FROM path JOIN ag ON ag.symbol = path.symbol AND ag.h = path.h + 1)))))
        SELECT symbol, CAST(h AS INT) AS horizon, agreement, round(raw, 6) AS raw_close, round(close, 6) AS pred_close, round(close / before - 1, 6) AS predicted_return FROM path WHERE h > 0""",
    ),
    "k9_forecaster": (
        lambda s, d: R.choose_forecaster(experiments(s, d), ["momentum"]),
        f"""{scored_sql('fold')}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY composite DESC NULLS LAST, trained_at DESC, model) AS k FROM c),
        p AS (SELECT symbol, arg_min(model, k) AS best, arg_min(model, k) FILTER (WHERE model <> 'momentum') AS t FROM k GROUP BY symbol) SELECT symbol, best, coalesce(t, best) AS chosen, best = 'momentum' AND t IS NOT NULL AS replaced FROM p""",
    ),
    "k10_forecast_runs": (
        lambda s, d: rounded(R.forecast_runs(points(s, d), R.realized_volatility(table_bars(s, d).where(F.col("Date") < "1999-06-01")))),
        f"""WITH {POINTS}, e AS (SELECT symbol, max(horizon) AS steps, arg_max(pred, horizon) / max(last_close) - 1 AS path_return FROM pts GROUP BY symbol), k AS (SELECT symbol, ln(c / lag(c) OVER ({P})) AS r, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars WHERE dt < DATE '1999-06-01'),
        v AS (SELECT symbol, CASE WHEN max(n) >= 21 THEN stddev_pop(r) ELSE 0 END AS vol20 FROM k WHERE k <= 20 GROUP BY symbol), t AS (SELECT *, greatest(0.005, 0.003, 0.25 * vol20 * sqrt(steps)) AS threshold FROM e JOIN v USING (symbol))
        SELECT symbol, steps, round(path_return, 6) AS path_return, round(vol20, 6) AS vol20, round(threshold, 6) AS threshold, CASE WHEN path_return > threshold THEN 'UP' WHEN path_return < -threshold THEN 'DOWN' ELSE 'FLAT' END AS label FROM t""",
    ),
    "k12_history": (
        lambda s, d: rounded(R.history(dated_runs(s, d), 2).select("symbol", "run", F.size("points").alias("n"), F.element_at("points", -1)["actual_close"].alias("last_actual"), "mae", "dir_acc", F.col("k").alias("place"))),
        f"""WITH {DATED}, g AS (SELECT symbol, run, CAST(count(*) AS INT) AS n, arg_max(actual, horizon) AS a, avg(abs_error) AS mae, 100 * avg(CASE WHEN up THEN 1.0 ELSE 0 END) AS dir_acc FROM res GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY run DESC) AS INT) AS place FROM g)
        SELECT symbol, run, n, round(a, 6) AS last_actual, round(mae, 6) AS mae, round(dir_acc, 6) AS dir_acc, place FROM k WHERE place <= 2""",
    ),
    "k15_rolling_accuracy": (
        lambda s, d: rounded(R.rolling_accuracy(dated_points(s, d).select("symbol", "run", "run_at").distinct(), dated_runs(s, d), F.lit("1999-08-04").cast("date"), 60)),
        f"""WITH {DATED}, g AS (SELECT symbol, count(*) AS n, 100 * avg(CASE WHEN up THEN 1.0 ELSE 0 END) AS dir_acc, avg(abs_error) AS mae FROM res WHERE target_date >= DATE '1999-08-04' - 60 GROUP BY symbol)
        SELECT p.symbol, coalesce(n, 0) AS n, round(dir_acc, 6) AS dir_acc, round(mae, 6) AS mae, CASE WHEN dir_acc < 50 THEN 'degraded' ELSE 'healthy' END AS status FROM (SELECT DISTINCT symbol FROM pts) p LEFT JOIN g USING (symbol)""",
    ),
    "k15_marked_runs": (
        lambda s, d: R.mark_degraded(dated_points(s, d).select("symbol", "run", "run_at").distinct(), R.rolling_accuracy(dated_points(s, d), dated_runs(s, d), F.lit("1999-08-04").cast("date"), 60)).select("symbol", "run", "live_status"),
        f"""WITH {DATED}, g AS (SELECT symbol, 100 * avg(CASE WHEN up THEN 1.0 ELSE 0 END) AS dir_acc FROM res WHERE target_date >= DATE '1999-08-04' - 60 GROUP BY symbol), n AS (SELECT symbol, max(run) AS newest FROM pts GROUP BY 1)
        SELECT DISTINCT pts.symbol, run, CASE WHEN run = newest AND dir_acc < 50 THEN 'degraded' ELSE 'healthy' END AS live_status FROM pts JOIN n USING (symbol) LEFT JOIN g USING (symbol)""",
    ),
}
