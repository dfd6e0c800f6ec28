"""Queries over sources and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.plans.common import BARS, rounded
from tidemark.session import table
from tidemark.sources import bars as B

CUT = "1999-01-01"


def stored_and_offered(spark, sf_dir):
    bars = B.table_bars(spark, sf_dir)
    return bars.where(F.col("Date") < CUT), bars.where(F.col("Date") >= F.date_sub(F.lit(CUT).cast("date"), 30)).withColumn("seq", F.lit(1))


def a15(spark, sf_dir):
    stored, offered = stored_and_offered(spark, sf_dir)
    both = B.stored_rows_win(stored.select("symbol", "Date", "Close"), offered.select("symbol", "Date", (F.col("Close") + 1).alias("Close")), ["symbol", "Date"])
    return rounded(both.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("Close").alias("total")))


def a17(spark, sf_dir):
    """The trading calendar of each order year: holidays are dates of the largest orders."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("Date"), "o_totalprice")
    span = orders.agg(F.min("Date").alias("a"), F.max("Date").alias("b")).first()
    holidays = orders.where("o_totalprice > 400000").select("Date").distinct().withColumn("Note", F.lit("closed"))
    days = B.calendar(spark, str(span["a"]), str(span["b"]), holidays)
    return days.groupBy(F.year("Date").alias("year")).agg(F.count(F.lit(1)).alias("days"), F.count_if("Is_Trading_Day").alias("trading"), F.count("Note").alias("noted"))


PLANS = {
    "a2_bars": (
        lambda s, d: rounded(B.table_bars(s, d)),
        f'WITH {BARS} SELECT symbol, dt AS "Date", round(o, 6) AS "Open", round(h, 6) AS "High", round(l, 6) AS "Low", round(c, 6) AS "Close", v AS "Volume" FROM bars',
    ),
    "a6_latest_rows": (
        lambda s, d: rounded(B.latest_rows(B.table_bars(s, d))),
        f"WITH {BARS} SELECT symbol, max(dt) AS last_date, round(arg_max(c, dt), 6) AS last_close FROM bars GROUP BY symbol",
    ),
    "a7_update_status": (
        lambda s, d: B.update_status(*stored_and_offered(s, d)),
        f"""WITH {BARS}, last AS (SELECT symbol, max(dt) AS last FROM bars WHERE dt < DATE '{CUT}' GROUP BY symbol)
        SELECT b.symbol, count(CASE WHEN b.dt >= DATE '{CUT}' - 30 AND (last IS NULL OR b.dt > last) THEN 1 END) AS rows_added,
          CASE WHEN count(CASE WHEN b.dt >= DATE '{CUT}' - 30 AND (last IS NULL OR b.dt > last) THEN 1 END) > 0 THEN 'updated' ELSE 'up_to_date' END AS status
        FROM bars b LEFT JOIN last USING (symbol) GROUP BY b.symbol""",
    ),
    "a15_stored_rows_win": (
        a15,
        f"WITH {BARS} SELECT symbol, count(*) AS n, round(sum(CASE WHEN dt < DATE '{CUT}' THEN c ELSE c + 1 END), 6) AS total FROM bars GROUP BY symbol",
    ),
    "a17_calendar": (
        a17,
        """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS dt, o_totalprice AS p FROM orders), span AS (SELECT min(dt) AS a, max(dt) AS b FROM o),
        days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS dt FROM span), hol AS (SELECT DISTINCT dt, true AS hol FROM o WHERE p > 400000)
        SELECT CAST(year(dt) AS INT) AS year, count(*) AS days, count(CASE WHEN isodow(dt) < 6 AND hol IS NULL THEN 1 END) AS trading, count(hol) AS noted FROM days LEFT JOIN hol USING (dt) GROUP BY 1""",
    ),
    "b3_survivorship": (
        lambda s, d: Q.survivorship(B.table_bars(s, d)),
        f"""WITH {BARS}, g AS (SELECT symbol, dt, dt - lag(dt) OVER (PARTITION BY symbol ORDER BY dt) AS gap FROM bars)
        SELECT symbol, CAST(max(dt) - min(dt) AS INT) AS span_days, count(*) AS n_rows, CAST(coalesce(max(gap), 0) AS INT) AS max_gap,
          max(dt) - min(dt) < 730 AS short_history, coalesce(max(gap), 0) > 10 AS gap_found FROM g GROUP BY symbol""",
    ),
    "b5_corporate_actions": (
        lambda s, d: rounded(Q.corporate_actions(B.table_bars(s, d))),
        f"""WITH {BARS} SELECT symbol, dt AS "Date", round(logret, 6) AS logret, CASE WHEN abs(logret) >= 0.5 THEN 'extreme' ELSE 'large' END AS severity,
          CASE WHEN logret < 0 THEN 'split_or_fall' ELSE 'merge_or_rise' END AS note FROM rets WHERE abs(logret) >= 0.3""",
    ),
    "b8_universe_audit": (
        lambda s, d: rounded(Q.audit(B.table_bars(s, d))),
        f"""WITH {BARS}, g AS (SELECT *, dt - lag(dt) OVER (PARTITION BY symbol ORDER BY dt) AS gap FROM rets), t AS (SELECT max(dt) AS newest FROM bars)
        SELECT symbol, count(*) AS n_rows, min(dt) AS first_date, max(dt) AS last_date, CAST(max(dt) - min(dt) AS INT) AS span_days, count(*) - count(DISTINCT dt) AS duplicate_dates,
          count(CASE WHEN v = 0 THEN 1 END) AS zero_volume, count(CASE WHEN c IS NULL THEN 1 END) AS null_close, count(CASE WHEN c <= 0 THEN 1 END) AS nonpositive_close,
          CAST(max(gap) AS INT) AS max_gap, count(CASE WHEN abs(logret) >= 0.3 THEN 1 END) AS anomalies, round(max(abs(logret)), 6) AS max_abs_logret,
          CAST(max(newest) - max(dt) AS INT) AS days_behind,
          CASE WHEN max(dt) - min(dt) >= 3652.5 THEN 'long' WHEN max(dt) - min(dt) >= 1826.25 THEN 'mid' ELSE 'short' END AS history
        FROM g, t GROUP BY symbol""",
    ),
    "b9_training_window": (
        lambda s, d: Q.training_window(B.table_bars(s, d), 3, 252).groupBy("symbol", "window_status").agg(F.count(F.lit(1)).alias("n"), F.min("Date").alias("first_date")),
        f"""WITH {BARS}, m AS (SELECT *, max(dt) OVER (PARTITION BY symbol) AS last FROM bars), k AS (SELECT *, count(CASE WHEN dt >= last - INTERVAL 3 YEAR THEN 1 END) OVER (PARTITION BY symbol) AS n_in FROM m)
        SELECT symbol, CASE WHEN n_in >= 252 THEN 'window' ELSE 'all' END AS window_status, count(*) AS n, min(dt) AS first_date FROM k WHERE n_in < 252 OR dt >= last - INTERVAL 3 YEAR GROUP BY 1, 2""",
    ),
    "b15_freshness": (
        lambda s, d: Q.freshness(B.table_bars(s, d), 3),
        f"""WITH {BARS}, days AS (SELECT DISTINCT dt FROM bars), last AS (SELECT symbol, max(dt) AS last_date FROM bars GROUP BY symbol)
        SELECT symbol, last_date, count(days.dt) AS days_behind, count(days.dt) > 3 AS stale FROM last LEFT JOIN days ON days.dt > last_date GROUP BY symbol, last_date""",
    ),
    "e38_fingerprint": (
        lambda s, d: B.table_bars(s, d).groupBy("symbol").agg(F.min("Date").cast("string").alias("a"), F.max("Date").cast("string").alias("b"), F.count(F.lit(1)).cast("string").alias("n")).select("symbol", F.sha2(F.concat_ws("|", "symbol", "a", "b", "n"), 256).alias("fingerprint")),
        f"WITH {BARS} SELECT symbol, sha256(concat_ws('|', symbol, CAST(min(dt) AS VARCHAR), CAST(max(dt) AS VARCHAR), CAST(count(*) AS VARCHAR))) AS fingerprint FROM bars GROUP BY symbol",
    ),
}
