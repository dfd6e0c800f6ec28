"""Inputs that several queries share, in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import over_time
from tidemark.operators.features import causal_columns, returns
from tidemark.session import table
from tidemark.sources.bars import table_bars


#: Output columns that are dates; queries give them as ISO text, alike in Spark and in SQL.
DATES = ("Date", "first_date", "last_date", "entry_date", "exit_date", "target_date")


def dated(df: DataFrame) -> DataFrame:
    return df.select([F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in df.dtypes])


def dated_sql(sql: str) -> str:
    """sql with the date columns of its last SELECT as text."""
    depth, last = 0, 0
    for m in re.finditer(r"[()]|\bSELECT\b", sql):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if m[0] == "SELECT" and depth == 0:
            last = m.start()
    head = re.split(r"\bFROM\b(?![^()]*\))", sql[last:])[0]
    found = [c for c in DATES if re.search(rf'(?:AS "?{c}"?|[,\s]{c})(?=[,\s]|$)', head)]
    return f"SELECT * REPLACE ({', '.join(f'CAST({chr(34)}{c}{chr(34)} AS VARCHAR) AS {chr(34)}{c}{chr(34)}' for c in found)}) FROM ({sql})" if found else sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with causal columns and a sector."""
    return causal_columns(table_bars(spark, sf_dir)).join(sectors(spark, sf_dir), "symbol")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector: the most frequent part type of the brand, the first by name of equal ones."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol"), "p_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("symbol").agg(F.min_by("p_type", F.struct((-F.col("n")).alias("n"), "p_type")).alias("sector"))


def prediction_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, Date, y_pred (minus the past five-bar log return), y_true (the next one), and the panel's columns."""
    p = panel(spark, sf_dir).withColumns({"y_pred": -F.log(F.col("Close") / F.lag("Close", 5).over(over_time())), "y_true": F.col("target")})
    return p.where("y_pred is not null and y_true is not null")


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' predictions a bar: reversal and momentum of the last bar; realized_return is the next bar's simple return."""
    base = returns(table_bars(spark, sf_dir)).withColumn("realized_return", F.lead("Close").over(over_time()) / F.col("Close") - 1).where("realized_return is not null and ret is not null")
    both = base.withColumn("m", F.explode(F.array(F.struct(F.lit("reversal").alias("model"), (-F.col("ret")).alias("y_pred")), F.struct(F.lit("momentum").alias("model"), F.col("ret").alias("y_pred")))))
    return both.select("symbol", "m.model", "Date", "Close", "ret", "realized_return", "m.y_pred", F.col("realized_return").alias("y_true"))


BARS = """
trades AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS dt, l_extendedprice / l_quantity AS price, l_quantity AS q, l_orderkey * 100 + l_linenumber AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey
), bars AS (
  SELECT symbol, dt, arg_min(price, seq) AS o, max(price) AS h, min(price) AS l, arg_max(price, seq) AS c, sum(q) AS v FROM trades GROUP BY symbol, dt
), rets AS (
  SELECT *, c / lag(c) OVER w - 1 AS ret, ln(c / lag(c) OVER w) AS logret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)
)"""
SECTORS = """sectors AS (
  SELECT symbol, sector FROM (SELECT p_brand AS symbol, p_type AS sector, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS k FROM part GROUP BY 1, 2) WHERE k = 1
)"""
PANEL = (
    BARS
    + f", {SECTORS}"
    + """, panel0 AS (
  SELECT *, ln(lead(c, 5) OVER w / c) AS target, lead(dt, 5) OVER w AS target_date,
    CASE WHEN count(c * v) OVER r >= 5 THEN ln(1 + quantile_cont(c * v, 0.5) OVER r) END AS liq_log,
    CASE WHEN count(logret) OVER r >= 5 THEN stddev_samp(logret) OVER r END AS vol,
    -ln(c / lag(c, 5) OVER w) AS y_pred
  FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY dt), r AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)
), panel AS (SELECT panel0.*, sector FROM panel0 JOIN sectors USING (symbol)
), preds AS (SELECT *, target AS y_true FROM panel WHERE y_pred IS NOT NULL AND target IS NOT NULL)"""
)
MODELS = (
    BARS
    + """, base AS (
  SELECT symbol, dt, c, ret, lead(c) OVER (PARTITION BY symbol ORDER BY dt) / c - 1 AS rr FROM rets
), models AS (
  SELECT symbol, 'reversal' AS model, dt, c, ret, rr, -ret AS y_pred, rr AS y_true FROM base WHERE rr IS NOT NULL AND ret IS NOT NULL
  UNION ALL SELECT symbol, 'momentum', dt, c, ret, rr, ret, rr FROM base WHERE rr IS NOT NULL AND ret IS NOT NULL
)"""
)


def average_rank_sql(value: str, keys: str) -> str:
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0)"
