"""All queries of the panel engine, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.xsection import daily_rank_ic, ic_summary
from tidemark.plans import answers, backtests, boards, calibrations, crossings, forecasting, quality, runs, selections, series, serving, storage, training
from tidemark.plans.common import dated, dated_sql, prediction_panel, rounded

MODULES = (quality, series, crossings, backtests, selections, boards, serving, runs, forecasting, training, calibrations, storage, answers)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda s, d, q=query: dated(q(s, d))) for m in MODULES for name, (query, _) in m.PLANS.items()}
ORACLES: dict[str, str] = {name: dated_sql(sql) for m in MODULES for name, (_, sql) in m.PLANS.items() if sql}


def flagship(spark: SparkSession, sf_dir: str, min_names: int = 8) -> DataFrame:
    """Line items to bars, a five-bar reversal as prediction, its daily rank correlation with the next five bars, summarised."""
    return rounded(ic_summary(daily_rank_ic(prediction_panel(spark, sf_dir), min_names)))
