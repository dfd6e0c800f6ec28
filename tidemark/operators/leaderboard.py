"""Leaderboards of finished runs: reliability classes, ranks, summaries by sector and history, and the report that they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The trade band, how near a clone is to holding, and the gap from which a run is unstable.
TRADE_BAND, CLONE_WITHIN, UNSTABLE_GAP = (8, 20), 0.001, 0.25
CLASSES = ("stable", "defensive", "research_candidate", "unstable", "invalid", "incomplete")
#: Fixed texts by history bucket.
HISTORY_WARNINGS = {
    "long_history": "",
    "mid_history": "5-10 years of data; compare against long_history cohorts before blaming model quality.",
    "short_history": "Less than 5 years of data; higher regime and holdout uncertainty.",
    "missing_data": "CSV missing or date history is unreadable; skipped unless data is restored.",
    "unknown": "History was not evaluated because data_dir was not provided.",
}
#: Fixed names: statuses and reasons of the sector lookup, and the diagnoses that keep confidence at medium.
MATCHED, UNSUPPORTED, NOT_FOUND = "matched_universe_sector_index", "missing_or_unsupported_sector_index", "symbol_not_found"
CAPPING = ("gate_too_strict", "insufficient_trades", "model_signal_weak", "underperform_buyhold")


def number(value: Column) -> Column:
    """A number from a number or from text with a point or a comma; null where it is none."""
    return F.regexp_replace(value.cast("string"), ",", ".").try_cast("double")


def history_bucket(years: Column, looked: bool = True, long_years: float = 10.0, short_years: float = 5.0) -> Column:
    missing = "missing_data" if looked else "unknown"
    return F.when(years.isNull(), missing).when(years >= long_years, "long_history").when(years >= short_years, "mid_history").otherwise("short_history")


def history_warning(bucket: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in HISTORY_WARNINGS.items() for x in pair])[bucket], F.lit(""))


def universe_check(bars: DataFrame, universe: DataFrame, long_years: float = 10.0, short_years: float = 5.0) -> DataFrame:
    """One row a listed symbol: whether it has bars, their first and last date, years of history, bucket and its warning, sector (else the
    sector index), and whether they reach back far enough. universe(symbol, sector, sector_index)."""
    span = bars.groupBy(F.upper(F.trim("symbol")).alias("symbol")).agg(F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    listed = universe.select(F.upper(F.trim("symbol")).alias("symbol"), F.coalesce(blank("sector"), blank("sector_index")).alias("sector"))
    out = listed.join(span, "symbol", "left").withColumn("history_years", F.round(F.datediff("last_date", "first_date") / 365.25, 4))
    bucket = history_bucket(F.col("history_years"), True, long_years, short_years)
    out = out.withColumns({"present": F.col("first_date").isNotNull(), "history_bucket": bucket, "long_enough": F.coalesce(F.col("history_years") >= long_years, F.lit(False))})
    return out.withColumn("data_history_warning", history_warning(F.col("history_bucket")))


def normal_symbol(value: Column) -> Column:
    """Upper case, trimmed, without the exchange's ending."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(value, F.lit("")))), r"\.IS$", "")


def sector_mapping(symbols: DataFrame, universe: DataFrame, supported: Sequence[str], market: str) -> DataFrame:
    """The sector index of each symbol from universe(symbol, sector, sector_index), else the market, with status, reason and the column that
    holds its returns. Of universe rows that repeat a symbol the first by sector index, then sector, counts."""
    rows = universe.select(normal_symbol(F.col("symbol")).alias("symbol"), F.struct(normal_symbol(F.col("sector_index")).alias("i"), F.col("sector").alias("s")).alias("u"))
    rows = rows.groupBy("symbol").agg(F.min("u").alias("u"))
    out = symbols.select(normal_symbol(F.col("symbol")).alias("symbol")).join(rows, "symbol", "left")
    found, listed = F.col("u").isNotNull(), F.coalesce(F.col("u.i").isin(list(supported)), F.lit(False))
    index = F.when(listed, F.col("u.i")).otherwise(market)
    return out.select(
        "symbol", F.nullif(F.trim("u.s"), F.lit("")).alias("sector"), index.alias("sector_index"), F.when(listed, "matched").otherwise("fallback").alias("status"),
        F.when(listed, MATCHED).when(found, UNSUPPORTED).otherwise(NOT_FOUND).alias("reason"), F.concat(index, F.lit("_Return")).alias("return_column"),
    )


def in_band(trades: Column) -> Column:
    return F.coalesce(trades.between(*TRADE_BAND), F.lit(False))


def run_rows(reports: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Leaderboard rows of reports(symbol, run_id, model, wf_net, final_net, final_buyhold, final_trades, final_sharpe, missing): gap, excess,
    flags, reliability class, and two ranks among complete rows (of each key): by walk-forward net return, and by excess, then net return.

    The numbers may be text. missing names what a run lacks, joined by |; empty or null for nothing.
    """
    n = {c: number(F.col(c)) for c in ("wf_net", "final_net", "final_buyhold", "final_trades", "final_sharpe")}
    out = reports.withColumns(n).withColumn("missing", F.coalesce("missing", F.lit("")))
    gap, excess, trades = F.col("wf_net") - F.col("final_net"), F.col("final_net") - F.col("final_buyhold"), F.col("final_trades")
    clone = F.coalesce((trades <= 1) & (F.abs(excess) <= CLONE_WITHIN), F.lit(False))
    out = out.withColumns({"gap": gap, "excess": excess, "complete": F.col("missing") == "", "enough_trades": in_band(trades), "benchmark_clone": clone})
    yes = lambda c: F.coalesce(c, F.lit(False))
    gained = yes(F.col("wf_net") > 0)
    label = F.when(~F.col("complete"), "incomplete").when(F.col("benchmark_clone") | trades.isNull() | (trades < 2), "invalid")
    label = label.when(F.col("enough_trades") & yes(F.col("excess") > 0) & gained, "stable")
    label = label.when(gained & (yes(F.col("final_net") <= 0) | yes(F.col("gap") >= UNSTABLE_GAP)), "unstable")
    label = label.when(F.col("enough_trades") & yes((F.col("final_net") >= 0) & (F.col("final_sharpe") > 0) & (F.col("excess") <= 0)), "defensive")
    out = out.withColumn("reliability", label.otherwise("research_candidate"))
    w = Window.partitionBy(*(keys or (F.lit(0),)), "complete")  # a row a symbol, run and model
    prediction = F.rank().over(w.orderBy(F.desc_nulls_last("wf_net")))
    trading = F.rank().over(w.orderBy(F.desc(F.coalesce("excess", F.lit(-1e9)) * 1000 + F.coalesce("final_net", F.lit(-1e9)))))
    return out.withColumns({"prediction_rank": F.when(F.col("complete"), prediction), "trading_rank": F.when(F.col("complete"), trading)})


def model_family(model: Column) -> Column:
    """A model's name without the endings of its variants."""
    name = F.trim(F.coalesce(model, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, " Return$", ""), " v2$", ""), " Lite$", "")
    return F.when(name == "", "unknown").when(name.startswith("Ensemble "), "Ensemble").when(bare.contains("Hybrid"), "Prophet Hybrid").otherwise(bare)


def counted(rows: DataFrame, by: str, what: str, least: int = 1) -> DataFrame:
    """by, and what as `value:count` joined in order, with the most frequent value (the first by name of equal ones)."""
    counts = rows.groupBy(by, what).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("n") >= least, F.struct(F.col(what).alias("v"), F.col("n").cast("string").alias("k")))))
    return counts.groupBy(by).agg(F.concat_ws("|", F.transform(pairs, lambda p: F.concat(p["v"], F.lit(":"), p["k"]))).alias("breakdown"), F.min_by(what, F.struct((-F.col("n")).alias("n"), F.col(what))).alias("top"))


def class_summary(rows: DataFrame, by: str) -> DataFrame:
    """Leaderboard rows by sector or history_bucket: symbols, rows, each class, the share that is incomplete or invalid, the mean gap, and model
    families; by sector the history buckets and repeated families, else all families."""
    rows = rows.withColumns({by: F.coalesce(by, F.lit("unknown")), "family": model_family(F.col("model"))})
    out = rows.groupBy(by).agg(
        F.count_distinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("run_rows"), *[F.count_if(F.col("reliability") == c).alias(f"{c}_count") for c in CLASSES],
        F.round(F.avg(F.col("reliability").isin("incomplete", "invalid").cast("double")), 6).alias("incomplete_invalid_rate"), F.avg("gap").alias("mean_gap"),
    )
    families = counted(rows, by, "family", 2 if by == "sector" else 1)
    out = out.join(families.withColumnsRenamed({"breakdown": "repeated_families" if by == "sector" else "families", "top": "top_family"}), by)
    if by == "sector":
        buckets = rows.withColumn("history_bucket", F.coalesce("history_bucket", F.lit("unknown")))
        out = out.join(counted(buckets, by, "history_bucket").select(by, F.col("breakdown").alias("history_buckets")), by)
    return out


def markdown(df: DataFrame, order: str) -> str:
    """A small table as Markdown; nothing but summaries of a few rows is meant for it."""
    rows = df.orderBy(order).collect()
    if not rows:
        return "_No rows._"
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def decision_report(rows: DataFrame) -> str:
    """The report on a leaderboard: overview, classes by history and by sector, and notes."""
    top = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"), F.concat_ws(", ", F.array_sort(F.collect_set("history_bucket"))).alias("buckets"), F.count_if(F.col("reliability").isin("incomplete", "invalid")).alias("bad")).first()
    first = rows.where("complete").orderBy("trading_rank", "prediction_rank", "symbol", "model").limit(1).collect()
    notes = ["- No run-level rows were available."] if not top["n"] else [
        f"- First ranked complete row: {first[0]['symbol']} / {first[0]['model']} / {first[0]['reliability']} / {first[0]['history_bucket']}." if first else "- No complete final-holdout rows were available.",
        f"- Incomplete or invalid rows: {top['bad']}",
    ]
    return "\n".join([
        "# Decision report", "", "The final holdout confirms only; policies are selected on walk-forward data.", "", "## Overview", "", f"- Run rows: {top['n']}", f"- Symbols: {top['symbols']}", f"- History buckets: {top['buckets']}", "",
        "## Reliability by history", "", markdown(class_summary(rows, "history_bucket"), "history_bucket"), "", "## Sectors", "", markdown(class_summary(rows, "sector"), "sector"), "", "## Notes", "", *notes, "",
    ])


def newest_runs(experiments: DataFrame, n: int) -> DataFrame:
    """Models over each symbol's n newest runs by the time they were trained: runs, means of score, direction, Sharpe and stability, the least
    stability, runs of stability 0 or more, in order of the mean score. experiments(symbol, run_id, model, trained_at, composite, dir_acc,
    sharpe, stability)."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("t"), F.desc("run_id"))
    runs = experiments.where("run_id is not null").groupBy("symbol", "run_id").agg(F.max("trained_at").alias("t")).withColumn("k", F.row_number().over(newest)).where(F.col("k") <= n)
    s = F.col("stability")
    out = experiments.join(runs.select("symbol", "run_id"), ["symbol", "run_id"]).groupBy("symbol", "model").agg(
        F.count(F.lit(1)).alias("run_count"), *[F.avg(c).alias(f"mean_{c}") for c in ("composite", "dir_acc", "sharpe", "stability")], F.min(s).alias("min_stability"), F.count_if(s >= 0).alias("steady_runs")
    )
    return out.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc_nulls_last("mean_composite"), "model")))


def signal_sets(folds: DataFrame, share: float = 0.7, least: int = 3) -> DataFrame:
    """fold, set, status, fold_count: the first part of the folds for calibration, the rest, `least` at least, for evaluation; with that few folds
    all are for evaluation and the status says that none are left."""
    w = Window.partitionBy(F.lit(0))  # a row a fold
    out = folds.select("fold").where("fold is not null").distinct().withColumns({"at": F.row_number().over(w.orderBy("fold")), "fold_count": F.count(F.lit(1)).over(w)})
    n = F.col("fold_count")
    first = F.greatest(F.lit(1), F.least(F.floor(n * share), n - least))
    few = n <= least
    return out.select("fold", F.when(~few & (F.col("at") <= first), "calibration").otherwise("evaluation").alias("set"), F.when(few, "skipped_insufficient_folds").otherwise("applied").alias("status"), "fold_count")


def confidence(rows: DataFrame) -> DataFrame:
    """confidence, block and soft_reasons of rows(eligibility, stale, dir_acc, rmse_ratio, psi_high, corporate_action, degraded, diagnosis,
    stability, rolling_ratio, agreement, regime_misaligned), all of which may be null.

    The first hard block in order makes it low. Soft reasons keep it at medium. High needs a direction of 55 at least, and what is known of
    stability, error and agreement to be good; what is unknown does not stand in the way.
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    hard = (
        ("eligibility", F.coalesce(c("eligibility"), F.lit("eligible")) != "eligible"), ("stale_data", c("stale")), ("dir_acc", c("dir_acc") < 50), ("rmse_ratio", c("rmse_ratio") >= 1), ("psi", c("psi_high")),
        ("corporate_action", c("corporate_action")), ("degraded", c("degraded")),
    )
    block = F.lit(None).cast("string")
    for name, bad in reversed(hard):
        block = F.when(yes(bad), name).otherwise(block)
    named = F.array_sort(F.array_intersect(F.transform(F.split(F.coalesce(c("diagnosis"), F.lit("")), ","), lambda x: F.trim(x)), F.array(*[F.lit(x) for x in CAPPING])))
    soft = (
        F.when(F.size(named) > 0, F.concat(F.lit("diagnosis: "), F.concat_ws(", ", named))), F.when(c("stability") < -0.1, F.lit("stability")), F.when(c("rolling_ratio") < 0.5, F.lit("rolling_ratio")),
        F.when(c("agreement") < 0.5, F.lit("agreement")), F.when(yes(c("regime_misaligned")), F.lit("regime")),
    )
    out = rows.withColumns({"block": block, "soft_reasons": F.array_compact(F.array(*soft))})
    fine = lambda ok: F.coalesce(ok, F.lit(True))
    high = (F.size("soft_reasons") == 0) & yes(c("dir_acc") >= 55) & fine(c("stability") >= 0.5) & fine(c("rmse_ratio") < 1) & fine(c("agreement") >= 5 / 7)
    out = out.withColumn("confidence", F.when(F.col("block").isNotNull(), "low").when(high, "high").otherwise("medium"))
    return out.withColumn("soft_reasons", F.when(F.col("block").isNull(), F.col("soft_reasons")).otherwise(F.array().cast("array<string>")))
