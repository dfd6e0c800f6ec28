"""Studies over pooled models: one linear fit a fold from sums of products, variants of targets and features, and what a model is for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.training import normal_equations, solve_ridge
from tidemark.operators.xsection import cross_sectional_features, cross_sectional_target, daily_rank_ic, ic_summary


def pooled_predictions(folded: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> DataFrame:
    """folded's test rows with y_pred by the ridge of each fold's training rows (role train / test). All folds' sums of products come in one
    aggregate; a few numbers a fold reach the driver."""
    whole = " and ".join(f"`{f}` is not null" for f in features)
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = folded.where(whole).withColumn("_x", x)
    sums = normal_equations(rows.where("role = 'train'"), "_x", target, ["fold"]).collect()  # folds x features^2 numbers
    fits = []
    for r in sums:
        w, b = solve_ridge(r["sums"], alpha)
        fits.append((r["fold"], [float(v) for v in w], b))
    table = folded.sparkSession.createDataFrame(fits, f"fold {folded.schema['fold'].dataType.simpleString()}, _w array<double>, _b double")
    test = rows.where("role = 'test'").join(F.broadcast(table), "fold")  # a row a fold
    return test.withColumn("y_pred", F.aggregate(F.zip_with("_x", "_w", lambda a, b: a * b), F.col("_b"), lambda s, v: s + v)).drop("_x", "_w", "_b")


def _scores(eps: float) -> dict[str, Column]:
    """Rows, direction in percent (forecasts within eps of 0 don't count), error, and the best that one constant direction would reach."""
    taken = F.abs("y_pred") > eps
    up = F.avg((F.col("y_true") > 0).cast("double"))
    return {
        "n": F.count(F.lit(1)), "dir_acc": 100 * F.avg(F.when(taken, (F.signum("y_true") == F.signum("y_pred")).cast("double"))),
        "rmse": F.sqrt(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2))), "base_rate": 100 * F.greatest(up, 1 - up),
    }


def per_fold_metrics(predictions: DataFrame, eps: float = 0.0) -> DataFrame:
    """predictions(symbol, fold, y_true, y_pred) by symbol and fold."""
    return predictions.groupBy("symbol", "fold").agg(*[c.alias(n) for n, c in _scores(eps).items()])


def per_symbol_metrics(predictions: DataFrame, least: int = 20, eps: float = 0.0) -> DataFrame:
    """Over all folds of a symbol: n_oos, n_folds, direction, error, base rate, edge over it, the share of folds with a direction of 50 or more,
    and whether there are enough rows to rely on."""
    folds = per_fold_metrics(predictions, eps).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_folds"), F.avg((F.col("dir_acc") >= 50).cast("double")).alias("positive_fold_ratio"))
    whole = predictions.groupBy("symbol").agg(*[c.alias({"n": "n_oos"}.get(n, n)) for n, c in _scores(eps).items()])
    return whole.join(folds, "symbol").withColumns({"edge": F.col("dir_acc") - F.col("base_rate"), "reliable": F.col("n_oos") >= least})


def ic_study(panel: DataFrame, assign, features: Sequence[str], min_names: int = 8) -> DataFrame:
    """Daily rank correlation with the raw target of three variants: absolute target, rank target, rank target with features relative to the
    date. assign(panel) gives rows by fold and role."""
    rows = cross_sectional_features(cross_sectional_target(panel, min_names=min_names), list(features))
    folded = assign(rows)
    relative = [f"{f}_{k}" for f in features for k in ("csr", "csz")]
    variants = [("absolute", "target", list(features)), ("rank_target", "target_cs", list(features)), ("rank_target_rank_features", "target_cs", [*features, *relative])]
    parts = []
    for name, target, columns in variants:
        found = pooled_predictions(folded, columns, target).withColumn("y_true", F.col("target"))
        parts.append(ic_summary(daily_rank_ic(found, min_names)).withColumns({"variant": F.lit(name), "features": F.lit(len(columns))}))
    return reduce(DataFrame.unionByName, parts)


#: Ensembles that may be chosen like candidates: fixed names.
CHOOSABLE = ("Ensemble Inverse RMSE", "Ensemble Cash-Gated", "Ensemble Seq-Attention Inverse RMSE")


def resolve_candidates(specs: DataFrame, selected: Sequence[str] = (), disabled: Sequence[str] = (), require_available: bool = False) -> DataFrame:
    """The models of specs(model, role, default_candidate, available) that take part: the selected ones that are candidates, else the default
    candidates; less the disabled ones and, if asked, those that are not available."""
    out = specs.where("role = 'candidate'")
    out = out.where(F.col("model").isin(list(selected))) if selected else out.where("default_candidate")
    if disabled:
        out = out.where(~F.col("model").isin(list(disabled)))
    return (out.where("available") if require_available else out).select("model")


def scoped(rows: DataFrame, specs: DataFrame, candidates: DataFrame) -> DataFrame:
    """rows with family, report_group (candidate, benchmark, ensemble, comparison), is_candidate, and reportable: candidates, benchmarks and the
    ensembles that may be chosen."""
    m = F.col("model")
    known = specs.select("model", F.col("role").alias("_role"), F.col("category").alias("family"))
    out = rows.join(F.broadcast(known), "model", "left").join(F.broadcast(candidates.select("model", F.lit(True).alias("_own"))), "model", "left")
    candidate = F.coalesce("_own", F.lit(False)) | m.isin(*CHOOSABLE)
    group = F.when(candidate, "candidate").when(F.col("_role") == "benchmark", "benchmark").when(m.startswith("Ensemble "), "ensemble").otherwise("comparison")
    out = out.withColumns({"family": F.coalesce("family", F.when(m.startswith("Ensemble "), "ensemble").otherwise("unknown")), "report_group": group, "is_candidate": candidate})
    return out.withColumn("reportable", F.col("report_group").isin("candidate", "benchmark")).drop("_role", "_own")


def worst_fold(folds: DataFrame) -> DataFrame:
    """The fold of each symbol and model with the least composite; of equal ones with the largest error."""
    w = Window.partitionBy("symbol", "model").orderBy(F.asc_nulls_last("composite"), F.desc_nulls_last("rmse"), "fold")
    return folds.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def best_candidate(metrics: DataFrame) -> DataFrame:
    """The candidate with the largest composite of each symbol, the smaller error first among equals."""
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("composite"), F.asc_nulls_last("rmse"), "model")
    return metrics.where("is_candidate").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def report_order(summary: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """place by net return, then Sharpe."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("net_return"), F.desc_nulls_last("sharpe"), "model")
    return summary.withColumn("place", F.row_number().over(w))


def window_choice(runs: DataFrame) -> DataFrame:
    """runs(symbol, window_years, model, composite, net_return, holdout_net_return): the gap to the holdout and the order in which windows are to
    be chosen, best first."""
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("composite"), F.desc_nulls_last("net_return"), F.asc_nulls_last(F.abs("holdout_gap")), "window_years", "model")
    out = runs.withColumn("holdout_gap", F.col("net_return") - F.col("holdout_net_return"))
    return out.withColumns({"place": F.row_number().over(w)}).withColumn("chosen", F.col("place") == 1)


def guard_scope(calibration: DataFrame, holdout: DataFrame, keys: Sequence[str] = ("symbol", "Date")) -> DataFrame:
    """calibration, if none of its rows are in the holdout; else an error that names how many."""
    n = calibration.join(holdout.select(*keys), list(keys), "left_semi").limit(1000).count()
    if n:
        raise ValueError(f"holdout rows must not be calibrated on: {n}{' or more' if n == 1000 else ''} of them")
    return calibration


def matrix_status(plan: DataFrame, finished: DataFrame, failed: DataFrame, resume: bool = True) -> DataFrame:
    """plan(symbol, model, policy) with status: skipped if a complete run is there and runs are resumed, error if it failed, ok if it ran,
    planned otherwise."""
    keys = ["symbol", "model", "policy"]
    out = plan.join(finished.select(*keys, F.lit(True).alias("_done")).distinct(), keys, "left").join(failed.groupBy(*keys).agg(F.max("error").alias("error")), keys, "left")
    done = F.coalesce("_done", F.lit(False))
    return out.withColumn("status", F.when(done & F.lit(resume), "skipped").when(F.col("error").isNotNull(), "error").when(done, "ok").otherwise("planned")).drop("_done")


def report_pairs(models: DataFrame, walk_forward: DataFrame, final: DataFrame, missing: DataFrame) -> DataFrame:
    """models(symbol, run_id, model) with the columns of both reports (wf_, final_ before their names), and what is missing: the run's files, and
    the model's row in a final report that is there. For leaderboard.run_rows."""
    keys = ["symbol", "run_id", "model"]
    renamed = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])
    reported = final.select("symbol", "run_id").distinct().withColumn("_reported", F.lit(True))
    out = models.join(renamed(walk_forward, "wf"), keys, "left").join(renamed(final.withColumn("_row", F.lit(True)), "final"), keys, "left")
    out = out.join(reported, ["symbol", "run_id"], "left").join(missing.select("symbol", "run_id", F.col("missing").alias("_files")), ["symbol", "run_id"], "left")
    no_row = F.when(F.coalesce("_reported", F.lit(False)) & F.col("final__row").isNull(), "final_holdout_model_row")
    return out.withColumn("missing", F.concat_ws("|", F.nullif("_files", F.lit("")), no_row)).drop("_files", "_reported", "final__row")


def backfill_metrics(experiments: DataFrame, reports: DataFrame, columns: Sequence[str], kept: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """experiments with the reports' columns where symbol, run, model and mode agree (kept: only where the report has a value), and the report
    rows that met no experiment."""
    keys = ["symbol", "run_id", "model", "validation_mode"]
    fresh = reports.select(*keys, F.lit(True).alias("_met"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = experiments.join(fresh, keys, "left")

    def value(c: str) -> Column:
        return F.coalesce(F.col(f"_{c}"), F.col(c)) if c in kept else F.when(F.col("_met"), F.col(f"_{c}")).otherwise(F.col(c))

    out = out.withColumns({c: value(c) for c in columns}).select(experiments.columns)
    return out, reports.join(experiments.select(*keys), keys, "left_anti")


def both_missing(data: DataFrame, universe: DataFrame) -> DataFrame:
    """symbol and where it is missing: not in the universe, or without data."""
    a, b = (df.select(F.upper("symbol").alias("symbol")).distinct() for df in (data, universe))
    return a.join(b, "symbol", "left_anti").withColumn("missing", F.lit("universe")).unionByName(b.join(a, "symbol", "left_anti").withColumn("missing", F.lit("data")))
