"""Baselines, pooled models with Spark ML, and ways to combine predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def naive_baselines(rows: DataFrame, split: str) -> DataFrame:
    """Last value, zero and mean of the past as predictions of every row from `split` on."""
    past = rows.where(F.col("Date") < split).groupBy("symbol").agg(F.max_by("y_true", "Date").alias("naive_last"), F.avg("y_true").alias("naive_drift"))
    return rows.where(F.col("Date") >= split).select("symbol", "Date", "y_true").join(past, "symbol").select("symbol", "Date", "y_true", "naive_last", F.lit(0.0).alias("naive_zero"), "naive_drift")


def autoregression(rows: DataFrame, steps: int) -> DataFrame:
    """First-order autoregression of each symbol's returns by least squares, carried forward."""
    w = Window.partitionBy("symbol").orderBy("Date")
    fit = rows.withColumn("prev", F.lag("ret").over(w)).groupBy("symbol").agg(F.regr_slope("ret", "prev").alias("phi"), F.regr_intercept("ret", "prev").alias("c"), F.max_by("ret", "Date").alias("last"))
    out = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    power = F.pow("phi", "step")
    return out.select("symbol", "step", "phi", (F.col("c") * (1 - power) / (1 - F.col("phi")) + power * F.col("last")).alias("y_pred"))


def weights(predictions: DataFrame, how: str) -> DataFrame:
    """One weight a model, summing to 1; equal where none is positive. predictions(model, y_pred, y_true)."""
    pnl = F.signum("y_pred") * F.col("y_true")
    gain, loss = F.sum(F.when(pnl > 0, pnl)), -F.sum(F.when(pnl < 0, pnl))
    worth = {
        "inverse_rmse": 1 / F.nullif(F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col("y_true"), 2))), F.lit(0.0)),
        "sharpe": F.avg(pnl) / F.nullif(F.stddev_samp(pnl), F.lit(0.0)),
        "profit_factor": gain / F.nullif(loss, F.lit(0.0)) - 1,
        "risk_parity": 1 / F.nullif(F.stddev_samp(pnl), F.lit(0.0)),
    }[how]
    every = Window.partitionBy(F.lit(0))  # a row a model
    out = predictions.groupBy("model").agg(F.greatest(F.coalesce(worth, F.lit(0.0)), F.lit(0.0)).alias("_w"))
    return out.select("model", F.when(F.sum("_w").over(every) > 0, F.col("_w") / F.sum("_w").over(every)).otherwise(1 / F.count(F.lit(1)).over(every)).alias("weight"))


def category_weights(models: DataFrame) -> DataFrame:
    """models(model, category): equal over categories, equal within."""
    every = Window.partitionBy(F.lit(0))
    n = F.size(F.collect_set("category").over(every))
    return models.select("model", (1 / (n * F.count(F.lit(1)).over(Window.partitionBy("category")))).alias("weight"))


def combine(predictions: DataFrame, model_weights: DataFrame, missing: float = 0.0) -> DataFrame:
    """Weighted mean over models, equal where the weights present sum to 0."""
    w = F.coalesce("weight", F.lit(missing))
    out = predictions.join(model_weights, "model", "left").groupBy("symbol", "Date").agg(F.sum(w * F.col("y_pred")).alias("_s"), F.sum(w).alias("_w"), F.avg("y_pred").alias("_m"))
    return out.select("symbol", "Date", F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).otherwise(F.col("_m")).alias("y_pred"))


def cash_gate(predictions: DataFrame, least_agreement: float, least_size: float) -> DataFrame:
    """Mean prediction of the models, 0 where they disagree or the mean is small."""
    up, down = F.count_if(F.col("y_pred") > 0), F.count_if(F.col("y_pred") < 0)
    out = predictions.groupBy("symbol", "Date").agg((F.greatest(up, down) / F.count(F.lit(1))).alias("agreement"), F.avg("y_pred").alias("mean"))
    return out.withColumn("gated", F.when((F.col("agreement") >= least_agreement) & (F.abs("mean") >= least_size), F.col("mean")).otherwise(0.0))


def estimators() -> dict[str, Callable]:
    """Named factories of pooled Spark ML regressors over a `features` vector."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    common = {"featuresCol": "features", "labelCol": "target", "predictionCol": "y_pred"}
    return {
        "ridge": lambda: LinearRegression(elasticNetParam=0.0, regParam=1.0, **common),
        "elastic_net": lambda: LinearRegression(elasticNetParam=0.5, regParam=0.01, **common),
        "boosting": lambda: GBTRegressor(maxIter=20, maxDepth=4, seed=7, **common),
        "forest": lambda: RandomForestRegressor(numTrees=30, maxDepth=6, seed=7, **common),
    }


def out_of_sample(folded: DataFrame, features: list[str], factory: Callable) -> DataFrame:
    """Predictions of each fold's test rows by a model fitted on its training rows; folded: rows with fold and role. A distributed fit a fold."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(folded.where("target is not null"))
    out = None
    for fold in sorted(r["fold"] for r in folded.select("fold").distinct().collect()):
        model = factory().fit(rows.where((F.col("fold") == fold) & (F.col("role") == "train")))
        part = model.transform(rows.where((F.col("fold") == fold) & (F.col("role") == "test"))).select("symbol", "fold", "Date", F.col("target").alias("y_true"), "y_pred")
        out = part if out is None else out.unionByName(part)
    return out
