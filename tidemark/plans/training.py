"""Queries over grouped fits, linear sequence models, blends and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import over_time
from tidemark.operators import features as C
from tidemark.operators import splits
from tidemark.operators import training as T
from tidemark.operators.recursive import LinearModel
from tidemark.plans.common import MODELS, PANEL, model_rows, panel, rounded
from tidemark.sources.bars import table_bars

FEATURES = ("ret", "vol", "SMA_14_rel", "STD_14_rel", "logret_lag_1")
BLENDED = MODELS + """, base2 AS (
  SELECT symbol, model, dt, y_pred AS t, rr AS y, c * (1 + greatest(-0.95, least(5, y_pred))) AS p, c * (1 + rr) AS a, c FROM models
), st AS (
  SELECT symbol, model, sqrt(avg((p - a) ** 2)) AS rmse, avg(sign(t) * y) AS m, coalesce(stddev_samp(sign(t) * y), 0) AS sd FROM base2 GROUP BY 1, 2
), raw AS (
  SELECT symbol, model, unnest([{'b': 'equal', 'r': 1.0::DOUBLE}, {'b': 'inverse_rmse', 'r': CASE WHEN rmse > 0 THEN 1 / rmse ELSE 0 END}, {'b': 'sharpe', 'r': CASE WHEN sd > 0 THEN greatest(m / sd, 0) ELSE 0 END},
    {'b': 'risk_parity', 'r': CASE WHEN sd > 0 THEN 1 / sd ELSE 0 END}, {'b': 'hierarchical', 'r': 0.5::DOUBLE}], recursive := true) FROM st
), wide AS (
  SELECT symbol, dt, max(CASE WHEN model = 'momentum' THEN t END) AS x, max(CASE WHEN model = 'reversal' THEN t END) AS z, max(y) AS y FROM base2 GROUP BY 1, 2
), g AS (
  SELECT symbol, sum(x * x) + 1 AS xx, sum(z * z) + 1 AS zz, sum(x * z) AS xz, sum(x * y) AS xy, sum(z * y) AS zy, count(*) AS n FROM wide GROUP BY symbol
), raw2 AS (
  SELECT symbol, model, b, r FROM raw
  UNION ALL SELECT symbol, 'momentum', 'stacker', CASE WHEN n < 3 THEN 1 ELSE greatest(0, (xy * zz - zy * xz) / (xx * zz - xz * xz)) END FROM g
  UNION ALL SELECT symbol, 'reversal', 'stacker', CASE WHEN n < 3 THEN 1 ELSE greatest(0, (zy * xx - xy * xz) / (xx * zz - xz * xz)) END FROM g
), w AS (
  SELECT symbol, model, b, CASE WHEN sum(r) OVER (PARTITION BY symbol, b) > 0 THEN r / sum(r) OVER (PARTITION BY symbol, b) ELSE 0.5 END AS w FROM raw2
), bl AS (
  SELECT symbol, dt, b, sum(w * t) AS t, sum(w * p) AS p, greatest(count(*) FILTER (t > 0), count(*) FILTER (t < 0)) / 2.0 AS agree, max(c) AS c FROM base2 JOIN w USING (symbol, model) GROUP BY 1, 2, 3
), every AS (
  SELECT symbol, dt, b, t, p FROM bl
  UNION ALL SELECT symbol, dt, 'cash_gated', CASE WHEN agree >= 0.6 THEN t ELSE 0 END, c * (1 + greatest(-0.95, least(5, CASE WHEN agree >= 0.6 THEN t ELSE 0 END))) FROM bl WHERE b = 'sharpe'
)"""


def supervised(s, d):
    rows = C.lags(C.volatility(C.moving_averages(panel(s, d))))
    return rows.withColumn("target", F.lead("logret").over(over_time())).where("target is not null")


def fold_fits(s, d):
    """Three walk-forward folds of 60 rows of each symbol, every family in each, by side."""
    rows = supervised(s, d)
    folded = splits.assign_folds(rows, splits.walk_forward_bounds(rows, 3, 60, 120, embargo=1))
    return rounded(T.fit_folds(folded, FEATURES))


def family_scores(s, d):
    """Error and direction of each family over all symbols' folds."""
    e = F.col("y_pred") - F.col("y_true")
    out = fold_fits(s, d).groupBy("model", "status").agg(
        F.count_distinct("symbol", "fold").alias("fits"), F.count("Date").alias("rows"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.signum("y_pred") == F.signum("y_true")).cast("double")).alias("direction")
    )
    return rounded(out)


def blends(s, d):
    rows = model_rows(s, d)
    both = rows.select(
        "symbol", "Date", "model", F.col("y_pred").alias("target_pred"), F.col("y_true").alias("y_target"), F.col("Close").alias("prev_close"),
        (F.col("Close") * (1 + F.greatest(F.lit(-0.95), F.least(F.lit(5.0), F.col("y_pred"))))).alias("price_pred"), (F.col("Close") * (1 + F.col("y_true"))).alias("y_price"),
    )
    kinds = s.createDataFrame([("reversal", "contrarian"), ("momentum", "trend")], "model string, category string")
    return both, kinds


def sequence_models(s, d):
    """Next-bar predictions of both linear sequence models over windows of eight bars, fitted on the years before the last ones."""
    rows = C.drift_features(table_bars(s, d)).withColumn("target", F.lead("logret").over(over_time()))
    out = None
    for kind in ("dlinear", "nlinear"):
        design = T.sequence_design(rows, ["logret", "range_rel", "dlog_volume"], 8, kind).where("target is not null")
        model = T.fit_sequence(design.where("Date < '2000-01-01'"), kind)
        part = design.where("Date >= '2000-01-01'").select("symbol", F.lit(kind).alias("model"), "Date", model.column().alias("y_pred"), F.col("target").alias("y_true"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


LINEAR = LinearModel(("liq_log", "vol", "ret"), (0.5, -2.0, 1.0), 0.1)

PLANS = {
    "j26_fold_fits": (fold_fits, None),
    "j26_family_scores": (family_scores, None),
    "j5_linear_sequences": (sequence_models, None),
    "j15_blend_weights": (
        lambda s, d: rounded(T.blend_weights(*blends(s, d))),
        f"WITH {BLENDED} SELECT symbol, model, b AS blend, round(w, 6) AS weight FROM w",
    ),
    "j15_blends": (
        lambda s, d: T.blend_all(*blends(s, d), mode="return").select("symbol", "Date", "blend", F.round("target_pred", 6).alias("target_pred"), F.round(F.log("price_pred"), 6).alias("log_price")),
        f'WITH {BLENDED} SELECT symbol, dt AS "Date", b AS blend, round(t, 6) AS target_pred, round(ln(p), 6) AS log_price FROM every',
    ),
    "j18_replaced_means": (
        lambda s, d: rounded(T.replaced_means(panel(s, d), LINEAR.features, LINEAR.predict)),
        f"""WITH {PANEL}, p AS (SELECT * FROM panel WHERE vol IS NOT NULL AND ret IS NOT NULL AND liq_log IS NOT NULL), a AS (SELECT avg(liq_log) AS l0, avg(vol) AS v0, avg(ret) AS r0 FROM p)
        SELECT symbol, dt AS "Date", unnest(['liq_log', 'vol', 'ret']) AS feature, unnest([round(0.5 * (liq_log - l0), 6), round(-2 * (vol - v0), 6), round(ret - r0, 6)]) AS contribution FROM p, a""",
    ),
}
