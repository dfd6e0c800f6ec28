"""Queries that go through the stores and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import xsection as X
from tidemark.plans.common import rounded
from tidemark.plans.selections import experiments, scored, scored_sql
from tidemark.session import shared_folder, written
from tidemark.sources import stores

PEERS = "run_id long, symbol string, peer_score double, peer_percentile double"


def run_log(s, d):
    """Every model's year logged in two commits, the second of which runs twice."""
    log = stores.run_log(s, shared_folder(s, "run-log"))
    rows = experiments(s, d).select(
        "model", F.col("trained_at").cast("timestamp").alias("logged_at"), F.col("symbol").alias("dataset_hash"), F.create_map(F.lit("fold"), F.col("fold").cast("string")).alias("parameters"),
        F.create_map(F.lit("mae"), F.col("mae"), F.lit("composite"), F.col("composite")).alias("metrics"), F.array(F.lit("ret")).alias("features"), F.create_map(F.lit("validation_mode"), F.lit("walk_forward")).alias("metadata"),
    )
    rows = written(rows, "runs")
    early = F.col("logged_at") < "1999-01-01"
    for token, part in (("early", rows.where(early)), ("late", rows.where(~early)), ("late", rows.where(~early))):
        log.commit(part, token)
    m = F.col("metrics")
    return rounded(log.read().select("model", F.col("dataset_hash").alias("symbol"), F.col("parameters")["fold"].cast("int").alias("fold"), m["mae"].alias("mae"), m["composite"].alias("composite"), F.size("features").alias("features_count")))


def catalogue(s, d):
    """Versions of each symbol's models as their years are registered, in two batches."""
    store = stores.model_catalogue(s, shared_folder(s, "catalogue"))
    rows = experiments(s, d).select(
        F.concat_ws("|", "symbol", "model").alias("model_name"), F.array(F.lit("ret")).alias("features"), F.create_map(F.lit("rmse"), F.col("rmse")).alias("metrics"), F.concat(F.lit("/models/"), F.col("fold").cast("string")).alias("model_path"),
        F.col("trained_at").cast("timestamp").alias("registered_at"),
    )
    rows = written(rows, "entries")
    early = F.col("registered_at") < "1998-01-01"
    stores.register_models(store, rows.where(early), "early")
    stores.register_models(store, rows.where(~early), "late")
    return rounded(store.read().select("model_name", "version", "model_path", F.col("metrics")["rmse"].alias("rmse")))


def peers(s, d):
    """Scores of two runs, some of the second replaced; the newest run by percentile."""
    store = stores.Store(s, shared_folder(s, "peers"), PEERS, ("run_id", "symbol"))
    rows = scored(s, d, "fold").where("model = 'reversal'").select(F.col("fold").cast("long").alias("run_id"), "symbol", F.col("dir_acc").alias("peer_score"))

    def placed(part):
        return part.withColumn("peer_percentile", 100 * F.percent_rank().over(X.Window.partitionBy("run_id").orderBy("peer_score", "symbol")))

    for year in (1999, 2000):
        store.commit(placed(rows.where(F.col("run_id") == year)), f"run {year}")
    store.commit(placed(rows.where("run_id = 2000")).where("symbol like '%1'").withColumn("peer_percentile", F.col("peer_percentile") / 2), "corrected")
    store.compact()
    return rounded(stores.latest_run(store.read()))


C = scored_sql("fold")
PLANS = {
    "a21_run_log": (run_log, f"{C} SELECT model, symbol, fold, round(mae, 6) AS mae, round(composite, 6) AS composite, 1 AS features_count FROM c"),
    "a22_model_versions": (
        catalogue,
        f"{C} SELECT symbol || '|' || model AS model_name, CAST(row_number() OVER (PARTITION BY symbol, model ORDER BY trained_at, fold) AS INT) AS version, '/models/' || fold AS model_path, round(rmse, 6) AS rmse FROM c",
    ),
    "a23_peer_store": (
        peers,
        f"""{C}, ps AS (SELECT symbol, dir_acc, 100 * percent_rank() OVER (ORDER BY dir_acc, symbol) AS pc FROM c WHERE model = 'reversal' AND fold = 2000), q AS (SELECT symbol, dir_acc, CASE WHEN symbol LIKE '%1' THEN pc / 2 ELSE pc END AS pc FROM ps)
        SELECT 2000::BIGINT AS run_id, symbol, round(dir_acc, 6) AS peer_score, round(pc, 6) AS peer_percentile, CAST(row_number() OVER (ORDER BY pc DESC NULLS LAST, symbol) AS INT) AS place FROM q""",
    ),
}
