"""Operators across the symbols of a date: ranks, rank correlation, segments, peers, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import across, average_rank, percentile


def cross_sectional_target(panel: DataFrame, raw: str = "target", out: str = "target_cs", method: str = "rank", min_names: int = 8) -> DataFrame:
    """Centred rank 2 (r - 0.5) / n - 1, or z-score by sample deviation; dates with fewer names, and null targets, go."""
    d = across()
    if method == "rank":
        value = 2 * (average_rank(raw, "Date") - 0.5) / F.count(F.lit(1)).over(d) - 1
    else:
        value = (F.col(raw) - F.avg(raw).over(d)) / F.nullif(F.stddev_samp(raw).over(d), F.lit(0.0))
    return panel.where(F.col(raw).isNotNull()).withColumns({"_n": F.count(F.lit(1)).over(d), out: value}).where((F.col("_n") >= min_names) & F.col(out).isNotNull()).drop("_n")


def cross_sectional_features(panel: DataFrame, columns: list[str], kinds: tuple[str, ...] = ("rank", "zscore")) -> DataFrame:
    """_csr and _csz of each column within its date; null becomes 0."""
    d, more = across(), {}
    for c in columns:
        if "rank" in kinds:
            more[f"{c}_csr"] = F.coalesce(2 * (average_rank(c, "Date") - 0.5) / F.count(F.lit(1)).over(d) - 1, F.lit(0.0))
        if "zscore" in kinds:
            more[f"{c}_csz"] = F.coalesce((F.col(c) - F.avg(c).over(d)) / F.nullif(F.stddev_samp(c).over(d), F.lit(0.0)), F.lit(0.0))
    return panel.withColumns(more)


def percent_rank(value: str, *keys: str) -> Column:
    """Average rank over the count of values, 0.5 for null."""
    return F.coalesce(average_rank(value, *(keys or ("Date",))) / F.count(value).over(across(*keys)), F.lit(0.5))


def rank_blend(predictions: DataFrame, a: str, b: str, weight: float = 0.3) -> DataFrame:
    return predictions.withColumns({"_a": percent_rank(a), "_b": percent_rank(b)}).withColumn("y_pred", weight * F.col("_a") + (1 - weight) * F.col("_b")).drop("_a", "_b")


def daily_rank_ic(predictions: DataFrame, min_names: int = 8, segment: str | None = None) -> DataFrame:
    """Rank correlation of y_pred and y_true over the names of each date (and segment); constant dates are left out."""
    keys = [segment, "Date"] if segment else ["Date"]
    known = predictions.where(F.col("y_pred").isNotNull() & F.col("y_true").isNotNull())
    ranked = known.withColumns({"_p": average_rank("y_pred", *keys), "_t": average_rank("y_true", *keys)})
    # names are distinct within a date unless rows repeat; distinct symbols are what counts
    ic = ranked.groupBy(*keys).agg(F.corr("_p", "_t").alias("ic"), F.count_distinct("symbol").alias("n"), F.stddev_pop("_p").alias("_sp"), F.stddev_pop("_t").alias("_st"))
    return ic.where((F.col("n") >= min_names) & (F.col("_sp") > 0) & (F.col("_st") > 0)).select(*keys, F.round("ic", 9).alias("ic"), "n")


def ic_summary(daily: DataFrame, *keys: str) -> DataFrame:
    mean, sd = F.avg("ic"), F.stddev_pop("ic")
    return daily.groupBy(*keys).agg(mean.alias("ic_mean"), sd.alias("ic_std"), (mean / F.nullif(sd, F.lit(0.0))).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("pct_positive"), F.count(F.lit(1)).alias("n_days"))


def apart(daily: DataFrame, gap_days: int) -> DataFrame:
    """Dates at least gap_days after the last one kept, greedily from the first. One row a date, folded in order."""
    step = F.aggregate(
        F.array_sort(F.collect_list(F.struct("Date", "ic"))),
        F.expr("cast(array() as array<struct<Date:date,ic:double>>)"),
        lambda kept, x: F.when((F.size(kept) == 0) | (F.datediff(x["Date"], F.element_at(kept, -1)["Date"]) >= gap_days), F.concat(kept, F.array(x))).otherwise(kept),
    )
    return daily.select("Date", F.col("ic").cast("double").alias("ic")).agg(step.alias("k")).select(F.explode("k").alias("k")).select("k.Date", "k.ic")


def bucket(value: str, n: int, *keys: str) -> Column:
    """Quantile bucket 1 to n by first rank (ties by symbol), as equal-share cuts of the ranks give it."""
    w = Window.partitionBy(*keys)
    r = F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), "symbol"))
    return F.when(F.col(value).isNotNull(), F.greatest(F.lit(1), F.ceil((r - 1) * n / F.nullif(F.count(value).over(w) - 1, F.lit(0))).cast("int")))


def symbol_segments(panel: DataFrame, n: int = 5) -> DataFrame:
    """One row a symbol: median liquidity and volatility with their buckets, and the first sector."""
    per = panel.groupBy("symbol").agg(percentile(F.col("liq_log"), 0.5).alias("liq_med"), percentile(F.col("vol"), 0.5).alias("vol_med"), F.min_by("sector", "Date").alias("sector"))
    return per.withColumns({"liq_bucket": bucket("liq_med", n), "vol_bucket": bucket("vol_med", n)})


def segment_ic(predictions: DataFrame, segments: DataFrame, column: str, min_names: int = 3) -> DataFrame:
    """IC summary per segment; segments without enough names keep a row."""
    joined = predictions.join(segments.select("symbol", F.col(column).alias("segment")), "symbol")
    found = ic_summary(daily_rank_ic(joined, min_names, "segment"), "segment")
    size = segments.groupBy(F.col(column).alias("segment")).agg(F.count_distinct("symbol").alias("n_symbols"))
    return size.join(found, "segment", "left").withColumn("n_days", F.coalesce("n_days", F.lit(0)))


def peer_scores(predictions: DataFrame, *keys: str, min_universe: int = 15, high: float = 70.0, low: float = 30.0) -> DataFrame:
    """Scores within a date (and other keys, if given): centred rank, percentile and label; the first row (by y_pred) of a symbol counts."""
    keys = keys or ("Date",)
    one = Window.partitionBy(*keys, "symbol").orderBy(F.desc("y_pred"))
    rows = predictions.where(F.col("y_pred").isNotNull()).withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    share = (average_rank("y_pred", *keys) - 0.5) / n
    out = rows.withColumns({"universe_size": n, "peer_score": 2 * share - 1, "peer_percentile": 100 * share})
    p = F.col("peer_percentile")
    label = F.when(F.col("universe_size") < min_universe, "unknown").when(p >= high, "outperform").when(p <= low, "underperform").otherwise("inline")
    return out.withColumn("peer_label", label)


def newest_date(panel: DataFrame, least: int = 1) -> DataFrame:
    """Rows of the newest date that has so many, or of the newest of the fullest dates if none has."""
    last = panel.groupBy("Date").agg(F.least(F.count(F.lit(1)), F.lit(least)).alias("_n")).agg(F.max_by("Date", F.struct("_n", "Date")).alias("_d"))
    return panel.join(last, panel["Date"] == last["_d"], "left_semi")


def peer_confidence(peers: DataFrame, min_universe: int = 15) -> DataFrame:
    """Gates first, of which the first that fails gives low and a warning; then the composite ICIR: 1.0 high, 0.5 medium, else low, with a reason."""
    thin = (F.col("universe_size") < min_universe) | (F.col("peer_label") == "unknown")
    warning = F.when(~F.col("tradable"), "not_tradable").when(F.col("stale"), "stale").when(thin, "thin_universe").when(F.col("icir").isNull(), "icir_unknown")
    grade = F.when(F.col("icir") >= 1.0, "high").when(F.col("icir") >= 0.5, "medium").otherwise("low")
    out = peers.withColumn("_w", warning)
    return out.withColumns({
        "confidence_label": F.when(F.col("_w").isNotNull(), "low").otherwise(grade),
        "confidence_reasons": F.when(F.col("_w").isNull(), F.array(F.concat(F.lit("icir_"), grade))).otherwise(F.array().cast("array<string>")),
        "confidence_warnings": F.array_compact(F.array("_w")),
    }).drop("_w")


def composite_icir(peers: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean over the axes that have a value."""
    total = sum(F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items())
    value = sum(F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items())
    return peers.withColumn("icir", value / F.nullif(total, F.lit(0.0)))


def psi(rows: DataFrame, columns: list[str], split: str = "part", bins: int = 10) -> DataFrame:
    """Population stability per feature between split = 'train' and 'holdout': equal-width bins over both, empty bins at 1e-4.

    The edges are one row of the wide table; bins are counted in the wide table, too, an array of counters a feature.
    """
    edges = rows.agg(*[f(c).cast("double").alias(f"_{c}_{n}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    placed = rows.crossJoin(F.broadcast(edges))  # one row
    counts = []
    for c in columns:
        low, high = F.col(f"_{c}_low") - 1e-9, F.col(f"_{c}_high") + 1e-9
        place = F.floor((F.col(c).cast("double") - low) / (high - low) * bins).cast("int") + 1
        b = F.when(F.col(c).isNotNull(), F.least(F.lit(bins), place))
        for part in ("train", "holdout"):
            counts.append(F.array(*[F.count_if((b == k) & (F.col(split) == part)) for k in range(1, bins + 1)]).alias(f"{c}_{part}"))
    one = placed.agg(*counts)
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_train").alias("t"), F.col(f"{c}_holdout").alias("h")) for c in columns])).alias("x")).select("x.*")
    total = {c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) for c in "th"}
    long = long.select("feature", "t", "h", total["t"].alias("nt"), total["h"].alias("nh")).where("nt + nh > 0")

    def share(x: Column, n: str) -> Column:
        return F.when(x > 0, x / F.col(n)).otherwise(1e-4)

    parts = F.zip_with("t", "h", lambda t, h: (share(h, "nh") - share(t, "nt")) * F.log(share(h, "nh") / share(t, "nt")))
    found = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    enough = (F.col("nt") >= 2 * bins) & (F.col("nh") >= 2 * bins)
    return long.select("feature", F.when(enough, F.greatest(F.lit(0.0), found)).otherwise(0.0).alias("psi"))


def quintile_grid(predictions: DataFrame, n: int = 5, min_names: int = 8) -> DataFrame:
    """Per prediction quintile, and over all: rows, share of rises and mean outcome."""
    q = predictions.withColumn("_n", F.count(F.lit(1)).over(across())).withColumn("quintile", F.when(F.col("_n") >= min_names, bucket("y_pred", n, "Date").cast("string")).otherwise("NA"))
    return q.rollup("quintile").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y_true") > 0).cast("double")).alias("share_up"), F.avg("y_true").alias("mean_return")).withColumn("quintile", F.coalesce("quintile", F.lit("ALL")))
