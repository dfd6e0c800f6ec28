"""Models fitted by group and by fold, linear models from normal equations, and all blends of their predictions.

A symbol's rows of a fold are one group: they are shuffled once and every family is fitted there, so the fits of all symbols and folds run side by
side. Pooled linear models need no rows anywhere: tasks send their sums of products, which Spark adds up.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import reconstruct, sequences

#: Trees: bins of a feature, depth and number of trees of boosting and forest, the step of boosting, and the rows a leaf has at least.
BINS, BOOST, FOREST, STEP, LEAF = 16, (3, 40), (5, 30), 0.1, 5


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """Least squares with a penalty on the weights of centred columns, none on the intercept."""
    mean, middle = x.mean(0), y.mean()
    w = np.linalg.solve((x - mean).T @ (x - mean) + alpha * np.eye(x.shape[1]), (x - mean).T @ (y - middle))
    return lambda z: (z - mean) @ w + middle


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float = 0.001, l1: float = 0.5, rounds: int = 1000, tolerance: float = 1e-10) -> Callable[[np.ndarray], np.ndarray]:
    """Coordinate descent on half the mean squared error + alpha (l1 |w| + (1 - l1) / 2 w^2), over sums of products."""
    mean, middle, n = x.mean(0), y.mean(), len(x)
    gram, moment = (x - mean).T @ (x - mean) / n, (x - mean).T @ (y - middle) / n
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            rho = moment[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / (gram[j, j] + alpha * (1 - l1)) if gram[j, j] > 0 else 0.0
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tolerance:
            break
    return lambda z: (z - mean) @ w + middle


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]


def grow(b: np.ndarray, y: np.ndarray, depth: int, weight: np.ndarray | None = None, allowed: Callable[[int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree over binned columns, a level at a time: feature (-1: none) and bin (left up to it) of the inner places of a full binary tree, and
    the value of all its places. Each place takes the split that lowers the squared error most, if each side keeps LEAF rows."""
    w = np.ones(len(y)) if weight is None else weight
    places = 2 ** (depth + 1) - 1
    feature, cut, value = np.full(places, -1), np.zeros(places, int), np.zeros(places)
    at = np.zeros(len(y), int)
    for level in range(depth + 1):
        first, many = 2**level - 1, 2**level
        here = at - first
        live = (here >= 0) & (w > 0)
        total, size = (np.bincount(here[live], v[live], many) for v in (w * y, w))
        own = np.divide(total, size, out=np.zeros(many), where=size > 0)
        value[first : first + many] = np.where(size > 0, own, value[(np.arange(first, first + many) - 1) // 2] if level else 0.0)
        if level == depth:
            break
        best = np.full(many, 1e-12)
        for j in range(b.shape[1]):
            usable = np.ones(many, bool) if allowed is None else allowed(level)[:, j]
            key = here[live] * BINS + b[live, j]
            s, n = (np.bincount(key, v[live], many * BINS).reshape(many, BINS).cumsum(1)[:, :-1] for v in (w * y, w))
            right, m = total[:, None] - s, size[:, None] - n
            fits = (n >= LEAF) & (m >= LEAF) & usable[:, None]
            gain = np.where(fits, s**2 / np.maximum(n, 1e-9) + right**2 / np.maximum(m, 1e-9) - (total**2 / np.maximum(size, 1e-9))[:, None], -1.0)
            top = gain.argmax(1)
            found = gain[np.arange(many), top]
            better = found > best * (1 + 1e-12)
            best[better] = found[better]
            feature[first : first + many][better], cut[first : first + many][better] = j, top[better]
        split = live & (feature[at] >= 0)
        at = np.where(split, 2 * at + 1 + (b[np.arange(len(b)), np.maximum(feature[at], 0)] > cut[at]), np.where(at >= first, -1, at))
    return feature, cut, value


def leaf_values(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    feature, cut, value = tree
    at = np.zeros(len(b), int)
    for _ in range(int(np.log2(len(feature) + 1)) - 1):
        inner = (feature[at] >= 0) & (2 * at + 2 < len(feature))
        at = np.where(inner, 2 * at + 1 + (b[np.arange(len(b)), np.maximum(feature[at], 0)] > cut[at]), at)
    return value[at]


def boosting(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """Small trees, each on what the ones before left over."""
    edges = bin_edges(x)
    b, middle, trees = binned(x, edges), y.mean(), []
    left = y - middle
    for _ in range(BOOST[1]):
        trees.append(grow(b, left, BOOST[0]))
        left = left - STEP * leaf_values(trees[-1], b)
    return lambda z: middle + STEP * sum(leaf_values(t, binned(z, edges)) for t in trees)


def forest(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """Trees on rows drawn with return, each place choosing among a third of the columns (one at least)."""
    edges, r = bin_edges(x), np.random.default_rng(seed)
    b, k = binned(x, edges), max(1, x.shape[1] // 3)

    def some(level: int) -> np.ndarray:
        return chosen[level]

    trees = []
    for _ in range(FOREST[1]):
        chosen = [r.random((2**level, x.shape[1])).argsort(1) < k for level in range(FOREST[0])]
        trees.append(grow(b, y, FOREST[0], np.bincount(r.integers(0, len(y), len(y)), minlength=len(y)).astype(float), some))
    return lambda z: sum(leaf_values(t, binned(z, edges)) for t in trees) / len(trees)


#: Families by name: a fit of (x, y, seed) that gives a prediction of x. Columns come scaled by the training rows.
FAMILIES: dict[str, Callable] = {
    "naive_mean": lambda x, y, seed: lambda z: np.full(len(z), y.mean()),
    "ridge": lambda x, y, seed: ridge(x, y),
    "elastic_net": lambda x, y, seed: elastic_net(x, y),
    "boosting": lambda x, y, seed: boosting(x, y, seed),
    "forest": lambda x, y, seed: forest(x, y, seed),
}


def fit_group(train: pd.DataFrame, test: pd.DataFrame, features: Sequence[str], target: str, family: str, seed: int) -> np.ndarray:
    """Predictions of the test rows by one family, fitted on the training rows, columns scaled by their mean and deviation."""
    x, z = train[list(features)].to_numpy(float), test[list(features)].to_numpy(float)
    sd = x.std(0)
    mean, sd = x.mean(0), np.where(sd > 0, sd, 1.0)
    return FAMILIES[family]((x - mean) / sd, train[target].to_numpy(float), seed)((z - mean) / sd)


def group_seed(symbol: str, fold: int) -> int:
    return zlib.crc32(f"{symbol}:{fold}".encode())


def fit_folds(folded: DataFrame, features: Sequence[str], target: str = "target", families: Sequence[str] = tuple(FAMILIES), least: int = 60) -> DataFrame:
    """symbol, fold, model, status, Date, y_pred, y_true, n_train for every family in every fold of a symbol.

    folded has symbol, fold, role (train or test), Date, the features and the target; rows that lack one take no part. A split, a walk-forward and
    the whole selection period against a holdout are folds alike. A family that can't be fitted leaves one row without a date and says why:
    too few training rows, no test rows, or the error.
    """
    names = list(features)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        symbol, fold = key
        rows = rows.sort_values("Date", kind="stable")
        train, test = rows[rows["role"] == "train"], rows[rows["role"] == "test"]
        why = "too_few_rows" if len(train) < least else "no_test_rows" if not len(test) else ""
        parts = []
        for family in families:
            said, found = why, None
            if not why:
                try:
                    found = fit_group(train, test, names, target, family, group_seed(symbol, fold))
                except (np.linalg.LinAlgError, FloatingPointError) as error:
                    said = type(error).__name__
            parts.append(pd.DataFrame({
                "symbol": symbol, "fold": fold, "model": family, "status": said or "fitted", "Date": [None] if found is None else test["Date"].to_numpy(),
                "y_pred": [np.nan] if found is None else found, "y_true": [np.nan] if found is None else test[target].to_numpy(float), "n_train": len(train),
            }))
        return pd.concat(parts)

    whole = " and ".join(f"`{c}` is not null" for c in (*names, target))
    rows = folded.where(whole).select("symbol", F.col("fold").cast("int").alias("fold"), "role", "Date", *[F.col(c).cast("double").alias(c) for c in (*names, target)])
    kind = "symbol string, fold int, model string, status string, Date date, y_pred double, y_true double, n_train int"
    out = rows.groupBy("symbol", "fold").applyInPandas(run, kind)
    return out.withColumns({c: F.when(F.col("Date").isNotNull(), F.col(c)) for c in ("y_pred", "y_true")})


def normal_equations(rows: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys and sums: the products of (1, x, y) with itself, added over all rows, row by row of the matrix. x is an array of doubles of one
    length. Each task sends one matrix a key; Spark adds them place by place."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = np.asarray(batch.column(len(names)).flatten()).reshape(batch.num_rows, -1)
            z = np.column_stack([np.ones(len(wide)), wide, np.asarray(batch.column(len(names) + 1))])
            own = list(zip(*[batch.column(k).to_pylist() for k in range(len(names))], strict=True)) if names else [()] * len(z)
            places: dict[tuple, list[int]] = {}
            for at, key in enumerate(own):
                places.setdefault(key, []).append(at)
            for key, at in places.items():
                held[key] = held.get(key, 0) + z[at].T @ z[at]
        columns = [pa.array([key[k] for key in held], batch_kind) for k, batch_kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([m.ravel() for m in held.values()], pa.list_(pa.float64()))], names=[*names, "part"])

    from pyspark.sql.pandas.types import to_arrow_type

    few = rows.select(*names, F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    kinds = [to_arrow_type(few.schema[k].dataType) for k in names]
    shape = ", ".join([*(f"`{k}` {few.schema[k].dataType.simpleString()}" for k in names), "part array<double>"])
    placed = few.mapInArrow(run, shape).select(*names, F.posexplode("part").alias("at", "v"))
    added = placed.groupBy(*names, "at").agg(F.sum("v").alias("v"))
    return added.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("sums")).where(F.size("sums") > 0)


def solve_ridge(sums: Sequence[float], alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept from normal_equations' sums."""
    k = int(round(len(sums) ** 0.5))
    m = np.array(sums).reshape(k, k)
    n, sx, sy = m[0, 0], m[0, 1:-1], m[0, -1]
    gram, moment = m[1:-1, 1:-1] - np.outer(sx, sx) / n, m[1:-1, -1] - sx * sy / n
    w = np.linalg.solve(gram + alpha * np.eye(len(sx)), moment)
    return w, float((sy - sx @ w) / n)


def sequence_design(rows: DataFrame, columns: Sequence[str], steps: int, kind: str) -> DataFrame:
    """rows with x: a window of the last `steps` rows less its mean (dlinear) or its last row (nlinear), row by row, then that mean or row."""
    out = sequences(rows.where(" and ".join(f"`{c}` is not null" for c in columns)), list(columns), steps)
    s = F.col("sequence")

    def mean_of(j: int) -> Column:
        return F.aggregate(s, F.lit(0.0), lambda total, r: total + r[j]) / steps

    level = {"dlinear": F.array(*[mean_of(j) for j in range(len(columns))]), "nlinear": F.element_at(s, -1)}[kind]
    out = out.withColumn("_level", level)
    less = F.flatten(F.transform(s, lambda r: F.zip_with(r, F.col("_level"), lambda a, b: a - b)))
    return out.withColumn("x", F.concat(less, "_level")).drop("_level", "sequence")


@dataclass(frozen=True)
class LinearSequence:
    """A linear prediction over the x of sequence_design."""

    kind: str
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        products = F.zip_with(F.col("x"), F.array(*[F.lit(w) for w in self.weights]), lambda a, b: a * b)
        return F.aggregate(products, F.lit(self.intercept), lambda s, v: s + v)


def fit_sequence(design: DataFrame, kind: str, target: str = "target", alpha: float = 1.0) -> LinearSequence:
    """The ridge fit of a design's rows; only its sums of products come to the driver."""
    found = normal_equations(design, "x", target).first()
    if found is None:
        raise ValueError("no rows to fit")
    w, b = solve_ridge(found["sums"], alpha)
    return LinearSequence(kind, tuple(float(v) for v in w), b)


#: The blends, in the order in which they are given.
BLENDS = ("equal", "inverse_rmse", "sharpe", "risk_parity", "hierarchical", "stacker", "cash_gated")


def blend_weights(predictions: DataFrame, categories: DataFrame, alpha: float = 1.0) -> DataFrame:
    """symbol, model, blend, weight of each blend but the gate, over predictions(symbol, Date, model, target_pred, price_pred, y_target, y_price).

    Weights of a symbol sum to 1 and are equal where a rule gives none. The stacker is a ridge without intercept of the target on the models'
    target predictions, over the dates that all have, from sums of products; negatives count as 0.
    """
    pnl = F.signum("target_pred") * F.col("y_target")
    stats = predictions.groupBy("symbol", "model").agg(
        F.sqrt(F.avg(F.pow(F.col("price_pred") - F.col("y_price"), 2))).alias("rmse"), F.avg(pnl).alias("mean"), F.coalesce(F.stddev_samp(pnl), F.lit(0.0)).alias("sd")
    )
    stats = stats.join(F.broadcast(categories), "model", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
    own = Window.partitionBy("symbol")
    raw = {
        "equal": F.lit(1.0),
        "inverse_rmse": F.when(F.col("rmse") > 0, 1 / F.col("rmse")).otherwise(0.0),
        "sharpe": F.when(F.col("sd") > 0, F.greatest(F.col("mean") / F.col("sd"), F.lit(0.0))).otherwise(0.0),
        "risk_parity": F.when(F.col("sd") > 0, 1 / F.col("sd")).otherwise(0.0),
        "hierarchical": 1 / (F.size(F.collect_set("category").over(own)) * F.count(F.lit(1)).over(Window.partitionBy("symbol", "category"))),
    }
    long = stats.withColumn("b", F.array(*[F.struct(F.lit(n).alias("blend"), w.cast("double").alias("raw")) for n, w in raw.items()]))
    long = long.select("symbol", "model", F.explode("b").alias("b")).select("symbol", "model", "b.*")

    row = predictions.groupBy("symbol", "Date").agg(F.collect_list(F.struct("model", "target_pred")).alias("p"), F.max("y_target").alias("y"))
    models = stats.groupBy("symbol").agg(F.count(F.lit(1)).alias("k"))
    full = row.join(models, "symbol").where(F.size("p") == F.col("k"))
    pairs = full.select("symbol", "y", "p", F.explode("p").alias("a")).select("symbol", "y", "a", F.explode("p").alias("b"))
    sums = pairs.groupBy("symbol", F.col("a.model").alias("a"), F.col("b.model").alias("b")).agg(
        F.sum(F.col("a.target_pred") * F.col("b.target_pred")).alias("ab"), F.sum(F.col("a.target_pred") * F.col("y")).alias("ay"), F.count(F.lit(1)).alias("n")
    )

    def stack(rows: pd.DataFrame) -> pd.DataFrame:
        gram = rows.pivot(index="a", columns="b", values="ab").sort_index(axis=0).sort_index(axis=1)
        moment = rows.groupby("a")["ay"].first().sort_index()
        k = len(gram)
        w = np.ones(k) if rows["n"].iloc[0] < max(2, k + 1) else np.linalg.solve(gram.to_numpy() + alpha * np.eye(k), moment.to_numpy())
        return pd.DataFrame({"symbol": rows["symbol"].iloc[0], "model": gram.index, "blend": "stacker", "raw": np.maximum(w, 0.0)})

    stacked = sums.groupBy("symbol").applyInPandas(stack, "symbol string, model string, blend string, raw double")
    each = Window.partitionBy("symbol", "blend")
    total = F.sum("raw").over(each)
    return long.unionByName(stacked).select("symbol", "model", "blend", F.when(total > 0, F.col("raw") / total).otherwise(1 / F.count(F.lit(1)).over(each)).alias("weight"))


def blend_all(predictions: DataFrame, categories: DataFrame, mode: str = "log_return", least_agreement: float = 0.6) -> DataFrame:
    """symbol, Date, blend, target_pred, price_pred of all BLENDS, over the dates on which every model of the symbol predicts.

    predictions has prev_close besides. The gate takes the Sharpe blend's target where enough models agree on the sign, else 0, and its price
    from the close before.
    """
    found = predictions.join(blend_weights(predictions, categories), ["symbol", "model"])
    every = predictions.groupBy("symbol").agg(F.count_distinct("model").alias("_k"))
    up, down = F.count_if(F.col("target_pred") > 0), F.count_if(F.col("target_pred") < 0)
    out = found.groupBy("symbol", "Date", "blend").agg(
        F.sum(F.col("weight") * F.col("target_pred")).alias("target_pred"), F.sum(F.col("weight") * F.col("price_pred")).alias("price_pred"),
        (F.greatest(up, down) / F.count(F.lit(1))).alias("_agree"), F.max("prev_close").alias("prev_close"), F.count(F.lit(1)).alias("_n"),
    )
    out = out.join(every, "symbol").where(F.col("_n") == F.col("_k"))
    gated = out.where("blend = 'sharpe'").withColumns({"blend": F.lit("cash_gated"), "target_pred": F.when(F.col("_agree") >= least_agreement, F.col("target_pred")).otherwise(0.0)})
    gated = reconstruct(gated, mode, "target_pred").withColumn("price_pred", F.col("pred_price"))
    columns = ["symbol", "Date", "blend", "target_pred", "price_pred"]
    return out.select(columns).unionByName(gated.select(columns))


def replaced_means(rows: DataFrame, features: Sequence[str], predict: Callable[[np.ndarray], np.ndarray], keys: Sequence[str] = ("symbol", "Date")) -> DataFrame:
    """keys, feature, contribution: the prediction less the prediction with the feature at its mean over all rows, for each row and feature.

    One aggregate gives the means (a number a feature); each batch then scores its rows once as they are and once for every replaced column. The
    table is read once and no copy of it is made.
    """
    names = list(features)
    whole = rows.where(" and ".join(f"`{f}` is not null" for f in names)).select(*keys, *[F.col(f).cast("double").alias(f) for f in names])
    means = whole.agg(*[F.avg(f) for f in names]).first()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame[names].to_numpy(float)
            base = predict(x)
            out = frame[list(keys)].copy()
            for k, _ in enumerate(names):
                moved = x.copy()
                moved[:, k] = means[k]
                out[f"c{k}"] = base - predict(moved)
            yield out

    kind = ", ".join([*(f"`{k}` {whole.schema[k].dataType.simpleString()}" for k in keys), *(f"c{k} double" for k in range(len(names)))])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{k}").alias("contribution")) for k, f in enumerate(names)])
    return whole.mapInPandas(run, kind).select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
