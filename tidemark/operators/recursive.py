"""Recursive forecasts: a model applied to the features that its own last price has made, step by step.

Each symbol is one row that holds its last bars; a task takes many symbols at once and folds the horizon over their state (the last closes, the
volume windows, the exponential averages), all symbols of a batch in one step. No job a step, no history that is longer than a feature reaches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.averages import FEATURES, empty, step
from tidemark.operators.forecasts import TICKS, next_days

#: Bars of history that a forecast starts from. The slowest average gives older ones less than 1e-16 of its weight.
HISTORY = 1000
#: Window features that the fold keeps up to date, beside averages.FEATURES.
WINDOWED = [
    *(f"SMA_{n}_rel" for n in (7, 14, 21, 50)), "Market_Regime_SMA200", "STD_14_rel", "STD_21_rel", "BB_width", "BB_upper_rel", "BB_lower_rel",
    "OBV_Norm_20", "VWAP_20_rel", "ret", "logret", *(f"logret_lag_{k}" for k in range(1, 6)),
]


@dataclass(frozen=True)
class LinearModel:
    """A linear prediction over named features, scaled as when it was fitted; quantiles by the residuals' own."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float = 0.0
    center: tuple[float, ...] | None = None
    scale: tuple[float, ...] | None = None
    clip: float | None = None
    residuals: dict[float, float] = field(default_factory=dict)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        if self.center is not None:
            x = (x - np.array(self.center)) / np.array(self.scale)
        return x if self.clip is None else np.clip(x, -self.clip, self.clip)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ np.array(self.weights) + self.intercept

    def quantiles(self, x: np.ndarray) -> dict[float, np.ndarray]:
        middle = self.predict(x)
        return {q: middle + d for q, d in self.residuals.items()}

    def column(self) -> Column:
        """The prediction as an expression over the features' columns."""
        out = F.lit(float(self.intercept))
        for k, (name, weight) in enumerate(zip(self.features, self.weights, strict=True)):
            x = F.col(name).cast("double")
            if self.center is not None:
                x = (x - float(self.center[k])) / float(self.scale[k])
            if self.clip is not None:
                x = F.greatest(F.lit(-float(self.clip)), F.least(F.lit(float(self.clip)), x))
            out = out + float(weight) * x
        return out


@dataclass(frozen=True)
class TreeModel:
    """A sum of regression trees over named features, as arrays (feature -1: a leaf)."""

    features: tuple[str, ...]
    trees: tuple[tuple[np.ndarray, ...], ...]
    tree_weights: tuple[float, ...]
    residuals: dict[float, float] = field(default_factory=dict)

    @classmethod
    def of(cls, model, features: Sequence[str], residuals: dict[float, float] | None = None) -> TreeModel:
        """From a fitted boosting or forest regressor of Spark ML with continuous features."""
        trees = []
        for tree in model.trees:
            rows: list[list[float]] = []

            def walk(node, rows=rows) -> int:
                at = len(rows)
                rows.append([-1, 0.0, 0, 0, node.prediction()])
                if node.subtreeDepth():
                    split = node.split()
                    rows[at][:2] = split.featureIndex(), split.threshold()
                    rows[at][2] = walk(node.leftChild())
                    rows[at][3] = walk(node.rightChild())
                return at

            walk(tree._call_java("rootNode"))
            columns = np.array(rows).T
            trees.append((columns[0].astype(int), columns[1], columns[2].astype(int), columns[3].astype(int), columns[4]))
        weights = list(model.treeWeights)
        if "Forest" in type(model).__name__:
            weights = [w / sum(weights) for w in weights]
        return cls(tuple(features), tuple(trees), tuple(weights), residuals or {})

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.tree_weights, strict=True):
            at = np.zeros(len(x), int)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])
            out += weight * value[at]
        return out

    def quantiles(self, x: np.ndarray) -> dict[float, np.ndarray]:
        middle = self.predict(x)
        return {q: middle + d for q, d in self.residuals.items()}


def tick_of(price: np.ndarray) -> np.ndarray:
    """Millionths of the price tick."""
    edges = [below for below, _ in TICKS if below is not None]
    return np.array([round(t * 1e6) for _, t in TICKS])[np.searchsorted(edges, price, "right")]


def on_tick(price: np.ndarray, how: str = "nearest", tick: np.ndarray | None = None) -> np.ndarray:
    """Prices on a tick, in millionths as whole numbers so that halves go up."""
    tick = tick_of(price) if tick is None else tick
    p = np.floor(price * 1e6 + 0.5).astype(np.int64)
    steps = {"nearest": (2 * p + tick) // (2 * tick), "floor": p // tick, "ceil": -(-p // tick)}[how]
    return steps * tick / 1e6


def price_band(before: np.ndarray, band: float = 0.10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper price of the day after `before`, and the tick of its base price."""
    base = on_tick(before)
    return on_tick(base * (1 - band), "ceil"), on_tick(base * (1 + band), "floor"), tick_of(base) / 1e6


def bound(price: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.clip(on_tick(np.clip(price, low, high)), low, high)


def to_price(target: np.ndarray, before: np.ndarray, mode: str) -> np.ndarray:
    """A predicted target as a price, within the same limits as features.reconstruct."""
    if mode == "price":
        return target
    return before * (1 + np.clip(target, -0.95, 5.0)) if mode == "return" else before * np.exp(np.clip(target, -1.0, 1.0))


class Series:
    """The state of many series: right-aligned matrices of their last bars (nan before they begin), and their averages."""

    def __init__(self, open_: list, high: list, low: list, close: list, volume: list):
        n, longest = len(close), max((len(c) for c in close), default=0)

        def matrix(rows: list) -> np.ndarray:
            out = np.full((n, longest), np.nan)
            for k, row in enumerate(rows):
                out[k, longest - len(row) :] = row
            return out

        self.high, self.low, self.close, self.volume = map(matrix, (high, low, close, volume))
        self.averages = empty(n)
        self.last: dict[str, np.ndarray] = {}
        for t in range(longest):
            self.last = step(self.averages, self.high[:, t], self.low[:, t], self.close[:, t])

    def append(self, close: np.ndarray) -> None:
        """A bar of which only the close is known; its high, low and volume are the last ones."""
        for name in ("high", "low", "volume"):
            rows = getattr(self, name)
            setattr(self, name, np.concatenate([rows[:, 1:], rows[:, -1:]], axis=1))
        self.close = np.concatenate([self.close[:, 1:], close[:, None]], axis=1)
        self.last = step(self.averages, self.high[:, -1], self.low[:, -1], close)

    def features(self) -> dict[str, np.ndarray]:
        """All features of the newest bar; nan where a window is not full."""
        c = self.close
        now, before = c[:, -1], c[:, -2] if c.shape[1] > 1 else np.full(len(c), np.nan)
        n = c.shape[1]

        def window(rows: np.ndarray, k: int) -> np.ndarray:
            return rows[:, -k:] if n >= k else np.full((len(rows), k), np.nan)

        out = dict(self.last)
        with np.errstate(invalid="ignore", divide="ignore"):
            out["ret"], out["logret"] = now / before - 1, np.log(now / before)
            steps = np.log(window(c, 7)[:, 1:] / window(c, 7)[:, :-1])
            out |= {f"logret_lag_{k}": steps[:, -1 - k] for k in range(1, 6)}
            out |= {f"SMA_{k}_rel": now / window(c, k).mean(1) - 1 for k in (7, 14, 21, 50)}
            long = window(c, 200).mean(1)
            out["Market_Regime_SMA200"] = np.where(np.isnan(long), 0, np.where(now > long, 1, -1)).astype(float)
            out |= {f"STD_{k}_rel": window(c, k).std(1, ddof=1) / now for k in (14, 21)}
            middle, sd = window(c, 20).mean(1), window(c, 20).std(1)
            out |= {"BB_width": 4 * sd / middle, "BB_upper_rel": (middle + 2 * sd) / now - 1, "BB_lower_rel": (middle - 2 * sd) / now - 1}
            volume, typical = window(self.volume, 20), (window(self.high, 20) + window(self.low, 20) + window(c, 20)) / 3
            signs = np.sign(window(c, 21)[:, 1:] - window(c, 21)[:, :-1])
            total = np.where(volume.sum(1) == 0, np.nan, volume.sum(1))
            out["OBV_Norm_20"] = (signs * volume).sum(1) / total
            flow = (typical * volume).sum(1) / total
            out["VWAP_20_rel"] = now / np.where(flow == 0, np.nan, flow) - 1
        return out


POINTS = ["raw_predicted_close", "bounded_predicted_close", "predicted_return", "lower_band", "upper_band", "price_tick"]


def fold(series: Series, extra: dict[str, np.ndarray], model, horizon: int, mode: str, band: float) -> list[dict[str, np.ndarray]]:
    """The points of each step: predict from the newest features, bound the price, append it, and so on."""
    out, kept = [], {}
    for _ in range(horizon):
        now = series.features() | extra
        x = np.stack([now[f] for f in model.features], axis=1)
        for k, f in enumerate(model.features):  # a feature that a step can't give keeps its last value
            x[:, k] = np.where(np.isnan(x[:, k]), kept.get(f, x[:, k]), x[:, k])
            kept[f] = x[:, k]
        before = series.close[:, -1]
        low, high, tick = price_band(before, band)
        raw = to_price(model.predict(x), before, mode)
        close = bound(raw, low, high)
        point = dict(zip(POINTS, (raw, close, close / before - 1, low, high, tick), strict=True))
        for q, target in model.quantiles(x).items():
            price = bound(to_price(target, before, mode), low, high)
            point |= {f"p{round(100 * q)}_close": price, f"p{round(100 * q)}_return": price / before - 1}
        out.append(point)
        series.append(close)
    return out


def last_bars(bars: DataFrame, extra: Sequence[str] = (), history: int = HISTORY) -> DataFrame:
    """One row a symbol: its last bars in arrays, by date, and the newest values of the extra columns."""
    recent = bars.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("Date")))).where(F.col("_k") <= history)
    names = ["Open", "High", "Low", "Close", "Volume"]
    packed = recent.groupBy("symbol").agg(
        F.max("Date").alias("last_date"), F.array_sort(F.collect_list(F.struct("Date", *[F.col(c).cast("double").alias(c) for c in names]))).alias("b"), *[F.max_by(F.col(c).cast("double"), "Date").alias(c) for c in extra]
    )
    return packed.select("symbol", "last_date", *[F.col("b")[c].alias(c) for c in names], *extra)


def roll_forward_recursive(bars: DataFrame, model, horizon: int = 5, mode: str = "log_return", extra: Sequence[str] = (), band: float = 0.10, history: int = HISTORY) -> DataFrame:
    """symbol, last_date, horizon, the price, return, band and tick of each step, and the prices and returns of the model's quantiles.

    The model has features, predict(matrix) and quantiles(matrix). Features are those of averages.FEATURES and WINDOWED, which follow the
    forecast closes, and the extra columns of bars, which stay as they were last. Symbols whose newest features are not all known are left out.
    """
    known = {*FEATURES, *WINDOWED, *extra}
    if missing := [f for f in model.features if f not in known]:
        raise ValueError(f"the model needs features that the bars do not give: {missing[:5]}")
    quantiles = [f"p{round(100 * q)}_{x}" for q in model.residuals for x in ("close", "return")]
    columns = [*POINTS, *quantiles]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                series = Series(*(part[c].tolist() for c in ("Open", "High", "Low", "Close", "Volume")))
                beside = {c: part[c].to_numpy(float) for c in extra}
                first = series.features() | beside
                ready = ~np.isnan(np.stack([first[f] for f in model.features], axis=1)).any(1)
                for h, point in enumerate(fold(series, beside, model, horizon, mode, band), 1):
                    out = pd.DataFrame({"symbol": part["symbol"].to_numpy(), "last_date": part["last_date"].to_numpy(), "horizon": np.int32(h), **point})
                    yield out[ready][["symbol", "last_date", "horizon", *columns]]

    schema = "symbol string, last_date date, horizon int, " + ", ".join(f"{c} double" for c in columns)
    return last_bars(bars, extra, history).mapInPandas(run, schema)


def recursive_points(bars: DataFrame, days: DataFrame, model, **options) -> DataFrame:
    """roll_forward_recursive with the target date of each step, from days(Date)."""
    horizon = options.get("horizon", 5)
    points = roll_forward_recursive(bars, model, **options)
    last = bars.groupBy("symbol").agg(F.max("Date").alias("last_date"))
    return points.join(next_days(last, days, horizon), ["symbol", "horizon"])


def latest_features(rows: DataFrame, features: Sequence[str], steps: int = 1) -> DataFrame:
    """The newest row of each symbol that has all features, or its last `steps` rows as one array of arrays (only where there are so many)."""
    if missing := [f for f in features if f not in rows.columns]:
        raise ValueError(f"missing features: {missing[:5]}")
    whole = rows.where(" and ".join(f"`{f}` is not null" for f in features))
    newest = whole.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("Date"))))
    if steps == 1:
        return newest.where("_k = 1").drop("_k")
    row = F.struct("Date", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    packed = newest.where(F.col("_k") <= steps).groupBy("symbol").agg(F.max("Date").alias("Date"), F.array_sort(F.collect_list(row)).alias("r"))
    return packed.where(F.size("r") == steps).select("symbol", "Date", F.transform("r", lambda x: x["x"]).alias("sequence"))


def latest_targets(rows: DataFrame, model: LinearModel) -> DataFrame:
    """Target and quantile targets of each symbol's newest row, by the model's own scaling."""
    target = model.column()
    quantiles = {f"p{round(100 * q)}_target": target + float(d) for q, d in model.residuals.items()}
    return latest_features(rows, model.features).select("symbol", "Date", target.alias("target"), *[c.alias(n) for n, c in quantiles.items()])


def fit_linear(rows: DataFrame, features: Sequence[str], target: str = "target", penalty: float = 1e-4, quantiles: Sequence[float] = (0.1, 0.5, 0.9)) -> LinearModel:
    """A ridge model of the rows that have all features, by one distributed fit, with the quantiles of its residuals (to a thousandth)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    whole = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(rows.where(f"`{target}` is not null"))
    fitted = LinearRegression(featuresCol="_x", labelCol=target, regParam=penalty, elasticNetParam=0.0, solver="normal").fit(whole)
    model = LinearModel(tuple(features), tuple(float(w) for w in fitted.coefficients), float(fitted.intercept))
    left = whole.select((F.col(target) - model.column()).alias("r")).agg(F.percentile_approx("r", list(quantiles), 1000)).first()[0]
    return LinearModel(model.features, model.weights, model.intercept, residuals=dict(zip(quantiles, left, strict=True)))


def rederive(stored: DataFrame, appended: DataFrame, derive, derived: Sequence[str], look_back: int = HISTORY) -> DataFrame:
    """The appended bars with their derived columns, computed from each symbol's last look_back stored bars only; other columns as given.

    derive adds the derived columns to bars. Stored rows are not changed: what a window or a faded average has seen lies within look_back.
    """
    own = [c for c in appended.columns if c in stored.columns and c not in derived]
    touched = stored.join(appended.select("symbol").distinct(), "symbol", "left_semi")
    recent = touched.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("Date")))).where(F.col("_k") <= look_back)
    both = recent.select(*own, F.lit(False).alias("_new")).unionByName(appended.select(*own, F.lit(True).alias("_new")))
    return derive(both).where("_new").select(*own, *derived)
