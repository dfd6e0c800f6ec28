"""Grouped fits, linear sequences, blends and attributions against single fits and plain loops."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import training as T
from tidemark.operators.recursive import TreeModel


def folded_rows(seed=4):
    r = np.random.default_rng(seed)
    rows = []
    for s in ("A", "B", "C"):
        for fold in (1, 2):
            n = 150 if s != "C" else 40
            x = r.normal(size=(n + 25, 3))
            y = 0.5 * x[:, 0] - np.maximum(x[:, 1], 0) + 0.2 * r.normal(size=n + 25)
            rows += [(s, fold, "train" if k < n else "test", datetime.date(2021, 1, 1) + datetime.timedelta(days=k), *map(float, x[k]), float(y[k])) for k in range(n + 25)]
    rows += [("D", 1, "train", datetime.date(2021, 1, 1) + datetime.timedelta(days=k), float(k), 1.0, 2.0, float(k % 3)) for k in range(80)]
    rows += [("A", 1, "test", datetime.date(2022, 1, 1), None, 1.0, 1.0, 1.0)]
    return rows, "symbol string, fold int, role string, Date date, a double, b double, c double, target double"


def test_grouped_fits_equal_single_fits(spark):
    rows, schema = folded_rows()
    got = T.fit_folds(spark.createDataFrame(rows, schema).repartition(7), ["a", "b", "c"]).toPandas()
    status = {(r.symbol, r.fold): r.status for r in got.itertuples()}
    assert status[("C", 1)] == "too_few_rows" and status[("D", 1)] == "no_test_rows" and status[("A", 1)] == "fitted"
    assert set(got[got.status == "fitted"].model) == set(T.FAMILIES)
    data = pd.DataFrame(rows, columns=["symbol", "fold", "role", "Date", "a", "b", "c", "target"]).dropna()
    for (symbol, fold), group in data[data.symbol.isin(["A", "B"])].groupby(["symbol", "fold"]):
        group = group.sort_values("Date")
        train, test = group[group.role == "train"], group[group.role == "test"]
        for family in T.FAMILIES:
            own = got[(got.symbol == symbol) & (got.fold == fold) & (got.model == family)].sort_values("Date")
            want = T.fit_group(train, test, ["a", "b", "c"], "target", family, T.group_seed(symbol, fold))
            assert own.y_pred.tolist() == pytest.approx(want.tolist()) and own.y_true.tolist() == pytest.approx(test.target.tolist()) and (own.n_train == 150).all()
    # dates of a fold are the same for every family, and each family beats the mean
    fitted = got[got.status == "fitted"].copy()
    assert fitted.groupby(["symbol", "fold", "Date"]).model.nunique().eq(len(T.FAMILIES)).all()
    error = ((fitted.y_pred - fitted.y_true) ** 2).groupby(fitted.model).mean()
    assert (error.drop("naive_mean") < 0.7 * error["naive_mean"]).all()


def test_linear_families():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(80, 4)) + 3, r.normal(size=80)
    design = np.column_stack([np.ones(80), x])
    w = np.linalg.solve(design.T @ design + np.diag([0, 2, 2, 2, 2]), design.T @ y)
    assert T.ridge(x, y, 2.0)(x[:5]) == pytest.approx(design[:5] @ w)
    # the elastic net's weights satisfy its optimality conditions
    alpha, l1 = 0.05, 0.5
    fit = T.elastic_net(x, y, alpha, l1)
    w = np.array([fit(np.eye(4)[j : j + 1])[0] - fit(np.zeros((1, 4)))[0] for j in range(4)])
    slope = (x - x.mean(0)).T @ (y - fit(x)) / 80 - alpha * (1 - l1) * w
    assert all(abs(g - alpha * l1 * np.sign(v)) < 1e-8 if abs(v) > 1e-12 else abs(g) <= alpha * l1 + 1e-8 for g, v in zip(slope, w, strict=True))
    assert (np.abs(w) < 1e-12).any()


def test_a_tree_takes_the_best_split():
    r = np.random.default_rng(2)
    for _ in range(20):
        x = r.integers(0, 9, (60, 3)).astype(float)
        y = r.normal(size=60) + (x[:, 1] > 4)
        edges = T.bin_edges(x)
        b = T.binned(x, edges)
        feature, cut, value = T.grow(b, y, 1)
        best = min(
            ((y[x[:, j] <= t] - y[x[:, j] <= t].mean()) ** 2).sum() + ((y[x[:, j] > t] - y[x[:, j] > t].mean()) ** 2).sum()
            for j in range(3) for t in range(9) if min((x[:, j] <= t).sum(), (x[:, j] > t).sum()) >= T.LEAF
        )
        assert ((y - T.leaf_values((feature, cut, value), b)) ** 2).sum() == pytest.approx(best)
    deep = T.grow(b, y, 4)
    assert ((y - T.leaf_values(deep, b)) ** 2).sum() < best
    flat = T.grow(b, np.ones(60), 3)
    assert (flat[0] == -1).all() and (T.leaf_values(flat, b) == 1).all()


@pytest.mark.parametrize("kind", ["dlinear", "nlinear"])
def test_linear_sequences_equal_numpy(spark, kind):
    r = np.random.default_rng(7)
    rows = [(s, datetime.date(2021, 1, 1) + datetime.timedelta(days=k), *map(float, r.normal(size=2)), float(r.normal())) for s in "AB" for k in range(50)]
    df = spark.createDataFrame(rows, "symbol string, Date date, u double, v double, target double").repartition(5)
    design = T.sequence_design(df, ["u", "v"], 6, kind)
    x, y = [], []
    for s in "AB":
        own = np.array([t[2:4] for t in rows if t[0] == s])
        for k in range(5, 50):
            window = own[k - 5 : k + 1]
            level = window.mean(0) if kind == "dlinear" else window[-1]
            x.append(np.concatenate([(window - level).ravel(), level]))
            y.append([t[4] for t in rows if t[0] == s][k])
    x, y = np.array(x), np.array(y)
    assert design.count() == len(x)
    w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + np.eye(x.shape[1]), (x - x.mean(0)).T @ (y - y.mean()))
    model = T.fit_sequence(design, kind)
    assert np.array(model.weights) == pytest.approx(w, abs=1e-9) and model.intercept == pytest.approx(y.mean() - x.mean(0) @ w, abs=1e-9)
    got = sorted(t[0] for t in design.select(model.column()).collect())
    assert got == pytest.approx(sorted((x @ w + y.mean() - x.mean(0) @ w).tolist()), abs=1e-9)
    by = {t["symbol"]: T.solve_ridge(t["sums"])[0] for t in T.normal_equations(design, "x", "target", ["symbol"]).collect()}
    a = x[:45]
    assert by["A"] == pytest.approx(np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + np.eye(a.shape[1]), (a - a.mean(0)).T @ (y[:45] - y[:45].mean())), abs=1e-9)
    assert T.normal_equations(design.limit(0), "x", "target").count() == 0


def test_blends_equal_a_plain_computation(spark):
    r = np.random.default_rng(3)
    names, cats = ["m1", "m2", "m3"], {"m1": "linear", "m2": "linear"}
    rows, want = [], {}
    for s in ("A", "B"):
        n = 40
        y = r.normal(0, 0.02, n)
        pred = {m: 0.3 * y * (k if s == "A" else -1) + r.normal(0, 0.01, n) for k, m in enumerate(names)}
        before = 50 * np.exp(np.cumsum(r.normal(0, 0.02, n)))
        price = {m: before * np.exp(p) for m, p in pred.items()}
        actual = before * np.exp(y)
        days = [datetime.date(2022, 1, 1) + datetime.timedelta(days=k) for k in range(n)]
        for m in names:
            rows += [(s, days[k], m, float(pred[m][k]), float(price[m][k]), float(y[k]), float(actual[k]), float(before[k])) for k in range(n)]
        norm = lambda v: {m: x / sum(v.values()) if sum(v.values()) > 0 else 1 / 3 for m, x in v.items()}
        pnl = {m: np.sign(pred[m]) * y for m in names}
        x = np.column_stack([pred[m] for m in names])
        coef = np.maximum(np.linalg.solve(x.T @ x + np.eye(3), x.T @ y), 0)
        weights = {
            "equal": dict.fromkeys(names, 1 / 3), "inverse_rmse": norm({m: 1 / np.sqrt(((price[m] - actual) ** 2).mean()) for m in names}),
            "sharpe": norm({m: max(pnl[m].mean() / pnl[m].std(ddof=1), 0) for m in names}), "risk_parity": norm({m: 1 / pnl[m].std(ddof=1) for m in names}),
            "hierarchical": {"m1": 0.25, "m2": 0.25, "m3": 0.5}, "stacker": norm(dict(zip(names, coef, strict=True))),
        }
        for blend, w in weights.items():
            for k in range(n):
                want[s, days[k], blend] = (sum(w[m] * pred[m][k] for m in names), sum(w[m] * price[m][k] for m in names))
        for k in range(n):
            agree = max(sum(pred[m][k] > 0 for m in names), sum(pred[m][k] < 0 for m in names)) / 3
            t = want[s, days[k], "sharpe"][0] if agree >= 0.7 else 0.0
            want[s, days[k], "cash_gated"] = (t, before[k] * np.exp(t))
    rows.append(("A", datetime.date(2030, 1, 1), "m1", 0.5, 1.0, 0.1, 1.0, 1.0))  # not all models have it: kept from the blends
    schema = "symbol string, Date date, model string, target_pred double, price_pred double, y_target double, y_price double, prev_close double"
    df = spark.createDataFrame([x for x in rows if x[1].year < 2030], schema)
    kinds = spark.createDataFrame(list(cats.items()), "model string, category string")
    got = {(x["symbol"], x["Date"], x["blend"]): (x["target_pred"], x["price_pred"]) for x in T.blend_all(df, kinds, least_agreement=0.7).collect()}
    assert got.keys() == want.keys() and {k[2] for k in got} == set(T.BLENDS)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12), k
    more = T.blend_all(spark.createDataFrame(rows, schema), kinds)
    assert more.where("Date > '2025-01-01'").count() == 0


def test_attributions_equal_a_plain_loop(spark):
    from pyspark.ml.feature import VectorAssembler

    from tidemark.operators.ensembles import estimators

    r = np.random.default_rng(9)
    x = r.normal(size=(150, 3))
    rows = spark.createDataFrame([(f"S{k % 4}", k, *map(float, v), float(v[0] * 2 - v[1] ** 2)) for k, v in enumerate(x)], "symbol string, Date int, a double, b double, c double, target double")
    fitted = estimators()["boosting"]().fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows))
    tree = TreeModel.of(fitted, ["a", "b", "c"])
    for predict in (tree.predict, lambda z: z @ np.array([1.0, 2.0, -3.0])):
        got = {(t["Date"], t["feature"]): t["contribution"] for t in T.replaced_means(rows.repartition(3), ["a", "b", "c"], predict).collect()}
        for k, f in enumerate("abc"):
            moved = x.copy()
            moved[:, k] = x[:, k].mean()
            want = predict(x) - predict(moved)
            assert [got[i, f] for i in range(150)] == pytest.approx(want.tolist(), abs=1e-9)
    assert T.replaced_means(rows.withColumn("a", F.lit(None).cast("double")), ["a", "b"], lambda z: z[:, 0]).count() == 0
