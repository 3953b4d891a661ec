"""Linear models of many cells against closed forms and optimality conditions."""

import numpy as np
import pytest

from lexiprobe.operators import linear


def table(spark, seed=0, n=120, d=6):
    draw = np.random.default_rng(seed)
    x = np.where(draw.random((n, d)) < 0.6, draw.normal(size=(n, d)), 0.0)
    group = np.array(["a", "b", "c"])[draw.integers(0, 3, n)]
    y = x @ draw.normal(size=(d, 2)) + draw.normal(size=(n, 2)) + 1.0
    y[draw.random((n, 2)) < 0.1] = np.nan
    entries = [(i, j, float(x[i, j])) for i in range(n) for j in range(d) if x[i, j]]
    labels = [(i, str(group[i]), *[None if np.isnan(v) else float(v) for v in y[i]], *[None if np.isnan(v) else int(v > 1) for v in y[i]]) for i in range(n)]
    frame = spark.createDataFrame(labels, "doc_id long, language string, y0 double, y1 double, c0 int, c1 int")
    return x, group, y, spark.createDataFrame(entries, "doc_id long, feature int, value double"), frame


def test_ridge_equals_the_closed_form(spark):
    x, group, y, entries, labels = table(spark)
    rows = linear.Rows(entries, labels, ["y0", "y1"], "language")
    got = linear.ridge(rows, alpha=2.0)
    for g in "abc":
        for k, c in enumerate(("y0", "y1")):
            m = (group == g) & ~np.isnan(y[:, k])
            a = np.concatenate([x[m], np.ones((m.sum(), 1))], axis=1)
            want = np.linalg.solve(a.T @ a + np.diag([2.0] * x.shape[1] + [0.0]), a.T @ y[m, k])
            w, b = got.of(c, g)
            assert np.allclose([*w, b], want, atol=1e-7)
    alone = linear.ridge(linear.Rows(entries, labels.where("language = 'a'"), ["y0"], "language"), alpha=2.0)
    assert got.passes <= alone.passes + 12  # cells share their passes


@pytest.mark.parametrize("penalty", ["l2", "l1"])
def test_logistic_meets_its_optimality_conditions(spark, penalty):
    x, group, y, entries, labels = table(spark, 1)
    got = linear.logistic(linear.Rows(entries, labels, ["c0", "c1"], "language"), c=0.7, penalty=penalty)
    for g in "abc":
        for k, c in enumerate(("c0", "c1")):
            m = (group == g) & ~np.isnan(y[:, k])
            a = np.concatenate([x[m], np.ones((m.sum(), 1))], axis=1)
            w = np.append(*got.of(c, g))
            gradient = 0.7 * a.T @ (1 / (1 + np.exp(-a @ w)) - (y[m, k] > 1))
            if penalty == "l2":
                assert np.abs(gradient + w).max() < 1e-4
            else:
                assert np.abs(gradient[w != 0] + np.sign(w[w != 0])).max(initial=0) < 1e-4 and (np.abs(gradient[w == 0]) <= 1 + 1e-6).all()
    if penalty == "l1":
        assert (got.w == 0).any()
    with pytest.raises(ValueError, match="unknown penalty"):
        linear.logistic(linear.Rows(entries, labels, ["c0"]), penalty="elastic")


def test_every_row_under_every_model(spark):
    x, group, y, entries, labels = table(spark, 2)
    got = linear.ridge(linear.Rows(entries, labels, ["y0", "y1"], "language"))
    margins = {(r["doc_id"], r["group"], r["label"]): r["margin"] for r in got.margins(labels, entries).collect()}
    assert len(margins) == len(x) * 6
    for g in "abc":
        w, b = got.of("y1", g)
        assert np.allclose([margins[i, g, "y1"] for i in range(len(x))], x @ w + b)


def test_odd_tables(spark):
    _, _, _, entries, labels = table(spark, 3)
    none = linear.Rows(entries, labels.where("false"), ["y0"], "language")
    assert linear.ridge(none).w.size == 0 and linear.logistic(none).w.size == 0
    bare = linear.ridge(linear.Rows(entries.where("false"), labels, ["y0"]))  # no features: the mean
    assert np.isclose(bare.of("y0")[1], labels.agg({"y0": "avg"}).first()[0])
    with pytest.raises(ValueError, match="fewer cells"):
        linear.Rows(entries, labels, ["y0"], "language", max_weights=5)
