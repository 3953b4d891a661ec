"""Boosted trees against a plain loop over small tables."""

import math
import random

import pytest

from lexiprobe.operators import boosting


def loop(rows, entries, classify, p):
    """Exact greedy boosting: every value of every feature is tried, missing values on both sides."""
    x = {k: {} for k, _ in rows}
    for k, f, v in entries:
        x[k][f] = v
    mean = sum(y for _, y in rows) / len(rows)
    base = math.log(mean / (1 - mean)) if classify else mean
    margin = {k: base for k, _ in rows}
    y = dict(rows)
    trees = []

    def score(ks, g, h):
        return sum(g[k] for k in ks) ** 2 / (sum(h[k] for k in ks) + p.reg_lambda)

    def grow(ks, g, h, depth):
        leaf = -p.eta * sum(g[k] for k in ks) / (sum(h[k] for k in ks) + p.reg_lambda)
        best = None
        for f in sorted({f for k in ks for f in x[k]}) if depth else ():
            for v in sorted({x[k][f] for k in ks if f in x[k]}):
                for missing_left in (False, True):
                    left = [k for k in ks if (x[k][f] <= v if f in x[k] else missing_left)]
                    right = [k for k in ks if k not in set(left)]
                    if not left or not right or sum(h[k] for k in left) < p.min_child_weight or sum(h[k] for k in right) < p.min_child_weight:
                        continue
                    gain = score(left, g, h) + score(right, g, h) - score(ks, g, h)
                    if gain > 1e-8 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, v, missing_left, left, right
        if best is None:
            return leaf
        _, f, v, missing_left, left, right = best
        return f, v, missing_left, grow(left, g, h, depth - 1), grow(right, g, h, depth - 1)

    def walk(tree, k):
        while isinstance(tree, tuple):
            f, v, missing_left, left, right = tree
            tree = left if (x[k][f] <= v if f in x[k] else missing_left) else right
        return tree

    losses = []
    for _ in range(p.rounds):
        q = {k: 1 / (1 + math.exp(-m)) for k, m in margin.items()}
        g = {k: q[k] - y[k] if classify else margin[k] - y[k] for k in margin}
        h = {k: q[k] * (1 - q[k]) if classify else 1.0 for k in margin}
        trees.append(tree := grow(list(margin), g, h, p.depth))
        margin = {k: m + walk(tree, k) for k, m in margin.items()}
        losses.append(sum(math.log1p(math.exp(-abs(m))) + max(m, 0) - y[k] * m if classify else (y[k] - m) ** 2 for k, m in margin.items()) / len(rows))
    return margin, losses


def table(seed, n=60, features=5):
    draw = random.Random(seed)
    entries = [(k, f, round(draw.gauss(0, 1), 3)) for k in range(n) for f in range(features) if draw.random() < 0.6]
    score = {k: 0.0 for k in range(n)}
    for k, f, v in entries:
        score[k] += v * (f - 2)
    return entries, [(k, round(s + draw.gauss(0, 0.3), 3)) for k, s in score.items()]


@pytest.mark.parametrize("classify", [False, True])
def test_equals_a_plain_loop(spark, classify):
    p = boosting.Parameters(rounds=3, depth=3, eta=0.3, reg_lambda=1.5)
    cells, entries = [], []
    want = {}
    for c in ("a", "b"):
        e, rows = table(c)
        rows = [(k, float(v > 0)) if classify else (k, v) for k, v in rows]
        shift = 1000 * (c == "b")
        entries += [(k + shift, f, v) for k, f, v in e]
        cells += [(k + shift, c, v) for k, v in rows]
        want[c] = loop(rows, e, classify, p)
    frame = spark.createDataFrame(entries, "doc_id long, feature int, value double")
    labels = spark.createDataFrame(cells, "doc_id long, cell string, label double")
    model = boosting.fit(frame, labels, classify, p, cell="cell")
    got = {r["doc_id"]: r for r in model.predict(labels, frame, cell="cell").collect()}
    for c, shift in (("a", 0), ("b", 1000)):
        for k, m in want[c][0].items():
            assert math.isclose(got[k + shift]["probability"] if classify else got[k + shift]["prediction"], 1 / (1 + math.exp(-m)) if classify else m, abs_tol=1e-7)
    curve = {(r["cell"], r["round"]): r["loss"] for r in model.curve(labels, frame, cell="cell", by=("cell",)).collect()}
    for c in ("a", "b"):
        for t, loss in enumerate(want[c][1]):
            assert math.isclose(curve[c, t + 1], loss, abs_tol=1e-7)


def test_columns_and_rows_are_drawn_once_a_tree(spark, tmp_path):
    e, rows = table(5, 80, 10)
    frame, labels = spark.createDataFrame(e, "doc_id long, feature int, value double"), spark.createDataFrame(rows, "doc_id long, label double")
    p = boosting.Parameters(rounds=4, depth=3, subsample=0.7, colsample=0.3)
    model = boosting.fit(frame, labels, False, p)
    for tree in model.trees.first()["trees"]:
        assert 0 < len({f for f in tree["feature"] if f >= 0}) <= 3
    again = boosting.fit(frame, labels, False, p)
    assert again.trees.collect() == model.trees.collect()
    assert model.importances().agg({"splits": "sum"}).first()[0] == sum(f >= 0 for t in model.trees.first()["trees"] for f in t["feature"])
    model.save(str(tmp_path / "model"))
    loaded = boosting.Model.load(spark, str(tmp_path / "model"))
    key = lambda m: sorted(map(tuple, m.predict(labels, frame).collect()))
    assert key(loaded) == key(model)


def test_bins_are_quantiles_where_values_are_many(spark):
    e = [(k, 0, float(k)) for k in range(1000)]
    frame, labels = spark.createDataFrame(e, "doc_id long, feature int, value double"), spark.createDataFrame([(k, float(k >= 500)) for k, _, _ in e], "doc_id long, label double")
    edges = boosting.bin_edges(frame, 16).first()["edges"]
    assert len(edges) == 16 and edges[-1] == 999.0
    model = boosting.fit(frame, labels, True, boosting.Parameters(rounds=1, depth=1, bins=16))
    tree = model.trees.first()["trees"][0]
    assert tree["feature"][1] == 0 and 430 < tree["cut"][1] < 570


def test_odd_tables(spark):
    """Rows without features, without labels, one class, nothing at all."""
    frame = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0), (3, 0, None), (9, 0, 1.0)], "doc_id long, feature int, value double")
    labels = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0), (5, None)], "doc_id long, label double")
    model = boosting.fit(frame, labels, True, boosting.Parameters(rounds=2, depth=2))
    got = model.predict(labels, frame).collect()
    assert len(got) == 5 and all(r["prediction"] == 1.0 for r in got)
    empty = boosting.fit(frame, labels.where("false"), False)
    assert [r["prediction"] for r in empty.predict(labels, frame).collect()] == [None] * 5
