"""Forests without a depth limit."""

import numpy as np
import pytest

from lexiprobe.operators import forest


def frames(spark, x, y):
    entries = [(i, j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v]
    return spark.createDataFrame(entries or [(0, 0, 0.0)], "doc_id long, feature int, value double"), spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "doc_id long, label double")


def shown(df, column="prediction"):
    return [r[column] for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("small", [1000, 64])
def test_a_table_that_needs_depth_sixty_is_fitted_to_purity(spark, small):
    """Labels alternate along one feature whose best cut is always the outermost one."""
    y = [float(i % 2) * 4.0**i for i in range(70)]
    entries, labels = frames(spark, [[i + 1.0] for i in range(70)], y)
    model = forest.fit(entries, labels, False, forest.Parameters(trees=1, bootstrap=False, small=small, bins=256))
    assert np.allclose(shown(model.predict(labels, entries)), y, rtol=1e-12)

    def depth(packed):
        feature, _, left, _ = forest.pickle.loads(packed)
        down = {0: 0}
        for node in range(len(feature)):
            if feature[node] >= 0:
                down[int(left[node])] = down[int(left[node]) + 1] = down[node] + 1
        return max(down.values())

    deepest = max(depth(r["packed"]) for r in model.subtrees.collect()) + len(model.levels)
    assert deepest > 30 and (small == 1000 or model.levels)


@pytest.mark.parametrize(("classify", "small"), [(True, 10_000), (False, 40)])
def test_pure_trees_give_back_their_labels(spark, classify, small, tmp_path):
    draw = np.random.default_rng(small)
    x = np.where(draw.random((120, 6)) < 0.5, draw.normal(size=(120, 6)).round(2), 0.0)
    score = x[:, 0] - x[:, 1] * x[:, 2] + 0.1 * draw.normal(size=120)
    y = (score > 0).astype(float) if classify else score
    _, first = np.unique(x, axis=0, return_inverse=True)
    keep = np.unique(first, return_index=True)[1]  # equal rows can't be told apart
    x, y = x[keep], y[keep]
    entries, labels = frames(spark, x, y)
    model = forest.fit(entries, labels, classify, forest.Parameters(trees=2, bootstrap=False, small=small))
    assert np.allclose(shown(model.predict(labels, entries)), y)
    assert bool(model.levels) == (small == 40)
    drawn = forest.fit(entries, labels, classify, forest.Parameters(trees=5, small=small))
    got = shown(drawn.predict(labels, entries))
    assert np.mean((np.array(got) > 0.5) == (y > 0.5)) > 0.8
    drawn.save(str(tmp_path / "forest"))
    assert shown(forest.Model.load(spark, str(tmp_path / "forest")).predict(labels, entries)) == got
    assert drawn.importances().count() > 1


def test_odd_tables(spark):
    entries, labels = frames(spark, [[1.0], [1.0], [0.0]], [0, 1, 1])
    model = forest.fit(entries, labels, True, forest.Parameters(trees=2, bootstrap=False, small=1))  # rows that nothing divides
    assert shown(model.predict(labels, entries), "probability") == [0.5, 0.5, 1.0]
    none = forest.fit(entries, labels.where("false"), False, forest.Parameters(trees=2))
    assert shown(none.predict(labels, entries)) == [None] * 3
    with pytest.raises(ValueError, match="0 and 1"):
        forest.fit(entries, labels.withColumn("label", labels["label"] * 3), True)


def test_a_node_goes_through_its_own_rows_only(monkeypatch):
    """Work a node is in proportion to its rows; blocks of any width, and rows as a matrix or not, give the same tree."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, 7)).round(1), rng.integers(0, 5, 400).astype(float)
    full = [np.arange(7)] * 400, list(x)
    sparse = [np.flatnonzero(r) for r in x], [r[r != 0] for r in x]
    seen, columns = [], forest.Grown._columns

    def counted(self, rows, features):
        for some, block in columns(self, rows, features):
            seen.append((len(rows), block.shape))
            yield some, block

    monkeypatch.setattr(forest.Grown, "_columns", counted)
    trees = []
    for f, v in (full, sparse):
        for cells in (1, 1000, 1 << 21):
            monkeypatch.setattr(forest, "_CELLS", cells)
            trees.append(forest.Grown(f, v, y, np.ones(400), 1.0, [1]).packed())
    assert len(set(trees)) == 1
    assert all(shape[0] == n and shape[1] <= 7 for n, shape in seen)


def test_nodes_of_rows_meet_entries_without_a_broadcast(spark, monkeypatch):
    """Files of nodes are small for their rows, so joins chosen by file size would bring all rows of all trees to the driver."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3)).round(2)
    entries, labels = frames(spark, x, x[:, 0] - x[:, 1])
    plans, keep = {}, forest.Scratch.keep

    def kept(self, df, table):
        plans[table] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, table)

    monkeypatch.setattr(forest.Scratch, "keep", kept)
    model = forest.fit(entries, labels, False, forest.Parameters(trees=2, small=25))
    assert len(model.levels) > 1
    for table in ("at-2", "subtrees"):
        assert "SortMergeJoin [row#" in plans[table] and "BroadcastHashJoin [row#" not in plans[table]
