import hashlib
import math

import numpy as np
import pytest

from lexiprobe.llm import elkan_kmeans as ek

from ..oracle import connect, rows_of, sql_rows


def naive(rows, k, rounds, dims, scale=256.0):
    """Plain rounds over Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, y)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs)]
    got = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, j in got:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in got), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_its_sql(spark, sf):
    assert rows_of(ek.op11_centroids(spark, sf)) == sql_rows(connect(sf), ek.OP11_SQL)


ODD = [
    (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.5]), (5, [0.5, None]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (None, [-0.25, 1.0]), (None, [0.0, 0.0]),
    (8, [-0.001, 0.001]), (9, []), (10, [1e4, -1e4]), (11, [0.25, 0.75]), (11, [0.75, 0.25]),
]


@pytest.mark.parametrize("k", [1, 3, 40])
def test_messy_vectors(spark, k):
    df = spark.createDataFrame([(i, v, 1, b"x", 0.0) for i, v in ODD], "vec_id long, embedding array<double>, cluster int, x binary, upper double")
    assert result(ek.cluster(df, k=k, dims=2)) == naive(ODD, k, 5, 2)
    assert ek.cluster(df.where("vec_id = 3"), dims=2).count() == 0
    assert ek.cluster(df.where("false"), dims=2).columns == ek.cluster(df, dims=2).columns


@pytest.mark.parametrize("seed", range(3))
def test_many_ties(spark, seed):
    """Vectors on a small grid: most distances are tied."""
    draw = np.random.default_rng(seed)
    rows = [(i, (draw.integers(-3, 4, 3) / 256).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert result(ek.cluster(df, k=12, dims=3)) == naive(rows, 12, 5, 3)


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        ek.cluster(df, dims=2).count()


def test_bounds_save_distances_and_lose_none():
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.normal(m, 20, (300, 8)) for m in range(-600, 600, 120)]).astype(np.int64)
    c = x[draw.permutation(len(x))[:20]].copy()
    cluster, upper, lower = ek.Bounds(c).first(x)
    for _ in range(6):
        before = c
        c = np.stack([x[cluster == j].sum(0) // max((cluster == j).sum(), 1) if (cluster == j).any() else c[j] for j in range(20)])
        cluster, upper, lower, computed = ek.Bounds(c, before).next(x, cluster, upper, lower)
        exact = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (cluster == exact.argmin(1)).all()
        assert (upper >= np.sqrt(exact.min(1))).all() and (lower <= np.sqrt(exact)).all()
    assert computed < len(x) * 20 // 4
