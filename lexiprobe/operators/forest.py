"""Random forests of any depth: large nodes are split by histograms, small ones grown to purity in their task.

Features are (doc_id, feature, value) rows; what a row lacks is zero. Each tree has its own bootstrap,
Poisson counts drawn by the hash of row and tree. While a node holds more than ``small`` rows, one
aggregate a level sums labels by (tree, node, feature, bin) for all such nodes of all trees; absent
entries are the node's total less what is there. A node of at most ``small`` rows goes, with its rows,
to one task, which grows the rest of the tree exactly. So no task holds more than that, and depth has
no limit. Trees are tables: splits of the large nodes, and one row a grown subtree. Rows' nodes are a
few bits each in files but as many rows as all trees draw, so they meet the entries by a merge join only:
a broadcast, which goes by file size, would bring them all to the driver.

Splits minimise squared error, which for labels 0 and 1 is the Gini impurity. Each node tries a share
of the features drawn by its own hash, and all of them where none of those divides it. Ties fall to
the smaller feature and the smaller cut. A prediction is the mean of the trees' leaves.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .boosting import bin_edges
from .groups import per_group

#: Shares of rows that are drawn at most 0, 1, 2, ... times.
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
_SPLIT = "tree int, node long, feature int, cut double, left long"
#: Rows that meet one subtree in one task when predicting, about.
_MEET = 100_000
#: Values that are sorted at once when a node of a subtree is split, about.
_CELLS = 1 << 21


@dataclass(frozen=True)
class Parameters:
    trees: int = 100
    share: float | None = None  # of the features tried in a node; none: the square root of their number for classes, all for values
    bootstrap: bool = True
    small: int = 50_000
    bins: int = 64
    seed: int = 42


def _rows(entries: DataFrame, rows: DataFrame, key: str, *columns: Column | str) -> DataFrame:
    """Rows with their entries as two arrays."""
    sparse = entries.where("value IS NOT NULL AND value != 0").groupBy(F.col(key).alias("__k")).agg(F.sort_array(F.collect_list(F.struct(F.col("feature").cast("int").alias("f"), F.col("value").cast("double").alias("v")))).alias("e"))
    e = F.coalesce("e", F.expr("CAST(array() AS array<struct<f:int,v:double>>)"))
    return rows.join(sparse, F.col(key).eqNullSafe(F.col("__k")), "left").select(*columns, F.transform(e, lambda x: x["f"]).alias("f"), F.transform(e, lambda x: x["v"]).alias("v"))


def _value(feature: Column) -> Column:
    at = F.array_position("f", feature)
    return F.when(at > 0, F.get("v", (at - 1).cast("int"))).otherwise(0.0)


def _chance(*of: Column | str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / float(1 << 30)


def _step(at: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows (tree, node, f, v and others) one level down, where their node is split."""
    joined = at.join(per_group(splits), ["tree", "node"], "left")
    down = F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.col("left") + (_value(F.col("feature")) > F.col("cut")).cast("long"))
    return joined.withColumn("node", down).drop("feature", "cut", "left")


def _binned(base: DataFrame, edges: DataFrame) -> DataFrame:
    """``base`` with its entries' bins as an array; a negative value's is -1 less its bin."""
    entries = base.select(F.col("row").alias("__r"), F.explode(F.arrays_zip("f", "v")).alias("e")).select("__r", F.col("e.f").alias("feature"), F.col("e.v").alias("v"))
    under = F.size(F.filter("edges", lambda c: c < F.col("v")))
    binned = entries.join(per_group(edges), "feature").select("__r", F.struct("feature", F.when(F.col("v") < 0, -1 - under).otherwise(under).alias("b")).alias("e"))
    sparse = binned.groupBy("__r").agg(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["b"]).alias("b"))
    return base.join(sparse.hint("merge"), F.col("row") == F.col("__r"), "left").select(*base.columns, F.coalesce("b", F.expr("CAST(array() AS array<int>)")).alias("b"))


class Grown:
    """A subtree as arrays: feature (-1: a leaf), cut, left child (the right one follows), value."""

    def __init__(self, f: list[np.ndarray], v: list[np.ndarray], y: np.ndarray, w: np.ndarray, share: float, seed: list[int]):
        flat, values = np.concatenate([np.zeros(0, np.int64), *f]).astype(np.int64), np.concatenate([np.zeros(0), *v])
        self.features, self.column = np.unique(flat, return_inverse=True)
        self.values, self.n = values, np.array([len(x) for x in f], np.int64)
        self.start = np.cumsum(self.n) - self.n
        # Rows that hold every feature are a matrix already.
        self.matrix = values.reshape(len(y), -1) if len(self.features) and (self.n == len(self.features)).all() and (self.column.reshape(len(y), -1) == np.arange(len(self.features))).all() else None
        self.y, self.w, self.share, self.draw = y, w, share, np.random.default_rng(seed)
        self.feature, self.cut, self.left, self.value = [], [], [], []
        self._grow()

    def _columns(self, rows: np.ndarray, features: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of features, values by row and feature) in blocks, of those features that the rows hold; only the rows' own entries are gone through."""
        width = max(1, _CELLS // len(rows))
        if self.matrix is not None:
            mine = self.matrix[rows]
            for at in range(0, len(features), width):
                yield features[at : at + width], mine if len(features) == mine.shape[1] <= width else mine[:, features[at : at + width]]
            return
        n = self.n[rows]
        entry = np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row, column, values = np.repeat(np.arange(len(rows)), n), self.column[entry], self.values[entry]
        held = np.intersect1d(column, features)
        order = np.argsort(column, kind="stable")
        row, column, values = row[order], column[order], values[order]
        for at in range(0, len(held), width):
            some = held[at : at + width]
            lo, hi = np.searchsorted(column, some[0]), np.searchsorted(column, some[-1], "right")
            place = np.minimum(np.searchsorted(some, column[lo:hi]), len(some) - 1)
            hit = some[place] == column[lo:hi]
            out = np.zeros((len(rows), len(some)))
            out[row[lo:hi][hit], place[hit]] = values[lo:hi][hit]
            yield some, out

    def _best(self, rows: np.ndarray, features: np.ndarray) -> tuple | None:
        y, w = self.y[rows], self.w[rows]
        wy = w * y
        total_w, total = w.sum(), wy.sum()
        best = None
        for some, x in self._columns(rows, features):
            order = np.argsort(x, axis=0, kind="stable")
            s = np.take_along_axis(x, order, 0)
            ends = s[1:] > s[:-1]
            up_w, up = np.cumsum(w[order], axis=0)[:-1], np.cumsum(wy[order], axis=0)[:-1]
            score = np.where(ends, up * up / up_w + (total - up) ** 2 / np.where(ends, total_w - up_w, 1.0), -np.inf)
            at = score.argmax(0)
            for j, (found, i) in enumerate(zip(score[at, np.arange(len(some))].tolist(), at.tolist())):
                if found > -np.inf and (best is None or found > best[0] + 1e-12 * abs(best[0])):
                    best = found, int(self.features[some[j]]), float((s[i, j] + s[i + 1, j]) / 2), x[:, j].copy()
        return best

    def _grow(self) -> None:
        def add() -> int:
            for a, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.value, 0.0)):
                a.append(v)
            return len(self.feature) - 1

        every = np.arange(len(self.features))
        waiting = [(add(), np.arange(len(self.y)))]
        while waiting:
            node, rows = waiting.pop()
            y, w = self.y[rows], self.w[rows]
            self.value[node] = float((w * y).sum() / w.sum())
            if len(rows) < 2 or y.min() == y.max():
                continue
            some = np.flatnonzero(self.draw.random(len(self.features)) < self.share) if self.share < 1 else every
            best = self._best(rows, some)
            if best is None and self.share < 1:
                best = self._best(rows, every)
            if best is None:
                continue
            _, self.feature[node], self.cut[node], x = best
            self.left[node] = add()
            add()
            below = x <= self.cut[node]
            waiting += [(self.left[node], rows[below]), (self.left[node] + 1, rows[~below])]

    def packed(self) -> bytes:
        return pickle.dumps((np.array(self.feature, np.int32), np.array(self.cut), np.array(self.left, np.int64), np.array(self.value)))


def _walk(packed: bytes, f: list[np.ndarray], v: list[np.ndarray]) -> np.ndarray:
    """The leaf's value for each row; all rows go down together."""
    feature, cut, left, value = pickle.loads(packed)
    owner = np.repeat(np.arange(len(f)), [len(x) for x in f])
    flat, values = np.concatenate([np.zeros(0, np.int64), *f]).astype(np.int64), np.concatenate([np.zeros(0), *v])
    width = int(max(flat.max(initial=0), feature.max(initial=0))) + 1
    keys = owner * width + flat  # sorted: features of a row are
    at = np.zeros(len(f), np.int64)
    live = np.flatnonzero(feature[at] >= 0)
    while len(live):
        want = live * width + feature[at[live]]
        place = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        x = np.where(keys[place] == want, values[place], 0.0) if len(keys) else np.zeros(len(live))
        at[live] = left[at[live]] + (x > cut[at[live]])
        live = live[feature[at[live]] >= 0]
    return value[at]


class Model:
    """``levels``: the splits of large nodes by level; ``subtrees``: (tree, node, packed)."""

    def __init__(self, levels: list[DataFrame], subtrees: DataFrame, classify: bool, trees: int):
        self.levels, self.subtrees, self.classify, self.trees = levels, subtrees, classify, trees

    def predict(self, rows: DataFrame, entries: DataFrame, key: str = "doc_id") -> DataFrame:
        """``rows`` with prediction, and for classes the probability of class 1."""
        scratch = Scratch(rows.sparkSession, "forest-predict")
        named = scratch.keep(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
        at = scratch.keep(_rows(entries, named, key, F.col("__row").alias("row")), "arrays").select("*", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree")).withColumn("node", F.lit(0).cast("long"))
        for level in self.levels:
            at = _step(at, level)
        salts = max(1, -(-named.count() // _MEET))
        at = at.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
        held = self.subtrees.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"row": pd.Series([], dtype="int64"), "value": pd.Series([], dtype="float64")})
            return pd.DataFrame({"row": left["row"], "value": _walk(right["packed"].iloc[0], left["f"].tolist(), left["v"].tolist())})

        keys = ("tree", "node", "salt")
        leaves = at.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(meet, "row long, value double")
        mean = leaves.groupBy("row").agg(F.avg("value").alias("__mean"))
        out = named.join(mean, F.col("__row") == F.col("row"), "left").drop("row", "__row")
        if not self.classify:
            return out.withColumnRenamed("__mean", "prediction")
        return out.withColumn("prediction", (F.col("__mean") > 0.5).cast("double")).withColumnRenamed("__mean", "probability")

    def importances(self) -> DataFrame:
        """(feature, splits): how many splits of all trees use a feature."""

        def used(batches):
            for pdf in batches:
                features = [f for packed in pdf["packed"] for f in pickle.loads(packed)[0].tolist() if f >= 0]
                yield pd.DataFrame({"feature": pd.Series(features, dtype="int32")})

        out = self.subtrees.select("packed").mapInPandas(used, "feature int")
        for level in self.levels:
            out = out.unionByName(level.select("feature"))
        return out.groupBy("feature").agg(F.count("*").alias("splits"))

    def save(self, path: str) -> None:
        self.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")
        spark = self.subtrees.sparkSession
        rows = spark.createDataFrame([], f"level int, {_SPLIT}")
        for k, level in enumerate(self.levels):
            rows = rows.unionByName(level.select(F.lit(k).alias("level"), *level.columns))
        rows.write.mode("overwrite").parquet(f"{path}/splits")
        spark.createDataFrame([(len(self.levels), self.classify, self.trees)], "levels int, classify boolean, trees int").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        about, splits = spark.read.parquet(f"{path}/about").first(), spark.read.parquet(f"{path}/splits")
        return cls([splits.where(F.col("level") == k).drop("level") for k in range(about["levels"])], spark.read.parquet(f"{path}/subtrees"), about["classify"], about["trees"])


def fit(entries: DataFrame, labels: DataFrame, classify: bool, p: Parameters = Parameters(), key: str = "doc_id") -> Model:
    """A forest on ``labels`` (key, label) and their ``entries`` (key, feature, value). Rows without a label take no part."""
    spark = labels.sparkSession
    scratch = Scratch(spark, "forest")
    rows = labels.where(F.col("label").isNotNull()).select(F.col(key), F.col("label").cast("double").alias("y"))
    if classify and not rows.where("y NOT IN (0, 1)").isEmpty():
        raise ValueError("labels of classes are 0 and 1")
    entries = entries.select(F.col(key), F.col("feature").cast("int").alias("feature"), F.col("value").cast("double").alias("value"))
    base = scratch.keep(_rows(entries, rows, key, F.monotonically_increasing_id().alias("row"), "y"), "base")
    features = base.select(F.explode("f").alias("feature")).distinct().count()
    share = p.share if p.share is not None else min(1.0, features**-0.5 if classify and features else 1.0)
    times = sum(((_chance("row", "tree", F.lit(p.seed)) >= c).cast("int") for c in _POISSON), F.lit(0)) if p.bootstrap else F.lit(1)

    def roots() -> DataFrame:
        trees = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(p.trees - 1))).alias("tree")).withColumn("node", F.lit(0).cast("long"))
        return trees.withColumn("w", times.cast("double")).where("w > 0")

    def with_entries(some: DataFrame) -> DataFrame:
        return some if "f" in some.columns else some.join(base.drop("y").hint("merge"), "row")

    at = roots()
    levels: list[DataFrame] = []
    next_id = dict.fromkeys(range(p.trees), 1)
    stuck: set[tuple[int, int]] = set()  # nodes that none of their drawn features divides
    edges = None
    while True:
        sizes = at.groupBy("tree", "node").agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), F.sum("w").alias("W"), F.sum(F.col("w") * F.col("y")).alias("S"))
        sums = {(r["tree"], r["node"]): (r["W"], r["S"]) for r in sizes.where((F.col("n") > p.small) & (F.col("low") < F.col("high"))).collect()}  # at most rows / small of each tree
        large = sorted(x for x in sums if (*x, True) not in stuck)  # so that nodes get the same numbers in each run
        if not large:
            break
        if edges is None:
            edges = scratch.keep(bin_edges(base.select(F.explode(F.arrays_zip("f", "v")).alias("e")).select(F.col("e.f").alias("feature"), F.col("e.v").alias("value")), p.bins), "edges")
            base = scratch.keep(_binned(base, edges), "binned")
            scratch.drop("base")
            at = roots()
        total = per_group(spark.createDataFrame([(t, n, *sums[t, n], (t, n) in stuck) for t, n in large], "tree int, node long, W double, S double, wide boolean"))
        found = {(r["tree"], r["node"]): r for r in _histogram_splits(with_entries(at.join(total.drop("W", "S"), ["tree", "node"])), total.drop("wide"), edges, share, p.seed).collect()}
        splits = []
        for t, n in large:
            if (t, n) in found:
                splits.append((t, n, found[t, n]["feature"], found[t, n]["cut"], next_id[t]))
                next_id[t] += 2
            else:  # try all features next; a node that even those don't divide stays as it is
                stuck.add((t, n, True) if (t, n) in stuck or share >= 1 else (t, n))
        if splits:
            level = scratch.keep(spark.createDataFrame(splits, _SPLIT).coalesce(1), f"level-{len(levels)}")
            levels.append(level)
            at = scratch.keep(_step(with_entries(at), level).select("tree", "node", "row", "y", "w"), f"at-{len(levels)}")
            scratch.drop(f"at-{len(levels) - 1}")
    seed = p.seed

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = key
        pdf = pdf.sort_values("row", ignore_index=True)
        if pdf["y"].min() == pdf["y"].max():  # also keeps undivided large nodes cheap
            pdf = pdf.head(1)
        got = Grown(pdf["f"].tolist(), pdf["v"].tolist(), pdf["y"].to_numpy(), pdf["w"].to_numpy(), share, [seed, int(tree), int(node)])
        return pd.DataFrame({"tree": [tree], "node": [node], "packed": [got.packed()]})

    dealt = with_entries(at).select("tree", "node", "row", "y", "w", "f", "v")
    subtrees = scratch.keep(dealt.groupBy("tree", "node").applyInPandas(grow, "tree int, node long, packed binary"), "subtrees")
    return Model(levels, subtrees, classify, p.trees)


def _histogram_splits(at: DataFrame, total: DataFrame, edges: DataFrame, share: float, seed: int) -> DataFrame:
    """(tree, node, feature, cut) of the best split of each node, by bins; none where no drawn feature divides it. ``total``: the nodes' sums of weights and labels."""
    node = ["tree", "node"]
    pairs = at.select(*node, "w", "y", "wide", F.explode(F.arrays_zip("f", "b")).alias("e"))
    if share < 1:
        pairs = pairs.where(F.col("wide") | (_chance("tree", "node", "e.f", F.lit(seed)) < share))
    sums = pairs.groupBy(*node, F.col("e.f").alias("feature"), F.col("e.b").alias("b")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"))
    positive = F.col("b") >= 0
    sums = sums.select(*node, "feature", positive.alias("positive"), F.when(positive, F.col("b")).otherwise(-1 - F.col("b")).alias("bin"), "w", "s")
    # Zeros lie between the negative and the positive values: a cut after a negative bin, one after the zeros, one after each positive bin.
    seen = sums.groupBy(*node, "feature").agg(F.sum("w").alias("sw"), F.sum("s").alias("ss")).join(total, node)
    zeros = seen.select(*node, "feature", F.lit(None).cast("boolean").alias("positive"), F.lit(-1).alias("bin"), (F.col("W") - F.col("sw")).alias("w"), (F.col("S") - F.col("ss")).alias("s"))
    place = F.when(F.col("positive").isNull(), 0).when(F.col("positive"), 1).otherwise(-1)
    every = sums.unionByName(zeros).withColumn("place", place)
    up = W.partitionBy(*node, "feature").orderBy("place", "bin")  # at most as many rows as bins, and the zeros
    every = every.select(*node, "feature", "place", "bin", F.sum("w").over(up).alias("uw"), F.sum("s").over(up).alias("us")).join(total, node)
    below, above = F.col("uw"), F.col("W") - F.col("uw")
    score = F.col("us") * F.col("us") / below + (F.col("S") - F.col("us")) * (F.col("S") - F.col("us")) / above
    ok = every.where((F.col("uw") > 1e-9) & (F.col("W") - F.col("uw") > 1e-9)).withColumn("score", score)
    best = F.max(F.struct("score", (-F.col("feature")).alias("f"), (-F.col("place")).alias("p"), (-F.col("bin")).alias("b"))).alias("best")
    chosen = ok.groupBy(*node).agg(best).select(*node, (-F.col("best.f")).alias("feature"), (-F.col("best.p")).alias("place"), (-F.col("best.b")).alias("bin")).join(per_group(edges), "feature")
    return chosen.select(*node, "feature", F.when(F.col("place") == 0, 0.0).otherwise(F.get("edges", F.col("bin"))).alias("cut"))
