"""Second-order boosted trees over histograms, for any number of models at once.

Features are (doc_id, feature, value) rows; what a row lacks is missing, not zero, and goes where a
split's gain is larger. Values are cut into bins once. A level of a tree is one aggregate: sums of
gradients and hessians by (cell, node, feature, bin); of two siblings only the smaller is summed, the
other is the parent's histogram less that. A cell is a model of its own (a language, task or control),
and all cells grow side by side, so the number of jobs depends on rounds and depth alone.

Gradients are whole numbers of a fixed scale, so sums are exact in any order: reruns and subtracted
histograms agree to the last bit.

Leaves are -eta * G / (H + reg_lambda). Columns are drawn once a tree, rows by the hash of their
number. Ties in gain fall to the smaller feature, the smaller bin, and missing values to the right.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .groups import MOST, per_group

_TREE = "feature array<int>, bin array<int>, cut array<double>, missing_left array<boolean>, value array<double>"


@dataclass(frozen=True)
class Parameters:
    rounds: int = 100
    depth: int = 6
    eta: float = 0.1
    subsample: float = 1.0
    colsample: float = 1.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    bins: int = 256
    seed: int = 42


def bin_edges(entries: DataFrame, bins: int) -> DataFrame:
    """(feature, edges): the sorted distinct values of a feature, or as many quantiles where there are more than ``bins``."""
    values = entries.groupBy("feature", "value").agg(F.count("*").alias("n"))
    many = values.groupBy("feature").agg(F.count("*").alias("k"))
    few = values.join(many.where(F.col("k") <= bins), "feature").groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("edges"))
    cuts = F.percentile_approx("value", [(k + 1) / bins for k in range(bins)], 50 * bins)
    large = entries.join(many.where(F.col("k") > bins), "feature").groupBy("feature").agg(F.array_sort(F.array_distinct(cuts)).alias("edges"))
    return few.unionByName(large)


def _looked_up(keys: Column, values: Column, key: Column) -> Column:
    """The value beside a key; null where the row lacks it."""
    at = F.array_position(keys, key)
    return F.when(at > 0, F.get(values, (at - 1).cast("int")))


def leaf_of(tree: Column, keys: Column, values: Column, cuts: str, depth: int) -> Column:
    """The node (1 is the root, 2n and 2n + 1 the children of n) where a row ends; ``cuts``: the tree's field that ``values`` compare with."""

    def step(node: Column, _: Column) -> Column:
        f = F.get(tree["feature"], node)
        v = _looked_up(keys, values, f)
        left = F.coalesce(v <= F.get(tree[cuts], node), F.get(tree["missing_left"], node))
        return F.when(f < 0, node).otherwise(node * 2 + F.when(left, 0).otherwise(1))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)


class _Tree:
    """A tree of one cell as it grows, as arrays by node."""

    def __init__(self, depth: int):
        n = 2 << depth
        self.feature, self.bin, self.cut, self.missing_left, self.value = [-1] * n, [0] * n, [0.0] * n, [False] * n, [0.0] * n

    def row(self) -> tuple:
        return self.feature, self.bin, self.cut, self.missing_left, self.value


class Model:
    """Trees by cell: ``trees`` has (cell, base, trees), one row a cell."""

    def __init__(self, trees: DataFrame, classify: bool, parameters: Parameters):
        self.trees, self.classify, self.p = trees, classify, parameters

    def _with_margins(self, rows: DataFrame, entries: DataFrame, cell: str | None, key: str) -> DataFrame:
        """``rows`` with ``margins``: the running sums of all rounds, from the base on."""
        sparse = entries.groupBy(key).agg(F.collect_list(F.struct("feature", "value")).alias("__e"))
        named = rows.withColumn("__cell", F.col(cell).cast("string") if cell else F.lit(""))
        joined = named.join(sparse, key, "left").join(per_group(self.trees.withColumnRenamed("cell", "__cell")), "__cell", "left")
        e = F.coalesce("__e", F.expr("CAST(array() AS array<struct<feature:int,value:double>>)"))
        keys, values = F.transform(e, lambda x: x["feature"]), F.transform(e, lambda x: x["value"])
        outputs = F.transform("trees", lambda t: F.get(t["value"], leaf_of(t, keys, values, "cut", self.p.depth)))
        running = F.aggregate(outputs, F.array("base"), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
        return joined.withColumn("margins", running).drop("__e", "__cell", "trees", "base")

    def predict(self, rows: DataFrame, entries: DataFrame, cell: str | None = None, key: str = "doc_id") -> DataFrame:
        """``rows`` with prediction, and for classes the probability of class 1; null for cells without a model."""
        out = self._with_margins(rows, entries, cell, key).withColumn("__m", F.element_at("margins", -1)).drop("margins")
        if not self.classify:
            return out.withColumnRenamed("__m", "prediction")
        return out.withColumn("probability", 1 / (1 + F.exp(-F.col("__m")))).withColumn("prediction", (F.col("__m") > 0).cast("double")).drop("__m")

    def curve(self, rows: DataFrame, entries: DataFrame, label: str = "label", cell: str | None = None, key: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
        """(by, round, loss, n): mean squared error, or log loss, after each round (0: the base alone), in one pass."""
        y, m = F.col(label).cast("double"), F.col("m")
        loss = F.log1p(F.exp(-F.abs(m))) + F.greatest(m, F.lit(0.0)) - y * m if self.classify else (y - m) * (y - m)
        rounds = self._with_margins(rows, entries, cell, key).where(y.isNotNull()).select(*by, label, F.posexplode("margins").alias("round", "m"))
        return rounds.groupBy(*by, "round").agg(F.avg(loss).alias("loss"), F.count("*").alias("n"))

    def importances(self) -> DataFrame:
        """(cell, feature, splits): how many splits use a feature."""
        features = F.explode(F.flatten(F.transform("trees", lambda t: F.filter(t["feature"], lambda f: f >= 0)))).alias("feature")
        return self.trees.select("cell", features).groupBy("cell", "feature").agg(F.count("*").alias("splits"))

    def save(self, path: str) -> None:
        p = self.p
        self.trees.withColumn("classify", F.lit(self.classify)).withColumn("depth", F.lit(p.depth)).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        rows = spark.read.parquet(path)
        first = rows.first()
        return cls(rows.drop("classify", "depth"), first["classify"], Parameters(depth=first["depth"]))


def fit(entries: DataFrame, labels: DataFrame, classify: bool, parameters: Parameters = Parameters(), cell: str | None = None, key: str = "doc_id") -> Model:
    """Trees for each cell of ``labels`` (key, label, cell); ``entries`` are its features (key, feature, value).

    Rows without a label take no part; a row without features has all of them missing. Labels of
    classes are 0 and 1. Without rows the model has no cells.
    """
    return _Fit(entries, labels, classify, parameters, cell, key).run()


class _Fit:
    def __init__(self, entries: DataFrame, labels: DataFrame, classify: bool, p: Parameters, cell: str | None, key: str):
        self.spark, self.classify, self.p = labels.sparkSession, classify, p
        self.scratch = Scratch(self.spark, "boosting")
        entries = entries.select(F.col(key).alias("key"), F.col("feature").cast("int").alias("feature"), F.col("value").cast("double").alias("value")).where("value IS NOT NULL")
        rows = labels.where(F.col("label").isNotNull()).select(F.col(key).alias("key"), (F.col(cell).cast("string") if cell else F.lit("")).alias("cell"), F.col("label").cast("double").alias("y"))
        entries = self.scratch.keep(entries.join(rows.select("key").distinct(), "key", "left_semi"), "entries")
        self.edges = self.scratch.keep(bin_edges(entries, p.bins), "edges")
        binned = entries.join(self.edges, "feature").select("key", "feature", F.size(F.filter("edges", lambda e: e < F.col("value"))).alias("bin"))
        sparse = binned.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("feature", "bin"))).alias("e"))
        none = F.expr("CAST(array() AS array<struct<feature:int,bin:int>>)")
        base = self.scratch.keep(rows.join(sparse, "key", "left").select(F.monotonically_increasing_id().alias("row"), "cell", "y", F.coalesce("e", none).alias("e")), "unsorted")
        self.parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.base = self.scratch.keep_by(base.repartition(self.parts, "row"), "base", "row", self.parts)
        self.scratch.drop("unsorted", "entries")
        mean = F.avg("y")
        prior = F.when(mean.between(1e-9, 1 - 1e-9), F.log(mean / (1 - mean))).otherwise(F.when(mean > 0.5, 20.0).otherwise(-20.0)) if classify else mean
        self.cells = {r["cell"]: r for r in self.base.groupBy("cell").agg(prior.alias("base"), F.min("y").alias("low"), F.max("y").alias("high"), F.count("*").alias("n")).collect()}  # a row a model
        n = sum(r["n"] for r in self.cells.values())
        bound = 1.0 if classify else max([r["high"] - r["low"] for r in self.cells.values()] or [0.0])
        # The largest power of two whose sums of all gradients, and of all hessians, fit into a long.
        self.scale = 2.0 ** max(0, min(40, math.floor(61 - math.log2(max(n, 1)) - math.log2(max(bound, 1.0)))))
        self.features = [r["feature"] for r in self.edges.select("feature").orderBy("feature").collect()] if p.colsample < 1 else None  # a row a column of the model

    def run(self) -> Model:
        p, trees = self.p, {c: [] for c in self.cells}
        start = self._by_cell({c: (r["base"],) for c, r in self.cells.items()}, "margin double")
        margins = self.base.select("row", "cell").join(start, "cell").select("row", "margin")
        margins = self._kept(margins, "margins-0")
        for t in range(p.rounds if self.cells else 0):
            grown = self._tree(t, margins)
            for c, tree in grown.items():
                trees[c].append(tree.row())
            if t + 1 < p.rounds:
                table = self._by_cell({c: (tree.row(),) for c, tree in grown.items()}, f"tree struct<{_TREE.replace(' array', ':array')}>")
                rows = self.base.join(margins, "row").join(table, "cell")
                margins = self._kept(rows.select("row", (F.col("margin") + F.get("tree.value", self._node(F.col("tree")))).alias("margin")), f"margins-{t + 1}")
                self.scratch.drop(f"margins-{t}")
        model = self.spark.createDataFrame([(c, float(self.cells[c]["base"]), trees[c]) for c in self.cells], f"cell string, base double, trees array<struct<{_TREE.replace(' array', ':array')}>>")
        out = self.scratch.keep(model, "model")
        return Model(out, self.classify, p)

    def _kept(self, margins: DataFrame, name: str) -> DataFrame:
        return self.scratch.keep_by(margins, name, "row", self.parts)

    def _by_cell(self, values: dict, schema: str) -> DataFrame:
        """A small table by cell: broadcast while there are few cells."""
        table = self.spark.createDataFrame([(c, *v) for c, v in values.items()], f"cell string, {schema}")
        return F.broadcast(table) if len(values) <= MOST else table

    def _node(self, tree: Column, depth: int | None = None) -> Column:
        e = F.col("e")
        return leaf_of(tree, F.transform(e, lambda x: x["feature"]), F.transform(e, lambda x: x["bin"]), "bin", depth or self.p.depth)

    def _gradients(self, t: int, margins: DataFrame) -> DataFrame:
        """(row, cell, e, g, h) of the rows that the tree is grown on."""
        p, y, m = self.p, F.col("y"), F.col("margin")
        q = 1 / (1 + F.exp(-m))
        g, h = (q - y, q * (1 - q)) if self.classify else (m - y, F.lit(1.0))
        rows = self.base.join(margins, "row")
        if p.subsample < 1:
            rows = rows.where(F.pmod(F.xxhash64("row", F.lit(p.seed), F.lit(t)), F.lit(1 << 30)) < int(p.subsample * (1 << 30)))
        whole = lambda v: F.round(v * self.scale).cast("long")
        rows = rows.select("row", "cell", "e", whole(g).alias("g"), whole(h).alias("h"))
        if self.features:
            drawn = np.random.default_rng([p.seed, t]).choice(self.features, max(1, int(p.colsample * len(self.features))), replace=False)
            table = self.spark.createDataFrame([(sorted(drawn.tolist()),)], "drawn array<int>")
            rows = rows.crossJoin(F.broadcast(table))  # one row of at most all columns
            rows = rows.withColumn("e", F.filter("e", lambda x: F.array_contains("drawn", x["feature"]))).drop("drawn")
        return rows

    def _tree(self, t: int, margins: DataFrame) -> dict[str, _Tree]:
        p = self.p
        trees = {c: _Tree(p.depth) for c in self.cells}
        rows = self._gradients(t, margins)
        small, before = None, None  # (cell, node) whose rows are summed; the histogram of the level above
        for depth in range(p.depth + 1):
            if depth == 0:
                at = rows.withColumn("node", F.lit(1))
            else:
                table = self._by_cell({c: (tree.row(),) for c, tree in trees.items()}, f"tree struct<{_TREE.replace(' array', ':array')}>")
                at = rows.join(table, "cell").withColumn("node", self._node(F.col("tree"), depth)).drop("tree")
                at = at.join(per_group(self.spark.createDataFrame(small, "cell string, node int")), ["cell", "node"], "left_semi")
            histogram = self._histogram(at)
            if depth:
                # The other child is the parent less this one.
                this = self.scratch.keep(histogram, f"sum-{t}-{depth}")
                of = before.join(per_group(self.spark.createDataFrame([(c, n // 2, n ^ 1) for c, n in small], "cell string, node int, child int")), ["cell", "node"])
                less = this.select("cell", F.col("node").bitwiseXOR(F.lit(1)).alias("child"), "feature", "bin", F.col("g").alias("lg"), F.col("h").alias("lh"), F.col("n").alias("ln"))
                zero = lambda c: F.coalesce(c, F.lit(0))
                other = of.join(less, ["cell", "child", "feature", "bin"], "left").select("cell", F.col("child").alias("node"), "feature", "bin", (F.col("g") - zero("lg")).alias("g"), (F.col("h") - zero("lh")).alias("h"), (F.col("n") - zero("ln")).alias("n"))
                histogram = this.unionByName(other.where("n > 0"))
            histogram = self.scratch.keep(histogram, f"histogram-{t}-{depth}")
            splits = self._splits(histogram, depth < p.depth).collect()  # at most cells * 2 ** depth rows
            self.scratch.drop(f"histogram-{t}-{depth - 1}", f"sum-{t}-{depth}")
            small, before = [], histogram
            for r in splits:
                tree, node = trees[r["cell"]], r["node"]
                tree.value[node] = -p.eta * (r["G"] / self.scale) / (r["H"] / self.scale + p.reg_lambda)
                if depth < p.depth and r["feature"] is not None:
                    tree.feature[node], tree.bin[node], tree.cut[node], tree.missing_left[node] = r["feature"], r["bin"], r["cut"], r["missing_left"]
                    small.append((r["cell"], 2 * node if 2 * r["n_left"] <= r["N"] else 2 * node + 1))
            if not small:
                break
        self.scratch.drop(*(f"histogram-{t}-{d}" for d in range(p.depth + 1)))
        return trees

    @staticmethod
    def _histogram(at: DataFrame) -> DataFrame:
        """Sums by (cell, node, feature, bin); feature -1 has the whole node's."""
        whole = F.array(F.struct(F.lit(-1).alias("feature"), F.lit(0).alias("bin")))
        pairs = at.select("cell", "node", "g", "h", F.explode(F.concat(whole, "e")).alias("x"))
        return pairs.groupBy("cell", "node", F.col("x.feature").alias("feature"), F.col("x.bin").alias("bin")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))

    def _splits(self, histogram: DataFrame, further: bool) -> DataFrame:
        """(cell, node, G, H, N, feature, bin, cut, missing_left, n_left) of each node; feature is null where no split gains."""
        p = self.p
        total = histogram.where("feature = -1").select("cell", "node", F.col("g").alias("G"), F.col("h").alias("H"), F.col("n").alias("N"))
        if not further:
            none = lambda kind: F.lit(None).cast(kind)
            return total.select("*", none("int").alias("feature"), none("int").alias("bin"), none("double").alias("cut"), none("boolean").alias("missing_left"), none("long").alias("n_left"))
        one = W.partitionBy("cell", "node", "feature")
        upto, whole = one.orderBy("bin"), one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # at most as many rows as bins
        sums = histogram.where("feature >= 0").select("cell", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}_up") for c in "ghn"], *[F.sum(c).over(whole).alias(f"{c}_all") for c in "ghn"])
        both = sums.join(per_group(total), ["cell", "node"]).withColumn("missing_left", F.explode(F.array(F.lit(False), F.lit(True))))
        left = lambda c: F.col(f"{c}_up") + F.when(F.col("missing_left"), F.col(c.upper()) - F.col(f"{c}_all")).otherwise(0)
        both = both.select("cell", "node", "feature", "bin", "missing_left", "G", "H", "N", left("g").alias("gl"), left("h").alias("hl"), left("n").alias("n_left"))
        real = lambda c: c / F.lit(self.scale)
        gl, hl, gr, hr = real(F.col("gl")), real(F.col("hl")), real(F.col("G") - F.col("gl")), real(F.col("H") - F.col("hl"))
        score = lambda g, h: g * g / (h + p.reg_lambda)
        gain = score(gl, hl) + score(gr, hr) - score(real(F.col("G")), real(F.col("H")))
        ok = (F.col("n_left") > 0) & (F.col("n_left") < F.col("N")) & (hl >= p.min_child_weight) & (hr >= p.min_child_weight) & (gain / 2 > p.gamma + 1e-9)
        best = F.max(F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("missing_left")).alias("right"), "n_left")).alias("best")
        found = both.where(ok).groupBy("cell", "node").agg(best).select("cell", "node", (-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("bin"), (~F.col("best.right")).alias("missing_left"), "best.n_left")
        found = found.join(self.edges, "feature").withColumn("cut", F.get("edges", F.col("bin"))).drop("edges")
        return total.join(found, ["cell", "node"], "left")
