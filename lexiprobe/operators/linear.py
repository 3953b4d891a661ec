"""Linear models of many cells at once: one pass over the rows a step, whatever the number of cells.

Rows hold their features sparsely and one label a cell; a null label keeps the row out of that cell. A
group (a language) has weights of its own, so the models are groups x labels. Weights are a dense
matrix of features by cells on the driver, sent to the tasks each step, and sums of that size come
back through a tree of partial sums; both are bounded by ``max_weights``, never by the rows.

* Ridge: squared error plus alpha times squared weights, the intercept free, by conjugate gradients
  on all right-hand sides together. A cell that has converged stands still while others go on.
* Logistic: C times log loss plus half the squared weights, or their absolute sum ("l1"), the
  intercept penalised as a weight, by truncated Newton steps; conjugate gradients use products with
  the Hessian. Step sizes of all cells are tried in one pass. With "l1" steps stay in the orthant of
  the weights, or of the downhill direction where a weight is zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch, ship

#: Numbers of a weight matrix at most: 64 MB.
MAX_WEIGHTS = 1 << 23
#: Step sizes tried together.
_STEPS = 2.0 ** -np.arange(12)
#: Relative errors of sums over many rows: of a gradient that cancels out, of a loss.
_NOISE, _ROUNDING = 1e-11, 1e-14


class Rows:
    """Rows of all cells, written once: group, labels, features."""

    def __init__(self, entries: DataFrame, labels: DataFrame, columns: list[str], group: str | None = None, key: str = "doc_id", features: int | None = None, max_weights: int = MAX_WEIGHTS):
        """``entries``: (key, feature, value); ``labels``: key, group and the label columns."""
        self.spark, self.columns = labels.sparkSession, columns
        ship(self.spark)
        scratch = Scratch(self.spark, "linear")
        sparse = entries.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("feature").cast("int").alias("f"), F.col("value").cast("double").alias("v")))).alias("e"))
        g = F.col(group).cast("string") if group else F.lit("")
        rows = labels.join(sparse, key, "left").select(F.coalesce(g, F.lit("")).alias("group"), F.array(*[F.col(c).cast("double") for c in columns]).alias("y"), F.coalesce("e", F.expr("CAST(array() AS array<struct<f:int,v:double>>)")).alias("e"))
        self.rows = scratch.keep(rows.select("group", "y", F.transform("e", lambda x: x["f"]).alias("f"), F.transform("e", lambda x: x["v"]).alias("v")), "rows")
        self.groups = [r["group"] for r in self.rows.select("group").distinct().orderBy("group").limit(max_weights + 1).collect()]
        top = self.rows.agg(F.max(F.array_max("f"))).first()[0]
        self.d = features if features is not None else (-1 if top is None else top) + 1
        self.k = len(columns)
        if (self.d + 1) * self.k * max(1, len(self.groups)) > max_weights:
            raise ValueError(f"{self.d + 1} weights for {self.k * len(self.groups)} cells are more than {max_weights}; fit fewer cells at a time")

    def zeros(self) -> np.ndarray:
        """Weights by group, feature (the last is the intercept) and label."""
        return np.zeros((len(self.groups), self.d + 1, self.k))

    def summed(self, each: Callable, width: int) -> np.ndarray:
        """The sum over all rows of what ``each`` makes of a block: (group numbers, labels, product) -> per-group matrices of ``width`` numbers."""
        index, d, k = {g: i for i, g in enumerate(self.groups)}, self.d, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                of = np.array([index[g] for g in batch.column(0).to_pylist()])
                y = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)
                f, v = batch.column(2).flatten().to_numpy(zero_copy_only=False), batch.column(3).flatten().to_numpy(zero_copy_only=False)
                n = np.diff(batch.column(2).offsets.to_numpy())
                for g in np.unique(of).tolist():
                    mine = of == g
                    entry = np.repeat(mine, n)
                    out = each(g, y[mine], Block(f[entry], v[entry], n[mine], d))
                    total[g] = total[g] + out if g in total else out
            for g, out in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([out.ravel()], pa.list_(pa.float64()))], names=["g", "s"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for g, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                    s = s.values.to_numpy()
                    total[g] = total[g] + s if g in total else s.copy()
            for g, s in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([s], pa.list_(pa.float64()))], names=["g", "s"])

        schema = "g int, s array<double>"
        parts = self.rows.mapInArrow(run, schema)
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 4)
        tree = parts.repartition(n).mapInArrow(merge, schema)
        out = np.zeros((len(self.groups), width))
        few = n * out.size <= 1 << 18  # small sums come in one job, else some rows of the matrix's size at a time
        for r in tree.collect() if few else tree.toLocalIterator():
            out[r["g"]] += np.array(r["s"])
        return out


@dataclass
class Block:
    """Some rows of one group as a sparse matrix with a column of ones."""

    f: np.ndarray
    v: np.ndarray
    n: np.ndarray
    d: int

    def times(self, w: np.ndarray) -> np.ndarray:
        """X w, for weights (d + 1, k)."""
        out = np.zeros((len(self.n), w.shape[1]))
        some = np.flatnonzero(self.n)
        if len(some):
            out[some] = np.add.reduceat(self.v[:, None] * w[self.f], (np.cumsum(self.n) - self.n)[some], axis=0)
        return out + w[self.d]

    def transposed_times(self, q: np.ndarray) -> np.ndarray:
        """X' q, for q (rows, k)."""
        out = np.zeros((self.d + 1, q.shape[1]))
        np.add.at(out, self.f, self.v[:, None] * np.repeat(q, self.n, axis=0))
        out[self.d] = q.sum(0)
        return out


@dataclass
class Weights:
    """Fitted weights by group, feature and label; the last feature is the intercept. ``passes`` over the rows."""

    groups: list[str]
    columns: list[str]
    w: np.ndarray
    passes: int
    gradient: np.ndarray

    def of(self, column: str, group: str = "") -> tuple[np.ndarray, float]:
        w = self.w[self.groups.index(group), :, self.columns.index(column)]
        return w[:-1], float(w[-1])

    def table(self, spark: SparkSession) -> DataFrame:
        """(group, label, feature, weight) of weights that are not zero; feature -1 is the intercept."""
        g, f, c = np.nonzero(self.w)
        last = self.w.shape[1] - 1
        rows = [(self.groups[i], self.columns[k], -1 if j == last else int(j), float(self.w[i, j, k])) for i, j, k in zip(g.tolist(), f.tolist(), c.tolist())]
        return spark.createDataFrame(rows, "group string, label string, feature int, weight double")

    def margins(self, rows: DataFrame, entries: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, group, label, margin): every row under every model, from one join of the entries with the weights.

        A row's own group need not be the model's: this is the transfer of all models to all rows.
        """
        table = self.table(rows.sparkSession)
        bias = {(g, c): float(self.w[i, -1, k]) for i, g in enumerate(self.groups) for k, c in enumerate(self.columns)}
        every = rows.sparkSession.createDataFrame([(g, c, b) for (g, c), b in bias.items()], "group string, label string, bias double")
        sums = entries.join(F.broadcast(table.where("feature >= 0")), "feature").groupBy(key, "group", "label").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))  # at most max_weights rows
        crossed = rows.select(key).crossJoin(F.broadcast(every))  # a row a model
        return crossed.join(sums, [key, "group", "label"], "left").select(key, "group", "label", (F.coalesce("s", F.lit(0.0)) + F.col("bias")).alias("margin"))


def ridge(rows: Rows, alpha: float = 1.0, tol: float = 1e-10, most: int = 1000) -> Weights:
    """All cells' ridge regressions; a cell ends when its residual is ``tol`` of its right-hand side."""
    shape = rows.zeros().shape
    flat = (rows.d + 1) * rows.k

    def operator(p: np.ndarray) -> np.ndarray:
        def each(g, y, x):
            return x.transposed_times(np.where(np.isnan(y), 0.0, x.times(p[g])))

        penalty = alpha * p
        penalty[:, -1] = 0.0
        return rows.summed(each, flat).reshape(shape) + penalty

    w = rows.zeros()
    r = rows.summed(lambda g, y, x: x.transposed_times(np.nan_to_num(y)), flat).reshape(shape)
    p, rr = r.copy(), (r * r).sum(1)
    goal, passes = tol * tol * rr, 1
    while (rr > goal).any() and passes < most:
        q = operator(p)
        passes += 1
        live = rr > goal
        bend = (p * q).sum(1)
        a = np.where(live & (bend > 0), rr / np.where(bend > 0, bend, 1.0), 0.0)[:, None, :]
        w, r = w + a * p, r - a * q
        new = np.where(live, (r * r).sum(1), rr)
        p = np.where(live[:, None, :], r + (new / np.where(rr > 0, rr, 1.0))[:, None, :] * p, p)
        rr = new
        if passes % 50 == 0:  # directions of a long run lose their conjugacy: start again from the true residual
            r = rows.summed(lambda g, y, x, w=w: x.transposed_times(np.where(np.isnan(y), 0.0, np.nan_to_num(y) - x.times(w[g]))), flat).reshape(shape)
            passes += 1
            penalty = alpha * w
            penalty[:, -1] = 0.0
            r -= penalty
            p, rr = r.copy(), (r * r).sum(1)
    return Weights(rows.groups, rows.columns, w, passes, np.sqrt(rr))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def logistic(rows: Rows, c: float = 1.0, penalty: str = "l2", tol: float = 1e-6, most: int = 100, inner: int = 60) -> Weights:
    """All cells' logistic regressions of labels 0 and 1; ends when no cell's (pseudo-)gradient is above ``tol`` times its start.

    With "l1" the penalty's slope is 1 whatever the number of rows, so ``tol`` is of that, or as near as sums of so many rows come.
    """
    if penalty not in ("l1", "l2"):
        raise ValueError(f"unknown penalty {penalty!r}")
    shape, flat, one = rows.zeros().shape, (rows.d + 1) * rows.k, penalty == "l1"
    passes = 0

    def gradient(w: np.ndarray) -> np.ndarray:
        def each(g, y, x):
            return x.transposed_times(np.where(np.isnan(y), 0.0, c * (_sigmoid(x.times(w[g])) - np.nan_to_num(y))))

        return rows.summed(each, flat).reshape(shape) + (0.0 if one else w)

    def curved(w: np.ndarray, p: np.ndarray) -> np.ndarray:
        def each(g, y, x):
            q = _sigmoid(x.times(w[g]))
            return x.transposed_times(np.where(np.isnan(y), 0.0, c * q * (1 - q) * x.times(p[g])))

        return rows.summed(each, flat).reshape(shape) + (0.0 if one else p)

    def losses(tried: list[np.ndarray]) -> np.ndarray:
        def each(g, y, x):
            out = []
            for w in tried:
                z = x.times(w[g])
                out.append(np.where(np.isnan(y), 0.0, np.logaddexp(0, z) - np.nan_to_num(y) * z).sum(0))
            return np.stack(out)

        log = rows.summed(each, len(tried) * rows.k).reshape(shape[0], len(tried), rows.k)
        return np.stack([c * log[:, i] + (np.abs(w).sum(1) if one else 0.5 * (w * w).sum(1)) for i, w in enumerate(tried)])

    def pseudo(w: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.where(w != 0, g + np.sign(w), np.sign(g) * np.maximum(np.abs(g) - 1, 0)) if one else g

    w = rows.zeros()
    start = None
    for _ in range(most):
        g = pseudo(w, gradient(w))
        passes += 1
        size = np.abs(g).max(1, initial=0.0)
        start = np.maximum(size, 1e-300) if start is None else start
        live = size > (np.maximum(tol, _NOISE * start) if one else tol * np.maximum(start, 1.0))
        if not live.any():
            break
        free = (w != 0) | (g != 0)
        side = np.where(w != 0, np.sign(w), -np.sign(g))
        # Newton direction by conjugate gradients, to a residual that shrinks with the gradient.
        step, r = np.zeros(shape), np.where(free, -g, 0.0)
        p, rr = r.copy(), (r * r).sum(1)
        goal = np.minimum(0.01, np.sqrt(size / start)) ** 2 * rr
        for _ in range(inner):
            on = live & (rr > goal)
            if not on.any():
                break
            q = np.where(free, curved(w, p), 0.0) + (1e-10 * p if one else 0.0)
            passes += 1
            bend = (p * q).sum(1)
            a = np.where(on & (bend > 0), rr / np.where(bend > 0, bend, 1.0), 0.0)[:, None, :]
            step, r = step + a * p, r - a * q
            new = np.where(on, (r * r).sum(1), rr)
            p = np.where(on[:, None, :], r + (new / np.where(rr > 0, rr, 1.0))[:, None, :] * p, p)
            rr = new
        to = lambda s: np.where((w + s * step) * side > 0, w + s * step, 0.0) if one else w + s * step
        tried = [w, *(to(s) for s in _STEPS)]
        f = losses(tried)
        passes += 1
        fall = np.stack([((t - w) * g).sum(1) for t in tried])
        # Near the end a step gains less than the losses' rounding errors.
        good = (f <= f[0] + 1e-4 * fall + (_ROUNDING * np.abs(f[0]) if one else 0.0)) & (np.arange(len(tried)) > 0)[:, None, None]
        first = np.where(good.any(0) & live, good.argmax(0), 0)  # the longest step that is good enough; none: stay
        if not first.any():
            break
        w = np.take_along_axis(np.stack(tried), first[None, :, None, :], 0)[0]
    return Weights(rows.groups, rows.columns, w, passes, np.abs(pseudo(w, gradient(w))).max(1, initial=0.0))
