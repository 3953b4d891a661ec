"""Probes: small networks on sentence vectors, one per group, trained side by side.

A probe is a list of layers; each layer gives its output, and from the gradient behind it the gradient
before it and those of its own parameters. Training is AdamW with a cosine rate, gradient
accumulation, and early stopping on a tenth of the rows with the best state restored.
"""

from __future__ import annotations

import copy
import math
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch, ship

#: Bytes of fitted probes that are sent to the workers at a time.
SENT = 64 << 20


def _erf(z: np.ndarray) -> np.ndarray:
    """The error function to 2e-7 (Abramowitz and Stegun, 7.1.26)."""
    t = 1 / (1 + 0.3275911 * np.abs(z))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(z) * (1 - poly * np.exp(-z * z))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _gelu(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    share = 0.5 * (1 + _erf(z / math.sqrt(2)))
    return z * share, share + z * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _silu(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = _sigmoid(z)
    return z * s, s * (1 + z * (1 - s))


def _tanh(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.tanh(z)
    return t, 1 - t * t


def _logistic(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = _sigmoid(z)
    return s, s * (1 - s)


#: Value and slope by name; other names are "relu".
ACTIVATIONS = {
    "relu": lambda z: (np.maximum(z, 0), (z > 0).astype(float)), "gelu": _gelu, "tanh": _tanh, "sigmoid": _logistic, "silu": _silu, "swish": _silu,
    "leaky_relu": lambda z: (np.where(z > 0, z, 0.01 * z), np.where(z > 0, 1.0, 0.01)), "softplus": lambda z: (np.logaddexp(0, z), _sigmoid(z)),
}


def initial(how: str, rows: int, columns: int, draw: np.random.Generator) -> np.ndarray:
    """A weight matrix; other names than those below give the uniform range of one over the root of its rows."""
    if how in ("normal", "small"):
        return draw.normal(0, 0.02 if how == "normal" else 0.01, (rows, columns))
    if how == "xavier":
        edge = math.sqrt(6 / (rows + columns))
    elif how == "kaiming":
        return draw.normal(0, math.sqrt(2 / rows), (rows, columns))
    elif how == "orthogonal":
        q, r = np.linalg.qr(draw.normal(size=(max(rows, columns), min(rows, columns))))
        q = q * np.sign(np.diag(r))
        return q if rows >= columns else q.T
    else:
        edge = 1 / math.sqrt(rows)
    return draw.uniform(-edge, edge, (rows, columns))


class Dense:
    def __init__(self, w: np.ndarray, bias: bool):
        self.params = [w, *([np.zeros(w.shape[1])] if bias else [])]
        self.decayed = 1  # the first so many parameters

    def forward(self, x: np.ndarray, draw) -> np.ndarray:
        self.x = x
        return x @ self.params[0] + (self.params[1] if len(self.params) > 1 else 0)

    def backward(self, d: np.ndarray) -> np.ndarray:
        self.grads = [self.x.T @ d, *([d.sum(0)] if len(self.params) > 1 else [])]
        return d @ self.params[0].T


class NormedDense:
    """Weights as direction times length, a length for each output."""

    def __init__(self, w: np.ndarray):
        self.params, self.decayed = [w, np.linalg.norm(w, axis=0), np.zeros(w.shape[1])], 1

    def forward(self, x: np.ndarray, draw) -> np.ndarray:
        v, g, b = self.params
        self.x, self.norm = x, np.maximum(np.linalg.norm(v, axis=0), 1e-12)
        self.w = v * (g / self.norm)
        return x @ self.w + b

    def backward(self, d: np.ndarray) -> np.ndarray:
        v, g, _ = self.params
        of_w = self.x.T @ d
        of_g = (of_w * v).sum(0) / self.norm
        self.grads = [g / self.norm * (of_w - v * (of_g / self.norm)), of_g, d.sum(0)]
        return d @ self.w.T


class Activation:
    def __init__(self, name: str):
        self.name, self.params, self.decayed, self.grads = name.lower(), [], 0, []

    def forward(self, x: np.ndarray, draw) -> np.ndarray:
        out, self.slope = ACTIVATIONS.get(self.name, ACTIVATIONS["relu"])(x)
        return out

    def backward(self, d: np.ndarray) -> np.ndarray:
        return d * self.slope


class Dropout:
    def __init__(self, share: float):
        self.share, self.params, self.decayed, self.grads = share, [], 0, []

    def forward(self, x: np.ndarray, draw) -> np.ndarray:
        self.kept = None if draw is None else (draw.random(x.shape) >= self.share) / (1 - self.share)
        return x if self.kept is None else x * self.kept

    def backward(self, d: np.ndarray) -> np.ndarray:
        return d if self.kept is None else d * self.kept


class Norm:
    """Layer normalization (axis 1) or batch normalization (axis 0, with running moments for prediction)."""

    def __init__(self, width: int, axis: int):
        self.axis, self.params, self.decayed = axis, [np.ones(width), np.zeros(width)], 0
        self.mean, self.var = np.zeros((1, width)), np.ones((1, width))

    def forward(self, x: np.ndarray, draw) -> np.ndarray:
        own = self.axis == 1 or (draw is not None and len(x) > 1)
        mean, var = (x.mean(self.axis, keepdims=True), x.var(self.axis, keepdims=True)) if own else (self.mean, self.var)
        if own and self.axis == 0:
            self.mean, self.var = 0.9 * self.mean + 0.1 * mean, 0.9 * self.var + 0.1 * var
        self.own, self.scale = own, 1 / np.sqrt(var + 1e-5)
        self.z = (x - mean) * self.scale
        return self.z * self.params[0] + self.params[1]

    def backward(self, d: np.ndarray) -> np.ndarray:
        self.grads = [(d * self.z).sum(0), d.sum(0)]
        d = d * self.params[0]
        if self.own:
            d = d - d.mean(self.axis, keepdims=True) - self.z * (d * self.z).mean(self.axis, keepdims=True)
        return d * self.scale


def layers(
    width: int, outputs: int, hidden: Sequence[int] = (64,), activation: str = "relu", dropout: float = 0.0, normalization: str = "none", bias: bool = True,
    init: str = "xavier", rank: int | None = None, weight_norm: bool = False, draw: np.random.Generator | None = None,
) -> list:
    """A probe's layers. Without ``hidden`` it is linear, at most of ``rank``, or with normed weights.

    Before each hidden layer stand its normalization ("layer" or "batch") and its dropout.
    """
    draw = draw or np.random.default_rng(0)
    out: list = []
    if not hidden:
        drop = [Dropout(dropout)] if dropout else []
        if rank is not None and rank < width:
            return [*drop, Dense(initial(init, width, rank, draw), False), Dense(initial(init, rank, outputs, draw), True)]
        w = initial(init, width, outputs, draw)
        return [*drop, NormedDense(w) if weight_norm else Dense(w, True)]
    for size in hidden:
        if normalization.lower() in ("layer", "batch"):
            out.append(Norm(width, 1 if normalization.lower() == "layer" else 0))
        if dropout:
            out.append(Dropout(dropout))
        out += [Dense(initial(init, width, size, draw), bias), Activation(activation)]
        width = size
    return [*out, Dense(initial(init, width, outputs, draw), bias)]


class Probe:
    """A trained network with the scaling of its inputs and, for regression (``classes`` 0), its outputs."""

    def __init__(self, stack: list, mean: np.ndarray, std: np.ndarray, classes: int, shift: float, scale: float):
        self.stack, self.mean, self.std, self.classes, self.shift, self.scale = stack, mean, std, classes, shift, scale

    def forward(self, x: np.ndarray, draw=None) -> np.ndarray:
        """Probabilities or standardised values of scaled rows; with ``draw`` as in training."""
        for layer in self.stack:
            x = layer.forward(x, draw)
        if self.classes:
            e = np.exp(x - x.max(1, keepdims=True))
            x = e / e.sum(1, keepdims=True)
        return x

    def backward(self, d: np.ndarray) -> None:
        for layer in reversed(self.stack):
            d = layer.backward(d)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        """Class probabilities, or values."""
        out = self.forward((rows - self.mean) / self.std)
        return out if self.classes else out[:, 0] * self.scale + self.shift


def mlp(
    x: np.ndarray, y: np.ndarray, classes: int, hidden: Sequence[int] = (64,), epochs: int = 60, lr: float = 3e-3, batch: int = 32, patience: int = 10,
    accumulate: int = 1, decay: float = 0.01, seed: int = 0, **network,
) -> Probe:
    """Trains a probe; ``network`` are options of ``layers``. ``classes`` 0: regression on standardised labels."""
    draw = np.random.default_rng(seed)
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-8)
    shift, scale = (0.0, 1.0) if classes else (float(y.mean()), float(max(y.std(), 1e-8)))
    x = (x - mean) / std
    goal = np.eye(classes)[y.astype(int)] if classes else ((y - shift) / scale)[:, None]
    order = draw.permutation(len(x))
    held, train = order[: max(1, len(x) // 10)], order[max(1, len(x) // 10) :]
    if not len(train):
        train = held
    probe = Probe(layers(x.shape[1], goal.shape[1], hidden, draw=draw, **network), mean, std, classes, shift, scale)
    params = [(layer, k) for layer in probe.stack for k in range(len(layer.params))]

    def loss(rows: np.ndarray) -> float:
        p = probe.forward(x[rows])
        return float(-np.log(np.maximum((p * goal[rows]).sum(1), 1e-12)).mean()) if classes else float(((p - goal[rows]) ** 2).mean())

    moments = [(np.zeros_like(layer.params[k]), np.zeros_like(layer.params[k])) for layer, k in params]
    best, kept, waited, step = math.inf, None, 0, 0
    for epoch in range(epochs):
        rate = lr * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        sums, seen = [np.zeros_like(m) for m, _ in moments], 0
        for at in range(0, len(train), batch):
            rows = train[at : at + batch]
            probe.backward((probe.forward(x[rows], draw) - goal[rows]) / len(rows))
            for s, (layer, k) in zip(sums, params):
                s += layer.grads[k]
            seen += 1
            if seen % accumulate and at + batch < len(train):
                continue
            step += 1
            for s, (m, v), (layer, k) in zip(sums, moments, params):
                g = s / accumulate
                m[...] = 0.9 * m + 0.1 * g
                v[...] = 0.999 * v + 0.001 * g * g
                layer.params[k] -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * layer.params[k] * (k < layer.decayed))
                s[...] = 0
        draw.shuffle(train)
        now = loss(held)
        if now < best - 1e-6:
            best, kept, waited = now, copy.deepcopy(probe.stack), 0
        else:
            waited += 1
            if waited >= patience:
                break
    probe.stack = kept if kept is not None else probe.stack
    for layer in probe.stack:  # what the last rows left behind isn't part of the state
        for name in {"x", "slope", "kept", "z", "w"} & layer.__dict__.keys():
            setattr(layer, name, None)
    return probe


def probes(rows: DataFrame, by: Sequence[str], classes: int, kind: str = "mlp", train: str = "train", most_rows: int = 20_000, **how) -> DataFrame:
    """One probe per group (a language, a layer): (by, doc_id, label, prediction, error).

    ``rows``: by, doc_id, split, label, embedding. A group is one probe and fits on at most
    ``most_rows`` training rows, the first by hashed id; only those are gathered. All rows of other
    splits are predicted where they are. A failure stays in its group: one row without a document
    reports it in ``error``.
    """
    spark = rows.sparkSession
    ship(spark)
    names, kinds = list(by), dict(rows.dtypes)
    key = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    learn = rows.where(F.col("split") == train).withColumn("__h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).withColumn("__key", key)
    # A bound on the hash leaves some more than ``most_rows`` of a large group; the rest never moves.
    counts = learn.groupBy("__key").agg(F.count("*").alias("__n"))
    few = learn.join(F.broadcast(counts) if counts.count() <= 10_000 else counts, "__key").where(F.col("__h") <= F.least(F.lit(1.0), (most_rows + 10.0 * most_rows**0.5) / F.col("__n")) * (1 << 30))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.sort_values(["__h", "doc_id"]).head(most_rows)
        out = one[[*names, "__key"]].head(1).copy()
        out["probe"], out["error"] = None, None
        try:
            x, y = np.stack(one["embedding"].to_numpy()).astype(float), one["label"].to_numpy(float)
            more = {k: v for k, v in how.items() if k != "hidden"}
            out["probe"] = [pickle.dumps(mlp(x, y, classes, hidden=() if kind == "linear" else how.get("hidden", (64,)), **more))]
        except Exception as e:  # the group's failure is its result
            out["error"] = f"{type(e).__name__}: {e}"
        return out

    groups = ", ".join(f"{n} {kinds[n]}" for n in names)
    scratch = Scratch(spark, "probes")
    fitted = scratch.keep(few.select(*names, "__key", "__h", "doc_id", "label", "embedding").groupBy("__key").applyInPandas(fit, f"{groups}, __key string, probe binary, error string"), "fitted")
    test = rows.where(F.col("split") != train).select(*names, "doc_id", F.col("label").cast("double").alias("label"), "embedding", key.alias("__key"))
    schema = f"{groups}, doc_id {kinds['doc_id']}, label double, prediction double, error string"
    none = F.lit(None)
    untrained = test.select(*names, "__key").distinct().join(fitted.select("__key"), "__key", "left_anti").select(*names, F.lit("ValueError: no training rows").alias("error"))
    failed = fitted.where("probe IS NULL").select(*names, "error").unionByName(untrained)
    out = failed.select(*names, none.cast(kinds["doc_id"]).alias("doc_id"), none.cast("double").alias("label"), none.cast("double").alias("prediction"), "error")
    # Probes go to the workers in lots of bounded size; most runs have one.
    sizes = fitted.where("probe IS NOT NULL").select("__key", F.length("probe").alias("n")).orderBy("__key").collect()
    lots: list[list[str]] = [[]]
    size = 0
    for r in sizes:
        if size + r["n"] > SENT and lots[-1]:
            lots.append([])
            size = 0
        lots[-1].append(r["__key"])
        size += r["n"]
    for lot in lots:
        if lot:
            out = out.unionByName(_predicted(test, fitted, lot, names, classes, schema))
    return out


def _predicted(test: DataFrame, fitted: DataFrame, lot: list[str], names: list[str], classes: int, schema: str) -> DataFrame:
    spark = test.sparkSession
    sent = spark.sparkContext.broadcast({r["__key"]: bytes(r["probe"]) for r in fitted.where(F.col("__key").isin(lot)).collect()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, Probe] = {}
        for pdf in batches:
            pdf["prediction"], pdf["error"] = math.nan, None
            for key, at in pdf.groupby("__key").indices.items():
                try:
                    if key not in ready:
                        ready[key] = pickle.loads(sent.value[key])
                    p = ready[key](np.stack(pdf["embedding"].iloc[at].to_numpy()).astype(float))
                    pdf.iloc[at, pdf.columns.get_loc("prediction")] = p.argmax(1).astype(float) if classes else p.reshape(-1)
                except Exception as e:  # the group's failure is its result
                    pdf.iloc[at, pdf.columns.get_loc("error")] = f"{type(e).__name__}: {e}"
            yield pdf[[*names, "doc_id", "label", "prediction", "error"]]

    return test.where(F.col("__key").isin(lot)).mapInPandas(run, schema)
