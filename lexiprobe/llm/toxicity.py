"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of a lower-cased text, hashed to a fixed number of cells and present or
not. Each cell is scaled by the log ratio of its smoothed counts in the toxic and the other training
texts, and logistic regression is fitted on the scaled features. Two margins of that one linear model
make the score: that of the whole text, as it was trained, and that of the strongest window of
characters, so that a passage counts alike in short and in long texts. A logistic curve over both,
fitted on margins of texts that their model did not see, weighs them.

Defined results
---------------
* A null text counts as empty; a text without n-grams has the score of no evidence. Rows with a null doc_id are scored and count as held out; repeated rows score alike.
* Labels other than 0 and 1, and labels of ids that ``documents`` lacks, teach nothing; of several
  labels of one id the largest holds, of several texts of one id the smallest. Without labels of both kinds all scores are 0.
* An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns
  may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, claim, fold, read, ship

#: Orders of the n-grams, in code points.
ORDERS = (3, 4, 5)
#: Cells that n-grams are hashed to.
CELLS = 1 << 18
#: Labelled texts used for fitting: at most so many of each class.
SAMPLE = 1500
#: Characters of a window whose evidence is joined.
WINDOW = 24
_MUL = np.uint64(0x9E3779B97F4A7C15)


def ngram_cells(text: str, orders: tuple[int, ...] = ORDERS) -> list[np.ndarray]:
    """For each order the cell of the n-gram that starts at each character."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = []
    for n in orders:
        if len(points) < n:
            out.append(np.zeros(0, np.int64))
            continue
        h = np.full(len(points) - n + 1, np.uint64(n))
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * _MUL
            h ^= h >> np.uint64(31)
        out.append((h >> np.uint64(64 - 18)).astype(np.int64))
    return out


class NbLinear:
    """A linear model of a text's n-grams, and the curve from its margins to a score.

    ``weights``: ratio times coefficient by cell; ``used``: cells with a ratio. ``curve``: what the
    margin of the whole text, that of its strongest window, and one weigh in the score's logit.
    """

    def __init__(self, weights: np.ndarray, used: np.ndarray, bias: float, curve: np.ndarray):
        self.weights, self.used, self.bias, self.curve = weights.astype(np.float32), used, bias, curve

    def margins(self, text: str) -> tuple[float, float]:
        """The trained margin of the whole text, and the largest sum of weights over any window of characters."""
        cells = ngram_cells(text)
        if not len(cells[0]):
            return self.bias, 0.0
        there = np.concatenate(cells)
        there = np.unique(there[self.used[there]])
        whole = float(self.weights[there].sum(dtype=np.float64)) / max(len(there), 1) ** 0.5 + self.bias
        total = np.zeros(len(cells[0]), dtype=np.float64)
        for c in cells:
            total[: len(c)] += self.weights[c]
        run = np.concatenate([[0.0], np.cumsum(total)])
        width = min(WINDOW, len(total))
        return whole, float((run[width:] - run[:-width]).max())

    def score(self, text: str) -> float:
        whole, window = self.margins(text)
        a, b, c = self.curve
        return float(1.0 / (1.0 + np.exp(-np.clip(a * whole + b * window + c, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients (the last one is the intercept's) by Newton's method; the classes weigh alike."""
    w = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    scale = np.append(np.maximum(x.std(0), 1e-9), 1.0)
    a = np.concatenate([x, np.ones((len(x), 1))], 1) / scale
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b)), a.T @ (w * (p - y)) + ridge * b)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return b / scale


def log_count_ratios(present: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, least: float = 1.0, rare: float = 0.003) -> np.ndarray:
    """By cell, how much likelier it is in toxic texts: log of the ratio of smoothed shares.

    Cells that say little either way (below ``least``), or that too few texts hold to tell from
    chance (a share ``rare`` of all, and two), have none: it keeps long texts clean.
    """
    p, q = np.full(CELLS, alpha), np.full(CELLS, alpha)
    for cells, kind in zip(present, y):  # a text's cells are distinct
        (p if kind == 1 else q)[cells] += 1
    ratio = np.log(p / (y.sum() + 2 * alpha)) - np.log(q / ((1 - y).sum() + 2 * alpha))
    ratio[(np.abs(ratio) < least) | (p + q - 2 * alpha < max(2, rare * len(present)))] = 0.0
    return ratio


def fit_linear(present: list[np.ndarray], y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> NbLinear:
    """Ridge-penalised logistic regression on the scaled n-grams of each text, its row divided by the root of their number."""
    ratio = log_count_ratios(present, y)
    there = [c[ratio[c] != 0] for c in present]  # far fewer than all n-grams
    rows = np.repeat(np.arange(len(present)), [len(c) for c in there])
    cells = np.concatenate(there)
    used, at = np.unique(cells, return_inverse=True)
    r = ratio[used]
    norm = np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(present))))[rows]
    value = r[at] / norm
    class_weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    coef, bias = np.zeros(len(used)), 0.0
    v1 = v2 = np.zeros(len(used))
    for t in range(1, steps + 1):  # Adam
        z = np.bincount(rows, weights=value * coef[at], minlength=len(present)) + bias
        g = class_weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.bincount(at, weights=value * g[rows], minlength=len(used)) + ridge * coef / len(y) / 10
        v1, v2 = 0.9 * v1 + 0.1 * grad, 0.99 * v2 + 0.01 * grad * grad
        coef = coef - 0.2 * (v1 / (1 - 0.9**t)) / (np.sqrt(v2 / (1 - 0.99**t)) + 1e-8)
        bias -= 0.2 * g.sum()
    weights = np.zeros(CELLS)
    weights[used] = r * coef
    return NbLinear(weights, ratio != 0, bias, np.array([1.0, 0.0, 0.0]))


def fit(texts: list[str], toxic: np.ndarray, share: float = 0.5) -> NbLinear:
    """Fits on texts and 0/1 labels; both classes must be there. ``share``: toxic ones among all labels.

    The curve is fitted on margins that models of the other half of the texts gave, with classes of
    equal weight; their real shares then shift it. If no n-gram tells the classes apart, the score is
    that share, and below one half.
    """
    present = [np.unique(np.concatenate(ngram_cells(t))).astype(np.int32) for t in texts]
    y = toxic.astype(np.float64)
    model = fit_linear(present, y)
    half = np.zeros(len(texts), dtype=np.int64)
    for value in (0, 1):  # alternating within each class
        half[y == value] = np.arange(int((y == value).sum())) % 2
    x = np.zeros((len(texts), 2))
    for h in (0, 1):
        learn_on, apply_to = np.flatnonzero(half != h), np.flatnonzero(half == h)
        one = fit_linear([present[i] for i in learn_on], y[learn_on]) if 0 < y[learn_on].sum() < len(learn_on) else model
        x[apply_to] = [one.margins(texts[i]) for i in apply_to]
    if model.used.any():
        curve = logistic(x, y)
        model.curve = curve + np.array([0.0, 0.0, np.log(share / (1 - share))])
    else:
        share = min(share, 0.49)
        model.curve = np.array([0.0, 0.0, np.log(share / (1 - share))])
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> NbLinear | None:
    """Fits on at most ``sample`` labelled texts of each class, none of them held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(label).alias("y"))
    rows = []
    for value in (0, 1):
        chosen = bounded_sample(known.where(F.col("y") == value), "doc_id", sample)
        rows += docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("doc_id").select("text", "y").collect()
    y = np.array([r["y"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    return fit([r["text"] for r in rows], y, shares[1] / (shares[0] + shares[1]))


def score(docs: DataFrame, model: NbLinear | None) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted (1 from a score of one half)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # CELLS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        m = sent.value
        for batch in batches:
            scores = [m.score(t or "") if m else 0.0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier does not reject, each by its own text, with the columns of ``docs``."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        m = sent.value
        for batch in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):  # whole rows are large
            yield batch.filter(pa.array([not m or m.score(t or "") < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, learn(docs, read(spark, sf_dir, "labels")))
