"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. A line's potential comes from features of the line and of the lines before
and after it; neighbouring labels have potentials of their own. Forward-backward gives each line's
probability of being good, and the mean of those, weighted by line length, is the document's
evidence, which a logistic curve turns into the score.

Only documents have labels, so training starts with every line labelled like its document, then
twice relabels the lines of bad documents that the field itself takes for good.

Defined results
---------------
* A null text counts as empty; an empty text is one empty line and is scored like any other. Rows
  with a null doc_id are scored and count as held out; repeated rows score alike.
* Labels that are null, and labels of ids that ``documents`` lacks, teach nothing; of several labels
  of one id the largest holds. If only one class was labelled, every score is that class; without
  labels it is 1.
* An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns
  may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, claim, fold, read, ship
from .tokens import batches as slices
from .toxicity import logistic

#: Labelled documents used for fitting: at most so many of each class.
SAMPLE = 1500
#: Classes of bytes that are counted in a line.
CLASSES = ("lower", "upper", "digit", "space", "stop", "bang", "bar", "symbol", "other ASCII", "beyond ASCII")


def _byte_classes() -> np.ndarray:
    out = np.full(256, 8, dtype=np.uint8)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"?-()", b"!", b"|", b"*#$%&@^~=+<>{}[]\\/_`")):
        out[list(chars)] = k
    out[128:] = 9
    return out


_CLASS = _byte_classes()
_RANDOM = np.random.default_rng(3).integers(1, 1 << 62, 256, dtype=np.uint64)
WIDTH = len(CLASSES) + 6


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, length in bytes of each line, features of each line)."""
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.flatnonzero(flat == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    owner = np.searchsorted(np.cumsum([len(r) for r in raw]), ends, side="right")
    length = ends - starts
    line = np.repeat(np.arange(len(ends)), length + 1)
    n = len(ends)
    kind = _CLASS[flat]
    counts = np.bincount(line * len(CLASSES) + kind, minlength=n * len(CLASSES)).reshape(n, len(CLASSES)).astype(np.float64)
    counts[np.arange(n), _CLASS[10]] -= 1  # the line's end itself
    size = np.maximum(length, 1)[:, None]
    # Words: a hash of their bytes, and whether the word before on the line is the same.
    space = (kind == 3) | (flat == 10)
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    words = np.zeros(n)
    again = np.zeros(n)
    if len(first):
        place = np.arange(len(flat), dtype=np.int64)
        place -= np.repeat(first, np.diff(np.concatenate([first, [len(flat)]]))) if first[0] == 0 else np.concatenate([place[: first[0]], np.repeat(first, np.diff(np.concatenate([first, [len(flat)]])))])
        value = np.where(space, np.uint64(0), _RANDOM[flat] * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        h = np.add.reduceat(value, first)
        of = line[first]
        words = np.bincount(of, minlength=n).astype(np.float64)
        same = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        again = np.bincount(of[1:][same], minlength=n).astype(np.float64)
    text_lines = np.bincount(owner, minlength=len(texts))
    more = np.stack([
        np.log1p(length) / 8, again / np.maximum(words - 1, 1), length / np.maximum(words, 1) / 20, (length == 0).astype(float),
        counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1), counts[:, 4] / np.maximum(words, 1),
    ], 1)
    return text_lines, length, np.concatenate([counts / size, more], 1)


def with_neighbours(lines: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (zero at the ends of a text), and a one."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    first = np.concatenate([[0], np.cumsum(lines)[:-1]])
    before[first], after[np.cumsum(lines) - 1] = 0, 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], 1)


def marginals(lines: np.ndarray, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all texts at once: P(good) of each line, edge expectations, log Z.

    ``node`` is the potential of good over bad of each line; ``edge`` the 2 x 2 log potentials. Texts
    stand in order of falling line count, so at each step those still running are a prefix.
    """
    order = np.argsort(-lines, kind="stable")
    start = (np.cumsum(lines) - lines)[order]
    size = lines[order]
    top = int(size[0])
    live = np.searchsorted(-size, -np.arange(top), side="left")  # texts with more than t lines
    psi = np.exp(edge)
    forward = np.zeros((len(node), 2))
    log_z = 0.0
    state = None
    for t in range(top):
        at = start[: live[t]] + t
        local = np.stack([np.ones(len(at)), np.exp(np.clip(node[at], -50, 50))], 1)
        state = local if t == 0 else (state[: live[t]] @ psi) * local
        total = state.sum(1, keepdims=True)
        log_z += float(np.log(total).sum())
        state = state / total
        forward[at] = state
    back = np.ones((len(order), 2))
    good = np.zeros(len(node))
    pairs = np.zeros((2, 2))
    for t in range(top - 1, -1, -1):
        at = start[: live[t]] + t
        if t + 1 < top:
            k = live[t + 1]
            nxt = at[:k] + 1
            local = np.stack([np.ones(k), np.exp(np.clip(node[nxt], -50, 50))], 1) * back[:k]
            joint = forward[at[:k]][:, :, None] * psi[None] * local[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pairs += joint.sum(0)
            up = local @ psi.T
            back[:k] = up / up.sum(1, keepdims=True)
        p = forward[at] * back[: live[t]]
        good[at] = p[:, 1] / p.sum(1)
    return good, pairs, log_z


class LineField:
    def __init__(self, mean: np.ndarray, std: np.ndarray):
        self.mean, self.std = mean, std
        self.weights = np.zeros(3 * WIDTH + 1)
        self.edge = np.zeros((2, 2))
        self.slope, self.shift = 1.0, 0.0

    def potentials(self, lines: np.ndarray, x: np.ndarray) -> np.ndarray:
        return with_neighbours(lines, (x - self.mean) / self.std) @ self.weights

    def evidence(self, lines: np.ndarray, length: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Log odds of each text's length-weighted mean probability of good lines."""
        good, _, _ = marginals(lines, self.potentials(lines, x), self.edge)
        owner = np.repeat(np.arange(len(lines)), lines)
        w = np.maximum(length, 1)
        mean = np.bincount(owner, weights=good * w) / np.bincount(owner, weights=w)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.slope * self.evidence(*line_features(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def climb(self, lines: np.ndarray, x: np.ndarray, y: np.ndarray, line_weight: np.ndarray, steps: int = 80, ridge: float = 1e-3) -> None:
        """Adam on the penalised log likelihood of the line labels ``y``."""
        f = with_neighbours(lines, (x - self.mean) / self.std)
        inner = np.ones(len(y) - 1, dtype=bool)
        inner[(np.cumsum(lines) - 1)[:-1]] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][inner], y[1:][inner]), 1)
        m = [np.zeros_like(self.weights), np.zeros((2, 2))]
        s = [np.zeros_like(self.weights), np.zeros((2, 2))]
        for t in range(1, steps + 1):
            good, pairs, _ = marginals(lines, f @ self.weights, self.edge)
            grads = [f.T @ (line_weight * (y - good)) / len(y) - ridge * self.weights, (seen - pairs) / len(y) - ridge * self.edge]
            for k, (value, grad) in enumerate(zip((self.weights, self.edge), grads)):
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.99 * s[k] + 0.01 * grad**2
                value += 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)


def fit(texts: list[str], label: np.ndarray, turns: int = 2) -> LineField:
    """Fits on texts and 0/1 labels; both classes must be there."""
    lines, length, x = line_features(texts)
    field = LineField(x.mean(0), np.maximum(x.std(0), 1e-3))
    owner = np.repeat(np.arange(len(lines)), lines)
    whole = label[owner]
    y = whole.copy()
    for turn in range(turns + 1):
        field.climb(lines, x, y, np.ones(len(y)))
        good, _, _ = marginals(lines, field.potentials(lines, x), field.edge)
        y = np.where((whole == 0) & (good > 0.5), 1, whole)
        none = np.bincount(owner, weights=1 - y)[owner] == 0  # a bad text keeps a bad line at least
        y = np.where(none & (whole == 0), 0, y)
    z = field.evidence(lines, length, x)
    field.slope, field.shift = map(float, logistic(z[:, None], label.astype(float)))
    return field


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> LineField | float:
    """Fits on at most ``sample`` labelled documents of each class, none of them held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(label).alias("y"))
    rows = []
    for value in (0, 1):
        chosen = bounded_sample(known.where(F.col("y") == value), "doc_id", sample, seed=1)
        rows += docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("doc_id").select("text", "y").collect()
    y = np.array([r["y"] for r in rows])
    if len(set(y.tolist())) == 2:
        field = fit([r["text"] or "" for r in rows], y)
        # The curve was fitted with classes of equal weight; their real shares shift it.
        shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
        field.shift += math.log(shares[1] / shares[0])
        return field
    return float(y[0]) if len(y) else 1.0


def score(docs: DataFrame, field: LineField | float, threshold: float = 0.3) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        f = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            got = [f.scores(texts[a:b]) for a, b in slices(texts, 2_000_000)] if isinstance(f, LineField) else [np.full(len(texts), f)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.concatenate([*got, np.zeros(0)]), pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, learn(docs, read(spark, sf_dir, "labels")))
