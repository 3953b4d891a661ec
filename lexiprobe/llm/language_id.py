"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is the product (binding) of its letters'
vectors, each rotated by its place; a document is the sum (bundle) of its n-grams, and a language
the sum of the unit vectors of its training documents. A document has the language whose prototype
is nearest by cosine. Runs of characters that are no letters count as one separator.

Defined results
---------------
* A text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be
  learned. Rows with a null doc_id count as held out; repeated rows get equal results.
* Equal cosines fall to the language that is first by code point. Training documents without text,
  letters or language teach nothing. An empty table gives an empty result. Only ``doc_id``, ``text``
  and, for training, ``lang`` are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, fold, read, ship

#: Components of a vector, letters of an n-gram.
DIMENSIONS, GRAM = 512, 3
#: Training documents of a language: all, or about so many of them by hashed id.
SAMPLE = 1000
#: Characters whose counts are held at a time.
_CHARS = 1_500_000
_cache: dict[str, object] = {}


def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    if "letters" not in _cache:
        _cache["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _cache["letters"]


def _vector(letter: int) -> np.ndarray:
    """The random vector of a code point (0: separator); the same in every process."""
    known = _cache.setdefault("vectors", {})
    if letter not in known:
        known[letter] = np.random.default_rng((7, letter)).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)
    return known[letter]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram of the texts: its text's place in the list and its code points as one number."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    flat = np.concatenate(points)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in points])
    flat = np.where(_letters()[np.minimum(flat, 0x10FFFF)], flat, 0).astype(np.uint64)
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0) | (owner[1:] != owner[:-1])
    flat, owner = flat[keep], owner[keep]
    if len(flat) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = np.zeros(len(flat) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        code = (code << np.uint64(21)) | flat[k : len(flat) - GRAM + 1 + k]
    inside = owner[GRAM - 1 :] == owner[: len(code)]
    return owner[: len(code)][inside], code[inside]


def _bound(codes: np.ndarray) -> np.ndarray:
    """The vectors of n-grams: rotated letter vectors, multiplied."""
    out = np.ones((len(codes), DIMENSIONS), dtype=np.int8)
    for k in range(GRAM):
        letters, at = np.unique((codes >> np.uint64(21 * (GRAM - 1 - k))) & np.uint64(0x1FFFFF), return_inverse=True)
        out *= np.stack([np.roll(_vector(int(c)), k) for c in letters])[at]
    return out


def bundles(texts: list[str]) -> np.ndarray:
    """A row per text: the sum of its n-grams' vectors, at unit length (zero without letters)."""
    owner, code = _grams(texts)
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    if len(code):
        used, at = np.unique(code, return_inverse=True)
        for a in range(0, len(used), 4096):  # so many n-grams' vectors at a time
            here = (at >= a) & (at < a + 4096)
            width = min(4096, len(used) - a)
            counts = np.bincount(owner[here] * width + (at[here] - a), minlength=len(texts) * width).reshape(len(texts), width)
            out += counts.astype(np.float32) @ _bound(used[a : a + 4096]).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHARS or i - at >= 1023:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if not text.isascii() else not text.upper() == text.lower()


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Prototype by language, from documents that are not held out."""
    ship(docs.sparkSession)
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    share = train.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("__share"))
    chosen = train.select("doc_id", "text", "lang").join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("__share") * (1 << 20))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _parts(texts):
                for lang, v in zip(langs[a:b], bundles(texts[a:b])):
                    total.setdefault(lang, np.zeros(DIMENSIONS))
                    total[lang] += v
        rows = sorted(total.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.string()), pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32()), pa.array([v for _, v in rows], pa.list_(pa.float64()))], names=["lang", "part", "v"]
        )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "v": [np.sum(list(pdf.sort_values("part")["v"]), axis=0)]})

    rows = chosen.select("lang", "text").mapInArrow(sums, "lang string, part int, v array<double>").groupBy("lang").applyInPandas(add, "lang string, v array<double>").collect()
    return {r["lang"]: np.array(r["v"]) for r in sorted(rows, key=lambda r: r["lang"]) if np.any(r["v"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score (the cosine, 0 at least)."""
    ship(docs.sparkSession)
    names = list(prototypes)
    table = np.stack([v / np.linalg.norm(v) for v in prototypes.values()]).astype(np.float32) if names else None
    sent = docs.sparkSession.sparkContext.broadcast((names, table))  # a vector a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        langs, protos = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found, scores = ["und"] * len(texts), [0.0] * len(texts)
            for a, b in _parts(texts) if langs else ():
                cosines = bundles(texts[a:b]) @ protos.T
                best = cosines.argmax(1)
                for i in range(a, b):
                    if has_letter(texts[i]):
                        found[i], scores[i] = langs[best[i - a]], float(min(1.0, max(0.0, cosines[i - a, best[i - a]])))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
