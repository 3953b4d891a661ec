"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are centred and rotated (principal axes, then iterative quantisation), and the signs of the
components are their codes. A code is cut into substrings of 8 bits, and each substring has an index
from value to vectors. By the pigeonhole principle every code within Hamming distance
parts * (s + 1) - 1 of the query's has a substring within distance s, so probing the substrings'
values within s finds all of them; they are then ranked by the distance of the original vectors.

The probing radius grows until it covers the Hamming distance that, on the fitting sample, all but a
few pairs as near as the k-th best neighbour so far stay below. So a query is answered by its own
distances: neither the number of candidates nor the radius is a fixed cap.

Every row is indexed. Rows are dealt into blocks of bounded size, queries into blocks as well, and
each pair of blocks is one task of the same size; the k best of each block are merged at the end.

Defined results
---------------
* Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
  vectors whose length is not the most frequent one. Rows with a null vec_id take no part.
* Ties in distance fall to the smaller vec_id. Of equal vectors only those of the k + 1 smallest ids
  can be among anyone's k nearest, and of equal rows only k, so only those are searched; the result is
  that of searching all. An id is listed once for each of its rows, never for a query of that id. An
  id of several vectors asks with the smallest of them, component by component.
* With fewer candidates than k a query has all of them. An empty table gives an empty result. Only
  ``vec_id`` and ``embedding`` are read, so further columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, read

#: Rows the codes are learned from, at most.
SAMPLE = 4000
#: Rows and queries of a block, about: a vector is copied once for each block of queries, a query once
#: for each block of rows, so both are as large as a task can hold. Tables that a few tasks could hold
#: are cut finer, into SPREAD blocks or blocks of FINE rows.
BLOCK, QUERIES = 1 << 17, 1 << 15
FINE, SPREAD = 1 << 14, 64
BITS, PART = 64, 8
_POP = np.array([bin(v).count("1") for v in range(256)], dtype=np.uint8)
#: The values of a substring by their number of bits: probing distance s flips these.
_FLIPS = [np.flatnonzero(_POP == s) for s in range(PART + 1)]


class Codes:
    """Centre, rotation, and how Hamming distance follows distance on the fitting sample."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, seed: int = 5, turns: int = 30, sure: float = 1.75):
        self.centre = sample.mean(0)
        x = sample - self.centre
        _, axes = np.linalg.eigh(x.T @ x / max(len(x), 1))
        draw = np.random.default_rng(seed)
        d = x.shape[1]
        axes = axes[:, ::-1][:, : min(bits, d)]
        if d < bits:  # more bits than axes: random directions within their span
            axes = axes @ np.linalg.qr(draw.standard_normal((bits, d)))[0].T
            turn = np.eye(bits)
        else:
            turn = np.linalg.qr(draw.standard_normal((bits, bits)))[0]
            v = x @ axes
            for _ in range(turns):
                u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
                turn = (u @ w).T
        self.map = axes @ turn
        self.bits = bits
        self._calibrate(sample, sure)

    def _calibrate(self, sample: np.ndarray, sure: float) -> None:
        """Line and spread of Hamming distance over the pairs nearest to each sampled row."""
        some = sample[: min(len(sample), 512)]
        codes, words = self.codes(sample), self.codes(some)
        near, apart = [], []
        for v, c in zip(some, words):
            d = np.sqrt(((sample - v) ** 2).sum(1))
            best = np.argsort(d, kind="stable")[: max(11, len(sample) // 20)]
            best = best[d[best] > 0]
            near.append(d[best])
            apart.append(_POP[codes[best] ^ c].sum(1))
        d, h = np.concatenate(near), np.concatenate(apart).astype(float)
        if len(d) < 2 or d.std() == 0:
            self.slope, self.base, self.spread = 0.0, float(self.bits), 0.0
            return
        self.slope = float(((d - d.mean()) * (h - h.mean())).mean() / d.var())
        self.base = float(h.mean() - self.slope * d.mean())
        self.spread = sure * float((h - self.slope * d - self.base).std())

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.centre) @ self.map >= 0, axis=1)

    def radius(self, distance: float) -> float:
        """The Hamming distance that pairs this near stay below."""
        return self.base + self.slope * distance + self.spread


class BlockIndex:
    """The substring indexes of one block of vectors, in order of their ids."""

    def __init__(self, model: Codes, ids: np.ndarray, x: np.ndarray):
        self.model, self.ids, self.x = model, ids, x
        self.words = model.codes(x)
        self.order = [np.argsort(w, kind="stable").astype(np.int32) for w in self.words.T]
        self.bounds = [np.searchsorted(w[o], np.arange(257)).astype(np.int64) for w, o in zip(self.words.T, self.order)]

    def _probe(self, word: np.ndarray, s: int) -> np.ndarray:
        """Places of all vectors with a substring at distance s of the query's."""
        got = []
        for p, v in enumerate(word):
            values = np.bitwise_xor(_FLIPS[s], int(v))
            a, b = self.bounds[p][values], self.bounds[p][values + 1]
            n = b - a
            if total := int(n.sum()):
                got.append(self.order[p][np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)])
        return np.concatenate(got) if got else np.zeros(0, np.int32)

    def nearest(self, query_id: int, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k best of this block, nearest first."""
        word = self.model.codes(v[None])[0]
        parts = len(word)
        seen = np.zeros(len(self.ids), dtype=bool)
        waiting = np.zeros(0, np.int64)  # found, but beyond the radius that is complete
        best_i, best_d = np.zeros(0, np.int64), np.zeros(0)
        for s in range(PART + 1):
            new = self._probe(word, s)
            new = np.unique(new[~seen[new]])
            seen[new] = True
            waiting = np.concatenate([waiting, new])
            within = parts * (s + 1) - 1
            apart = _POP[self.words[waiting] ^ word].sum(1)
            now, waiting = waiting[apart <= within], waiting[apart > within]
            now = now[self.ids[now] != query_id]
            d = np.sqrt(((self.x[now] - v) ** 2).sum(1))
            best_i, best_d = np.concatenate([best_i, self.ids[now]]), np.concatenate([best_d, d])
            order = np.lexsort((best_i, best_d))[:k]
            best_i, best_d = best_i[order], best_d[order]
            if len(best_i) == k and within >= self.model.radius(best_d[-1]):
                break
        return best_i, best_d


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, in double precision."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(finite & F.exists("v", lambda x: x != 0))


def block_rows(n: int) -> int:
    """Rows of a block for a table of n."""
    return min(BLOCK, max(FINE, -(-n // SPREAD)))


def search(vectors: DataFrame, every: int = 100, k: int = 10, sample: int = SAMPLE, block: int | None = None, queries: int = QUERIES) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    result = "query_id long, rank int, vec_id long, score double"
    rows = scratch.keep(usable(vectors).select("vec_id", "v", F.xxhash64("v").alias("same")), "rows")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("v") == sizes["d"])
    n, n_queries = sizes["count"], rows.where(F.col("vec_id") % every == 0).select("vec_id").distinct().count()
    blocks, parts = -(-n // (block or block_rows(n))), max(1, -(-n_queries // queries))
    drawn = bounded_sample(rows, "vec_id", sample, seed=2).orderBy("vec_id").select("v").collect()
    model = Codes(np.array([r["v"] for r in drawn]), BITS)
    # Of equal vectors those of the k + 1 smallest ids, in two steps, so that no group meets in one task.
    distinct = rows.groupBy("vec_id", "same", "v").agg(F.count("*").alias("copies"))
    salted = distinct.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).alias("block"))
    few = salted.withColumn("at", F.row_number().over(W.partitionBy("same", "v", "salt").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    few = few.withColumn("at", F.row_number().over(W.partitionBy("same", "v").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    few = few.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts))
    # Each block of rows meets each block of queries: one stated query set against all rows.
    left = few.select("vec_id", "v", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(False).alias("asks"))
    right = asked.select("vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), part.alias("part"), F.lit(True).alias("asks"))
    sent = spark.sparkContext.broadcast(model)  # a few matrices of d x bits

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        stored = pdf[~pdf["asks"]].sort_values("vec_id")
        asking = pdf[pdf["asks"]].sort_values("vec_id")
        out = []
        if len(stored) and len(asking):
            index = BlockIndex(sent.value, stored["vec_id"].to_numpy(), np.stack(stored["v"].to_numpy()))
            for q, v in zip(asking["vec_id"], asking["v"]):
                ids, distances = index.nearest(q, v, k)
                out += [(q, i, d) for i, d in zip(ids.tolist(), distances.tolist())]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    met = left.unionByName(right).groupBy("block", "part").applyInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))
