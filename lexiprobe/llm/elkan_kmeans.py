"""Centroid clustering by Elkan's bounds, exact to the last integer.

Components become integers, floor(scale * x), so distances, sums and centroids are integers and every
run gives the same result. Each vector carries an upper bound of its distance to its own centroid and
a lower bound for each of the k centroids; when centroids move, the bounds give way by as much. A
centroid is left out for a vector only if its lower bound, or half its distance from the vector's own
centroid, lies strictly above the upper bound: ties are always computed. Bounds are rounded outwards,
so no rounding can hide a nearer centroid; whatever they leave is decided by exact squared distances.

Vectors never move: each round maps the table of vectors and bounds into the next one, below the
shared folder, and only the vectors that changed their cluster are read again, to add to and take
from the sums. Between tasks and driver go k centroids and k sums, whatever the number of vectors.

Defined results
---------------
* Vectors that are null, have another number of components than ``dims``, or hold null or non-finite
  components are not kept: they have no row. Components beyond 2 ** 27 after scaling raise an error,
  since squared distances would leave the range of a long.
* Rows with a null vec_id are clustered like others but start a centroid only if too few others are
  there. Repeated rows are vectors of their own; equal hashes fall to the smaller vector.
* With fewer kept vectors than k each starts a centroid. Centroids without vectors stay where they
  are. Ties fall to the smaller centroid. An empty table gives an empty result. Only ``vec_id`` and
  ``embedding`` are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, claim, read

#: The largest size of a scaled component: 64 squared differences of twice that fit into a long.
LARGEST = 1 << 27
_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
_STATE = "vec_id long, x binary, was int, cluster int, upper double, lower binary"


def _up(x: np.ndarray) -> np.ndarray:
    """At least the true value, where x is off by an ulp or so."""
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf), -np.inf), 0.0)


def _narrow(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are not above x."""
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x from c (one centroid, or one for each row)."""
    apart = x - c
    return np.einsum("ij,ij->i", apart, apart)


class Bounds:
    """Centroids of one round, how far they moved and how far they lie from each other."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c = centroids
        self.moved = np.zeros(len(centroids)) if before is None else _up(np.sqrt(squared(centroids, before).astype(np.float64)))
        if before is not None:
            self.moved[(centroids == before).all(1)] = 0.0
        self.apart = np.stack([_down(np.sqrt(squared(centroids, c).astype(np.float64))) for c in centroids])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower) of vectors without bounds: all distances are computed."""
        lower = np.empty((len(x), len(self.c)), np.float32)
        best, cluster = None, np.zeros(len(x), np.int32)
        for j, c in enumerate(self.c):
            d = squared(x, c)
            lower[:, j] = _narrow(_down(np.sqrt(d.astype(np.float64))))
            nearer = np.ones(len(x), bool) if best is None else d < best
            best = d if best is None else np.where(nearer, d, best)
            cluster[nearer] = j
        return cluster, _up(np.sqrt(best.astype(np.float64))), lower

    def next(self, x: np.ndarray, was: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, upper, lower, distances computed) after the centroids moved."""
        cluster = was.copy()
        upper = np.where(self.moved[was] > 0, _up(upper + self.moved[was]), upper)
        lower = np.where(self.moved > 0, _narrow(_down(lower.astype(np.float64) - self.moved)), lower)
        open_ = (upper[:, None] >= lower) & (2 * upper[:, None] >= self.apart[was])
        open_[np.arange(len(x)), was] = False
        rows = np.flatnonzero(open_.any(1))
        best = np.zeros(len(x), np.int64)
        best[rows] = squared(x[rows], self.c[was[rows]])
        upper[rows] = _up(np.sqrt(best[rows].astype(np.float64)))
        computed = len(rows)
        for j, c in enumerate(self.c):
            r = rows[open_[rows, j]]
            r = r[(upper[r] >= lower[r, j]) & (2 * upper[r] >= self.apart[cluster[r], j])]
            if not len(r):
                continue
            computed += len(r)
            d = squared(x[r], c)
            root = np.sqrt(d.astype(np.float64))
            lower[r, j] = _narrow(_down(root))
            nearer = (d < best[r]) | ((d == best[r]) & (j < cluster[r]))
            r, d, root = r[nearer], d[nearer], root[nearer]
            best[r], cluster[r], upper[r] = d, j, _up(root)
        return cluster, upper, lower, computed


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, v) of the vectors of ``dims`` finite components, as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") == dims)
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _whole(v: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * v) as integers."""
    with np.errstate(over="ignore"):
        x = np.floor(v * scale)
    if x.size and not np.abs(x).max() <= LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return x.astype(np.int64)


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """Rows of equally long binary values."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    raw, step = rows.tobytes(), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, len(raw) + 1, step, dtype=np.int32)), pa.py_buffer(raw)])


def _state(ids: pa.Array, x: np.ndarray, was: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    columns = [ids, _binary(x.astype("<i4")), pa.array(was, pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper), _binary(lower.astype("<f4"))]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "was", "cluster", "upper", "lower"])


def _assigned(rows: DataFrame, bounds: Bounds, scale: float, first: bool) -> DataFrame:
    """The state after one assignment, from vectors (``first``) or from the state before."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for b in batches:
            if b.num_rows:
                x = _whole(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1), scale)
                yield _state(b.column(0), x, np.full(len(x), -1, np.int32), *bounds.first(x))

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for b in batches:
            if b.num_rows:
                x, was = _matrix(b.column(1), "<i4").astype(np.int64), b.column(2).to_numpy()
                yield _state(b.column(0), x, was, *bounds.next(x, was, b.column(3).to_numpy(), _matrix(b.column(4), "<f4"))[:3])

    return rows.select("vec_id", "v").mapInArrow(start, _STATE) if first else rows.select("vec_id", "x", "cluster", "upper", "lower").mapInArrow(go_on, _STATE)


def _changes(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What each cluster's sum and count gain by the last assignment, from the vectors that moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        gain = np.zeros((k + 1, dims + 1), np.int64)  # the last row is of vectors that had no cluster
        for b in batches:
            if b.num_rows:
                x = np.concatenate([_matrix(b.column(0), "<i4").astype(np.int64), np.ones((b.num_rows, 1), np.int64)], axis=1)
                np.subtract.at(gain, b.column(1).to_numpy(), x)
                np.add.at(gain, b.column(2).to_numpy(), x)
        at, i = np.nonzero(gain[:k])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(i, pa.int32()), pa.array(gain[at, i])], names=["cluster", "i", "gain"])

    moved = state.where("cluster != was").select("x", "was", "cluster").mapInArrow(run, "cluster int, i int, gain long")
    out = np.zeros((k, dims + 1), np.int64)
    for r in moved.groupBy("cluster", "i").agg(F.sum("gain").alias("gain")).collect():  # at most k * (dims + 1) rows
        out[r["cluster"], r["i"]] = r["gain"]
    return out[:, :dims], out[:, dims]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, seed: str = "2") -> DataFrame:
    """A row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the k vectors of smallest sha256 of "<seed>:<vec_id>". ``distance`` is the
    squared one from the vector's final centroid, ``inertia`` their sum over a cluster and over all.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "elkan")
    rows = kept(vectors, dims)
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = rows.orderBy(h.asc_nulls_last(), "v").select("v").limit(k).collect()
    if not start:
        return spark.createDataFrame([], _RESULT)
    c = _whole(np.array([r["v"] for r in start]), scale)
    sums, counts = np.zeros_like(c), np.zeros(len(c), np.int64)
    bounds, state = Bounds(c), rows
    for turn in range(rounds + 1):
        state = scratch.keep(_assigned(state, bounds, scale, turn == 0), f"state-{turn}")
        scratch.drop(f"state-{turn - 1}")
        if turn == rounds:
            break
        more, joined = _changes(state, len(c), dims)
        sums, counts = sums + more, counts + joined
        before, c = c, np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], c)
        if (c == before).all():
            break  # the next assignments would be this one
        bounds = Bounds(c, before)
    return _described(state, c, scratch, f"state-{turn}")


def _described(state: DataFrame, c: np.ndarray, scratch: Scratch, last: str) -> DataFrame:
    """The result's columns, with exact distances from the final centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for b in batches:
            if b.num_rows:
                d = squared(_matrix(b.column(1), "<i4").astype(np.int64), c[b.column(2).to_numpy()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d)], names=["vec_id", "cluster", "distance"])

    placed = scratch.keep(state.select("vec_id", "x", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long"), "placed")
    scratch.drop(last)
    sums = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row a centroid
    total = sum(sums.values())
    named = [(j, d, total, hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j, d in sums.items()]
    about = placed.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def _sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> str:
    """The plain algorithm, a step a table."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(y AS DOUBLE)) AS BIGINT) FOR y IN embedding] AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len([y FOR y IN embedding IF y IS NOT NULL AND isfinite(y)]) = {dims})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < {k})""",
    ]
    nearest = """a{0} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.r, c{0}.c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c{0}.x)]) AS d FROM v CROSS JOIN c{0}) GROUP BY r)"""
    moved = """c{1} AS MATERIALIZED (
  SELECT c{0}.c, coalesce(m.x, c{0}.x) AS x FROM c{0} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
      SELECT a.c, i, sum(v.x[i]) AS s, count(*) AS n FROM v JOIN a{0} AS a USING (r), generate_series(1, {2}) AS g(i) GROUP BY a.c, i) GROUP BY c) AS m ON m.c = c{0}.c)"""
    for t in range(rounds):
        steps += [nearest.format(t), moved.format(t, t + 1, dims)]
    steps.append(nearest.format(rounds))
    return "WITH " + ",\n".join(steps) + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} AS a USING (r) JOIN c{rounds} AS c ON c.c = a.c"""


OP11_SQL = _sql()
