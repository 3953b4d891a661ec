"""Near-duplicate detection by SetSketch registers.

A document's set is its distinct word shingles, hashed to 64 bits. Its sketch has one register for
each of m hash functions: the smallest of the set's exponentially distributed hash values, spaced
exponentially and truncated to [0, q + 1]. Registers of a union are the larger registers of its
parts, so sketches merge. Equal register values are as likely as the sets are alike; bands of
register values name the buckets in which documents meet.

1. Documents with equal sets are one node (named by a 128-bit hash of the set), so a group of copies
   is one node however large it is.
2. In each bucket a node meets one leader, never all others. A pair is dropped only if the joint
   likelihood of both sketches puts its similarity far below the threshold, or the sizes of the sets
   rule it out; all other pairs are verified on the full sets. Verified links give components.
3. What shares a bucket but no component is then compared in blocks of bounded rows and bytes, by its
   sketches and, where those find a pair likely, by the full sets. Only verified links leave a block
   (those that connect its components), so a bucket is never expanded into pairs, and every pair of a bucket is compared however large it
   is. Buckets that share nodes (a group of near copies has many in common) are compared as one where
   that leaves fewer pairs. In a bucket of n rows, m of which are in other components than its leader,
   time grows with n * m and rows with n * m / 1024.

Defined results
---------------
* Null texts, texts without words and empty sets are linked with nothing: component_id = doc_id.
* Rows with a null doc_id link like others but have no id to give: their component is the smallest
  id of their group (null if it has none). Repeated rows have equal sets and so one component.
* An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns
  may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, among, claim, read, rows_kept, text_or_empty
from .components import components, dense_components, extended

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Rows and shingles of a block, about.
_ROWS, _SHINGLES = 1024, 1 << 22
#: Elements hashed at a time; they stay in a core's cache over all registers.
_CHUNK = 1 << 15


class _WordHashes(dict):
    """Words to 64-bit hashes; emptied beyond 250,000 words, which changes no hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def word_hashes(text: str) -> np.ndarray:
    """One hash a word, A-Z lower-cased; bytes.lower and bytes.split are ASCII only, as the words are."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes; with fewer words than ``width``, the whole sequence is one."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(width, len(h))
    s = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        s = (s * _M1) ^ (s >> np.uint64(29))
        s += h[k : len(h) - n + 1 + k] * _M2
    s ^= s >> np.uint64(32)
    s *= _M1
    return np.unique(s)


class SetSketch:
    """m registers with base b, rate a and limit q + 1."""

    def __init__(self, m: int = 128, b: float = 1.001, a: float = 20.0, q: int = (1 << 16) - 2, seed: int = 1):
        self.m, self.b, self.a, self.q = m, b, a, q
        draw = np.random.default_rng(seed)
        self.xor = draw.integers(0, 1 << 32, m, dtype=np.uint64).astype(np.uint32)
        self.mul = draw.integers(0, 1 << 32, m, dtype=np.uint64).astype(np.uint32) | np.uint32(1)

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of m registers for each non-empty set."""
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        low = np.full((len(sets), self.m), 0xFFFFFFFF, dtype=np.uint32)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        flat = ((flat >> np.uint64(32)) ^ flat).astype(np.uint32)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sets)), sizes)
        for at in range(0, len(flat), _CHUNK):
            part, own = flat[at : at + _CHUNK], owner[at : at + _CHUNK]
            first, last = own[0], own[-1]
            cuts = np.maximum(ends[first:last] - at, 0)
            cuts = np.concatenate([[0], cuts])
            x = np.empty_like(part)
            y = np.empty_like(part)
            for i in range(self.m):
                np.bitwise_xor(part, self.xor[i], out=x)
                np.multiply(x, self.mul[i], out=x)
                np.right_shift(x, 15, out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
                least = np.minimum.reduceat(x, cuts)
                np.minimum(low[first : last + 1, i], least, out=low[first : last + 1, i])
        u = (low.astype(np.float64) + 0.5) / 4294967296.0
        x = -np.log1p(-u) / self.a
        return np.clip(np.floor(1.0 - np.log(x) / np.log(self.b)), 0, self.q + 1).astype(np.uint16)

    @staticmethod
    def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.maximum(one, other)

    def similarity(self, k1: np.ndarray, k2: np.ndarray, n1: np.ndarray, n2: np.ndarray, steps: int = 60) -> np.ndarray:
        """The Jaccard similarity of greatest likelihood, jointly from which register is larger.

        With shares u and v of the sets' sizes, a register of the first is larger with probability
        p(u - v J'), one of the second with p(v - u J'), p(x) = -log_b(1 - x (b - 1) / b); the rest
        are equal. The likelihood is concave in J; a grid over [0, min(u / v, v / u)] finds it.
        """
        up = (k1 > k2).sum(1)[:, None].astype(np.float64)
        down = (k1 < k2).sum(1)[:, None].astype(np.float64)
        u = (n1 / (n1 + n2))[:, None]
        v = 1.0 - u
        j = np.minimum(u / v, v / u) * np.linspace(0.0, 1.0, steps)[None, :]
        prob = lambda x: np.clip(-np.log(np.clip(1.0 - x * (self.b - 1.0) / self.b, 1e-12, 1.0)) / np.log(self.b), 1e-9, 1.0)
        p_up, p_down = prob(u - v * j), prob(v - u * j)
        same = np.clip(1.0 - p_up - p_down, 1e-9, 1.0)
        best = (up * np.log(p_up) + down * np.log(p_down) + (self.m - up - down) * np.log(same)).argmax(1)
        return np.take_along_axis(j, best[:, None], 1)[:, 0]


def _name(shingle_set: np.ndarray) -> bytes:
    """A set's node."""
    return xxhash.xxh3_128_digest(shingle_set.tobytes())


def _bucket(registers: np.ndarray, band: int, rows: int) -> int:
    """The bucket that a band of register values names."""
    return xxhash.xxh3_64_intdigest(registers[band * rows : (band + 1) * rows].tobytes(), band) - (1 << 63)


_SKETCH = "doc_id long, n_shingles long, node binary, registers binary, bands array<long>"


def sketches(docs: DataFrame, width: int, sketch: SetSketch, rows: int, more: tuple[Column, ...] = ()) -> DataFrame:
    """A row per document; node, registers and bands are null for empty sets. ``more``: at most a digest to carry along."""
    bands = sketch.m // rows
    names = ["doc_id", "n_shingles", "node", "registers", "bands", *["digest"][: len(more)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _words.clear)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingles(t or "", width) for t in batch.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                k = sketch.registers(full)
                keys = [[_bucket(row, b, rows) for b in range(bands)] for row in k]
                regs = iter(zip(map(_name, full), k, keys))
                got = [next(regs) if len(s) else (None, None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([g[0] for g in got], pa.binary()), pa.array([None if g[1] is None else g[1].tobytes() for g in got], pa.binary()), pa.array([g[2] for g in got], pa.list_(pa.int64())), *batch.columns[2:]],
                    names=names,
                )

    return docs.select("doc_id", "text", *more).mapInArrow(run, _SKETCH + ", digest binary" * len(more))


def _fits(na, nb, percent: int):
    """Whether sets of these sizes can be as similar as asked; for columns and arrays."""
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent)


def _likely(pairs: DataFrame, nodes: DataFrame, sketch: SetSketch, percent: int, least: float) -> DataFrame:
    """Those pairs (a, b) of which the sketches don't put the similarity below ``least``."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"k{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_fits(F.col("na"), F.col("nb"), percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _words.clear)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, ka, nb, kb = (batch.column(c) for c in range(6))
            regs = lambda k: np.frombuffer(b"".join(k.to_pylist()), np.uint16).reshape(-1, sketch.m)
            est = sketch.similarity(regs(ka), regs(kb), na.to_numpy(zero_copy_only=False).astype(float), nb.to_numpy(zero_copy_only=False).astype(float))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(est >= least))

    return both.select("a", "b", "na", "ka", "nb", "kb").mapInArrow(run, "a binary, b binary")


def _opened(at: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """What meets in buckets of several labels: its rows, and a row a bucket with the numbers of its blocks.

    ``at``: bucket, inner, node, label, n_shingles. In each pair of differing labels one is not the
    leader's, so it is enough that those rows ("asking") meet all rows of their bucket. Aggregates
    are written before they are joined: both sides of a join are then plain exchanges, and adaptive
    execution can split a bucket that holds a large part of all rows.
    """
    lead = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("label").alias("label")))
    open_ = at.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), lead.alias("lead")).where("low < high")
    open_ = scratch.keep(open_.select("bucket", F.col("lead.label").alias("lead_label")), f"{name}-open")
    rows = scratch.keep(at.join(open_, "bucket").withColumn("asks", F.col("label") != F.col("lead_label")).drop("lead_label"), f"{name}-rows")
    asks = F.col("asks").cast("long")
    blocks = lambda n, words: F.greatest(F.ceil(n / _ROWS), F.ceil(words / _SHINGLES)).cast("long")
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("words"), F.sum(asks).alias("asking"), F.sum(asks * F.col("n_shingles")).alias("asking_words"))
    return rows, scratch.keep(sums.select("bucket", blocks(F.col("asking"), F.col("asking_words")).alias("n_i"), blocks(F.col("n"), F.col("words")).alias("n_j")), f"{name}-sums")


def _blocks(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """(bucket, inner, i, j, asks, node, label): asking rows are dealt into blocks i, all rows into blocks j.

    A task compares one block of each kind at a time: by the numbers in ``sums`` some _ROWS rows and
    _SHINGLES shingles of each. So every row is there once for each block of the other kind.
    """
    at = rows.join(sums, "bucket")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c))
    asking = at.where("asks").select("bucket", "inner", own("n_i", 1).alias("i"), upto("n_j").alias("j"), F.lit(True).alias("asks"), "node", "label")
    asked = at.select("bucket", "inner", upto("n_i").alias("i"), own("n_j", 2).alias("j"), F.lit(False).alias("asks"), "node", "label")
    return asking.unionByName(asked)


def _meetings(at: DataFrame, scratch: Scratch) -> DataFrame:
    """The blocks of all buckets; those that share nodes are one bucket where that leaves fewer pairs ("inner")."""
    rows, _ = _opened(at.withColumn("inner", F.lit(False)), scratch, "meet")
    # Each node and its bucket's first one: those of near copies are the same in most of their buckets.
    first = scratch.keep(rows.groupBy("bucket").agg(F.min("node").alias("a")), "group-lead")
    edges = rows.join(first, "bucket").where("node != a").select("a", F.col("node").alias("b")).distinct()
    group = dense_components(scratch.keep(edges, "group-edges"), scratch, "groups")
    named = rows.join(group.withColumnRenamed("label", "first"), "node", "left").withColumn("group", F.xxhash64(F.coalesce("first", "node")))
    named = scratch.keep(named.select("bucket", "group", "node", "label", "n_shingles", "asks"), "in-groups")
    pairs = lambda df: df.agg((F.count("*") * F.count_if("asks")).alias("pairs"))
    alone = pairs(named.groupBy("group", "bucket")).groupBy("group").agg(F.sum("pairs").alias("alone"))
    whole = pairs(named.groupBy("group", "node").agg(F.max("asks").alias("asks")).groupBy("group"))
    one = scratch.keep(alone.join(whole, "group").select("group", (F.col("pairs") < F.col("alone")).alias("inner")), "merged")
    merged = named.join(one, "group").select(F.when(F.col("inner"), F.col("group")).otherwise(F.col("bucket")).alias("bucket"), "inner", "node", "label", "n_shingles")
    return _blocks(*_opened(scratch.keep(merged.distinct(), "within"), scratch, "inner"))


def _grouped(rows: DataFrame, handle, schema: str) -> DataFrame:
    """Applies ``handle`` to the rows of each (bucket, i, j), asking rows first, as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _words.clear)
        held: list[pa.RecordBatch] = []  # of the group that may go on in the next batch
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                key = tuple(keys[:, x].tolist())
                if key != last and held:
                    yield handle(pa.Table.from_batches(held))
                    held = []
                last = key
                held.append(batch.slice(x, y - x))
        if held:
            yield handle(pa.Table.from_batches(held))

    placed = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", F.desc("asks"))
    return placed.mapInArrow(run, schema)


class _Block:
    """One block: which asked rows are likely partners of an asking row."""

    def __init__(self, group: pa.Table, sketch: SetSketch, rows: int, percent: int, least: float):
        self.sketch, self.rows, self.percent, self.least = sketch, rows, percent, least
        self.bucket, self.inner = group.column("bucket")[0].as_py(), group.column("inner")[0].as_py()
        self.asking = int(group.column("asks").to_numpy().sum())
        self.ids = group.column("node").to_pylist()
        self.label = np.unique(np.array(group.column("label").to_pylist(), dtype="S16"), return_inverse=True)[1]
        self.size = group.column("n_shingles").to_numpy().astype(float)
        self.regs = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(-1, sketch.m)

    def likely(self, x: int) -> np.ndarray:
        """Places of the likely partners of another label that share no earlier bucket with row x.

        A bucket of several has those that share an earlier bucket as well.
        """
        k, regs, size = self.asking, self.regs, self.size
        y = k + np.flatnonzero((self.label[k:] != self.label[x]) & _fits(size[k:], size[x], self.percent))
        if len(y):
            # As many registers are equal as the sets are alike, give or take 0.05: far below that
            # the likelihood needn't be computed.
            same = regs[y] == regs[x]
            near = same.sum(1) >= (self.least - 0.15) * self.sketch.m
            y, same = y[near], same[near]
        if len(y) and not self.inner:
            band = same.reshape(len(y), -1, self.rows).all(2).argmax(1)
            y = y[np.isin(band, [b for b in set(band.tolist()) if _bucket(regs[x], b, self.rows) == self.bucket])]
        if len(y):
            y = y[self.sketch.similarity(np.broadcast_to(regs[x], (len(y), self.sketch.m)), regs[y], np.full(len(y), size[x]), size[y]) >= self.least]
        return y


def _apart(met: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch, sketch: SetSketch, rows: int, percent: int, least: float) -> DataFrame:
    """Verified links (a, b) between nodes that share a bucket but no label.

    The sketches tell which rows of a block have likely partners at all; only those get their full
    sets, and are then compared exactly in the same block. What a block's links have connected is not compared again.
    Pairs never leave a block: of them only time depends, and rows on the number of blocks.
    """
    with_registers = lambda df: df.join(nodes.select("node", "n_shingles", "registers"), "node")

    def sift(group: pa.Table) -> pa.RecordBatch:
        block = _Block(group, sketch, rows, percent, least)
        stay = np.zeros(group.num_rows, dtype=bool)
        for x in range(block.asking):
            y = block.likely(x)
            if len(y):
                stay[x] = stay[y] = True
        kept = group.filter(pa.array(stay))
        return pa.RecordBatch.from_arrays([pa.array(kept.column(c).to_pylist(), t) for c, t in kinds.items()], names=list(kinds))

    kinds = {"bucket": pa.int64(), "inner": pa.bool_(), "i": pa.int64(), "j": pa.int64(), "asks": pa.bool_(), "node": pa.binary(), "label": pa.binary()}
    columns = ("bucket", "i", "j", "asks", "inner", "node", "label", "n_shingles", "registers")
    blocks = with_registers(_meetings(met, scratch)).select(*columns)
    left = scratch.keep(_grouped(blocks, sift, "bucket long, inner boolean, i long, j long, asks boolean, node binary, label binary"), "sifted")

    def verify(group: pa.Table) -> pa.RecordBatch:
        block = _Block(group, sketch, rows, percent, least)
        shingle = [np.array(s, dtype=np.int64) for s in group.column("shingles").to_numpy()]
        a, b = [], []
        within = np.arange(block.label.max(initial=-1) + 1)  # the part of each label, by the links so far
        for x in range(block.asking):
            mine = block.label[x]
            y = block.likely(x)
            for at in range(0, len(y), 64):
                part = y[at : at + 64]
                part = part[within[block.label[part]] != within[mine]]
                if not len(part):
                    continue
                flat = np.concatenate([shingle[z] for z in part])
                place = np.minimum(np.searchsorted(shingle[x], flat), len(shingle[x]) - 1)
                ends = np.cumsum([len(shingle[z]) for z in part])
                hits = np.concatenate([[0], np.cumsum(shingle[x][place] == flat)])
                common = hits[ends] - hits[np.concatenate([[0], ends[:-1]])]
                union = len(shingle[x]) + np.array([len(shingle[z]) for z in part]) - common
                for z in part[common * 100 >= union * percent]:
                    if within[block.label[z]] != within[mine]:
                        within[within == within[block.label[z]]] = within[mine]
                        a.append(min(block.ids[x], block.ids[z]))
                        b.append(max(block.ids[x], block.ids[z]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    ordered = sets.select("node", F.sort_array("shingles").alias("shingles"))
    full = with_registers(left).join(_only(ordered, left.select(F.col("node").alias("a"), F.col("node").alias("b"))), "node")
    return _grouped(full.select(*columns, "shingles"), verify, "a binary, b binary").distinct()


def _only(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``table`` (by node) that pairs need, and a few more."""
    return among(table, "node", pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on full sets."""
    sets = _only(sets, pairs)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, sketch: SetSketch | None = None, rows: int = 4, margin: float = 0.2) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept.

    ``rows`` registers a band; with 128 registers a pair of similarity 0.8 shares a band but for one
    case in 20 million. ``margin``: pairs are dropped unverified if the sketches' estimate lies that
    far below the threshold (over five standard deviations).
    """
    out = _in_batches(docs, width, percent, sketch, rows, margin)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _in_batches(docs: DataFrame, width: int, percent: int, sketch: SetSketch | None, rows: int, margin: float, more: tuple[Column, ...] = ()) -> DataFrame:
    # Rows with sets are large: a thousand go to Python at a time. All Python runs within this call.
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = docs.sparkSession.conf.get(batch)
    docs.sparkSession.conf.set(batch, "1000")
    try:
        return _near_duplicates(docs, width, percent, sketch or SetSketch(), rows, margin, more)
    finally:
        docs.sparkSession.conf.set(batch, before)


def _near_duplicates(docs: DataFrame, width: int, percent: int, sketch: SetSketch, rows: int, margin: float, carry: tuple[Column, ...]) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id; with ``carry`` also node, label (a component's own) and digest."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    all_docs = scratch.keep(sketches(docs, width, sketch, rows, carry), "sketches")
    some = all_docs.where("node is not null")
    first = scratch.keep(some.groupBy("node").agg(F.min("doc_id").alias("first_id")), "first")

    # Buckets of two nodes or more, and their leaders; entries are moved once.
    entries = some.select("node", "n_shingles", F.explode("bands").alias("bucket")).repartition("bucket").distinct()
    order = W.partitionBy("bucket").orderBy("node")
    entries = entries.select("*", F.lag("node").over(order).alias("before"), F.lead("node").over(order).alias("after"), F.first("node").over(order).alias("lead"))
    met = scratch.keep(entries.where("before IS NOT NULL OR after IS NOT NULL").drop("before", "after"), "met")
    meeting = scratch.keep(met.select("node").distinct(), "meeting")
    nodes = among(some.select("node", "n_shingles", "registers"), "node", meeting)
    nodes = scratch.keep(nodes.join(meeting, "node", "left_semi").dropDuplicates(["node"]), "nodes")
    # Full sets of the documents that meet others, from their whole texts.
    one = scratch.keep(first.join(nodes.select("node"), "node", "left_semi").select("node", F.col("first_id").alias("doc_id")), "one")
    sets = scratch.keep(_sets(docs, one, width), "sets")

    # Each node and its bucket's leader.
    pairs = met.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    least = percent / 100 - margin
    links = scratch.keep(_verified(scratch.keep(_likely(pairs, nodes, sketch, percent, least), "likely"), sets, percent), "links")
    found = components(links, scratch, "labels")
    # What still shares a bucket but no component.
    at = scratch.keep(met.join(found, "node", "left").select("bucket", "node", "n_shingles", F.coalesce("label", "node").alias("label")), "at")
    more = scratch.keep(_apart(at, nodes, sets, scratch, sketch, rows, percent, least), "more-links")
    scratch.drop("at", "group-lead", "group-edges", "groups-low", "groups-left", "sifted", "within", "in-groups", "merged", *(f"{a}-{b}" for a in ("meet", "inner") for b in ("open", "rows", "sums")))
    if not more.isEmpty():
        found = extended(found, more, scratch, "more-labels")
    scratch.drop("likely", "met", "meeting", "nodes", "sets")

    named = first.join(found, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    ids = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    carried = ("node", "label", "digest") if carry else ()
    by_node = scratch.keep(named.select("node", "label").join(ids, "label").select("node", "component_id", *carried[1:2]), "by-node")
    # Both sides of the last join are plain files, so a node with many copies can be split.
    out = all_docs.select("doc_id", "n_shingles", "node", *carried[2:]).join(by_node, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", *carried)


def _sets(docs: DataFrame, one: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of one document of each node in ``one`` (node, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _words.clear)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [(n, shingles(t or "", width)) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                rows = [(name, s.view(np.int64)) for n, s in sets if (name := _name(s)) == n or n is None]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.list_(pa.int64()))], names=["node", "shingles"])

    # A row whose text is not the node's (an id with several texts) is left out in ``run``.
    schema = "node binary, shingles array<long>"
    named = one.where("doc_id IS NOT NULL")
    by_id = among(docs.select("doc_id", "text"), "doc_id", named.select("doc_id")).join(named, "doc_id").select("node", "text").mapInArrow(run, schema)
    by_id = by_id.dropDuplicates(["node"])  # a repeated row gives its set again
    nameless = one.where("doc_id IS NULL").select("node")
    if nameless.isEmpty():
        return by_id
    # Nodes of null ids alone are found by their texts, each text once.
    texts = docs.where("doc_id IS NULL AND text IS NOT NULL").select("text").distinct().select(F.lit(None).cast("binary").alias("node"), "text")
    return by_id.unionByName(texts.mapInArrow(run, schema).join(nameless, "node", "left_semi").dropDuplicates(["node"]))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, sketch: SetSketch | None = None, rows: int = 4, margin: float = 0.2) -> DataFrame:
    """One row of each group, of smallest doc_id (null last), with the columns of ``docs``; texts without words all stay."""
    scratch = Scratch(docs.sparkSession, "keep-first")
    digest = F.unhex(F.sha2(text_or_empty(), 256))
    first = _in_batches(docs, width, percent, sketch, rows, margin, (digest,)).where(F.col("node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")))
    texts = first.groupBy("label", "digest", "doc_id").agg(F.count("*").alias("n"))
    kept = texts.groupBy("label").agg(F.min(F.struct("digest", "doc_id", "n")).alias("row")).select("row.*")
    blank = docs.where(~text_or_empty().rlike(WORD))
    return rows_kept(docs, digest, scratch.keep(kept, "kept")).unionByName(blank)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=2)
