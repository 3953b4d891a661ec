"""N-gram Jaccard join by partitions of the universe, exact.

Two sets of x and y elements with a similarity of p percent differ in at most
H = floor((100 - p) * (x + y) / (100 + p)) elements. Sizes fall into bands so that partners are in the
same band or the next; each band hashes elements into its own number of segments. Of any chosen
segments, whose allowances v (0: equal, 1: one element apart) have sum(v + 1) > H, two partners agree
in at least one within its allowance, so looking up those segments finds all of them.

1. Documents with equal sets are one node. Each node has a signature for every segment, in its own
   band's partition and in that of the band below. There are about 1.3 segments for each difference
   allowed, so a set too many of whose signatures stand alone has no partner: all but near copies go.
2. A few of each remaining set's signatures, chosen by hash, name lists in which it meets the first
   node; verified links give components. Most near copies are joined here.
3. The segment subsets are indexed in each set's own band. Only lists of several components matter; a
   set looks up its H + 1 segments of fewest nodes of other components, if any. Where these are more
   than its size, one-deletion neighbourhoods are indexed too in the bands concerned, and segments
   are allocated to allowance 0 or 1, or left out, by the cost of a unit of allowance.
4. Who meets in a list is verified on full sets: with the list's first node, then, where several
   components are left, with all others. Short lists give their pairs, a bounded multiple of their
   rows. Long ones that share nodes are compared as one group where that is less work, in blocks of
   bounded rows and elements; only links that connect components leave a block, fewer than its rows.
   Components name the classes.

Defined results
---------------
* Null texts, texts without words and empty sets are linked with nothing: component_id = doc_id.
* Rows with a null doc_id link like others but have no id to give: their component is the smallest
  id of their group (null if it has none). Repeated rows have equal sets and so one component.
* An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns
  may have any name.
* Shingles are 64-bit hashes, nodes 128-bit ones; other than by equal hashes no link is lost or added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, among, claim, read
from .components import components, dense_components, extended
from .near_dedup import _M1, _M2, _fits, _grouped, _name, _only, _sets, _verified, _words, shingles

#: Segments for each difference allowed; signatures by which a set first meets others; pairs a row of lists that give their pairs.
SLACK, PICKS, SHORT = 1.3, 3, 4
#: Rows and elements of a block, about.
ROWS, ELEMENTS = 1024, 1 << 20
#: Neighbourhoods are considered where the lists looked up hold more than so many times the set's size.
DEAR = 1.0
#: Nodes whose texts are found by a broadcast of their ids, at most.
_FEW = 100_000
_SKETCH = "row long, doc_id long, n_shingles long, node binary, needs array<int>, own int, signatures array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _M2
    x ^= x >> np.uint64(31)
    x *= _M1
    return x ^ (x >> np.uint64(29))


class Bands:
    """Bands of sizes, their numbers of segments, and how far partners differ."""

    def __init__(self, percent: int, slack: float = SLACK, largest: int = 1 << 40):
        if not 50 <= percent <= 100:
            raise ValueError("similarities of 50 to 100 percent")
        self.percent, low = percent, [1]
        while low[-1] <= largest:
            low.append(low[-1] * 100 // percent + 1)
        self.low = np.array(low, dtype=np.int64)
        self.high = self.low[1:] - 1
        most = self.apart(self.high, self.high * 100 // percent)
        self.segments = np.ceil(slack * (most + 1)).astype(np.int64)

    def apart(self, x, y):
        """Elements in which sets of these sizes may differ."""
        return (100 - self.percent) * (x + y) // (100 + self.percent)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1

    def indexed(self, n: np.ndarray) -> np.ndarray:
        """How far a set may differ from its partners of at least its size."""
        return self.apart(n, n * 100 // self.percent)

    def probed(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """How far it may differ from those of at most its size in a band; -1 where the band has none."""
        high = self.high[np.maximum(band, 0)]
        return np.where((band >= 0) & (high * 100 >= n * self.percent), self.apart(n, np.minimum(high, n)), -1)


class Segments:
    """The segments of some sets, in one band's partition each."""

    def __init__(self, bands: Bands, sets: list[np.ndarray], band: np.ndarray):
        n = np.array(list(map(len, sets)), dtype=np.int64)
        self.many = bands.segments[band]
        self.start = np.concatenate([[0], np.cumsum(self.many)])
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets)), n)
        within = ((flat >> np.uint64(32)) * self.many[owner].astype(np.uint64)) >> np.uint64(32)
        self.at, self.element = self.start[owner] + within.astype(np.int64), _mixed(flat)
        self.sums = np.zeros(self.start[-1], np.uint64)
        np.add.at(self.sums, self.at, self.element)
        self.size = np.bincount(self.at, minlength=int(self.start[-1]))
        self.owner = np.repeat(np.arange(len(sets)), self.many)
        self.number = np.arange(len(self.owner)) - self.start[self.owner]
        self.salt = _mixed((band[self.owner].astype(np.uint64) << np.uint64(40)) + self.number.astype(np.uint64) + np.uint64(1))

    def subsets(self) -> np.ndarray:
        """A signature for each segment."""
        return _mixed(self.sums ^ self.salt).view(np.int64)

    def deletions(self) -> np.ndarray:
        """A signature for each element, of its segment without it."""
        return _mixed((self.sums[self.at] - self.element) ^ self.salt[self.at]).view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _needed(bands: Bands, parts: list[Segments | None], n: np.ndarray, band: np.ndarray) -> list[np.ndarray]:
    """Signatures of its own and the lower partition that a set must share to have partners; a large number where it can't have any."""
    out = []
    for part, most in zip(parts, (np.where(bands.segments[band] > 0, bands.indexed(n), 0), bands.probed(n, band - 1))):
        empty = np.add.reduceat(part.size == 0, part.start[:-1])
        # Sets that may differ in nothing have no partner but their equals.
        out.append(np.where(most > 0, part.many - most - empty, np.iinfo(np.int32).max))
    return out


def _sketched(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """A row per document with its signatures; node and all after it are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _words.clear)
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingles(t or "", width) for t in batch.column(1).to_pylist()]
                size = np.array(list(map(len, sets)), dtype=np.int64)
                full = np.flatnonzero(size)
                some, n = [sets[i] for i in full.tolist()], size[full]
                band = bands.of(n)
                signed = np.zeros(len(sets), np.int64)
                own = np.zeros(len(sets), np.int64)
                needs = np.full((len(sets), 2), np.iinfo(np.int32).max)
                values = np.zeros(0, np.int64)
                if len(some):
                    parts = [Segments(bands, some, band), Segments(bands, some, np.maximum(band - 1, 0))]
                    need = _needed(bands, parts, n, band)
                    keep = [(p.size > 0) & (d[p.owner] < np.iinfo(np.int32).max) for p, d in zip(parts, need)]
                    values = np.concatenate([p.subsets()[k] for p, k in zip(parts, keep)])
                    of = np.concatenate([p.owner[k] for p, k in zip(parts, keep)])
                    values = values[np.argsort(of, kind="stable")]  # own ones first
                    own[full] = np.bincount(parts[0].owner[keep[0]], minlength=len(some))
                    signed[full] = np.bincount(of, minlength=len(some))
                    needs[full] = np.stack(need, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(sets))), batch.column(0).cast(pa.int64()), pa.array(size), pa.array([_name(s) if len(s) else None for s in sets], pa.binary()),
                        _lists(needs.ravel(), np.full(len(sets), 2), pa.int32()), pa.array(own, pa.int32()), _lists(values, signed, pa.int64()),
                    ],
                    names=["row", "doc_id", "n_shingles", "node", "needs", "own", "signatures"],
                )
                row += len(sets)

    return docs.select("doc_id", "text").mapInArrow(run, _SKETCH)


def _entries(some: DataFrame, nodes: DataFrame) -> DataFrame:
    """(at, signature) of one document of each node, and of a few others; ``at``: twice its row, and 1 for its own partition.

    Of the signatures 48 bits are enough to tell which are shared by chance: more sets stay, none go.
    """
    entries = among(some, "row", nodes.select("row")).select("row", "own", F.posexplode("signatures").alias("place", "signature"))
    at = F.shiftleft("row", 1).bitwiseOR((F.col("place") < F.col("own")).cast("long"))
    return entries.select(at.alias("at"), F.col("signature").bitwiseAND((1 << 48) - 1).alias("signature"))


def _survivors(sketched: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, id): the nodes that share enough signatures with others to have partners, each with a number of its own.

    ``nodes``: each node and its first row.
    """
    some = sketched.where("node IS NOT NULL")
    # Rows that need none survive as they are; a signature is shared if two rows have it. Entries, of which there
    # are far more than documents, are moved once: who shares a signature is told where its entries meet.
    one = W.partitionBy("signature")
    row = F.shiftright("at", 1)
    shared = _entries(some, nodes).repartition("signature").select("at", F.min(row).over(one).alias("low"), F.max(row).over(one).alias("high")).where("low < high")
    mine = F.col("at").bitwiseAND(1) == 1
    hits = shared.groupBy(row.alias("row")).agg(F.count_if(mine).alias("hits_own"), F.count_if(~mine).alias("hits_below"))
    enough = lambda own, below: (own >= F.col("needs")[0]) | (below >= F.col("needs")[1])
    small = some.select("row", "node", "needs")
    rows = small.join(hits, "row").where(enough(F.col("hits_own"), F.col("hits_below"))).select("node", "row")
    rows = rows.unionByName(small.where(enough(F.lit(0), F.lit(0))).select("node", "row"))
    return scratch.keep(rows.groupBy("node").agg(F.min("row").alias("id")), "survivors")


def _subsets(sets: DataFrame, bands: Bands) -> DataFrame:
    """(node, n, band, part, most, many, segment, signature) of each set: part 0 is its own band's, part 1 the lower one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _words.clear)
        for batch in batches:
            for nodes, some, n, band, part, most in _parts(batch, bands):
                own = Segments(bands, some, band)
                of = own.owner
                columns = [nodes.take(pa.array(of)), pa.array(n[of]), pa.array(band[of], pa.int32()), pa.array(np.full(len(of), part), pa.int32()), pa.array(most[of]), pa.array(own.many[of]), pa.array(own.number), pa.array(own.subsets())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "band", "part", "most", "many", "segment", "signature"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, n long, band int, part int, most long, many long, segment long, signature long")


def _picks(sets: DataFrame, bands: Bands, picks: int) -> DataFrame:
    """(bucket, node, n): each set's signatures of smallest hash, by ``picks`` hash functions, in both partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _words.clear)
        for batch in batches:
            for nodes, some, n, band, _, _ in _parts(batch, bands):
                own = Segments(bands, some, band)
                signature = own.subsets().view(np.uint64)
                for k in range(picks):
                    h = np.where(own.size > 0, _mixed(signature + np.uint64(k + 1)), np.uint64(0xFFFFFFFFFFFFFFFF))
                    least = np.minimum.reduceat(h, own.start[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), nodes, pa.array(n)], names=["bucket", "node", "n"])

    return sets.select("node", "shingles").mapInArrow(run, "bucket long, node long, n long").distinct()


def _parts(batch: pa.RecordBatch, bands: Bands) -> Iterator[tuple]:
    """(nodes, sets, sizes, band, part, how far probes may differ) of a batch of sets, 64 at a time, for each partition where partners can be."""
    for at in range(0, batch.num_rows, 64):
        some = [np.array(s, dtype=np.int64).view(np.uint64) for s in batch.column(1).slice(at, 64).to_numpy(zero_copy_only=False)]
        n = np.array(list(map(len, some)), dtype=np.int64)
        for part in (0, 1):
            band = bands.of(n) - part
            most = bands.probed(n, band)
            use = np.flatnonzero(bands.indexed(n) > 0 if part == 0 else most > 0)
            if len(use):
                yield batch.column(0).slice(at, 64).take(pa.array(use)), [some[i] for i in use.tolist()], n[use], band[use], part, most[use]


def _neighbours(sets: DataFrame, bands: Bands, wanted: DataFrame | None, which: list[int]) -> DataFrame:
    """(node, n, part, segment, signature) of one-deletion neighbourhoods: of sets whose own band is in
    ``which`` (to index them), or of the (node, part) in ``wanted`` (to look them up)."""
    named = wanted is not None
    rows = sets if wanted is None else sets.join(wanted.groupBy("node").agg(F.collect_set("part").alias("parts")), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _words.clear)
        for batch in batches:
            asked = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())) if named else None
            for nodes, some, n, band, part, _ in _parts(batch, bands):
                use = [i for i, (node, b) in enumerate(zip(nodes.to_pylist(), band.tolist())) if (part in asked[node] if asked is not None else part == 0 and b in which)]
                if use:
                    own = Segments(bands, [some[i] for i in use], band[use])
                    of = np.array(use)[own.owner[own.at]]
                    columns = [nodes.take(pa.array(of)), pa.array(n[of]), pa.array(np.full(len(of), part), pa.int32()), pa.array(own.number[own.at]), pa.array(own.deletions())]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "part", "segment", "signature"])

    return rows.mapInArrow(run, "node long, n long, part int, segment long, signature long")


def allocation(equal: np.ndarray, near: np.ndarray, need: int) -> np.ndarray:
    """The allowance of each segment (-1: not looked up), by cost of a unit, of which ``need`` are used in all."""
    price = np.minimum(equal, near / 2)
    order = np.argsort(price, kind="stable")
    units = np.where(near / 2 < equal, 2, 1)
    used = np.searchsorted(np.cumsum(units[order]), need) + 1
    out = np.full(len(equal), -1)
    out[order[:used]] = units[order[:used]] - 1
    return out


def _allocated(rows: DataFrame) -> DataFrame:
    """(node, part, segment, allowance) of the segments to look up; ``rows``: node, part, need (units still to be used), segment, equal, near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _words.clear)
        for batch in batches:
            out = []
            for node, part, need, of in zip(*(c.to_pylist() for c in batch.columns)):
                v = allocation(np.array([s["equal"] for s in of], float), np.array([s["near"] for s in of], float), need)
                out += [(node, part, s["segment"], int(a)) for s, a in zip(of, v.tolist()) if a >= 0]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ((),) * 4, kinds)], names=["node", "part", "segment", "allowance"])

    sets = rows.groupBy("node", "part", "need").agg(F.sort_array(F.collect_list(F.struct("segment", "equal", "near"))).alias("of"))
    return sets.mapInArrow(run, "node long, part int, segment long, allowance int")


def _other(signature: str | Column) -> Column:
    """The name of the list of neighbourhoods beside that of subsets."""
    return F.xxhash64(signature, F.lit("deleted"))


def _in_lists(rows: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with the few of their lists that are still of interest; the others' rows stay where they are."""
    return among(rows, key, lists).join(lists, key)


def _met(sets: DataFrame, labels: DataFrame, bands: Bands, scratch: Scratch) -> DataFrame:
    """(bucket, node, n, asks): who looks up a list, and who is in it; ``labels``: node, label of those that have links."""
    subsets = _subsets(sets, bands).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    subsets = scratch.keep(subsets, "subsets")
    held = F.col("part") == 0
    # Lists of several components; nobody else's segment costs anything.
    lists = subsets.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count_if(held).alias("length")).where("low < high AND length > 0")
    lists = scratch.keep(lists.select("signature", "length"), "lists")
    rows = scratch.keep(_in_lists(subsets, lists, "signature"), "rows")
    scratch.drop("subsets")
    same = scratch.keep(rows.where(held).groupBy("signature", "label").agg(F.count("*").alias("same")), "same")
    asking = rows.where("most > 0").join(same, ["signature", "label"], "left").withColumn("equal", F.col("length") - F.coalesce("same", F.lit(0))).where("equal > 0").drop("length", "same")
    one = W.partitionBy("node", "part")
    # Segments that cost nothing come first: what is left of the H + 1 must be looked up.
    ranked = asking.withColumn("need", F.col("most") + 1 - (F.col("many") - F.count("*").over(one))).where("need > 0")
    ranked = ranked.withColumn("rank", F.row_number().over(one.orderBy("equal", "segment"))).withColumn("cost", F.sum(F.when(F.col("rank") <= F.col("need"), F.col("equal")).otherwise(0)).over(one))
    ranked = scratch.keep(ranked.withColumn("dear", F.col("cost") > F.col("n") * DEAR), "ranked")
    asked = lambda rows, bucket: rows.select(bucket.alias("bucket"), "node", "n", F.lit(True).alias("asks"))
    listed = lambda rows, bucket: rows.select(bucket.alias("bucket"), "node", "n", F.lit(False).alias("asks"))
    met = listed(rows.where(held), F.col("signature")).unionByName(asked(ranked.where("NOT dear AND rank <= need"), F.col("signature")))
    dear = ranked.where("dear")
    which = [r["band"] for r in dear.select("band").distinct().collect()]  # bands are few: sizes grow by a fixed rate
    if not which:
        return met
    # Nobody looks up the others' lists, which are most by far.
    deleted = scratch.keep(among(_neighbours(sets, bands, None, which), "signature", scratch.keep(dear.select("signature").distinct(), "dear")), "deleted")
    lookups = scratch.keep(_neighbours(sets, bands, dear.select("node", "part").distinct(), []), "lookups")
    in_lists = scratch.keep(deleted.groupBy("signature").agg(F.count("*").alias("length")), "deleted-lengths")
    near = lookups.join(lists, "signature").groupBy("node", "part", "segment").agg(F.sum("length").alias("by_lookup"))
    keys = ["node", "part", "segment"]
    costs = dear.join(near, keys, "left").join(in_lists, "signature", "left")
    costs = costs.select(*keys, "need", "equal", (F.col("equal") + F.coalesce("by_lookup", F.lit(0)) + F.coalesce("length", F.lit(0))).alias("near"))
    chosen = scratch.keep(_allocated(costs), "chosen")
    near = chosen.where("allowance = 1").select(*keys)
    own = dear.join(chosen.select(*keys), keys)
    met = met.unionByName(asked(own, F.col("signature"))).unionByName(asked(lookups.join(near, keys), F.col("signature")))
    # A neighbour's list may be of one component, which is not the asking node's.
    by_lookup = subset_lists(sets, bands).join(lookups.join(near, keys).select("signature").distinct(), "signature", "left_semi")
    return met.unionByName(listed(by_lookup, F.col("signature"))).unionByName(asked(dear.join(near, keys), _other("signature"))).unionByName(listed(deleted, _other("signature")))


def subset_lists(sets: DataFrame, bands: Bands) -> DataFrame:
    """(signature, node, n) of the index of segment subsets."""
    return _subsets(sets, bands).where("part = 0").select("signature", "node", "n")


def _first_pairs(at: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Distinct pairs (a, b) of each row and the first row of its bucket of the other side; without sides, of any."""
    one = lambda side: F.min(F.when(F.col("asks") == side, F.struct("node", "n", "label")))
    lead = scratch.keep(at.groupBy("bucket").agg(one(True).alias("asking"), one(False).alias("held")).where("asking IS NOT NULL AND held IS NOT NULL"), f"{name}-lead")
    first = at.join(lead, "bucket").withColumn("with", F.when(F.col("asks"), F.col("held")).otherwise(F.col("asking")))
    first = first.where(F.col("label") != F.col("with.label")).select("node", "n", F.col("with.node").alias("other"), F.col("with.n").alias("n_other"))
    return first.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "n", "n_other").distinct()


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(_fits(F.col("n"), F.col("n_other"), percent)).select("a", "b")


def _pairs(asking: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of differing labels that meet in a bucket and whose sizes fit."""
    right = held.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    both = asking.join(right, "bucket").where((F.col("label") != F.col("lb")) & _fits(F.col("n"), F.col("nb"), percent))
    return both.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _linked(sets: DataFrame, bands: Bands, scratch: Scratch) -> DataFrame:
    """(node, label) of all nodes that have links."""
    percent = bands.percent
    # Most near copies share a picked signature with the first node that has it.
    picked = scratch.keep(_picks(sets, bands, PICKS), "picked")
    lead = scratch.keep(picked.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("lead")), "picked-lead")
    pairs = picked.join(lead, "bucket").where("node != lead.node").select(F.col("lead.node").alias("a"), F.col("node").alias("b"), "n", F.col("lead.n").alias("n_other")).distinct()
    links = scratch.keep(_verified(scratch.keep(_sized(pairs, percent), "picked-pairs"), sets, percent), "links-picked")
    labels = components(links, scratch, "labels-picked")
    scratch.drop("picked", "picked-lead")
    at = scratch.keep(_met(sets, labels, bands, scratch).distinct(), "at")

    def still_open(labels: DataFrame, name: str) -> DataFrame:
        """Rows of buckets where asking rows meet other components, with the numbers of both sides."""
        rows = scratch.keep(at.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), f"named-{name}")
        ends = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count_if("asks").alias("p"), F.count_if(~F.col("asks")).alias("i")).where("low < high AND p > 0 AND i > 0")
        out = scratch.keep(_in_lists(rows, scratch.keep(ends.select("bucket", "p", "i"), f"many-{name}"), "bucket"), f"open-{name}")
        scratch.drop(f"named-{name}")
        return out

    rows = still_open(labels, "first")
    more = scratch.keep(_verified(scratch.keep(_sized(_first_pairs(rows, scratch, "first"), percent), "with-first"), sets, percent), "links-first")
    if not more.isEmpty():
        labels = extended(labels, more, scratch, "labels-first")
        rows = still_open(labels, "then")
    few = F.col("p") * F.col("i") <= SHORT * (F.col("p") + F.col("i"))
    short = scratch.keep(_verified(scratch.keep(_pairs(rows.where(few & F.col("asks")), rows.where(few & ~F.col("asks")), percent), "few"), sets, percent), "links-few")
    links = short
    long = rows.where(~few)
    if not long.isEmpty():
        links = links.unionByName(scratch.keep(_in_blocks(_groups(long, scratch), sets, percent, scratch), "links-blocks"))
    return extended(labels, links, scratch, "labels")


def _groups(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of long lists; lists that share nodes are one bucket where that leaves fewer pairs to compare."""
    # Each node and its list's first one: those of near copies are the same in most of their lists.
    lead = scratch.keep(rows.groupBy("bucket").agg(F.min("node").alias("a")), "group-lead")
    edges = rows.join(lead, "bucket").where("node != a").select("a", F.col("node").alias("b")).distinct()
    group = dense_components(scratch.keep(edges, "group-edges"), scratch, "groups").withColumnRenamed("label", "group")
    named = rows.join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    merged = scratch.keep(named.select("bucket", "group", "node", "n", "label", "asks"), "grouped")
    sides = lambda df: df.agg(F.count_if("asks").alias("p"), F.count_if(~F.col("asks")).alias("i"))
    alone = sides(merged.groupBy("group", "bucket")).groupBy("group").agg(F.sum(F.col("p") * F.col("i")).alias("alone"))
    whole = sides(merged.select("group", "node", "asks").distinct().groupBy("group"))
    together = scratch.keep(alone.join(whole, "group").select("group", (F.col("p") * F.col("i") < F.col("alone")).alias("together")), "together")
    return scratch.keep(merged.join(together, "group").select(F.when(F.col("together"), F.col("group")).otherwise(F.col("bucket")).alias("bucket"), "node", "n", "label", "asks").distinct(), "long")


def _in_blocks(rows: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between asking and held rows of a bucket, of differing labels, compared in blocks."""
    asks = F.col("asks").cast("long")
    blocks = lambda side: F.greatest(F.ceil(F.sum(side) / ROWS), F.ceil(F.sum(side * F.col("n")) / ELEMENTS), F.lit(1)).cast("long")
    sums = scratch.keep(rows.groupBy("bucket").agg(blocks(asks).alias("n_i"), blocks(1 - asks).alias("n_j")), "sums")
    at = rows.join(sums, "bucket")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    asking = at.where("asks").select("bucket", own("n_i").alias("i"), upto("n_j").alias("j"), "asks", "node", "label")
    held = at.where("NOT asks").select("bucket", upto("n_i").alias("i"), own("n_j").alias("j"), "asks", "node", "label")
    placed = scratch.keep(asking.unionByName(held), "placed")
    full = placed.join(_only(sets, placed.select(F.col("node").alias("a"), F.col("node").alias("b"))), "node").select("bucket", "i", "j", "asks", "node", "label", "shingles")

    def verify(group: pa.Table) -> pa.RecordBatch:
        asks = group.column("asks").to_numpy()
        ids, label = group.column("node").to_numpy(), group.column("label").to_numpy()
        some = [np.asarray(s, dtype=np.int64) for s in group.column("shingles").to_numpy()]
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        a, b = [], []
        if len(x) and len(y):
            number = np.unique(label, return_inverse=True)[1]
            p, q = spanning(linked_pairs([some[k] for k in x], [some[k] for k in y], percent), number[x], number[y])
            a, b = np.minimum(ids[x[p]], ids[y[q]]), np.maximum(ids[x[p]], ids[y[q]])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _grouped(full, verify, "a long, b long").distinct()


def spanning(link: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (p, q) that connect the same components as all links do: fewer than there are components.

    ``x`` and ``y``: the numbers of the components that the rows and columns of ``link`` are in so far.
    """
    part = np.arange(max(x.max(initial=-1), y.max(initial=-1)) + 1)
    p, q = [], []
    for i in range(len(x)):
        at = np.flatnonzero(link[i])
        other, first = np.unique(part[y[at]], return_index=True)
        new = other != part[x[i]]
        if new.any():
            p += [i] * int(new.sum())
            q += at[first[new]].tolist()
            part[np.isin(part, other[new])] = part[x[i]]
    return np.array(p, dtype=np.int64), np.array(q, dtype=np.int64)


def linked_pairs(xs: list[np.ndarray], ys: list[np.ndarray], percent: int, width: int = 2048) -> np.ndarray:
    """Which x and y are as similar as asked: products of membership matrices, some elements at a time."""
    flat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (ex, ox), (ey, oy) = flat(xs), flat(ys)
    both = np.intersect1d(ex, ey)
    px, py = (np.searchsorted(both, e) for e in (ex, ey))
    common = np.zeros((len(xs), len(ys)), np.float32)  # exact: counts stay below 2 ** 24 in a block
    sizes = [np.array([len(s) for s in sets]) for sets in (xs, ys)]
    for at in range(0, len(both), width):
        parts = []
        for e, p, o, n in ((ex, px, ox, len(xs)), (ey, py, oy, len(ys))):
            in_ = (p >= at) & (p < min(at + width, len(both)))
            in_[in_] = both[p[in_]] == e[in_]
            m = np.zeros((n, width), np.float32)
            m[o[in_], p[in_] - at] = 1.0
            parts.append(m)
        common += parts[0] @ parts[1].T
    common = common.astype(np.int64)
    return common * 100 >= (sizes[0][:, None] + sizes[1][None, :] - common) * percent


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, slack: float = SLACK) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Documents link if 100 * intersection >= percent * union of their sets of ``width``-word shingles.
    """
    spark = docs.sparkSession
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    scratch = Scratch(spark, "jaccard")
    before = spark.conf.get(batch)
    spark.conf.set(batch, "1000")  # rows with sets are large; all Python runs within this call
    try:
        return _classes(docs, width, Bands(percent, slack), scratch)
    finally:
        spark.conf.set(batch, before)


def _classes(docs: DataFrame, width: int, bands: Bands, scratch: Scratch) -> DataFrame:
    sketched = scratch.keep(_sketched(docs, width, bands), "sketched")
    first = scratch.keep(sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row")), "first")
    survivors = _survivors(sketched, first, scratch)
    one = scratch.keep(first.join(survivors, "node", "left_semi").select("node", F.col("first_id").alias("doc_id")), "one")
    one = F.broadcast(one) if survivors.count() <= _FEW else one
    sets = scratch.keep(_sets(docs, one, width).join(survivors, "node").select(F.col("id").alias("node"), "shingles"), "sets")
    found = _linked(sets, bands, scratch).select(F.col("node").alias("id"), "label").join(survivors, "id").select("node", "label")
    found = found.withColumn("label", F.unhex(F.hex("label")))  # beside names of nodes that have no links
    named = first.join(found, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    ids = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_node = scratch.keep(named.select("node", "label").join(ids, "label").select("node", "component_id"), "by-node")
    # Both sides of the last join are plain files, so a node with many copies can be split.
    out = sketched.select("doc_id", "n_shingles", "node").join(by_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"), width=4, percent=85)
