"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same bytes.

A text is read by a byte-level vocabulary (A) and a piece vocabulary (B). Byte offsets where tokens of
both end cut the tokens into groups, and every A token of a group is linked with every B token of it.
A pair's count is the number of documents that hold it linked; links are scored by their counts.

1. Each task aligns its documents and gathers links into blocks of about two million, by whole
   documents. A block has a row for each id stripe (A id modulo the number of stripes): the stripe's
   distinct pairs, how many documents of the block hold each, and which, how often.
2. The pairs' numbers of a stripe are added up by ``np.add.at`` into a dense matrix of some 256 A ids
   by all B ids. Blocks are dealt over salts, and a stripe's salts added in a second step, so a pair
   that is in every document is only a number a block, and no task reads a stripe of all blocks.
3. The sums go to each salt of their stripe again, where row maxima give each A id's highest count;
   every block's pairs get their counts there. Those answers meet the block's links, and its
   documents, in one partition, where the links are scored.

Matrices are of the vocabularies' size, blocks of bounded links (or one document); all else is sums.

Defined results
---------------
* Null and empty texts, and texts whose tokens don't spell the text with its space (as when U+2581 is
  in it), have no tokens: zeros, and an empty ``groups_sha256``.
* Rows with a null doc_id and repeated rows are documents of their own. Ties for the highest count
  all count as best. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so
  further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, claim, read
from .tokens import _ALPHABET, Encoder, batches

#: Links of a block, about; A ids of a stripe; blocks of a salt; bits of a document's number in its block.
LINKS, STRIPE_IDS, SALT_BLOCKS, _DOC_BITS = 2_000_000, 256, 256, 21
#: Groups of more links than this are counted by their distinct ids.
_WIDE = 4096
#: Pieces of text that each of the two encoders remembers at most.
_REMEMBERED = 120_000
_DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
_ALIGNED = "block long, stripe int, kind int, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, runs binary, docs binary, times binary"
_SCHEMA = pa.schema([
    ("block", pa.int64()), ("stripe", pa.int32()), ("kind", pa.int32()), ("doc", pa.int32()), *((c, pa.int64()) for c in _DOC), ("groups_sha256", pa.string()),
    *((c, pa.binary()) for c in ("pairs", "runs", "docs", "times")),
])
_RESULT = pa.schema([*((c, pa.int64()) for c in (*_DOC, "n_best", "count_sum")), ("groups_sha256", pa.string())])


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest whole bytes, behind a byte that names their number."""
    size = np.min_scalar_type(int(values.max()) if len(values) else 0).itemsize
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


class PieceEncoder(Encoder):
    """Ids of a sentencepiece vocabulary for texts that begin with the space which that library adds.

    Where no piece holds a space behind another sign, none reaches across the place before a run of
    spaces, so texts are cut there and each distinct piece is read once.
    """

    def __init__(self, path: str, most: int):
        import sentencepiece

        self.most, self.words, self.begins = most, None, True
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.whole = "▁" not in names or any("▁" in n.lstrip("▁") for n in names)
        self._forget()

    def _odd(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        return list(range(len(texts))) if self.whole else []

    @staticmethod
    def _cut(data: np.ndarray, offsets: np.ndarray, odd: list[int]) -> tuple[pa.Array, np.ndarray]:
        cut = data == 32
        cut[1:] &= data[:-1] != 32
        for i in odd:
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        at = np.flatnonzero(cut)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        return pieces, np.searchsorted(at, offsets)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.model.encode([t[1:] for t in texts], num_threads=1)
        got = [ids if t != " " else [self.model.piece_to_id("▁")] for t, ids in zip(texts, got)]  # that library adds no space to nothing
        return np.array([i for ids in got for i in ids], dtype=np.uint32), np.array(list(map(len, got)), dtype=np.int64)

    def spelled(self) -> list[bytes]:
        """Each id's bytes."""
        name = self.model.id_to_piece
        return [bytes([int(name(i)[3:5], 16)]) if self.model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]


def _spelled(encoder: Encoder) -> list[bytes]:
    """Each id's bytes in a byte-level vocabulary."""
    byte = {int(c): b for b, c in enumerate(_ALPHABET.tolist()) if b != 10} | {0x10A: 10}
    names = {i: t for t, i in encoder.tokenizer.get_vocab(with_added_tokens=True).items()}
    return [bytes(byte[ord(c)] for c in names[i]) if i in names and all(ord(c) in byte for c in names[i]) else b"" for i in range(max(names) + 1)]


class Aligner:
    """Both encoders and what their ids spell."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Encoder(a_path, _REMEMBERED, plain=True), PieceEncoder(b_path, _REMEMBERED)
        self.bytes = _spelled(self.a), self.b.spelled()
        self.lengths = tuple(np.array([len(t) for t in table], dtype=np.int64) for table in self.bytes)
        self.sizes = tuple(map(len, self.bytes))
        self.text = [b"%d%c" % (i, sign) for n, signs in zip(self.sizes, (b",|", b",;")) for sign in signs for i in range(n)]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, number a text, B ids, number a text); texts that the tokens don't spell have none."""
        full = pc.fill_null(texts.cast(pa.string()), "")
        spaced = pc.if_else(pc.equal(pc.binary_length(full), 0), "", pc.binary_join_element_wise(pa.scalar(" "), full, pa.scalar("")))
        sides = [encoder.encode(spaced) for encoder in (self.a, self.b)]
        good = np.ones(len(texts), dtype=bool)
        want = pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = None
        for (ids, n), table, length in zip(sides, self.bytes, self.lengths):
            ends = np.concatenate([[0], np.cumsum(length[ids])])[np.cumsum(np.concatenate([[0], n]))]
            good &= np.diff(ends) == want
            spelled = b"".join(map(table.__getitem__, ids.tolist()))
            whole = whole if whole is not None else "".join(spaced.to_pylist()).encode("utf-8", "surrogatepass")
            if spelled != whole:
                at = np.concatenate([[0], np.cumsum(want)]).tolist()
                good &= [spelled[p:q] == whole[x:y] for p, q, x, y in zip(ends.tolist(), ends[1:].tolist(), at, at[1:])]
        if not good.all():
            sides = [(ids[np.repeat(good, n)], np.where(good, n, 0)) for ids, n in sides]
        return *sides[0], *sides[1]

    def align(self, texts: pa.Array) -> Alignment:
        return Alignment(self, *self.read(texts))


class Alignment:
    """The groups of a batch of texts."""

    def __init__(self, own: Aligner, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        self.own, self.a, self.b = own, a.astype(np.int64), b.astype(np.int64)
        self.n_a, self.n_b = n_a, n_b
        ends = [np.cumsum(length[ids]) for length, ids in zip(own.lengths, (self.a, self.b))]
        self.cut_a, self.cut_b = self._met(ends[0], ends[1]), self._met(ends[1], ends[0])
        self.in_a, self.in_b = (np.diff(np.flatnonzero(cut), prepend=-1) for cut in (self.cut_a, self.cut_b))  # tokens of each group
        self.of_text = np.concatenate([[0], np.cumsum(self.cut_a)])[np.concatenate([[0], np.cumsum(n_a)])]
        self.n_groups = np.diff(self.of_text)
        self.n_links = np.diff(np.concatenate([[0], np.cumsum(self.in_a * self.in_b)])[self.of_text])

    @staticmethod
    def _met(ends: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether a token's end is also one of the other side's."""
        at = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=bool)
        at[other] = True
        return at[ends]

    def digests(self) -> list[str]:
        """Each text's groups, hashed; '' without tokens."""
        size_a, size_b = self.own.sizes
        group_a, group_b = np.cumsum(self.cut_a) - self.cut_a, np.cumsum(self.cut_b) - self.cut_b
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + np.concatenate([[0], np.cumsum(self.in_b)])[group_a]] = self.a + size_a * self.cut_a
        order[np.arange(len(self.b)) + np.cumsum(self.in_a)[group_b]] = 2 * size_a + self.b + size_b * self.cut_b
        text, at = self.own.text.__getitem__, np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return [hashlib.sha256(b"".join(map(text, order[x:y].tolist()))[:-1]).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(text, A id, B id, times) of all links; times is None where each is one."""
        text = np.repeat(np.arange(len(self.n_a)), self.n_groups)
        first_a, first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        n = self.in_a * self.in_b
        one = n == 1
        yield text[one], self.a[first_a[one]], self.b[first_b[one]], None
        some = np.flatnonzero((n > 1) & (n <= _WIDE))
        for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(n[some]) // LINKS)) + 1) if len(some) else ():
            k = n[part]
            within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            of = np.repeat(part, k)
            yield text[of], self.a[first_a[of] + within // self.in_b[of]], self.b[first_b[of] + within % self.in_b[of]], None
        for g in np.flatnonzero(n > _WIDE).tolist():
            a, ka = np.unique(self.a[first_a[g] : first_a[g] + self.in_a[g]], return_counts=True)
            b, kb = np.unique(self.b[first_b[g] : first_b[g] + self.in_b[g]], return_counts=True)
            yield np.full(len(a) * len(b), text[g]), np.repeat(a, len(b)), np.tile(b, len(a)), np.outer(ka, kb).ravel()


class Stripes:
    """How A ids are dealt into stripes: id i is row i div n of stripe i mod n."""

    def __init__(self, sizes: tuple[int, int], ids: int):
        self.size_a, self.size_b = sizes
        self.n = -(-self.size_a // ids)
        self.rows = -(-self.size_a // self.n)
        self.cells = self.rows * self.size_b
        if self.n * self.cells >= 1 << (63 - _DOC_BITS):
            raise ValueError("these vocabularies are too large for one key")

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """stripe * cells + the pair's cell."""
        return (a % self.n * self.rows + a // self.n) * self.size_b + b

    def matrix(self) -> np.ndarray:
        return np.zeros(self.cells, np.int64)


class _Block:
    """Links of whole documents, until there are enough of them."""

    def __init__(self, stripes: Stripes, part: int):
        self.stripes, self.number = stripes, part << 32
        self._clear()

    def _clear(self) -> None:
        self.docs, self.links = 0, 0
        self.plain: list[np.ndarray] = []
        self.counted: list[tuple[np.ndarray, np.ndarray]] = []

    def full(self) -> bool:
        return self.links >= LINKS or self.docs >= (1 << _DOC_BITS) - 100_000

    def add(self, found: Alignment) -> range:
        """Takes a batch of texts; gives their numbers in the block."""
        for text, a, b, times in found.links():
            code = self.stripes.code(a, b) << _DOC_BITS | (text + self.docs)
            self.links += len(code)
            if times is None:
                self.plain.append(code)
            else:
                self.counted.append((code, times))
        at = self.docs
        self.docs += len(found.n_a)
        return range(at, self.docs)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair and document, times), sorted."""
        code, times = np.unique(np.concatenate([np.zeros(0, np.int64), *self.plain]), return_counts=True)
        if self.counted:
            code, times = np.concatenate([code, *(c for c, _ in self.counted)]), np.concatenate([times, *(t for _, t in self.counted)])
            code, at = np.unique(code, return_inverse=True)
            summed = np.zeros(len(code), np.int64)
            np.add.at(summed, at, times)
            times = summed
        return code, times

    def rows(self) -> list[tuple]:
        """(block, stripe, pairs, runs, docs, times), packed, a row a stripe; the block is then empty."""
        code, times = self._merged()
        pair, doc = code >> _DOC_BITS, code & ((1 << _DOC_BITS) - 1)
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        stripe, cell, run = pair[first] // self.stripes.cells, pair[first] % self.stripes.cells, np.diff(first, append=len(pair))
        cuts = [*np.flatnonzero(np.diff(stripe, prepend=-1)).tolist(), len(first)]
        out, at = [], np.append(first, len(pair)).tolist()
        for x, y in zip(cuts, cuts[1:]):
            p, q = at[x], at[y]
            out.append((self.number, int(stripe[x]), pack(np.diff(cell[x:y], prepend=0)), pack(run[x:y]), pack(doc[p:q]), pack(times[p:q])))
        self.number += 1
        self._clear()
        return out


_open: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's pair of encoders."""
    claim(__name__, _open.clear)
    if (a_path, b_path) not in _open:
        _open[a_path, b_path] = Aligner(a_path, b_path)
    return _open[a_path, b_path]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], type=f.type) for f in schema], schema=schema)


def _aligned(docs: DataFrame, a_path: str, b_path: str, stripes: Stripes) -> DataFrame:
    """Rows of documents (kind 0) and of blocks' stripes (kind 2)."""

    def run(whole: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        block = _Block(stripes, TaskContext.get().partitionId())
        links = lambda: _batch([(n, s, 2, *[None] * 7, *packed) for n, s, *packed in block.rows()], _SCHEMA)
        for batch in whole:
            for x, y in batches(batch.column(1)):
                found = own.align(batch.column(1).slice(x, y - x))
                at, n = block.add(found), y - x
                columns = [
                    pa.array(np.full(n, block.number)), pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.array(at, dtype=np.int32)), batch.column(0).slice(x, n).cast(pa.int64()),
                    *(pa.array(c.astype(np.int64)) for c in (found.n_a, found.n_b, found.n_groups, found.n_links)), pa.array(found.digests(), pa.string()), *(pa.nulls(n, pa.binary()) for _ in range(4)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)
                if block.full():
                    yield links()
        if block.docs:
            yield links()

    return docs.select("doc_id", "text").mapInArrow(run, _ALIGNED)


def _cells(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))


def _summed(rows: DataFrame, stripes: Stripes, keys: tuple[str, ...]) -> DataFrame:
    """(stripe, pairs, runs): the numbers of all rows with the same keys, of which the first is the stripe, added up."""

    def run(whole: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _open.clear)
        last, cells = None, stripes.matrix()

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(cells)
            out = pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int32()), pa.array([pack(np.diff(at, prepend=0))], pa.binary()), pa.array([pack(cells[at])], pa.binary())], names=["stripe", "pairs", "runs"])
            cells[at] = 0
            return out

        for batch in whole:
            for *key, pairs, runs in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    if last is not None:
                        yield done()
                    last = key
                np.add.at(cells, _cells(pairs), unpack(runs))
        if last is not None:
            yield done()

    placed = rows.select(*keys, "pairs", "runs").repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(run, "stripe int, pairs binary, runs binary")


def _answers(rows: DataFrame, counts: DataFrame, stripes: Stripes, salts: int) -> DataFrame:
    """(block, stripe, counts, best): for each row's pairs in order, their counts, and whether that is the A id's highest."""

    def run(whole: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _open.clear)
        cells, best = stripes.matrix(), None
        for batch in whole:
            out = []
            for stripe, _, block, pairs, runs in zip(*(c.to_pylist() for c in batch.columns)):
                at = _cells(pairs)
                if block is None:  # the counts of the rows that follow
                    cells[:] = 0
                    cells[at] = unpack(runs)
                    best = cells.reshape(stripes.rows, -1).max(1)
                else:
                    n = cells[at]
                    out.append((block, stripe, pack(n), np.packbits(n == best[at // stripes.size_b]).tobytes()))
            names = ["block", "stripe", "counts", "best"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ((), (), (), ()), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=names)

    known = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("block"), "pairs", "runs")
    asked = rows.select("stripe", "salt", "block", "pairs", F.lit(None).cast("binary").alias("runs"))
    placed = known.unionByName(asked).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.asc_nulls_first("block"))
    return placed.mapInArrow(run, "block long, stripe int, counts binary, best binary")


def _scored(aligned: DataFrame, answers: DataFrame) -> DataFrame:
    """The result: each block's documents (kind 0), answers (1) and links (2) meet in one partition."""

    def run(whole: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _open.clear)
        last, docs, answer = None, [], None
        best = total = np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            full = [(*d[1:-1], int(best[d[0]]), int(total[d[0]]), d[-1]) if d[0] < len(best) else (*d[1:-1], 0, 0, d[-1]) for d in docs]
            return _batch(full, _RESULT)

        for batch in whole:
            for block, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if block != last:
                    if docs:
                        yield done()
                    last, docs, best, total = block, [], np.zeros(0, np.int64), np.zeros(0, np.int64)
                if kind == 0:
                    docs.append(row[:7])
                    continue
                runs, doc, times, counts, high = row[7:]
                if kind == 1:
                    answer = unpack(counts), high
                    continue
                if not len(best):
                    best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                runs, doc, times = unpack(runs), unpack(doc), unpack(times)
                n, high = answer[0], np.unpackbits(np.frombuffer(answer[1], np.uint8), count=len(runs)).astype(np.int64)
                np.add.at(best, doc, times * np.repeat(high, runs))
                np.add.at(total, doc, times * np.repeat(n, runs))
        if docs:
            yield done()

    columns = ("doc", *_DOC, "groups_sha256", "runs", "docs", "times")
    none = F.lit(None)
    told = answers.select("block", "stripe", F.lit(1).alias("kind"), *(none.cast(dict(aligned.dtypes)[c]).alias(c) for c in columns), "counts", "best")
    rows = aligned.select("block", "stripe", "kind", *columns, none.cast("binary").alias("counts"), none.cast("binary").alias("best")).unionByName(told)
    placed = rows.repartition("block").sortWithinPartitions("block", "stripe", "kind").select("block", "kind", *columns, "counts", "best")
    kinds = ", ".join(f"{c} long" for c in (*_DOC, "n_best", "count_sum"))
    return placed.mapInArrow(run, f"{kinds}, groups_sha256 string").select(*_DOC, "n_best", "count_sum", "groups_sha256")


def align(docs: DataFrame, a_path: str, b_path: str, stripe_ids: int = STRIPE_IDS, salt_blocks: int = SALT_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(documents, counts): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each
    document; and per stripe the packed cells and counts of all linked pairs, as ``pair_counts`` lists them.

    ``a_path``: a byte-level file of the tokenizers library; ``b_path``: a sentencepiece model.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    own = Aligner(a_path, b_path)
    stripes = Stripes(own.sizes, stripe_ids)
    aligned = scratch.keep(_aligned(docs, a_path, b_path, stripes), "aligned")
    blocks = aligned.where("kind = 2").select("block", "stripe", "pairs", "runs")
    salts = max(1, -(-aligned.where("kind = 0 AND doc = 0").count() // salt_blocks))
    blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    counts = scratch.keep(_summed(_summed(blocks, stripes, ("stripe", "salt")), stripes, ("stripe",)), "counts")
    return _scored(aligned, _answers(blocks, counts, stripes, salts)), counts


def pair_counts(counts: DataFrame, a_path: str, b_path: str, stripe_ids: int = STRIPE_IDS) -> DataFrame:
    """(a, b, documents, best): each linked pair, how many documents hold it, whether that is its A id's highest."""
    stripes = Stripes(Aligner(a_path, b_path).sizes, stripe_ids)

    def run(whole: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole:
            for stripe, pairs, runs in zip(*(c.to_pylist() for c in batch.columns)):
                at, n = _cells(pairs), unpack(runs)
                top = np.zeros(stripes.rows, np.int64)
                np.maximum.at(top, at // stripes.size_b, n)
                yield pa.RecordBatch.from_arrays([pa.array(at // stripes.size_b * stripes.n + stripe), pa.array(at % stripes.size_b), pa.array(n), pa.array(n == top[at // stripes.size_b])], names=["a", "b", "documents", "best"])

    return counts.select("stripe", "pairs", "runs").mapInArrow(run, "a long, b long, documents long, best boolean")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return align(read(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))[0]
