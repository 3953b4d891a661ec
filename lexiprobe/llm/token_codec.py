"""Token ids in files: context-mixing predictions drive a range coder in independent blocks.

A block holds up to LANES * STEPS ids, cut into lanes of STEPS ids that are coded side by side, one
id of every lane at a time, all with one adaptive model. It names the ids that occur in it (its
alphabet); the model works on their ranks and mixes three distributions:

* order 2: all on the id that last followed the two ids before, with a count of how often it was right;
* order 1: all on the id that last followed the id before, likewise;
* order 0: the frequencies of the ids of the block so far, one slot at least for each of the alphabet.

The weights of the mixture are the shares with which each order was right before, kept apart by the
confidence of both upper orders and by whether they agree. One step of a range coder codes an id
with its probability in the mixture: state and range have 64 bits, and a carry runs back through the
words put out. The model starts anew in every block, and a block carries checksums of its bytes and
of its ids, so blocks are read independently.

A frame is a run of whole documents (ids and lengths) with their blocks; files are Parquet tables of
frames (part, frame, n_ids, payload), written and read by Spark, in ascending doc_id order.

Defined results
---------------
* A null text counts as empty; each document ends with ``end_id``, so an empty one has one id.
* Null doc_ids come last. Repeated rows are documents of their own, in order of their texts. An
  empty table gives no rows. Only ``doc_id`` and ``text`` are read, so further columns may have any
  name. Ids from 2 ** 22 on are refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read
from .tokens import batches, encoder

STEPS, LANES = 512, 4096
MAGIC = b"LXT2"
_U, _I = np.uint64, np.int32
#: The range is kept above this; below it, the upper half of the state is put out.
_LEAST = _U(1 << 32)
_ORDER2_BITS = 17
#: Pieces of text whose ids a worker remembers: nothing else is large here.
PIECES = 1_200_000
_HEAD = struct.Struct("<4sIIIIIII")  # magic, ids, lanes, largest id, bytes of alphabet, bytes of words, crc of ids, crc of the rest


class _Model:
    """Predictions and mixing weights over the ranks of a block's alphabet; encoder and decoder feed it the same ranks.

    A rank's share of the total 2 ** bits is the mixture of three distributions: order 0 over 2 **
    slot_bits slots, times its weight, and the weights of orders 1 and 2 on the one rank each predicts.
    """

    def __init__(self, size: int, lanes: int):
        self.size = size
        self.slot_bits = max(16, size.bit_length() + 1)
        self.weight_bits = min(12, 30 - self.slot_bits)
        self.bits = self.slot_bits + self.weight_bits
        self.after1 = np.zeros(size, dtype=_I)  # predicted rank * 4 + confidence
        self.after2 = np.zeros(1 << _ORDER2_BITS, dtype=_I)
        self.right = np.ones((32, 3), dtype=np.int64) * np.array([2, 2, 4])
        self.count = np.zeros(size, dtype=np.int64)
        self.last, self.before = np.zeros(lanes, dtype=_I), np.zeros(lanes, dtype=np.uint32)
        self.fresh: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.at = 0
        self._refresh()

    def _refresh(self) -> None:
        """Order-0 frequencies (each rank has one slot at least) and mixing weights from what was seen so far."""
        slots = 1 << self.slot_bits
        if self.fresh:
            self.count += np.bincount(np.concatenate(self.fresh), minlength=self.size)
            marks = np.bincount(np.concatenate(self.marks), minlength=128).reshape(32, 4)  # hits: none, order 2, order 1, both
            self.right += np.stack([marks[:, 1] + marks[:, 3], marks[:, 2], marks[:, 0]], 1)
            self.fresh, self.marks = [], []
        room = slots - self.size
        freq = 1 + self.count * room // max(int(self.count.sum()), 1)
        freq[int(freq.argmax())] += slots - int(freq.sum())
        self.freq = freq.astype(np.int64)
        self.start = np.cumsum(freq) - freq
        self.slots = np.repeat(np.arange(self.size, dtype=_I), freq)
        whole = 1 << self.weight_bits
        weight = 1 + self.right[:, :2] * (whole - 3) // self.right.sum(1, keepdims=True)
        self.w0 = whole - weight.sum(1)
        self.w1, self.w2 = weight[:, 1] << self.slot_bits, weight[:, 0] << self.slot_bits

    def predict(self, lanes: int) -> None:
        """Predictions and weights of the first ``lanes`` lanes."""
        last = self.last[:lanes]
        key = self.before[:lanes] ^ last.view(np.uint32) * np.uint32(0x85EBCA6B)
        key ^= key >> np.uint32(15)
        self.cell = (key & np.uint32((1 << _ORDER2_BITS) - 1)).view(_I)
        self.two, self.one = self.after2.take(self.cell), self.after1.take(last)
        self.p2, self.p1 = self.two >> 2, self.one >> 2
        context = (self.two & 3) << 3
        context |= (self.one & 3) << 1
        context |= self.p1 == self.p2
        self.context = context
        self.s0, self.s1, self.s2 = self.w0.take(context), self.w1.take(context), self.w2.take(context)

    def share(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the ranks' parts of the total."""
        self.hit2, self.hit1 = x == self.p2, x == self.p1
        size = self.s0 * self.freq.take(x)
        size += self.s2 * self.hit2
        size += self.s1 * self.hit1
        start = self.s0 * self.start.take(x)
        start += self.s2 * (self.p2 < x)
        start += self.s1 * (self.p1 < x)
        return start, size

    def at_target(self, t: np.ndarray) -> np.ndarray:
        """The ranks whose parts hold the targets: each prediction's own part is taken out, the rest are order-0 slots."""
        part = self.s0 * self.start.take(self.p2)
        part += self.s1 * (self.p1 < self.p2)
        np.subtract(t, part, out=part)
        np.maximum(part, 0, out=part)
        t = t - np.minimum(part, self.s2)
        part = t - self.s0 * self.start.take(self.p1)
        np.maximum(part, 0, out=part)
        t -= np.minimum(part, self.s1)
        return self.slots.take((t / self.s0).astype(np.int64))  # exact: both are far below 2 ** 53

    def learn(self, x: np.ndarray) -> None:
        """``share`` has been asked for the same ranks."""
        fresh = x << 2
        for table, cell, old, hit in ((self.after2, self.cell, self.two, self.hit2), (self.after1, self.last[: len(x)], self.one, self.hit1)):
            sure = old & 3
            table[cell] = np.where(hit, old + (sure < 3), np.where(sure > 0, old - 1, fresh))
        mark = self.context << 2
        mark |= self.hit2
        mark |= self.hit1.astype(_I) << 1
        self.marks.append(mark.astype(np.uint8))
        self.fresh.append(x)
        self.before[: len(x)] = self.last[: len(x)].view(np.uint32) * np.uint32(0x9E3779B1)
        self.last[: len(x)] = x
        self.at += 1
        if self.at & (self.at - 1) == 0 or self.at % 64 == 0:
            self._refresh()


class _Writer:
    """Range coders side by side, 64 bits of state each; a lane puts out one 32-bit word a step at most."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
        self.words = np.zeros((lanes, STEPS + 2), dtype="<u4")
        self.used = np.zeros(lanes, dtype=np.int64)

    def code(self, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        n = len(start)
        low, rng = self.low[:n], self.range[:n]
        rng >>= _U(bits)
        add = start.view(_U) * rng
        low += add
        over = np.flatnonzero(low < add)
        if len(over):
            self._carry(over)
        rng *= size.view(_U)
        at = np.flatnonzero(rng < _LEAST)
        if len(at):
            place = self.used[at]
            out = low[at]
            self.words[at, place] = out >> _U(32)
            self.used[at] = place + 1
            low[at] = out << _U(32)
            rng[at] <<= _U(32)

    def _carry(self, lanes: np.ndarray) -> None:
        """Adds one to the last word put out, and on through words that are full."""
        place = self.used[lanes] - 1
        while len(lanes):
            self.words[lanes, place] += np.uint32(1)
            full = self.words[lanes, place] == 0
            lanes, place = lanes[full], place[full] - 1

    def finish(self) -> tuple[np.ndarray, bytes]:
        at = np.arange(len(self.low))
        self.words[at, self.used], self.words[at, self.used + 1] = self.low >> _U(32), self.low & _U(0xFFFFFFFF)
        self.used += 2
        keep = np.arange(self.words.shape[1])[None, :] < self.used[:, None]
        return self.used.astype("<u2"), self.words[keep].tobytes()


class _Reader:
    """Range decoders side by side; ``value`` is what was read less the lower end of the range."""

    def __init__(self, used: np.ndarray, words: np.ndarray):
        self.at = np.cumsum(used.astype(np.int64)) - used
        self.words = words.astype(_U)
        self.value = self.words[self.at] << _U(32) | self.words[self.at + 1]
        self.at += 2
        self.range = np.full(len(used), ~_U(0))

    def target(self, n: int, bits: int) -> np.ndarray:
        self.range[:n] >>= _U(bits)
        return np.minimum(self.value[:n] // self.range[:n], _U((1 << bits) - 1)).view(np.int64)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        n = len(start)
        value, rng = self.value[:n], self.range[:n]
        value -= start.view(_U) * rng
        rng *= size.view(_U)
        at = np.flatnonzero(rng < _LEAST)
        if len(at):
            place = self.at[at]
            value[at] = value[at] << _U(32) | self.words[place]
            self.at[at] = place + 1
            rng[at] <<= _U(32)


def _lanes(n: int) -> tuple[int, int]:
    """Lanes of a block of n ids, and how many ids the last lane has."""
    lanes = -(-n // STEPS)
    return lanes, n - (lanes - 1) * STEPS


def encode_block(ids: np.ndarray) -> bytes:
    """A block of 1 to STEPS * LANES ids."""
    n, largest = len(ids), int(ids.max())
    if largest >= 1 << 22:
        raise ValueError(f"token id {largest} is beyond this format")
    lanes, tail = _lanes(n)
    there = np.zeros(largest + 1, dtype=bool)
    there[ids] = True
    rank = np.cumsum(there, dtype=_I) - _I(1)
    grid = np.zeros(lanes * STEPS, dtype=_I)
    grid[:n] = rank[ids]
    grid = np.ascontiguousarray(grid.reshape(lanes, STEPS).T)
    model, out = _Model(int(rank[-1]) + 1, lanes), _Writer(lanes)
    for t in range(STEPS if lanes > 1 else tail):
        live = lanes if t < tail else lanes - 1
        x = grid[t, :live]
        model.predict(live)
        out.code(*model.share(x), model.bits)
        model.learn(x)
    used, words = out.finish()
    alphabet = zlib.compress(np.packbits(there).tobytes(), 6)
    body = alphabet + used.tobytes() + words
    return _HEAD.pack(MAGIC, n, lanes, largest, len(alphabet), len(words), zlib.crc32(ids.astype("<u4")), zlib.crc32(body)) + body


def decode_block(data: memoryview | bytes) -> tuple[np.ndarray, int]:
    """(ids as unsigned 32-bit numbers, bytes read); raises ValueError where a checksum differs."""
    magic, n, lanes, largest, letters, size, crc_ids, crc_body = _HEAD.unpack_from(data)
    body = bytes(data[_HEAD.size : _HEAD.size + letters + 2 * lanes + size])
    if magic != MAGIC or zlib.crc32(body) != crc_body:
        raise ValueError("damaged block")
    there = np.unpackbits(np.frombuffer(zlib.decompress(body[:letters]), np.uint8), count=largest + 1)
    alphabet = np.flatnonzero(there).astype("<u4")
    source = _Reader(np.frombuffer(body, "<u2", lanes, letters), np.frombuffer(body, "<u4", size // 4, letters + 2 * lanes))
    tail = _lanes(n)[1]
    model = _Model(len(alphabet), lanes)
    grid = np.zeros((STEPS, lanes), dtype=_I)
    for t in range(STEPS if lanes > 1 else tail):
        live = lanes if t < tail else lanes - 1
        model.predict(live)
        grid[t, :live] = x = model.at_target(source.target(live, model.bits))
        source.take(*model.share(x))
        model.learn(x)
    ids = alphabet[grid.T.reshape(-1)[:n]]
    if zlib.crc32(ids) != crc_ids:
        raise ValueError("ids differ from their checksum")
    return ids, _HEAD.size + len(body)


def encode_frame(doc_ids: list[int | None], sizes: np.ndarray, flat: np.ndarray) -> bytes:
    """Whole documents: their ids and lengths, then blocks of all their token ids."""
    flags = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    ids = np.array([d or 0 for d in doc_ids], dtype="<i8")
    blocks = [encode_block(flat[a : a + STEPS * LANES]) for a in range(0, len(flat), STEPS * LANES)]
    table = zlib.compress(flags.tobytes() + ids.tobytes() + sizes.astype("<u4").tobytes(), 1)
    return struct.pack("<IIII", len(doc_ids), len(blocks), len(table), zlib.crc32(table)) + table + b"".join(blocks)


def decode_frame(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, token counts, all token ids)."""
    docs, blocks, size, crc = struct.unpack_from("<IIII", data)
    table = data[16 : 16 + size]
    if zlib.crc32(table) != crc:
        raise ValueError("damaged frame")
    raw = zlib.decompress(table)
    flags = np.frombuffer(raw, np.uint8, docs)
    ids = np.frombuffer(raw, "<i8", docs, docs)
    sizes = np.frombuffer(raw, "<u4", docs, 9 * docs)
    view, at, got = memoryview(data), 16 + size, []
    for _ in range(blocks):
        block, used = decode_block(view[at:])
        got.append(block)
        at += used
    return [int(i) if f else None for f, i in zip(flags, ids)], sizes, np.concatenate(got) if got else np.zeros(0, "<u4")


_FRAMES = "part int, frame int, first_id long, n_ids long, payload binary"


def runs(rows: Iterator[pa.RecordBatch], encode, end_id: int, most: int = STEPS * LANES) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, sizes, ids) of runs of whole documents of at most ``most`` ids; a longer document is a run of its own."""
    keys: list[int | None] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in rows:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for a, b in batches(texts, 8_000_000):
            flat, sizes = encode(texts.slice(a, b - a), end_id)
            ends = np.cumsum(sizes)
            at = 0  # the first document of this slice that isn't held yet
            while at < b - a:
                begin = int(ends[at] - sizes[at])
                upto = int(np.searchsorted(ends, most - size + begin, "right"))
                if upto == at and not keys:
                    upto = at + 1
                if upto > at:
                    end = int(ends[upto - 1])
                    keys += ids[a + at : a + upto]
                    held.append((sizes[at:upto], flat[begin:end]))
                    size += end - begin
                    at = upto
                if at < b - a:
                    yield keys, *(np.concatenate(parts) for parts in zip(*held))
                    keys, held, size = [], [], 0
    if keys:
        yield keys, *(np.concatenate(parts) for parts in zip(*held))


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Writes the token ids of ``docs`` to ``path`` in ascending doc_id order."""
    schema = pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        for frame, (keys, sizes, flat) in enumerate(runs(rows, encoder(tokenizer, PIECES).encode, end_id)):
            row = (part, frame, first, len(flat), encode_frame(keys, sizes, flat))
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, schema)], schema=schema)
            first += len(flat)

    # A null id sorts behind all others.
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")]
    placed = docs.select("doc_id", "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    placed.mapInArrow(run, _FRAMES).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """A row per document of the files: doc_id, start, n_tokens, ids_crc32, ids (unless not asked for)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, first, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                keys, sizes, flat = decode_frame(payload)
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = flat.tobytes()
                cuts = [(4 * int(e - n), 4 * int(e)) for e, n in zip(ends, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(first + ends - sizes, pa.int64()), pa.array(sizes.astype(np.int64), pa.int64()), pa.array([zlib.crc32(raw[a:b]) for a, b in cuts], pa.int64()), pa.array([raw[a:b] if with_ids else None for a, b in cuts], pa.binary())],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    frames = spark.read.schema(_FRAMES).parquet(path)
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a partition
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    docs = frames.select("part", "first_id", "payload").mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    out = docs.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{Scratch(spark, 'token-ids').path}/files"
    write_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_ids(spark, path, with_ids=False)
