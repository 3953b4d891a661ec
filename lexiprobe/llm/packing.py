"""Bounded-space online packing of documents into sequences of a fixed length.

Each partition keeps a fixed number of open windows. A document's whole windows are sequences of
their own; its tail goes into the open window it fits best. Where none fits and all are in use, the
fullest is emitted: its gap is filled with the head of the tail if that gap is worth a cut, else it
is left as padding. What is still open at the end of a partition is merged: the leftovers of a
fixed number of partitions are packed together, so no task holds more than a fixed number of windows.

Defined results
---------------
* A null text counts as empty; each document ends with ``end_id``, so an empty one has one token.
* Rows with a null doc_id are packed like others. Repeated rows are packed each on its own, with
  pieces of their own. The order within a partition is the order of its rows; ties between windows
  fall to the one opened first. An empty table gives no pieces. Only ``doc_id`` and ``text`` are
  read, so further columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, ship
from .tokens import batches, encoder

#: Partitions whose leftovers are merged in one task.
MERGED = 64
#: Sequence ids: the partition's number times this, plus a count.
STEP = 1 << 32
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, left_of long"
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary()), ("left_of", pa.int64())])

Piece = tuple  # doc_id, start, ids as bytes, doc_tokens


class Packer:
    """Open windows of one partition; ``done`` collects closed windows as lists of pieces."""

    def __init__(self, length: int, windows: int, min_cut: int):
        self.length, self.windows, self.min_cut = length, windows, min_cut
        self.open: list[list] = []  # [free, pieces]
        self.done: list[list[Piece]] = []

    def add(self, doc_id: int | None, ids: bytes, start: int = 0, doc_tokens: int | None = None) -> None:
        n, at = len(ids) // 4, 0
        whole = doc_tokens if doc_tokens is not None else n
        while n - at >= self.length:
            self.done.append([(doc_id, start + at, ids[4 * at : 4 * (at + self.length)], whole)])
            at += self.length
        while at < n:
            need = n - at
            best = None
            for w in self.open:
                if w[0] >= need and (best is None or w[0] < best[0]):
                    best = w
            if best is None and len(self.open) < self.windows:
                self.open.append(best := [self.length, []])
            if best is None:
                fullest = min(self.open, key=lambda w: w[0])
                if fullest[0] >= self.min_cut:
                    best, need = fullest, fullest[0]
                else:
                    self._close(fullest)
                    continue
            best[1].append((doc_id, start + at, ids[4 * at : 4 * (at + need)], whole))
            best[0] -= need
            at += need
            if best[0] == 0:
                self._close(best)

    def _close(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self.done.append(window[1])


class _Rows:
    """Closed windows as rows."""

    def __init__(self, part: int, with_ids: bool):
        self.next, self.with_ids = part * STEP, with_ids
        self.rows: list[tuple] = []

    def take(self, windows: list[list[Piece]], left_of: int | None = None) -> None:
        for pieces in windows:
            offset = 0
            for doc_id, start, ids, whole in pieces:
                self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), whole, self.next, offset, ids if self.with_ids or left_of is not None else None, left_of))
                offset += len(ids) // 4
            self.next += 1

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(c), type=t.type) for c, t in zip(zip(*self.rows), _ARROW)] if self.rows else [pa.array([], type=t.type) for t in _ARROW], schema=_ARROW)
        self.rows = []
        return out


def pack(
    docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, windows: int = 32, min_cut: int = 32, with_ids: bool = True
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``tokenizer`` is the path of a vocabulary file; ``ids`` are little-endian unsigned 32-bit ids
    (null without ``with_ids``). The pieces of a sequence stand gapless from offset 0.
    """
    def partition(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
        packer, out = Packer(length, windows, min_cut), _Rows(part, with_ids)
        for batch in rows:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in batches(texts):
                flat, sizes = encode(texts.slice(a, b - a), end_id)
                raw, at = flat.tobytes(), 0
                for key, n in zip(keys[a:b], sizes.tolist()):
                    packer.add(key, raw[at : at + 4 * n])
                    at += 4 * n
                out.take(packer.done)
                packer.done = []
                yield out.batch()
        out.take([w[1] for w in packer.open], left_of=part)
        yield out.batch()

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packer, out = Packer(length, windows * MERGED, 1), _Rows(0, with_ids)
        out.next = -(int(key[0]) + 1) * STEP  # below 0: no other sequence has these
        pieces = sorted(zip(pdf["doc_id"], pdf["start"], pdf["ids"], pdf["doc_tokens"], pdf["sequence_id"], pdf["offset"]), key=lambda p: (-len(p[2]), p[4], p[5]))
        total = sum(len(p[2]) // 4 for p in pieces)
        packer.windows = -(-total // length)  # as few as hold them all
        for doc_id, start, ids, whole, _, _ in pieces:
            packer.add(None if doc_id is None else int(doc_id), bytes(ids), int(start), int(whole))
        out.take(packer.done)
        out.take([w[1] for w in packer.open])
        return out.batch().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "packing")
    placed = scratch.keep(docs.select("doc_id", "text").mapInArrow(partition, _SCHEMA), "placed")
    # Ids go as text: a column of longs and nulls would reach pandas as floats, which hold 53 bits.
    groups = placed.where("left_of is not null").selectExpr("*", f"left_of div {MERGED} as merged").withColumn("doc_id", F.col("doc_id").cast("string"))
    merged = groups.groupBy("merged").applyInPandas(merge, _SCHEMA)
    return placed.where("left_of is null").unionByName(merged).drop("left_of")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")
