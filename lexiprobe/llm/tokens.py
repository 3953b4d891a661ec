"""Token ids of whole texts from a vocabulary file of the tokenizers library.

A text is cut where no token can reach across: before a single space, before and behind a single
line break, and before a full stop or comma behind a letter or digit. The cuts are places in the
batch's bytes, so pieces are views of the texts. Each distinct piece of a batch is encoded once, and
the ids of a text are its pieces' ids in a row. Texts with longer runs of white space or signs at
those places are pieces of their own. Ids are the same as those of
``Tokenizer.encode(text, add_special_tokens=False)``.

Words of plain Latin letters skip the tokenizer's normaliser and splitting pattern, which leave them
as they are but for lower case and the byte alphabet: the same model reads them, spelled so already.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import claim

#: Bytes a piece starts with.
_CUTS = np.zeros(256, dtype=bool)
_CUTS[list(b" \n.,")] = True
#: White space other than space and line break, and the one letter whose lower case does not end in
#: a letter.
_RARE = re.compile("[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u0130\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A full stop or comma that is not behind a letter or digit.
_STOP = re.compile(r"[.,](?<![^\W_].)", re.DOTALL)
#: Words of letters that are normal forms and have lower cases of one letter each.
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
#: Pieces remembered at most, where the caller doesn't say, and ids in them for each; it bounds memory and changes no result.
_MOST, _IDS = 250_000, 10
#: Characters of the longest piece that is remembered.
_LONG = 48
_open: dict[str, "Encoder"] = {}


def _plain(text: str) -> bool:
    """Whether the text may be cut."""
    if "  " in text or " \n" in text or "\n\n" in text or "\n " in text:
        return False
    return not (_RARE.search(text) or _STOP.search(text))


def _suspicious() -> np.ndarray:
    """By two bytes in a row, as one number: whether a text with them needs the closer look of ``_plain``."""
    out = np.zeros((256, 256), dtype=bool)
    white, stops = list(b" \n"), list(b".,")
    out[np.ix_(white, white)] = True
    out[:, stops] = True
    out[np.ix_(list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), stops)] = False
    for c in map(chr, (*range(32), 0x85, 0xA0, 0x130, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)):
        if c != "\n":
            raw = c.encode()
            if len(raw) == 1:
                out[:, raw[0]] = True
            else:
                out[raw[0], raw[1]] = True
    return out.reshape(-1)


_SUSPICIOUS = _suspicious()


def _odd(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Places of the texts that may not be cut; all others are told apart by their bytes alone."""
    if not len(data):
        return []
    pairs = data[:-1].astype(np.uint16)
    pairs <<= 8
    pairs |= data[1:]
    at = np.flatnonzero(_SUSPICIOUS[pairs]) + 1
    # A stop behind a Latin-1 letter of two bytes is as good as one behind a plain letter.
    stop = (data[at] == 46) | (data[at] == 44)
    latin = stop & (at > 1) & (data[at - 2] == 0xC3) & (data[at - 1] >= 128) & (data[at - 1] != 0x97) & (data[at - 1] != 0xB7)
    first = offsets[:-1][offsets[:-1] < offsets[1:]]  # bytes without one before them in their text
    first = first[(data[first] < 32) | (data[first] == 46) | (data[first] == 44)]
    suspects = np.unique(np.searchsorted(offsets, np.concatenate([at[~latin], first]), "right") - 1)
    return [i for i, t in zip(suspects.tolist(), texts.take(pa.array(suspects)).to_pylist()) if not _plain(t)]


def _byte_alphabet() -> np.ndarray:
    """The code point that stands for each byte in byte-level vocabularies; a line break, the separator here, becomes a space.

    Fixed values: printable bytes stand for themselves, the others follow from 256 on in order.
    """
    table = np.arange(256, dtype="<u4")
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    table[odd] = 256 + np.arange(len(odd))
    table[10] = 32
    return table


_ALPHABET = _byte_alphabet()
_BREAK = "\u010a"  # a line break in that alphabet


class Encoder:
    """Turns arrays of texts into ids."""

    def __init__(self, path: str, most: int | None = None, plain: bool = False):
        """``plain``: strings of special tokens are ordinary text."""
        self.most = most or _MOST
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self._borders()
        self._stripped(path)
        self._forget()

    def _borders(self) -> None:
        """Which ids begin a word of letters, or end one, where the vocabulary's own signs tell."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        first = self.tokenizer.id_to_token(self.tokenizer.encode(" a", add_special_tokens=False).ids[0])
        self.begins = not first.endswith("</w>")  # else white space leaves no trace in the ids
        self.border = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.border[[i for t, i in vocabulary.items() if (t.startswith(first[0]) if self.begins else t.endswith("</w>"))]] = True
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _stripped(self, path: str) -> None:
        """The same model behind white space alone, if the file's other steps are those that words need not take."""
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        steps = [s["type"] for s in (parts["normalizer"] or {}).get("normalizers", [parts["normalizer"]] if parts["normalizer"] else [])]
        splits = parts["pre_tokenizer"] or {}
        self.words = None
        if parts["model"]["type"] == "BPE" and steps in ([], ["NFC", "Replace", "Lowercase"]) and "ByteLevel" in json.dumps(splits):
            self.lower = bool(steps)
            self.words = Tokenizer(self.tokenizer.model)  # shared, not loaded again
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ends: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0
        self.start, self.known = np.zeros(1 << 16, np.int64), 0  # of each known piece; the next one's start is its end

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Puts further pieces behind the known ones; gives the place of the first."""
        first, n, m = self.known, len(sizes), len(ids)
        if self.used + m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(m, len(self.ids)), np.uint32)])
        if first + n + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(max(n + 1, len(self.start)), np.int64)])
        self.ids[self.used : self.used + m] = ids
        self.start[first] = self.used
        self.start[first + 1 : first + n + 1] = self.used + np.cumsum(sizes)
        self.used, self.known = self.used + m, first + n
        return first

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); null counts as empty, ``end_id`` closes each text."""
        if len(self.at) > self.most or self.used > _IDS * self.most:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        pieces, bounds = self._cut(data, offsets, self._odd(texts, data, offsets))
        coded = pieces.dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        if end_id is not None:
            if end_id not in self.ends:
                self.ends[end_id] = self._add(np.array([end_id], np.uint32), np.ones(1, np.int64))
            place, bounds = np.insert(place, bounds[1:], self.ends[end_id]), bounds + np.arange(n + 1)
        begin = self.start[place]
        sizes = self.start[place + 1] - begin
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(begin - ends[:-1], sizes)
        at += np.arange(len(at))
        return self.ids[at], np.diff(ends[bounds])

    def _odd(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        return _odd(texts, data, offsets)

    @staticmethod
    def _cut(data: np.ndarray, offsets: np.ndarray, odd: list[int]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and the place of each text's first piece (and of the end)."""
        cut = _CUTS[data]
        cut[1:] |= data[:-1] == 10
        for i in odd:
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        at = np.flatnonzero(cut)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        return pieces, np.searchsorted(at, offsets)

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where the ids of each piece are; new pieces are encoded."""
        place = np.array(list(map(self.at.get, pieces, repeat(-1))), dtype=np.int64)
        new = np.flatnonzero(place < 0)
        texts = [pieces[i] for i in new]
        word = _WORD.fullmatch
        kind = [0 if self.words is None else 1 if word(p) else 2 if p[0] == " " and word(p, 1) else 0 for p in texts]
        kind = np.array(kind, dtype=np.int8)
        if not self.begins:  # the ids of a word are the same behind a space
            kind = np.minimum(kind, 1)
        for k, read in enumerate((self._whole, self._bare, self._spaced)):
            group = np.flatnonzero(kind == k)
            for part in np.split(group, range(10_000, len(group), 10_000)) if len(group) else ():
                some = [texts[i] for i in part.tolist()]
                first = self._add(*read(some))
                places = range(first, first + len(some))
                place[new[part]] = places
                short = max(map(len, some)) <= _LONG
                self.at.update(zip(some, places) if short else ((p, at) for p, at in zip(some, places) if len(p) <= _LONG))
        return place

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], dtype=np.uint32), np.array(list(map(len, got)), dtype=np.int64)

    def _read(self, text: str, between: str = " ") -> np.ndarray:
        """Ids of words, one a line, by one call."""
        raw = np.frombuffer((text.lower() if self.lower else text).encode(), np.uint8)
        spelled = _ALPHABET[raw].tobytes().decode("utf-32-le")
        if between != " ":
            spelled = between[1:] + spelled.replace(" ", between)
        return np.array(self.words.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words behind a space, in vocabularies whose ids tell where a word begins."""
        ids = self._read("\n".join(words))
        at = np.flatnonzero(self.border[ids])
        return (ids, np.diff(np.append(at, len(ids)))) if len(at) == len(words) else self._whole(words)

    def _bare(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.begins:
            ids = self._read("\n".join(words).replace(" ", ""))
            at = np.flatnonzero(self.border[ids])
            return (ids, np.diff(at, prepend=-1)) if len(at) == len(words) else self._whole(words)
        # A line break stands before each word; no word of letters holds one.
        ids = self._read("\n".join(words), f" {_BREAK} ")
        at = np.flatnonzero(ids == self.line[0])
        if len(at) != len(words) or len(self.line) != 1:
            return self._whole(words)
        return np.delete(ids, at), np.diff(np.append(at, len(ids))) - 1


def encoder(path: str, most: int | None = None) -> Encoder:
    """The worker's encoder of that file; a worker keeps it until another operator's task comes."""
    claim(__name__, _open.clear)
    if path not in _open:
        _open[path] = Encoder(path)
    _open[path].most = most or _MOST
    return _open[path]


def batches(texts: pa.Array, most: int = 3_400_000) -> Iterator[tuple[int, int]]:
    """Slices (from, to) of about ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = size = 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)
