import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as p
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexiprobe.llm import token_alignment as ta

A, B = p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")


def ends(tokens):
    out, at = [], 0
    for t in tokens:
        out.append(at := at + len(t))
    return out


class Brute:
    """Token by token, with both libraries as they are."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        byte = {c: i for i, c in enumerate(self._alphabet())}
        self.a_bytes = lambda i: bytes(byte[c] for c in self.a.id_to_token(i))

    @staticmethod
    def _alphabet():
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

    def b_bytes(self, i):
        t = self.b.id_to_piece(i)
        return bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_bytes, b_bytes = list(map(self.a_bytes, a)), list(map(self.b_bytes, b))
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            return []
        ea, eb = ends(a_bytes), ends(b_bytes)
        out, i, j = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            x, y = ea.index(cut, i) + 1, eb.index(cut, j) + 1
            out.append((a[i:x], b[j:y]))
            i, j = x, y
        return out

    def rows(self, docs):
        found = [self.groups(t) for _, t in docs]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for g in found]
        count = Counter(pair for c in links for pair in c)
        best = {}
        for (x, _), n in count.items():
            best[x] = max(n, best.get(x, 0))
        out = []
        for (doc_id, _), g, c in zip(docs, found, links):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            out.append((
                doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(k for pair, k in c.items() if count[pair] == best[pair[0]]),
                sum(k * count[pair] for pair, k in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
            ))
        return out, count


@pytest.fixture(scope="module")
def brute():
    return Brute()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


ODD = [
    "", " ", "  a   b", "\n\n\n\n", "a\tb\r\nc", "x▁y", "<|endoftext|> and </s> <0x0A>", "naïve Straße 中文字符 🙂🙂🙃", "   ", "   wide", "0x" + "a1" * 400, "é" * 50, "Hello, world! It's 12,345.67",
    " " * 3000, "ab" * 5000, "𝕏" * 200, "\x00\x01", "tail ", "don't  stop\n  now",
]


def test_equals_brute_force_on_documents(docs, brute):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, count = brute.rows(rows)
    got, counts = ta.align(docs, A, B)
    assert ordered(got.collect()) == ordered(want)
    pairs = {(r["a"], r["b"]): r["documents"] for r in ta.pair_counts(counts, A, B).collect()}
    assert pairs == count


def test_odd_texts(spark, brute, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD * 2)] + [(None, "a b"), (1, None), ((1 << 60) + 1, "big id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ordered(ta.align(df, A, B)[0].collect()) == ordered(brute.rows(rows)[0])
    # Several salts give the same.
    assert ordered(ta.align(df, A, B, stripe_ids=2000, salt_blocks=1)[0].collect()) == ordered(brute.rows(rows)[0])


def test_messy_rows_and_none(messy, nothing, brute):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert ordered(ta.align(messy, A, B)[0].collect()) == ordered(brute.rows(rows)[0])
    assert ta.align(nothing, A, B)[0].count() == 0


def test_small_blocks_and_wide_groups(brute, monkeypatch):
    monkeypatch.setattr(ta, "LINKS", 50)
    monkeypatch.setattr(ta, "_WIDE", 2)
    own = ta.Aligner(A, B)
    stripes = ta.Stripes(own.sizes, 256)
    texts = [t for t in ODD if len(t) < 1000]
    block, got = ta._Block(stripes, 0), Counter()
    for t in texts:
        block.add(own.align(pa.array([t])))
        if block.full():
            got.update(pairs_of(block, stripes))
    got.update(pairs_of(block, stripes))
    assert got == brute.rows(list(enumerate(texts)))[1]


def pairs_of(block, stripes):
    out = Counter()
    for _, stripe, pairs, runs, docs, times in block.rows():
        at, n = np.cumsum(ta.unpack(pairs)), ta.unpack(runs)
        assert n.sum() == len(ta.unpack(docs)) == len(ta.unpack(times))
        for cell, k in zip(at.tolist(), n.tolist()):
            out[cell // stripes.size_b * stripes.n + stripe, cell % stripes.size_b] += k
    return out


def test_packed_numbers():
    for top in (0, 200, 70_000, 1 << 40):
        values = np.array([0, 1, top])
        assert ta.unpack(ta.pack(values)).tolist() == values.tolist()
    assert ta.unpack(ta.pack(np.zeros(0, np.int64))).tolist() == []
