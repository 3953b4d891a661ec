import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexiprobe.llm import mixing, packing, token_codec
from lexiprobe.llm.common import Scratch
from lexiprobe.llm.tokens import Encoder, batches

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def reference_ids(path, texts):
    return [e.ids + [1] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_ids_of_whole_texts(path, docs):
    texts = [r["text"] for r in docs.collect()]
    draw = np.random.default_rng(0)
    letters = list("ab \n.,'1éΣ!?_-\t\x00 　İ")
    texts += ["".join(draw.choice(letters, draw.integers(0, 15))) for _ in range(3000)] + ["", " ", "a  b", "a \n b", "don't. I'll,\nx", "<|endoftext|>. a"]
    texts += ["\u00c0\u00c9\u00ff\u0178 \u017dlu\u0165 \u0141\u00d3D\u0179 \u017fo stra\u00dfe", "\u03a3\u03bf\u03c6\u03cc\u03c2 \u039f\u0394\u039f\u03a3 x", "e\u0301 \ufb01", "x" * 3000, "\u0661\u0662 4five", "foo\nbar\nbaz. Qux", None]
    want = reference_ids(path, [t or "" for t in texts])
    assert encoded(Encoder(path), texts, 1) == want
    assert encoded(Encoder(path), texts) == [ids[:-1] for ids in want]
    assert encoded(Encoder(path), []) == []


def encoded(encoder, texts, end_id=None):
    """Lists of ids; the texts are a slice of a longer array, as Spark may give them."""
    flat, sizes = encoder.encode(pa.array(["before. x", *texts, "y"], pa.string()).slice(1, len(texts)), end_id)
    assert len(flat) == sizes.sum()
    ends = np.cumsum(sizes)
    return [flat[e - n : e].tolist() for e, n in zip(ends, sizes)]


def test_a_full_cache_changes_no_ids(monkeypatch, docs):
    texts = [r["text"] for r in docs.collect()]
    want = encoded(Encoder(BYTES), texts)
    monkeypatch.setattr("lexiprobe.llm.tokens._MOST", 50)
    small = Encoder(BYTES)
    assert [encoded(small, [t])[0] for t in texts] == want


def test_batches_cover_all_texts():
    texts = pa.array(["ab", None, "", "abcdef", "a"] * 7)
    for most in (1, 3, 100):
        cuts = list(batches(texts, most))
        assert [i for a, b in cuts for i in range(a, b)] == list(range(35))


def check_packing(pieces, rows, length):
    want = dict(zip([k for k, _ in rows], reference_ids(BYTES, [t or "" for _, t in rows])))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for k, ids in want.items():
        at = 0
        for p in sorted(by_doc[k], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= length
    return sum(p["length"] for p in pieces) / (length * len(by_seq))


def test_packing_is_exact_and_full(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pieces = packing.pack(docs.repartition(3), BYTES).collect()
    assert check_packing(pieces, rows, 2048) > 0.97
    assert all(zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] for p in pieces)


def test_packing_messy_rows(messy, nothing):
    unique = messy.dropDuplicates(["doc_id", "text"])
    rows = [(r["doc_id"], r["text"]) for r in unique.where("doc_id IS NOT NULL").collect()]
    check_packing(packing.pack(unique.where("doc_id IS NOT NULL"), BYTES, length=64, windows=2).collect(), rows, 64)
    assert packing.pack(nothing, BYTES).count() == 0
    total = sum(len(i) for i in reference_ids(BYTES, [r["text"] or "" for r in messy.collect()]))
    assert sum(p["length"] for p in packing.pack(messy, BYTES).collect()) == total


def test_packing_keeps_large_ids(spark):
    """Ids beyond 53 bits beside null ones, in the leftovers that are merged."""
    ids = [(1 << 53) + 1, None, (1 << 53) + 3, -(1 << 62) - 1, 7]
    df = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string").repartition(4)
    got = packing.pack(df, BYTES, with_ids=False).select("doc_id").collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted(ids, key=str)


def test_blocks_round_trip():
    draw = np.random.default_rng(0)
    for n in (1, 2, 511, 512, 513, 5000, 70_000):
        for top in (1, 2, 300, 49_000, (1 << 22) - 1):
            ids = np.minimum(draw.geometric(0.01, n), top) if n % 2 else draw.integers(0, top + 1, n)
            back, _ = token_codec.decode_block(token_codec.encode_block(ids))
            assert (back == ids).all()
    with pytest.raises(ValueError):
        token_codec.encode_block(np.array([1 << 22]))


def test_carries_run_back_through_full_words():
    draw = np.random.default_rng(3)
    out = token_codec._Writer(200)
    starts, sizes = [], []
    for _ in range(token_codec.STEPS):  # parts at the upper end of the range fill words with ones
        size = draw.choice([1, 2, 1 << 10], 200)
        start = np.where(draw.random(200) < 0.9, (1 << 20) - size, draw.integers(0, 1 << 19, 200))
        out.code(start, size, 20)
        starts.append(start)
        sizes.append(size)
    used, words = out.finish()
    source = token_codec._Reader(used, np.frombuffer(words, "<u4"))
    for start, size in zip(starts, sizes):
        got = source.target(200, 20)
        assert ((start <= got) & (got < start + size)).all()
        source.take(start, size)


def test_the_mixture_covers_its_total_once():
    draw = np.random.default_rng(4)
    model = token_codec._Model(5, 64)
    for _ in range(40):
        model.predict(64)
        parts = [model.share(np.full(64, k, dtype=np.int32)) for k in range(5)]
        end = np.zeros(64, dtype=np.int64)
        for k, (start, size) in enumerate(parts):
            assert (start == end).all() and (size > 0).all()
            end = start + size
            assert (model.at_target(start) == k).all() and (model.at_target(end - 1) == k).all()
        assert (end == 1 << model.bits).all()
        x = draw.integers(0, 3, 64).astype(np.int32)
        model.share(x)
        model.learn(x)


def test_runs_hold_whole_documents():
    texts = ["a b", "word " * 2000, None, "c " * 600, "d", "e f"]
    rows = [pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(part, pa.string())], names=["doc_id", "text"]) for ids, part in (([1, 2, None], texts[:3]), ([4, 5, 6], texts[3:]))]
    got = list(token_codec.runs(iter(rows), Encoder(WORDS).encode, 1, most=512))
    assert [keys for keys, _, _ in got] == [[1], [2], [None], [4], [5, 6]]
    assert [i for _, _, flat in got for i in flat.tolist()] == [i for ids in reference_ids(WORDS, [t or "" for t in texts]) for i in ids]
    back = [token_codec.decode_frame(token_codec.encode_frame(*run)) for run in got]
    assert all(b[0] == g[0] and (b[1] == g[1]).all() and (b[2] == g[2]).all() for b, g in zip(back, got, strict=True))


def test_repetitive_ids_shrink():
    ids = np.tile(np.arange(50), 4000)
    assert len(token_codec.encode_block(ids)) < 0.15 * 2 * len(ids)


def test_damage_is_noticed():
    block = bytearray(token_codec.encode_block(np.arange(2000)))
    block[-10] ^= 1
    with pytest.raises(ValueError):
        token_codec.decode_block(bytes(block))
    frame = bytearray(token_codec.encode_frame([1, None], np.array([2, 1]), np.array([3, 1, 1], np.uint32)))
    frame[18] ^= 1
    with pytest.raises(ValueError):
        token_codec.decode_frame(bytes(frame))


def test_files_give_back_every_id(spark, messy, nothing, docs):
    for df in (docs, messy):
        path = f"{Scratch(spark, 'test-ids').path}/files"
        token_codec.write_ids(df, WORDS, path)
        rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
        got = sorted(token_codec.read_ids(spark, path).collect(), key=lambda r: r["start"])
        at = 0
        for r, (k, _), ids in zip(got, rows, reference_ids(WORDS, [t or "" for _, t in rows]), strict=True):
            raw = np.array(ids, "<u4").tobytes()
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (k, at, len(ids), zlib.crc32(raw), raw)
            at += len(ids)
    path = f"{Scratch(spark, 'test-ids').path}/files"
    token_codec.write_ids(nothing, WORDS, path)
    assert token_codec.read_ids(spark, path).count() == 0


def filled(sizes, weights, share=1.5, most=2.0):
    """Shares by repeated resharing."""
    total, target, full = share * sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        target = [most * sizes[i] if i in full else left * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in full and target[i] > most * sizes[i] + 1e-9}
        if not over:
            return target
        full |= over


def check_mix(df):
    rows = df.collect()
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    source = {(r["doc_id"], len((r["text"] or "").encode().split())): r["source"] for r in rows}
    by = defaultdict(lambda: [0, 0, None])
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        s = by[source[r["doc_id"], r["size"]]]
        s[0] += r["size"]
        s[1] += r["taken"]
        s[2] = r["target"]
        s.append(r["source_size"])
    names = sorted(by, key=lambda n: (n is None, n or ""))
    want = filled([by[n][0] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for n, t in zip(names, want):
        assert by[n][2] == pytest.approx(t) and set(by[n][3:]) == {by[n][0]}
    return {n: by[n] for n in names}


def test_mix_meets_its_targets(docs):
    for size, taken, target, *_ in check_mix(docs).values():
        assert abs(taken - target) <= max(2, 0.02 * size)
    assert mixing.mix(docs).exceptAll(mixing.mix(docs.repartition(5))).count() == 0


def test_mix_of_messy_rows(messy, nothing):
    check_mix(messy.dropDuplicates(["doc_id", "text"]))
    assert mixing.mix(nothing).count() == 0
    assert mixing.repeated(messy).columns == messy.columns


def test_one_length_of_one_source_is_split_exactly(spark):
    df = spark.createDataFrame([(i, "a b c", "s0") for i in range(3000)] + [(i + 3000, "x " * 9, "s1") for i in range(2000)], "doc_id long, text string, source string")
    for size, taken, target, *_ in check_mix(df).values():
        assert abs(taken - target) <= 9


def test_fit_lengths_reaches_reachable_sums():
    draw = np.random.default_rng(1)
    for _ in range(40):
        lengths = np.unique(draw.integers(0, 400, 30))
        counts = draw.integers(1, 9, len(lengths))
        budget = int(draw.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fit_lengths(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and 0 <= budget - (take * lengths).sum() <= 2


@pytest.mark.parametrize("enumerated", [0, 16])
def test_fit_lengths_of_long_documents_is_best(monkeypatch, enumerated):
    monkeypatch.setattr(mixing, "ENUMERATED", enumerated)
    draw = np.random.default_rng(2)
    cases = [([80_000, 90_001], [1, 1], 90_000), ([100, 80_000], [3, 1], 80_100), ([0, 100_000, 100_001, 100_002], [5, 1, 1, 1], 120_000)]
    for top in (30, 200_000):
        for _ in range(60):
            lengths = np.unique(draw.integers(0, top, draw.integers(2, 7)))
            counts = draw.integers(1, 5, len(lengths))
            cases.append((lengths, counts, int(draw.integers(0, (lengths * counts).sum() + 1))))
    for lengths, counts, budget in cases:
        lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
        sums = {0}
        for length, n in zip(lengths.tolist(), counts.tolist()):
            for _ in range(n):
                sums |= {s + length for s in sums if s + length <= budget}
        take = mixing.fit_lengths(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and (take * lengths).sum() == max(sums)


def test_two_dozen_long_documents_miss_almost_nothing():
    draw = np.random.default_rng(4)
    for n in (17, 24, 40):
        lengths = np.unique(draw.integers(2_000_000, 60_000_000, n))
        counts = np.ones(len(lengths), dtype=np.int64)
        budget = int(lengths.sum() * 0.4)
        take = mixing.fit_lengths(lengths, counts, budget)
        assert (take <= 1).all() and 0 <= budget - (take * lengths).sum() < (5000 if n == 17 else 100)


def test_documents_without_words_are_taken_by_whole_passes():
    take = mixing.fit_lengths(np.array([0, 10]), np.array([100, 100]), 500)
    assert take.tolist() == [0, 50]


def test_a_source_of_few_long_documents_meets_its_target(spark):
    df = spark.createDataFrame([(i, "w " * n, "s0") for i, n in enumerate((100_000, 100_001, 100_002))] + [(9, "x " * 400_000, "s1")], "doc_id long, text string, source string")
    for size, taken, target, *_ in check_mix(df).values():
        assert 0 <= target - taken < 100_000


def test_a_document_of_several_blocks(monkeypatch):
    monkeypatch.setattr(token_codec, "LANES", 1)
    draw = np.random.default_rng(6)
    flat, sizes = draw.integers(0, 900, 3000).astype(np.uint32), np.array([2500, 0, 500])
    keys, back, ids = token_codec.decode_frame(token_codec.encode_frame([4, None, 6], sizes, flat))
    assert keys == [4, None, 6] and (back == sizes).all() and (ids == flat).all()
