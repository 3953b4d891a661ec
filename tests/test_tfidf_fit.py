"""The vocabulary counted by buckets is the one of all terms, whatever is left out on the way."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from lexiprobe.operators import tfidf


def brute(docs, most, max_features, min_df, max_df, n):
    df, total = Counter(), Counter()
    by = {}
    for i, w in docs:
        by.setdefault(i, []).extend(" ".join(w[k : k + m]) for m in range(1, most + 1) for k in range(len(w) - m + 1))
    for g in by.values():
        total.update(g)
        df.update(set(g))
    kept = sorted((t for t in df if min_df <= df[t] <= max_df * n), key=lambda t: (-total[t], t))[:max_features]
    return {t: (df[t], total[t]) for t in kept}


@pytest.mark.parametrize("most,repeated", [(1, False), (2, False), (2, True), (3, True)])
@pytest.mark.parametrize("max_features,bits", [(30, 10), (30, 4), (1000000, 10)])
def test_the_most_frequent_terms_are_exact(spark, monkeypatch, most, repeated, max_features, bits):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)] + ["é", "日本", "x y"]
    docs = [(k % 40 if repeated else k, [rng.choice(words) for _ in range(rng.randrange(0, 60))]) for k in range(200)]
    docs += [(None, ["only", "null"]), (None, ["only", "null"])] if repeated else [(None, ["only", "null"])]
    frame = spark.createDataFrame(docs, "doc_id long, w array<string>").repartition(3)
    monkeypatch.setattr(tfidf, "_SOME", 500)  # several slices a batch; the driver's value goes with the functions
    got = tfidf.fit(tfidf.totals(frame, len(docs), most, max_features, 3, 0.5, bits=bits), len(docs), max_features, 3, 0.5)
    want = brute(docs, most, max_features, 3, 0.5, len(docs))
    assert {r["term"]: r["df"] for r in got.collect()} == {t: d for t, (d, _) in want.items()}
    counts = {(r["doc_id"], r["term"]): r["tf"] for r in tfidf.counts_of(frame, got, most).collect()}
    every = Counter((i, " ".join(w[k : k + m])) for i, w in docs for m in range(1, most + 1) for k in range(len(w) - m + 1))
    assert counts == {k: v for k, v in every.items() if k[1] in want}


def test_a_document_of_several_slices_counts_once(monkeypatch):
    """The rows of one key in separate batches, as a task sees them."""
    batches = [pa.record_batch([pa.array(k), pa.array(w, pa.list_(pa.string()))], names=["doc_id", "w"]) for k, w in (([1, 2], [["a"], ["b", "a"]]), ([2], [["b", "c"]]), ([2, 3], [["a"], None]))]
    seen = [(keys.to_pylist(), some.words.to_pylist()) for keys, some in tfidf._slices(iter(batches), 2)]
    assert seen == [([1, 2], ["a", "b"]), ([2], ["b", "c"]), ([2, 3], ["a"])]


def test_rare_terms_are_not_moved(spark, tmp_path):
    """Terms of one occurrence each stay out of the exact counts, unless they could be wanted."""
    rows = [(k, ["often", "also"] * 3 + [f"rare{k}x{j}" for j in range(40)]) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, w array<string>")
    got = tfidf.totals(frame, len(rows), 2, 2, 3, 1.0, bits=16)
    assert got.count() < 2000  # of 12,000 words and as many pairs
    assert {r["term"] for r in tfidf.fit(got, len(rows), 2, 3, 1.0).collect()} == {"also", "often"}


def test_subwords_are_cut_in_bounded_pieces(spark, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    sizes = []
    whole = tfidf._load(path)
    monkeypatch.setattr(tfidf, "_load", lambda p: lambda texts: (sizes.append(sum(map(len, texts))), whole(texts))[1])
    monkeypatch.setattr(tfidf, "_TEXT", 1000)
    texts = pa.array(["some words of a text " * 10, None, ""] * 50)
    got = tfidf.subwords(path).func(texts)
    assert len(got) == 150 and max(sizes) <= 1000 and got[1].as_py() == [] and got[0].as_py() == whole([texts[0].as_py()])[0].as_py()
