import zlib

import numpy as np
import pytest

from lexiprobe.llm import language_id, quality_crf, toxicity


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def larger(spark):
    at = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def accuracy(scored, labels, column):
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", column).collect()
    return np.mean([r["predicted"] == r[column] for r in rows])


def test_quality_on_held_out_documents(larger):
    docs, labels = larger
    assert accuracy(quality_crf.score(docs, quality_crf.learn(docs, labels)), labels, "quality") >= 0.95


def test_toxicity_on_held_out_documents(larger):
    docs, labels = larger
    assert accuracy(toxicity.score(docs, toxicity.learn(docs, labels)), labels, "toxic") >= 0.9


def test_language_on_held_out_documents(larger):
    docs, _ = larger
    got = language_id.predict(docs, language_id.learn(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97


def test_messy_rows(spark, docs, labels, messy, nothing):
    field, linear, protos = quality_crf.learn(docs, labels), toxicity.learn(docs, labels), language_id.learn(docs)
    for got in (quality_crf.score(messy, field).collect(), toxicity.score(messy, linear).collect()):
        assert len(got) == messy.count()
        assert all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"]) for r in got)
    got = {r["doc_id"]: r for r in language_id.predict(messy, protos).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5, 12)] == ["und"] * 4 and got[11]["lang_pred"] != "und"
    for f in (lambda d: quality_crf.score(d, field), lambda d: toxicity.score(d, linear), lambda d: language_id.predict(d, protos)):
        assert f(nothing).count() == 0
    assert toxicity.keep_clean(messy, labels).columns == messy.columns


def test_without_anything_to_learn(messy, labels):
    none = labels.where("false")
    assert {r["score"] for r in toxicity.score(messy, toxicity.learn(messy, none)).collect()} == {0.0}
    assert {r["score"] for r in quality_crf.score(messy, quality_crf.learn(messy, none)).collect()} == {1.0}
    assert {r["lang_pred"] for r in language_id.predict(messy, language_id.learn(messy.where("lang IS NULL"))).collect()} == {"und"}


def test_labels_of_held_out_rows_teach_nothing(docs, labels):
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, flipped)
    assert (a.weights == b.weights).all() and (a.curve == b.curve).all()


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([3, 1, 4])
    node, edge = rng.normal(size=8), rng.normal(size=(2, 2))
    good, _, _ = quality_crf.marginals(lines, node, edge)
    at = 0
    for n in lines:
        total, p = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(node[at + k] * y[k] for k in range(n)) + sum(edge[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            p += w * np.array(y)
        assert np.allclose(good[at : at + n], p / total)
        at += n


def test_line_features_count_repetition():
    lines, length, x = quality_crf.line_features(["aa aa aa\nb c", ""])
    assert lines.tolist() == [2, 1] and length.tolist() == [8, 3, 0]
    again = x[:, len(quality_crf.CLASSES) + 1]
    assert again[0] == 1.0 and again[1] == 0.0 and np.isfinite(x).all()


def test_profiles_are_the_same_in_every_process():
    one = language_id._vector(97).copy()
    language_id._cache.clear()
    assert (language_id._vector(97) == one).all() and set(one.tolist()) == {1, -1}
    assert np.allclose(np.linalg.norm(language_id.bundles(["some words here", "!!"]), axis=1), [1, 0])


def test_toxicity_equals_a_naive_loop(docs, labels):
    """Log-count ratios and scores n-gram by n-gram."""
    rows = [(r["text"], r["toxic"]) for r in docs.join(labels, "doc_id").where("text IS NOT NULL AND toxic IS NOT NULL").orderBy("doc_id").limit(60).collect()]
    cell = lambda gram: int(toxicity.ngram_cells(gram, (len(gram),))[0][0])
    grams = lambda t: [[cell(t.lower()[k : k + n]) for k in range(len(t.lower()) - n + 1)] for n in toxicity.ORDERS]
    texts, y = [t[:400] for t, _ in rows], np.array([c for _, c in rows], dtype=float)
    y[:5] = 1
    each = [grams(t) for t in texts]
    sets = [{c for order in e for c in order} for e in each]
    ratio = toxicity.log_count_ratios([np.unique(np.concatenate(toxicity.ngram_cells(t))) for t in texts], y)
    for c in list(set().union(*sets))[:3000]:
        p = 1 + sum(c in s and v == 1 for s, v in zip(sets, y))
        q = 1 + sum(c in s and v == 0 for s, v in zip(sets, y))
        want = np.log(p / (y.sum() + 2)) - np.log(q / (len(y) - y.sum() + 2))
        assert ratio[c] == pytest.approx(0 if abs(want) < 1 or p + q - 2 < 2 else want)
    model = toxicity.fit(texts, y.astype(int), 0.2)
    assert (model.used == (ratio != 0)).all()
    for t, e, s in zip(texts[:20], each, sets):
        there = [c for c in s if ratio[c] != 0]
        whole = sum(float(model.weights[c]) for c in there) / max(1, len(there)) ** 0.5 + model.bias
        at = [sum(float(model.weights[order[k]]) for order in e if k < len(order)) for k in range(len(e[0]))]
        width = min(toxicity.WINDOW, len(at))
        window = max(sum(at[k : k + width]) for k in range(len(at) - width + 1))
        assert model.margins(t) == pytest.approx((whole, window), rel=1e-4, abs=1e-4)
        a, b, c = model.curve
        assert model.score(t) == pytest.approx(1 / (1 + np.exp(-(a * whole + b * window + c))), abs=1e-3)


def test_toxicity_without_telling_ngrams():
    """Texts alike in both classes: the share of toxic labels, and below one half."""
    for share, want in ((0.1, 0.1), (0.9, 0.49)):
        model = toxicity.fit(["same words here"] * 8, np.array([0, 1] * 4), share)
        assert model.score("same words here") == pytest.approx(want) and model.score("") == pytest.approx(want)


def test_languages_equal_a_naive_loop(docs):
    """Vectors n-gram by n-gram, prototypes and cosines, on a few documents."""
    texts = [r["text"][:150] for r in docs.where("text IS NOT NULL").orderBy("doc_id").limit(12).collect()] + ["", "!!", "a", "Über straße 42 ñandú", "x  y\n\nz"]

    def naive(text):
        letters = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
        kept = [c for k, c in enumerate(letters) if c or not k or letters[k - 1]]
        total = np.zeros(language_id.DIMENSIONS)
        for k in range(len(kept) - 2):
            total += np.prod([np.roll(language_id._vector(kept[k + j]), j).astype(float) for j in range(3)], axis=0)
        return total / n if (n := np.linalg.norm(total)) else total

    want = np.stack([naive(t) for t in texts])
    assert np.allclose(language_id.bundles(texts), want, atol=1e-5)
    protos = language_id.learn(docs)
    table = np.stack([v / np.linalg.norm(v) for v in protos.values()])
    frame = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_id.predict(frame, protos).collect():
        cosines = table @ want[r["doc_id"]]
        if not any(map(str.isalpha, texts[r["doc_id"]])):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == list(protos)[int(cosines.argmax())] and r["score"] == pytest.approx(max(0.0, cosines.max()), abs=1e-4)


def test_line_features_equal_a_naive_loop(docs):
    """Every feature of every line, the neighbours' beside them, and the weighted mean over a text's lines."""
    texts = [r["text"][:600] for r in docs.where("text IS NOT NULL").orderBy("doc_id").limit(15).collect()] + ["", "\n\n", "aa aa\tbb | CC! 12 é\x0bx\n \n***", "x" * 300]
    lines, length, x = quality_crf.line_features(texts)
    rows = [(i, line) for i, t in enumerate(texts) for line in t.encode().split(b"\n")]
    assert lines.tolist() == [sum(i == k for i, _ in rows) for k in range(len(texts))] and length.tolist() == [len(line) for _, line in rows]
    for got, (_, line) in zip(x, rows, strict=True):
        counts = np.bincount([quality_crf._CLASS[b] for b in line], minlength=len(quality_crf.CLASSES)).astype(float)
        words = line.split()
        again = sum(a == b for a, b in zip(words, words[1:]))
        more = [np.log1p(len(line)) / 8, again / max(len(words) - 1, 1), len(line) / max(len(words), 1) / 20, float(not line), counts[1] / max(counts[0] + counts[1], 1), counts[4] / max(len(words), 1)]
        assert np.allclose(got, [*(counts / max(len(line), 1)), *more])
    wide, width = quality_crf.with_neighbours(lines, x), x.shape[1]
    for k, (i, _) in enumerate(rows):
        before = x[k - 1] if k and rows[k - 1][0] == i else np.zeros(width)
        after = x[k + 1] if k + 1 < len(rows) and rows[k + 1][0] == i else np.zeros(width)
        assert np.allclose(wide[k], [*x[k], *before, *after, 1])
    field = quality_crf.fit(texts, np.arange(len(texts)) % 2)
    good = quality_crf.marginals(lines, field.potentials(lines, x), field.edge)[0]
    for i, z in enumerate(field.evidence(lines, length, x)):
        own = [k for k, r in enumerate(rows) if r[0] == i]
        mean = sum(good[k] * max(length[k], 1) for k in own) / sum(max(length[k], 1) for k in own)
        mean = min(max(mean, 1e-4), 1 - 1e-4)
        assert z == pytest.approx(np.log(mean / (1 - mean)))


def test_texts_of_very_many_lines():
    texts = ["a line of words.\n" * 60_000, "\n" * 50_000, "one"]
    field = quality_crf.fit(["good words here.\nmore of them.", "!!! ||| ***\n### $$$"] * 10, np.array([1, 0] * 10))
    scores = field.scores(texts)
    assert len(scores) == 3 and np.isfinite(scores).all() and scores[0] > 0.5
