import hashlib
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiprobe.llm import mih_ann, pii, queries


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in reversed(m[0]) if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark)


TEXTS = (
    "a.b@c.d@e.f a.b@c.d_x@e.f 1.2.3.4.5.6.7.8 1.2.3.400 ..@a.b.c x@y 00000000255.1.1.1 99999999999999.1.1.1",
    "é😀 a@b.co 4111 1111 1111 1111 +1 (269) 555-3296 +12345 (12)", "4111-1111 1111-1111" * 3 + " " + "1" * 5000, "1.2.3.4" * 3, "a" * 20000 + "@b.c", "+" * 50 + "1 2", "++12345678901",
)


def test_base_spans_equal_brute_force(spark, docs, model, messy):
    extra = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra).union(messy.select("doc_id", "text"))
    texts = {}
    for r in df.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    found = 0
    for r in pii.find(df, model).collect():
        spans = sorted((s["start"], s["kind"], s["end"]) for s in r["base"])
        assert spans in [base(t) for t in texts[r["doc_id"]]]
        assert not any(a["start"] < b["end"] and b["start"] < a["end"] for a in r["added"] for b in r["base"])
        found += len(spans)
    assert found > 10


def test_candidates_are_selected_by_form_and_context(spark, model):
    cases = [("call (212) 555-0187 now", "phone_alt"), ("mail jane (at) example (dot) com today", "email_alt"), ("host fe80:1234:5678:9abc:def0:1234:5678:9abc up", "ip_alt"), ("card 4111.1111.1111.1111 ok", "card_alt"), ('here token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" la', "secret"), ('HERE!! TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!', "secret")]
    clean = ["on 2024-05-17 at noon", "order 12345678", "at 12:30:45", "version 10.20.2024", "he is there at home.Next one", "commit 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde by", "the antidisestablishmentarianism2 of", "see some-long-page-title-2024 for"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([c for c, _ in cases] + clean)], "doc_id long, text string")
    got = {r["doc_id"]: [pii.KINDS[s["kind"]] for s in r["added"]] for r in pii.find(df, model).collect()}
    assert [got[i] for i in range(len(cases))] == [[k] for _, k in cases]
    assert all(not got[i] for i in range(len(cases), len(cases) + len(clean)))


def test_gates_pass_all_that_their_generators_match(spark, docs):
    texts = ["mail jane {at} example {dot} com", "contact jane [ at ] example.org", "JANE AT EXAMPLE DOT COM", "jo { AT } a (DOT) b", "tel 06 12 34 56 78", "tel (0)6-1 2-3 4-5 6", "card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "fe80:1:2::3", "key a1b2c3d4e5f6a7b8c9d0==", "at home", ""]
    df = spark.createDataFrame([(-i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string").union(docs.select("doc_id", F.coalesce("text", F.lit(""))))
    for kind, pattern in pii.GENERATORS.items():
        pairs = df.select(pii._candidates(F.col("text"), kind).alias("gated"), pii.found(F.col("text"), pattern).alias("all"))
        assert pairs.where("gated != all").count() == 0 and pairs.where("size(all) > 0").count() > 0


PIECES = ["12", "345-", "(0)", ". ", "555", "@", " at ", "a.b", "com", " (dot) ", " [AT] ", ":", "::", "fe8", "4111", ".1111", "_", "/", "tel ", "\u00e9", "\U0001f600", "+1", " ", "\n", "x", "a1b2c3d4e5f6a7b8c9d0"]


def random_texts(n, seed=0):
    draw = np.random.default_rng(seed)
    return ["".join(draw.choice(PIECES, draw.integers(0, 60))) for _ in range(n)]


def test_candidates_equal_brute_force(spark):
    """Places, matches and context of each generator's matches, and the gates, on random texts."""
    texts = random_texts(1500)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kind, pattern in pii.GENERATORS.items():
        hits = 0
        for r in df.select("doc_id", pii._candidates(F.col("text"), kind).alias("c")).collect():
            t, last, want = texts[r["doc_id"]], 0, []
            found = list(re.finditer(pattern, t))
            for k, m in enumerate(found):
                gap, after = t[last : m.start()], t[m.end() : found[k + 1].start() if k + 1 < len(found) else len(t)]
                behind = after[:1] or (found[k + 1][0][:1] if k + 1 < len(found) else "")
                want.append((m.start(), m.end(), m[0], gap[-pii._LEFT :], t[m.start() - 1 : m.start()] if m.start() else "", behind))
                last = m.end()
            assert [tuple(c) for c in r["c"]] == want
            hits += len(want)
        assert hits > 20


def test_added_spans_equal_brute_force(spark, model):
    """What is added: candidates that overlap no base span and whose score reaches the threshold."""
    texts = random_texts(800, 1) + ["tel 212 555 0187, +1 (212) 555-0187 call (212) 555-0188 mail a at b.com"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: [] for i in range(len(texts))}
    for k, kind in enumerate(pii.GENERATORS):
        one = df.select("doc_id", F.explode(pii._candidates(F.col("text"), kind)).alias("s")).select("doc_id", "s.start", "s.end", pii.features(F.col("s"), k).alias("f")).withColumn("z", F.expr(model.score("f", k)))
        for r in one.collect():
            clear = not any(r["start"] < e and s < r["end"] for s, _, e in base(texts[r["doc_id"]]))
            if clear and r["z"] >= model.thresholds[kind]:
                want[r["doc_id"]].append((r["start"], pii.KINDS.index(kind), r["end"]))
    got = {r["doc_id"]: sorted(tuple(s) for s in r["added"]) for r in pii.find(df, model).collect()}
    assert got == {i: sorted(v) for i, v in want.items()} and sum(map(len, want.values())) > 20


def test_sweep_equals_all_pairs(spark):
    draw = np.random.default_rng(2)
    rows = []
    for _ in range(300):
        spans = [(int(a), int(a + n), "m", "", "", "") for a, n in zip(draw.integers(0, 60, draw.integers(0, 9)), draw.integers(1, 12, 9))]
        found = [(int(a), 1, int(a + n)) for a, n in zip(draw.integers(0, 60, draw.integers(0, 7)), draw.integers(1, 12, 9))]
        rows.append((spans, found))
    df = spark.createDataFrame(rows, f"spans array<{pii._SPAN}>, found array<struct<start:int,kind:int,end:int>>")
    for r in df.select("*", pii._clear_of(F.col("spans"), F.col("found")).alias("free")).collect():
        want = [s for s in r["spans"] if not any(b["start"] < s["end"] and s["start"] < b["end"] for b in r["found"])]
        assert sorted(map(tuple, r["free"])) == sorted(map(tuple, want))


def test_many_matches_in_one_text(spark, model):
    """A text of 50,000 numbers takes seconds: work does not grow with the square of the matches."""
    text = " ".join(f"call ({100 + i % 900}) 555-{i % 10000:04d} +1 (212) 555-{i % 10000:04d}" for i in range(25_000))
    began = time.time()
    (r,) = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).select(F.size("base").alias("b"), F.size("added").alias("a"), "base", "added").collect()
    assert time.time() - began < 60
    want = base(text)
    assert [tuple(s) for s in sorted(r["base"])] == want and r["a"] >= 25_000 - (r["b"] - 25_000)
    (masked,) = pii.redacted(spark.createDataFrame([(1, text[:20_000])], "doc_id long, text string"), model=model).collect()
    assert len(masked["text"]) == 20_000 and not re.search("[0-9]{4}", masked["text"][:-40])
    assert time.time() - began < 120


def test_unseen_templates_are_recalled(spark, model, nothing):
    assert model.recall["email_alt"] >= 0.9 and model.recall["ip_alt"] >= 0.9 and model.recall["card_alt"] >= 0.8 and model.recall["phone_alt"] >= 0.7 and model.recall["secret"] >= 0.8
    assert pii.find(nothing, model).count() == 0 and pii.redacted(nothing, model=model).count() == 0


def test_compressed_addresses_are_proposed_and_selected(spark, model):
    whole = ["fe80::1", "2001:db8::8a2e:370:7334", "fe80::1ff:fe23:4567:890a", "::1", "2001:db8:1::", "::ffff:1:2", "1:2:3:4:5:6:7::", "2001:db8:85a3:0:0:8a2e:370:7334"]
    cases = [("ip ", w, " up") for w in whole] + [("host ", "fe80::1", ": up"), ("ip:", "2001:db8::1", ".")]
    clean = ["at 12:30:45", "id 00:1a:2b:3c:4d:5e", "and 0a:1b:2c:3d:4e:5f or", "std::begin", "list[::2]", "ratio 1:2:3", "a type :: is"]
    never = ["1::2::3", "1:::2", "12:30", "1:2:3:4:5:6:7:8:9:0"]
    texts = [a + w + b for a, w, b in cases] + clean + never
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    proposed = {r["doc_id"]: [s["match"] for s in r["c"]] for r in df.select("doc_id", pii._candidates(F.col("text"), "ip_alt").alias("c")).collect()}
    assert [proposed[i] for i in range(len(cases))] == [[w] for _, w, _ in cases]
    assert not any(proposed[len(texts) - 1 - i] for i in range(len(never)))
    added = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["added"] if pii.KINDS[s["kind"]] == "ip_alt"] for r in pii.find(df, model).collect()}
    assert [added[i] for i in range(len(cases))] == [[w] for _, w, _ in cases]
    assert not any(added[len(cases) + i] for i in range(len(clean)))


def test_written_form_and_redaction(spark, model):
    df = spark.createDataFrame([(1, "a@b.co and a@b.co"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find(df, model).select("doc_id", pii.written(F.col("base")).alias("s"), F.sha2(pii.written(F.col("base")), 256).alias("h")).collect()}
    assert rows[1]["s"] == "email:0:6,email:11:17" and rows[2]["s"] == "" and rows[2]["h"] == hashlib.sha256(b"").hexdigest()
    assert {r["doc_id"]: r["text"] for r in pii.redacted(df, model=model).collect()} == {1: "****** and ******", 2: ""}


def test_search_recall_and_order(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = v.collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=float)
    hit = n = 0
    got = {}
    for r in mih_ann.search(v, every=10).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {i for i in ids if i % 10 == 0}
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in found] == sorted((r["score"], r["vec_id"]) for r in found)
        assert all(r["score"] == d[ids == r["vec_id"]][0] for r in found)
        hit += len({r["vec_id"] for r in found} & set(ids[best].tolist()))
        n += 10
    assert hit / n >= 0.9


def test_search_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (None, [1.0, 0.0]), (100, [0.0, 2.0]), (9, [float("inf"), 1.0])] + [(k, [1.0, 0.0]) for k in range(200, 260)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, embedding array<float>, query_id string")
    got = mih_ann.search(df).collect()
    first = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert first == [1, *range(200, 209)]
    assert {r["query_id"] for r in got} == {0, 100, 200}
    assert mih_ann.search(df.where("false")).count() == 0
    assert mih_ann.search(df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_search_with_repeated_ids_and_vectors(spark, seed):
    """Few vectors, many rows of one id, ids of several vectors: as a full search over all rows finds."""
    draw = np.random.default_rng(seed)
    points = [(1.0, 0.0), (0.6, 0.8), (0.0, 1.0), (-1.0, 0.5)]
    rows = [(100, [1.0, 0.0])] * 11 + [(101, [1.0, 0.0]), (102, [0.5, 0.5]), (103, [1.0, 0.7])] + [(int(i), list(points[int(p)])) for i, p in zip(draw.integers(95, 106, 60), draw.integers(0, 4, 60))]
    got = mih_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    asked = min(v for i, v in rows if i == 100)
    near = sorted((math.dist(asked, v), i) for i, v in rows if i != 100)[:10]
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(100, i) for _, i in near]
    assert np.allclose([r["score"] for r in got], [d for d, _ in near])


def test_code_distances_are_complete():
    """Every code within the radius that a probing distance covers is found."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64))
    model = mih_ann.Codes(x[:1000])
    index = mih_ann.BlockIndex(model, np.arange(3000), x)
    word = model.codes(x[:1])[0]
    apart = mih_ann._POP[index.words ^ word].sum(1)
    found = set()
    for s in range(4):
        found |= set(index._probe(word, s).tolist())
        assert set(np.flatnonzero(apart <= 8 * (s + 1) - 1).tolist()) <= found


def test_pipeline_stages(spark, sf, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    got = corpus_pipeline.run(spark, sf).collect()
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        before = kept
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns and kept.count() <= before.count()
    taken = {r["doc_id"]: r["count"] for r in corpus_pipeline.mix_sources(spark, kept, sf).groupBy("doc_id").count().collect()}
    starts = {}
    for p in got:
        if p["start"] == 0:
            starts[p["doc_id"]] = starts.get(p["doc_id"], 0) + 1
    assert starts == taken


def test_every_operator_has_a_query():
    names = set(queries.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
