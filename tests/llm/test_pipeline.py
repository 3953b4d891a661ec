"""The pipeline, stage by stage, against brute force, on messy tables and on empty ones."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lexiprobe.llm import toxicity

from .conftest import CLASHING, EXTRA
from .test_dedup import brute
from .test_packing_codec_mixing import BYTES, filled, reference_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
FILTERS = [name for name, _ in corpus_pipeline.STAGES[:3]]


def corpus():
    draw = np.random.default_rng(7)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for k in range(90):
        text = " ".join(draw.choice(words, int(draw.integers(1, 120))))
        if k % 6 == 0:
            text += " you vile rotten scum and worthless filth"
        rows.append((k, text, "en", f"s{k % 4}" if k % 9 else None))
    base = " ".join(words[:90])
    rows += [(200, base, "en", "s1"), (201, base.replace(" ", "  "), "en", "s0"), (None, base, "en", "s1"), (202, base + " more", "en", "s2"), (203, base + " more words", "en", "s1"), (203, base + " more words", "en", "s1")]
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, " \n\t", "en", "s1"), (None, None, None, None), (5, "another text of the same id", "en", "s1"), (303, "long text . " * 8000, "en", "s3"), (None, "alone here", "en", "s0")]
    return [(*r, 1, *EXTRA) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], 1, int("vile" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] < 90 and r[1] != "another text of the same id"]
    spark.createDataFrame([*labels, (None, None, None), (9999, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def plain(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def first(rows):
    """The row of smallest id, null last; of equal ids the smallest text (null first)."""
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_each_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    before = plain(docs)
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))

    docs = stages["toxicity"](spark, docs, folder).cache()
    clean = plain(docs)
    assert Counter(clean) == Counter(r for r in before if model.score(r[1] or "") < 0.5)
    caught = [r for r in before if "vile" in (r[1] or "")]
    assert not set(caught) & set(clean) and len(clean) == len(before) - len(caught)

    docs = stages["exact_dedup"](spark, docs, folder).cache()
    distinct = plain(docs)
    groups = defaultdict(list)
    for r in clean:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
    assert len(distinct) == len(groups)
    for r in distinct:
        assert r[0] == first(groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")])[0]

    docs = stages["near_dedup"](spark, docs, folder).cache()
    apart = plain(docs)
    component = defaultdict(list)
    blank = []
    for r, (_, n, _) in zip(distinct, brute([r[:2] for r in distinct], 5), strict=True):
        blank += [r] if not n else []
    for i, r in enumerate(distinct):
        if r in blank:
            continue
        # Rows stand for their group's smallest id; rows without an id that link with nothing stay alone.
        same = [x for x in distinct if x not in blank and linked(r[1], x[1])]
        component[frozenset(same)].append(r)
    merged = merge([set(s) for s in component])
    want = [first(g) for g in merged] + blank
    assert Counter(r[0] for r in apart) == Counter(r[0] for r in want) and len(apart) == len(want)

    docs = stages["mixing"](spark, docs, folder).cache()
    mixed = plain(docs)
    size = lambda r: len((r[1] or "").encode().split())
    sources = sorted({r[2] for r in apart}, key=lambda s: (s is None, s or ""))
    words = [sum(size(r) for r in apart if r[2] == s) for s in sources]
    longest = [max(size(r) for r in apart if r[2] == s) for s in sources]
    for s, target, most in zip(sources, filled(words, [(5, 2, 1)[i % 3] for i in range(len(sources))]), longest):
        assert 0 <= round(target) - sum(size(r) for r in mixed if r[2] == s) <= most
    assert set(mixed) <= set(apart) and max(Counter(mixed).values()) <= 2

    pieces = stages["packing"](spark, docs, folder).collect()
    total = sum(len(i) for i in reference_ids(BYTES, [r[1] or "" for r in mixed]))
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sum(p["length"] for p in pieces) == total and Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(r[0] for r in mixed)
    for parts in by_sequence.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def linked(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
    return 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])


def merge(groups):
    out = []
    for g in groups:
        touching = [o for o in out if o & g]
        out = [o for o in out if not o & g] + [set().union(g, *touching)]
    return out


def test_run_applies_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        docs = after.cache()
    want = Counter(r["doc_id"] for r in docs.collect())
    assert Counter(p["doc_id"] for p in corpus_pipeline.run(spark, folder).collect() if p["start"] == 0) == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
