"""Filtering and repeating stages decide by row, also where ids are null or repeated."""

from collections import Counter

import numpy as np
import pytest

from lexiprobe.llm import exact_dedup, mixing, near_dedup, toxicity

SCHEMA = "doc_id long, text string, source string"
NEAR = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_a_toxic_row_takes_no_other_row_along(frame, monkeypatch):
    model = toxicity.fit(["you vile rotten scum", "a calm sunny day"] * 20, np.array([1, 0] * 20))
    monkeypatch.setattr(toxicity, "learn", lambda *_: model)
    rows = [(None, "you vile rotten scum", "a"), (None, "a calm sunny day", "a"), (1, "you vile rotten scum", "a"), (1, "a calm sunny day", "b"), (2, "a calm sunny day", "b")]
    got = toxicity.keep_clean(frame(rows), None)
    assert texts(got) == Counter({(None, "a calm sunny day"): 1, (1, "a calm sunny day"): 1, (2, "a calm sunny day"): 1})


def test_a_kept_row_brings_no_copy_back(frame):
    rows = [(None, "x y", "a"), (None, "x  y", "a"), (None, "only", "a"), (5, "p", "a"), (5, "q", "a"), (3, "p", "a"), (None, "q", "a"), (9, "r", "a"), (9, "r", "b")]
    got = texts(exact_dedup.keep_distinct(frame(rows)))
    assert got == Counter({(None, "x  y"): 1, (None, "only"): 1, (3, "p"): 1, (5, "q"): 1, (9, "r"): 1})


def test_a_kept_row_brings_no_near_copy_back(frame):
    other, third = NEAR.replace("w", "v"), NEAR.replace("w", "u")
    rows = [(1, NEAR, "a"), (2, NEAR + " more", "a"), (2, other, "a"), (None, NEAR, "a"), (None, third, "a"), (None, third, "b"), (None, "", "a"), (None, " ", "a"), (4, None, "a"), (7, "lone", "a"), (7, "lone", "a")]
    got = texts(near_dedup.keep_first(frame(rows)))
    assert got == Counter({(1, NEAR): 1, (2, other): 1, (None, third): 1, (None, ""): 1, (None, " "): 1, (4, None): 1, (7, "lone"): 1})


def test_copies_are_taken_by_row(frame):
    rows = [(None, "a " * k, "s") for k in range(1, 40)] + [(None, "b " * 5, "t"), (None, "b " * 9, "t")] + [(8, "c d", "u")] * 3 + [(8, "e f", "u"), (8, None, None)]
    docs = frame(rows)
    size = lambda t: len((t or "").split())
    want, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        want[(r["doc_id"], r["size"])] += r["copies"]
    for (k, t), n in texts(mixing.repeated(docs)).items():
        got[(k, size(t))] += n
    assert got == +want and len({r["copies"] for r in mixing.mix(docs).where("doc_id is null").collect()}) > 1
