import hashlib
import re

import numpy as np
import pytest

from lexiprobe.llm import exact_dedup, near_dedup
from lexiprobe.llm.common import Scratch

from ..oracle import connect, rows_of, sql_rows


def test_exact_equals_its_sql(spark, sf):
    assert rows_of(exact_dedup.op3_exact_dedup(spark, sf)) == sql_rows(connect(sf), exact_dedup.OP3_SQL)


def test_exact_on_messy_rows(messy, nothing):
    rows = messy.collect()
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), []).append(r["doc_id"])
    got = exact_dedup.exact_dedup(messy).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r["text_sha256"]]
        keep = min((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
    assert exact_dedup.exact_dedup(nothing).count() == 0
    kept = exact_dedup.keep_distinct(messy)
    assert kept.columns == messy.columns


def test_index_outlives_batches(spark, docs):
    scratch = Scratch(spark, "test-index")
    first = exact_dedup.DigestIndex(spark, f"{scratch.path}/index", 4)
    one, two = docs.where("doc_id < 120"), docs.where("doc_id >= 100")
    exact_dedup.dedup_batch(one, first, "one", scratch).collect()
    spark.sql(f"DROP TABLE {first.table}")
    again = exact_dedup.DigestIndex(spark, f"{scratch.path}/index", 4)
    late = exact_dedup.dedup_batch(two, again, "two", scratch).collect()
    all_ = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs).collect()}
    assert all(r["keep_id"] == all_[r["doc_id"]] for r in late)
    assert again.rows().count() == len(set(all_.values()))
    plan = again.lacks(again.rows().limit(5).select("digest"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan or "LeftAnti" in plan


def brute(rows, width, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        n = min(width, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    members = {}
    for i, (k, _) in enumerate(rows):
        members.setdefault(top(i), []).append(k)
    return [(k, len(sets[i]), k if not sets[i] else min((m for m in members[top(i)] if m is not None), default=None)) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_equals_brute_force(docs, width):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, width=width).collect())
    assert got == sorted(brute(rows, width))
    assert any(a != c for a, _, c in got)


def test_near_on_messy_rows(messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(messy, width=2).collect()), key=key)
    assert got == sorted(brute(rows, 2), key=key)
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert near_dedup.keep_first(messy).columns == messy.columns


def test_chains_are_one_component(spark):
    """Each text is like the next one only: the ends meet through the others."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 100])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(df, width=2).collect()} == {0}


def test_registers_merge_and_estimate():
    s = near_dedup.SetSketch()
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**64, 900, dtype=np.uint64), rng.integers(0, 2**64, 900, dtype=np.uint64)
    u = np.unique(np.concatenate([a, b]))
    ka, kb, ku = s.registers([a, b, u])
    assert (near_dedup.SetSketch.merge(ka, kb) == ku).all()
    for share in (0.3, 0.6, 0.8, 0.95):
        part = u[: int(len(u) * share)]
        k = s.registers([part, u])
        est = s.similarity(k[:1], k[1:], np.array([float(len(part))]), np.array([float(len(u))]))[0]
        assert abs(est - len(part) / len(u)) < 0.15


@pytest.mark.parametrize("rows_, words", [(1024, 1 << 22), (7, 1 << 22), (1024, 400)])
def test_blocks_find_links_that_leaders_miss(spark, monkeypatch, rows_, words):
    """Many near copies of different degree around one text: components as by brute force, however buckets are divided."""
    for name, value in (("_ROWS", rows_), ("_SHINGLES", words)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for k in range(120):
        w = list(base)
        for i in rng.choice(150, rng.integers(0, 16), replace=False):
            w[i] = f"x{k}_{i}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, width=2).collect())
    assert got == sorted(brute(rows, 2))


def test_rows_without_ids_link_others(spark):
    """A chain 5 - null - 7 whose ends meet through the row without an id only, and a longer text without an id."""
    words = [f"w{i}" for i in range(200)]
    chain = [(5, " ".join(words[0:100])), (None, " ".join(words[8:108])), (7, " ".join(words[16:116]))]
    other = [f"v{i}" for i in range(60)]
    rows = [*chain, (6, " ".join(other)), (None, " ".join([*other, "more"])), (None, " ".join([*other, "more"])), (None, "alone and far from all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, width=2).collect()), key=key)
    assert got == sorted(brute(rows, 2), key=key)
    assert {c for k, _, c in got if k in (5, 7)} == {5}


def test_repeated_rows_are_one_set(spark, monkeypatch):
    """Hundreds of rows of two near copies: one set each, and one verified pair."""
    seen = []
    verified = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, sets, percent: seen.append((pairs.count(), sets.count(), verified(pairs, sets, percent).count())) or verified(pairs, sets, percent))
    a, b = " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(101))
    df = spark.createDataFrame([(1, a), (2, b)] * 300, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, width=2).select("doc_id", "component_id").distinct().collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1)]
    assert seen == [(1, 2, 1)]


def test_few_texts_move_beside_those_wanted(spark):
    """All texts were exchanged to find those of a few ids."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text").unionByName(spark.createDataFrame([(None, "t")], "doc_id long, text string"))
    wanted = spark.range(0, 20_000, 40).selectExpr("id AS doc_id").unionByName(spark.createDataFrame([(None,)], "doc_id long"))
    got = near_dedup.among(docs, "doc_id", wanted)
    ids = {r["doc_id"] for r in got.collect()}
    assert got.columns == docs.columns and set(range(0, 20_000, 40)) <= ids and None not in ids and len(ids) < 4000
    assert near_dedup.among(docs, "doc_id", wanted.where("false")).isEmpty()
