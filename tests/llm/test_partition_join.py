import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiprobe.llm import partition_join as pj
from lexiprobe.llm.common import Scratch
from lexiprobe.llm.near_dedup import shingles

from .test_dedup import brute


def rows_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (2, 70)])
def test_equals_brute_force(docs, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = rows_of(pj.jaccard_classes(docs, width, percent))
    assert got == sorted(brute(rows, width, percent), key=repr)
    assert any(a != c for a, _, c in got)


def test_messy_rows_and_none(messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert rows_of(pj.jaccard_classes(messy, 4, 85)) == sorted(brute(rows, 4, 85), key=repr)
    assert pj.jaccard_classes(nothing, 4, 85).count() == 0


def near_copies(seed, bases, copies, words=(3, 80)):
    draw = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    out = []
    for _ in range(bases):
        base = [draw.choice(["x", "y", "z"]) + str(draw.randrange(400)) for _ in range(draw.randint(*words))] + draw.choice([[], common, common[:5]])
        for _ in range(draw.randint(1, copies)):
            text = list(base)
            for _ in range(draw.randrange(6)):
                at = draw.randrange(len(text) + 1)
                text[at : at + draw.randrange(2)] = [f"n{draw.randrange(50)}"] * draw.randrange(2)
            out.append(" ".join(text))
    draw.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("dear", [False, True])
def test_groups_of_near_copies(spark, monkeypatch, dear):
    """Many sizes, shared passages; also with lists that are compared in rounds, and neighbourhoods for all."""
    if dear:
        monkeypatch.setattr(pj, "SHORT", 0)
        monkeypatch.setattr(pj, "PICKS", 1)
        monkeypatch.setattr(pj, "ROWS", 5)
        monkeypatch.setattr(pj, "DEAR", 0.0)
    rows = near_copies(dear, 40, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(pj.jaccard_classes(df, 2, 85)) == sorted(brute(rows, 2, 85), key=repr)


def test_repeated_rows_give_one_pair(spark):
    a, b = " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(101))
    df = spark.createDataFrame([(1, a), (2, b)] * 300, "doc_id long, text string")
    assert rows_of(pj.jaccard_classes(df, 4, 85)) == [(1, 97, 1)] * 300 + [(2, 98, 1)] * 300


def test_partners_agree_in_a_chosen_segment():
    """The pigeonhole, on random pairs near the threshold and random allocations."""
    draw = np.random.default_rng(3)
    for percent in (60, 85, 95):
        bands = pj.Bands(percent)
        for _ in range(200):
            n = int(draw.integers(2, 120))
            common = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            x, y = (np.unique(np.concatenate([common, draw.integers(0, 1 << 63, int(draw.integers(0, max(1, n * (100 - percent) // 100))), dtype=np.uint64)])) for _ in range(2))
            x, y = sorted((x, y), key=len, reverse=True)
            both = len(np.intersect1d(x, y))
            if both * 100 < percent * (len(x) + len(y) - both):
                continue
            band = bands.of(np.array([len(y)]))
            assert bands.of(np.array([len(x)]))[0] - band[0] in (0, 1)
            most = int(bands.probed(np.array([len(x)]), band)[0])
            assert len(x) + len(y) - 2 * both <= min(most, int(bands.indexed(np.array([len(y)]))[0]))
            sx, sy = pj.Segments(bands, [x], band), pj.Segments(bands, [y], band)
            assert (sx.subsets() == sy.subsets()).sum() >= sx.many[0] - most
            v = pj.allocation(draw.random(sx.many[0]), draw.random(sx.many[0]), most + 1)
            assert (v + 1).sum() >= most + 1
            found = False
            for s in np.flatnonzero(v >= 0):
                mine, other = sx.deletions()[sx.at == s], sy.deletions()[sy.at == s]
                found |= sx.subsets()[s] == sy.subsets()[s]
                if v[s] == 1:
                    found |= sy.subsets()[s] in mine or sx.subsets()[s] in other
            assert found


def test_shingles_are_those_of_near_duplicates():
    assert len(shingles("A b\tc d E", 4)) == 2 and len(shingles("a b", 4)) == 1 and not len(shingles(" \n", 4))


def test_a_group_of_near_copies_leaves_few_links(spark):
    """Links of a block grew with the square of the group."""
    n = 60
    sets = spark.range(n).select(F.col("id").alias("node"), F.expr("concat(sequence(1L, 100L), array(1000 + id))").alias("shingles"))
    rows = spark.range(n).select(F.lit(7).cast("long").alias("bucket"), F.col("id").alias("node"), F.lit(101).cast("long").alias("n"), F.col("id").alias("label"), F.explode(F.array(F.lit(True), F.lit(False))).alias("asks"))
    links = [(r["a"], r["b"]) for r in pj._in_blocks(rows, sets, 85, Scratch(spark, "test")).collect()]
    assert len(links) == n - 1
    reached = {0}
    for _ in range(n):
        reached |= {x for link in links if reached & set(link) for x in link}
    assert reached == set(range(n))


def test_spanning_links_connect_what_all_links_do():
    draw = np.random.default_rng(5)
    for _ in range(50):
        x, y = draw.integers(0, 12, 15), draw.integers(0, 12, 9)
        link = draw.random((15, 9)) < 0.08

        def classes(pairs):
            part = list(range(12))
            for a, b in pairs:
                part = [part[a] if k == part[b] else k for k in part]
            return {frozenset(i for i in range(12) if part[i] == k) for k in part}

        p, q = pj.spanning(link, x, y)
        assert link[p, q].all() and len(p) < 12
        assert classes(zip(x[p], y[q])) == classes((x[i], y[j]) for i, j in zip(*np.nonzero(link)))


def test_rows_of_settled_lists_are_not_moved(spark):
    rows, lists = spark.range(20_000).selectExpr("id AS signature", "id + 7 AS node"), spark.range(3).selectExpr("id * 1000 AS signature", "id AS length")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for more lists than are broadcast
    try:
        joined = pj._in_lists(rows, lists, "signature").select("signature", "node", "length")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in joined.collect()} == {(0, 7, 0), (1000, 1007, 1), (2000, 2007, 2)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Rows of other lists go before the exchange, by marks that every task has.
    assert plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning(signature") < plan.index("BroadcastHashJoin")


def test_lists_that_nobody_looks_up_are_not_kept(spark, monkeypatch):
    """All one-deletion neighbourhoods of a band were kept, and read again and again."""
    monkeypatch.setattr(pj, "PICKS", 1)
    monkeypatch.setattr(pj, "DEAR", 0.0)
    keep, kept = Scratch.keep, {}
    monkeypatch.setattr(Scratch, "keep", lambda self, df, table: kept.setdefault(table, keep(self, df, table)))
    rows = near_copies(1, 40, 25)
    assert rows_of(pj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 2, 85)) == sorted(brute(rows, 2, 85), key=repr)
    which = [r["band"] for r in kept["ranked"].where("dear").select("band").distinct().collect()]
    whole = pj._neighbours(kept["sets"], pj.Bands(85), None, which)
    asked = kept["ranked"].where("dear").select("signature").distinct()
    assert which and kept["deleted"].count() * 2 < whole.count()
    assert kept["deleted"].join(asked, "signature", "left_semi").count() == whole.join(asked, "signature", "left_semi").count() > 0


def test_copies_give_their_signatures_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(k, text) for k in range(500)] + [(900, text + " more")], "doc_id long, text string")
    some = Scratch(spark, "test").keep(pj._sketched(df, 4, pj.Bands(85)), "sketched")
    nodes = some.groupBy("node").agg(F.min("row").alias("row"))
    assert some.count() == 501 and nodes.count() == 2
    assert pj._entries(some, nodes).count() * 5 < some.selectExpr("sum(size(signatures)) AS n").first()["n"]
