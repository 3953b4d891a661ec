"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length (in words) within each source. A source's target is met by
whole passes over the source plus a set of documents whose lengths add up to the rest. That set is
first taken in proportion from every length; what is then missing is closed by bounded-knapsack
dynamic programming over the lengths that are still available. Only counts by length leave the
documents; the documents of each length are then chosen by a seeded hash.

Defined results
---------------
* A null or empty text has size 0, takes 0 words and never changes a target.
* Sources are ordered by code point, null last (null is a source of its own); weights repeat over
  that order. A source without words has target 0. An empty table gives an empty result.
* Ties in the seeded order fall to the smaller doc_id; repeated rows (same id and text) count as
  rows of their own. Equal seeds give equal results. Only ``doc_id``, ``source`` and ``text`` are
  read, so further columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, read

#: The dynamic program runs over a remaining budget of at most so many words (times the lengths' common divisor).
DP_WORDS = 1 << 24
#: Sources of at most so many documents are fitted over all sets: the sums of either half meet in the middle.
ENUMERATED = 40
#: Parts by hash into which the documents of one length are counted, so that no length is one task.
HASH_PARTS = 256


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size).

    Weighted shares of ``share`` times all words, none above ``most`` times its source. A source is
    full when level * weight exceeds its cap; taking sources by cap over weight, the level that the
    rest share follows from running sums, so no iteration is needed. There is one row a source here.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = per_source.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(most)).alias("cap"))
    by_level = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.select("*", (
        (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("w").over(by_level.rowsBetween(0, W.unboundedFollowing))
    ).alias("level"))
    # The first source whose cap lies at or above the level shared from it on sets the level; from
    # there the running levels fall, so it is the largest of such levels.
    t = t.select("*", F.max(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))).over(whole).alias("final"))
    return t.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w"))).alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget``.

    Documents are taken in proportion, and dynamic programming over those still free closes the gap.
    Where it can't, more of what was taken is given back and the program runs over a wider gap, at
    last one of DP_WORDS. So the sum is the largest one not above the budget for budgets up to DP_WORDS
    (times the lengths' common divisor), and for sources of up to ENUMERATED documents. Beyond that
    it is the largest that differs from the proportional choice within DP_WORDS words; subset sums of
    any size have no bounded method. Memory: five bytes a word of the gap. Documents without words
    are taken by whole passes alone.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if int(counts[lengths > 0].sum()) <= ENUMERATED:
        return _enumerated(lengths, counts, budget)
    unit = int(np.gcd.reduce(lengths[lengths > 0]))
    size, budget = lengths // unit, budget // unit
    take = np.where(lengths > 0, (counts * budget) // max(total // unit, 1), 0)
    left = budget - int((take * size).sum())
    longest, shortest = np.argsort(-size, kind="stable"), np.argsort(size, kind="stable")
    for window in (1 << 16, 1 << 20, DP_WORDS):
        for k in longest:  # down to what the window holds
            if left <= window:
                break
            more = min(int(counts[k] - take[k]), (left - window // 2) // max(int(size[k]), 1))
            if more > 0:
                take[k] += more
                left -= more * int(size[k])
        gap = min(left, window)
        got, missed = _reached(size, counts - take, gap)
        if missed == 0 and gap == left or gap == budget:
            break
        if window < DP_WORDS:  # give back what the next window holds; short documents close gaps best
            for k in shortest:
                back = min(int(take[k]), max(window * 16 - left, 0) // max(int(size[k]), 1))
                take[k] -= back
                left += back * int(size[k])
    return take + got


def _enumerated(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The best set of a few documents, out of all: for each set of the first half, the best of the second."""
    which = np.repeat(np.arange(len(lengths)), np.where(lengths > 0, counts, 0))
    half = len(which) // 2

    def sums(documents: np.ndarray) -> np.ndarray:
        out = np.zeros(1, dtype=np.int64)
        for k in documents:
            out = np.concatenate([out, out + lengths[k]])  # bit i of a place: whether document i is in
        return out

    one, other = sums(which[:half]), sums(which[half:])
    order = np.argsort(other, kind="stable")
    at = np.searchsorted(other[order], budget - one, "right") - 1
    best = int(np.where(at >= 0, one + other[order[np.maximum(at, 0)]], -1).argmax())
    bits = best | int(order[at[best]]) << half
    return np.bincount(which[[i for i in range(len(which)) if bits >> i & 1]], minlength=len(lengths)).astype(counts.dtype)


def _reached(size: np.ndarray, free: np.ndarray, gap: int) -> tuple[np.ndarray, int]:
    """Bounded knapsack: the documents of the largest sum not above ``gap``, and what is missing to it.

    Each length's documents form bundles of 1, 2, 4, ...; for each sum the first bundle that reached
    it is kept. The sum without that bundle was reached by earlier bundles alone.
    """
    seen = np.zeros(gap + 1, dtype=bool)
    first = np.full(gap + 1, -1, dtype=np.int32)
    seen[0] = True
    bundles: list[tuple[int, int]] = []
    top = 0  # no sum above it is reached
    for k in np.argsort(size, kind="stable").tolist():
        words, n, part = int(size[k]), int(free[k]), 1
        if words == 0 or words > gap:
            continue
        n = min(n, gap // words)
        while n > 0 and not seen[gap]:
            some = min(part, n)
            add = some * words
            upto = min(top + add, gap)
            new = seen[: upto + 1 - add] & ~seen[add : upto + 1]
            seen[add : upto + 1] |= new
            first[add : upto + 1][new] = len(bundles)
            bundles.append((k, some))
            top, n, part = upto, n - some, part * 2
        if seen[gap]:
            break
    best = at = int(np.flatnonzero(seen)[-1])
    out = np.zeros(len(size), dtype=np.int64)
    while at:
        k, some = bundles[first[at]]
        out[k] += some
        at -= some * int(size[k])
    return out, gap - best


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    size, n = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = int(n // size) if size else 1
    pdf["passes"] = passes
    pdf["extra"] = fit_lengths(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(n - passes * size) if size else 0)
    return pdf[["key", "size", "n", "passes", "extra", "source_size", "target"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, copies (times the mix takes it)."""
    return _mixed(docs, weights, share, most, seed).drop("key")


def _key() -> Column:
    """The source as a key; null gets one of its own, which no source has."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _mixed(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """The rows of ``mix`` with their source's key."""
    scratch = Scratch(docs.sparkSession, "mixing")
    key = _key()
    rank = F.xxhash64(F.lit(seed), F.col("doc_id"))
    each = scratch.keep(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")).select("*", key.alias("key"), rank.alias("rank"), F.pmod(rank, F.lit(HASH_PARTS)).cast("int").alias("part")), "documents")
    parts = scratch.keep(each.groupBy("key", "size", "part").agg(F.count("*").alias("n"), F.first("source").alias("source")), "parts")
    goal = targets(parts.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size")).drop("key"), weights, share, most)
    by_length = parts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    fitted = by_length.join(goal.select(key.alias("key"), "source_size", "target"), "key").groupBy("key").applyInPandas(_fit, "key string, size long, n long, passes int, extra long, source_size long, target double")
    # Of a length, whole parts by hash are taken in order, and one part is split by rank.
    before = F.coalesce(F.sum("n").over(W.partitionBy("key", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = scratch.keep(parts.select("key", "size", "part", F.col("n").alias("n_part"), before.alias("before")).join(fitted, ["key", "size"]).select(
        "key", "size", "part", "passes", "source_size", "target", "n_part", F.greatest(F.lit(0), F.least("n_part", F.col("extra") - F.col("before"))).alias("quota")
    ), "plan")
    at = each.select("doc_id", "key", "size", "part", "rank").join(plan, ["key", "size", "part"])
    split = (F.col("quota") > 0) & (F.col("quota") < F.col("n_part"))
    place = F.row_number().over(W.partitionBy("key", "size", "part").orderBy("rank", "doc_id"))
    sure = at.where(~split).select("*", (F.col("quota") > 0).cast("int").alias("chosen"))
    cut = at.where(split).select("*", (place <= F.col("quota")).cast("int").alias("chosen"))
    copies = F.col("passes") + F.col("chosen")
    return sure.unionByName(cut).select("doc_id", "key", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it (a document without words: once a pass).

    Rows are matched by doc_id (null is an id), source and size. Where the mix takes some of the rows
    that share all three once more than the others, these are the ones of smallest text.
    """
    scratch = Scratch(docs.sparkSession, "repeated")
    low = F.min("copies").cast("int")
    taken = _mixed(docs, **how).groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__of"), F.col("size").alias("__words")).agg(
        low.alias("__low"), F.max("copies").alias("__high"), (F.sum("copies") - low * F.count("*")).alias("__more")
    )
    taken = scratch.keep(taken.where("__high > 0"), "taken")
    named = docs.withColumns({"__key": _key(), "__size": words_in(F.col("text"))})
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of")) & (F.col("__size") == F.col("__words"))
    out = named.join(taken.where("__low = __high"), same).select(*docs.columns, F.col("__low").alias("__copies"))
    unlike = taken.where("__low < __high")
    n = unlike.count()  # ids are unique in most corpora; then the texts are gone through once
    if n:
        place = F.row_number().over(W.partitionBy("__id", "__of", "__words").orderBy("text"))
        met = named.join(F.broadcast(unlike) if n <= 50_000 else unlike, same)
        out = out.unionByName(met.select(*docs.columns, (F.col("__low") + (place <= F.col("__more")).cast("int")).alias("__copies")))
    return out.where("__copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
