"""Connected components of a link table, without gathering links or components anywhere.

Each node repeatedly takes the smallest label among its own and its neighbours', then the label of
its label (pointer jumping), until nothing changes. Every round is written to the shared folder, so
a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b); label is the smallest node that it reaches."""
    both = scratch.keep(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.keep(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-0")
    at = 0
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("m"))
        lower = labels.join(seen, "node").select("node", "label", F.least("label", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        nxt = scratch.keep(lower.join(jump, "low").select("node", F.least("low", "next").alias("new"), "label"), f"{name}-{at + 1}")
        changed = not nxt.where("new < label").isEmpty()
        scratch.drop(f"{name}-{at}")
        at += 1
        labels = nxt.select("node", F.col("new").alias("label"))
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels


def dense_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``components`` of a graph of far more links than nodes: nodes are one with their smallest neighbour first, which leaves few links."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    low = scratch.keep(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("low")), f"{name}-low")
    end = lambda c: low.select(F.col("node").alias(c), F.col("low").alias(f"l{c}"))
    left = links.join(end("a"), "a").join(end("b"), "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).where("a != b").distinct()
    top = components(scratch.keep(left, f"{name}-left"), scratch, name).select(F.col("node").alias("low"), "label")
    return scratch.keep(low.join(top, "low", "left").select("node", F.coalesce("label", "low").alias("label")), f"{name}-all")


def extended(labels: DataFrame, more: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``labels`` (node, label) of some links, brought up to date with ``more`` links (a, b).

    Only the new links are gone through, between the components that there are.
    """
    end = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    ends = more.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = components(scratch.keep(ends.where("a != b").distinct(), f"{name}-ends"), scratch, name)
    old = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("lower")), "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    return scratch.keep(old.unionByName(joined.join(labels.select("node"), "node", "left_anti")), f"{name}-all")
