"""Complexity scores: scaling, summing, rounding, ablation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FEATURES, SCORE
from .groups import per_group
from .projection import encoded_type, language_code, token_range
from .sampling import drawn

#: A frame of the published data is one file, that is one source, language and type.
GROUP = ("source", "language", "type")


def prepared(df: DataFrame, least: int = 4, most: int = 100) -> DataFrame:
    """Rows within the token range, with codes for language and type, and what they were before."""
    kept = token_range(df, least, most).withColumn("original_n_tokens", F.col("n_tokens")).withColumn("language", language_code(F.col("language")))
    return kept.withColumn("type_original", F.col("type")).withColumn("question_type", encoded_type(F.col("type")))


def minmax(df: DataFrame, features: Sequence[str] = FEATURES, group: Sequence[str] = GROUP) -> DataFrame:
    """Each feature scaled to [0, 1] within its group; unchanged where all values are equal.

    The group's extremes are aggregated first and joined, as a broadcast where groups are few; then
    rows are not shuffled by group. ``df`` is gone through twice.
    """
    edges = per_group(df.groupBy(*group).agg(*[f(c).alias(f"__{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]))
    keys = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    joined = df.alias("a").join(edges.alias("b"), on, "left")

    def scaled(c: str):
        lo, hi = F.col(f"b.__lo_{c}"), F.col(f"b.__hi_{c}")
        return F.when(hi > lo, (F.col(f"a.{c}") - lo) / (hi - lo)).otherwise(F.col(f"a.{c}"))

    return joined.select(*[scaled(c).alias(c) if c in features else F.col(f"a.{c}").alias(c) for c in df.columns])


def scored(df: DataFrame, exclude: str | None = None, drop_excluded: bool = False, features: Sequence[str] = FEATURES) -> DataFrame:
    """Adds the sum of the features that are there, nulls counting as 0; ``exclude`` leaves one out."""
    present = [c for c in features if c in df.columns and c != exclude]
    total = F.lit(0.0)
    for c in present:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    out = df.withColumn(SCORE, total)
    return out.drop(exclude) if exclude and drop_excluded else out


def standardised(df: DataFrame, column: str = SCORE) -> DataFrame:
    """The column as z-score over the whole frame (n - 1 in the deviation), if that is above 0."""
    stats = df.agg(F.avg(column).alias("__mean"), F.stddev_samp(column).alias("__sd"))
    z = F.when(F.col("__sd") > 0, (F.col(column) - F.col("__mean")) / F.col("__sd")).otherwise(F.col(column))
    return df.crossJoin(F.broadcast(stats)).withColumn(column, z).drop("__mean", "__sd")  # stats is one row


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """Every floating column, half to even."""
    return df.select(*[F.bround(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def ablations(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """A row per input row and feature: the rounded score without that feature, from one pass."""
    without = F.array(*[F.struct(F.lit(x).alias("excluded"), sum((F.coalesce(F.col(c), F.lit(0.0)) for c in features if c != x), F.lit(0.0)).alias("score")) for x in features])
    rows = df.select("*", F.explode(without).alias("__a")).withColumn("excluded", F.col("__a.excluded"))
    return rows.withColumn(SCORE, F.bround("__a.score", 3)).drop("__a")


def shuffled(df: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """Adds ``position``, from 1: each row's place in a reproducible random order of all.

    Rows are cut into pieces by their draw and counted, so no task sorts them all.
    """
    return drawn(df, (), key, seed, "position", "__n").drop("__n")


def combined(frames: Sequence[DataFrame], seed: int | None = None) -> DataFrame:
    """All rows of the frames by column name; a seed gives them a reproducible order (rows that differ only in which columns are null differ)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out if seed is None else out.orderBy(F.md5(F.concat(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}), F.lit(f":{seed}"))))


def finalized(df: DataFrame, drop_original_tokens: bool = True) -> DataFrame:
    """Without the working columns."""
    return df.drop("type_original", *(["original_n_tokens"] if drop_original_tokens else []))


