"""Exact quantiles of groups of any size, by selection instead of one buffer a group.

Approximate splitters cut each group into some 256 buckets, which are counted. The wanted ranks then
lie in known buckets, and only the values of those are counted one by one. The largest task holds the
distinct values of one bucket, about a 256th of a group's (or one value, however often it occurs).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .groups import matched, per_group

BUCKETS = 256


def quantiles(df: DataFrame, column: str, fractions: Sequence[float], by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """(by, p, n): the interpolated quantiles at ``fractions`` as an array, and the number of values that are not null.

    Groups with a null key are groups; groups without values have no row. ``df`` is gone through twice.
    """
    x = df.select(*by, F.col(column).cast("double").alias("__x")).where("__x IS NOT NULL")
    cuts = F.percentile_approx("__x", [(k + 1) / buckets for k in range(buckets - 1)], 20 * buckets)
    groups = per_group(x.groupBy(*by).agg(F.array_sort(F.array_distinct(cuts)).alias("__cuts"), F.count("*").alias("n")))
    placed = matched(x, groups, by).withColumn("__bucket", F.size(F.filter("__cuts", lambda c: c < F.col("__x")))).drop("__cuts")
    w = W.partitionBy(*by).orderBy("__bucket")
    counted = placed.groupBy(*by, "__bucket").agg(F.count("*").alias("__k"), F.first("n").alias("n"))
    counted = counted.withColumn("__before", F.sum("__k").over(w) - F.col("__k"))  # at most as many rows a group as buckets
    place = F.posexplode(F.array(*[F.lit(float(f)) for f in fractions])).alias("__at", "__f")
    at = (F.col("n") - 1) * F.col("__f")
    wanted = counted.select(*by, "n", "__bucket", "__before", "__k", place).withColumn("__rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))))
    wanted = wanted.where((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__k")))
    inside = [*by, "__bucket"]
    hit = placed.join(per_group(_renamed(wanted.select(*inside).distinct(), inside)), _same(inside), "left_semi")
    values = hit.groupBy(*inside, "__x").agg(F.count("*").alias("__c"))
    values = values.withColumn("__upto", F.sum("__c").over(W.partitionBy(*inside).orderBy("__x")))
    asked = _renamed(wanted.select(*inside, "n", "__at", "__f", "__rank", "__before"), inside)
    local = F.col("__rank") - F.col("__before")
    found = values.join(asked, _same(inside) & (local < F.col("__upto")) & (local >= F.col("__upto") - F.col("__c")))
    ends = found.groupBy(*by, "n", "__at", "__f").agg(F.min_by("__x", "__rank").alias("lo"), F.max_by("__x", "__rank").alias("hi"))
    rest = at - F.floor(at)
    value = F.when(rest == 0, F.col("lo")).otherwise(F.col("lo") * (1 - rest) + F.col("hi") * rest)
    points = ends.select(*by, "n", F.struct("__at", value.alias("v")).alias("__p")).groupBy(*by, "n").agg(F.sort_array(F.collect_list("__p")).alias("__ps"))
    return points.select(*by, F.transform("__ps", lambda p: p["v"]).alias("p"), "n")


def _renamed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"__of_{c}" for c in columns})


def _same(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return out
