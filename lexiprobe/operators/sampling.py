"""Deterministic sampling: rows are ranked by the hash of key and seed, so reruns agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import SCORE, SEEDS
from ..sources.shared import Scratch
from .groups import matched, per_group
from .quantiles import quantiles


def draw(key: str, seed: int) -> Column:
    """The order of random draws; the same in any engine that has MD5. A null key draws like an empty one."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], part: Column, rank: str, size: str) -> DataFrame:
    """Adds each row's place in its group, from 1, and the group's size.

    There are few groups (a language and type), so a window over a group would put much of the input
    into one task. ``part`` cuts a group into pieces that follow the order; pieces are counted, and a
    row's place is that of its piece plus its place within.
    """
    g = F.to_json(F.struct(*[F.col(c) for c in group]), {"ignoreNullFields": "false"}) if group else F.lit("")
    rows = df.withColumn("__g", g).withColumn("__part", part)
    cells = rows.groupBy("__g", "__part").agg(F.count("*").alias("__k"))
    w = W.partitionBy("__g")
    before = F.coalesce(F.sum("__k").over(w.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("__g", "__part", before.alias("__before"), F.sum("__k").over(w).alias(size))
    # A row whose key is null has no part, which is a part of its own.
    cells = cells.withColumnsRenamed({"__g": "__of", "__part": "__of_part"})
    placed = rows.join(cells, (F.col("__g") == F.col("__of")) & F.col("__part").eqNullSafe(F.col("__of_part")))
    inside = F.row_number().over(W.partitionBy("__g", "__part").orderBy(*order))
    return placed.withColumn(rank, F.col("__before") + inside).drop("__g", "__part", "__of", "__of_part", "__before")


def drawn(df: DataFrame, group: Sequence[str], key: str, seed: int, rank: str, size: str) -> DataFrame:
    """``ranked`` by random draw; the pieces are the first three digits of the draw."""
    d = draw(key, seed)
    return ranked(df, group, [d, F.col(key)], F.substring(d, 1, 3), rank, size)


def hold_out(df: DataFrame, group: Sequence[str], size: int, key: str = "doc_id", seed: int = 69) -> DataFrame:
    """Adds ``dev``: least(size, a tenth) rows of each group are held out, drawn first."""
    rows = drawn(df, group, key, seed, "__rank", "__n")
    return rows.withColumn("dev", F.col("__rank") <= F.least(F.lit(size), F.floor(F.col("__n") / 10))).drop("__rank", "__n")


def split(df: DataFrame, strata: Sequence[str], ratio: float = 0.1, least: int = 5, key: str = "doc_id", seed: int = 69) -> DataFrame:
    """Adds ``split``: validation gets greatest(2, floor(n * ratio)) rows of each stratum with at
    least ``least`` rows; smaller strata, and frames of at most ten rows, are all train."""
    total = df.agg(F.count("*").alias("__total"))  # one row
    rows = drawn(df, strata, key, seed, "__rank", "__n").crossJoin(F.broadcast(total))
    chosen = (F.col("__total") > 10) & (F.col("__n") >= least) & (F.col("__rank") <= F.greatest(F.lit(2), F.floor(F.col("__n") * ratio)))
    return rows.withColumn("split", F.when(chosen, "validation").otherwise("train")).drop("__total", "__rank", "__n")


def token_bins(df: DataFrame, group: Sequence[str], column: str = "n_tokens", size: str = "n") -> DataFrame:
    """Adds ``bin``: least(greatest(5, n / 10), 10) equally filled bins of each group; and n as ``size``."""
    fractions = [k / d for d in range(5, 11) for k in range(d + 1)]
    points = quantiles(df, column, fractions, group).drop("n")
    groups = matched(df.groupBy(*group).agg(F.count("*").alias("n")), points, group, "left") if group else points.crossJoin(df.agg(F.count("*").alias("n")))
    bins = F.least(F.greatest(F.lit(5), F.floor(F.col("n") / 10)), F.lit(10)).cast("int")
    start = {d: sum(x + 1 for x in range(5, d)) for d in range(5, 11)}
    picked = F.slice("p", F.element_at(F.create_map(*[F.lit(v) for d in start for v in (d, start[d] + 1)]), bins), bins + 1)
    # A group without values is one bin.
    groups = per_group(groups.select(*group, F.coalesce(F.array_distinct(picked), F.array().cast("array<double>")).alias("edges"), F.col("n").alias(size)))
    x = F.col(column).cast("double")
    inner = F.filter("edges", lambda e, i: (i > 0) & (e < x))
    top = F.size("edges") - 2
    return matched(df, groups, group).withColumn("bin", F.coalesce(F.least(F.size(inner), F.greatest(top, F.lit(0))), F.lit(0))).drop("edges")


def quota(table: dict[tuple[str, str], int], default: int, language: str = "language", kind: str = "type") -> Column:
    """Rows wanted of a language and type; ``default`` where the table has none."""
    out = F.lit(default)
    for (name, of), n in table.items():
        out = F.when((F.col(language) == name) & (F.col(kind) == of), n).otherwise(out)
    return out


def token_sample(df: DataFrame, target: int | Column, group: Sequence[str], column: str = "n_tokens", key: str = "doc_id", seed: int = 69) -> DataFrame:
    """At most ``target`` rows a group (a number, or a column of the group, as from ``quota``), from
    each token bin in proportion to its share.

    A group of at most ``target`` rows stays whole. Each bin gives greatest(1, floor(share of
    target)) rows; what exceeds the target in all is trimmed by a second draw.
    """
    target = F.lit(target) if isinstance(target, int) else target
    rows = token_bins(df, group, column, "__group")
    rows = drawn(rows, [*group, "bin"], key, seed, "__rank", "__n")
    small = F.col("__group") <= target
    rows = rows.where(small | (F.col("__rank") <= F.greatest(F.lit(1), F.floor(target * 1.0 * F.col("__n") / F.col("__group"))))).drop("__rank", "__n")
    rows = drawn(rows, group, key, seed + 1, "__rank", "__n")
    return rows.where(small | (F.col("__rank") <= target)).drop("__rank", "__n", "__group", "bin")


def match_distribution(pool: DataFrame, reference: DataFrame, target: int, column: str = SCORE, key: str = "doc_id", seed: int = 69) -> DataFrame:
    """``target`` rows of ``pool`` whose column is distributed like the reference's.

    The reference's deciles (fewer if it has under 200 rows) are the bins; each bin gives
    greatest(1, floor(share of target)) rows, then the rest is drawn from what is left, or the
    excess trimmed. A pool smaller than the target stays whole. Both are gone through several times,
    so they are written once.
    """
    scratch = Scratch(pool.sparkSession, "match")
    pool, reference = scratch.keep(pool, "pool"), scratch.keep(reference.select(F.col(column).cast("double").alias(column)), "reference")
    if pool.count() < target:
        return pool
    n_ref = reference.count()
    bins = min(10, n_ref // 20)
    if bins < 2:
        return token_sample(pool.withColumn("__all", F.lit(1)), target, ["__all"], key=key, seed=seed).drop("__all")
    found = quantiles(reference, column, [k / bins for k in range(bins + 1)]).first()
    edges = sorted(set(found["p"]))[1:-1] if found else []
    place = sum(((F.col(column) >= e).cast("int") for e in edges), F.lit(0))
    share = reference.groupBy(place.alias("bin")).agg((F.count("*") / F.lit(float(n_ref))).alias("share"))
    rows = drawn(pool.withColumn("bin", place), ["bin"], key, seed, "__rank", "__n").join(F.broadcast(share), "bin", "left")  # at most ten bins
    quota = F.when(F.col("share").isNull(), 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("share") * target)))
    # Rows chosen by bin come first; filling up and trimming are both the first ``target`` of this order.
    rows = rows.withColumn("__in", F.col("__rank") <= quota)
    return rows.orderBy(F.desc("__in"), draw(key, seed + 1), key).limit(target).drop("bin", "share", "__in", "__rank", "__n")


def shuffled_labels(df: DataFrame, label: str, seeds: Sequence[int] = SEEDS, within: str = "language", key: str = "doc_id") -> DataFrame:
    """Controls: for each seed, the label permuted within each language; ``config`` names the control."""
    rows = df.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    ends = df.agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))  # one row
    rows = rows.crossJoin(F.broadcast(ends))
    piece = F.floor((F.col(key) - F.col("__lo")) * 1000 / (F.col("__hi") - F.col("__lo") + 1))
    d = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("seed").cast("string")))
    group = [within, "seed"]
    left = ranked(rows, group, [F.col(key)], piece, "__at", "__n").drop(label, "__lo", "__hi", "__n")
    right = ranked(rows, group, [d, F.col(key)], F.substring(d, 1, 3), "__r", "__n").select(F.col(within).alias("__w"), F.col("seed").alias("__s"), "__r", F.col(label))
    on = F.col(within).eqNullSafe(F.col("__w")) & (F.col("seed") == F.col("__s")) & (F.col("__at") == F.col("__r"))
    return left.join(right, on).drop("__w", "__s", "__r", "__at").withColumn("config", F.concat(F.lit(f"control_{label}_seed"), F.col("seed").cast("string")))
