"""Aggregates with a row a group, made ready for a join with all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that are sent to every task, at most.
MOST = 10_000


def per_group(table: DataFrame, most: int = MOST) -> DataFrame:
    """``table``, broadcast if it has at most ``most`` rows (it is then computed once), else as it is.

    Groups such as a language and type are few and hold much of all rows each, so a join by key would
    put much of the input into one task. Spark can't know that an aggregate is small before it ran.
    """
    rows = table.limit(most + 1).collect()
    return table if len(rows) > most else F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def matched(rows: DataFrame, table: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` beside the one row of ``table`` of their group, where null is a group like others."""
    if not by:
        return rows.crossJoin(table)  # one row
    other = table.withColumnsRenamed({c: f"__by_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return rows.join(other, same, how).drop(*(f"__by_{c}" for c in by))
