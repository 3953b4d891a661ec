"""What the operators share: words, folds, bounded samples, and the shared folder's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.shared import Scratch, read, shared_dir

__all__ = ["WHITE", "WORD", "Scratch", "among", "bounded_sample", "claim", "fold", "read", "rows_kept", "shared_dir", "ship", "text_or_empty"]

#: ASCII white space, as a Java and DuckDB character class.
WHITE = r"[\x20\x09-\x0D]+"
#: A word: a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows with whole texts that go to a Python worker at a time, where the session has not said otherwise.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, and keeps batches of whole texts small on both sides.

    The session's default of 10,000 rows a batch is for narrow rows; another number is left as it is.
    """
    shared.ship(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out part."""
    return F.crc32(doc_id.cast("string")) % 5


def rows_kept(docs: DataFrame, digest: Column, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each row of ``kept`` (doc_id, digest, n), with the columns of ``docs``.

    ``kept`` is gone through several times. ``n`` says how many rows have that id (null is an id) and digest; of several, the one of smallest
    text is given. Digests are those of ``kept``; no digest is there with two ids.
    """
    kept = kept.select(F.col("doc_id").alias("__kept_id"), F.col("digest").alias("__kept_digest"), F.col("n").alias("__n"))
    named = docs.withColumn("__digest", digest)
    same = (F.col("__digest") == F.col("__kept_digest")) & F.col("doc_id").eqNullSafe(F.col("__kept_id"))
    one = named.join(kept.where("__n = 1"), same, "left_semi").select(*docs.columns)
    several = kept.where("__n > 1")
    n = several.count()  # ids are unique in most corpora; then the texts are gone through once
    if not n:
        return one
    many = named.join(F.broadcast(several) if n <= 50_000 else several, same, "left_semi").groupBy("__digest").agg(F.min_by(F.struct(*docs.columns), F.struct("text")).alias("__row"))
    return one.unionByName(many.select("__row.*"))


def bounded_sample(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, the same ones on every run: those whose hashed key is smallest."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    return df.orderBy(h, F.col(key)).limit(most)


#: Bits of a table of marks for each wanted key, and at most (as powers of two).
_MARK_BITS, _MOST_MARK_BITS = 4, 27


def among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key ``wanted`` (a table of that column, gone through twice) can hold: all that it holds, and a few of the others.

    The wanted keys' hashes are marked in a table of bits, some 16 a key and never more than 2^27, that
    goes to every task. So an exact join that follows moves little but the wanted rows. Null keys go.
    """
    bits = min(_MOST_MARK_BITS, max(10, wanted.count().bit_length() + _MARK_BITS))
    h = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    one = F.expr("shiftleft(1L, cast(__h & 63 AS int))")
    marked = wanted.where(F.col(key).isNotNull()).select(h.alias("__h")).groupBy(F.shiftright("__h", 6).alias("__word")).agg(F.bit_or(one).alias("__marks"))
    near = rows.where(F.col(key).isNotNull()).withColumn("__h", h).withColumn("__word", F.shiftright("__h", 6)).join(F.broadcast(marked), "__word")
    return near.where(F.col("__marks").bitwiseAND(one) != 0).select(*rows.columns)


#: How to empty what an operator's module keeps in a Python worker between tasks.
_kept: dict[str, Callable[[], None]] = {}


def claim(owner: str, empty: Callable[[], None] | None = None) -> None:
    """Says whose task runs in this worker; what other operators kept there is let go.

    Workers live on through many stages, and an executor's memory must not hold the caches of all
    operators that ever ran in it.
    """
    for name in [n for n in _kept if n != owner]:
        _kept.pop(name)()
    if empty:
        _kept[owner] = empty
