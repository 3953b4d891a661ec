"""Exact deduplication against a persistent digest index (DataFrame and SQL functions only).

The index is a table of text digests, bucketed and sorted by digest. A batch of documents is
grouped by digest, its groups are sort-merge anti-joined with the index, and only the groups that
the index lacks are appended, so each batch reads its own texts once and the index's digests once.

Defined results
---------------
* Texts are equal if identical after each run of ASCII white space became one space; a null text
  counts as the empty text, and empty texts are equal to each other.
* Of equal texts the row with the smallest doc_id stays; a text that an earlier batch brought keeps
  the id the index holds. Rows with a null doc_id come after all others; where a group has no
  other, they are all kept. Repeated rows (same doc_id, same text) share one decision.
* An empty table gives an empty result. Only ``id_col`` and ``text_col`` are read, so further
  columns may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, Scratch, read, rows_kept, text_or_empty


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): 32 bytes of SHA-256 of each normalised text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text_or_empty(text_col)), 256)).alias("digest"))


class DigestIndex:
    """A table (digest, keep_id, batch) at ``path``, in ``buckets`` buckets by digest, sorted within.

    The path outlives the session: a new ``DigestIndex`` with the same path and number of buckets
    attaches to the files that are there.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.table = "digest_index_" + re.sub(r"\W", "_", path)[-80:].lower()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def lacks(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index has not: a sort-merge anti-join by bucket."""
        return groups.join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        (
            groups.select("digest", "keep_id", F.lit(batch).alias("batch"))
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def forget(self) -> None:
        """Takes the table out of the catalog; its files stay and can be attached again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def dedup_batch(docs: DataFrame, index: DigestIndex, batch: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicates one batch within itself and against ``index``, and appends what is new.

    Returns a row per document: doc_id, keep_id (the row that stays), group_size (rows of this batch
    with the text), kept, text_sha256.
    """
    of = scratch.keep(digests(docs, id_col, text_col), f"{batch}-digests")
    groups = scratch.keep(of.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), f"{batch}-groups")
    index.append(index.lacks(groups), batch)
    # Written before the join with the documents, so that both sides of it are plain exchanges
    # and a digest with a third of all rows is split by adaptive execution.
    settled = scratch.keep(groups.select("digest", "group_size").join(index.rows().select("digest", "keep_id"), "digest"), f"{batch}-settled")
    return _decided(of, settled)


def _decided(of: DataFrame, settled: DataFrame) -> DataFrame:
    return of.join(settled, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """All of ``docs``, brought to an index of its own in ``batches`` batches of ascending ids (null last).

    Each batch's texts are anti-joined with what the batches before brought, so the row that stays is
    the one of smallest id in the whole table; ``group_size`` counts all batches' rows with the text.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    of = scratch.keep(digests(docs, id_col, text_col), "digests")
    index = DigestIndex(docs.sparkSession, f"{scratch.path}/index")
    cuts = of.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    # A batch is what lies above one cut and not above the next; without ids there is one batch.
    bounds = [None, *sorted(set(cuts or [])), None]
    brought = None
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        last = high is None
        within = F.lit(True) if low is None else F.col("doc_id") > low
        part = of.where((within | F.col("doc_id").isNull()) if last else within & (F.col("doc_id") <= high))
        groups = scratch.keep(part.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), f"groups-{k}")
        index.append(index.lacks(groups), str(k))
        brought = groups if brought is None else brought.unionByName(groups)
    sizes = brought.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    settled = scratch.keep(sizes.join(index.rows().select("digest", "keep_id"), "digest"), "settled")
    index.forget()
    scratch.drop("index", *(f"groups-{k}" for k in range(len(bounds) - 1)))
    return _decided(of, settled)


def keep_distinct(docs: DataFrame) -> DataFrame:
    """One row of each normalised text, of smallest doc_id (null last), with the columns of ``docs``."""
    scratch = Scratch(docs.sparkSession, "keep-distinct")
    kept = exact_dedup(docs).where("kept").groupBy("doc_id", F.unhex("text_sha256").alias("digest")).agg(F.count("*").alias("n"))
    return rows_kept(docs, F.unhex(F.sha2(normalised(text_or_empty()), 256)), scratch.keep(kept, "kept"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
