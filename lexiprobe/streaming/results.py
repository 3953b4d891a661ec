"""Result documents as they arrive.

The published pipeline has no streams; this follows a growing folder of result documents and keeps
counts by status, so a long batch can be watched. It adds nothing to the batch results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.results import standardized
from ..schemas import RESULT


def follow(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Standardized rows of new documents below ``path``, each experiment once within ``late``."""
    docs = spark.readStream.schema(RESULT).json(path)
    rows = standardized(docs).withColumn("at", F.try_to_timestamp("timestamp")).where("at IS NOT NULL")
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["experiment_id"])


def append_standardized(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new to a Parquet table and stops; run it again for the next documents."""
    return follow(spark, source).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
