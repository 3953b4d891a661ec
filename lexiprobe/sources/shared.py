"""The shared folder, tables written below it, and the package on the workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a local
    session gets a temporary folder of its own; a cluster session must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lexiprobe-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


class Scratch:
    """Tables of one run, written below the shared folder so that a lost executor loses nothing.

    ``keep`` writes a frame and gives it back as read from the files, which cuts its lineage.
    ``drop`` deletes a table that later plans don't read any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/lexiprobe/{name}-{uuid.uuid4().hex}"
        _written.append(self.path)

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        at = f"{self.path}/{table}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def keep_by(self, df: DataFrame, table: str, key: str, parts: int) -> DataFrame:
        """Like ``keep``, in ``parts`` buckets by ``key``: what then goes by that key needs no exchange.

        ``df`` should be hash partitioned by it into as many parts, else each task writes to many buckets.
        """
        name = f"kept_{uuid.uuid4().hex}"
        df.write.bucketBy(parts, key).sortBy(key).format("parquet").option("path", f"{self.path}/{table}").saveAsTable(name)
        kept = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files are not the catalog's own
        return kept

    def drop(self, *tables: str) -> None:
        for table in tables:
            _delete(self.spark, f"{self.path}/{table}")


#: Folders of this process's runs that may still hold tables.
_written: list[str] = []


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def holds(path: str | None) -> bool:
    """Whether a run's folder was written by this process and not cleared."""
    return path in _written


def clear(spark: SparkSession) -> None:
    """Deletes the tables that runs of this process left below the shared folder.

    Results are read from such tables when they are used, so this is for when all are used or written.
    """
    while _written:
        _delete(spark, _written.pop())


_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, whatever their own search path; once an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent.parent
        to = tempfile.mkdtemp(prefix="lexiprobe-code-")  # read by the driver alone, which serves it
        atexit.register(shutil.rmtree, to, ignore_errors=True)
        _shipped[context.applicationId] = shutil.make_archive(f"{to}/{root.name}", "zip", root.parent, root.name)
        context.addPyFile(_shipped[context.applicationId])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
