"""Experiment batches: features once, every cell of a grid, result documents and their rollups."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import models, results, tfidf
from ..operators.grid import experiment_id_of
from ..operators.projection import task_type, with_label
from ..schemas import RESULT
from ..sources import readers
from ..sources.shared import Scratch


def run_batch(dataset: DataFrame, cells: list[dict], min_df: int = 3, max_features: int = tfidf.MAX_FEATURES, store: str | None = None, side_by_side: int = 4) -> list[dict]:
    """Result documents of the cells (language, task, model_type, config), features fitted once.

    ``dataset``: doc_id, text, language, split, config and label columns. Cells run ``side_by_side``,
    each in a scheduler pool of its own, over one written feature table. A failing cell gives a failed
    document and stops nothing. With a ``store``, each document is committed under its id as soon as
    it is there, and cells that the store has completed are taken from it: a batch that was killed
    goes on where it ended.
    """
    spark = dataset.sparkSession
    done = {} if store is None else {r["experiment_id"]: r.asDict(recursive=True) for r in readers.stored_results(spark, store).where("status = 'completed'").collect()}  # a row a cell
    left = [c for c in cells if experiment_id_of(c) not in done]
    if left:
        scratch = Scratch(spark, "batch")
        base = dataset.where("config = 'base'")
        model = tfidf.Tfidf(max_features=max_features, min_df=min_df).fit(base.where("split = 'train'"))
        model.vocabulary = scratch.keep(model.vocabulary, "vocabulary")
        size = model.vocabulary.count()
        # In buckets by document, as the counts are: no cell moves them.
        vectors = scratch.keep_by(model.transform(base).select("doc_id", "term_id", "tfidf"), "vectors", "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")))

        def run(cell: dict) -> dict:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", experiment_id_of(cell))
            document = run_cell(dataset, vectors, size, cell)
            if store is not None:
                readers.write_results(as_documents(spark, [document]), store)
            return document

        pool = ThreadPoolExecutor(max(1, side_by_side))
        try:
            done |= {d["experiment_id"]: d for d in pool.map(inheritable_thread_target(run), left)}
        finally:
            pool.shutdown(cancel_futures=True)
    return [done[experiment_id_of(c)] for c in cells]


def run_cell(dataset: DataFrame, vectors: DataFrame, size: int, cell: dict) -> dict:
    """The result document of one cell."""
    kind = task_type(cell["task"])
    document = {"experiment_id": experiment_id_of(cell), "timestamp": datetime.now(timezone.utc).isoformat(), "config": cell}
    try:
        rows = with_label(dataset.where((F.col("config") == cell.get("config", "base")) & (F.col("language") == cell["language"])), cell["task"])
        data = models.sparse_rows(vectors, rows.select("doc_id", "split", F.col("label").cast("double").alias("label")), size)
        parts = {name: data.where(F.col("split") == split) for name, split in (("train", "train"), ("val", "validation"), ("test", "test"))}
        return document | models.experiment(cell["model_type"], kind, parts, params=cell.get("params"), config=cell)
    except Exception as e:  # recorded in the document of the cell
        return document | {"status": "failed", "error": f"{type(e).__name__}: {e}"[:500], "task_type": kind}


def as_documents(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """Result documents as rows of ``schemas.RESULT``; what that has no field for is left out."""

    def fitted(value, kind):
        if isinstance(kind, T.StructType):
            return None if value is None else {f.name: fitted(value.get(f.name), f.dataType) for f in kind.fields}
        return str(value) if value is not None and isinstance(kind, T.StringType) else value

    return spark.createDataFrame([fitted(d, RESULT) for d in documents], RESULT)


def summaries(documents: DataFrame) -> dict[str, DataFrame]:
    """Every summary table of a batch of result documents (``schemas.RESULT``)."""
    rows = results.standardized(documents)
    done = rows.where("status = 'completed'")
    compared = results.main_vs_control(done)
    long = results.long_form(done)
    return {
        "all_results": rows, "successful_results": done, "failed_results": rows.where("status = 'failed'"), "main_vs_control": compared, "by_task_language": results.by_task_language(done),
        "by_model_type": results.by_model_type(done), "improvements": results.improvement_summary(compared), "tasks": results.task_summary(done), "best": results.best_per_task(long), "inventory": results.inventory(long),
        "success": results.success(rows), "duration": results.duration_hours(rows),
    }
