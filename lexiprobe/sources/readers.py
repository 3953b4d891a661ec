"""Readers and writers of the file layouts. Every reader states its schema; none infers one."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import COMPLEXITY, DATASET, FEATURES, IMPORTANCE, QUESTION, RESULT, RESULT_LONG, TRACKER, VECTORS, VOCABULARY, dataset_configs, extended
from .shared import ship

SPLIT_ALIASES = {"val": "validation", "dev": "validation"}


def complexity_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files named <language>_<type>.csv; columns language and type win over the name.

    Files that need such a name and lack it, and files without n_tokens, are left out. Columns are taken
    by name from each file's header. Adds ``source_file``.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    out = None
    # One header a file: files are grouped by it, so each group is one scan.
    heads = spark.read.option("wholetext", "false").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").text(path)
    first = heads.select("_metadata.file_path", "value", F.monotonically_increasing_id().alias("at")).groupBy("file_path").agg(F.min_by("value", "at").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in first.collect():  # a row a file
        groups.setdefault(row["header"], []).append(row["file_path"])
    for header, paths in sorted(groups.items()):
        columns = [c.strip() for c in header.split(",")]
        if "n_tokens" not in columns:
            continue
        schema = ", ".join(f"`{c}` {'DOUBLE' if c in FEATURES else 'STRING'}" for c in columns)
        raw = spark.read.option("header", "true").schema(schema).csv(sorted(paths))
        stem = F.split(name, "_")
        rows = raw.select("*", name.alias("source_file"), F.get(stem, F.lit(0)).alias("__l"), F.get(stem, F.lit(1)).alias("__t"))
        if not {"language", "type"} <= set(columns):
            rows = rows.where("__t IS NOT NULL")
        pick = lambda c, d, there=frozenset(columns): F.coalesce(F.col(c), F.col(d)) if c in there else F.col(d)
        one = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in FEATURES], pick("language", "__l").alias("language"), pick("type", "__t").alias("type"), "source_file")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], extended(COMPLEXITY, source_file=T.StringType()))


#: White space that may stand alone on the line that ends a sentence.
_BLANK = r"(?U)^[\s\x1c-\x1f\x85]*$"


def conllu(spark: SparkSession, path: str, glob: str = "*.conllu") -> DataFrame:
    """Sentences (file, sent_ix, text, lines) of all files below ``path`` that ``glob`` names.

    A sentence ends at a line without anything but white space, or at the end of the file; lines end
    at any of the three line breaks. Its text is in the comment "text" or "sent". ``sent_ix`` orders
    the sentences of a file without being dense.

    Files are split as any text, so a sentence may reach over several blocks. A task puts together the
    lines of its blocks' sentences; only pieces at a block's ends are moved, to be joined. Blank lines
    are counted by block, and the blocks' sums give each sentence its number in the file.
    """
    ship(spark)
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.col("value").rlike(_BLANK).alias("blank"))
    blocks = lines.groupBy("file", "block").agg(F.sum(F.col("blank").cast("long")).alias("n"))  # a row a block
    upto = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.select("file", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    # Blocks are as many as the scan's splits, all of which the driver lists.
    numbered = lambda edges: lines.mapInArrow(partial(_pieces, edges=edges), "file string, block long, sent long, lines array<string>").join(F.broadcast(before), ["file", "block"]).select("file", "block", (F.col("sent") + F.col("before")).alias("sent_ix"), "lines")
    joined = numbered(True).groupBy("file", "sent_ix").agg(F.array_sort(F.collect_list(F.struct("block", "lines"))).alias("l"))
    joined = joined.select("file", "sent_ix", F.flatten(F.transform("l", lambda x: x["lines"])).alias("lines"))
    sentences = numbered(False).drop("block").unionByName(joined)
    text = F.nullif(F.array_join(F.slice(F.filter(F.transform("lines", lambda v: F.regexp_extract(v, r"(?d)^# (?:text|sent) = (.+)$", 1)), lambda v: v != ""), -1, 1), ""), F.lit(""))
    return sentences.select("file", "sent_ix", text.alias("text"), "lines")


def _pieces(batches: Iterator[pa.RecordBatch], edges: bool) -> Iterator[pa.RecordBatch]:
    """(file, block, sent, lines): the runs of lines without blank ones, ``sent`` blank lines after the start of their
    block. ``edges``: the first and last runs of blocks, which may go on in another block; else all others."""
    at, sent, held = None, 0, []  # the block, blank lines so far, and lines of its last run so far

    def pieces(sents: np.ndarray, sizes: np.ndarray, values: pa.Array) -> pa.RecordBatch:
        n = len(sents)
        runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * n), pa.array([at[1]] * n), pa.array(sents), runs], names=["file", "block", "sent", "lines"])

    def one() -> pa.RecordBatch:
        values = pa.concat_arrays(held)
        return pieces(np.array([sent]), np.array([len(values)]), values)

    for batch in batches:
        file, block, value, blank = batch.columns
        value = value.cast(pa.string())
        code, start = file.dictionary_encode(), block.to_numpy()
        number, blank = code.indices.to_numpy(), blank.to_numpy(zero_copy_only=False)
        turns = np.flatnonzero((np.diff(number) != 0) | (np.diff(start) != 0)) + 1
        for low, high in zip([0, *turns.tolist()], [*turns.tolist(), len(start)]):  # rows of one block
            if low == high:
                continue
            name = (code.dictionary[int(number[low])].as_py(), int(start[low]))
            if name != at:
                if held and edges:
                    yield one()
                at, sent, held = name, 0, []
            ends = low + np.flatnonzero(blank[low:high])
            if not len(ends):
                held.append(value.slice(low, high - low))
                continue
            if ends[0] > low:
                held.append(value.slice(low, ends[0] - low))
            if held and edges == (sent == 0):
                yield one()
            first, size = ends[:-1] + 1, np.diff(ends) - 1  # runs between blank lines
            some = np.flatnonzero(size)
            if len(some) and not edges:
                inside = _inside(first[some] - low, size[some], high - low)
                yield pieces(sent + 1 + some, size[some], value.slice(low, high - low).filter(pa.array(inside)))
            sent += len(ends)
            held = [value.slice(ends[-1] + 1, high - ends[-1] - 1)] if ends[-1] + 1 < high else []
    if held and edges:
        yield one()


def _inside(first: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which of n rows are in the runs."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + size, -1)
    return np.cumsum(step[:n]) > 0


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Corpus questions as Parquet (``schemas.QUESTION``)."""
    return spark.read.schema(QUESTION).parquet(path)


def cache_table(df: DataFrame, path: str) -> DataFrame:
    """``df`` through a Parquet cache: written once, later calls read the files."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dataset(spark: SparkSession, path: str, config: str = "base", split: str | None = None) -> DataFrame:
    """One configuration (and split) of the dataset; both are partition columns, so others aren't read."""
    if config not in dataset_configs():
        raise ValueError(f"unknown configuration {config!r}")
    rows = spark.read.schema(extended(DATASET, config=T.StringType(), split=T.StringType())).parquet(path).where(F.col("config") == config)
    return rows if split is None else rows.where(F.col("split") == SPLIT_ALIASES.get(split, split))


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("config", "split").parquet(path)


def missing_partitions(spark: SparkSession, path: str, splits: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """Configurations and splits that the dataset lacks."""
    wanted = spark.createDataFrame([(c, s) for c in dataset_configs() for s in splits], "config string, split string")
    return wanted.join(spark.read.parquet(path).select("config", "split").distinct(), ["config", "split"], "left_anti")


def write_features(vectors: DataFrame, vocabulary: DataFrame, path: str) -> None:
    """The feature store: vectors by split, vocabulary, and one row of metadata."""
    vectors.write.mode("overwrite").partitionBy("split").parquet(f"{path}/vectors")
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    vocabulary.agg(F.count("*").alias("n_features"), F.sha2(F.array_join(F.sort_array(F.collect_list("term")), "\n"), 256).alias("vocabulary_sha256")).write.mode("overwrite").json(f"{path}/metadata")


def features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Vectors of one split (val and dev mean validation) or of all."""
    rows = spark.read.schema(VECTORS).parquet(f"{path}/vectors")
    return rows if split is None else rows.where(F.col("split") == SPLIT_ALIASES.get(split, split))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCABULARY).parquet(f"{path}/vocabulary")


def result_json(spark: SparkSession, path: str) -> DataFrame:
    """Result documents, one JSON object a line or a file; what can't be parsed is left out.

    A file with a document on any of its lines is read by lines, any other one as a single document.
    """
    files = spark.read.schema(extended(RESULT, _corrupt=T.StringType())).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    at = F.col("_metadata.file_path").alias("__file")
    good = lambda df: df.select(*RESULT.names, at).where("experiment_id IS NOT NULL")
    lines, whole = good(files.json(path)), good(files.option("multiLine", "true").json(path))
    return lines.unionByName(whole.join(lines.select("__file").distinct(), "__file", "left_anti")).drop("__file")


def write_results(results: DataFrame, path: str) -> None:
    """Commits result documents as one further batch below ``path``; its documents replace those of equal ids."""
    results.write.mode("error").json(f"{path}/batch={time.time_ns():020d}")


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store: of each id the one committed last. A store without batches has none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], RESULT)
    rows = spark.read.schema(extended(RESULT, batch=T.StringType())).option("basePath", path).json(path).where("experiment_id IS NOT NULL")
    last = rows.groupBy("experiment_id").agg(F.max_by(F.struct(*RESULT.names), F.struct("batch", "timestamp")).alias("d"))
    return last.select("d.*")


def results_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Long result tables, each path once; values that are no numbers are dropped."""
    text = spark.read.option("header", "true").schema("experiment_type STRING, language STRING, task STRING, model STRING, metric STRING, value STRING").csv(sorted(set(paths)))
    return text.withColumn("value", F.col("value").try_cast("double")).where("value IS NOT NULL").select(*RESULT_LONG.names)


def collected_results(spark: SparkSession, path: str) -> DataFrame:
    """Long results of all runs below ``path``: its tfidf_results.csv files, or else its results.json files.

    The folders .../<task>/<model>/<language>/... name what a JSON file is about; the task is
    question_type or complexity. Files elsewhere, and metrics that are null or no numbers, are left out.
    """
    tree = spark.read.option("recursiveFileLookup", "true")
    tables = tree.option("pathGlobFilter", "tfidf_results.csv").text(path)
    if not tables.isEmpty():
        return results_csv(spark, [r["f"] for r in tables.select(F.col("_metadata.file_path").alias("f")).distinct().collect()])  # a row a run
    files = tree.schema("test_metrics MAP<STRING, STRING>").option("multiLine", "true").option("pathGlobFilter", "results.json").json(path)
    part = lambda k: F.regexp_extract(F.col("_metadata.file_path"), r"/(question_type|complexity)/([^/]+)/([^/]+)/(?:.*/)?results\.json$", k)
    rows = files.select(F.lit("tfidf").alias("experiment_type"), part(3).alias("language"), part(1).alias("task"), part(2).alias("model"), F.explode("test_metrics").alias("metric", "value"))
    rows = rows.withColumn("value", F.col("value").try_cast("double"))
    return rows.where("task != '' AND metric != 'primary_metric' AND value IS NOT NULL").select(*RESULT_LONG.names)


def probe_tracker(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Probe results (``schemas.TRACKER``), each path once; textual metrics are dropped."""
    rows = spark.read.option("header", "true").schema(TRACKER).csv(sorted(set(paths)))
    rows = rows.withColumn("value", F.col("value").try_cast("double")).where("value IS NOT NULL")
    return rows.withColumn("is_control", F.coalesce(F.contains("experiment_type", F.lit("control")) | (F.col("control_index").try_cast("int") > 0), F.lit(False))).withColumnRenamed("layer_index", "layer")


def append_tracker(rows: DataFrame, path: str) -> None:
    """Appends one row per non-null metric."""
    rows.where("value IS NOT NULL").select(*TRACKER.names).write.mode("append").option("header", "true").csv(path)


def importance_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IMPORTANCE).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path).where("model_type IS NOT NULL")


def write_class_text(classified: DataFrame, path: str) -> None:
    """One trimmed question a line, by language and class."""
    classified.where("final_class IS NOT NULL").select("language", "final_class", F.trim("question_text").alias("value")).write.mode("append").partitionBy("language", "final_class").text(path)


def write_conllu(sentences: DataFrame, path: str, by: Sequence[str] = ("language", "bucket")) -> None:
    """Appends sentences in their format, by language and bucket."""
    sentences.select(*by, F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("value")).write.mode("append").partitionBy(*by).option("lineSep", "\n").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def synthetic_features(spark: SparkSession, n: int = 100, vocabulary_size: int = 200, sparsity: float = 0.9, seed: int = 42, ids: DataFrame | None = None) -> DataFrame:
    """(split, doc_id, term_id, tfidf): 70 / 15 / 15 per cent of the documents, log-normal weights,
    at least one term a document; the same for equal arguments. The documents are 0 to n - 1, or those
    of ``ids`` (doc_id), which are then taken to run to about n."""
    u = lambda k: (F.pmod(F.xxhash64("doc_id", "term_id", F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    documents = spark.range(n).withColumnRenamed("id", "doc_id") if ids is None else ids.select("doc_id")
    cells = documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(vocabulary_size - 1))).alias("term_id"))
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(2))
    own = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(vocabulary_size)) == F.col("term_id")
    split = F.when(F.col("doc_id") < int(n * 0.7), "train").when(F.col("doc_id") < int(n * 0.7) + int(n * 0.15), "validation").otherwise("test")
    return cells.where((u(0) >= sparsity) | own).select(split.alias("split"), "doc_id", "term_id", F.exp(normal - 1).alias("tfidf"))


def mock_dataset(spark: SparkSession, n: int = 100, ids: DataFrame | None = None) -> DataFrame:
    """Deterministic labels of ``ids`` (doc_id) or of 0 to n - 1: question_type i % 2, score 0.1 + (i % 10) / 10,
    submetrics around it in [0, 1]."""
    i = F.col("id")
    score = 0.1 + (i % 10) * 0.1
    sub = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + (k - 2) * 0.05)).alias(f) for k, f in enumerate(FEATURES)]
    rows = spark.range(n) if ids is None else ids.select(F.col("doc_id").alias("id"))
    return rows.select(i.alias("doc_id"), F.concat(F.lit("text "), i.cast("string")).alias("text"), F.lit("en").alias("language"), (i % 2).cast("int").alias("question_type"), score.alias("complexity_score"), *sub)


def complexity_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line, reason): what ``complexity_csv`` leaves out or can't read, so that its rows and these are all lines.

    Reasons of whole files (a row for each of their lines): ``no n_tokens``, ``name without language and
    type``. Of rows, which are loaded with a null in place: ``n_tokens is no number``. Headers are no lines.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    lines = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), name.alias("source_file"), "value", F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"), F.min("at").alias("first"))  # a row a file
    columns = F.transform(F.split("header", ","), lambda c: F.trim(c))
    place = F.array_position(columns, "n_tokens")
    rows = lines.join(heads, "file").where("at > first").select("source_file", F.col("value").alias("line"), columns.alias("columns"), place.alias("place"))
    named = F.array_contains("columns", "language") & F.array_contains("columns", "type")
    value = F.trim(F.get(F.split("line", ","), (F.col("place") - 1).cast("int")))
    reason = F.when(F.col("place") == 0, "no n_tokens").when(~named & (F.size(F.split("source_file", "_")) < 2), "name without language and type").when((F.coalesce(value, F.lit("")) != "") & value.try_cast("double").isNull(), "n_tokens is no number")
    return rows.select("source_file", "line", reason.alias("reason")).where("reason IS NOT NULL")


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """(language, type, reason, n): rows loaded (reason is null) and refused, by language and type or, of refused ones, by file name."""
    loaded = complexity_csv(spark, path).groupBy("language", "type").agg(F.count("*").alias("n")).select("language", "type", F.lit(None).cast("string").alias("reason"), "n")
    stem = F.split("source_file", "_")
    refused = complexity_rejects(spark, path).groupBy(F.get(stem, F.lit(0)).alias("language"), F.get(stem, F.lit(1)).alias("type"), "reason").agg(F.count("*").alias("n"))
    return loaded.unionByName(refused)
