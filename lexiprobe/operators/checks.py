"""Data quality: each check returns the rows that violate it, so an empty frame is a pass."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import LANGUAGES, MODELS, SPLITS
from .projection import compatible

BOUNDED = ("accuracy", "precision", "recall", "f1")


def _violations(df: DataFrame, key: Sequence[str], rules: dict) -> DataFrame:
    """(key, check) for each rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]))
    return df.select(*key, F.explode(broken).alias("check"))


def metric_ranges(long: DataFrame, key: Sequence[str] = ("language", "task", "model", "metric")) -> DataFrame:
    """Metrics that are missing, not finite or out of range ([0, 1], mse >= 0, r2 <= 1)."""
    m, v = F.col("metric"), F.col("value")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    return _violations(long, key, {
        "missing": v.isNull(), "not finite": ~finite, "outside 0..1": finite & m.isin(*BOUNDED) & ~v.between(0, 1), "negative mse": finite & (m == "mse") & (v < 0), "r2 above 1": finite & (m == "r2") & (v > 1),
    })


def label_domain(df: DataFrame, label: str, task_type: str, key: str = "doc_id") -> DataFrame:
    """Labels that are null, or not 0 / 1 (classification), or not finite (regression)."""
    v = F.col(label).cast("double")
    bad = ~v.isin(0.0, 1.0) if task_type == "classification" else F.isnan(v) | (F.abs(v) == float("inf"))
    return _violations(df, [key], {"null label": v.isNull(), "outside domain": bad})


def unmatched(features: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys on one side only."""
    a = features.select(key).distinct().withColumn("f", F.lit(True))
    b = labels.select(key).distinct().withColumn("l", F.lit(True))
    return a.join(b, key, "full").where("f IS NULL OR l IS NULL").select(key, F.when(F.col("f").isNull(), "no features").otherwise("no label").alias("check"))


def missing_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing): nulls and NaN, of columns that have any."""
    gone = [F.count_if(F.col(c).isNull() | (F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))).alias(c) for c in columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("p")
    return df.agg(*gone).select(pairs).select("p.column", "p.missing").where("missing > 0")


def out_of_range(df: DataFrame, column: str, least: float, most: float, key: str = "doc_id") -> DataFrame:
    return df.where(~F.col(column).between(least, most)).select(key, column)


def probability_sums(df: DataFrame, columns: Sequence[str], key: str = "doc_id", tolerance: float = 1e-6) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return df.where(F.abs(total - 1) > tolerance).select(key, total.alias("total"))


def required_fields(df: DataFrame, fields: Sequence[str]) -> list[str]:
    """Fields that the schema lacks."""
    return [f for f in fields if f not in df.columns]


def unequal_lengths(df: DataFrame, columns: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Rows whose array columns differ in length."""
    first = F.size(columns[0])
    return df.where(reduce(lambda a, b: a | b, [F.size(c) != first for c in columns[1:]])).select(key, *[F.size(c).alias(c) for c in columns])


def sparsity(vectors: DataFrame, n_features: int, least: float = 0.0, most: float = 1.0) -> DataFrame:
    """Splits whose sparsity is outside the range, or that hold no entries."""
    s = vectors.groupBy("split").agg(F.countDistinct("doc_id").alias("n"), F.count("*").alias("nnz")).withColumn("sparsity", 1 - F.col("nnz") / (F.col("n") * n_features))
    return s.where(~F.col("sparsity").between(least, most)).select("split", "sparsity")


def missing_splits(vectors: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    wanted = vectors.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return wanted.join(vectors.select("split").distinct(), "split", "left_anti")


def foreign_terms(vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Term ids of any split that the vocabulary lacks."""
    return vectors.select("split", "term_id").distinct().join(vocabulary.select("term_id"), "term_id", "left_anti")


def coverage(found: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Expected values that do not occur."""
    wanted = found.sparkSession.createDataFrame([(column, v) for v in expected], "dimension string, value string")
    return wanted.join(found.select(F.col(column).alias("value")).distinct(), "value", "left_anti").select("dimension", "value")


def grid_coverage(completed: DataFrame) -> DataFrame:
    """Languages, tasks and models of the grid without a completed experiment."""
    out = coverage(completed, "language", LANGUAGES).unionByName(coverage(completed, "model_type", MODELS))
    return out.unionByName(coverage(completed, "task", ("question_type", "complexity")))


#: (task type, model, metric, whether it is a lower bound, bound) that main experiments must keep.
BASELINES = (("classification", "dummy", "accuracy", False, 0.6), ("classification", "logistic", "accuracy", True, 0.5), ("regression", "dummy", "r2", False, 0.1), ("regression", "ridge", "r2", True, 0.0))


def baselines(completed: DataFrame) -> DataFrame:
    """Per bound: the extreme main value, whether it keeps the bound (null without experiments)."""
    main = completed.where("experiment_type = 'main'")
    rows = []
    for kind, model, metric, lower, bound in BASELINES:
        v = F.col(f"test_{metric}")
        extreme = F.min(v) if lower else F.max(v)
        one = main.where((F.col("task_type") == kind) & (F.col("model_type") == model)).agg(extreme.alias("value"))
        rows.append(one.select(F.lit(kind).alias("task_type"), F.lit(model).alias("model_type"), F.lit(metric).alias("metric"), "value", (F.col("value") >= bound if lower else F.col("value") <= bound).alias("ok")))
    return reduce(DataFrame.unionByName, rows)


def incompatible(results: DataFrame) -> DataFrame:
    return results.where(~compatible(F.col("model_type"), F.col("task_type")))


def dataset_integrity(dataset: DataFrame, columns: Sequence[str], languages: Sequence[str] = LANGUAGES) -> dict[str, bool]:
    """Whether all splits, columns and languages are there; errors are raised, never taken for a pass."""
    there = set(dataset.columns)
    found = dataset.agg(F.collect_set("split").alias("s"), F.collect_set("language").alias("l")).first()
    return {"splits": set(SPLITS) <= set(found["s"]), "columns": set(columns) <= there, "languages": set(languages) <= set(found["l"])}


def unsupported_languages(df: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    return df.select("language").distinct().where(F.col("language").isNull() | ~F.col("language").isin(*languages))


def disagreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that only one of two interfaces gives."""
    return one.exceptAll(other).withColumn("side", F.lit("first")).unionByName(other.exceptAll(one).withColumn("side", F.lit("second")))


def missing_files(paths: Sequence[str]) -> list[str]:
    return [p for p in paths if not Path(p).exists()]


def json_problems(path: str, required: Sequence[str]) -> list[str]:
    """What is wrong with a JSON file: unreadable, or keys that lack."""
    try:
        got = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        return [f"unreadable: {e}"]
    return [f"no key {k}" for k in required if not isinstance(got, dict) or k not in got]


def positive_definite(matrix: Sequence[Sequence[float]], tolerance: float = 1e-10) -> bool:
    a = np.asarray(matrix, dtype=float)
    return bool(a.ndim == 2 and a.shape[0] == a.shape[1] and np.allclose(a, a.T) and np.linalg.eigvalsh(a).min() > -tolerance)


def within(measured: float, limit: float) -> bool:
    """Whether a measured time or memory is a number at most the limit."""
    return math.isfinite(measured) and 0 <= measured <= limit
