"""Filters and projections of rows, labels and result columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FEATURES, LANGUAGE_CODES, TASK_COLUMNS

DISPLAY_NAMES = {"ar": "Arabic", "en": "English", "fi": "Finnish", "id": "Indonesian", "ja": "Japanese", "ko": "Korean", "ru": "Russian"}


def in_languages(df: DataFrame, languages: Sequence[str], column: str = "language") -> DataFrame:
    """Rows of these languages, whatever their case; ["all"] keeps every row."""
    return df if list(languages) == ["all"] else df.where(F.lower(column).isin([x.lower() for x in languages]))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The same frame; raises if it has no row."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def token_range(df: DataFrame, least: int = 4, most: int = 100, column: str = "n_tokens") -> DataFrame:
    return df.where(F.col(column).between(least, most))


def language_code(language: Column) -> Column:
    """Code of a full language name; anything else passes through."""
    out = F.lit(None).cast("string")
    for name, code in LANGUAGE_CODES.items():
        out = F.when(F.lower(language) == name, code).otherwise(out)
    return F.coalesce(out, language)


def display_name(code: Column) -> Column:
    out = code
    for key, name in DISPLAY_NAMES.items():
        out = F.when(code == key, name).otherwise(out)
    return out


def encoded_type(kind: Column) -> Column:
    """polar: 1, content: 0, anything else null."""
    return F.when(kind == "polar", 1).when(kind == "content", 0)


def resolve_target(task: str, submetric: str | None = None) -> str:
    """The label column of a task; single_submetric needs a submetric."""
    name = submetric if task == "single_submetric" or submetric else task
    if name not in TASK_COLUMNS:
        raise ValueError(f"unknown task {task!r} / submetric {submetric!r}; known: {', '.join(TASK_COLUMNS)}")
    return TASK_COLUMNS[name]


def task_type(task: str, override: str | None = None) -> str:
    """classification or regression; a task without a type of its own counts as classification."""
    if override in ("classification", "regression"):
        return override
    return "regression" if task in ("complexity", "single_submetric", *FEATURES) else "classification"


def with_label(df: DataFrame, task: str, submetric: str | None = None) -> DataFrame:
    """Adds ``label``: null becomes 0; an int for classification, else a double."""
    column = resolve_target(task, submetric)
    if column not in df.columns:
        raise ValueError(f"no column {column!r}; there are {', '.join(df.columns)}")
    value = F.coalesce(F.col(column), F.lit(0))
    return df.withColumn("label", value.cast("int") if task_type(task) == "classification" else F.nanvl(value.cast("double"), F.lit(0.0)))


def included(classified: DataFrame) -> DataFrame:
    """The three columns of what is kept for training."""
    return classified.where(F.col("included") & F.col("final_class").isNotNull()).select("question_text", "language", "final_class")


def contains(column: Column, text: str) -> Column:
    """Whether the text is in the column; null: no."""
    return F.coalesce(F.contains(column, F.lit(text)), F.lit(False))


def control_of(experiment_type: Column) -> Column:
    """The label that a control shuffles, from control_<label>_seed<n>; null if it is none."""
    return F.nullif(F.regexp_extract(experiment_type, r"control_(.+)_seed\d+", 1), F.lit(""))


def layer_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"layer_(\d+)", 1), F.lit("")).cast("int")


def compatible(model: Column, kind: Column) -> Column:
    """logistic only classifies, ridge only regresses."""
    return ~((model == "logistic") & (kind != "classification")) & ~((model == "ridge") & (kind != "regression"))


def primary_metric(kind: Column, accuracy: Column, mse: Column) -> Column:
    return F.when(kind == "classification", accuracy).otherwise(mse)


def aligned(features: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Features with labels by key: what has no partner is left out, as truncation would."""
    return features.join(labels, key)
