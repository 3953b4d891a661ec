"""Result documents: standardisation, comparison with controls, summaries, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall", "f1", "mse", "r2")
PARTS = ("train", "val", "test")
KEYS = ("task", "model_type", "language", "task_type")


def _or(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def standardized(results: DataFrame) -> DataFrame:
    """Nested result documents (``schemas.RESULT``) as flat rows.

    Language, task and types are taken from the document, else from its configuration; the class of
    the estimator and the configured model keep columns of their own. Metrics become
    <part>_<metric>; NaN becomes null; the name of the primary metric is left out. A document
    without test metrics stays, with nulls.
    """
    text = F.lower(F.coalesce(F.to_json("config"), F.lit("")))
    seed = F.nullif(F.regexp_extract(F.to_json("config"), r"(?i)seed(\d+)", 1), F.lit("")).cast("int")
    numbers = [F.when(~F.isnan(f"{p}_metrics.{m}"), F.col(f"{p}_metrics.{m}")).alias(f"{p}_{m}") for p in PARTS for m in ("primary_value", *METRICS)]
    shape = lambda p: F.when(F.size(f"data_shapes.{p}") > 0, F.get(F.col(f"data_shapes.{p}"), 0))
    return results.select(
        F.coalesce("experiment_id", F.lit("unknown")).alias("experiment_id"), F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.coalesce("status", F.lit("unknown")).alias("status"), "error",
        _or(F.col("language"), F.col("config.language")).alias("language"), _or(F.col("task"), F.col("config.task")).alias("task"),
        _or(F.col("model"), F.col("model_type"), F.col("config.model_type")).alias("model_type"), F.col("config.model_type").alias("config_model"),
        _or(F.col("model_type"), F.col("model_class")).alias("model_class"), _or(F.col("task_type"), F.col("config.task_type")).alias("task_type"),
        _or(F.col("config.config"), F.col("config.dataset_config")).alias("dataset_config"), F.when(F.contains(text, F.lit("control")), "control").otherwise("main").alias("experiment_type"),
        seed.alias("control_seed"), F.coalesce("train_time", F.lit(0.0)).alias("train_time"), *numbers,
        *[F.coalesce(shape(p), F.col(f"{p}_info.samples")).alias(f"{p}_samples") for p in PARTS],
    )


def numeric_metrics(metrics: Column) -> Column:
    """A map of metrics without null and NaN values."""
    return F.map_filter(metrics, lambda k, v: v.isNotNull() & ~F.isnan(v))


def long_form(standard: DataFrame, part: str = "test", metrics: Sequence[str] = METRICS) -> DataFrame:
    """(experiment_type, language, task, model, metric, value) of what is not null."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{part}_{m}").alias("value")) for m in metrics])).alias("m")
    return standard.select("experiment_type", "language", "task", F.col("model_type").alias("model"), pairs).select("experiment_type", "language", "task", "model", "m.metric", "m.value").where("value IS NOT NULL")


def control_average(completed: DataFrame, parts: Sequence[str] = PARTS, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean of each metric over the controls of a task, model and language."""
    return completed.where("experiment_type = 'control'").groupBy(*KEYS).agg(*[F.avg(f"{p}_{m}").alias(f"{p}_{m}") for p in parts for m in metrics])


def main_vs_control(completed: DataFrame, metrics: Sequence[str] = ("accuracy", "f1", "mse", "r2")) -> DataFrame:
    """Main experiments beside the mean of their controls: difference, and improvement (positive is better)."""
    main = completed.where("experiment_type = 'main'").select(*KEYS, *[F.col(f"test_{m}").alias(f"test_{m}_main") for m in metrics])
    control = control_average(completed, ("test",), metrics).select(*KEYS, *[F.col(f"test_{m}").alias(f"test_{m}_control") for m in metrics])
    out = main.join(control, list(KEYS))
    for m in metrics:
        diff = F.col(f"test_{m}_main") - F.col(f"test_{m}_control")
        out = out.withColumn(f"test_{m}_diff", diff).withColumn(f"test_{m}_improvement", -diff if m == "mse" else diff)
    return out


def selectivity(compared: DataFrame, metric: str) -> DataFrame:
    """Improvement over the control, absolute and as a share of it (null where the control is 0)."""
    gain, control = F.col(f"test_{metric}_improvement"), F.col(f"test_{metric}_control")
    return compared.where(gain.isNotNull()).select(*KEYS, F.col(f"test_{metric}_main").alias("main"), control.alias("control"), gain.alias("delta"), F.when(control != 0, gain / control).alias("selectivity"))


def summary(completed: DataFrame, by: Sequence[str], metrics: Sequence[str] = ("accuracy", "f1", "mse", "r2")) -> DataFrame:
    """mean, std (n - 1; null for one row) and count of test metrics."""
    aggs = [f(f"test_{m}").alias(f"test_{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))]
    return completed.groupBy(*by).agg(*aggs)


def by_task_language(completed: DataFrame, **how) -> DataFrame:
    return summary(completed, ("task", "language", "experiment_type"), **how)


def by_model_type(completed: DataFrame, **how) -> DataFrame:
    return summary(completed, ("model_type", "task_type", "experiment_type"), **how)


def model_means(completed: DataFrame) -> DataFrame:
    """Means of four test metrics and of the training time by model, task and experiment type."""
    return completed.groupBy("model_type", "task", "experiment_type").agg(*[F.avg(f"test_{m}").alias(m) for m in ("accuracy", "f1", "mse", "r2")], F.avg("train_time").alias("train_time"))


def pivoted(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    """Means with one column a value; the values are stated, so no pass finds them."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.avg(value))


def unique_pivot(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    """As ``pivoted`` for one value a cell; raises if a cell has several."""
    if not df.groupBy(*rows, column).count().where("count > 1").isEmpty():
        raise ValueError(f"several values for one {column} of {', '.join(rows)}")
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.first(value, ignorenulls=True))


def frequencies(results: DataFrame, columns: Sequence[str] = ("status", "task", "model_type", "language")) -> DataFrame:
    """(dimension, value, n) of every column, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return results.select(pairs).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


ERRORS = (("memory", "memory"), ("timeout", "timeout"), ("shape", "shape"), ("import", "import"))


def error_category(error: Column) -> Column:
    """The first of memory, timeout, shape and import that the message names, else other; null stays."""
    low = F.lower(error)
    out = None
    for word, name in ERRORS:
        out = F.when(F.contains(low, F.lit(word)), name) if out is None else out.when(F.contains(low, F.lit(word)), name)
    return out.when(error.isNotNull(), "other")


def improvement_summary(compared: DataFrame, metrics: Sequence[str] = ("accuracy", "f1", "mse", "r2")) -> DataFrame:
    """Of each metric's improvements: best, worst, mean, std, how many are positive or negative, n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"test_{m}_improvement").alias("v")) for m in metrics])).alias("p")
    v = F.col("v")
    return compared.select(pairs).select("p.metric", "p.v").where(v.isNotNull()).groupBy("metric").agg(
        F.max(v).alias("best"), F.min(v).alias("worst"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"), F.count(v).alias("n")
    )


def task_summary(completed: DataFrame) -> DataFrame:
    return completed.groupBy("task").agg(
        F.count("*").alias("n"), F.avg("test_accuracy").alias("accuracy_mean"), F.stddev_samp("test_accuracy").alias("accuracy_std"), F.max("test_accuracy").alias("accuracy_best"),
        F.avg("test_mse").alias("mse_mean"), F.stddev_samp("test_mse").alias("mse_std"), F.min("test_mse").alias("mse_best"),
    )


def five_numbers(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Least, quartiles and largest of a value: what a box plot shows."""
    p = F.percentile(F.col(value), [0.0, 0.25, 0.5, 0.75, 1.0])
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(p.alias("p"), F.count("*").alias("n")).select(*by, *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))], "n")


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, n) over equal widths from the least to the largest value; the last bin is closed."""
    kept = df.where(F.col(value).isNotNull())
    edge = kept.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row
    x = F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    place = F.when(F.col("hi") > F.col("lo"), F.least(x, F.lit(bins - 1))).otherwise(0)
    return kept.crossJoin(F.broadcast(edge)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def best_per(df: DataFrame, by: Sequence[str], value: str, smallest: bool, ties: Sequence[str | Column]) -> DataFrame:
    """The row of best value of each group; ties fall to the first by ``ties``."""
    order = F.col(value).asc() if smallest else F.col(value).desc()
    return df.where(F.col(value).isNotNull()).withColumn("__at", F.row_number().over(W.partitionBy(*by).orderBy(order, *ties))).where("__at = 1").drop("__at")


def best_per_task(long: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    """Best accuracy of classification and best mse of regression: (task, metric, value, model, language).

    Ties fall to the first by language, model and layer, and to main experiments before controls."""
    fits = ((F.col("task") == "question_type") & (F.col("metric") == "accuracy")) | ((F.col("task") != "question_type") & (F.col("metric") == "mse"))
    merit = F.when(F.col("metric") == "mse", -F.col("value")).otherwise(F.col("value"))
    return best_per(long.where(fits).withColumn("__m", merit), by, "__m", False, [*(c for c in ("language", "model", "layer") if c in long.columns), *(F.desc(c) for c in ("experiment_type",) if c in long.columns)]).drop("__m")


def features_vs_probes(features: DataFrame, probes: DataFrame) -> DataFrame:
    """The best feature model beside the best probe of each language and task."""
    a = best_per_task(features, ("language", "task")).select("language", "task", "metric", F.col("value").alias("features_value"), F.col("model").alias("features_model"))
    b = best_per_task(probes, ("language", "task")).select("language", "task", F.col("value").alias("probe_value"), F.col("layer").alias("probe_layer"))
    return a.join(b, ["language", "task"])


def top_importances(docs: DataFrame, vocabulary: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Ranked features of each importance document (``schemas.IMPORTANCE``).

    Dummy models and documents without importances are left out; a feature without a name is
    feature_<index>. Ties in absolute importance fall to the smaller index.
    """
    key = ["task", "task_type", "language", "model_type"]
    rows = docs.where(~F.lower("model_type").startswith("dummy") & (F.size("feature_importance") > 0)).select(*key, F.posexplode("feature_importance").alias("ix", "importance"))
    rows = rows.withColumn("abs_importance", F.abs("importance")).withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("abs_importance"), "ix"))).where(F.col("rank") <= k)
    if vocabulary is not None:
        rows = rows.join(vocabulary.select(F.col("term_id").alias("ix"), F.col("term").alias("__name")), "ix", "left")
    else:
        rows = rows.withColumn("__name", F.lit(None).cast("string"))
    return rows.select("rank", *key, F.coalesce("__name", F.concat(F.lit("feature_"), F.col("ix").cast("string"))).alias("feature_name"), "importance", "abs_importance")


def importance_summary(top: DataFrame, k: int = 10) -> DataFrame:
    """By task type, the k features of largest mean absolute importance, rounded to 4 digits."""
    s = top.groupBy("task_type", "feature_name").agg(
        F.bround(F.avg("abs_importance"), 4).alias("avg_abs_importance"), F.bround(F.stddev_samp("abs_importance"), 4).alias("std_abs_importance"), F.count("*").alias("frequency"), F.bround(F.avg("importance"), 4).alias("avg_importance")
    )
    place = F.row_number().over(W.partitionBy("task_type").orderBy(F.desc("avg_abs_importance"), "feature_name"))
    return s.withColumn("rank", place).where(F.col("rank") <= k)


def inventory(long: DataFrame) -> DataFrame:
    """One row: distinct languages, models, tasks, metrics, sorted; rows in all."""
    distinct = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",").alias(c + "s")
    return long.agg(F.count("*").alias("total"), *[distinct(c) for c in ("language", "model", "task", "metric")])


def importance_inventory(top: DataFrame) -> DataFrame:
    distinct = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",").alias(c + "s")
    return top.agg(F.count_if(F.col("task_type") == "classification").alias("classification_rows"), F.count_if(F.col("task_type") == "regression").alias("regression_rows"), *[distinct(c) for c in ("task", "language", "model_type")])


def success(results: DataFrame) -> DataFrame:
    """One row: total, completed, failed, success_rate (0 of nothing is 0)."""
    c = F.count_if(F.col("status") == "completed")
    return results.agg(F.count("*").alias("total"), c.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), (c / F.greatest(F.lit(1), F.count("*"))).alias("success_rate"))


def duration_hours(results: DataFrame) -> DataFrame:
    """One row: hours from the first to the last timestamp (ISO text; unreadable ones are passed over)."""
    t = F.try_to_timestamp("timestamp")
    return results.agg(((F.unix_micros(F.max(t)) - F.unix_micros(F.min(t))) / F.lit(3.6e9)).alias("duration_hours"))


def patience_trace(history: DataFrame, by: Sequence[str], patience: int = 3, least_gain: float = 0.0) -> DataFrame:
    """Per epoch of each run: best validation loss so far, whether it improved, epochs since, and
    whether training would have stopped. ``history``: by, epoch, val_loss."""
    w = W.partitionBy(*by).orderBy("epoch")
    before = F.min("val_loss").over(w.rowsBetween(W.unboundedPreceding, -1))
    better = before.isNull() | (F.col("val_loss") < before - least_gain)
    rows = history.withColumn("best_loss", F.min("val_loss").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("improved", better)
    last = F.max(F.when(F.col("improved"), F.col("epoch"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("best_epoch", last).withColumn("waited", F.col("epoch") - last)
    return rows.withColumn("stopped", F.max((F.col("waited") >= patience).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1)


def one_class_runs(history: DataFrame, by: Sequence[str], length: int = 3) -> DataFrame:
    """Runs with ``length`` or more epochs in a row that predict one class. ``history``: by, epoch, classes."""
    w = W.partitionBy(*by).orderBy("epoch")
    rows = history.withColumn("one", F.col("classes") <= 1).withColumn("island", F.sum((F.col("classes") > 1).cast("int")).over(w))
    return rows.where("one").groupBy(*by, "island").agg(F.count("*").alias("epochs"), F.min("epoch").alias("from_epoch")).where(F.col("epochs") >= length).drop("island")
