"""Metrics of predictions as grouped aggregates: one pass and one small shuffle a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, group: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(*group, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def per_class(predictions: DataFrame, group: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Support, precision, recall and F1 of every class that occurs as label or prediction; 0 / 0 is 0."""
    cells = confusion(predictions, group, label, prediction)
    sides = F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit(True).alias("is_label")), F.struct(F.col("prediction").alias("class"), F.lit(False).alias("is_label")))).alias("side")
    rows = cells.select(*group, "n", (F.col("label") == F.col("prediction")).alias("hit"), sides)
    label_side = F.col("side.is_label")
    counts = rows.groupBy(*group, F.col("side.class").alias("class")).agg(
        F.sum(F.when(label_side, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~label_side, F.col("n")).otherwise(0)).alias("predicted"), F.sum(F.when(label_side & F.col("hit"), F.col("n")).otherwise(0)).alias("tp")
    )
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return counts.select("*", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def classification(predictions: DataFrame, group: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy, precision, recall, f1 (weighted by support), macro_f1, n_samples; and, where exactly
    two classes occur, the values of the larger class."""
    c = per_class(predictions, group, label, prediction)
    w = lambda m: (F.sum(F.col("support") * F.col(m)) / F.sum("support"))
    top = lambda m: F.when(F.count("*") == 2, F.max_by(m, "class"))
    return c.groupBy(*group).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), w("precision").alias("precision"), w("recall").alias("recall"), w("f1").alias("f1"), F.avg("f1").alias("macro_f1"),
        top("precision").alias("binary_precision"), top("recall").alias("binary_recall"), top("f1").alias("binary_f1"), F.sum("support").alias("n_samples"),
    )


def regression(predictions: DataFrame, group: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """mse, rmse, mae, r2, n_samples. r2 of constant labels: 1 if there is no error, else 0."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = predictions.groupBy(*group).agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("var"), F.count(y).alias("n_samples"))
    r2 = F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return sums.select(*group, "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "n_samples")


def by_task_type(predictions: DataFrame, task_type: str, group: Sequence[str] = ()) -> DataFrame:
    """The metrics of a task type in long form: (group, metric, value), primary metric first."""
    names = ("accuracy", "precision", "recall", "f1") if task_type == "classification" else ("mse", "r2")
    wide = classification(predictions, group) if task_type == "classification" else regression(predictions, group)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    return wide.select(*group, F.explode(pairs).alias("m")).select(*group, "m.metric", "m.value", (F.col("m.metric") == names[0]).alias("primary"))


def thresholded(probability: Column, cut: float = 0.5) -> Column:
    return (probability > cut).cast("int")


def mean_loss(predictions: DataFrame, task_type: str, group: Sequence[str] = (), label: str = "label", prediction: str = "prediction", least: float = 1e-7) -> DataFrame:
    """(group, loss, n): the mean log loss of probabilities (kept ``least`` away from 0 and 1), or the mean squared error; rows without a label or prediction are left out."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    q = F.greatest(F.lit(least), F.least(F.lit(1 - least), p))
    loss = -(y * F.log(q) + (1 - y) * F.log(1 - q)) if task_type == "classification" else (y - p) * (y - p)
    return predictions.where(y.isNotNull() & p.isNotNull()).groupBy(*group).agg(F.avg(loss).alias("loss"), F.count("*").alias("n"))
