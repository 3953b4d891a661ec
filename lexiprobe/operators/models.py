"""Baselines and probes: dummy, logistic, ridge, forests, boosting, pooling, MLP, transfer."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import Scratch
from . import boosting, forest, linear, metrics
from .grid import parameters
from .groups import matched, per_group
from .probes import mlp, probes  # noqa: F401 (among the models)
from .quantiles import quantiles

def sparse_rows(vectors: DataFrame, labels: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """(doc_id, features, label) from long vectors; a document without terms has the zero vector.

    A sparse vector is stored as a struct, so it is written as one and read as a vector: no Python.
    """
    scratch = Scratch(labels.sparkSession, "vectors")
    entries = vectors.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("term_id").cast("int").alias("i"), F.col("tfidf").cast("double").alias("v")))).alias("e"))
    e = F.coalesce("e", F.expr("CAST(array() AS array<struct<i:int,v:double>>)"))
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.transform(e, lambda x: x["i"]).alias("indices"), F.transform(e, lambda x: x["v"]).alias("values"))
    scratch.keep(labels.join(entries, key, "left").select(*labels.columns, vector.alias("features")), "rows")
    schema = T.StructType([*labels.schema.fields, T.StructField("features", VectorUDT())])
    return labels.sparkSession.read.schema(schema).parquet(f"{scratch.path}/rows")


def _parts(features: str = "features") -> Column:
    """A vector's entries, an array of (feature, value); dense vectors give all of theirs."""
    v = F.unwrap_udt(F.col(features))
    sparse = F.transform(F.arrays_zip(v["indices"], v["values"]), lambda x: F.struct(x["indices"].alias("feature"), x["values"].alias("value")))
    dense = F.transform(v["values"], lambda x, i: F.struct(i.cast("int").alias("feature"), x.alias("value")))
    return F.when(v["type"] == 1, dense).otherwise(sparse)


def vector_entries(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, feature, value) of ``features``."""
    return rows.select(key, F.explode(_parts()).alias("e")).select(key, "e.feature", "e.value")


def dense_rows(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(column, lambda x: x.cast("double"))))


# --- dummies: aggregates joined back, no pass over features ---

CLASS_STRATEGIES = ("most_frequent", "prior", "stratified", "uniform", "constant")
VALUE_STRATEGIES = ("mean", "median", "quantile", "constant")


def drawn(key: Column, seed: int) -> Column:
    """A number in [0, 1) drawn from a key; the same in any engine that has MD5. A null key draws like an empty one."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def dummy_classifier(
    train: DataFrame, test: DataFrame, label: str = "label", by: Sequence[str] = (), strategy: str = "most_frequent", constant: float | None = None, key: str | None = None, seed: int = 42
) -> DataFrame:
    """Predicts without features, within groups if given (null is a group).

    most_frequent and prior: the most frequent training label (ties: the smallest). stratified and
    uniform: a label drawn by the row's key, by the labels' shares or evenly. constant: that one.
    Rows of a group without training labels have no prediction.
    """
    if strategy not in CLASS_STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(CLASS_STRATEGIES)}")
    if strategy == "constant":
        return test.withColumn("prediction", F.lit(constant))
    counts = train.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    if strategy in ("most_frequent", "prior"):
        mode = counts.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("prediction"))
        return matched(test, per_group(mode), by, "left")
    if key is None:
        raise ValueError(f"{strategy} draws by a key; name its column")
    shares = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "n"))).alias("__c"), F.sum("n").alias("__n"))  # a row a group, of its classes
    u, c = drawn(F.col(key), seed), F.col("__c")
    if strategy == "uniform":
        at = F.least(F.floor(u * F.size(c)).cast("int"), F.size(c) - 1)
    else:  # the first label whose running share lies above the draw
        running = F.transform(c, lambda x, i: F.aggregate(F.slice(c, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]))
        at = F.least(F.size(F.filter(running, lambda r: r <= u * F.col("__n"))), F.size(c) - 1)
    return matched(test, per_group(shares), by, "left").withColumn("prediction", F.get(c, at)["label"]).drop("__c", "__n")


def dummy_regressor(train: DataFrame, test: DataFrame, label: str = "label", by: Sequence[str] = (), strategy: str = "mean", constant: float | None = None, quantile: float = 0.5) -> DataFrame:
    """Predicts the mean, median, a quantile of the training labels or a constant, within groups if given (null is a group)."""
    if strategy not in VALUE_STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(VALUE_STRATEGIES)}")
    if strategy == "constant":
        return test.withColumn("prediction", F.lit(constant))
    if strategy == "mean":
        value = train.groupBy(*by).agg(F.avg(label).alias("prediction"))
    else:
        value = quantiles(train, label, [0.5 if strategy == "median" else quantile], by).select(*by, F.get("p", F.lit(0)).alias("prediction"))
    return matched(test, per_group(value), by, "left")


# --- linear models with the objectives of the published runs ---


class PenalisedLogistic:
    """Logistic regression whose intercept is penalised too: C times log loss, plus half the squared weights or ("l1") their absolute sum."""

    def __init__(self, c: float = 1.0, max_iter: int = 1000, penalty: str = "l2", coefficients: np.ndarray | None = None, intercept: float = 0.0):
        self.c, self.max_iter, self.penalty, self.coefficients, self.intercept = c, max_iter, penalty, coefficients, intercept

    def fit(self, rows: DataFrame) -> PenalisedLogistic:
        """``rows``: features (vector), label (0 / 1), doc_id."""
        first = rows.select(F.unwrap_udt("features").alias("v")).select(F.coalesce("v.size", F.size("v.values"))).first()
        data = linear.Rows(vector_entries(rows), rows.select("doc_id", "label"), ["label"], features=first[0] if first else 0)
        self.coefficients, self.intercept = linear.logistic(data, self.c, self.penalty, tol=1e-7, most=self.max_iter).of("label") if data.groups else (np.zeros(data.d), 0.0)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds probability (of label 1) and prediction."""
        table = rows.sparkSession.createDataFrame([(self.coefficients.tolist(),)], "__w array<double>")  # one row, a number a feature
        margin = F.aggregate(_parts(), F.lit(self.intercept), lambda a, x: a + x["value"] * F.get("__w", x["feature"]))
        out = rows.crossJoin(F.broadcast(table)).withColumn("probability", 1 / (1 + F.exp(-margin))).drop("__w")
        return out.withColumn("prediction", (F.col("probability") > 0.5).cast("double"))

    def save(self, path: str) -> None:
        SparkSession.active().createDataFrame([(self.coefficients.tolist(), float(self.intercept))], "coefficients array<double>, intercept double").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PenalisedLogistic:
        row = spark.read.parquet(path).first()
        return cls(coefficients=np.array(row["coefficients"]), intercept=row["intercept"])


class Boosted:
    """Boosted trees over vectors; zeros that a sparse vector leaves out are missing values."""

    def __init__(self, model: boosting.Model):
        self.model = model

    @classmethod
    def fit(cls, rows: DataFrame, classify: bool, parameters: boosting.Parameters) -> Boosted:
        return cls(boosting.fit(vector_entries(rows), rows.select("doc_id", "label"), classify, parameters))

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.predict(rows, vector_entries(rows))

    @property
    def featureImportances(self) -> np.ndarray:  # noqa: N802 (as other models name it)
        """Each feature's share of the splits."""
        found = {r["feature"]: r["splits"] for r in self.model.importances().collect()}  # a row a feature
        out = np.zeros(max(found, default=-1) + 1)
        out[list(found)] = list(found.values())
        return out / max(out.sum(), 1.0)

    def save(self, path: str) -> None:
        self.model.save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        return cls(boosting.Model.load(spark, path))


class Forest(Boosted):
    """A forest of any depth over vectors."""

    def __init__(self, model: forest.Model):
        self.model = model

    @classmethod
    def fit(cls, rows: DataFrame, classify: bool, parameters: forest.Parameters) -> Forest:
        return cls(forest.fit(vector_entries(rows), rows.select("doc_id", "label"), classify, parameters))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        return cls(forest.Model.load(spark, path))


def ridge(rows: DataFrame, alpha: float = 1.0):
    """Ridge regression with an unpenalised intercept: squared error plus alpha times squared weights.

    Spark scales the penalty by the label's deviation, so that is put into it.
    """
    stats = rows.agg(F.count("*").alias("n"), F.stddev_samp("label").alias("sd")).first()
    sd = stats["sd"] or 0.0
    if sd == 0 or math.isnan(sd):
        return LinearRegression(maxIter=1).fit(rows)
    return LinearRegression(solver="l-bfgs", regParam=alpha / stats["n"] * sd, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(rows)


def estimator(model: str, task_type: str, params: dict | None = None, seed: int = 42):
    """A fitter (rows -> model with ``transform``) by model name."""
    if task_type not in ("classification", "regression"):
        raise ValueError(f"unknown task type {task_type!r}")
    if (model, task_type) in (("logistic", "regression"), ("ridge", "classification")):
        raise ValueError(f"{model} is not for {task_type}")
    p = parameters(model, task_type) | (params or {})
    classify = task_type == "classification"
    if model == "dummy":
        if p["strategy"] not in (CLASS_STRATEGIES if classify else VALUE_STRATEGIES):
            raise ValueError(f"unknown strategy {p['strategy']!r}")
        return lambda rows: Dummy.fit(rows, classify, p["strategy"], p.get("constant"), p.get("quantile", 0.5), seed)
    if model == "logistic":
        return lambda rows: PenalisedLogistic(p["C"], p["max_iter"], p["penalty"]).fit(rows)
    if model == "ridge":
        return lambda rows: ridge(rows, p["alpha"])
    if model == "random_forest":
        if p.get("max_depth"):
            kind = RandomForestClassifier if classify else RandomForestRegressor
            return lambda rows: kind(numTrees=p["n_estimators"], maxDepth=p["max_depth"], seed=seed).fit(rows)
        return lambda rows: Forest.fit(rows, classify, forest.Parameters(trees=p["n_estimators"], seed=seed))
    how = boosting.Parameters(
        rounds=p["n_estimators"], depth=p["max_depth"], eta=p["learning_rate"], subsample=p["subsample"], colsample=p["colsample_bytree"], reg_lambda=p["reg_lambda"], gamma=p.get("gamma", 0.0),
        min_child_weight=p.get("min_child_weight", 1.0), bins=p.get("max_bin", 256), seed=seed,
    )
    return lambda rows: Boosted.fit(rows, classify, how)


def unhonoured(model: str, task_type: str, params: dict | None = None) -> dict:
    """The parameters that this engine's models don't have, as asked for: result documents record them."""
    asked = parameters(model, task_type) | (params or {})
    known = {
        "dummy": {"strategy", "constant", "quantile"}, "logistic": {"C", "max_iter", "penalty"}, "ridge": {"alpha"}, "random_forest": {"n_estimators", "max_depth"},
        "xgboost": {"n_estimators", "max_depth", "learning_rate", "subsample", "colsample_bytree", "reg_lambda", "gamma", "min_child_weight", "max_bin"},
    }
    return {k: v for k, v in asked.items() if k not in known[model]}


class Dummy:
    """A prediction without features; its state is a small table of training labels or one number."""

    def __init__(self, state: DataFrame, classify: bool, strategy: str, constant: float | None = None, quantile: float = 0.5, seed: int = 42):
        self.state, self.classify, self.strategy, self.constant, self.quantile, self.seed = state, classify, strategy, constant, quantile, seed

    @classmethod
    def fit(cls, train: DataFrame, classify: bool, strategy: str | None = None, constant: float | None = None, quantile: float = 0.5, seed: int = 42) -> Dummy:
        strategy = strategy or ("most_frequent" if classify else "mean")
        if strategy in ("stratified", "uniform"):
            return cls(train.select("label"), classify, strategy, constant, quantile, seed)
        one = train.sparkSession.range(1).select()
        how = {"strategy": strategy, "constant": constant} | ({} if classify else {"quantile": quantile})
        return cls((dummy_classifier if classify else dummy_regressor)(train.select("label"), one, **how), classify, strategy)

    def transform(self, rows: DataFrame) -> DataFrame:
        if self.strategy in ("stratified", "uniform"):
            return dummy_classifier(self.state, rows, strategy=self.strategy, key="doc_id", seed=self.seed)
        return rows.crossJoin(F.broadcast(self.state))  # one row

    def save(self, path: str) -> None:
        if self.strategy in ("stratified", "uniform"):
            raise ValueError("a dummy that draws is fitted where it is used")
        self.state.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dummy:
        return cls(spark.read.parquet(path), True, "constant")


def importances(model) -> np.ndarray | None:
    """Coefficients or split gains of a fitted model, as one array; None for dummies."""
    for name in ("coefficients", "featureImportances"):
        if hasattr(model, name):
            v = getattr(model, name)
            return np.asarray(v.toArray() if hasattr(v, "toArray") else v)
    return None


def evaluate(model, rows: DataFrame, task_type: str) -> dict[str, float]:
    out = model.transform(rows)
    got = (metrics.classification if task_type == "classification" else metrics.regression)(out.withColumn("label", F.col("label").cast("double")).withColumn("prediction", F.col("prediction").cast("double"))).first()
    return {k: float(v) for k, v in got.asDict().items() if v is not None}


def experiment(model: str, task_type: str, parts: dict[str, DataFrame], params: dict | None = None, config: dict | None = None) -> dict:
    """Fits on parts["train"], times it, and evaluates every part; the result document as a dict."""
    began = time.perf_counter()
    fitted = estimator(model, task_type, params)(parts["train"])
    took = time.perf_counter() - began
    out = {"status": "completed", "error": None, "model_type": type(fitted).__name__, "task_type": task_type, "train_time": took, "config": (config or {}) | ({"unhonoured": left} if (left := unhonoured(model, task_type, params)) else {})}
    primary = "accuracy" if task_type == "classification" else "mse"
    for name, rows in parts.items():
        m = evaluate(fitted, rows, task_type)
        if primary in m:  # a part without rows has no metrics
            out[f"{name}_metrics"] = {"primary_metric": primary, "primary_value": m[primary]} | m
    if (w := importances(fitted)) is not None:
        top = np.argsort(-np.abs(w), kind="stable")[:10]
        out["feature_importance"] = {"top_indices": top.tolist(), "values": w.tolist()}
    return out


def boosting_curve(model: Boosted, rows: DataFrame) -> list[float]:
    """Loss of a boosted model after each round, from one pass."""
    curve = model.model.curve(rows, vector_entries(rows))
    return [r["loss"] for r in curve.where("round > 0").orderBy("round").collect()]  # a row a round


# --- hidden states ---


def pooled(hidden: DataFrame, how: str = "mean", layer: int | None = None, layers: int | None = None) -> DataFrame:
    """Sentence vectors (doc_id, layer, embedding) of ``schemas.HIDDEN``: first token or masked mean.

    A layer beyond the last is the last. A mask of zeros gives the zero vector.
    """
    rows = hidden if layer is None else hidden.where(F.col("layer") == (layer if layers is None else min(layer, layers - 1)))
    if how == "cls":
        return rows.select("doc_id", "layer", F.get("tokens", F.lit(0)).alias("embedding"))
    width = F.size(F.get("tokens", F.lit(0)))
    total = F.aggregate(
        F.zip_with("tokens", "mask", lambda t, m: F.transform(t, lambda x: x * m)), F.array_repeat(F.lit(0.0), width.cast("int")), lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b)
    )
    n = F.greatest(F.aggregate("mask", F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    return rows.select("doc_id", "layer", F.transform(total, lambda x: x / n).alias("embedding"))


def transfer(rows: DataFrame, source: str, target: str, model: str, task_type: str, column: str = "language") -> dict[str, float]:
    """Fits on one language's rows and evaluates on another's."""
    fitted = estimator(model, task_type)(rows.where(F.col(column) == source))
    return evaluate(fitted, rows.where(F.col(column) == target), task_type)


def transfer_matrix(weights: linear.Weights, rows: DataFrame, entries: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(train_language, test_language, label, mse, n): every model of ``weights`` on the rows of every language, in one pass.

    ``labels``: key, language, label, y; rows without a label are left out.
    """
    margins = weights.margins(rows, entries, key).withColumnRenamed("group", "train_language")
    both = margins.join(labels.where("y IS NOT NULL"), [key, "label"])
    apart = F.col("y") - F.col("margin")
    return both.groupBy("train_language", F.col("language").alias("test_language"), "label").agg(F.avg(apart * apart).alias("mse"), F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): n_all / (classes * n)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__all"), F.count("*").alias("__k"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("__all") / (F.col("__k") * F.col("n"))).alias("weight"))


def tokenized(docs: DataFrame, ids: str = "input_ids", length: int = 128, pad: int = 1) -> DataFrame:
    """Ids cut or padded to ``length``, with their mask and the label as a double."""
    cut = F.slice(ids, 1, length)
    n = F.size(cut)
    padded = lambda a, v: F.concat(a, F.array_repeat(F.lit(v), (F.lit(length) - n).cast("int")))
    return docs.select("doc_id", padded(cut, pad).alias("input_ids"), padded(F.array_repeat(F.lit(1), n.cast("int")), 0).alias("attention_mask"), F.col("label").cast("double").alias("label"))
