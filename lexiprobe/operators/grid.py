"""Experiment grids, ids and model defaults."""

from __future__ import annotations

import copy
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEATURES, LANGUAGES, MODELS, SEEDS
from .projection import compatible

#: Default parameters by model and task type, as the published runs have them.
PARAMETERS = {
    "dummy": {"classification": {"strategy": "most_frequent"}, "regression": {"strategy": "mean"}},
    "logistic": {"classification": {"C": 1.0, "max_iter": 1000, "penalty": "l2"}},
    "ridge": {"regression": {"alpha": 1.0}},
    "random_forest": {kind: {"n_estimators": 100, "max_depth": None} for kind in ("classification", "regression")},
    "xgboost": {kind: {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8, "reg_lambda": 1} for kind in ("classification", "regression")},
}


#: Recommended networks of probes and their training, as the published runs have them.
PROBE_NETWORKS = {
    "classification": {"probe_hidden_size": 128, "dropout": 0.3, "activation": "gelu", "normalization": "layer", "probe_depth": 1, "weight_init": "xavier"},
    "regression": {"probe_hidden_size": 96, "dropout": 0.1, "activation": "silu", "normalization": "layer", "probe_depth": 1, "weight_init": "small", "output_standardization": True},
}
PROBE_TRAINING = {
    "classification": {"batch_size": 16, "weight_decay": 0.01, "num_epochs": 15, "lr": 1e-4, "patience": 3, "gradient_accumulation_steps": 2},
    "regression": {"batch_size": 16, "weight_decay": 0.01, "num_epochs": 15, "lr": 5e-5, "patience": 4, "gradient_accumulation_steps": 2},
}


def probe_options(task: str) -> dict:
    """The recommended options of ``probes.probes`` for a task: question_type classifies, all others are values."""
    kind = "classification" if task == "question_type" else "regression"
    net, run = PROBE_NETWORKS[kind], PROBE_TRAINING[kind]
    return {
        "classes": 2 if kind == "classification" else 0, "hidden": (net["probe_hidden_size"],) * net["probe_depth"], "dropout": net["dropout"], "activation": net["activation"],
        "normalization": net["normalization"], "init": net["weight_init"], "batch": run["batch_size"], "decay": run["weight_decay"], "epochs": run["num_epochs"], "lr": run["lr"],
        "patience": run["patience"], "accumulate": run["gradient_accumulation_steps"],
    }


def parameters(model: str, task_type: str) -> dict:
    """A copy of the defaults; a model without that task type gives its first entry."""
    if model not in PARAMETERS:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(PARAMETERS)}")
    found = PARAMETERS[model]
    return copy.deepcopy(found.get(task_type) or next(iter(found.values())))


def _crossed(df: DataFrame, name: str, values) -> DataFrame:
    """Each row with each value of a short list, as an array that is exploded: one task, no join."""
    return df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def _languages(spark: SparkSession, languages: DataFrame | None) -> DataFrame:
    """(language): the given ones, or the published seven."""
    return languages.select("language") if languages is not None else _crossed(spark.range(0, 1, 1, 1), "language", LANGUAGES).select("language")


def experiment_grid(spark: SparkSession, languages: DataFrame | None = None) -> DataFrame:
    """All experiments: languages x tasks x compatible models x (main and three controls), 96 rows a language.

    Columns: language, task, task_type, model_type, control_index (null: main), submetric, kind,
    dataset_config, experiment_id. Every factor is a short list.
    """
    tasks = [("question_type", "classification", None), ("complexity", "regression", None), *(("single_submetric", "regression", f) for f in FEATURES)]
    task = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.lit(k).alias("task_type"), F.lit(m).cast("string").alias("submetric")) for t, k, m in tasks]))
    grid = _languages(spark, languages).select("language", task.alias("t")).select("language", "t.*")
    grid = _crossed(_crossed(grid, "model_type", MODELS), "control_index", [None, *SEEDS])
    grid = grid.where(compatible(F.col("model_type"), F.col("task_type")))
    control, sub = F.col("control_index").isNotNull(), F.col("submetric").isNotNull()
    kind = F.when(control & sub, "control_submetric").when(control, "control").when(sub, "submetric").otherwise("main")
    of = F.coalesce("submetric", "task")
    config = F.when(control, F.concat(F.lit("control_"), of, F.lit("_seed"), F.col("control_index").cast("string"))).otherwise("base")
    grid = grid.withColumn("kind", kind).withColumn("dataset_config", config)
    return grid.withColumn("experiment_id", experiment_id({
        "config": F.col("dataset_config"), "experiment_type": F.when(control, "control").otherwise("main"), "language": F.col("language"), "model_type": F.col("model_type"), "task": of, "task_type": F.col("task_type"),
    }))


def experiment_id(config: dict[str, Column]) -> Column:
    """First 12 hex digits of the MD5 of the configuration as JSON with sorted keys.

    Values are strings of plain characters; ``experiment_id_of`` does the same for any dict.
    """
    parts = [F.concat(F.lit(f'"{k}": "'), config[k], F.lit('"')) for k in sorted(config)]
    return F.substring(F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))), 1, 12)


def experiment_id_of(config: dict) -> str:
    return hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def grid_sizes(grid: DataFrame) -> DataFrame:
    """Experiments by kind and whether they classify."""
    return grid.groupBy("kind", "task_type").agg(F.count("*").alias("experiments"))


def layer_grid(spark: SparkSession, layers: int = 12, languages: DataFrame | None = None) -> DataFrame:
    """Probes: languages x labels x (main and three controls) x layers; 2688 rows for seven languages."""
    grid = _crossed(_crossed(_languages(spark, languages), "label", ("question_type", "complexity", *FEATURES)), "control_index", [0, *SEEDS])
    return _crossed(grid, "layer", range(1, layers + 1))


def finetune_grid(spark: SparkSession, languages: DataFrame | None = None) -> DataFrame:
    """Fine-tuning runs: as ``layer_grid`` without layers; 224 rows for seven languages."""
    return layer_grid(spark, 1, languages).drop("layer")


def remaining(grid: DataFrame, done: DataFrame, failed: DataFrame | None = None, tries: int = 2) -> DataFrame:
    """Experiments still to run: not completed, and failed fewer than ``tries`` times."""
    left = grid.join(done.select("experiment_id").distinct(), "experiment_id", "left_anti")
    if failed is not None:
        spent = failed.groupBy("experiment_id").agg(F.count("*").alias("n")).where(F.col("n") >= tries)
        left = left.join(spent, "experiment_id", "left_anti")
    return left


def valid_configuration() -> list[str]:
    """What is wrong with the tables of this module; empty if nothing is."""
    wrong = [f"{m} has no defaults" for m in MODELS if m not in PARAMETERS]
    wrong += [f"{m}: unknown task type {k}" for m, kinds in PARAMETERS.items() for k in kinds if k not in ("classification", "regression")]
    wrong += ["logistic must only classify"] * ("regression" in PARAMETERS["logistic"]) + ["ridge must only regress"] * ("classification" in PARAMETERS["ridge"])
    return wrong
