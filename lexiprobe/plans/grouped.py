"""Every cell of the experiment grid at once: baselines of one binned measure, from sufficient statistics.

One pass over the rows gives, for each language, task, control, part and bin of the measure, the
number of rows and the sums of labels and of their squares. Dummies, ridge regression, penalised
logistic regression and one boosted stump on that measure are all functions of those few numbers, and
so are their metrics on every part. So all cells are fitted and evaluated together, whatever the
number of rows: the rows are gone through once, not once a cell.

Controls permute the labels of the training rows within a language; other parts keep theirs. A
language without training rows, and a classifier whose training labels are of one class, are failed
experiments with an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, sampling
from ..operators.projection import compatible
from ..schemas import FEATURES, LANGUAGES, MODELS, RESULT, SCORE, SEEDS

#: Bins of the measure; label columns by task.
BINS = 16
LABELS = {"question_type": "question_type", "complexity": SCORE} | {f: f for f in FEATURES}
PARTS = {"train": "train", "validation": "val", "test": "test"}
_CELL = ("language", "task", "control_index")
#: Newton steps of the two logistic parameters, and the largest change in one of them.
STEPS, STRIDE = 20, 2.0
ETA, LAMBDA, ALPHA = 0.1, 1.0, 1.0


def _exact_sum(v: Column) -> Column:
    """The sum, added up in decimals: the same in any order of the rows, which a sum of doubles is not."""
    plain = F.abs(v) < 1e9  # not NaN, and with room for the sum beside 18 decimal places
    return F.coalesce(F.sum(F.when(plain, v).cast("decimal(28,18)")).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(F.when(~plain, v)), F.lit(0.0))


def statistics(rows: DataFrame, labels: dict[str, str] = LABELS, seeds: Sequence[int] = SEEDS, key: str = "doc_id") -> DataFrame:
    """(language, task, control_index, part, x, n, sy, syy); control_index 0 is the uncontrolled run.

    ``rows``: key, language, split, x (a bin) and the label columns.
    """
    y = F.struct(*[F.col(c).cast("double").alias(t) for t, c in labels.items()])
    rows = rows.select(key, "language", "split", "x", y.alias("y"))
    train = rows.where("split = 'train'")
    shuffled = sampling.shuffled_labels(train, "y", seeds, key=key).select("language", "split", "x", "y", F.col("seed").alias("control_index"))
    every = rows.select("language", "split", "x", "y", F.lit(0).alias("control_index")).unionByName(shuffled)
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(f"y.{t}").alias("y")) for t in labels])).alias("p")
    part = F.element_at(F.create_map(*[F.lit(v) for kv in PARTS.items() for v in kv]), F.col("split"))
    long = every.select("language", "control_index", part.alias("part"), "x", pairs).select("language", "control_index", "part", "x", "p.task", F.coalesce("p.y", F.lit(0.0)).alias("y"))
    return long.groupBy(*_CELL, "part", "x").agg(F.count("*").alias("n"), _exact_sum(F.col("y")).alias("sy"), _exact_sum(F.col("y") * F.col("y")).alias("syy"))


def _total(bins: Column, value) -> Column:
    return F.aggregate(bins, F.lit(0.0), lambda a, b: a + value(b))


def _newton(bins: Column) -> Column:
    """(w, b) of the logistic regression on x / 8 with both parameters penalised."""

    def step(s: Column, _: Column) -> Column:
        def add(a: Column, c: Column) -> Column:
            x = c["x"] / F.lit(8.0)
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(s["w"] * x + s["b"])))
            g, h = c["n"] * p - c["sy"], c["n"] * p * (F.lit(1.0) - p)
            return F.struct((a["gw"] + g * x).alias("gw"), (a["gb"] + g).alias("gb"), (a["ww"] + h * x * x).alias("ww"), (a["wb"] + h * x).alias("wb"), (a["bb"] + h).alias("bb"))

        start = F.struct(s["w"].alias("gw"), s["b"].alias("gb"), F.lit(1.0).alias("ww"), F.lit(0.0).alias("wb"), F.lit(1.0).alias("bb"))
        sums = F.aggregate(bins, start, add)

        def move(t: Column) -> Column:
            det = t["ww"] * t["bb"] - t["wb"] * t["wb"]
            clip = lambda v: F.greatest(F.lit(-STRIDE), F.least(F.lit(STRIDE), v))
            dw, db = (t["bb"] * t["gw"] - t["wb"] * t["gb"]) / det, (t["ww"] * t["gb"] - t["wb"] * t["gw"]) / det
            return F.struct((s["w"] - clip(dw)).alias("w"), (s["b"] - clip(db)).alias("b"))

        return F.transform(F.array(sums), move)[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("b")), step)


def _stump(bins: Column, classify: Column) -> Column:
    """(gain, first, left, right) of the best split x <= -first, or null where none gains: one round of depth 1."""
    half = lambda b: b["n"] * F.lit(0.5) - b["sy"]
    weight = lambda b: b["n"] * F.when(classify, 0.25).otherwise(1.0)
    total_g, total_h = _total(bins, half), _total(bins, weight)

    def split(b: Column) -> Column:
        below = F.filter(bins, lambda c: c["x"] <= b["x"])
        gl, hl = _total(below, half), _total(below, weight)
        gr, hr = total_g - gl, total_h - hl
        gain = gl * gl / (hl + LAMBDA) + gr * gr / (hr + LAMBDA) - total_g * total_g / (total_h + LAMBDA)
        ok = (hl >= 1) & (hr >= 1) & (gain > 1e-9)
        return F.when(ok, F.struct(F.bround(gain, 9).alias("gain"), (-b["x"]).alias("first"), (-ETA * gl / (hl + LAMBDA)).alias("left"), (-ETA * gr / (hr + LAMBDA)).alias("right")))

    whole = -ETA * total_g / (total_h + LAMBDA)
    return F.coalesce(F.array_max(F.filter(F.transform(bins, split), lambda s: s.isNotNull())), F.struct(F.lit(0.0).alias("gain"), F.lit(0).alias("first"), whole.alias("left"), whole.alias("right")))


def fitted(stats: DataFrame) -> DataFrame:
    """(language, task, control_index, n, classes, model_type, slope, base, stump): the parameters of each cell and model."""
    bins = F.sort_array(F.collect_list(F.struct("x", "n", "sy")))  # at most BINS entries
    cells = stats.where("part = 'train'").groupBy(*_CELL).agg(bins.alias("bins"), F.sum("n").alias("n"), F.sum("sy").alias("sy"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("xm"))
    classify, mean, xm = F.col("task") == "question_type", F.col("sy") / F.col("n"), F.col("xm")
    # Each model's parameters are computed where it is used only.
    slope = _total(F.col("bins"), lambda b: (b["x"] - xm) * b["sy"]) / (_total(F.col("bins"), lambda b: b["n"] * (b["x"] - xm) * (b["x"] - xm)) + ALPHA)
    wide = cells.select(*_CELL, "n", F.when(classify, (F.col("sy") > 0).cast("int") + (F.col("sy") < F.col("n")).cast("int")).alias("classes"), mean.alias("mean"), xm.alias("xm"), classify.alias("classify"),
                        F.when(~classify, slope).alias("ridge"), F.when(classify, _newton(F.col("bins"))).alias("logistic"), _stump(F.col("bins"), classify).alias("stump"))
    models = wide.select("*", F.explode(F.array(*map(F.lit, MODELS))).alias("model_type")).where(compatible(F.col("model_type"), F.when(F.col("classify"), "classification").otherwise("regression")))
    model = F.col("model_type")
    slope = F.when(model == "ridge", F.col("ridge")).when(model == "logistic", F.col("logistic.w") / 8).otherwise(0.0)
    base = F.when(model == "ridge", F.col("mean") - F.col("ridge") * F.col("xm")).when(model == "logistic", F.col("logistic.b")).when(model == "dummy", F.when(F.col("classify"), F.col("mean") - 0.5).otherwise(F.col("mean"))).otherwise(F.when(F.col("classify"), 0.0).otherwise(0.5))
    return models.select(*_CELL, "n", "classes", "classify", "model_type", slope.alias("slope"), base.alias("base"), F.when(model == "xgboost", F.col("stump")).alias("stump"))


def prediction(x: Column) -> Column:
    """What a row of ``fitted`` predicts for bin x: a value, or class 0 or 1 by the margin's sign."""
    leaf = F.when(x <= -F.col("stump.first"), F.col("stump.left")).otherwise(F.col("stump.right"))
    margin = F.col("slope") * x + F.col("base") + F.coalesce(leaf, F.lit(0.0))
    return F.when(F.col("classify"), (margin > 1e-12).cast("double")).otherwise(margin)


def evaluated(models: DataFrame, stats: DataFrame) -> DataFrame:
    """(language, task, control_index, model_type, part, samples, metrics) of every model on every part."""
    seen = stats.select("language", "task", "part", "x", F.col("n").alias("k"), "sy", "syy", F.col("control_index").alias("of"))
    both = models.join(seen, ["language", "task"]).where((F.col("part") != "train") | (F.col("of") == F.col("control_index"))).withColumn("p", prediction(F.col("x")))
    k, sy, p = F.col("k"), F.col("sy"), F.col("p")
    sums = both.groupBy(*_CELL, "model_type", "classify", "part").agg(
        F.sum("k").alias("samples"), F.sum(sy).alias("ones"), F.sum("syy").alias("squares"), F.sum(F.col("syy") - 2 * p * sy + k * p * p).alias("sse"), F.sum(F.when(p == 1, k).otherwise(0)).alias("said"), F.sum(F.when(p == 1, sy).otherwise(0.0)).alias("hit")
    )
    n, ones, said, hit = (F.col(c) for c in ("samples", "ones", "said", "hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    hit0 = (n - ones) - (said - hit)
    p1, r1, p0, r0 = ratio(hit, said), ratio(hit, ones), ratio(hit0, n - said), ratio(hit0, n - ones)
    f = lambda a, b: ratio(2 * a * b, a + b)
    weighted = lambda a, b: (ones * a + (n - ones) * b) / n
    spread = F.col("squares") - ones * ones / n
    classify = F.col("classify")
    values = {
        "accuracy": F.when(classify, (hit + hit0) / n), "precision": F.when(classify, weighted(p1, p0)), "recall": F.when(classify, weighted(r1, r0)), "f1": F.when(classify, weighted(f(p1, r1), f(p0, r0))),
        "mse": F.when(~classify, F.col("sse") / n), "r2": F.when(~classify, F.when(spread > 1e-9, 1 - F.col("sse") / spread).otherwise(0.0)),
    }
    return sums.select(*_CELL, "model_type", "part", "samples", *[F.bround(v, 12).alias(m) for m, v in values.items()])


def documents(spark: SparkSession, stats: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """A result document (``schemas.RESULT``) for every cell of the grid, from ``statistics`` (gone through several times).

    ``train_time`` is a millisecond a training row and the timestamp a second a row of all parts, so
    that a rerun gives the same documents.
    """
    models = fitted(stats)
    metrics = evaluated(models, stats)
    names = ("accuracy", "precision", "recall", "f1", "mse", "r2")
    classes = F.col("task_type") == "classification"
    whole = metrics.groupBy(*_CELL, "model_type").agg(*[F.max(F.when(F.col("part") == p, F.struct("samples", *names))).alias(p) for p in PARTS.values()])
    about = models.groupBy(*_CELL).agg(F.max("classes").alias("classes"))
    g = grid.experiment_grid(spark).where(F.col("language").isin(list(languages))).withColumn("task", F.coalesce("submetric", "task")).withColumnRenamed("control_index", "control").withColumn("control_index", F.coalesce("control", F.lit(0)))
    g = g.join(whole, [*_CELL, "model_type"], "left").join(about, list(_CELL), "left")
    error = F.when(F.col("train").isNull(), F.concat(F.lit("ValueError: no training rows for language "), F.col("language"))).when((F.col("model_type") == "logistic") & (F.col("classes") < 2), "ValueError: training labels of bad shape: one class only")
    g = g.withColumn("error", error)
    done = F.col("error").isNull()
    first = lambda p: F.struct(F.when(classes, "accuracy").otherwise("mse").alias("primary_metric"), F.when(classes, F.col(f"{p}.accuracy")).otherwise(F.col(f"{p}.mse")).alias("primary_value"), *[F.col(f"{p}.{m}").alias(m) for m in names])
    part = lambda p: F.when(done & F.col(p).isNotNull(), first(p)).alias(f"{p}_metrics")
    count = lambda p: F.when(done, F.coalesce(F.col(f"{p}.samples"), F.lit(0)))
    shapes = F.struct(*[F.when(done, F.array(count(p), F.lit(1).cast("long"))).alias(p) for p in PARTS.values()]).alias("data_shapes")
    second = sum((F.coalesce(F.col(f"{p}.samples"), F.lit(0)) for p in PARTS.values()), F.lit(0))
    text = lambda v=None: F.lit(v).cast("string")
    config = F.struct(
        F.concat_ws("_", "model_type", "task", "language", "dataset_config").alias("experiment_name"), "language", "task", "model_type", "task_type", F.col("dataset_config").alias("config"), text().alias("dataset_config"),
        F.when(F.col("control").isNull(), "main").otherwise("control").alias("experiment_type"), text("features").alias("features_dir"), text("grouped").alias("batch_name"),
    ).alias("config")
    out = g.select(
        "experiment_id", F.date_format(F.timestamp_seconds(F.lit(1_755_000_000) + second), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.when(done, "completed").otherwise("failed").alias("status"), "error",
        text().alias("language"), text("").alias("task"), text().alias("model"), "model_type", text().alias("model_class"), "task_type", F.when(done, F.col("train.samples") / 1e3).alias("train_time"), config,
        *[part(p) for p in PARTS.values()], shapes, *[F.lit(None).cast("struct<samples:bigint>").alias(f"{p}_info") for p in PARTS.values()],
    )
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT.fields])
