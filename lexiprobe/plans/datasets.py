"""Dataset construction: from raw feature rows to splits, ablations and controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import normalize, sampling
from ..schemas import FEATURES, SCORE

#: Rows of a language and type: the training target, and the cap of the test split.
TRAIN_ROWS, TEST_ROWS, DEV_ROWS = 500, 55, 75


def scored_rows(raw: DataFrame, least: int = 4, most: int = 100, standardise: bool = False) -> DataFrame:
    """Filtered, scaled within (source, language, type), summed and rounded."""
    rows = normalize.scored(normalize.minmax(normalize.prepared(raw, least, most)))
    return normalize.rounded(normalize.standardised(rows) if standardise else rows)


def build(raw: DataFrame, train_source: str = "tydi", train_rows: int = TRAIN_ROWS, test_rows: int = TEST_ROWS, dev_rows: int = DEV_ROWS, seed: int = 69) -> DataFrame:
    """All rows of the dataset with ``split``.

    Dev rows are held out of the training source first; training rows are then sampled by token
    bins, and test rows of the other source are matched to the training scores of their language.
    """
    rows = scored_rows(raw)
    group = ["language", "type"]
    pool = sampling.hold_out(rows.where(F.col("source") == train_source), group, dev_rows // 4, seed=seed)
    train = sampling.token_sample(pool.where("NOT dev").drop("dev"), train_rows, group, "original_n_tokens", seed=seed)
    parts = [pool.where("dev").drop("dev").withColumn("split", F.lit("validation")), train.withColumn("split", F.lit("train"))]
    other = rows.where(F.col("source") != train_source)
    languages = sorted(r["language"] for r in other.select("language").distinct().collect() if r["language"] is not None)  # a handful
    for language in languages:
        one = sampling.match_distribution(other.where(F.col("language") == language), train.where(F.col("language") == language), test_rows, seed=seed)
        parts.append(one.withColumn("split", F.lit("test")))
    return normalize.finalized(normalize.combined(parts))


def with_controls(dataset: DataFrame, labels: tuple[str, ...] = ("question_type", SCORE, *FEATURES)) -> DataFrame:
    """The base configuration and the label-shuffled controls; the test split keeps its labels."""
    base = dataset.withColumn("config", F.lit("base"))
    out = [base]
    for label in labels:
        name = "complexity" if label == SCORE else label
        moved = sampling.shuffled_labels(dataset.where("split != 'test'"), label).withColumn("config", F.replace("config", F.lit(f"control_{label}_"), F.lit(f"control_{name}_"))).drop("seed")
        kept = dataset.where("split = 'test'").select("*", F.explode(F.array(*[F.lit(f"control_{name}_seed{s}") for s in (1, 2, 3)])).alias("config"))
        out += [moved, kept]
    return normalize.combined(out)
