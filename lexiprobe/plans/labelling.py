"""Question labelling: corpus questions and treebank sentences to classes and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.annotations import agreement_counts, agreement_rates, annotation_counts, classify_questions
from ..functions.questions import ud_bucket
from ..operators.projection import in_languages, included
from ..sources import readers


def label_corpus(questions: DataFrame, languages: list[str] | None = None) -> dict[str, DataFrame]:
    """All tables of the labelling job: rows, training rows, annotation and agreement statistics."""
    kept = in_languages(questions, languages or ["all"])
    rows = classify_questions(kept)
    counts = agreement_counts(rows)
    return {
        "classified": rows.where("dropped IS NULL").drop("dropped", "added"), "training": included(rows.where("dropped IS NULL")), "annotations": annotation_counts(kept),
        "agreement": counts, "rates": agreement_rates(counts),
    }


def route_sentences(sentences: DataFrame, min_tokens: int = 3, max_tokens: int = 40) -> DataFrame:
    """Treebank sentences with the bucket they go to."""
    return sentences.withColumn("bucket", ud_bucket(F.col("text"), F.col("language"), min_tokens, max_tokens))


def bucket_counts(routed: DataFrame, by: str = "file") -> DataFrame:
    """Sentences, questions and buckets of each file, and in all (``by`` null)."""
    count = lambda *b: F.count_if(F.col("bucket").isin(*b))
    return routed.rollup(by).agg(
        F.count("*").alias("sentences"), count("filtered", "polar", "content", "unclassified").alias("questions"), count("filtered").alias("filtered"), count("polar").alias("polar"), count("content").alias("content"), count("unclassified").alias("unclassified")
    )


def label_treebank(spark, path: str, language: str, to: str | None = None) -> DataFrame:
    """Reads .conllu files, routes their sentences, and appends them to ``to`` if given."""
    routed = route_sentences(readers.conllu(spark, path).withColumn("language", F.lit(language)))
    if to:
        readers.write_conllu(routed.where("bucket != 'other'"), to)
    return routed
