"""Annotators' answers: predicates on arrays, and the decisions that join them with a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LANGUAGE_CODES
from .patterns import KO_WH
from .questions import CONTENT, POLAR, decide, has, ja_wh, qa_class

#: Languages whose polar questions follow the classifier; in the others both must agree.
BY_CLASSIFIER = ("english", "russian", "japanese", "arabic", "finnish", "korean")


def answered(answers: Column) -> Column:
    """Whether any annotator answered yes or no; null and empty: no."""
    return F.coalesce(F.exists(answers, lambda a: a.isin("YES", "NO")), F.lit(False))


def unanimous(answers: Column) -> Column:
    """Whether all annotators answered yes or no, or none did; at most one answer always is."""
    every = F.forall(answers, lambda a: F.coalesce(a.isin("YES", "NO"), F.lit(False)))
    return F.coalesce((F.size(answers) <= 1) | every | ~answered(answers), F.lit(True))


def yes_count(answers: Column) -> Column:
    return F.coalesce(F.size(F.filter(answers, lambda a: a == "YES")), F.lit(0))


def classify_questions(questions: DataFrame) -> DataFrame:
    """Classes, agreement and inclusion of corpus questions, with what was kept out before.

    Input: question_text, language (full name in any case), annotations.yes_no_answer, and any
    further columns. Adds annotation_class, classifier_class, agreement, final_class, included and
    ``dropped``: "inconsistent" or "no question word" for Japanese and Korean rows that take no part
    in statistics, null for all others. Rows of unknown languages are left out.
    """
    answers = F.col("annotations.yes_no_answer")
    language = F.lower("language")
    code = decide(*[(language == name, F.lit(code)) for name, code in LANGUAGE_CODES.items()])
    special = language.isin("japanese", "korean")
    polar = answered(answers)
    by_annotation = F.when(polar, POLAR).otherwise(CONTENT)
    text = F.col("question_text")
    by_classifier = F.when(special, by_annotation).otherwise(F.coalesce(qa_class(text, code), by_annotation))
    wh = F.when(language == "korean", has(text, KO_WH)).otherwise(ja_wh(text))
    rows = questions.where(language.isin(*LANGUAGE_CODES)).select(
        *[c for c in questions.columns if c != "language"], language.alias("language"), by_annotation.alias("annotation_class"), by_classifier.alias("classifier_class"),
        F.when(special & ~polar, decide((~unanimous(answers), F.lit("inconsistent")), (~wh, F.lit("no question word")))).alias("dropped"),
        (special & polar & ~unanimous(answers)).alias("added"),
    )
    a, c, name = F.col("annotation_class"), F.col("classifier_class"), F.col("language")
    either = (a == POLAR) | (c == POLAR)
    included = name.isin("japanese", "korean") | ((a == CONTENT) & (c == CONTENT)) | F.when(name == "indonesian", either & (a == c)).otherwise(name.isin(*BY_CLASSIFIER) & (c == POLAR))
    final = decide(((a == CONTENT) & (c == CONTENT), F.lit(CONTENT)), (name.isin(*BY_CLASSIFIER) & (c == POLAR), F.lit(POLAR)), ((name == "indonesian") & (a == c), a))
    return rows.withColumn("agreement", a == c).withColumn("included", included).withColumn("final_class", F.when(F.col("included"), final))


def annotation_counts(questions: DataFrame) -> DataFrame:
    """Per language and over all (language null): rows, annotators, distribution of yes counts.

    A single annotator's count is 0 or 1. One row per (language, number of yes answers).
    """
    answers = F.col("annotations.yes_no_answer")
    known = questions.where(F.lower("language").isin(*LANGUAGE_CODES)).select(F.lower("language").alias("language"), (F.coalesce(F.size(answers), F.lit(0)) > 1).alias("multiple"), yes_count(answers).alias("yes"))
    sets = known.groupingSets([[F.col("language"), F.col("yes")], [F.col("yes")]], F.col("language"), F.col("yes"))
    return sets.agg(F.count("*").alias("questions"), F.count_if("multiple").alias("multiple_annotators"), F.count_if(~F.col("multiple")).alias("single_annotator"))


def agreement_counts(classified: DataFrame) -> DataFrame:
    """Per language and over all (language null): how annotations and classifier agree.

    ``dropped`` rows are counted as such and nowhere else.
    """
    stays = F.col("dropped").isNull()
    count = lambda c: F.count_if(stays & c)
    a, c = F.col("annotation_class"), F.col("classifier_class")
    return classified.rollup("language").agg(
        F.count_if(stays).alias("total"), count(a == POLAR).alias("polar_by_annotation"), count(c == POLAR).alias("polar_by_classifier"), count(a == c).alias("agreement"),
        count(a != c).alias("disagreement"), count((a == c) & (a == POLAR)).alias("agreed_polar"), count((a == c) & (a == CONTENT)).alias("agreed_content"), count(~F.col("included")).alias("filtered_out"),
        F.count_if(F.col("dropped") == "inconsistent").alias("skipped"), F.count_if(F.col("dropped") == "no question word").alias("without_question_word"), F.count_if("added").alias("added_polar"),
    )


def agreement_rates(counts: DataFrame) -> DataFrame:
    """Shares in percent; 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) * 100.0 / F.col(b)).otherwise(0.0)
    return counts.select(
        "language", "total", share("agreement", "total").alias("agreement_rate"), share("polar_by_annotation", "total").alias("polar_annotation_rate"), share("polar_by_classifier", "total").alias("polar_classifier_rate"),
        share("agreed_polar", "polar_by_annotation").alias("polar_recall"), share("agreed_polar", "polar_by_classifier").alias("polar_precision"), share("filtered_out", "total").alias("filtered_rate"),
    )
