"""Data model: schemas of inputs and results, and the constants that several operators share."""

from __future__ import annotations

from pyspark.sql import types as T

#: Language codes, and their full names as the question corpus writes them.
LANGUAGES = ("ar", "en", "fi", "id", "ja", "ko", "ru")
LANGUAGE_CODES = {"arabic": "ar", "english": "en", "finnish": "fi", "indonesian": "id", "japanese": "ja", "korean": "ko", "russian": "ru"}

#: Complexity features; a row's token count is one of them.
FEATURES = ("avg_links_len", "avg_max_depth", "avg_subordinate_chain_len", "avg_verb_edges", "lexical_density", "n_tokens")
#: The one name of the summed score, wherever it is produced or read.
SCORE = "complexity_score"

#: Tasks and the label column of each.
TASK_COLUMNS = {"question_type": "question_type", "complexity": SCORE} | {f: f for f in FEATURES}
SPLITS = ("train", "validation", "test")
SEEDS = (1, 2, 3)
MODELS = ("dummy", "logistic", "ridge", "xgboost")
CONTROLLED = ("question_type", "complexity", *FEATURES)


def dataset_configs() -> list[str]:
    """Names of the 25 dataset configurations: the base and three controls of each label."""
    return ["base", *(f"control_{label}_seed{seed}" for label in CONTROLLED for seed in SEEDS)]


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_A = T.ArrayType


def struct(**fields: T.DataType) -> T.StructType:
    """A schema of nullable fields; needs no session, so workers can import it."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def extended(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    """A copy of the schema with further fields."""
    return T.StructType([*schema.fields, *struct(**fields).fields])


_FEATURE_FIELDS = {f: _D for f in FEATURES}
QUESTION = struct(question_text=_S, language=_S, annotations=struct(yes_no_answer=_A(_S)))
CLASSIFIED = struct(question_text=_S, language=_S, annotation_class=_S, classifier_class=_S, agreement=_B, final_class=_S, included=_B)
SENTENCE = struct(file=_S, sent_ix=_L, text=_S, lines=_A(_S))
COMPLEXITY = struct(**_FEATURE_FIELDS, language=_S, type=_S)
DATASET = struct(doc_id=_L, text=_S, language=_S, question_type=_I, complexity_score=_D, **_FEATURE_FIELDS)
VECTORS = struct(split=_S, doc_id=_L, term_id=_I, tfidf=_D)
VOCABULARY = struct(term=_S, term_id=_I, df=_L, idf=_D)
TOKENIZED = struct(doc_id=_L, input_ids=_A(_I), attention_mask=_A(_I), label=_D)
HIDDEN = struct(doc_id=_L, layer=_I, tokens=_A(_A(_D)), mask=_A(_I))
_METRICS = struct(primary_metric=_S, primary_value=_D, accuracy=_D, precision=_D, recall=_D, f1=_D, mse=_D, r2=_D)
_CONFIG = struct(experiment_name=_S, language=_S, task=_S, model_type=_S, task_type=_S, config=_S, dataset_config=_S, experiment_type=_S, features_dir=_S, batch_name=_S)
_INFO = struct(samples=_L)
RESULT = struct(
    experiment_id=_S, timestamp=_S, status=_S, error=_S, language=_S, task=_S, model=_S, model_type=_S, model_class=_S, task_type=_S, train_time=_D, config=_CONFIG,
    train_metrics=_METRICS, val_metrics=_METRICS, test_metrics=_METRICS, data_shapes=struct(train=_A(_L), val=_A(_L), test=_A(_L)), train_info=_INFO, val_info=_INFO, test_info=_INFO,
)
RESULT_LONG = struct(experiment_type=_S, language=_S, task=_S, model=_S, metric=_S, value=_D)
TRACKER = struct(experiment_type=_S, language=_S, task=_S, submetric=_S, control_index=_S, layer_index=_I, metric=_S, value=_S)
IMPORTANCE = struct(task=_S, task_type=_S, language=_S, model_type=_S, feature_importance=_A(_D))
