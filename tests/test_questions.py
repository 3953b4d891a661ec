import pytest
from pyspark.sql import functions as F

from lexiprobe import queries
from lexiprobe.functions import questions as q
from lexiprobe.functions.annotations import answered, unanimous, yes_count
from lexiprobe.sentences import SENTENCES


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.createDataFrame([(i, s[0], s[1]) for i, s in enumerate(SENTENCES)], "i int, language string, text string")
    t, lang = F.col("text"), F.col("language")
    rows = df.select("i", q.qa_class(t, lang).alias("qa"), q.ud_class(t, lang).alias("ud"), q.is_question(t).alias("asks"), q.is_filtered(t).alias("out"), q.ja_wh(t).alias("wh")).collect()
    return {r["i"]: r for r in rows}


@pytest.mark.parametrize("i", range(len(SENTENCES)))
def test_sentence(labelled, i):
    language, text, qa, ud, asks, out, wh = SENTENCES[i]
    r = labelled[i]
    assert (r["qa"], r["ud"], r["asks"], r["out"]) == (qa, ud, asks, out), text
    if language == "ja":
        assert r["wh"] == wh


def test_null_text_and_unknown_language(spark):
    df = spark.createDataFrame([(None, "en"), ("Is it far?", None), ("Is it far?", "xx")], "text string, language string")
    rows = df.select(q.qa_class(F.col("text"), F.col("language")).alias("qa"), q.ud_bucket(F.col("text"), F.col("language")).alias("b")).collect()
    assert [r["qa"] for r in rows] == [None, None, None]
    assert rows[0]["b"] is None and rows[1]["b"] == rows[2]["b"] == "unclassified"


def test_token_limits(spark):
    df = spark.createDataFrame([("a b",), ("a b c",), (" ".join("a" * 40),), (" ".join("a" * 41),)], "text string")
    assert [r[0] for r in df.select(q.is_filtered(F.col("text"))).collect()] == [True, False, False, True]


@pytest.mark.parametrize(
    ("answers", "any_", "same", "yes"),
    [(None, False, True, 0), ([], False, True, 0), (["YES"], True, True, 1), (["NONE"], False, True, 0), (["YES", "NO"], True, True, 1), (["YES", "NONE"], True, False, 1), (["NONE", "NONE"], False, True, 0), ([None, "YES"], True, False, 1)],
)
def test_annotations(spark, answers, any_, same, yes):
    r = spark.createDataFrame([(answers,)], "a array<string>").select(answered(F.col("a")), unanimous(F.col("a")), yes_count(F.col("a"))).first()
    assert tuple(r) == (any_, same, yes)


def test_rules_over_tables_equal_the_labels(spark, tmp_path):
    """The queries over whole tables, given the labelled sentences as lines of turns and documents."""
    code = {name: k for k, name in enumerate(queries._TURN_LANGUAGES)}
    turns = [(7 * i, code[s[0]], "user", s[1] + "\nLima") for i, s in enumerate(SENTENCES) if s[0] in code]
    spark.createDataFrame([*turns, (3, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {(r["conv_id"], r["line"]): r for r in queries.question_rules_conversations(spark, str(tmp_path)).collect()}
    assert len(rows) == 2 * len(turns)
    for i, (language, text, qa, ud, asks, out, _) in enumerate(SENTENCES):
        if language in code:
            r = rows[7 * i, 0]
            bucket = "other" if not asks else "filtered" if out else ud or "unclassified"
            assert (r["language"], r["qa"], r["ud"], r["question"], r["rejected"], r["bucket"]) == (language, qa, ud, asks, out, bucket)
    documents = [(7 * i + code[s[0]], s[1][:-1], "x") for i, s in enumerate(SENTENCES) if s[0] in code and s[1].endswith("?")]
    spark.createDataFrame(documents, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["file"]: r for r in queries.ud_buckets_documents(spark, str(tmp_path)).collect()}
    asked = [s for s in SENTENCES if s[0] in code and s[1].endswith("?")]
    for name in ("polar", "content"):
        assert got["x"][name] == got[None][name] == sum(s[4] and not s[5] and s[3] == name for s in asked)
    assert got["x"]["filtered"] == sum(s[4] and s[5] for s in asked) and got["x"]["sentences"] == len(asked)
