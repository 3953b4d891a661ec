import pytest

#: Further columns whose names operators use themselves.
CLASHING = "node string, digest string, score double, keep_id string, size string, copies string, bucket int, label string, ids string, base string"
EXTRA = ("n", "d", 0.5, "k", "s", "c", 1, "l", "i", "b")
LONG = "word another word. " * 6000


def rows():
    """Nulls, empty and blank texts, ties, copies, near copies, repeated rows, a long text."""
    near = " ".join(f"w{i}" for i in range(60))
    texts = [
        (1, "Hello  world", "en", "a"), (2, "Hello world", "en", "a"), (3, None, "en", "a"), (4, "", None, None), (5, " \n\t", "de", "b"), (6, near, "en", "b"), (7, near + " extra", "en", None),
        (8, near.upper(), "fr", "b"), (9, LONG, "en", "c"), (9, LONG, "en", "c"), (None, "Hello world", "en", "a"), (None, None, None, None), (10, "one", "en", "c"), (11, "éß 中文 ok", "es", "c"), (12, "!!! ???", "en", "c"),
    ]
    return [(*t, 1, *EXTRA) for t in texts]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
