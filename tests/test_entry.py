import ast
from pathlib import Path

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["language", "term", "mean_tfidf", "rank"] and df.count() > 0


def test_base_queries_do_not_need_the_training_data_part(monkeypatch):
    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert set(entry.queries()) == set(entry.base.QUERIES)


def test_nothing_else_imports_that_part():
    root = Path(entry.__file__).parent / "lexiprobe"
    files = [f for f in root.rglob("*.py") if "llm" not in f.relative_to(root).parts]
    assert len(files) > 20
    for f in files:
        for node in ast.walk(ast.parse(f.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import | ast.ImportFrom) else []
            module = getattr(node, "module", None) or ""
            assert not any("llm" in part.split(".") for part in (module, *names)), f
            assert not (isinstance(node, ast.Constant) and node.value in ("lexiprobe.llm", "corpus_pipeline")), f
