import json
import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiprobe.operators import grid, probes, results
from lexiprobe.plans import datasets, experiments, grouped, labelling
from lexiprobe.queries import documents, raw_rows
from lexiprobe.schemas import FEATURES, RESULT, SCORE, dataset_configs
from lexiprobe.sources import readers, shared
from lexiprobe.streaming.results import append_standardized


def test_complexity_csv_takes_names_and_skips_bad_files(spark, tmp_path):
    (tmp_path / "english_polar.csv").write_text("n_tokens,lexical_density\n5,0.5\n6,\n")
    (tmp_path / "finnish_content.csv").write_text("lexical_density,n_tokens,language\n0.1,7,suomi\n")
    (tmp_path / "noname.csv").write_text("n_tokens\n5\n")
    (tmp_path / "en_polar.csv").write_text("lexical_density\n0.5\n")
    got = sorted((r["language"], r["type"], r["n_tokens"], r["lexical_density"]) for r in readers.complexity_csv(spark, str(tmp_path)).collect())
    assert got == [("english", "polar", 5.0, 0.5), ("english", "polar", 6.0, None), ("suomi", "content", 7.0, 0.1)]


def test_conllu_reads_unterminated_sentences(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# text = Is it far?\n1\tIs\n2\tit\n\n# sent = No\n1\tNo\n\n1\tx")
    rows = readers.conllu(spark, str(tmp_path)).orderBy("sent_ix").collect()
    assert [(r["text"], len(r["lines"])) for r in rows] == [("Is it far?", 3), ("No", 2), (None, 1)]
    routed = labelling.label_treebank(spark, str(tmp_path), "en", str(tmp_path / "out"))
    assert sorted(r["bucket"] or "" for r in routed.collect()) == ["", "other", "polar"]
    counts = {r["file"]: r for r in labelling.bucket_counts(routed).collect()}
    assert counts[None]["sentences"] == 3 and counts[None]["polar"] == 1


def test_results_scan_skips_broken_files(spark, tmp_path):
    good = {"experiment_id": "x", "timestamp": "2025-01-01T00:00:00", "status": "completed", "config": {"language": "en", "task": "t", "model_type": "ridge", "config": "control_t_seed2"}, "model_type": "Ridge", "task": "", "test_metrics": {"mse": 0.5, "primary_metric": "mse"}, "data_shapes": {"test": [7, 9]}}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text("{ broken")
    r = results.standardized(readers.result_json(spark, str(tmp_path))).collect()
    assert len(r) == 1
    assert (r[0]["language"], r[0]["task"], r[0]["model_type"], r[0]["config_model"], r[0]["experiment_type"], r[0]["control_seed"], r[0]["test_mse"], r[0]["test_samples"], r[0]["train_time"]) == ("en", "t", "Ridge", "ridge", "control", 2, 0.5, 7, 0.0)


def test_feature_store_and_aliases(spark, tmp_path):
    v = readers.synthetic_features(spark, 40, 30)
    vocabulary = spark.range(30).select(F.concat(F.lit("t"), "id").alias("term"), F.col("id").cast("int").alias("term_id"), F.lit(1).cast("long").alias("df"), F.lit(1.0).alias("idf"))
    readers.write_features(v, vocabulary, str(tmp_path))
    assert readers.features(spark, str(tmp_path), "dev").count() == v.where("split = 'validation'").count() > 0
    assert v.select("doc_id").distinct().count() == 40
    assert spark.read.json(f"{tmp_path}/metadata").first()["n_features"] == 30


def test_dataset_partitions(spark, tmp_path):
    rows = readers.mock_dataset(spark, 20).withColumn("config", F.lit("base")).withColumn("split", F.lit("train"))
    readers.write_dataset(rows, str(tmp_path / "d"))
    assert readers.dataset(spark, str(tmp_path / "d"), "base", "train").count() == 20
    assert readers.missing_partitions(spark, str(tmp_path / "d")).count() == 3 * len(dataset_configs()) - 1
    with pytest.raises(ValueError):
        readers.dataset(spark, str(tmp_path / "d"), "nope")


def test_class_text_sink(spark, tmp_path):
    df = spark.createDataFrame([(" Is it? ", "en", "polar"), ("x", "en", None)], "question_text string, language string, final_class string")
    readers.write_class_text(df, str(tmp_path / "t"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["Is it?"]


def test_dataset_build_and_controls(spark, sf):
    raw = raw_rows(spark, sf).where("n_tokens <= 2000").withColumn("n_tokens", F.least("n_tokens", F.lit(90.0)))
    data = datasets.build(raw, train_rows=20, test_rows=10, dev_rows=20)
    splits = {r["split"]: r["count"] for r in data.groupBy("split").count().collect()}
    assert set(splits) == {"train", "validation", "test"}
    assert data.groupBy("doc_id").count().where("count > 1").isEmpty()
    both = datasets.with_controls(data, ("question_type",))
    assert both.select("config").distinct().count() == 4
    base = {r["doc_id"]: r["question_type"] for r in data.where("split = 'test'").collect()}
    assert all(base[r["doc_id"]] == r["question_type"] for r in both.where("split = 'test'").collect())


def test_batch_runs_cells_and_isolates_failures(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'")
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "validation").otherwise("test")
    data = docs.select("doc_id", "text", F.lit("en").alias("language"), split.alias("split"), F.lit("base").alias("config"), (F.col("doc_id") % 2).cast("int").alias("question_type"), (F.length("text") / 1000.0).alias("n_tokens"))
    cells = [{"language": "en", "task": "question_type", "model_type": "dummy", "config": "base"}, {"language": "en", "task": "n_tokens", "model_type": "ridge", "config": "base"}, {"language": "en", "task": "n_tokens", "model_type": "logistic", "config": "base"}]
    out = experiments.run_batch(data, cells, max_features=50)
    assert [d["status"] for d in out] == ["completed", "completed", "failed"] and "not for regression" in out[2]["error"]
    assert out[1]["test_metrics"]["mse"] >= 0


def test_cells_leave_the_features_where_they_are(spark, sf, monkeypatch):
    """Each cell moved the features of all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("doc_id", "text", F.lit("en").alias("language"), F.lit("train").alias("split"), F.lit("base").alias("config"))
    seen = []
    monkeypatch.setattr(experiments, "run_cell", lambda dataset, vectors, size, cell: seen.append(vectors) or {"experiment_id": experiments.experiment_id_of(cell)})
    experiments.run_batch(docs, [{"language": "en", "task": "n_tokens", "model_type": "dummy", "config": "base"}], max_features=50)
    by_document = seen[0].groupBy("doc_id").agg(F.collect_list("term_id").alias("e"))
    assert not by_document.isEmpty() and "Exchange" not in by_document._jdf.queryExecution().executedPlan().toString()


def test_refused_rows_are_reported(spark, tmp_path):
    (tmp_path / "en_polar.csv").write_text("n_tokens,lexical_density\n5,0.5\nsix,0.1\n\n,0.2\n")
    (tmp_path / "noname.csv").write_text("n_tokens\n5\n7\n")
    (tmp_path / "fi_polar.csv").write_text("lexical_density\n0.5\n")
    got = sorted(((r["language"], r["type"], r["reason"], r["n"]) for r in readers.load_report(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([("en", "polar", None, 3), ("en", "polar", "n_tokens is no number", 1), ("noname", None, "name without language and type", 2), ("fi", "polar", "no n_tokens", 1)], key=repr)


def test_a_killed_batch_goes_on_where_it_ended(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'")
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "validation").otherwise("test")
    data = docs.select("doc_id", "text", F.lit("en").alias("language"), split.alias("split"), F.lit("base").alias("config"), (F.col("doc_id") % 2).cast("int").alias("question_type"), (F.length("text") / 1000.0).alias("n_tokens"))
    cells = [{"language": "en", "task": t, "model_type": "dummy", "config": "base"} for t in ("question_type", "n_tokens")] + [{"language": "xx", "task": "n_tokens", "model_type": "ridge", "config": "base"}]
    store, ran, whole = str(tmp_path / "store"), [], experiments.run_cell

    def killed(dataset, vectors, size, cell):
        ran.append(cell["task"])
        if len(ran) >= 2:
            raise KeyboardInterrupt
        return whole(dataset, vectors, size, cell)

    monkeypatch.setattr(experiments, "run_cell", killed)
    with pytest.raises(KeyboardInterrupt):
        experiments.run_batch(data, cells, max_features=50, store=store, side_by_side=1)
    first = readers.stored_results(spark, store).collect()
    assert len(first) == 1 and first[0]["status"] == "completed"
    monkeypatch.setattr(experiments, "run_cell", lambda *a: ran.append(a[3]["task"]) or whole(*a))
    ran.clear()
    for _ in range(2):  # failed cells are tried again, completed ones are not
        out = experiments.run_batch(data, cells, max_features=50, store=store)
        assert [d["status"] for d in out] == ["completed", "completed", "failed"]
    assert sorted(ran) == ["n_tokens", "n_tokens", "n_tokens"]
    stored = readers.stored_results(spark, store).collect()
    assert len(stored) == 3 and first[0] in stored


def test_summaries_and_stream_agree(spark, sf, tmp_path):
    docs = documents(spark, sf)
    tables = experiments.summaries(docs)
    assert tables["all_results"].count() == 672 and tables["by_model_type"].count() == 12
    docs.coalesce(2).write.json(str(tmp_path / "in"))
    append_standardized(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 672 and got.where("status = 'completed'").count() == tables["successful_results"].count()
    assert set(RESULT.names) >= {"experiment_id", "config"}


def test_treebank_sentences_end_at_blank_lines_of_every_kind(spark, tmp_path):
    """CRLF, blanks on the empty line, several empty lines, no empty line at the end, blocks smaller than a sentence."""
    sentence = lambda k: [f"# text = words of {k}", *(f"{i}\tw{k}" for i in range(1, 4))]
    for name, line, blank in (("crlf", "\r\n", ""), ("spaces", "\n", " \t"), ("several", "\n", "\n"), ("wide", "\n", "\u3000"), ("old", "\r", "")):
        text = line.join([x for k in range(5) for x in (*sentence(k), blank)][:-1])
        (tmp_path / f"{name}.conllu").write_bytes(text.encode())
    want = [(f"words of {k}", sentence(k)) for k in range(5)]
    for size in ("128m", "50"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = readers.conllu(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        for name in ("crlf", "spaces", "several", "wide", "old"):
            of = sorted((r for r in rows if r["file"].endswith(f"{name}.conllu")), key=lambda r: r["sent_ix"])
            assert [(r["text"], r["lines"]) for r in of] == want, (name, size)


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_only_sentences_at_the_ends_of_blocks_are_moved(rows):
    """Runs of lines by block, whatever the batches: all but the first and last ones of a block stay where they are."""
    lines = [("f", b, "" if i % 6 in (3, 4) else f"{b}-{i}") for b in (0, 90) for i in range(38)] + [("g", 0, "x"), ("g", 0, "y")]
    want, at, sent = {}, None, 0
    for f, b, v in lines:
        at, sent = (f, b), (sent if (f, b) == at else 0) + (v == "")
        if v:
            want.setdefault((f, b, sent), []).append(v)
    kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_()]
    some = [[pa.array(c, k) for c, k in zip(zip(*[(f, b, v, v == "") for f, b, v in lines[i : i + rows]]), kinds)] for i in range(0, len(lines), rows)]
    got = {}
    for edges in (True, False):
        found = [tuple(r.values()) for batch in readers._pieces((pa.RecordBatch.from_arrays(c, names=list("fbve")) for c in some), edges) for r in batch.to_pylist()]
        assert all(k[:3] not in got for k in found)
        got |= {k[:3]: k[3] for k in found}
        assert len(found) == (5 if edges else len(want) - 5)
    assert got == want


def test_results_are_collected_from_a_tree(spark, tmp_path):
    for at, metrics in (("runs/question_type/dummy/en", {"accuracy": 0.5, "f1": None, "primary_metric": "accuracy"}), ("runs/complexity/ridge/fi/seed1", {"mse": 0.25, "r2": "no"}), ("runs/other/x/en", {"mse": 1.0})):
        (tmp_path / at).mkdir(parents=True)
        (tmp_path / at / "results.json").write_text(json.dumps({"test_metrics": metrics}))
    (tmp_path / "runs/complexity/bare/ar").mkdir(parents=True)
    (tmp_path / "runs/complexity/bare/ar/results.json").write_text("{}")
    got = sorted(map(tuple, readers.collected_results(spark, str(tmp_path)).collect()))
    assert got == [("tfidf", "en", "question_type", "dummy", "accuracy", 0.5), ("tfidf", "fi", "complexity", "ridge", "mse", 0.25)]
    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "deep/er/tfidf_results.csv").write_text("experiment_type,language,task,model,metric,value\ntfidf,ko,complexity,ridge,mse,0.75\n")
    assert [tuple(r) for r in readers.collected_results(spark, str(tmp_path)).collect()] == [("tfidf", "ko", "complexity", "ridge", "mse", 0.75)]


def test_recommended_probes_train(spark):
    rng = np.random.default_rng(0)
    rows = [("en", i, "test" if i % 5 == 0 else "train", float(i % 2), (rng.normal(size=8) + 3 * (i % 2) * np.array([1, -1] * 4)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "language string, doc_id long, split string, label double, embedding array<double>")
    for task in ("question_type", "complexity"):
        got = probes.probes(df, ("language",), **grid.probe_options(task) | {"lr": 5e-3}).collect()
        assert len(got) == 80 and not any(r["error"] for r in got)
        assert np.mean([(r["prediction"] > 0.5) == (r["label"] > 0.5) for r in got]) > 0.9


def test_tables_of_all_runs_can_be_cleared(spark):
    before, shared._written[:] = list(shared._written), []
    one = shared.Scratch(spark, "clear-test")
    kept = one.keep_by(spark.range(50).selectExpr("id AS k", "id * 2 AS v"), "rows", "k", 4)
    assert kept.selectExpr("sum(v)").first()[0] == 2450 and Path(one.path.removeprefix("file:")).exists()
    shared.clear(spark)
    assert not Path(one.path.removeprefix("file:")).exists() and not shared._written
    shared._written[:] = before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("kept_")]


def test_results_are_stored_by_id(spark, tmp_path):
    """A rerun replaces its documents; files of one document and of lines are both read."""
    rows = lambda docs: spark.createDataFrame([{"experiment_id": i, "status": s, "train_time": t} for i, s, t in docs], "experiment_id string, status string, train_time double")
    full = lambda df: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in RESULT.fields])
    store = str(tmp_path / "store")
    assert readers.stored_results(spark, store).count() == 0
    readers.write_results(full(rows([("a", "failed", 1.0), ("b", "completed", 2.0)])), store)
    readers.write_results(full(rows([("a", "completed", 3.0), ("c", "completed", 4.0)])), store)
    got = {r["experiment_id"]: (r["status"], r["train_time"]) for r in readers.stored_results(spark, store).collect()}
    assert got == {"a": ("completed", 3.0), "b": ("completed", 2.0), "c": ("completed", 4.0)}
    (tmp_path / "store" / "one.json").write_text('{\n  "experiment_id": "d",\n  "status": "completed"\n}')
    assert sorted(r["experiment_id"] for r in readers.result_json(spark, store).collect()) == ["a", "a", "b", "c", "d"]


def test_grouped_cells_equal_fits_row_by_row(spark):
    """The batch of all cells gives what a loop over rows gives, for dummies, ridge, stump and logistic regression."""
    draw = random.Random(3)
    rows = [(i, ("ar", "en")[i % 2], ("train", "train", "validation", "test")[i // 2 % 4], draw.randrange(16), draw.randrange(2), *[round(draw.random(), 3) for _ in range(7)]) for i in range(240)]
    names = ["doc_id", "language", "split", "x", "question_type", SCORE, *FEATURES]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n in ('language', 'split') else 'int' if n in ('x', 'question_type') else 'long' if n == 'doc_id' else 'double'}" for n in names))
    stats = grouped.statistics(df)
    got = {(r["config"]["language"], r["config"]["task"], r["config"]["model_type"]): r for r in grouped.documents(spark, stats).collect() if r["config"]["experiment_type"] == "main"}
    assert got["ru", "complexity", "ridge"]["status"] == "failed"
    for language in ("ar", "en"):
        part = lambda s: [(r[3], r[4], r[5]) for r in rows if r[1] == language and r[2] == s]
        train, test = part("train"), part("test")
        n, mean = len(train), sum(t[2] for t in train) / len(train)
        xm = sum(t[0] for t in train) / n
        w = sum((t[0] - xm) * (t[2] - mean) for t in train) / (sum((t[0] - xm) ** 2 for t in train) + 1)
        mse = sum((y - (mean + w * (x - xm))) ** 2 for x, _, y in test) / len(test)
        assert math.isclose(got[language, "complexity", "ridge"]["test_metrics"]["mse"], mse, rel_tol=1e-9)
        most = int(sum(t[1] for t in train) * 2 > n)
        assert math.isclose(got[language, "question_type", "dummy"]["test_metrics"]["accuracy"], sum(c == most for _, c, _ in test) / len(test))
        a = b = 0.0  # plain gradient descent on the penalised loss
        for _ in range(20000):
            p = [1 / (1 + math.exp(-(a * x / 8 + b))) for x, _, _ in train]
            a, b = a - 0.01 * (a + sum((q - c) * x / 8 for q, (x, c, _) in zip(p, train))), b - 0.01 * (b + sum(q - c for q, (_, c, _) in zip(p, train)))
        acc = sum((a * x / 8 + b > 0) == c for x, c, _ in test) / len(test)
        assert math.isclose(got[language, "question_type", "logistic"]["test_metrics"]["accuracy"], acc)
        best = max((sum(g for x, g in h if x <= t) ** 2 / (sum(x <= t for x, _ in h) + 1) + sum(g for x, g in h if x > t) ** 2 / (sum(x > t for x, _ in h) + 1), -t) for h in [[(x, 0.5 - y) for x, _, y in train]] for t in sorted({x for x, _ in h})[:-1])
        t = -best[1]
        leaf = lambda keep: -0.1 * sum(0.5 - y for x, _, y in train if keep(x)) / (sum(keep(x) for x, _, _ in train) + 1)
        low, high = leaf(lambda x: x <= t), leaf(lambda x: x > t)
        mse = sum((y - 0.5 - (low if x <= t else high)) ** 2 for x, _, y in test) / len(test)
        assert math.isclose(got[language, "complexity", "xgboost"]["test_metrics"]["mse"], mse, rel_tol=1e-9)
