import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiprobe.operators import checks, grid, metrics, models, normalize, probes, projection, quantiles, results, sampling, tfidf
from lexiprobe.schemas import FEATURES, SCORE, dataset_configs


def test_tfidf_by_hand(spark):
    docs = [(0, "a b a"), (1, "b c"), (2, ""), (3, None), (4, "  c\n d ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = tfidf.Tfidf(min_df=1, max_df=1.0)
    got = {(r["doc_id"], r["term"]): r["tfidf"] for r in model.fit_transform(df).collect()}
    counts = {}
    for i, t in docs:
        w = (t or "").split()
        counts[i] = Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:])])
    n = len(docs)
    dfreq = Counter(t for c in counts.values() for t in c)
    for i, c in counts.items():
        w = {t: (1 + math.log(k)) * (math.log((1 + n) / (1 + dfreq[t])) + 1) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            assert got.pop((i, t)) == pytest.approx(x / norm)
    assert not got
    assert [r["term"] for r in model.vocabulary.orderBy("term_id").collect()] == sorted(dfreq)
    with pytest.raises(ValueError):
        tfidf.Tfidf().transform(df)


@pytest.mark.parametrize("file", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tfidf_over_subwords(spark, file):
    """Subword strings and their pairs, counted by the vocabulary's own library."""
    path = public_tokenizers.path(file)
    docs = [(0, "Is Lima the capital of Peru?"), (1, "Mik\u00e4 on Perun p\u00e4\u00e4kaupunki?"), (2, None), (3, ""), (4, "\u9996\u90fd\u306f\u3069\u3053\u3067\u3059\u304b\uff1f Lima Lima")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cut = sentencepiece.SentencePieceProcessor(model_file=path).encode_as_pieces if file.endswith(".model") else lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).tokens
    want = Counter()
    for i, t in docs:
        w = list(cut(t or ""))
        want.update((i, x) for x in w + [f"{x} {y}" for x, y in zip(w, w[1:])])
    model = tfidf.Tfidf(min_df=1, max_df=1.0, tokenizer=tfidf.subwords(path))
    assert {(r["doc_id"], r["term"]): r["tf"] for r in model.counts(df).collect()} == want
    assert {(r["doc_id"], r["term"]) for r in model.fit_transform(df).collect()} == set(want)


def test_ngrams_of_any_order(spark):
    texts = ["", "a", "a b", "a b c d e"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tfidf.tokens(F.col("t")).alias("w"))
    for least, most in ((1, 1), (1, 2), (2, 2), (2, 3), (1, 4)):
        for r in df.select("t", tfidf.ngrams(F.col("w"), least, most).alias("g")).collect():
            w = r["t"].split()
            assert r["g"] == [" ".join(w[k : k + n]) for n in range(least, most + 1) for k in range(len(w) - n + 1)]


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 5)), rng.normal(size=60)
    df = spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], ["doc_id", "features", "label"])
    model = models.ridge(df, 1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(model.coefficients.toArray(), np.linalg.solve(xc.T @ xc + np.eye(5), xc.T @ yc), atol=1e-6)


def test_logistic_penalises_its_intercept(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=80) > 0.4).astype(float)
    df = spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], ["doc_id", "features", "label"])
    model = models.PenalisedLogistic().fit(df)
    a, w = np.hstack([x, np.ones((80, 1))]), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.eye(4), a.T @ (p - y) + w)
    assert np.allclose([*model.coefficients, model.intercept], w, atol=1e-4)
    assert set(r["prediction"] for r in model.transform(df).collect()) <= {0.0, 1.0}


def test_minmax_leaves_constants_and_scales_by_group(spark):
    df = spark.createDataFrame([("a", None, 1.0, 5.0), ("a", None, 3.0, 5.0), ("b", "x", 7.0, None)], "language string, type string, n_tokens double, lexical_density double").withColumn("source", F.lit("s"))
    got = sorted((r["language"], r["n_tokens"], r["lexical_density"]) for r in normalize.minmax(df, ("n_tokens", "lexical_density")).collect())
    assert got == [("a", 0.0, 5.0), ("a", 1.0, 5.0), ("b", 7.0, None)]


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.0005,), (0.0015,), (2.6745,)], "x double")
    assert [r["x"] for r in normalize.rounded(df).collect()] == [0.0, 0.002, 2.674]


def test_score_of_nulls_is_zero(spark):
    df = spark.createDataFrame([(None, None), (1.0, 2.0)], "n_tokens double, lexical_density double")
    assert [r[SCORE] for r in normalize.scored(df).collect()] == [0.0, 3.0]


def test_classification_by_hand(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, prediction int")
    m = metrics.classification(df).first()
    assert (m["accuracy"], m["binary_precision"], m["binary_recall"]) == (0.75, 1.0, 0.5)
    assert m["f1"] == pytest.approx(0.5 * (2 / 3) + 0.5 * 0.8)
    assert metrics.classification(spark.createDataFrame([(1, 0)], "label int, prediction int")).first()["precision"] == 0.0


def test_regression_by_hand(spark):
    m = metrics.regression(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "label double, prediction double")).first()
    assert (m["mse"], m["r2"], m["mae"]) == (0.5, 0.5, 0.5)


def test_grid_counts(spark):
    g = grid.experiment_grid(spark)
    assert g.count() == 672 and g.select("experiment_id").distinct().count() == 672
    assert {r["experiments"] for r in grid.grid_sizes(g).collect()} == {21, 63, 126, 378}
    assert grid.layer_grid(spark).count() == 2688 and grid.finetune_grid(spark).count() == 224
    assert len(dataset_configs()) == 25 and grid.valid_configuration() == []
    one = g.where("language = 'ar' AND task = 'complexity' AND model_type = 'ridge' AND control_index IS NULL").first()
    assert one["experiment_id"] == grid.experiment_id_of({"config": "base", "experiment_type": "main", "language": "ar", "model_type": "ridge", "task": "complexity", "task_type": "regression"})


def test_remaining_stops_after_two_failures(spark):
    g = spark.createDataFrame([("a",), ("b",), ("c",)], "experiment_id string")
    done, failed = g.where("experiment_id = 'a'"), spark.createDataFrame([("b",), ("b",), ("c",)], "experiment_id string")
    assert [r[0] for r in grid.remaining(g, done, failed).collect()] == ["c"]


def test_samples_keep_small_groups_and_are_stable(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 5, "s").otherwise("l").alias("g"), (F.col("id") % 37).cast("double").alias("n_tokens"))
    a = sorted(r["doc_id"] for r in sampling.token_sample(df, 50, ["g"]).collect())
    assert a == sorted(r["doc_id"] for r in sampling.token_sample(df.repartition(7), 50, ["g"]).collect())
    assert {0, 1, 2, 3, 4} <= set(a) and len(a) <= 55


def test_shuffle_keeps_each_language_s_labels(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("language"), F.col("id").alias("y"))
    got = sampling.shuffled_labels(df, "y").collect()
    assert len(got) == 150
    for seed in (1, 2, 3):
        for lang in "01":
            labels = sorted(r["y"] for r in got if r["seed"] == seed and r["language"] == lang)
            assert labels == [i for i in range(50) if str(i % 2) == lang]


def test_distribution_matching_returns_the_target(spark):
    pool = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") / 300.0).alias(SCORE), F.lit(5.0).alias("n_tokens"))
    ref = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") / 800.0).alias(SCORE), F.lit(5.0).alias("n_tokens"))
    got = sampling.match_distribution(pool, ref, 40).collect()
    assert len(got) == 40 and sum(r[SCORE] <= 0.55 for r in got) >= 36
    assert sampling.match_distribution(pool.limit(10), ref, 40).count() == 10


def test_targets_and_labels(spark):
    assert projection.resolve_target("single_submetric", "n_tokens") == "n_tokens" and projection.task_type("n_tokens") == "regression"
    with pytest.raises(ValueError):
        projection.resolve_target("single_submetric")
    df = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, question_type int")
    assert [r["label"] for r in projection.with_label(df, "question_type").collect()] == [0, 1]
    with pytest.raises(ValueError, match="there are"):
        projection.with_label(df, "complexity")
    with pytest.raises(ValueError):
        projection.require_rows(df.where("false"), "x")


def test_estimators_refuse_what_they_cannot_do():
    for model, kind in (("logistic", "regression"), ("ridge", "classification"), ("dummy", "ranking")):
        with pytest.raises(ValueError):
            models.estimator(model, kind)


def test_experiment_document(spark):
    rng = np.random.default_rng(2)
    rows = [(i, Vectors.dense(rng.normal(size=4)), float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, ["doc_id", "features", "label"])
    doc = models.experiment("ridge", "regression", {"train": df, "test": df})
    assert doc["status"] == "completed" and doc["test_metrics"]["primary_metric"] == "mse" and len(doc["feature_importance"]["values"]) == 4
    doc = models.experiment("dummy", "classification", {"train": df, "test": df})
    assert doc["test_metrics"]["accuracy"] == 0.5 and "feature_importance" not in doc


def test_probes_report_failures(spark):
    df = spark.createDataFrame([(0, 1, "test", 1.0, [1.0, 2.0]), (1, 1, "train", 1.0, [1.0, 2.0]), (1, 2, "train", 0.0, [2.0, 1.0]), (1, 3, "test", 0.0, [2.0, 1.0])], "layer int, doc_id long, split string, label double, embedding array<double>")
    got = {r["layer"]: r for r in models.probes(df, ("layer",), 2, epochs=3).collect()}
    assert "no training rows" in got[0]["error"] and got[1]["error"] is None


@pytest.mark.parametrize(
    "options",
    [
        {"activation": a} for a in ("relu", "gelu", "tanh", "sigmoid", "silu", "swish", "leaky_relu", "softplus", "no such name")
    ]
    + [{"normalization": n, "hidden": (5, 4)} for n in ("layer", "batch")] + [{"bias": False}, {"hidden": ()}, {"hidden": (), "rank": 2}, {"hidden": (), "weight_norm": True}]
    + [{"init": i} for i in ("normal", "small", "kaiming", "orthogonal", "other")],
)
def test_gradients_equal_differences(options):
    """Every layer's gradient against the difference quotient of the loss."""
    draw = np.random.default_rng(0)
    x, goal = draw.normal(size=(7, 6)), np.eye(3)[draw.integers(0, 3, 7)]
    probe = probes.Probe(probes.layers(6, 3, **({"hidden": (5,)} | options), draw=draw), 0, 1, 3, 0, 1)
    loss = lambda: -np.log((probe.forward(x, draw) * goal).sum(1)).mean()
    probe.backward((probe.forward(x, draw) - goal) / len(x))
    grads = [[g.copy() for g in layer.grads] for layer in probe.stack]
    for layer, own in zip(probe.stack, grads):
        for p, g in zip(layer.params, own, strict=True):
            for _ in range(5):
                at = tuple(draw.integers(0, n) for n in p.shape)
                p[at] += 1e-5
                up = loss()
                p[at] -= 2e-5
                down = loss()
                p[at] += 1e-5
                assert g[at] == pytest.approx((up - down) / 2e-5, abs=2e-5)


def test_initial_weights():
    draw = np.random.default_rng(1)
    for how, spread in (("normal", 0.02), ("small", 0.01), ("xavier", (2 / 500) ** 0.5), ("kaiming", (2 / 300) ** 0.5)):
        assert probes.initial(how, 300, 200, draw).std() == pytest.approx(spread, rel=0.05)
    for shape in ((30, 20), (20, 30)):
        w = probes.initial("orthogonal", *shape, draw)
        assert np.allclose(w.T @ w if shape[0] > shape[1] else w @ w.T, np.eye(20))


def test_probes_predict_where_rows_are(spark):
    """Groups of different vectors; only training rows are gathered, and at most the wanted number."""
    rng = np.random.default_rng(2)
    rows = []
    for layer in ("a", None):
        for i in range(300):
            v = rng.normal(size=4)
            rows.append((layer, i, "train" if i % 3 else "test", float(v[0] > 0), v.tolist()))
    df = spark.createDataFrame(rows, "layer string, doc_id long, split string, label double, embedding array<double>")
    for options in ({"kind": "linear"}, {"hidden": (16,), "activation": "gelu", "normalization": "layer", "dropout": 0.1}, {"most_rows": 50}):
        got = probes.probes(df, ("layer",), 2, epochs=40, lr=0.02, **options).collect()
        assert sorted((r["layer"] or "", r["doc_id"]) for r in got) == sorted((r[0] or "", r[1]) for r in rows if r[2] == "test")
        assert np.mean([r["label"] == r["prediction"] for r in got]) > 0.85 and not any(r["error"] for r in got)


def test_models_are_saved_and_loaded(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, Vectors.dense(a), float(a[0] > 0)) for i, a in enumerate(x)], ["doc_id", "features", "label"])
    model = models.PenalisedLogistic().fit(df)
    model.save(f"{tmp_path}/logistic")
    again = models.PenalisedLogistic.load(spark, f"{tmp_path}/logistic")
    shown = lambda m: [tuple(r) for r in m.transform(df).select("doc_id", "probability", "prediction").orderBy("doc_id").collect()]
    assert shown(model) == shown(again) and np.allclose(model.coefficients, again.coefficients)
    assert shown(model)[0][1] == pytest.approx(1 / (1 + math.exp(-(x[0] @ model.coefficients + model.intercept))))
    for kind in (True, False):
        dummy = models.Dummy.fit(df, kind)
        dummy.save(f"{tmp_path}/dummy")
        assert models.Dummy.load(spark, f"{tmp_path}/dummy").transform(df).first()["prediction"] == dummy.transform(df).first()["prediction"]


def test_what_a_model_lacks_is_recorded():
    assert not models.unhonoured("xgboost", "regression") and not models.unhonoured("logistic", "classification", {"penalty": "l1"})
    assert models.unhonoured("ridge", "regression", {"solver": "svd"}) == {"solver": "svd"} and not models.unhonoured("logistic", "classification")


def test_mlp_learns():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(int)
    for act in ("relu", "tanh", "silu"):
        assert (models.mlp(x, y, 2, hidden=(32,), epochs=200, lr=0.02, activation=act, patience=60)(x).argmax(1) == y).mean() > 0.9
    line = models.mlp(x, 3 * x[:, 0] + 1, 0, hidden=(), epochs=100, lr=0.05)(x)
    assert np.corrcoef(line, x[:, 0])[0, 1] > 0.99


def test_pooling_of_an_empty_mask(spark):
    df = spark.createDataFrame([(1, 0, [[1.0, 2.0], [3.0, 4.0]], [0, 0]), (2, 0, [[1.0, 2.0], [3.0, 4.0]], [1, 1])], "doc_id long, layer int, tokens array<array<double>>, mask array<int>")
    got = {r["doc_id"]: r["embedding"] for r in models.pooled(df).collect()}
    assert got == {1: [0.0, 0.0], 2: [2.0, 3.0]}


def test_checks(spark):
    long = spark.createDataFrame([("a", "t", "m", "accuracy", 1.2), ("a", "t", "m", "mse", -1.0), ("a", "t", "m", "r2", float("nan")), ("a", "t", "m", "f1", None), ("a", "t", "m", "f1", 0.5)], "language string, task string, model string, metric string, value double")
    assert sorted(r["check"] for r in checks.metric_ranges(long).collect()) == ["missing", "negative mse", "not finite", "outside 0..1"]
    assert checks.positive_definite([[2, 0], [0, 1]]) and not checks.positive_definite([[1, 2], [2, 1]])
    assert checks.within(1, 2) and not checks.within(float("nan"), 2)
    assert checks.required_fields(long, ["task", "zzz"]) == ["zzz"]
    df = spark.createDataFrame([(1, [1, 2], [1]), (2, [1], [1])], "doc_id long, a array<int>, b array<int>")
    assert [r["doc_id"] for r in checks.unequal_lengths(df, ["a", "b"]).collect()] == [1]


def test_json_checks(tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text('{"x": 1}')
    bad.write_text("{")
    assert checks.json_problems(str(good), ["x", "y"]) == ["no key y"] and checks.json_problems(str(bad), [])[0].startswith("unreadable")
    assert checks.missing_files([str(good), str(tmp_path / "c")]) == [str(tmp_path / "c")]


def test_unique_pivot_refuses_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "layer int, language string, value double")
    with pytest.raises(ValueError):
        results.unique_pivot(df, ("layer",), "language", ["a"], "value")


def test_error_categories_first_match_wins(spark):
    df = spark.createDataFrame([("Timeout importing MEMORY",), ("shape timeout",), ("?",), (None,)], "e string")
    assert [r[0] for r in df.select(results.error_category(F.col("e"))).collect()] == ["memory", "timeout", "other", None]


def test_features_are_the_six(spark):
    assert len(FEATURES) == 6


def test_boosting_curve_and_saved_models(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, Vectors.dense(x), float(x[0] > 0)) for i, x in enumerate(rng.normal(size=(60, 3)))]
    df = spark.createDataFrame(rows, ["doc_id", "features", "label"])
    model = models.estimator("xgboost", "regression", {"n_estimators": 4, "max_depth": 2, "subsample": 1.0})(df)
    curve = models.boosting_curve(model, df)
    assert len(curve) == 4 and curve[-1] <= curve[0]
    shown = lambda m: [r["prediction"] for r in m.transform(df).orderBy("doc_id").collect()]
    assert math.isclose(curve[-1], np.mean([(p - r[2]) ** 2 for p, r in zip(shown(model), rows)]))
    model.save(str(tmp_path / "m"))
    assert shown(models.Boosted.load(spark, str(tmp_path / "m"))) == shown(model)
    assert np.allclose(models.importances(model).sum(), 1)


def test_sparse_vectors_need_no_python(spark):
    vectors = spark.createDataFrame([(1, 4, 0.5), (1, 2, 0.25), (2, 0, 1.0)], "doc_id long, term_id int, tfidf double")
    labels = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 1.0)], "doc_id long, label double")
    df = models.sparse_rows(vectors, labels, 6)
    got = {r["doc_id"]: r["features"] for r in df.collect()}
    assert got == {1: Vectors.sparse(6, {2: 0.25, 4: 0.5}), 2: Vectors.sparse(6, {0: 1.0}), 3: Vectors.sparse(6, {})}
    back = models.vector_entries(df)
    assert sorted(map(tuple, back.collect())) == [(1, 2, 0.25), (1, 4, 0.5), (2, 0, 1.0)]
    assert "Python" not in back._jdf.queryExecution().toString()
    assert models.PenalisedLogistic(penalty="l1").fit(df).transform(df).count() == 3


def test_dummy_strategies(spark):
    train = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("a", 1), (None, 2), (None, None)], "g string, label int")
    test = spark.createDataFrame([(i, ("a", None)[i % 2], i % 3) for i in range(400)] + [(None, "a", 0), (7, "absent", 1)], "doc_id long, g string, label int")
    for strategy in models.CLASS_STRATEGIES:
        got = models.dummy_classifier(train, test, by=("g",), strategy=strategy, constant=9, key="doc_id").collect()
        assert len(got) == 402
        mine = [r["prediction"] for r in got if r["g"] == "a"]
        share = np.mean([p == 1 for p in mine])
        assert {"most_frequent": share == 1, "prior": share == 1, "stratified": 0.65 < share < 0.85, "uniform": 0.4 < share < 0.6, "constant": set(mine) == {9}}[strategy]
        if strategy != "constant":
            assert {r["prediction"] for r in got if r["g"] is None} == {2} and [r["prediction"] for r in got if r["g"] == "absent"] == [None]
    values = {"mean": 0.75, "median": 1.0, "quantile": 0.3, "constant": 9}
    for strategy in models.VALUE_STRATEGIES:
        got = models.dummy_regressor(train, test, by=("g",), strategy=strategy, constant=9, quantile=0.1).collect()
        assert len(got) == 402 and math.isclose([r["prediction"] for r in got if r["g"] == "a"][0], values[strategy])
    for call in (models.dummy_classifier, models.dummy_regressor):
        with pytest.raises(ValueError, match="unknown strategy"):
            call(train, test, strategy="guess")
    with pytest.raises(ValueError, match="unknown strategy"):
        models.estimator("dummy", "classification", {"strategy": "mean"})


def test_sampling_loses_no_rows_to_nulls(spark):
    rows = [(None if i % 10 == 0 else i, None if i % 7 == 0 else "en", "polar", float(i % 13)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, language string, type string, n_tokens double")
    group = ("language", "type")
    assert sampling.hold_out(df, group, 5).count() == 100
    assert sampling.split(df, group).count() == 100
    assert sampling.token_bins(df, group).count() == 100
    assert sampling.token_sample(df, 1000, group).count() == 100
    assert sampling.token_sample(df, 10, group).groupBy("language").count().where("count <= 10").count() == 2
    shuffled = sampling.shuffled_labels(df, "n_tokens", (1, 2))
    assert shuffled.count() == 200 and sorted(r["n_tokens"] for r in shuffled.where("seed = 1").collect()) == sorted(r[3] for r in rows)


@pytest.mark.parametrize("buckets", [2, 7, 256])
def test_quantiles_equal_the_exact_ones(spark, buckets):
    draw = np.random.default_rng(buckets)
    rows = [(None if i % 3 == 0 else f"g{i % 3}", float(v) if i % 11 else None) for i, v in enumerate(np.concatenate([draw.normal(size=300), draw.integers(0, 4, 300)]))]
    df = spark.createDataFrame([*rows, ("one", 4.0), ("none", None)], "g string, x double")
    at = [0.0, 0.1, 0.25, 0.5, 1 / 3, 0.9, 1.0]
    got = {r["g"]: (r["p"], r["n"]) for r in quantiles.quantiles(df, "x", at, ("g",), buckets).collect()}
    for g in (None, "g1", "g2", "one"):
        v = [x for k, x in [*rows, ("one", 4.0)] if k == g and x is not None]
        assert np.allclose(got[g][0], np.quantile(v, at)) and got[g][1] == len(v)
    assert "none" not in got
    assert np.allclose(quantiles.quantiles(df, "x", at, buckets=buckets).first()["p"], np.quantile([x for _, x in rows if x is not None] + [4.0], at))


def test_missing_splits_terms_and_sparsity(spark):
    v = spark.createDataFrame([("train", 1, 0, 0.5), ("train", 2, 7, 0.5)], "split string, doc_id long, term_id int, tfidf double")
    vocabulary = spark.createDataFrame([("a", 0)], "term string, term_id int")
    assert sorted(r["split"] for r in checks.missing_splits(v).collect()) == ["test", "validation"]
    assert [r["term_id"] for r in checks.foreign_terms(v, vocabulary).collect()] == [7]
    assert checks.sparsity(v, 10, 0.8).count() == 0 and checks.sparsity(v, 1, 0.5).count() == 1


def test_dataset_integrity_reports_what_lacks(spark):
    df = spark.createDataFrame([("train", "en"), ("test", "fi")], "split string, language string")
    assert checks.dataset_integrity(df, ["split", "text"], ["en", "fi"]) == {"splits": False, "columns": False, "languages": True}


def test_incompatible_results_and_grid_coverage(spark):
    df = spark.createDataFrame([("logistic", "regression", "en", "complexity"), ("ridge", "regression", "en", "complexity")], "model_type string, task_type string, language string, task string")
    assert [r["model_type"] for r in checks.incompatible(df).collect()] == ["logistic"]
    assert checks.grid_coverage(df).where("dimension = 'language'").count() == 6
