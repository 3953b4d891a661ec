"""Queries over the standard tables, and the SQL that gives the same rows.

The tables hold no questions and no experiments. So texts stand in for questions where volume counts,
hand-labelled sentences dealt to the documents where labels count; experiments are baselines of one
binned measure that are fitted on the documents' rows, and SQL fits them again. Syntactic features
are inputs of the published pipeline; here simple text measures take their places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import annotations as ann
from .functions import questions as q
from .operators import boosting, checks, grid, linear, metrics, models, normalize, projection, results, sampling, tfidf
from .plans import datasets, experiments, grouped, labelling
from .schemas import FEATURES, LANGUAGES, MODELS, RESULT, SCORE, dataset_configs
from .sentences import SENTENCES
from .sources import readers, shared
from .sources.shared import Scratch, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The columns rounded half to even, without negative zeros."""
    return df.withColumns({c: F.bround(c, digits) + F.lit(0.0) if df.schema[c].dataType.simpleString() == "double" else F.bround(c, digits) for c in columns})


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- TF-IDF: T1-T12, S5-S7, S15, S25, S26 -------------------------------------------------------

MIN_DF, MAX_FEATURES = tfidf.MIN_DF, tfidf.MAX_FEATURES


def _train(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id % 10 < 7")


def _features(spark: SparkSession, sf: str, keep: bool = True):
    """(documents, counts of the vocabulary's terms if they are to be kept, vocabulary), fitted on seven tenths of the documents."""
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    model = tfidf.Tfidf(MAX_FEATURES, MIN_DF).fit(_train(docs))
    return docs, model.kept_counts(docs) if keep else None, model.vocabulary


_TERMS = f"""
toks AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(w) AS term FROM toks
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM toks WHERE len(w) > 1
),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents WHERE doc_id % 10 < 7),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS total FROM counts WHERE doc_id % 10 < 7 GROUP BY term),
top AS (SELECT term, df FROM dfs, n WHERE df >= {MIN_DF} AND df <= 0.95 * n ORDER BY total DESC, term LIMIT {MAX_FEATURES}),
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, df, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM top, n),
w AS (SELECT doc_id, term, term_id, (1 + ln(tf)) * idf AS w FROM counts JOIN vocab USING (term)),
vectors AS (SELECT doc_id, term, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w)
"""


@query("tfidf_top_terms_by_lang", f"""WITH {_TERMS}, nl AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
m AS (SELECT lang AS language, term, round_even(sum(tfidf) / any_value(nl.n), 9) AS mean_tfidf FROM vectors JOIN documents USING (doc_id) JOIN nl USING (lang) GROUP BY lang, term),
k AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY mean_tfidf DESC, term) AS rank FROM m WHERE mean_tfidf > 0)
SELECT language, term, round_even(mean_tfidf, 6) AS mean_tfidf, rank FROM k WHERE rank <= 10""")
def tfidf_top_terms_by_lang(spark, sf):
    docs, counts, vocabulary = _features(spark, sf)
    return r6(tfidf.top_by_language(tfidf.transform(counts, vocabulary), docs.select("doc_id", F.col("lang").alias("language"))), "mean_tfidf")


@query("tfidf_vocab", f"WITH {_TERMS} SELECT term, term_id, df, round_even(idf, 6) AS idf FROM vocab")
def tfidf_vocab(spark, sf):
    return r6(_features(spark, sf, keep=False)[2], "idf")


@query("tfidf_weights", f"WITH {_TERMS} SELECT doc_id, count(*) AS terms, round_even(sum(tfidf), 6) AS l1, round_even(max(tfidf), 6) AS largest FROM vectors GROUP BY doc_id")
def tfidf_weights(spark, sf):
    _, counts, vocabulary = _features(spark, sf)
    return r6(tfidf.transform(counts, vocabulary).groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tfidf").alias("l1"), F.max("tfidf").alias("largest")), "l1", "largest")


@query("tfidf_subword_terms")
def tfidf_subword_terms(spark, sf):
    """The vocabulary over subwords and pairs of them, as the published feature sets have it."""
    import public_tokenizers

    docs = read(spark, sf, "documents").select("doc_id", "text")
    model = tfidf.Tfidf(MAX_FEATURES, MIN_DF, tokenizer=tfidf.subwords(public_tokenizers.path("piece_bpe_32k.model")))
    return r6(model.fit(_train(docs)).vocabulary, "idf")


@query("tfidf_doc_stats", f"""WITH {_TERMS}, per AS (SELECT d.doc_id, count(v.term) AS nnz FROM documents d LEFT JOIN vectors v USING (doc_id) GROUP BY d.doc_id), k AS (SELECT count(*) AS k FROM vocab)
SELECT count(*) AS n_samples, CAST(sum(nnz) AS BIGINT) AS nnz, round_even(avg(nnz), 9) AS mean_nnz, min(nnz) AS min_nnz, max(nnz) AS max_nnz, quantile_cont(nnz, 0.5) AS median_nnz, any_value(k) AS n_features,
round_even(1 - sum(nnz) / (count(*) * any_value(k)), 9) AS sparsity, round_even(sum(nnz) / (count(*) * any_value(k)), 9) AS density FROM per, k""")
def tfidf_doc_stats(spark, sf):
    docs, counts, vocabulary = _features(spark, sf)
    stats = tfidf.document_stats(tfidf.transform(counts, vocabulary), docs, 1)
    size = vocabulary.agg(F.count("*").alias("k"))  # one row
    density = F.col("nnz") / (F.col("n_samples") * F.col("k"))
    out = stats.drop("n_features", "sparsity", "density").crossJoin(F.broadcast(size)).withColumn("sparsity", 1 - density).withColumn("density", density).withColumnRenamed("k", "n_features")
    return r6(out, "mean_nnz", "sparsity", "density", digits=9)


@query("tfidf_df_top20", f"WITH {_TERMS} SELECT term, df FROM vocab ORDER BY df DESC, term LIMIT 20")
def tfidf_df_top20(spark, sf):
    return tfidf.top_by_document_frequency(_features(spark, sf, keep=False)[2])


@query("tfidf_top_of_documents", f"""WITH {_TERMS}, f AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3),
k AS (SELECT doc_id, term, round_even(tfidf, 9) AS tfidf FROM vectors JOIN f USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS rank FROM k)
SELECT doc_id, term, round_even(tfidf, 6) AS tfidf, rank FROM o WHERE rank <= 10""")
def tfidf_top_of_documents(spark, sf):
    _, counts, vocabulary = _features(spark, sf)
    return r6(tfidf.top_of_documents(tfidf.transform(counts, vocabulary)), "tfidf")


_SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END"


@query("tfidf_split_stats", f"""WITH {_TERMS} SELECT {_SPLIT} AS split, count(DISTINCT doc_id) AS n_samples, count(*) AS nnz, (SELECT count(*) FROM vocab) AS n_features,
round_even(1 - count(*) / (count(DISTINCT doc_id) * (SELECT count(*) FROM vocab)), 6) AS sparsity FROM vectors GROUP BY split""")
def tfidf_split_stats(spark, sf):
    _, counts, vocabulary = _features(spark, sf)
    scratch = Scratch(spark, "features")  # through the feature store and back
    readers.write_features(tfidf.transform(counts, vocabulary).select(F.expr(_SPLIT).alias("split"), "doc_id", "term_id", "tfidf"), vocabulary, scratch.path)
    return r6(tfidf.split_stats(readers.features(spark, scratch.path), readers.vocabulary(spark, scratch.path)), "sparsity")


@query("vocab_lengths", f"WITH {_TERMS} SELECT count(*) AS terms, round_even(avg(length(term)), 6) AS avg_length, min(length(term)) AS min_length, max(length(term)) AS max_length FROM vocab")
def vocab_lengths(spark, sf):
    return r6(tfidf.vocabulary_lengths(_features(spark, sf, keep=False)[2]), "avg_length")


@query("vocab_first_char", f"WITH {_TERMS} SELECT substr(term, 1, 1) AS first, count(*) AS terms FROM vocab GROUP BY 1 ORDER BY terms DESC, first LIMIT 10")
def vocab_first_char(spark, sf):
    return tfidf.first_characters(_features(spark, sf, keep=False)[2])


@query("vocab_length_hist", f"""WITH {_TERMS}, o AS (SELECT length(term) AS length, term, row_number() OVER (PARTITION BY length(term) ORDER BY term) AS pos FROM vocab)
SELECT length, count(*) AS terms, string_agg(CASE WHEN pos <= 3 THEN term END, '|' ORDER BY term) AS samples FROM o GROUP BY length ORDER BY length LIMIT 15""")
def vocab_length_hist(spark, sf):
    return tfidf.length_histogram(_features(spark, sf, keep=False)[2])


@query("vocab_ngram_orders", f"WITH {_TERMS} SELECT len(string_split(term, ' ')) AS words, count(*) AS terms FROM vocab GROUP BY 1")
def vocab_ngram_orders(spark, sf):
    return tfidf.ngram_orders(_features(spark, sf, keep=False)[2])


_PREFIXES = ["th", "un", "re", "zzz"]


@query("vocab_prefixes", f"WITH {_TERMS}, p AS (SELECT unnest({_list(_PREFIXES)}) AS prefix) SELECT prefix, count(term) AS terms FROM p LEFT JOIN vocab ON starts_with(term, prefix) GROUP BY prefix")
def vocab_prefixes(spark, sf):
    return tfidf.prefix_counts(_features(spark, sf, keep=False)[2], _PREFIXES)


_MARKERS = ["the", "of", "no such term"]


@query("vocab_markers", f"WITH {_TERMS}, m AS (SELECT unnest({_list(_MARKERS)}) AS term) SELECT term, term_id, df FROM m LEFT JOIN vocab USING (term)")
def vocab_markers(spark, sf):
    return tfidf.marker_lookup(_features(spark, sf, keep=False)[2], _MARKERS)


# --- Complexity rows: F1-F9, N1-N6, P1-P6, J4-J8 ------------------------------------------------

LEAST, MOST = 4, 2000


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A row per document in the shape of the raw complexity files, with doc_id and source."""
    # Texts with words; a condition on the words themselves would have them taken apart twice.
    d = read(spark, sf, "documents").where(F.col("text").rlike(r"[^ \t\n\r]")).select("doc_id", "text", "lang", tfidf.tokens(F.col("text")).alias("w"))
    n = F.size("w").cast("double")
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    return d.select(
        "doc_id", (F.length(F.translate("text", " \t\n\r", "")) / n).alias("avg_links_len"), F.array_max(F.transform(F.split("text", "\n"), F.length)).cast("double").alias("avg_max_depth"),
        (count(",") / (1.0 + count("."))).alias("avg_subordinate_chain_len"), (F.size(F.array_distinct("w")) / n).alias("avg_verb_edges"), (F.regexp_count("text", F.lit(r"[^ \t\n\r]{4,}")) / n).alias("lexical_density"), n.alias("n_tokens"),
        F.col("lang").alias("language"), F.when(F.col("doc_id") % 2 == 0, "polar").otherwise("content").alias("type"), F.when(F.col("doc_id") % 4 == 0, "ud").otherwise("tydi").alias("source"),
    )


_RAW = r"""
t AS (SELECT doc_id, text, lang, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
raw AS (
  SELECT doc_id, length(regexp_replace(text, '[ \t\n\r]', '', 'g')) / CAST(len(w) AS DOUBLE) AS avg_links_len,
    CAST(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS DOUBLE) AS avg_max_depth,
    (length(text) - length(replace(text, ',', ''))) / (1.0 + length(text) - length(replace(text, '.', ''))) AS avg_subordinate_chain_len,
    len(list_distinct(w)) / CAST(len(w) AS DOUBLE) AS avg_verb_edges, len(list_filter(w, lambda x: length(x) > 3)) / CAST(len(w) AS DOUBLE) AS lexical_density, CAST(len(w) AS DOUBLE) AS n_tokens,
    lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'polar' ELSE 'content' END AS type, CASE WHEN doc_id % 4 = 0 THEN 'ud' ELSE 'tydi' END AS source
  FROM t WHERE len(w) > 0)"""
_KEPT = f"kept AS (SELECT * FROM raw WHERE n_tokens BETWEEN {LEAST} AND {MOST})"
_SCALED = "scaled AS (SELECT doc_id, language, type, source, n_tokens AS original_n_tokens, " + ", ".join(
    f"CASE WHEN max({f}) OVER g > min({f}) OVER g THEN ({f} - min({f}) OVER g) / (max({f}) OVER g - min({f}) OVER g) ELSE {f} END AS {f}" for f in FEATURES
) + " FROM kept WINDOW g AS (PARTITION BY source, language, type))"
_SUM = " + ".join(f"coalesce({f}, 0)" for f in FEATURES)
_SCORED = f"scored AS (SELECT *, {_SUM} AS {SCORE} FROM scaled), rounded AS (SELECT doc_id, language, type, source, original_n_tokens, " + ", ".join(f"round_even({f}, 3) AS {f}" for f in (*FEATURES, SCORE)) + " FROM scored)"
_PIPE = f"{_RAW}, {_KEPT}, {_SCALED}, {_SCORED}"


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """``raw_rows`` written once: what follows goes through them several times, and their texts need not be taken apart again."""
    return Scratch(spark, "measured").keep(raw_rows(spark, sf), "rows")


def _kept(spark, sf):
    return projection.token_range(measured(spark, sf), LEAST, MOST)


def _rounded(spark, sf):
    return datasets.scored_rows(measured(spark, sf), LEAST, MOST)


@query("token_filter", f"WITH {_RAW}, {_KEPT} SELECT source, language, type, count(*) AS n, min(n_tokens) AS least, max(n_tokens) AS most FROM kept GROUP BY ALL")
def token_filter(spark, sf):
    return projection.token_range(raw_rows(spark, sf), LEAST, MOST).groupBy("source", "language", "type").agg(F.count("*").alias("n"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most"))


@query("minmax_by_group", f"WITH {_RAW}, {_KEPT}, {_SCALED} SELECT doc_id, " + ", ".join(f"round_even({f}, 6) AS {f}" for f in FEATURES) + " FROM scaled")
def minmax_by_group(spark, sf):
    return r6(normalize.minmax(_kept(spark, sf)).select("doc_id", *FEATURES), *FEATURES)


@query("complexity_score", f"WITH {_PIPE} SELECT doc_id, CASE type WHEN 'polar' THEN 1 WHEN 'content' THEN 0 END AS question_type, original_n_tokens, {SCORE} FROM rounded")
def complexity_score(spark, sf):
    return _rounded(spark, sf).select("doc_id", "question_type", "original_n_tokens", SCORE)


@query("complexity_zscore", f"WITH {_PIPE} SELECT doc_id, round_even(({SCORE} - avg({SCORE}) OVER ()) / stddev_samp({SCORE}) OVER (), 6) AS {SCORE} FROM scored")
def complexity_zscore(spark, sf):
    return r6(normalize.standardised(normalize.scored(normalize.minmax(_kept(spark, sf)))).select("doc_id", SCORE), SCORE)


@query("ablation_scores", f"WITH {_PIPE} " + " UNION ALL ".join(f"SELECT doc_id, '{x}' AS excluded, round_even({' + '.join(f for f in FEATURES if f != x)}, 3) AS {SCORE} FROM rounded" for x in FEATURES))
def ablation_scores(spark, sf):
    return normalize.ablations(_rounded(spark, sf)).select("doc_id", "excluded", SCORE)


@query("ablation_dropped", f"WITH {_PIPE} SELECT doc_id, round_even({' + '.join(f for f in FEATURES if f != 'n_tokens')}, 3) AS {SCORE} FROM rounded")
def ablation_dropped(spark, sf):
    return normalize.rounded(normalize.scored(_rounded(spark, sf), "n_tokens", drop_excluded=True)).drop("n_tokens").select("doc_id", SCORE)


_GROUP = ("language", "type")
_DRAW = lambda seed: f"md5(CAST(doc_id AS VARCHAR) || ':{seed}')"


@query("dev_holdout", f"WITH {_PIPE} SELECT doc_id, row_number() OVER (PARTITION BY language, type ORDER BY {_DRAW(69)}, doc_id) <= least(18, floor(count(*) OVER (PARTITION BY language, type) / 10)) AS dev FROM rounded")
def dev_holdout(spark, sf):
    return sampling.hold_out(_rounded(spark, sf), _GROUP, 18).select("doc_id", "dev")


@query("stratified_split", f"""WITH {_PIPE}, o AS (SELECT doc_id, count(*) OVER () AS total, count(*) OVER (PARTITION BY language, type) AS n, row_number() OVER (PARTITION BY language, type ORDER BY {_DRAW(69)}, doc_id) AS pos FROM rounded)
SELECT doc_id, CASE WHEN total > 10 AND n >= 5 AND pos <= greatest(2, floor(n * 0.1)) THEN 'validation' ELSE 'train' END AS split FROM o""")
def stratified_split(spark, sf):
    return sampling.split(_rounded(spark, sf), _GROUP).select("doc_id", "split")


def _token_sample_sql(target: str) -> str:
    """The rows of a token sample; ``target`` may name the group's language and type."""
    return f"""WITH {_PIPE}, g AS (SELECT language, type, list(original_n_tokens ORDER BY original_n_tokens) AS v, count(*) AS n, CAST(least(greatest(5, floor(count(*) / 10)), 10) AS INTEGER) AS b FROM rounded GROUP BY ALL),
k AS (SELECT language, type, v, n, b, unnest(range(0, b + 1)) AS i FROM g),
e AS (SELECT language, type, (n - 1) * (i / CAST(b AS DOUBLE)) AS pos, v, n FROM k),
e2 AS (SELECT DISTINCT language, type, v[CAST(floor(pos) AS INTEGER) + 1] + (v[CAST(least(floor(pos) + 2, n) AS INTEGER)] - v[CAST(floor(pos) AS INTEGER) + 1]) * (pos - floor(pos)) AS edge FROM e),
e3 AS (SELECT language, type, list(edge ORDER BY edge) AS edges FROM e2 GROUP BY ALL),
binned AS (SELECT r.*, least(len(list_filter(edges[2:], lambda x: x < original_n_tokens)), greatest(len(edges) - 2, 0)) AS bin FROM rounded r JOIN e3 USING (language, type)),
o AS (SELECT *, count(*) OVER (PARTITION BY language, type) AS n, count(*) OVER (PARTITION BY language, type, bin) AS nb, row_number() OVER (PARTITION BY language, type, bin ORDER BY {_DRAW(69)}, doc_id) AS pos FROM binned),
p AS (SELECT * FROM o WHERE n <= {target} OR pos <= greatest(1, floor({target} * 1.0 * nb / n))),
z AS (SELECT *, row_number() OVER (PARTITION BY language, type ORDER BY {_DRAW(70)}, doc_id) AS again FROM p)
SELECT doc_id, language, type FROM z WHERE n <= {target} OR again <= {target}"""


@query("token_bin_sample", _token_sample_sql("60"))
def token_bin_sample(spark, sf):
    return sampling.token_sample(_rounded(spark, sf), 60, _GROUP, "original_n_tokens").select("doc_id", "language", "type")


@query("quota_sample", _token_sample_sql("CASE WHEN language = 'en' AND type = 'polar' THEN 30 ELSE 40 END"))
def quota_sample(spark, sf):
    """Groups below their quota stay whole; of the others the quota is drawn by token bins."""
    wanted = sampling.quota({("en", "polar"): 30}, 40)
    return sampling.token_sample(_rounded(spark, sf), wanted, _GROUP, "original_n_tokens").select("doc_id", "language", "type")


@query("complexity_match_sample", f"""WITH {_PIPE}, ref AS (SELECT * FROM rounded WHERE source = 'tydi'), pool AS (SELECT * FROM rounded WHERE source = 'ud'),
e AS (SELECT unnest(list_distinct([{', '.join(f"quantile_cont({SCORE}, {k / 10})" for k in range(1, 10))}])) AS edge FROM ref),
binned AS (SELECT 'ref' AS side, doc_id, (SELECT count(*) FROM e WHERE {SCORE} >= edge) AS bin FROM ref UNION ALL SELECT 'pool', doc_id, (SELECT count(*) FROM e WHERE {SCORE} >= edge) FROM pool),
share AS (SELECT bin, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM ref) AS share FROM binned WHERE side = 'ref' GROUP BY bin),
o AS (SELECT doc_id, share, row_number() OVER (PARTITION BY bin ORDER BY {_DRAW(69)}, doc_id) AS pos FROM (SELECT * FROM binned WHERE side = 'pool') LEFT JOIN share USING (bin)),
z AS (SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN share IS NOT NULL AND pos <= greatest(1, floor(share * 55)) THEN 0 ELSE 1 END, {_DRAW(70)}, doc_id) AS k FROM o)
SELECT doc_id FROM z WHERE k <= 55""")
def complexity_match_sample(spark, sf):
    rows = _rounded(spark, sf)
    return sampling.match_distribution(rows.where("source = 'ud'"), rows.where("source = 'tydi'"), 55).select("doc_id")


@query("label_shuffle_control", f"""WITH {_PIPE}, s AS (SELECT doc_id, language, {SCORE}, unnest([1, 2, 3]) AS seed FROM rounded),
a AS (SELECT *, row_number() OVER (PARTITION BY language, seed ORDER BY doc_id) AS pos, row_number() OVER (PARTITION BY language, seed ORDER BY md5(CAST(doc_id AS VARCHAR) || ':' || CAST(seed AS VARCHAR)), doc_id) AS drawn FROM s)
SELECT x.doc_id, 'control_{SCORE}_seed' || CAST(x.seed AS VARCHAR) AS config, y.{SCORE} AS {SCORE} FROM a x JOIN a y ON x.language = y.language AND x.seed = y.seed AND x.pos = y.drawn""")
def label_shuffle_control(spark, sf):
    return sampling.shuffled_labels(_rounded(spark, sf).select("doc_id", "language", SCORE), SCORE).select("doc_id", "config", SCORE)


@query("rows_per_language", f"WITH {_RAW} SELECT language, source, count(*) AS n FROM raw WHERE lower(language) IN ('en', 'de') GROUP BY ALL")
def rows_per_language(spark, sf):
    return projection.in_languages(raw_rows(spark, sf), ["EN", "De"]).groupBy("language", "source").agg(F.count("*").alias("n"))


@query("language_union", "SELECT DISTINCT lang AS language FROM documents")
def language_union(spark, sf):
    rows = raw_rows(spark, sf)
    return rows.where("source = 'ud'").select("language").union(rows.where("source = 'tydi'").select("language")).distinct()


@query("label_projection", "SELECT doc_id, coalesce(quality, 0) AS label FROM documents LEFT JOIN labels USING (doc_id)")
def label_projection(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left").withColumnRenamed("quality", "question_type")
    return projection.with_label(rows, "question_type").select("doc_id", "label")


@query("features_with_labels", f"WITH {_RAW} SELECT r.doc_id, l.quality, r.n_tokens FROM raw r JOIN labels l USING (doc_id)")
def features_with_labels(spark, sf):
    return projection.aligned(raw_rows(spark, sf), read(spark, sf, "labels")).select("doc_id", "quality", "n_tokens")


@query("complexity_csv_load", f"WITH {_RAW} SELECT language, type, count(*) AS n, round_even(sum(n_tokens), 3) AS tokens FROM raw GROUP BY ALL")
def complexity_csv_load(spark, sf):
    """Rows written as one folder of CSV files a language and type, and loaded by file name."""
    path = Scratch(spark, "csv").path
    rows = raw_rows(spark, sf).select(*FEATURES, "language", "type")
    readers.write_csv(rows, f"{path}/all.csv")
    return readers.complexity_csv(spark, f"{path}/all.csv").groupBy("language", "type").agg(F.count("*").alias("n"), F.bround(F.sum("n_tokens"), 3).alias("tokens"))


@query("csv_load_report", f"""WITH {_RAW}, k AS (SELECT language, type, doc_id % 10 AS k FROM raw)
SELECT language, type, CAST(NULL AS VARCHAR) AS reason, count(*) AS n FROM k WHERE k < 8 GROUP BY language, type UNION ALL SELECT NULL, NULL, 'n_tokens is no number', count(*) FROM k WHERE k = 7
UNION ALL SELECT NULL, NULL, 'name without language and type', count(*) FROM k WHERE k = 8 UNION ALL SELECT NULL, NULL, 'no n_tokens', count(*) FROM k WHERE k = 9""")
def csv_load_report(spark, sf):
    """Rows loaded by language and type, and rows refused by reason: one in ten has no number, one lies in files without
    languages, one in files without the column."""
    path = Scratch(spark, "csv").path
    rows = raw_rows(spark, sf).withColumn("k", F.col("doc_id") % 10).withColumn("n_tokens", F.when(F.col("k") == 7, "many").otherwise(F.col("n_tokens").cast("string")))
    readers.write_csv(rows.where("k < 8").select("n_tokens", "language", "type"), f"{path}/all")
    readers.write_csv(rows.where("k = 8").select("n_tokens"), f"{path}/nameless")
    readers.write_csv(rows.where("k = 9").select("lexical_density"), f"{path}/countless")
    report = readers.load_report(spark, path)
    loaded = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return report.groupBy(loaded("language"), loaded("type"), "reason").agg(F.sum("n").alias("n"))


@query("conllu_sentences", r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\n\r]+')) AS text FROM documents)
SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '[ \t]+'), lambda x: x <> '')) + 2 AS lines FROM l WHERE len(list_filter(regexp_split_to_array(text, '[ \t]+'), lambda x: x <> '')) > 0""")
def conllu_sentences(spark, sf):
    """Every line of every text written as a treebank sentence, and read again; a comment holds its document."""
    path = Scratch(spark, "conllu").path
    texts = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", r"[\n\r]+")).alias("text"))
    words = texts.withColumn("words", F.filter(F.split("text", r"[ \t]+"), lambda x: x != "")).where("size(words) > 0")
    body = F.array_join(F.transform("words", lambda w, i: F.concat((i + 1).cast("string"), F.lit("\t"), w)), "\n")
    words.select(F.concat(F.lit("# doc_id = "), F.col("doc_id").cast("string"), F.lit("\n# text = "), "text", F.lit("\n"), body, F.lit("\n")).alias("value")).write.text(path)
    of = F.regexp_extract(F.get("lines", F.lit(0)), r"^# doc_id = (\d+)$", 1).cast("long")
    return readers.conllu(spark, path, "*.txt").select(of.alias("doc_id"), "text", F.size("lines").alias("lines"))


@query("mock_dataset", "SELECT doc_id, 'text ' || CAST(doc_id AS VARCHAR) AS text, CAST(doc_id % 2 AS INTEGER) AS question_type, round_even(0.1 + (doc_id % 10) * 0.1, 6) AS complexity_score, round_even(greatest(0.0, least(1.0, 0.1 + (doc_id % 10) * 0.1 - 0.1)), 6) AS avg_links_len FROM documents")
def mock_dataset(spark, sf):
    """Labels made up for the documents' ids."""
    out = readers.mock_dataset(spark, ids=read(spark, sf, "documents").select("doc_id"))
    return r6(out.select("doc_id", "text", "question_type", "complexity_score", "avg_links_len"), "complexity_score", "avg_links_len")


def _dataset(spark, sf) -> str:
    """The labelled documents as a dataset of the base configuration, by split, without a test part."""
    path = f"{Scratch(spark, 'dataset').path}/rows"
    rows = read(spark, sf, "labels").select("doc_id", F.col("quality").alias("question_type")).withColumn("config", F.lit("base")).withColumn("split", F.expr(_SPLIT))
    readers.write_dataset(rows.where("split != 'test'"), path)
    return path


@query("missing_partitions", f"SELECT config, split FROM (SELECT unnest({_list(dataset_configs())}) AS config), (SELECT unnest(['train', 'validation', 'test']) AS split) WHERE NOT (config = 'base' AND split IN (SELECT {_SPLIT} FROM labels WHERE {_SPLIT} <> 'test'))")
def missing_partitions(spark, sf):
    """A dataset with two partitions, and which of the 75 it lacks."""
    return readers.missing_partitions(spark, _dataset(spark, sf))


@query("dataset_one_partition", f"SELECT doc_id, CAST(quality AS INTEGER) AS question_type FROM labels WHERE {_SPLIT} = 'validation'")
def dataset_one_partition(spark, sf):
    return readers.dataset(spark, _dataset(spark, sf), "base", "dev").select("doc_id", F.col("question_type").cast("int").alias("question_type"))


@query("finalized_rows", f"WITH {_PIPE} SELECT doc_id, language, round_even(n_tokens, 3) AS n_tokens FROM rounded WHERE source = 'ud' UNION ALL SELECT doc_id, language, round_even(n_tokens, 3) FROM rounded WHERE source = 'tydi'")
def finalized_rows(spark, sf):
    rows = _rounded(spark, sf)
    out = normalize.finalized(normalize.combined([rows.where("source = 'ud'"), rows.where("source = 'tydi'")]))
    assert "original_n_tokens" not in out.columns and "type_original" not in out.columns
    return out.select("doc_id", "language", "n_tokens")


# --- Questions: C1-C23, A1-A5 -------------------------------------------------------------------


def dealt_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, language, text): the sentences with known labels in turn, one a document."""
    ids = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % len(SENTENCES)).cast("int").alias("sid"))
    return ids.join(F.broadcast(sentences(spark)), "sid")


def sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s[0], s[1]) for i, s in enumerate(SENTENCES)], "sid int, language string, text string").coalesce(1)


def _sql_value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"


_SENTENCES = "s(sid, language, text, qa, ud, question, rejected, wh) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(_sql_value, s))})" for i, s in enumerate(SENTENCES)) + ")"


_DEALT_SENTENCES = f"{_SENTENCES}, said AS (SELECT d.doc_id, s.* FROM documents d JOIN s ON d.doc_id % {len(SENTENCES)} = s.sid)"


@query("qa_classify", f"WITH {_DEALT_SENTENCES} SELECT doc_id, CAST(qa AS VARCHAR) AS qa FROM said")
def qa_classify(spark, sf):
    return dealt_sentences(spark, sf).select("doc_id", q.qa_class(F.col("text"), F.col("language")).alias("qa"))


@query("ud_classify", f"WITH {_DEALT_SENTENCES} SELECT doc_id, CAST(ud AS VARCHAR) AS ud FROM said")
def ud_classify(spark, sf):
    return dealt_sentences(spark, sf).select("doc_id", q.ud_class(F.col("text"), F.col("language")).alias("ud"))


@query("question_filters", f"WITH {_DEALT_SENTENCES} SELECT doc_id, question, rejected FROM said")
def question_filters(spark, sf):
    return dealt_sentences(spark, sf).select("doc_id", q.is_question(F.col("text")).alias("question"), q.is_filtered(F.col("text")).alias("rejected"))


@query("ud_bucket_counts", f"""WITH {_DEALT_SENTENCES}, b AS (SELECT language AS file, CASE WHEN NOT question THEN 'other' WHEN rejected THEN 'filtered' ELSE coalesce(ud, 'unclassified') END AS bucket FROM said)
SELECT file, count(*) AS sentences, count(*) FILTER (bucket <> 'other') AS questions, count(*) FILTER (bucket = 'filtered') AS filtered, count(*) FILTER (bucket = 'polar') AS polar, count(*) FILTER (bucket = 'content') AS content,
count(*) FILTER (bucket = 'unclassified') AS unclassified FROM b GROUP BY ROLLUP (file)""")
def ud_bucket_counts(spark, sf):
    return labelling.bucket_counts(labelling.route_sentences(dealt_sentences(spark, sf).withColumn("file", F.col("language"))))


_TURN_LANGUAGES = ("en", "fi", "ko", "ja", "ru", "ar", "id")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, language, text): every line of every turn, with each language's rules in turn."""
    lines = read(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    language = F.element_at(F.array(*map(F.lit, _TURN_LANGUAGES)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_TURN_LANGUAGES))) + 1).cast("int"))
    return lines.select("conv_id", "turn", "line", language.alias("language"), "text")


@query("question_rules_conversations")
def question_rules_conversations(spark, sf):
    """Both rule sets, the question test, the filter and the bucket of every line of every turn."""
    t, code = F.col("text"), F.col("language")
    return turns(spark, sf).select("conv_id", "turn", "line", "language", q.qa_class(t, code).alias("qa"), q.ud_class(t, code).alias("ud"), q.is_question(t).alias("question"), q.is_filtered(t).alias("rejected"), q.ud_bucket(t, code).alias("bucket"))


@query("ud_buckets_documents")
def ud_buckets_documents(spark, sf):
    """Every line of every document, made a question, through the treebank rules of the languages in turn."""
    lines = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.coalesce("lang", F.lit("")).alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    language = F.element_at(F.array(*map(F.lit, _TURN_LANGUAGES)), (F.pmod(F.col("doc_id") + F.col("line"), F.lit(len(_TURN_LANGUAGES))) + 1).cast("int"))
    return labelling.bucket_counts(labelling.route_sentences(lines.select("file", language.alias("language"), F.concat("text", F.lit("?")).alias("text"))))


_B, _E = r"(^|[^\p{L}\p{N}\p{M}_])", r"($|[^\p{L}\p{N}\p{M}_])"
_WH = "(wha[t]*|wh[o]*|wher[e]*|whe[n]*|wh[y]*|ho[w]*|whic[h]*)"
_ST = "(is|are|do|does|did|have|has|can|could|will|would|should|may|might)"


@query("qa_en_conversations", f"""WITH t AS (SELECT conv_id, turn, lower(text || '?') AS x FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN regexp_matches(x, '^{_WH}{_E}') THEN 'content' WHEN regexp_matches(x, '^{_ST}') THEN 'polar' WHEN regexp_matches(x, '{_B}{_WH}{_E}') THEN 'content' END AS qa FROM t""")
def qa_en_conversations(spark, sf):
    """Volume: the English rules over all turns, made questions."""
    return read(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", q.qa_class(F.concat("text", F.lit("?")), F.lit("en")).alias("qa"))


_NAMES = {"ar": "Arabic", "en": "English", "fi": "finnish", "id": "Indonesian", "ja": "Japanese", "ko": "KOREAN", "ru": "russian", "fr": "french"}


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """A question per document: sentences in turn, with zero to three answers by doc_id."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv]), F.col("language"))
    docs = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % len(SENTENCES)).cast("int").alias("sid"))
    answer = lambda i: F.element_at(F.array(F.lit("YES"), F.lit("NO"), F.lit("NONE"), F.lit("NONE"), F.lit("YES")), ((F.floor(F.col("doc_id") / 7) + i) % 5 + 1).cast("int"))
    every = F.when(F.col("doc_id") % 4 > 0, F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int")), answer)).otherwise(F.expr("CAST(array() AS array<string>)"))
    return docs.join(F.broadcast(sentences(spark)), "sid").select("doc_id", "sid", F.col("text").alias("question_text"), name.alias("language"), F.struct(every.alias("yes_no_answer")).alias("annotations"))


_ASKED = f"""{_SENTENCES}, a AS (SELECT doc_id, s.sid, CASE s.language WHEN 'ar' THEN 'arabic' WHEN 'en' THEN 'english' WHEN 'fi' THEN 'finnish' WHEN 'id' THEN 'indonesian' WHEN 'ja' THEN 'japanese' WHEN 'ko' THEN 'korean' WHEN 'ru' THEN 'russian' END AS language, qa, wh,
list_transform(range(1, CAST(doc_id % 4 AS INTEGER) + 1), lambda i: (['YES', 'NO', 'NONE', 'NONE', 'YES'])[CAST((doc_id // 7 + i) % 5 AS INTEGER) + 1]) AS answers FROM documents JOIN s ON doc_id % {len(SENTENCES)} = s.sid WHERE s.language <> 'fr'),
b AS (SELECT *, len(list_filter(answers, lambda x: x IN ('YES', 'NO'))) > 0 AS polar, len(answers) <= 1 OR len(list_filter(answers, lambda x: x IN ('YES', 'NO'))) IN (0, len(answers)) AS same, language IN ('japanese', 'korean') AS special FROM a),
c AS (SELECT *, CASE WHEN polar THEN 'polar' ELSE 'content' END AS annotation_class, CASE WHEN special OR qa IS NULL THEN CASE WHEN polar THEN 'polar' ELSE 'content' END ELSE qa END AS classifier_class,
  CASE WHEN special AND NOT polar AND NOT same THEN 'inconsistent' WHEN special AND NOT polar AND NOT wh THEN 'no question word' END AS dropped, special AND polar AND NOT same AS added FROM b),
d AS (SELECT *, special OR (annotation_class = 'content' AND classifier_class = 'content') OR CASE WHEN language = 'indonesian' THEN (annotation_class = 'polar' OR classifier_class = 'polar') AND annotation_class = classifier_class ELSE classifier_class = 'polar' END AS included FROM c),
e AS (SELECT *, CASE WHEN NOT included THEN NULL WHEN annotation_class = 'content' AND classifier_class = 'content' THEN 'content' WHEN language <> 'indonesian' AND classifier_class = 'polar' THEN 'polar' WHEN language = 'indonesian' AND annotation_class = classifier_class THEN annotation_class END AS final_class FROM d)"""


@query("qa_process", f"WITH {_ASKED} SELECT doc_id, language, annotation_class, classifier_class, annotation_class = classifier_class AS agreement, final_class, included FROM e WHERE dropped IS NULL")
def qa_process(spark, sf):
    return labelling.label_corpus(asked(spark, sf))["classified"].select("doc_id", "language", "annotation_class", "classifier_class", "agreement", "final_class", "included")


@query("qa_training_rows", f"WITH {_ASKED} SELECT language, final_class, count(*) AS n FROM e WHERE dropped IS NULL AND included AND final_class IS NOT NULL GROUP BY ALL")
def qa_training_rows(spark, sf):
    return labelling.label_corpus(asked(spark, sf))["training"].groupBy("language", "final_class").agg(F.count("*").alias("n"))


@query("annotation_stats", f"""WITH {_ASKED}, y AS (SELECT language, len(list_filter(answers, lambda x: x = 'YES')) AS yes, len(answers) > 1 AS m FROM a)
SELECT language, yes, count(*) AS questions, count(*) FILTER (m) AS multiple_annotators, count(*) FILTER (NOT m) AS single_annotator FROM y GROUP BY GROUPING SETS ((language, yes), (yes))""")
def annotation_stats(spark, sf):
    return ann.annotation_counts(asked(spark, sf))


_AGREE = f"""{_ASKED}, k AS (SELECT language, count(*) FILTER (dropped IS NULL) AS total, count(*) FILTER (dropped IS NULL AND polar) AS polar_by_annotation, count(*) FILTER (dropped IS NULL AND classifier_class = 'polar') AS polar_by_classifier,
count(*) FILTER (dropped IS NULL AND annotation_class = classifier_class) AS agreement, count(*) FILTER (dropped IS NULL AND annotation_class <> classifier_class) AS disagreement,
count(*) FILTER (dropped IS NULL AND annotation_class = classifier_class AND polar) AS agreed_polar, count(*) FILTER (dropped IS NULL AND annotation_class = classifier_class AND NOT polar) AS agreed_content,
count(*) FILTER (dropped IS NULL AND NOT included) AS filtered_out, count(*) FILTER (dropped = 'inconsistent') AS skipped, count(*) FILTER (dropped = 'no question word') AS without_question_word, count(*) FILTER (added) AS added_polar
FROM e GROUP BY ROLLUP (language))"""


@query("agreement_stats", f"WITH {_AGREE} SELECT * FROM k")
def agreement_stats(spark, sf):
    return ann.agreement_counts(ann.classify_questions(asked(spark, sf)))


_share = lambda a, b: f"round_even(CASE WHEN {b} > 0 THEN {a} * 100.0 / {b} ELSE 0 END, 6)"


@query("agreement_rates", f"""WITH {_AGREE} SELECT language, total, {_share('agreement', 'total')} AS agreement_rate, {_share('polar_by_annotation', 'total')} AS polar_annotation_rate, {_share('polar_by_classifier', 'total')} AS polar_classifier_rate,
{_share('agreed_polar', 'polar_by_annotation')} AS polar_recall, {_share('agreed_polar', 'polar_by_classifier')} AS polar_precision, {_share('filtered_out', 'total')} AS filtered_rate FROM k""")
def agreement_rates(spark, sf):
    return r6(ann.agreement_rates(ann.agreement_counts(ann.classify_questions(asked(spark, sf)))), "agreement_rate", "polar_annotation_rate", "polar_classifier_rate", "polar_recall", "polar_precision", "filtered_rate")


# --- Metrics and dummies: A6-A9, M1, M2, M20, A27 -----------------------------------------------

_LABELLED = f"l AS (SELECT doc_id, lang, quality, toxic, {_SPLIT} AS split, n_chars FROM documents JOIN labels USING (doc_id))"


def labelled(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf, "labels"), "doc_id").withColumn("split", F.expr(_SPLIT))


_MODE = "m AS (SELECT lang, quality AS prediction FROM (SELECT lang, quality, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, quality) AS pos FROM l WHERE split = 'train' GROUP BY lang, quality) WHERE pos = 1)"
_CLASSES = """cells AS (SELECT lang, label, prediction, count(*) AS n FROM p GROUP BY ALL), cls AS (SELECT lang, label AS class FROM cells UNION SELECT lang, prediction FROM cells),
c AS (SELECT lang, class, (SELECT coalesce(sum(n), 0) FROM cells x WHERE x.lang = cls.lang AND x.label = class) AS support, (SELECT coalesce(sum(n), 0) FROM cells x WHERE x.lang = cls.lang AND x.prediction = class) AS predicted,
  (SELECT coalesce(sum(n), 0) FROM cells x WHERE x.lang = cls.lang AND x.label = class AND x.prediction = class) AS tp FROM cls),
r AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM r)"""


def _dummy_predictions(spark, sf):
    rows = labelled(spark, sf).withColumn("label", F.col("quality"))
    return models.dummy_classifier(rows.where("split = 'train'"), rows.where("split != 'train'"), by=("lang",))


def _toxic_as_prediction(spark, sf):
    return labelled(spark, sf).select("lang", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


@query("confusion_counts", "SELECT lang, quality AS label, toxic AS prediction, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def confusion_counts(spark, sf):
    return metrics.confusion(_toxic_as_prediction(spark, sf), ("lang",))


_CLASSIFICATION = """SELECT lang, round_even(sum(tp) / sum(support), 6) AS accuracy, round_even(sum(support * p) / sum(support), 6) AS precision, round_even(sum(support * r) / sum(support), 6) AS recall, round_even(sum(support * f) / sum(support), 6) AS f1,
round_even(avg(f), 6) AS macro_f1, round_even(CASE WHEN count(*) = 2 THEN arg_max(p, class) END, 6) AS binary_precision, round_even(CASE WHEN count(*) = 2 THEN arg_max(r, class) END, 6) AS binary_recall,
round_even(CASE WHEN count(*) = 2 THEN arg_max(f, class) END, 6) AS binary_f1, CAST(sum(support) AS BIGINT) AS n_samples FROM f GROUP BY lang"""
_SHOWN = ("accuracy", "precision", "recall", "f1", "macro_f1", "binary_precision", "binary_recall", "binary_f1")


@query("classification_metrics", f"WITH p AS (SELECT lang, quality AS label, toxic AS prediction FROM documents JOIN labels USING (doc_id)), {_CLASSES} {_CLASSIFICATION}")
def classification_metrics(spark, sf):
    return r6(metrics.classification(_toxic_as_prediction(spark, sf), ("lang",)), *_SHOWN)


@query("dummy_classifier_metrics", f"WITH {_LABELLED}, {_MODE}, p AS (SELECT lang, quality AS label, prediction FROM l JOIN m USING (lang) WHERE split <> 'train'), {_CLASSES} {_CLASSIFICATION}")
def dummy_classifier_metrics(spark, sf):
    return r6(metrics.classification(_dummy_predictions(spark, sf), ("lang",)), *_SHOWN)


@query("metrics_long", f"""WITH p AS (SELECT lang, quality AS label, toxic AS prediction FROM documents JOIN labels USING (doc_id)), {_CLASSES}, g AS ({_CLASSIFICATION})
SELECT lang, 'accuracy' AS metric, accuracy AS value, TRUE AS "primary" FROM g UNION ALL SELECT lang, 'precision', precision, FALSE FROM g UNION ALL SELECT lang, 'recall', recall, FALSE FROM g UNION ALL SELECT lang, 'f1', f1, FALSE FROM g""")
def metrics_long(spark, sf):
    return r6(metrics.by_task_type(_toxic_as_prediction(spark, sf), "classification", ("lang",)), "value")


@query("dummy_regressor_metrics", f"""WITH {_PIPE}, s AS (SELECT *, {_SPLIT} AS split FROM rounded), m AS (SELECT language, avg({SCORE}) AS p FROM s WHERE split = 'train' GROUP BY language), z AS (SELECT s.language, {SCORE} AS y, p FROM s JOIN m USING (language) WHERE split <> 'train')
SELECT language, round_even(avg((y - p) * (y - p)), 6) AS mse, round_even(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round_even(avg(abs(y - p)), 6) AS mae, round_even(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, count(*) AS n_samples FROM z GROUP BY language""")
def dummy_regressor_metrics(spark, sf):
    rows = _rounded(spark, sf).withColumn("split", F.expr(_SPLIT)).withColumn("label", F.col(SCORE))
    out = models.dummy_regressor(rows.where("split = 'train'"), rows.where("split != 'train'"), by=("language",))
    return r6(metrics.regression(out, ("language",)), "mse", "rmse", "mae", "r2")


@query("class_weights", "SELECT quality AS label, count(*) AS n, round_even((SELECT count(*) FROM labels) / CAST((SELECT count(DISTINCT quality) FROM labels) * count(*) AS DOUBLE), 6) AS weight FROM labels GROUP BY quality")
def class_weights(spark, sf):
    return r6(models.class_weights(read(spark, sf, "labels").withColumnRenamed("quality", "label")), "weight")


@query("language_codes", "SELECT doc_id, CASE lang WHEN 'en' THEN 'en' ELSE lang END AS code FROM documents")
def language_codes(spark, sf):
    """Full names become codes, anything else passes through."""
    name = F.when(F.col("lang") == "en", "English").otherwise(F.col("lang"))
    return read(spark, sf, "documents").select("doc_id", projection.language_code(name).alias("code"))


@query("thresholded_scores", "SELECT event_id, CAST(value > 0.5 AS INTEGER) AS predicted FROM events")
def thresholded_scores(spark, sf):
    return read(spark, sf, "events").select("event_id", metrics.thresholded(F.col("value")).alias("predicted"))


@query("evaluation_loss", f"""WITH {_LABELLED}, p AS (SELECT lang, quality AS y, greatest(1e-7, least(1 - 1e-7, n_chars / 5000.0)) AS q FROM l WHERE quality IS NOT NULL)
SELECT lang, round_even(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS loss, count(*) AS n FROM p GROUP BY lang""")
def evaluation_loss(spark, sf):
    """Mean log loss by language, of the length as a probability of quality."""
    rows = labelled(spark, sf).select("lang", F.col("quality").alias("label"), (F.col("n_chars") / 5000.0).alias("prediction"))
    return r6(metrics.mean_loss(rows, "classification", ("lang",)), "loss")


# --- Grids, results: J1-J3, J7-J12, R1-R6, A10-A26, W1-W8, S8-S11, S17, S18 ------------------------

_SUBS = ", ".join(f"('single_submetric', 'regression', '{f}')" for f in FEATURES)
_GRID = f"""lang AS (SELECT unnest({_list(LANGUAGES)}) AS language), task(task, task_type, submetric) AS (VALUES ('question_type', 'classification', NULL), ('complexity', 'regression', NULL), {_SUBS}),
model AS (SELECT unnest({_list(MODELS)}) AS model_type), run AS (SELECT unnest([NULL, 1, 2, 3]) AS control_index),
g0 AS (SELECT *, coalesce(submetric, task) AS label FROM lang, task, model, run WHERE NOT (model_type = 'logistic' AND task_type <> 'classification') AND NOT (model_type = 'ridge' AND task_type <> 'regression')),
g1 AS (SELECT *, CASE WHEN control_index IS NOT NULL AND submetric IS NOT NULL THEN 'control_submetric' WHEN control_index IS NOT NULL THEN 'control' WHEN submetric IS NOT NULL THEN 'submetric' ELSE 'main' END AS kind,
  CASE WHEN control_index IS NULL THEN 'base' ELSE 'control_' || label || '_seed' || CAST(control_index AS VARCHAR) END AS dataset_config, CASE WHEN control_index IS NULL THEN 'main' ELSE 'control' END AS experiment_type FROM g0),
grid AS (SELECT *, substr(md5('{{"config": "' || dataset_config || '", "experiment_type": "' || experiment_type || '", "language": "' || language || '", "model_type": "' || model_type || '", "task": "' || label || '", "task_type": "' || task_type || '"}}'), 1, 12) AS experiment_id FROM g1)"""


_SPOKEN = _GRID.replace(f"lang AS (SELECT unnest({_list(LANGUAGES)}) AS language)", "lang AS (SELECT DISTINCT lang AS language FROM documents WHERE lang IS NOT NULL)")


def _spoken(spark, sf):
    return read(spark, sf, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("language")).distinct()


@query("experiment_grid", f"WITH {_SPOKEN} SELECT language, task, task_type, submetric, model_type, CAST(control_index AS INTEGER) AS control_index, kind, dataset_config, experiment_id FROM grid")
def experiment_grid(spark, sf):
    """The grid over the languages that the documents are in."""
    return grid.experiment_grid(spark, _spoken(spark, sf))


@query("grid_sizes", f"WITH {_SPOKEN} SELECT kind, task_type, count(*) AS experiments FROM grid GROUP BY ALL")
def grid_sizes(spark, sf):
    return grid.grid_sizes(grid.experiment_grid(spark, _spoken(spark, sf)))


@query("layer_grid_sizes", "WITH k AS (SELECT count(DISTINCT lang) AS k FROM documents) SELECT 'probes' AS grid, k * 8 * 4 * 12 AS n FROM k UNION ALL SELECT 'finetune', k * 8 * 4 FROM k")
def layer_grid_sizes(spark, sf):
    count = lambda df, name: df.agg(F.lit(name).alias("grid"), F.count("*").alias("n"))
    spoken = _spoken(spark, sf)
    return count(grid.layer_grid(spark, languages=spoken), "probes").unionByName(count(grid.finetune_grid(spark, spoken), "finetune"))


#: Languages that rows are dealt to in turn by doc_id; the grid's last language has none, so its experiments fail.
_DEALT = LANGUAGES[:-1]


def grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the experiments: doc_id, language, split, x (a bin of 125 tokens) and the label of every task."""
    rows = _rounded(spark, sf).drop("language", "question_type").join(read(spark, sf, "labels").select("doc_id", F.col("quality").alias("question_type")), "doc_id", "left")
    language = F.element_at(F.array(*map(F.lit, _DEALT)), (F.col("doc_id") % len(_DEALT) + 1).cast("int"))
    x = F.least(F.floor(F.col("original_n_tokens") / 125).cast("int"), F.lit(grouped.BINS - 1))
    return rows.select("doc_id", language.alias("language"), F.expr(_SPLIT).alias("split"), x.alias("x"), F.coalesce("question_type", F.lit(0)).alias("question_type"), SCORE, *FEATURES)


#: Where a session's batches are, by tables.
_batches: dict[tuple[str, str], str] = {}


def _batch(spark: SparkSession, sf: str) -> str:
    """The folder of the grid's batch over the given tables; it runs once a session, reports read what it wrote."""
    key = spark.sparkContext.applicationId, sf
    if not shared.holds(_batches.get(key)):
        scratch = Scratch(spark, "batch")
        stats = scratch.keep(grouped.statistics(scratch.keep(grid_rows(spark, sf), "rows")), "statistics")
        readers.write_results(grouped.documents(spark, stats), f"{scratch.path}/results")
        _batches[key] = scratch.path
    return _batches[key]


def statistics(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{_batch(spark, sf)}/statistics")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Result documents of the whole grid over the given tables."""
    return readers.stored_results(spark, f"{_batch(spark, sf)}/results")


def standard(spark: SparkSession, sf: str) -> DataFrame:
    return results.standardized(documents(spark, sf))


def completed(spark: SparkSession, sf: str) -> DataFrame:
    return standard(spark, sf).where("status = 'completed'")


_TASKS = ("question_type", "complexity", *FEATURES)
_LABEL_SQL = ", ".join(f"{{'task': '{t}', 'y': CAST({SCORE if t == 'complexity' else t} AS DOUBLE)}}" for t in _TASKS)
_ALL_LABELS = ["question_type", SCORE, *FEATURES]


def _newton_sql() -> str:
    """The Newton steps of the logistic cells, a step a table."""
    clip = lambda v: f"greatest(-{grouped.STRIDE}, least({grouped.STRIDE}, {v}))"
    steps = ["w0 AS (SELECT DISTINCT language, task, control_index, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS b FROM bins WHERE task = 'question_type')"]
    for k in range(grouped.STEPS):
        steps.append(f"""w{k + 1} AS MATERIALIZED (SELECT language, task, control_index, w - {clip('(bb * gw - wb * gb) / (ww * bb - wb * wb)')} AS w, b - {clip('(ww * gb - wb * gw) / (ww * bb - wb * wb)')} AS b FROM (
  SELECT language, task, control_index, any_value(w) AS w, any_value(b) AS b, any_value(w) + sum(g * z) AS gw, any_value(b) + sum(g) AS gb, 1 + sum(h * z * z) AS ww, sum(h * z) AS wb, 1 + sum(h) AS bb FROM (
    SELECT *, n * p - sy AS g, n * p * (1 - p) AS h FROM (SELECT t.*, w, b, t.x / 8.0 AS z, 1 / (1 + exp(-(w * t.x / 8.0 + b))) AS p FROM bins t JOIN w{k} USING (language, task, control_index))) GROUP BY ALL))""")
    return ",\n".join(steps)


_CELLS = "language, task, control_index"
_WEIGHTED = "(ones * {0}1 + (samples - ones) * {0}0) / samples"
_STATS = f"""{_PIPE}, based AS (SELECT doc_id, ({_list(_DEALT)})[CAST(doc_id % {len(_DEALT)} AS INTEGER) + 1] AS language, {_SPLIT} AS split, least(CAST(floor(original_n_tokens / 125) AS INTEGER), {grouped.BINS - 1}) AS x, coalesce(quality, 0) AS question_type, {SCORE}, {', '.join(FEATURES)}
  FROM rounded LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)),
sh AS (SELECT *, row_number() OVER (PARTITION BY language, seed ORDER BY doc_id) AS pos, row_number() OVER (PARTITION BY language, seed ORDER BY md5(CAST(doc_id AS VARCHAR) || ':' || CAST(seed AS VARCHAR)), doc_id) AS drawn FROM (SELECT *, unnest([1, 2, 3]) AS seed FROM based WHERE split = 'train')),
every AS (SELECT language, split, x, 0 AS control_index, {', '.join(_ALL_LABELS)} FROM based UNION ALL SELECT a.language, a.split, a.x, a.seed, {', '.join('b.' + c for c in _ALL_LABELS)} FROM sh a JOIN sh b ON a.language = b.language AND a.seed = b.seed AND a.pos = b.drawn),
long AS (SELECT language, split, x, control_index, unnest([{_LABEL_SQL}]) AS u FROM every),
stats AS MATERIALIZED (SELECT language, u.task AS task, control_index, CASE split WHEN 'validation' THEN 'val' ELSE split END AS part, x, count(*) AS n, sum(u.y) AS sy, sum(u.y * u.y) AS syy FROM long GROUP BY ALL),
bins AS (SELECT {_CELLS}, x, n, sy FROM stats WHERE part = 'train')"""
_FITS = f"""{_STATS}, cell AS (SELECT {_CELLS}, sum(n) AS n, sum(sy) AS sy, sum(x * n) / CAST(sum(n) AS DOUBLE) AS xm FROM bins GROUP BY ALL),
line AS (SELECT {_CELLS}, sum((x - xm) * bins.sy) / (sum(bins.n * (x - xm) * (x - xm)) + {grouped.ALPHA}) AS w FROM bins JOIN cell USING ({_CELLS}) GROUP BY ALL),
{_newton_sql()},
side AS (SELECT *, sum(g) OVER c AS gl, sum(h) OVER c AS hl, sum(g) OVER a AS gt, sum(h) OVER a AS ht FROM (SELECT *, n * 0.5 - sy AS g, n * CASE WHEN task = 'question_type' THEN 0.25 ELSE 1.0 END AS h FROM bins)
  WINDOW c AS (PARTITION BY {_CELLS} ORDER BY x), a AS (PARTITION BY {_CELLS})),
cut AS (SELECT {_CELLS}, x AS first, gl, hl, gt - gl AS gr, ht - hl AS hr, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM side),
best AS (SELECT {_CELLS}, first, -{grouped.ETA} * gl / (hl + 1) AS lo, -{grouped.ETA} * gr / (hr + 1) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY {_CELLS} ORDER BY round_even(gain, 9) DESC, first) AS k FROM cut WHERE hl >= 1 AND hr >= 1 AND gain > 1e-9) WHERE k = 1),
root AS (SELECT {_CELLS}, -{grouped.ETA} * any_value(gt) / (any_value(ht) + 1) AS leaf FROM side GROUP BY ALL),
par AS (SELECT {_CELLS}, task = 'question_type' AS classify, sy / n AS ym, xm, line.w AS ridge, lg.w AS lw, lg.b AS lb, first, coalesce(lo, leaf) AS lo, coalesce(hi, leaf) AS hi
  FROM cell JOIN line USING ({_CELLS}) LEFT JOIN w{grouped.STEPS} lg USING ({_CELLS}) JOIN root USING ({_CELLS}) LEFT JOIN best USING ({_CELLS})),
margin AS (SELECT p.*, m.model_type, s.part, s.x, s.n, s.sy, s.syy, CASE m.model_type WHEN 'dummy' THEN CASE WHEN classify THEN ym - 0.5 ELSE ym END WHEN 'ridge' THEN ym - ridge * xm + ridge * x WHEN 'logistic' THEN lw * x / 8 + lb
    ELSE CASE WHEN classify THEN 0 ELSE 0.5 END + CASE WHEN x <= coalesce(first, 0) THEN lo ELSE hi END END AS z
  FROM par p JOIN (SELECT unnest({_list(MODELS)}) AS model_type) m ON NOT (m.model_type = 'logistic' AND NOT classify) AND NOT (m.model_type = 'ridge' AND classify)
  JOIN stats s ON s.language = p.language AND s.task = p.task AND (s.part <> 'train' OR s.control_index = p.control_index)),
pred AS (SELECT *, CASE WHEN classify THEN CASE WHEN z > 1e-12 THEN 1.0 ELSE 0.0 END ELSE z END AS p FROM margin),
sums AS (SELECT {_CELLS}, model_type, part, any_value(classify) AS classify, CAST(sum(n) AS DOUBLE) AS samples, sum(sy) AS ones, sum(syy) AS squares, sum(syy - 2 * p * sy + n * p * p) AS sse, sum(CASE WHEN p = 1 THEN n ELSE 0 END) AS said, sum(CASE WHEN p = 1 THEN sy ELSE 0 END) AS hit FROM pred GROUP BY ALL),
rate AS (SELECT *, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p1, CASE WHEN ones > 0 THEN hit / ones ELSE 0 END AS r1, CASE WHEN samples - said > 0 THEN hit0 / (samples - said) ELSE 0 END AS p0, CASE WHEN samples - ones > 0 THEN hit0 / (samples - ones) ELSE 0 END AS r0, squares - ones * ones / samples AS spread
  FROM (SELECT *, samples - ones - (said - hit) AS hit0 FROM sums)),
f1s AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0 FROM rate),
met AS MATERIALIZED (SELECT {_CELLS}, model_type, part, CAST(samples AS BIGINT) AS samples, round_even(CASE WHEN classify THEN (hit + hit0) / samples END, 12) AS accuracy, round_even(CASE WHEN classify THEN {_WEIGHTED.format('p')} END, 12) AS precision, round_even(CASE WHEN classify THEN {_WEIGHTED.format('r')} END, 12) AS recall,
  round_even(CASE WHEN classify THEN {_WEIGHTED.format('f')} END, 12) AS f1, round_even(CASE WHEN NOT classify THEN sse / samples END, 12) AS mse, round_even(CASE WHEN NOT classify THEN CASE WHEN spread > 1e-9 THEN 1 - sse / spread ELSE 0 END END, 12) AS r2 FROM f1s),
one AS (SELECT {_CELLS}, CAST(min(sy) AS DOUBLE) AS sy, count(*) AS k FROM (SELECT {_CELLS}, sum(sy) AS sy, sum(n) AS n FROM bins WHERE task = 'question_type' GROUP BY ALL HAVING sum(sy) = 0 OR sum(sy) = sum(n)) GROUP BY ALL)"""
_WIDE = ", ".join(f"max({c}) FILTER (part = '{p}') AS {p}_{c}" for p in results.PARTS for c in ("samples", *results.METRICS))
_KEPT_METRICS = ", ".join(f"CASE WHEN error IS NULL THEN {p}_{m} END AS {p}_{m}" for p in results.PARTS for m in results.METRICS)
_STD = f"""{_GRID}, {_FITS}, wide AS (SELECT {_CELLS}, model_type, {_WIDE} FROM met GROUP BY ALL),
told AS (SELECT grid.*, wide.* EXCLUDE ({_CELLS}, model_type), CASE WHEN train_samples IS NULL THEN 'ValueError: no training rows for language ' || grid.language WHEN grid.model_type = 'logistic' AND one.k IS NOT NULL THEN 'ValueError: training labels of bad shape: one class only' END AS error
  FROM grid LEFT JOIN wide ON wide.language = grid.language AND wide.task = grid.label AND wide.control_index = coalesce(grid.control_index, 0) AND wide.model_type = grid.model_type
  LEFT JOIN one ON one.language = grid.language AND one.task = grid.label AND one.control_index = coalesce(grid.control_index, 0)),
std AS MATERIALIZED (SELECT experiment_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, error, language, label AS task, model_type, task_type, dataset_config, experiment_type, CAST(control_index AS INTEGER) AS control_seed,
  CASE WHEN error IS NULL THEN train_samples / 1e3 ELSE 0 END AS train_time, CASE WHEN error IS NULL THEN coalesce(test_samples, 0) END AS test_samples, coalesce(train_samples, 0) + coalesce(val_samples, 0) + coalesce(test_samples, 0) AS second, {_KEPT_METRICS} FROM told),
done AS (SELECT * FROM std WHERE status = 'completed')"""


_SCANNED = ("test_accuracy", "test_f1", "test_mse", "test_r2", "train_mse", "val_precision")


@query("result_json_scan", f"WITH {_STD} SELECT experiment_id, status, error, language, task, model_type, task_type, dataset_config, experiment_type, control_seed, train_time, test_samples, {', '.join(f'round_even({c}, 6) AS {c}' for c in _SCANNED)} FROM std")
def result_json_scan(spark, sf):
    names = "experiment_id status error language task model_type task_type dataset_config experiment_type control_seed train_time test_samples test_accuracy test_f1 test_mse test_r2 train_mse val_precision"
    return r6(results.standardized(readers.result_json(spark, f"{_batch(spark, sf)}/results")).select(*names.split()), *_SCANNED)


_K = "task, model_type, language, task_type"
_AVG = f"ca AS (SELECT {_K}, " + ", ".join(f"avg(test_{m}) AS {m}" for m in ("accuracy", "f1", "mse", "r2")) + f" FROM done WHERE experiment_type = 'control' GROUP BY {_K})"
_CMP = f"{_STD}, {_AVG}, cmp AS (SELECT {', '.join('d.' + k for k in _K.split(', '))}, " + ", ".join(
    f"d.test_{m} AS test_{m}_main, ca.{m} AS test_{m}_control, d.test_{m} - ca.{m} AS test_{m}_diff, {'ca.mse - d.test_mse' if m == 'mse' else f'd.test_{m} - ca.{m}'} AS test_{m}_improvement" for m in ("accuracy", "f1", "mse", "r2")
) + f" FROM done d JOIN ca USING ({_K}) WHERE d.experiment_type = 'main')"
_CMP_COLUMNS = [f"test_{m}_{s}" for m in ("accuracy", "f1", "mse", "r2") for s in ("main", "control", "diff", "improvement")]


@query("control_average", f"WITH {_STD}, {_AVG} SELECT {_K}, " + ", ".join(f"round_even({m}, 6) AS test_{m}" for m in ("accuracy", "f1", "mse", "r2")) + " FROM ca")
def control_average(spark, sf):
    out = results.control_average(completed(spark, sf), ("test",), ("accuracy", "f1", "mse", "r2"))
    return r6(out, *[f"test_{m}" for m in ("accuracy", "f1", "mse", "r2")])


@query("main_vs_control", f"WITH {_CMP} SELECT {_K}, " + ", ".join(f"round_even({c}, 6) + 0.0 AS {c}" for c in _CMP_COLUMNS) + " FROM cmp")
def main_vs_control(spark, sf):
    return r6(results.main_vs_control(completed(spark, sf)), *_CMP_COLUMNS)


@query("selectivity", f"WITH {_CMP} SELECT {_K}, round_even(test_mse_main, 6) AS main, round_even(test_mse_control, 6) AS control, round_even(test_mse_improvement, 6) + 0.0 AS delta, round_even(test_mse_improvement / nullif(test_mse_control, 0), 6) + 0.0 AS selectivity FROM cmp WHERE test_mse_improvement IS NOT NULL")
def selectivity(spark, sf):
    return r6(results.selectivity(results.main_vs_control(completed(spark, sf)), "mse"), "main", "control", "delta", "selectivity")


def _summary_sql(by: str) -> str:
    return f"WITH {_STD} SELECT {by}, " + ", ".join(f"round_even(avg(test_{m}), 6) AS test_{m}_mean, round_even(stddev_samp(test_{m}), 6) AS test_{m}_std, count(test_{m}) AS test_{m}_count" for m in ("accuracy", "f1", "mse", "r2")) + f" FROM done GROUP BY {by}"


_MEANS = [f"test_{m}_{s}" for m in ("accuracy", "f1", "mse", "r2") for s in ("mean", "std")]


@query("by_task_language", _summary_sql("task, language, experiment_type"))
def by_task_language(spark, sf):
    return r6(results.by_task_language(completed(spark, sf)), *_MEANS)


@query("by_model_type", _summary_sql("model_type, task_type, experiment_type"))
def by_model_type(spark, sf):
    return r6(results.by_model_type(completed(spark, sf)), *_MEANS)


@query("model_means", f"WITH {_STD} SELECT model_type, task, experiment_type, " + ", ".join(f"round_even(avg(test_{m}), 6) AS {m}" for m in ("accuracy", "f1", "mse", "r2")) + ", round_even(avg(train_time), 6) AS train_time FROM done GROUP BY model_type, task, experiment_type")
def model_means(spark, sf):
    return r6(results.model_means(completed(spark, sf)), "accuracy", "f1", "mse", "r2", "train_time")


@query("improvement_summary", f"WITH {_CMP}, u AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, test_{m}_improvement AS v FROM cmp" for m in ("accuracy", "f1", "mse", "r2")) + """)
SELECT metric, round_even(max(v), 6) + 0.0 AS best, round_even(min(v), 6) + 0.0 AS worst, round_even(avg(v), 6) + 0.0 AS mean, round_even(stddev_samp(v), 6) AS std, count(*) FILTER (v > 0) AS positive, count(*) FILTER (v < 0) AS negative, count(v) AS n FROM u WHERE v IS NOT NULL GROUP BY metric""")
def improvement_summary(spark, sf):
    return r6(results.improvement_summary(results.main_vs_control(completed(spark, sf))), "best", "worst", "mean", "std")


@query("task_summary", f"WITH {_STD} SELECT task, count(*) AS n, " + ", ".join(f"round_even(avg(test_{m}), 6) AS {m}_mean, round_even(stddev_samp(test_{m}), 6) AS {m}_std, round_even({f}(test_{m}), 6) AS {m}_best" for m, f in (("accuracy", "max"), ("mse", "min"))) + " FROM done GROUP BY task")
def task_summary(spark, sf):
    return r6(results.task_summary(completed(spark, sf)), "accuracy_mean", "accuracy_std", "accuracy_best", "mse_mean", "mse_std", "mse_best")


_BEST = f"""{_STD}, u AS (SELECT language, task, model_type AS model, experiment_type, CASE WHEN task = 'question_type' THEN 'accuracy' ELSE 'mse' END AS metric, CASE WHEN task = 'question_type' THEN test_accuracy ELSE test_mse END AS value FROM done)"""


@query("best_per_task", f"WITH {_BEST}, o AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY CASE WHEN metric = 'mse' THEN -value ELSE value END DESC, language, model, experiment_type DESC) AS pos FROM u WHERE value IS NOT NULL) SELECT experiment_type, language, task, model, metric, round_even(value, 6) AS value FROM o WHERE pos = 1")
def best_per_task(spark, sf):
    return r6(results.best_per_task(results.long_form(completed(spark, sf))), "value")


@query("best_per_language_task", f"WITH {_BEST}, o AS (SELECT *, row_number() OVER (PARTITION BY language, task ORDER BY CASE WHEN metric = 'mse' THEN -value ELSE value END DESC, language, model, experiment_type DESC) AS pos FROM u WHERE value IS NOT NULL) SELECT experiment_type, language, task, model, metric, round_even(value, 6) AS value FROM o WHERE pos = 1")
def best_per_language_task(spark, sf):
    return r6(results.best_per_task(results.long_form(completed(spark, sf)), ("language", "task")), "value")


_HIDDEN_TASKS = ("question_type", "complexity", *FEATURES)


def _probes(spark, sf):
    """Layer probes on the embeddings: component 1 to 12 stands for a layer, its sign is the probe's input;
    the vector's label or a further component is the task's label, predicted by the inputs' group."""
    e = F.col("embedding")
    labels = [F.pmod(F.coalesce("label", F.lit(0)), F.lit(2)).cast("double"), *[F.get(e, F.lit(12 + k)).cast("double") for k in range(1, len(_HIDDEN_TASKS))]]
    pairs = F.array(*[F.struct(F.lit(t).alias("task"), y.alias("y")) for t, y in zip(_HIDDEN_TASKS, labels)])
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("vec_id") % len(LANGUAGES) + 1).cast("int"))
    rows = read(spark, sf, "embeddings").where(F.size("embedding") >= 20).select(language.alias("language"), F.posexplode(F.slice("embedding", 1, 12)).alias("at", "x"), pairs.alias("pairs"))
    rows = rows.select("language", (F.col("at") + 1).alias("layer"), (F.col("x") > 0).alias("x"), F.explode("pairs").alias("p"))
    groups = rows.groupBy("language", F.col("p.task").alias("task"), "layer", "x").agg(F.count("*").alias("n"), F.sum("p.y").alias("sy"), F.sum(F.col("p.y") * F.col("p.y")).alias("syy"))
    classify = F.col("task") == "question_type"
    got = F.when(classify, F.greatest(F.col("sy"), F.col("n") - F.col("sy"))).otherwise(F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    sums = groups.groupBy("language", "task", "layer").agg(F.bround(F.sum(got) / F.sum("n"), 6).alias("value"))
    return sums.select("language", "task", "layer", F.when(classify, "accuracy").otherwise("mse").alias("metric"), "value")


_HIDDEN_SQL = ", ".join(f"{{'task': '{t}', 'y': {'CAST(coalesce(label, 0) % 2 AS DOUBLE)' if k == 0 else f'CAST(embedding[{13 + k}] AS DOUBLE)'}}}" for k, t in enumerate(_HIDDEN_TASKS))
_PROBES = f"""hr AS (SELECT ({_list(LANGUAGES)})[CAST(vec_id % {len(LANGUAGES)} AS INTEGER) + 1] AS language, embedding, unnest([{_HIDDEN_SQL}]) AS p FROM embeddings WHERE len(embedding) >= 20),
hg AS (SELECT language, p.task AS task, layer, embedding[layer] > 0 AS x, count(*) AS n, sum(p.y) AS sy, sum(p.y * p.y) AS syy FROM hr, (SELECT unnest(range(1, 13)) AS layer) GROUP BY ALL),
pr AS (SELECT language, task, layer, CASE WHEN task = 'question_type' THEN 'accuracy' ELSE 'mse' END AS metric, round_even(sum(CASE WHEN task = 'question_type' THEN greatest(sy, n - sy) ELSE syy - sy * sy / n END) / sum(n), 6) AS value FROM hg GROUP BY language, task, layer)"""


@query("features_vs_probes", f"""WITH {_BEST}, {_PROBES}, o AS (SELECT *, row_number() OVER (PARTITION BY language, task ORDER BY CASE WHEN metric = 'mse' THEN -value ELSE value END DESC, language, model, experiment_type DESC) AS pos FROM u WHERE value IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY language, task ORDER BY CASE WHEN metric = 'mse' THEN -value ELSE value END DESC, language, layer) AS pos FROM pr)
SELECT o.language, o.task, o.metric, round_even(o.value, 6) AS features_value, o.model AS features_model, p.value AS probe_value, CAST(p.layer AS INTEGER) AS probe_layer FROM o JOIN p USING (language, task) WHERE o.pos = 1 AND p.pos = 1""")
def features_vs_probes(spark, sf):
    return r6(results.features_vs_probes(results.long_form(completed(spark, sf)), _probes(spark, sf)), "features_value")


@query("layers_six_to_ten", f"WITH {_PROBES} SELECT CASE language WHEN 'ar' THEN 'Arabic' WHEN 'en' THEN 'English' WHEN 'fi' THEN 'Finnish' WHEN 'id' THEN 'Indonesian' WHEN 'ja' THEN 'Japanese' WHEN 'ko' THEN 'Korean' ELSE 'Russian' END AS language, task, round_even(avg(value), 6) AS mean FROM pr WHERE layer BETWEEN 6 AND 10 GROUP BY ALL")
def layers_six_to_ten(spark, sf):
    rows = _probes(spark, sf).withColumn("name", F.concat(F.lit("layer_"), F.col("layer").cast("string")))
    return r6(rows.where(projection.layer_of(F.col("name")).between(6, 10)).groupBy(projection.display_name(F.col("language")).alias("language"), "task").agg(F.avg("value").alias("mean")), "mean")


@query("control_names", f"WITH {_STD} SELECT regexp_extract(dataset_config, 'control_(.+)_seed', 1) AS label, count(*) AS n FROM std WHERE dataset_config LIKE 'control%' GROUP BY ALL")
def control_names(spark, sf):
    label = projection.control_of(F.col("dataset_config"))
    return standard(spark, sf).where(projection.contains(F.col("dataset_config"), "control_")).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("improvement_pivot", f"WITH {_CMP} SELECT task, model_type, " + ", ".join(f"round_even(avg(test_mse_improvement) FILTER (language = '{x}'), 6) + 0.0 AS {x}" for x in LANGUAGES) + " FROM cmp GROUP BY task, model_type")
def improvement_pivot(spark, sf):
    return r6(results.pivoted(results.main_vs_control(completed(spark, sf)), ("task", "model_type"), "language", LANGUAGES, "test_mse_improvement"), *LANGUAGES)


@query("layer_pivot", f"WITH {_PROBES} SELECT CAST(layer AS INTEGER) AS layer, " + ", ".join(f"max(value) FILTER (language = '{x}') AS {x}" for x in LANGUAGES) + " FROM pr WHERE task = 'question_type' GROUP BY layer")
def layer_pivot(spark, sf):
    return results.unique_pivot(_probes(spark, sf).where("task = 'question_type'"), ("layer",), "language", LANGUAGES, "value")


@query("result_frequencies", f"WITH {_STD} " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM std GROUP BY {c}" for c in ("status", "task", "model_type", "language")))
def result_frequencies(spark, sf):
    return results.frequencies(standard(spark, sf))


@query("error_categories", f"WITH {_STD} SELECT CASE WHEN lower(error) LIKE '%memory%' THEN 'memory' WHEN lower(error) LIKE '%timeout%' THEN 'timeout' WHEN lower(error) LIKE '%shape%' THEN 'shape' WHEN lower(error) LIKE '%import%' THEN 'import' ELSE 'other' END AS category, count(*) AS n FROM std WHERE error IS NOT NULL GROUP BY ALL")
def error_categories(spark, sf):
    return standard(spark, sf).where("error IS NOT NULL").groupBy(results.error_category(F.col("error")).alias("category")).agg(F.count("*").alias("n"))


@query("primary_metrics", f"WITH {_STD} SELECT experiment_id, round_even(CASE WHEN task_type = 'classification' THEN test_accuracy ELSE test_mse END, 6) AS value FROM done")
def primary_metrics(spark, sf):
    return r6(completed(spark, sf).select("experiment_id", projection.primary_metric(F.col("task_type"), F.col("test_accuracy"), F.col("test_mse")).alias("value")), "value")


@query("success_rate", f"WITH {_STD} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round_even(count(*) FILTER (status = 'completed') / CAST(greatest(1, count(*)) AS DOUBLE), 6) AS success_rate FROM std")
def success_rate(spark, sf):
    return r6(results.success(standard(spark, sf)), "success_rate")


@query("duration_hours", f"WITH {_STD} SELECT round_even((max(second) - min(second)) / 3600.0, 6) AS duration_hours FROM std")
def duration_hours(spark, sf):
    return r6(results.duration_hours(standard(spark, sf)), "duration_hours")


@query("box_plot_numbers", f"""WITH {_STD} SELECT language, experiment_type, round_even(min(test_mse), 6) AS low, round_even(quantile_cont(test_mse, 0.25), 6) AS q1, round_even(quantile_cont(test_mse, 0.5), 6) AS median, round_even(quantile_cont(test_mse, 0.75), 6) AS q3, round_even(max(test_mse), 6) AS high, count(test_mse) AS n
FROM done WHERE test_mse IS NOT NULL GROUP BY language, experiment_type""")
def box_plot_numbers(spark, sf):
    return r6(results.five_numbers(completed(spark, sf), ("language", "experiment_type"), "test_mse"), "low", "q1", "median", "q3", "high")


@query("train_time_histogram", f"WITH {_STD}, e AS (SELECT min(train_time) AS lo, max(train_time) AS hi FROM done) SELECT CAST(least(floor((train_time - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n FROM done, e GROUP BY ALL")
def train_time_histogram(spark, sf):
    return results.histogram(completed(spark, sf), "train_time", 30)


@query("result_inventory", f"""WITH {_BEST}, l AS ({' UNION ALL '.join(f"SELECT language, model_type AS model, task, '{m}' AS metric FROM done WHERE test_{m} IS NOT NULL" for m in results.METRICS)})
SELECT count(*) AS total, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, string_agg(DISTINCT model, ',' ORDER BY model) AS models, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics FROM l""")
def result_inventory(spark, sf):
    return results.inventory(results.long_form(completed(spark, sf)))


@query("probe_tracker_csv", f"WITH {_PROBES} SELECT language, task, count(*) AS n, round_even(sum(value), 6) AS total FROM pr GROUP BY ALL")
def probe_tracker_csv(spark, sf):
    """Probe results through the tracker file; its textual rows are dropped on reading."""
    path = f"{Scratch(spark, 'tracker').path}/probe_results.csv"
    rows = _probes(spark, sf).select(F.lit("probe").alias("experiment_type"), "language", "task", F.lit(None).cast("string").alias("submetric"), F.lit("0").alias("control_index"), F.col("layer").alias("layer_index"), "metric", F.col("value").cast("string").alias("value"))
    readers.append_tracker(rows.unionByName(rows.withColumn("metric", F.lit("primary_metric")).withColumn("value", F.lit("mse"))), path)
    return r6(readers.probe_tracker(spark, [path, path]).groupBy("language", "task").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


def _importance_docs(spark, sf):
    """Coefficients of the bins of the measure: each cell's ridge on them, four times as much on the logit scale, squared as a gain."""
    stats = statistics(spark, sf).where("part = 'train' AND control_index = 0")
    mean = F.sum("sy").over(W.partitionBy("language", "task")) / F.sum("n").over(W.partitionBy("language", "task"))
    c = stats.select("language", "task", "x", F.bround((F.col("sy") - mean * F.col("n")) / (F.col("n") + 1), 9).alias("c"))
    each = c.groupBy("language", "task").agg(*[F.coalesce(F.max(F.when(F.col("x") == k, F.col("c"))), F.lit(0.0)).alias(f"c{k}") for k in range(grouped.BINS)])
    g = grid.experiment_grid(spark).where("control_index IS NULL").withColumn("task", F.coalesce("submetric", "task")).join(each, ["language", "task"])
    value = lambda k: F.when(F.col("model_type") == "ridge", F.col(f"c{k}")).when(F.col("model_type") == "logistic", F.col(f"c{k}") * 4).otherwise(F.bround(F.col(f"c{k}") * F.col(f"c{k}"), 9))
    return g.select("task", "task_type", "language", "model_type", F.array(*[value(k) for k in range(grouped.BINS)]).alias("feature_importance"))


_IMP = f"""{_GRID}, {_STATS}, mn AS (SELECT language, task, sum(sy) / sum(n) AS m FROM bins WHERE control_index = 0 GROUP BY ALL), cf AS (SELECT language, task, x, round_even((sy - m * n) / (n + 1), 9) AS c FROM bins JOIN mn USING (language, task) WHERE control_index = 0),
d AS (SELECT label AS task, task_type, grid.language, model_type FROM grid JOIN mn ON mn.language = grid.language AND mn.task = grid.label WHERE control_index IS NULL AND model_type <> 'dummy'),
i AS (SELECT d.*, ix, CASE model_type WHEN 'ridge' THEN coalesce(c, 0) WHEN 'logistic' THEN coalesce(c, 0) * 4 ELSE round_even(coalesce(c, 0) * coalesce(c, 0), 9) END AS importance FROM d, (SELECT unnest(range(0, {grouped.BINS})) AS ix) LEFT JOIN cf ON cf.language = d.language AND cf.task = d.task AND cf.x = ix),
o AS (SELECT *, row_number() OVER (PARTITION BY task, task_type, language, model_type ORDER BY abs(importance) DESC, ix) AS rank FROM i), top AS (SELECT *, CASE WHEN ix < 12 THEN 'term' || CAST(ix AS VARCHAR) ELSE 'feature_' || CAST(ix AS VARCHAR) END AS feature_name FROM o WHERE rank <= 10)"""


def _top_importances(spark, sf):
    names = spark.range(12).select(F.concat(F.lit("term"), F.col("id").cast("string")).alias("term"), F.col("id").cast("int").alias("term_id"))
    return results.top_importances(_importance_docs(spark, sf), names)


@query("importance_top10", f"WITH {_IMP} SELECT CAST(rank AS INTEGER) AS rank, task, task_type, language, model_type, feature_name, round_even(importance, 6) AS importance, round_even(abs(importance), 6) AS abs_importance FROM top")
def importance_top10(spark, sf):
    return r6(_top_importances(spark, sf), "importance", "abs_importance")


@query("importance_summary", f"""WITH {_IMP}, s AS (SELECT task_type, feature_name, round_even(avg(abs(importance)), 4) AS avg_abs_importance, round_even(stddev_samp(abs(importance)), 4) AS std_abs_importance, count(*) AS frequency, round_even(avg(importance), 4) AS avg_importance FROM top GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY avg_abs_importance DESC, feature_name) AS rank FROM s) SELECT task_type, feature_name, avg_abs_importance, std_abs_importance, frequency, avg_importance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def importance_summary(spark, sf):
    return results.importance_summary(_top_importances(spark, sf))


@query("importance_inventory", f"WITH {_IMP} SELECT count(*) FILTER (task_type = 'classification') AS classification_rows, count(*) FILTER (task_type = 'regression') AS regression_rows, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, string_agg(DISTINCT model_type, ',' ORDER BY model_type) AS model_types FROM top")
def importance_inventory(spark, sf):
    return results.importance_inventory(_top_importances(spark, sf))


@query("top50_importances", f"WITH {_IMP} SELECT task, language, model_type, ix, round_even(importance, 6) AS importance FROM i ORDER BY abs(importance) DESC, task, language, model_type, ix LIMIT 50")
def top50_importances(spark, sf):
    rows = _importance_docs(spark, sf).where("model_type != 'dummy'").select("task", "language", "model_type", F.posexplode("feature_importance").alias("ix", "importance"))
    return r6(rows.orderBy(F.desc(F.abs("importance")), "task", "language", "model_type", "ix").limit(50), "importance")


#: How far the prediction of a constant has come to the training mean, by epoch: it overshoots and swings back.
_SWING = [round(1 - (-0.6) ** e, 9) for e in range(1, 13)]


def _history(spark, sf):
    """Twelve epochs of a constant learned for each main experiment: validation loss, and on how many sides of it bins lie."""
    stats = statistics(spark, sf).where("control_index = 0")
    mean = stats.where("part = 'train'").groupBy("language", "task").agg((F.sum("sy") / F.sum("n")).alias("m"))
    swing = F.posexplode(F.array(*map(F.lit, _SWING))).alias("e", "f")
    rows = stats.where("part = 'val'").join(mean, ["language", "task"]).select("*", swing).withColumn("p", F.col("m") * F.col("f"))
    loss = F.sum(F.col("syy") - 2 * F.col("p") * F.col("sy") + F.col("n") * F.col("p") * F.col("p")) / F.sum("n")
    each = rows.groupBy("language", "task", (F.col("e") + 1).alias("epoch")).agg(F.bround(loss, 9).alias("val_loss"), F.count_distinct(F.col("sy") > F.col("p") * F.col("n") + 1e-9).cast("int").alias("classes"))
    runs = grid.experiment_grid(spark).where("control_index IS NULL").select(F.col("experiment_id").alias("run"), "language", F.coalesce("submetric", "task").alias("task"))
    return runs.join(each, ["language", "task"]).select("run", "epoch", "val_loss", "classes")


_HIST = f"""{_GRID}, {_STATS}, tm AS (SELECT language, task, sum(sy) / sum(n) AS m FROM bins WHERE control_index = 0 GROUP BY ALL),
ep AS (SELECT language, task, epoch, round_even(sum(syy - 2 * p * sy + n * p * p) / sum(n), 9) AS val_loss, CAST(count(DISTINCT sy > p * n + 1e-9) AS INTEGER) AS classes FROM (
  SELECT s.*, e.epoch, m * CAST(({_list(_SWING)})[e.epoch] AS DOUBLE) AS p FROM stats s JOIN tm USING (language, task), (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS epoch) e WHERE control_index = 0 AND part = 'val') GROUP BY language, task, epoch),
h AS (SELECT g.experiment_id AS run, epoch, val_loss, classes FROM grid g JOIN ep ON ep.language = g.language AND ep.task = g.label WHERE g.control_index IS NULL)"""


@query("patience_trace", f"""WITH {_HIST}, a AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(val_loss) OVER (PARTITION BY run ORDER BY epoch) AS best_loss FROM h),
b AS (SELECT *, before IS NULL OR val_loss < before AS improved FROM a), c AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS best_epoch FROM b)
SELECT run, epoch, best_loss, improved, best_epoch, epoch - best_epoch AS waited, max(CASE WHEN epoch - best_epoch >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch) = 1 AS stopped FROM c""")
def patience_trace(spark, sf):
    return results.patience_trace(_history(spark, sf), ("run",)).select("run", "epoch", "best_loss", "improved", "best_epoch", "waited", "stopped")


@query("one_class_runs", f"""WITH {_HIST}, a AS (SELECT *, sum(CASE WHEN classes > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch) AS island FROM h)
SELECT run, count(*) AS epochs, min(epoch) AS from_epoch FROM a WHERE classes <= 1 GROUP BY run, island HAVING count(*) >= 3""")
def one_class_runs(spark, sf):
    return results.one_class_runs(_history(spark, sf), ("run",))


@query("remaining_experiments", f"WITH {_STD} SELECT experiment_id FROM std WHERE status <> 'completed'")
def remaining_experiments(spark, sf):
    return grid.remaining(grid.experiment_grid(spark), completed(spark, sf)).select("experiment_id")


# --- Checks: V1-V14 -------------------------------------------------------------------------------


@query("metric_range_checks", f"WITH {_STD} SELECT language, task, model_type AS model, 'r2' AS metric, 'r2 above 1' AS \"check\" FROM done WHERE test_r2 * 3 > 1")
def metric_range_checks(spark, sf):
    long = results.long_form(completed(spark, sf)).withColumn("value", F.when(F.col("metric") == "r2", F.col("value") * 3).otherwise(F.col("value")))
    return checks.metric_ranges(long)


@query("label_domain_checks", "SELECT doc_id, 'outside domain' AS \"check\" FROM labels WHERE quality + toxic NOT IN (0, 1)")
def label_domain_checks(spark, sf):
    return checks.label_domain(read(spark, sf, "labels").withColumn("sum", F.col("quality") + F.col("toxic")), "sum", "classification")


@query("unmatched_rows", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'no features' ELSE 'no label' END AS \"check\" FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def unmatched_rows(spark, sf):
    return checks.unmatched(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query("coverage_antijoin", f"WITH {_STD}, w(dimension, value) AS (SELECT 'language', unnest({_list(LANGUAGES)}) UNION ALL SELECT 'task', unnest({_list(('question_type', 'complexity', 'absent'))})) SELECT dimension, value FROM w WHERE NOT ((dimension = 'language' AND value IN (SELECT language FROM done)) OR (dimension = 'task' AND value IN (SELECT task FROM done)))")
def coverage_antijoin(spark, sf):
    done = completed(spark, sf)
    return checks.coverage(done, "language", LANGUAGES).unionByName(checks.coverage(done, "task", ("question_type", "complexity", "absent")))


@query("baseline_checks", f"WITH {_STD}, m AS (SELECT * FROM done WHERE experiment_type = 'main') " + " UNION ALL ".join(
    f"SELECT '{k}' AS task_type, '{m}' AS model_type, '{x}' AS metric, {'min' if lower else 'max'}(test_{x}) AS value, {'min' if lower else 'max'}(test_{x}) {'>=' if lower else '<='} {b} AS ok FROM m WHERE task_type = '{k}' AND model_type = '{m}'" for k, m, x, lower, b in checks.BASELINES
))
def baseline_checks(spark, sf):
    return checks.baselines(completed(spark, sf))


@query("missing_metric_values", f"WITH {_STD} " + " UNION ALL ".join(f"SELECT 'test_{m}' AS \"column\", count(*) FILTER (test_{m} IS NULL) AS missing FROM std HAVING count(*) FILTER (test_{m} IS NULL) > 0" for m in ("accuracy", "mse")))
def missing_metric_values(spark, sf):
    return checks.missing_values(standard(spark, sf), ["test_accuracy", "test_mse"])


@query("probability_sums", "SELECT event_id AS doc_id, round_even(value + (1 - value) + CASE WHEN event_id % 50 = 0 THEN 0.5 ELSE 0 END, 6) AS total FROM events WHERE event_id % 50 = 0")
def probability_sums(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("value").alias("p1"), (1 - F.col("value")).alias("p0"), F.when(F.col("event_id") % 50 == 0, 0.5).otherwise(0.0).alias("extra"))
    return r6(checks.probability_sums(rows, ["p1", "p0", "extra"]), "total")


@query("values_out_of_range", "SELECT doc_id, n_chars FROM documents WHERE NOT n_chars BETWEEN 100 AND 10000")
def values_out_of_range(spark, sf):
    return checks.out_of_range(read(spark, sf, "documents"), "n_chars", 100, 10000)


@query("unsupported_languages", "SELECT DISTINCT lang AS language FROM documents WHERE lang <> 'en'")
def unsupported_languages(spark, sf):
    return checks.unsupported_languages(read(spark, sf, "documents").withColumnRenamed("lang", "language"))


@query("interface_disagreement", "SELECT doc_id, quality, 'first' AS side FROM labels WHERE quality <> toxic UNION ALL SELECT doc_id, toxic, 'second' FROM labels WHERE quality <> toxic")
def interface_disagreement(spark, sf):
    rows = read(spark, sf, "labels")
    return checks.disagreement(rows.select("doc_id", "quality"), rows.select("doc_id", F.col("toxic").alias("quality")))


# --- Hidden states and models: M3-M6, M8-M16, M22 ---------------------------------------------------


def hidden(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as four tokens of sixteen numbers, the last masked for odd ids."""
    v = read(spark, sf, "embeddings")
    piece = lambda k: F.transform(F.slice("embedding", 1 + 16 * k, 16), lambda x: x.cast("double"))
    return v.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("layer"), F.array(*[piece(k) for k in range(4)]).alias("tokens"), F.array(*[F.lit(1)] * 3, F.when(F.col("vec_id") % 2 == 0, 1).otherwise(0)).alias("mask"))


@query("mean_pool_embeddings", """WITH e AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END AS m FROM embeddings)
SELECT doc_id, round_even((v[1] + v[17] + v[33] + m * v[49]) / (3 + m), 6) AS first, round_even((v[16] + v[32] + v[48] + m * v[64]) / (3 + m), 6) AS last FROM e""")
def mean_pool_embeddings(spark, sf):
    return r6(models.pooled(hidden(spark, sf)).select("doc_id", F.element_at("embedding", 1).alias("first"), F.element_at("embedding", -1).alias("last")), "first", "last")


@query("cls_pool_embeddings", "SELECT vec_id AS doc_id, round_even(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def cls_pool_embeddings(spark, sf):
    return r6(models.pooled(hidden(spark, sf), "cls", 5, 1).select("doc_id", F.element_at("embedding", 1).alias("first")), "first")


@query("padded_ids", "SELECT doc_id, CAST(coalesce(list_sum(list_transform(range(1, least(CAST(doc_id % 200 AS INTEGER), 128) + 1), lambda x: x)), 0) AS BIGINT) AS total, least(doc_id % 200, 128) AS used, CAST(128 AS INTEGER) AS length FROM documents")
def padded_ids(spark, sf):
    n = (F.col("doc_id") % 200).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("CAST(array() AS array<int>)"))
    rows = read(spark, sf, "documents").select("doc_id", ids.alias("input_ids"), F.lit(1).alias("label"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return models.tokenized(rows, pad=0).select("doc_id", add("input_ids").alias("total"), add("attention_mask").alias("used"), F.size("input_ids").alias("length"))


def probe_rows(spark: SparkSession, sf: str) -> DataFrame:
    v = models.dense_rows(read(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"))
    return v.select("doc_id", "features", "embedding", F.col("label").alias("class"), (F.col("label") >= 5).cast("double").alias("label"), F.expr(_SPLIT).alias("split"))


def _fitted(spark, sf, model: str, kind: str, label: Column, **params) -> DataFrame:
    rows = probe_rows(spark, sf).withColumn("label", label.cast("double"))
    out = models.estimator(model, kind, params)(rows.where("split = 'train'")).transform(rows.where("split != 'train'"))
    return r6(out.select("doc_id", "label", F.col("prediction").cast("double").alias("prediction")), "prediction", digits=4)


@query("logistic_probe")
def logistic_probe(spark, sf):
    return _fitted(spark, sf, "logistic", "classification", F.col("label"))


@query("ridge_probe")
def ridge_probe(spark, sf):
    return _fitted(spark, sf, "ridge", "regression", F.col("class"))


@query("gbt_probe")
def gbt_probe(spark, sf):
    return _fitted(spark, sf, "xgboost", "classification", F.col("label"), n_estimators=5, max_depth=3)


@query("forest_probe")
def forest_probe(spark, sf):
    return _fitted(spark, sf, "random_forest", "regression", F.col("class"), n_estimators=20)


# --- Models whose fits SQL repeats: M1, M2, M3, M4, M6, M10, M22, N6 ---

_CLASS_DRAWN = ("most_frequent", "prior", "stratified", "uniform", "constant")
_U = "CAST(('0x' || substr(md5(CAST(l.doc_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT) / 4294967296.0"


@query("dummy_class_strategies", f"""WITH {_LABELLED}, t AS (SELECT lang, quality AS label, count(*) AS n FROM l WHERE split = 'train' AND quality IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY label) AS upto, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY label) - 1 AS at, count(*) OVER (PARTITION BY lang) AS k, row_number() OVER (PARTITION BY lang ORDER BY n DESC, label) AS pos FROM t),
u AS (SELECT l.doc_id, l.lang, {_U} AS u FROM l WHERE split <> 'train')
SELECT doc_id, 'most_frequent' AS strategy, label AS prediction FROM u LEFT JOIN r ON r.lang IS NOT DISTINCT FROM u.lang AND pos = 1 UNION ALL SELECT doc_id, 'prior', label FROM u LEFT JOIN r ON r.lang IS NOT DISTINCT FROM u.lang AND pos = 1
UNION ALL SELECT doc_id, 'stratified', min(label) FROM u LEFT JOIN r ON r.lang IS NOT DISTINCT FROM u.lang AND upto > u.u * total GROUP BY doc_id UNION ALL SELECT doc_id, 'uniform', max(label) FROM u LEFT JOIN r ON r.lang IS NOT DISTINCT FROM u.lang AND r.at = least(floor(u.u * r.k), r.k - 1) GROUP BY doc_id
UNION ALL SELECT doc_id, 'constant', 1 FROM u""")
def dummy_class_strategies(spark, sf):
    """What each strategy of the dummy classifier predicts for the rows held out, by language."""
    rows = labelled(spark, sf).withColumn("label", F.col("quality"))
    train, test = rows.where("split = 'train'"), rows.where("split != 'train'").select("doc_id", "lang")
    out = [models.dummy_classifier(train, test, by=("lang",), strategy=s, constant=1, key="doc_id").select("doc_id", F.lit(s).alias("strategy"), F.col("prediction").cast("int").alias("prediction")) for s in _CLASS_DRAWN]
    return normalize.combined(out)


@query("dummy_value_strategies", f"""WITH {_LABELLED}, t AS (SELECT lang, avg(n_chars) AS mean, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.9) AS q FROM l WHERE split = 'train' GROUP BY lang)
SELECT lang, 'mean' AS strategy, round_even(mean, 6) AS prediction FROM t UNION ALL SELECT lang, 'median', round_even(median, 6) FROM t UNION ALL SELECT lang, 'quantile', round_even(q, 6) FROM t UNION ALL SELECT lang, 'constant', 7.0 FROM t""")
def dummy_value_strategies(spark, sf):
    """What each strategy of the dummy regressor predicts, by language."""
    rows = labelled(spark, sf).withColumn("label", F.col("n_chars").cast("double"))
    train = rows.where("split = 'train'")
    test = train.select("lang").distinct()
    out = [models.dummy_regressor(train, test, by=("lang",), strategy=s, constant=7.0, quantile=0.9).select("lang", F.lit(s).alias("strategy"), F.col("prediction").cast("double").alias("prediction")) for s in models.VALUE_STRATEGIES]
    return r6(normalize.combined(out), "prediction")


@query("stored_batch", f"""WITH l AS (SELECT doc_id, lang, {_SPLIT} AS split, CAST(quality AS INTEGER) AS q, length(text) / 1000.0 AS y FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND lang IS NOT NULL),
m AS (SELECT lang, avg(y) AS mean, CASE WHEN sum(q) * 2 > count(*) THEN 1 ELSE 0 END AS most FROM l WHERE split = 'train' GROUP BY lang), t AS (SELECT l.*, mean, most FROM l JOIN m USING (lang) WHERE split = 'test')
SELECT lang AS language, 'question_type' AS task, round_even(avg(CASE WHEN q = most THEN 1.0 ELSE 0.0 END), 6) AS value, count(*) AS batches FROM t GROUP BY lang UNION ALL SELECT lang, 'n_tokens', round_even(avg((y - mean) * (y - mean)), 6), count(*) FROM t GROUP BY lang""".replace("count(*) AS batches", "1 AS batches").replace("6), count(*) FROM t GROUP BY lang", "6), 1 FROM t GROUP BY lang"))
def stored_batch(spark, sf):
    """Dummy experiments of every language, fitted and stored one by one, in two goes of which the second takes up what is left."""
    docs = read(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").alias("language"), F.expr(_SPLIT).alias("split"), F.lit("base").alias("config"), (F.length("text") / 1000.0).alias("n_tokens"))
    data = Scratch(spark, "dataset").keep(docs.join(read(spark, sf, "labels").select("doc_id", F.col("quality").alias("question_type")), "doc_id"), "rows")
    languages = [r["language"] for r in data.select("language").distinct().orderBy("language").collect()]  # a row a language
    cells = [{"language": x, "task": t, "model_type": "dummy", "config": "base"} for x in languages for t in ("question_type", "n_tokens")]
    store = f"{Scratch(spark, 'store').path}/results"
    for some in (cells[: len(cells) // 2], cells):
        experiments.run_batch(data, some, max_features=200, store=store)
    rows = results.standardized(readers.result_json(spark, store))
    return r6(rows.groupBy("language", "task").agg(F.avg(F.coalesce("test_accuracy", "test_mse")).alias("value"), F.count("*").cast("int").alias("batches")), "value")


#: Two features of a document: its length in steps of 500 characters, and its line breaks, which two thirds of the documents have.
_LENGTH, _BREAKS = "least(CAST(floor(n_chars / 500) AS INTEGER), 40)", "least(len(string_split(text, chr(10))) - 1, 30)"


def measured_entries(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(entries, rows): doc_id, feature, value of two measures; doc_id, lang, split, quality, size of labelled documents."""
    docs = read(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL").join(read(spark, sf, "labels"), "doc_id")
    breaks = F.least(F.size(F.split("text", "\n")) - 1, F.lit(30))
    rows = docs.select("doc_id", "lang", F.expr(_SPLIT).alias("split"), "quality", (F.length("text") / 1000.0).alias("size"), F.least(F.floor(F.col("n_chars") / 500).cast("int"), F.lit(40)).alias("a"), F.when(F.col("doc_id") % 3 > 0, breaks).alias("b"))
    rows = Scratch(spark, "entries").keep(rows, "rows")
    pairs = F.explode(F.array(F.struct(F.lit(0).alias("feature"), F.col("a").cast("double").alias("value")), F.struct(F.lit(1).alias("feature"), F.col("b").cast("double").alias("value")))).alias("e")
    return rows.select("doc_id", pairs).select("doc_id", "e.feature", "e.value").where("value IS NOT NULL"), rows.drop("a", "b")


_ENTRIES = f"""d AS (SELECT doc_id, lang, {_SPLIT} AS split, quality, length(text) / 1000.0 AS size, {_LENGTH} AS a, CASE WHEN doc_id % 3 > 0 THEN {_BREAKS} END AS b FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND lang IS NOT NULL),
e AS (SELECT doc_id, lang, split, quality, 0 AS feature, a AS value FROM d UNION ALL SELECT doc_id, lang, split, quality, 1, b FROM d WHERE b IS NOT NULL)"""


@query("boosted_stump", f"""WITH {_ENTRIES}, m AS (SELECT lang, avg(quality) AS p, count(*) AS n FROM d WHERE split = 'train' GROUP BY lang), t AS (SELECT e.*, p - quality AS g, p * (1 - p) AS h FROM e JOIN m USING (lang) WHERE split = 'train'),
w AS (SELECT lang, sum(p - quality) AS tg, sum(p * (1 - p)) AS th FROM d JOIN m USING (lang) WHERE split = 'train' GROUP BY lang), f AS (SELECT lang, feature, sum(g) AS fg, sum(h) AS fh, count(*) AS fn FROM t GROUP BY ALL),
v AS (SELECT lang, feature, value, sum(sum(g)) OVER x AS ug, sum(sum(h)) OVER x AS uh, sum(count(*)) OVER x AS un FROM t GROUP BY lang, feature, value WINDOW x AS (PARTITION BY lang, feature ORDER BY value)),
c AS (SELECT v.lang, v.feature, v.value, ml, tg, th, m.n, ug + CASE WHEN ml THEN tg - fg ELSE 0 END AS gl, uh + CASE WHEN ml THEN th - fh ELSE 0 END AS hl, un + CASE WHEN ml THEN m.n - fn ELSE 0 END AS nl FROM v JOIN f USING (lang, feature) JOIN w USING (lang) JOIN m USING (lang), (SELECT unnest([false, true]) AS ml)),
k AS (SELECT *, gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) - tg * tg / (th + 1) AS gain FROM c WHERE nl > 0 AND nl < n AND hl >= 1 AND th - hl >= 1),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round_even(gain, 7) DESC, feature, value, ml) AS pos FROM k WHERE gain / 2 > 1e-9)
SELECT lang, feature, CAST(value AS DOUBLE) AS cut, ml AS missing_left, round_even(-0.1 * gl / (hl + 1), 6) AS left_leaf, round_even(-0.1 * (tg - gl) / (th - hl + 1), 6) AS right_leaf FROM b WHERE pos = 1""")
def boosted_stump(spark, sf):
    """One boosted round of depth 1 for every language at once: its split, and where missing values go."""
    entries, rows = measured_entries(spark, sf)
    train = rows.where("split = 'train'").withColumn("label", F.col("quality"))
    model = boosting.fit(entries, train, True, boosting.Parameters(rounds=1, depth=1), cell="lang")
    tree = model.trees.select(F.col("cell").alias("lang"), F.get("trees", F.lit(0)).alias("t")).where(F.get("t.feature", F.lit(1)) >= 0)
    at = lambda c, i: F.get(f"t.{c}", F.lit(i))
    return r6(tree.select("lang", at("feature", 1).alias("feature"), at("cut", 1).alias("cut"), at("missing_left", 1).alias("missing_left"), at("value", 2).alias("left_leaf"), at("value", 3).alias("right_leaf")), "left_leaf", "right_leaf")


@query("boosting_curves")
def boosting_curves(spark, sf):
    """Log loss of every language's trees after each round, on both parts, in one pass."""
    entries, rows = measured_entries(spark, sf)
    rows = rows.withColumn("label", F.col("quality"))
    model = boosting.fit(entries, rows.where("split = 'train'"), True, boosting.Parameters(rounds=4, depth=2, subsample=0.8), cell="lang")
    return r6(model.curve(rows, entries, cell="lang", by=("lang", "split")), "loss")


_LINES = f"""{_ENTRIES}, z AS (SELECT doc_id, lang, split, CAST(a AS DOUBLE) AS a, CAST(coalesce(b, 0) AS DOUBLE) AS b, unnest([{{'label': 'quality', 'y': CAST(quality AS DOUBLE)}}, {{'label': 'size', 'y': CAST(size AS DOUBLE)}}]) AS u FROM d),
y AS (SELECT doc_id, lang, split, a, b, u.label AS label, u.y AS y FROM z), c AS (SELECT *, a - avg(a) OVER g AS ca, b - avg(b) OVER g AS cb, y - avg(y) OVER g AS cy, avg(a) OVER g AS ma, avg(b) OVER g AS mb, avg(y) OVER g AS my FROM y WHERE split = 'train' WINDOW g AS (PARTITION BY lang, label)),
s AS (SELECT lang, label, sum(ca * ca) + 1 AS aa, sum(ca * cb) AS ab, sum(cb * cb) + 1 AS bb, sum(ca * cy) AS ay, sum(cb * cy) AS byy, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my FROM c GROUP BY ALL),
w AS (SELECT lang, label, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS w0, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS w1, ma, mb, my FROM s), l AS (SELECT lang, label, w0, w1, my - w0 * ma - w1 * mb AS b0 FROM w)"""


def _ridge_cells(spark, sf):
    entries, rows = measured_entries(spark, sf)
    data = linear.Rows(entries, rows.where("split = 'train'"), ["quality", "size"], "lang", features=2)
    return entries, rows, linear.ridge(data)


@query("ridge_cells", f"""WITH {_LINES} SELECT lang AS "group", label, 0 AS feature, round_even(w0, 6) AS weight FROM l UNION ALL SELECT lang, label, 1, round_even(w1, 6) FROM l UNION ALL SELECT lang, label, -1, round_even(b0, 6) FROM l""")
def ridge_cells(spark, sf):
    """Ridge regressions of all languages and two labels together, by conjugate gradients."""
    return r6(_ridge_cells(spark, sf)[2].table(spark), "weight")


@query("transfer_matrix", f"""WITH {_LINES} SELECT l.lang AS train_language, y.lang AS test_language, y.label, round_even(avg((y.y - w0 * a - w1 * b - b0) * (y.y - w0 * a - w1 * b - b0)), 6) AS mse, count(*) AS n FROM y JOIN l USING (label) WHERE split = 'test' GROUP BY l.lang, y.lang, y.label""")
def transfer_matrix(spark, sf):
    """Every language's models on every language's test rows, in one pass."""
    entries, rows, weights = _ridge_cells(spark, sf)
    test = rows.where("split = 'test'")
    long = test.select("doc_id", F.col("lang").alias("language"), F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("y")) for c in ("quality", "size")])).alias("u")).select("doc_id", "language", "u.label", "u.y")
    return r6(models.transfer_matrix(weights, test, entries, long), "mse")


@query("sparse_logistic", "SELECT DISTINCT lang AS \"group\", true AS optimal FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND lang IS NOT NULL")
def sparse_logistic(spark, sf):
    """Logistic regressions with absolute penalty, all languages together: whether each meets the optimality conditions."""
    entries, rows = measured_entries(spark, sf)
    got = linear.logistic(linear.Rows(entries, rows, ["quality"], "lang", features=2), c=0.1, penalty="l1")
    return spark.createDataFrame([(g, bool(s.max() < 1e-3)) for g, s in zip(got.groups, got.gradient)], "group string, optimal boolean")


@query("shuffled_order", f"WITH {_PIPE} SELECT doc_id, row_number() OVER (ORDER BY {_DRAW(69)}, doc_id) AS position FROM rounded")
def shuffled_order(spark, sf):
    """All rows in a reproducible random order, as a column."""
    return normalize.shuffled(_rounded(spark, sf).select("doc_id"), 69)


@query("mlp_probes")
def mlp_probes(spark, sf):
    """One probe for each residue of the id, trained side by side."""
    rows = probe_rows(spark, sf).select((F.col("doc_id") % 3).cast("int").alias("layer"), "doc_id", "split", "label", "embedding")
    return models.probes(rows, ("layer",), classes=2, hidden=(32,), epochs=20)


@query("transfer_metrics")
def transfer_metrics(spark, sf):
    """Fit on one half of the vectors, evaluate on the other, as one language to another."""
    rows = probe_rows(spark, sf).withColumn("language", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fi"))
    got = models.transfer(rows, "en", "fi", "ridge", "regression")
    return spark.createDataFrame(sorted((k, round(v, 6)) for k, v in got.items()), "metric string, value double")


# --- Sinks, checks and models whose results SQL repeats: S4, S12, S13, S22, S25, S26, F3, V1, V3, V6, V14, M4, M8-M12, M21 ---


@query("cached_rows", "SELECT doc_id, n_chars FROM documents")
def cached_rows(spark, sf):
    """A cache answers later calls from its first one."""
    path = f"{Scratch(spark, 'cached').path}/rows"
    rows = read(spark, sf, "documents").select("doc_id", "n_chars")
    readers.cache_table(rows, path)
    return readers.cache_table(rows.where("false"), path)


@query("class_text_files", f"WITH {_ASKED} SELECT language, final_class, count(*) AS n, CAST(sum(length(trim(text))) AS BIGINT) AS chars FROM e JOIN s USING (sid) WHERE dropped IS NULL AND final_class IS NOT NULL GROUP BY ALL".replace("e JOIN s USING (sid)", "e JOIN (SELECT sid, text FROM s) s USING (sid)"))
def class_text_files(spark, sf):
    """Questions written a line each by language and class, and read again."""
    path = f"{Scratch(spark, 'class-text').path}/text"
    readers.write_class_text(labelling.label_corpus(asked(spark, sf))["classified"], path)
    rows = spark.read.schema("value STRING, language STRING, final_class STRING").text(path)
    return rows.groupBy("language", "final_class").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query("treebank_files", f"WITH {_DEALT_SENTENCES}, b AS (SELECT language, CASE WHEN NOT question THEN 'other' WHEN rejected THEN 'filtered' ELSE coalesce(ud, 'unclassified') END AS bucket FROM said) SELECT language, bucket, 2 * count(*) AS sentences FROM b GROUP BY ALL")
def treebank_files(spark, sf):
    """Sentences appended twice to treebank files by language and bucket, and read again."""
    path = f"{Scratch(spark, 'treebank').path}/files"
    routed = labelling.route_sentences(dealt_sentences(spark, sf)).withColumn("lines", F.array(F.concat(F.lit("# text = "), "text"), F.lit("1\tw")))
    for _ in range(2):
        readers.write_conllu(routed, path)
    part = lambda name: F.regexp_extract("file", rf"/{name}=([^/]+)/", 1).alias(name)
    return readers.conllu(spark, path, "*.txt").groupBy(part("language"), part("bucket")).agg(F.count("*").alias("sentences"))


@query("synthetic_splits", """WITH n AS (SELECT count(*) AS n FROM documents), d AS (SELECT CASE WHEN doc_id < CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN doc_id < CAST(floor(n * 0.7) AS BIGINT) + CAST(floor(n * 0.15) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM documents, n)
SELECT split, count(*) AS documents, true AS all_have_terms, true AS sparse FROM d GROUP BY split""")
def synthetic_splits(spark, sf):
    """Made-up features for the documents' ids."""
    ids = read(spark, sf, "documents").select("doc_id")
    rows = readers.synthetic_features(spark, ids.count(), 300, ids=ids)
    return rows.groupBy("split").agg(F.countDistinct("doc_id").alias("documents"), (F.min("tfidf") > 0).alias("all_have_terms"), (F.count("*") / (F.countDistinct("doc_id") * 300) < 0.15).alias("sparse"))


@query("feature_store_checks", f"""WITH {_TERMS}, x AS (SELECT {_SPLIT} AS split, term_id, doc_id FROM vectors), k AS (SELECT count(*) AS k FROM vocab), p AS (SELECT split, 1 - count(*) / (count(DISTINCT doc_id) * any_value(k)) AS sparsity FROM x, k GROUP BY split)
SELECT 'missing split' AS "check", 'validation' AS value UNION ALL SELECT DISTINCT 'foreign term', split || ':' || CAST(term_id AS VARCHAR) FROM x WHERE split <> 'validation' AND term_id >= 500 AND term_id % 97 = 0
UNION ALL SELECT 'sparsity', split FROM p WHERE split <> 'validation' AND NOT sparsity BETWEEN 0 AND 0.5""")
def feature_store_checks(spark, sf):
    """A store that lacks a split and some terms of its vocabulary; sparsity above one half is to be found too."""
    path = f"{Scratch(spark, 'store').path}/store"
    _, counts, vocabulary = _features(spark, sf)
    vocabulary = Scratch(spark, "vocabulary").keep(vocabulary, "vocabulary")
    readers.write_features(tfidf.transform(counts, vocabulary).withColumn("split", F.expr(_SPLIT)).where("split != 'validation'").select("split", "doc_id", "term_id", "tfidf"), vocabulary, path)
    vectors, known = readers.features(spark, path), readers.vocabulary(spark, path)
    gone = checks.missing_splits(vectors).select(F.lit("missing split").alias("check"), F.col("split").alias("value"))
    foreign = checks.foreign_terms(vectors, known.where("NOT (term_id >= 500 AND term_id % 97 = 0)")).select(F.lit("foreign term").alias("check"), F.concat_ws(":", "split", "term_id").alias("value"))
    dense = checks.sparsity(vectors, known.count(), 0.0, 0.5).select(F.lit("sparsity").alias("check"), F.col("split").alias("value"))
    return gone.unionByName(foreign).unionByName(dense)


@query("rows_required", "SELECT lang AS language, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY lang UNION ALL SELECT 'no rows: Klingon', 0")
def rows_required(spark, sf):
    """Rows of a language, and the error where a language has none."""
    docs = read(spark, sf, "documents").select(F.col("lang").alias("language"))
    found = projection.require_rows(projection.in_languages(docs, ["EN"]), "English").groupBy("language").agg(F.count("*").alias("n"))
    try:
        projection.require_rows(projection.in_languages(docs, ["tlh"]), "Klingon")
    except ValueError as e:
        return found.unionByName(spark.createDataFrame([(str(e), 0)], "language string, n long"))
    return found


@query("unequal_lengths", "SELECT doc_id, CAST(doc_id % 5 + 1 AS INTEGER) AS a, CAST(doc_id % 4 + 1 AS INTEGER) AS b FROM documents WHERE doc_id % 5 <> doc_id % 4")
def unequal_lengths(spark, sf):
    upto = lambda n: F.sequence(F.lit(1), (F.col("doc_id") % n + 1).cast("int"))
    return checks.unequal_lengths(read(spark, sf, "documents").select("doc_id", upto(5).alias("a"), upto(4).alias("b")), ["a", "b"])


@query("incompatible_models", f"SELECT language, task_type, model_type FROM (SELECT DISTINCT lang AS language FROM documents WHERE lang IS NOT NULL), (SELECT unnest(['classification', 'regression']) AS task_type), (SELECT unnest({_list(MODELS)}) AS model_type) WHERE (model_type = 'logistic' AND task_type <> 'classification') OR (model_type = 'ridge' AND task_type <> 'regression')")
def incompatible_models(spark, sf):
    """Of all models and task types, for each language of the documents, those that don't go together."""
    kinds = _spoken(spark, sf).select("language", F.explode(F.array(F.lit("classification"), F.lit("regression"))).alias("task_type"))
    return checks.incompatible(kinds.select("language", "task_type", F.explode(F.array(*map(F.lit, MODELS))).alias("model_type")))


@query("dataset_integrity", f"WITH d AS (SELECT {_SPLIT} AS split, lang FROM documents) SELECT 'columns' AS part, true AS ok UNION ALL SELECT 'splits', count(DISTINCT split) = 3 FROM d UNION ALL SELECT 'languages', count(DISTINCT lang) FILTER (lang IN ('en', 'fr', 'fi')) = 3 FROM d")
def dataset_integrity(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), F.expr(_SPLIT).alias("split"))
    return spark.createDataFrame(list(checks.dataset_integrity(docs, ["doc_id", "split"], ["en", "fr", "fi"]).items()), "part string, ok boolean")


_DUMMY = f"""v AS (SELECT label, CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 < 8 THEN 'validation' ELSE 'test' END AS part FROM embeddings), m AS (SELECT avg(label) AS p FROM v WHERE part = 'train'),
z AS (SELECT part, avg((label - p) * (label - p)) AS mse, avg((label - p) * (label - p)) / var_pop(label) AS q FROM v, m GROUP BY part)"""


@query("experiment_metrics", f"WITH {_DUMMY} SELECT part, 'mse' AS metric, round_even(mse, 6) AS value FROM z UNION ALL SELECT part, 'r2', round_even(1 - q, 6) FROM z UNION ALL SELECT part, 'primary_value', round_even(mse, 6) FROM z")
def experiment_metrics(spark, sf):
    """A whole dummy experiment: fitted, evaluated on each part, and its result document taken apart."""
    rows = probe_rows(spark, sf).withColumn("label", F.col("class").cast("double"))
    parts = {p: rows.where(F.col("split") == p) for p in ("train", "validation", "test")}
    got = models.experiment("dummy", "regression", parts)
    found = [(p, m, round(got[f"{p}_metrics"][m], 6)) for p in parts for m in ("mse", "r2", "primary_value")]
    return spark.createDataFrame(found, "part string, metric string, value double")


@query("ridge_line", f"""WITH t AS (SELECT doc_id, CAST(n_chars AS DOUBLE) / 1000 AS x, CAST(quality AS DOUBLE) AS y, {_SPLIT} AS split FROM documents JOIN labels USING (doc_id)),
m AS (SELECT avg(x) AS mx, avg(y) AS my FROM t WHERE split = 'train'), w AS (SELECT sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + 1.0) AS w FROM t, m WHERE split = 'train')
SELECT doc_id, round_even(my + w * (x - mx), 4) AS prediction FROM t, m, w WHERE split <> 'train'""")
def ridge_line(spark, sf):
    """Ridge regression on one feature, whose solution SQL can write down."""
    rows = labelled(spark, sf).select("doc_id", "split", F.col("quality").cast("double").alias("label"), array_to_vector(F.array(F.col("n_chars").cast("double") / 1000)).alias("features"))
    out = models.estimator("ridge", "regression")(rows.where("split = 'train'")).transform(rows.where("split != 'train'"))
    return r6(out.select("doc_id", "prediction"), "prediction", digits=4)


@query("logistic_optimum", "SELECT CAST(unnest(range(0, 65)) AS INTEGER) AS component, true AS optimal")
def logistic_optimum(spark, sf):
    """The fitted logistic regression is the minimum of its objective: every component of the gradient vanishes."""
    rows = probe_rows(spark, sf).where("split = 'train'")
    model = models.estimator("logistic", "classification")(rows)
    weights = spark.createDataFrame([(k, float(w)) for k, w in enumerate([*model.coefficients, model.intercept])], "component int, w double")  # a row a feature
    wrong = F.col("probability") - F.col("label")
    parts = model.transform(rows).select(F.posexplode(F.transform(F.concat(vector_to_array("features"), F.array(F.lit(1.0))), lambda x: x * wrong)).alias("component", "g"))
    sums = parts.groupBy("component").agg(F.sum("g").alias("g"), F.sum(F.abs("g")).alias("size"))
    return sums.join(F.broadcast(weights), "component").select("component", (F.abs(F.col("g") + F.col("w")) <= 1e-3 * F.col("size")).alias("optimal"))


@query("probe_failures", f"WITH e AS (SELECT vec_id AS doc_id, CAST(vec_id % 3 AS INTEGER) AS layer FROM embeddings), f AS (SELECT layer, CASE WHEN layer = 2 THEN 'test' ELSE {_SPLIT} END AS split FROM e) SELECT layer, CASE WHEN layer = 2 THEN 0 ELSE count(*) FILTER (split <> 'train') END AS predicted, CASE WHEN layer = 2 THEN 'ValueError: no training rows' END AS error FROM f GROUP BY layer")
def probe_failures(spark, sf):
    """A group without training rows reports it, and the others are predicted."""
    rows = probe_rows(spark, sf).select((F.col("doc_id") % 3).cast("int").alias("layer"), "doc_id", "split", "label", "embedding")
    got = models.probes(rows.withColumn("split", F.when(F.col("layer") == 2, "test").otherwise(F.col("split"))), ("layer",), classes=2, hidden=(8,), epochs=2)
    return got.groupBy("layer").agg(F.count("prediction").alias("predicted"), F.max("error").alias("error"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf_top_terms_by_lang(spark, sf)
