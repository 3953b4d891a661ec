"""TF-IDF on long tables: one row per document and term, never a dense matrix.

Weights: term frequency 1 + ln(count), inverse document frequency ln((1 + n) / (1 + df)) + 1, rows
scaled to unit length. The vocabulary is fitted on the training split and applied to all splits.

Most terms of a large corpus are rare pairs that never get into the vocabulary. So a first pass counts
terms by a hash of them, which takes a bounded table; a term has no more occurrences than its bucket.
A second pass counts exactly the terms of the fullest buckets. If these show that a term of any other
bucket could still be among the ``max_features`` most frequent, a third pass counts all that could.
The vocabulary is the one that counting every term would give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import Scratch, ship

#: What the published feature sets were made with.
MAX_FEATURES, MIN_DF, MAX_DF = 32000, 3, 0.95


def tokens(text: Column) -> Column:
    """Pieces between white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r]+"), lambda t: t != "")


def ngrams(words: Column, least: int = 1, most: int = 2) -> Column:
    """All runs of ``least`` to ``most`` words, joined by a space."""
    runs, parts = words, []
    for n in range(1, most + 1):
        if n > 1:  # each run of n - 1 words that another word follows, and that word
            left = F.slice(runs, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
            runs = F.zip_with(left, F.slice(words, F.lit(n), F.greatest(F.size(words), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= least:
            parts.append(runs)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 2, tokenizer=tokens) -> DataFrame:
    """(doc_id, term, tf). ``tokenizer`` maps a text column to an array of tokens.

    Texts are dealt out by key before they are taken apart: that moves each text once instead of all its
    n-grams.
    """
    ship(docs.sparkSession)  # a tokenizer may run in Python
    placed = docs.select(key, text).repartition(key)
    words = placed.select(key, tokenizer(F.col(text)).alias("w"))
    return words.select(key, F.explode(ngrams(F.col("w"), 1, most)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _eligible(df: DataFrame, n_docs: int, min_df: int, max_df: float) -> DataFrame:
    return df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))


def fit(totals: DataFrame, n_docs: int, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """The vocabulary (term, term_id, df, idf) of the training documents' ``totals`` (term, df, total).

    Terms in fewer than ``min_df`` documents or more than ``max_df`` of them go; of the rest the
    ``max_features`` most frequent stay (ties: by code point). Ids follow code point order.
    """
    top = _eligible(totals, n_docs, min_df, max_df).orderBy(F.desc("total"), "term").limit(max_features)
    # At most max_features rows are numbered here.
    place = F.row_number().over(W.orderBy("term")) - 1
    return top.select("term", place.alias("term_id"), "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


#: Tokens that are taken at once in a task, about.
_SOME = 1 << 19
#: Buckets a wanted term, and how many of the fullest are counted exactly at first.
_BUCKETS, _FULLEST = 64, 4
#: Multiplier of the terms' hash; its powers join the hashes of two strings.
_P = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _P, np.uint64), dtype=np.uint64)])


def _hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A polynomial hash of each string's bytes, and the power of its length."""
    raw = strings.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    n = np.diff(offsets)
    power = _powers(int(n.max(initial=0)))
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        left = np.repeat(offsets[1:], n) - np.arange(offsets[0], offsets[-1]) - 1  # bytes after each
        out[some] = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[left], (offsets[:-1] - offsets[0])[some])
    return out, power[n]


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)).astype(np.int64)


class _Some:
    """The n-grams of some rows' tokens: for each order the row, hash and first token of every run."""

    def __init__(self, tokens: pa.ListArray, most: int):
        offsets = tokens.offsets.to_numpy()
        flat = tokens.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        self.words, self.code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(tokens)), np.diff(offsets))
        hashes, power = _hashes(self.words)
        first = np.arange(len(row))
        h = hashes[self.code]
        self.orders = [(row, h, first)]
        for n in range(2, most + 1):
            go = np.flatnonzero(row[n - 1 :] == row[: max(0, len(row) - n + 1)])  # runs of n tokens of one row
            last = self.code[go + n - 1]
            kept = h if len(h) == len(go) else h[np.searchsorted(first, go)]
            h, first = (kept * _P + np.uint64(33)) * power[last] + hashes[last], go  # 33: a space
            self.orders.append((row[go], h, go))

    def terms(self, keep: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(row, term number) of all runs that ``keep`` names by their hashes, and the terms."""
        rows, numbers, strings = [], [], []
        for n, (row, h, first) in enumerate(self.orders, 1):
            mine = np.flatnonzero(keep(h))
            at = first[mine]
            code = self.code[at]
            used, code = np.unique(code, return_inverse=True)
            text = self.words.take(pa.array(used))
            for k in range(1, n):
                width = len(self.words)
                used, code = np.unique(code * width + self.code[at + k], return_inverse=True)
                text = pc.binary_join_element_wise(text.take(pa.array(used // width)), self.words.take(pa.array(used % width)), " ")
            rows.append(row[mine])
            numbers.append(code + sum(map(len, strings)))
            strings.append(text)
        # One number a term, should a token and a run of tokens be the same string.
        same = pa.concat_arrays(strings).dictionary_encode()
        return np.concatenate(rows), same.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.concatenate(numbers)], same.dictionary


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, _Some]]:
    """(keys, n-grams) of the rows in some pieces. Null tokens are left out, as null arrays are."""
    for batch in batches:
        keys, tokens = batch.column(0), batch.column(1)
        if tokens.null_count:
            tokens = pc.fill_null(tokens, pa.scalar([], tokens.type))
        ends, at = tokens.offsets.to_numpy()[1:], 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, tokens.offsets[at].as_py() + _SOME, "right")))
            yield keys.slice(at, to - at), _Some(tokens.slice(at, to - at), most)
            at = to


def _numbered(keys: pa.Array) -> np.ndarray:
    """A number a document: equal keys have the same one."""
    return keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(document: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf), sorted by term."""
    width = int(document.max(initial=0)) + 1
    pair, tf = np.unique(term * width + document, return_counts=True)
    return pair % width, pair // width, tf


def _together(words: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """``words`` with the rows of one key next to each other, and whether some key has several rows."""
    several = not words.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return (words.repartition(key).sortWithinPartitions(key) if several else words), several


def totals(words: DataFrame, n_docs: int, most: int = 2, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, max_df: float = MAX_DF, key: str = "doc_id", bits: int | None = None) -> DataFrame:
    """(term, df, total) of every term that can be in the vocabulary. ``words``: key and an array of tokens ``w``.

    ``bits``: of the terms' hash; by default some 64 buckets a wanted term.
    """
    ship(words.sparkSession)
    scratch = Scratch(words.sparkSession, "terms")
    words, several = _together(words.select(key, "w"), key)
    bits = min(30, max(16, (_BUCKETS * max_features - 1).bit_length())) if bits is None else bits

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.int64)
        for _, some in _slices(batches, most):
            for _, h, _ in some.orders:
                n += np.bincount(_bucket(h, bits), minlength=len(n))
        used = np.flatnonzero(n)
        for at in range(0, len(used), 1 << 16):
            part = used[at : at + (1 << 16)]
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(n[part])], names=["bucket", "load"])

    full = scratch.keep(words.mapInArrow(loads, "bucket int, load long").groupBy("bucket").agg(F.sum("load").alias("load")), "loads")
    least = full.select("load").orderBy(F.desc("load")).limit(_FULLEST * max_features).agg(F.min("load")).first()[0] or 0
    while True:
        got = scratch.keep(_candidates(words, full, least, bits, most, several), f"terms-{least}").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        last = _eligible(got, n_docs, min_df, max_df).select("total").orderBy(F.desc("total")).limit(max_features).agg(F.count("*").alias("n"), F.min("total").alias("total")).first()
        need = last["total"] if last["n"] == max_features else min_df  # no term of a bucket with less can be wanted
        if least <= max(1, need):
            return got
        scratch.drop(f"terms-{least}")
        least = max(1, need)


def _candidates(words: DataFrame, full: DataFrame, least: int, bits: int, most: int, several: bool) -> DataFrame:
    """(term, df, total) by slices, of all terms of buckets with at least ``least`` occurrences."""
    keep = np.zeros(1 << bits, bool)
    keep[full.where(F.col("load") >= least).select("bucket").toPandas()["bucket"].to_numpy()] = True  # at most one number a bucket

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = None, set()  # the last key, and its terms so far
        for keys, some in _slices(batches, most):
            row, term, terms = some.terms(lambda h: keep[_bucket(h, bits)])
            of = _numbered(keys)
            document, term, tf = _pairs(of[row], term)
            new = np.ones(len(term), np.int64)
            if before is not None and keys[0].equals(before):
                mine = np.flatnonzero(document == of[0])
                new[mine] = [t not in seen for t in terms.take(pa.array(term[mine])).to_pylist()]
            if before is None or not keys[-1].equals(before):
                before, seen = keys[-1], set()
            if several:
                seen.update(terms.take(pa.array(term[document == of[-1]])).to_pylist())
            ends = np.flatnonzero(np.diff(term, prepend=-1))
            if len(ends):
                yield pa.record_batch([terms.take(pa.array(term[ends])).cast(pa.string()), pa.array(np.add.reduceat(new, ends)), pa.array(np.add.reduceat(tf, ends))], names=["term", "df", "total"])

    return words.mapInArrow(count, "term string, df long, total long")


def counts_of(words: DataFrame, vocabulary: DataFrame, most: int = 2, key: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf) of the vocabulary's terms, which are sent to every task."""
    ship(words.sparkSession)
    known = pa.array(sorted(r["term"] for r in vocabulary.select("term").collect()), pa.string())  # at most max_features rows
    words, several = _together(words.select(key, "w"), key)
    hashes = np.unique(_hashes(known)[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 24
        near = np.zeros(1 << bits, bool)
        near[_bucket(hashes, bits)] = True
        for keys, some in _slices(batches, most):
            row, term, terms = some.terms(lambda h: near[_bucket(h, bits)])
            wanted = pc.is_in(terms, value_set=known).to_numpy(zero_copy_only=False)[term] if len(terms) else np.zeros(0, bool)
            of = _numbered(keys)
            first = np.unique(of, return_index=True)[1]
            document, term, tf = _pairs(of[row[wanted]], term[wanted])
            order = np.argsort(document, kind="stable")
            yield pa.record_batch([keys.take(pa.array(first[document[order]])), terms.take(pa.array(term[order])).cast(pa.string()), pa.array(tf[order])], names=[key, "term", "tf"])

    out = words.mapInArrow(count, f"`{key}` {words.schema[key].dataType.simpleString()}, term string, tf long")
    return out.groupBy(key, "term").agg(F.sum("tf").alias("tf")) if several else out


def transform(counts: DataFrame, vocabulary: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, term_id, term, tfidf); unseen terms are left out. The vocabulary is at most
    max_features rows, so it is broadcast."""
    w = counts.join(F.broadcast(vocabulary), "term").select(key, "term_id", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return w.select(key, "term_id", "term", (F.col("w") / norm).alias("tfidf"))


def document_stats(vectors: DataFrame, docs: DataFrame, n_features: Column | int, key: str = "doc_id") -> DataFrame:
    """One row: documents, entries, entries of a document (mean, least, most, median), sparsity, density."""
    per = docs.select(key).join(vectors.groupBy(key).agg(F.count("*").alias("nnz")), key, "left").select(F.coalesce("nnz", F.lit(0)).alias("nnz"))
    n = F.lit(n_features) if isinstance(n_features, int) else n_features
    agg = per.agg(F.count("*").alias("n_samples"), F.sum("nnz").alias("nnz"), F.avg("nnz").alias("mean_nnz"), F.min("nnz").alias("min_nnz"), F.max("nnz").alias("max_nnz"), F.percentile("nnz", 0.5).alias("median_nnz"))
    density = F.col("nnz") / (F.col("n_samples") * n)
    return agg.select("*", n.cast("long").alias("n_features"), (1 - density).alias("sparsity"), density.alias("density"))


def split_stats(vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """By split: documents with terms, features, entries, sparsity."""
    size = vocabulary.agg(F.count("*").alias("n_features"))  # one row
    per = vectors.groupBy("split").agg(F.countDistinct("doc_id").alias("n_samples"), F.count("*").alias("nnz"))
    return per.crossJoin(F.broadcast(size)).withColumn("sparsity", 1 - F.col("nnz") / (F.col("n_samples") * F.col("n_features")))


def top_by_document_frequency(vocabulary: DataFrame, k: int = 20) -> DataFrame:
    return vocabulary.select("term", "df").orderBy(F.desc("df"), "term").limit(k)


def top_by_language(vectors: DataFrame, languages: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The k terms of largest mean weight over all documents of a language, zeros included.

    ``languages``: (doc_id, language).
    """
    n = languages.groupBy("language").agg(F.count("*").alias("n"))  # a row a language
    total = vectors.join(languages, key).groupBy("language", "term").agg(F.sum("tfidf").alias("s"))
    mean = F.bround(F.col("s") / F.col("n"), 9)
    ranked = total.join(F.broadcast(n), "language").select("language", "term", mean.alias("mean_tfidf")).where("mean_tfidf > 0")
    place = F.row_number().over(W.partitionBy("language").orderBy(F.desc("mean_tfidf"), "term"))
    return ranked.withColumn("rank", place).where(F.col("rank") <= k)


def top_of_documents(vectors: DataFrame, documents: int = 3, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The k heaviest terms of the first documents by key."""
    first = vectors.select(key).distinct().orderBy(key).limit(documents)
    rounded = vectors.join(F.broadcast(first), key).select(key, "term", F.bround("tfidf", 9).alias("tfidf"))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("tfidf"), "term"))
    return rounded.withColumn("rank", place).where(F.col("rank") <= k)


def vocabulary_lengths(vocabulary: DataFrame) -> DataFrame:
    n = F.length("term")
    return vocabulary.agg(F.count("*").alias("terms"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def first_characters(vocabulary: DataFrame, k: int = 10) -> DataFrame:
    return vocabulary.groupBy(F.substring("term", 1, 1).alias("first")).agg(F.count("*").alias("terms")).orderBy(F.desc("terms"), "first").limit(k)


def length_histogram(vocabulary: DataFrame, k: int = 15) -> DataFrame:
    """The k shortest lengths, their counts, and the first terms of each."""
    order = F.row_number().over(W.partitionBy(F.length("term")).orderBy("term"))
    return vocabulary.withColumn("at", order).groupBy(F.length("term").alias("length")).agg(F.count("*").alias("terms"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("at") <= 3, F.col("term")))), "|").alias("samples")).orderBy("length").limit(k)


def prefix_counts(vocabulary: DataFrame, prefixes: list[str]) -> DataFrame:
    """How many terms start with each prefix (none: 0)."""
    hits = F.array(*[F.when(F.startswith("term", F.lit(p)), p) for p in prefixes])
    wanted = vocabulary.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    found = vocabulary.select(F.explode(F.array_compact(hits)).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("terms"))
    return wanted.join(found, "prefix", "left").select("prefix", F.coalesce("terms", F.lit(0)).alias("terms"))


def ngram_orders(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.groupBy(F.size(F.split("term", " ")).alias("words")).agg(F.count("*").alias("terms"))


def marker_lookup(vocabulary: DataFrame, markers: list[str]) -> DataFrame:
    """Ids of given terms; null where the vocabulary lacks them."""
    wanted = vocabulary.sparkSession.createDataFrame([(m,) for m in markers], "term string")
    return wanted.join(vocabulary.select("term", "term_id", "df"), "term", "left")


class Tfidf:
    """Fit once, transform any split; the state is the vocabulary table."""

    def __init__(self, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, max_df: float = MAX_DF, most: int = 2, tokenizer=tokens):
        self.max_features, self.min_df, self.max_df, self.most, self.tokenizer = max_features, min_df, max_df, most, tokenizer
        self.vocabulary: DataFrame | None = None

    def words(self, docs: DataFrame, parts: int | None = None) -> DataFrame:
        """(doc_id, w): the texts' tokens. What Python makes is written, for several passes go over it."""
        ship(docs.sparkSession)
        placed = docs.select("doc_id", "text")
        out = (placed if parts is None else placed.repartition(parts, "doc_id")).select("doc_id", self.tokenizer(F.col("text")).alias("w"))
        return out if self.tokenizer is tokens or parts is not None else Scratch(docs.sparkSession, "words").keep(out, "words")

    def counts(self, docs: DataFrame) -> DataFrame:
        """(doc_id, term, tf) of all terms."""
        return term_counts(docs, most=self.most, tokenizer=self.tokenizer)

    def kept_counts(self, docs: DataFrame) -> DataFrame:
        """(doc_id, term, tf) of the vocabulary's terms, written in buckets by document."""
        if self.vocabulary is None:
            raise ValueError("fit first")
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return Scratch(docs.sparkSession, "tfidf").keep_by(counts_of(self.words(docs, parts), self.vocabulary, self.most), "counts", "doc_id", parts)

    def fit(self, docs: DataFrame) -> Tfidf:
        n = docs.count()
        self.vocabulary = fit(totals(self.words(docs), n, self.most, self.max_features, self.min_df, self.max_df), n, self.max_features, self.min_df, self.max_df)
        return self

    def transform(self, docs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
        """``counts``: those of ``docs``, where they are at hand."""
        if self.vocabulary is None:
            raise ValueError("fit first")
        return transform(self.kept_counts(docs) if counts is None else counts, self.vocabulary)

    def fit_transform(self, docs: DataFrame) -> DataFrame:
        return self.fit(docs).transform(docs)


def subwords(path: str):
    """A tokenizer of ``Tfidf`` from a vocabulary file: the subword strings of each text, as an array.

    ``path``: a .model file of the sentencepiece library, or a .json file of the tokenizers library.
    Null texts have none. Texts go through Arrow in batches, of which a bounded length is taken apart
    at once and held as numbers of the vocabulary; a worker loads the file once.
    """

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        encode = _load(path)
        lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        parts, at = [], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + _TEXT, "right")))
            parts.append(encode([t or "" for t in texts.slice(at, to - at).to_pylist()]))
            at = to
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return cut


#: Bytes of text that are encoded at once, about.
_TEXT = 1 << 20


@lru_cache(maxsize=2)
def _load(path: str) -> Callable[[list[str]], pa.Array]:
    """A function from texts to their subword strings."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        strings, unknown = [pieces.id_to_piece(i) for i in range(pieces.vocab_size())], pieces.unk_id()

        def encode(texts: list[str]) -> list[list[int]]:
            return pieces.encode(texts, out_type=int)

        def spelt(text: str) -> list[str]:
            return pieces.encode(text, out_type=str)  # an unknown piece is its own text
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        strings, unknown, spelt = [tokenizer.id_to_token(i) or "" for i in range(max(tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1)], -1, None

        def encode(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    known = pa.array(strings, pa.string())

    def cut(texts: list[str]) -> pa.Array:
        ids = encode(texts)
        if unknown >= 0 and any(unknown in x for x in ids):
            return pa.array([spelt(t) if unknown in x else [strings[i] for i in x] for t, x in zip(texts, ids)], pa.list_(pa.string()))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
        return pa.ListArray.from_arrays(pa.array(offsets), known.take(pa.array(flat)))

    return cut
