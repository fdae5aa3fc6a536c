"""Lexical retrieval by inverted index: only pairs that share a term are ever made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions.text import let, tokens
from statuta.operators.overlap import hashed, sized, top_overlaps, top_products
from statuta.operators.scores import ordinals, top_k
from statuta.sources.shelf import read, shelve


def overlaps(queries: DataFrame, query: str, q_text: str, docs: DataFrame, doc: str, d_text: str) -> DataFrame:
    """``(query, doc, score)`` with the number of distinct tokens both have, where there is any."""
    q = queries.select(F.col(query), F.explode(tokens(F.col(q_text))).alias("term"))
    d = docs.select(F.col(doc), F.explode(tokens(F.col(d_text))).alias("term"))
    return q.join(d, "term").groupBy(query, doc).agg(F.count("*").cast("double").alias("score"))


def best_overlaps(queries: DataFrame, query: str, q_text: str, docs: DataFrame, doc: str, d_text: str, k: int) -> DataFrame:
    """``(query, doc, score, rank)``: the ``k`` documents that share most distinct tokens with a query, ties by ``doc``;
    those that share none are left out. Blocks of both sides meet and give their best; no row is made for other pairs."""
    numbered = ordinals(docs.select(F.col(doc).alias("__doc"), F.col(d_text).alias("text")), "__doc").withColumn("d", F.col("ord") - 1)
    asked = queries.select(F.col(query).alias("q"), hashed(tokens(F.col(q_text))).alias("words"))
    best = top_k(top_overlaps(asked, numbered.select("d", hashed(tokens(F.col("text"))).alias("words")), k), ["q"], k, F.col("score").desc(), F.col("d"))
    return best.join(numbered.select("d", "__doc"), "d").select(F.col("q").alias(query), F.col("__doc").alias(doc), "score", "rank")


def words(c: Column, n: int) -> Column:
    """Words of at least two characters, lower case, and all runs of up to ``n`` of them."""

    def runs(one: Column) -> Column:
        run = lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(one) - (k - 1), F.lit(1))), lambda i: i + (k - 1) <= F.size(one)), lambda i: F.array_join(F.slice(one, i, k), " "))
        return F.concat(one, *[run(k) for k in range(2, n + 1)])

    return let(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), runs)


def term_weights(docs: DataFrame, doc: str, text: str, max_df: float = 0.9, max_features: int | None = None, ngrams: int = 1, min_df: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(weights, vocabulary)``: ``doc, term, w`` with ``w = (1 + ln tf) * idf`` at length one per document, and
    ``term, idf`` with ``idf = 1 + ln((1 + N) / (1 + df))``.

    Terms in more than ``max_df`` of the documents, or in fewer than ``min_df`` documents, are left out; with ``max_features``, only the most frequent stay
    (by total count, then by term).
    """
    bag = docs.where(F.col(doc).isNotNull()).select(F.col(doc), F.explode(words(F.col(text), ngrams)).alias("term"))
    tf = bag.groupBy(doc, "term").agg(F.count("*").alias("tf"))
    n = docs.where(F.col(doc).isNotNull()).count()
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where((F.col("df") <= max_df * n) & (F.col("df") >= min_df))
    if max_features is not None:
        stats = stats.orderBy(F.col("total").desc(), "term").limit(max_features)
    vocabulary = stats.select("term", (1 + F.log((1 + F.lit(n)) / (1 + F.col("df")))).alias("idf"))
    return weigh(tf, doc, vocabulary), vocabulary


def weigh(tf: DataFrame, doc: str, vocabulary: DataFrame) -> DataFrame:
    raw = tf.join(vocabulary, "term").select(doc, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    return raw.select(doc, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))).alias("w"))


def tfidf_top_k(queries: DataFrame, query: str, q_text: str, docs: DataFrame, doc: str, d_text: str, k: int, **options) -> DataFrame:
    """``query, doc, score, rank``: the ``k`` documents with the largest cosine of TF-IDF weights above zero, ties by
    ``doc``; the terms and ``options`` are those of ``term_weights``. No row is made for a pair, nor for a document's term: the
    idf of the terms, by their hash, lies in blocks that are read where a block of documents or questions is weighed."""
    n_of = options.get("ngrams", 1)
    docs = docs.where(F.col(doc).isNotNull())
    numbered = ordinals(docs.select(F.col(doc).alias("__doc"), F.col(d_text).alias("text")), "__doc").withColumn("d", F.col("ord") - 1)
    n, terms = numbered.count(), words(F.col("text"), n_of)
    max_features, counted = options.get("max_features"), F.count("*").alias("df")
    if max_features is None:
        stats = numbered.select(F.explode(F.array_distinct(hashed(terms))).alias("h")).groupBy("h").agg(counted)
    else:
        tf = numbered.select("d", F.explode(terms).alias("term")).groupBy("d", "term").agg(F.count("*").alias("tf"))
        stats = tf.groupBy("term").agg(counted, F.sum("tf").alias("total"))
    stats = stats.where((F.col("df") <= options.get("max_df", 0.9) * n) & (F.col("df") >= options.get("min_df", 1)))
    if max_features is not None:
        stats = stats.orderBy(F.col("total").desc(), "term").limit(max_features).withColumn("h", F.xxhash64("term"))

    def pack(batches):
        for t in sized(batches, 1 << 20):
            h, df = t["h"].to_numpy(), t["df"].to_numpy()
            by = np.argsort(h)
            yield pa.RecordBatch.from_pylist([{"h": h[by].astype(np.int64).tobytes(), "idf": (1 + np.log((1 + n) / (1 + df[by]))).tobytes()}])

    vocabulary = shelve(stats.select("h", "df").mapInArrow(pack, "h binary, idf binary"))

    def weigh(terms: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct terms of the vocabulary by ``of``, and ``(1 + ln tf) * idf`` at length one."""
        by = np.lexsort((terms, of))
        terms, of = terms[by], of[by]
        first = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (of[1:] != of[:-1])]) if len(terms) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(terms)))
        some, at = np.unique(terms[first], return_inverse=True)
        idf = np.zeros(len(some))
        for block in read(vocabulary):
            h = np.frombuffer(block["h"][0].as_buffer(), np.int64)
            there = np.searchsorted(h, some)
            hit = there < len(h)
            hit[hit] = h[there[hit]] == some[hit]
            idf[hit] = np.frombuffer(block["idf"][0].as_buffer(), np.float64)[there[hit]]
        known = idf[at] > 0
        terms, of, w = terms[first][known], of[first][known], ((1 + np.log(tf)) * idf[at])[known]
        lengths = np.sqrt(np.bincount(of, w * w)) if len(of) else np.zeros(0)
        return terms, of, w / lengths[of]

    asked = queries.where(F.col(query).isNotNull()).select(F.col(query).alias("q"), hashed(words(F.col(q_text), n_of)).alias("words"))
    best = top_k(top_products(asked, numbered.select("d", hashed(terms).alias("words")), k, weigh), ["q"], k, F.col("score").desc(), F.col("d"))
    return best.join(numbered.select("d", "__doc"), "d").select(F.col("q").alias(query), F.col("__doc").alias(doc), "score", "rank")
