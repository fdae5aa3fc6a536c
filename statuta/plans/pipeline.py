"""The ranking pipeline: lexical and keyword rankings, fused, one hop of the citation graph, weighted blend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions.text import tokens
from statuta.operators.overlap import hashed, overlap_places
from statuta.plans.config import PipelineConfig
from statuta.plans.runtime import require_columns

RESULT = "query_id string, rank int, citation string, score double, lexical_score double, rrf_score double, graph_score double"


def run_pipeline(queries: DataFrame, documents: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """``query_id, rank, citation, score, lexical_score, rrf_score, graph_score`` for all queries in one plan.

    ``queries``: ``query_id``, ``text``; ``documents``: ``doc_ord`` (0, 1, ... without gaps), ``citation`` (unique),
    ``text``, ``keywords``, ``neighbors``. Documents are ranked by token overlap (keywords, whole and lower-case, count
    as tokens) and by keyword overlap, ties by ``doc_ord``; both rankings are fused; the first ``seed_k`` of the lexical
    ranking lead to their outgoing neighbors; the blend is ``lexical * minmax + rrf * minmax + graph``.

    No row is made for a pair of query and document. Of the documents that share equally many tokens and equally many
    keywords, an earlier one is ahead in both rankings: only the first few of each such class and its last one can matter,
    for the result and for the range of the scores, and those that the graph leads to. Where the query is, all documents
    are read block by block (:mod:`statuta.operators.overlap`), which gives these with their places in both rankings.
    Queries without a document give no rows; null texts have no tokens.
    """
    require_columns(queries, "query_id", "text")
    require_columns(documents, "doc_ord", "citation", "text", "keywords", "neighbors")
    k, limit = config.rrf_k, config.result_limit
    docs = documents.select("doc_ord", "citation", tokens(F.col("text")).alias("t"), F.array_distinct(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower)).alias("k"))
    n = documents.count()
    if not n:
        return queries.sparkSession.createDataFrame([], RESULT)
    asked = queries.select(F.col("query_id").alias("q"), hashed(tokens(F.col("text"))).alias("words"))
    corpus = docs.select(F.col("doc_ord").cast("long").alias("d"), hashed(F.array_union("t", "k")).alias("words"), hashed(F.col("k")).alias("keys"))
    by_query = Window.partitionBy("query_id")
    links = documents.select("doc_ord", F.explode(F.array_distinct("neighbors")).alias("citation")).join(documents.select("citation", F.col("doc_ord").alias("target")), "citation")
    links = links.select(F.col("doc_ord").cast("long").alias("src"), F.col("target").cast("long").alias("dst"))
    rows = overlap_places(asked, corpus, links, max(limit, config.seed_k), config.seed_k)
    rows = rows.select(F.col("q").alias("query_id"), F.col("d").cast("int").alias("doc_ord"), "lex", "r_lex", "r_key", "graph")
    fused = rows.withColumn("rrf", F.round(1.0 / (k + F.col("r_lex")) + 1.0 / (k + F.col("r_key")), 12))
    stretch = lambda c, lo: F.when(F.max(c).over(by_query) <= lo, 1.0).otherwise((F.col(c) - lo) / (F.max(c).over(by_query) - lo))
    blended = fused.withColumns({"lexical_score": stretch("lex", F.min("lex").over(by_query)), "rrf_score": stretch("rrf", F.min("rrf").over(by_query)), "graph_score": F.col("graph")})
    blended = blended.withColumn("score", F.round(config.lexical_weight * F.col("lexical_score") + config.rrf_weight * F.col("rrf_score") + config.graph_weight * F.col("graph_score"), 9))
    ranked = blended.withColumn("rank", F.row_number().over(by_query.orderBy(F.col("score").desc(), "doc_ord"))).where(F.col("rank") <= limit)
    named = ranked.join(documents.select("doc_ord", "citation"), "doc_ord")
    return named.select("query_id", "rank", "citation", *[F.round(c, 6).alias(c) for c in ("score", "lexical_score", "rrf_score", "graph_score")])
