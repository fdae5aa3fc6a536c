"""Retrieval from the side of the laws: dense ranking of sub-queries, hints, graph, anchors, books, co-citation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import citation_book
from statuta.functions.vectors import centroids
from statuta.operators import graph as g
from statuta.operators.cooccurrence import anchor_scores, rerank_by_cocitation, spread
from statuta.operators.dense import dense_rrf_top
from statuta.operators.scores import minmax, ordered_union, share_of_max, top_k


@dataclass(frozen=True)
class CascadeConfig:
    rrf_k: float = 60.0
    per_subquery: int = 200
    final_k: int = 20
    exact_boost: float = 0.10
    book_boost: float = 0.005
    book_network_boost: float = 0.01
    network_weight: float = 0.25
    hint_weight: float = 0.40
    top_books: int = 20
    graph_mode: str = "both"
    graph_seeds: int = 200
    graph_boost: float = 0.1
    anchor_boost: float = 0.08
    anchor_targets: int = 50
    anchor_ranked: int = 5
    cocitation_boost: float = 0.0025
    cocitation_seeds: int = 100
    cocitation_targets: int = 50

    def __post_init__(self) -> None:
        if self.rrf_k < 0 or min(self.per_subquery, self.final_k, self.top_books) < 1:
            raise ValueError("sizes must be positive and rrf_k non-negative")
        if self.graph_mode not in (*g.MODES, "none"):
            raise ValueError(f"unknown graph mode: {self.graph_mode}")


def rank_by_subqueries(subqueries: DataFrame, query: str, sub: str, vector: str, laws: DataFrame, citation: str, law_vector: str, config: CascadeConfig = CascadeConfig(), most: int | None = None) -> DataFrame:
    """``query, citation, rrf, best, rank``: laws near any sub-query, by fused rank, best cosine, citation, descending; the
    first ``most`` of a query, or all."""
    asked = subqueries.select(F.col(query), F.to_json(F.struct(F.col(query).alias("q"), F.col(sub).alias("s"))).alias("__id"), F.col(vector).alias("v"))
    return dense_rrf_top(asked, query, "__id", "v", laws, citation, law_vector, config.per_subquery, config.rrf_k, most)


def domain_vectors(laws: DataFrame, title: str, book: str, vector: str) -> DataFrame:
    """``domain, centroid, n, book_code``: mean vector of the laws of a title and their most frequent book (ties: the
    smallest); laws without a title form a domain per book."""
    keyed = laws.withColumn("domain", F.when(F.coalesce(F.col(title), F.lit("")) != "", F.col(title)).otherwise(F.concat(F.lit("UNKNOWN_TITLE::"), F.coalesce(F.col(book), F.lit("")))))
    counted = keyed.groupBy("domain", F.col(book).alias("book_code")).agg(F.count("*").alias("c"))
    first = counted.groupBy("domain").agg(F.min_by("book_code", F.struct(-F.col("c"), "book_code")).alias("book_code"))
    return centroids(keyed, ["domain"], vector).join(first, "domain")


def book_seeds(near_domains: DataFrame, query: str, rrf_k: float = 60.0, top_domains: int = 100) -> DataFrame:
    """``query, book, score``: of the best domains of a query, how many a book has, their fused ranks and best cosine,
    each stretched to 0..1 and weighted .45, .45, .10.

    ``near_domains``: ``query``, ``domain``, ``book``, ``cos``, ``rank``, a row per sub-query and domain."""
    fused = near_domains.groupBy(query, "domain", "book").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("rrf"), F.max("cos").alias("best"))
    best = top_k(fused, [query], top_domains, F.col("rrf").desc(), F.col("best").desc(), F.col("domain").desc())
    books = best.groupBy(query, "book").agg(F.count("*").cast("double").alias("n"), F.sum("rrf").alias("rrf"), F.max("best").alias("best"))
    for c in ("n", "rrf", "best"):
        books = minmax(books, [query], c, constant=1.0)
    return books.select(query, "book", (0.45 * F.col("n") + 0.45 * F.col("rrf") + 0.10 * F.col("best")).alias("score"))


def book_scores(seeds: DataFrame, hints: DataFrame, query: str, networks: list[DataFrame], config: CascadeConfig = CascadeConfig()) -> DataFrame:
    """``query, book, score``: seeds, plus the hint weight for books named in the query, spread over the networks; the
    best books, relative to the best."""
    hinted = hints.select(query, "book").distinct().select(query, "book", F.lit(config.hint_weight).alias("score"))
    total = seeds.select(query, "book", "score").unionByName(hinted).groupBy(query, "book").agg(F.sum("score").alias("score"))
    wide = spread(total, [query], "book", networks, config.network_weight)
    best = top_k(wide, [query], config.top_books, F.col("score").desc(), F.col("seed").desc(), F.col("book").desc())
    return share_of_max(best, [query], "score").select(query, "book", "score")


def combined_boost(ranked: DataFrame, query: str, exact: DataFrame, books: DataFrame, book_network: DataFrame, graph: DataFrame, anchors: DataFrame, config: CascadeConfig = CascadeConfig()) -> DataFrame:
    """``query, citation, score, rank``: candidates are the exact hits, the ranking, its neighbours in the graph and the
    targets of its anchors; each source of evidence adds to the reciprocal rank.

    ``ranked(query, citation, rank)``, ``exact(query, citation, place)``, ``books(query, book)``,
    ``book_network(query, book, score)``, ``graph(src, dst)``, ``anchors(src, dst, weight)``.
    """
    part = lambda df, score: df.select(query, "citation", score.alias("part"))
    reciprocal = 1.0 / (config.rrf_k + F.col("rank"))
    parts = [part(ranked, reciprocal), part(exact, F.lit(float(config.exact_boost)))]
    if config.graph_mode != "none" and config.graph_boost > 0:
        seeds = ranked.where(F.col("rank") <= config.graph_seeds).select(query, "citation", (config.graph_boost * reciprocal).alias("w"))
        linked = g.neighbors(seeds, "citation", graph, config.graph_mode)
        parts.append(linked.select(query, F.col("neighbor").alias("citation"), F.col("w").alias("part")))
    heads = ordered_union([exact.select(query, "citation", "place"), ranked.where(F.col("rank") <= config.anchor_ranked).select(query, "citation", F.col("rank").alias("place"))], [query], "citation", "place")
    parts.append(part(anchor_scores(heads, [query], "citation", anchors, config.anchor_boost, config.anchor_targets), F.col("score")))
    total = reduce(DataFrame.unionByName, parts).groupBy(query, "citation").agg(F.sum("part").alias("base")).withColumn("book", citation_book(F.col("citation")))
    named = books.select(query, "book").distinct().withColumn("named", F.lit(1.0))
    scored = total.join(named, [query, "book"], "left").join(book_network.withColumnRenamed("score", "net"), [query, "book"], "left")
    score = F.col("base") + config.book_boost * F.coalesce("named", F.lit(0.0)) + config.book_network_boost * F.coalesce("net", F.lit(0.0))
    return top_k(scored.select(query, "citation", F.round(score, 9).alias("score")), [query], config.final_k, F.col("score").desc(), F.col("citation").desc())


def law_cascade(ranked: DataFrame, query: str, exact: DataFrame, books: DataFrame, book_network: DataFrame, graph: DataFrame, anchors: DataFrame, cocitation: DataFrame, config: CascadeConfig = CascadeConfig(), rerank=None) -> DataFrame:
    """The whole cascade after the dense ranking: boosts, co-citation, optionally a cross-encoder; the first ``final_k``."""
    wide = CascadeConfig(**{**config.__dict__, "final_k": max(config.final_k, config.per_subquery)})
    boosted = combined_boost(ranked, query, exact, books, book_network, graph, anchors, wide)
    again = rerank_by_cocitation(boosted.select(query, "citation", "rank"), [query], "citation", "rank", cocitation, config.cocitation_boost, config.cocitation_seeds, config.cocitation_targets, config.rrf_k)
    final = again if rerank is None else rerank(again)
    return final.where(F.col("rank") <= config.final_k)


def best_per_book(scores: DataFrame, query: str, n: int) -> DataFrame:
    """``query, book, total, best`` of the ``n`` best candidates of each query."""
    head = top_k(scores, [query], n, F.col("score").desc(), F.col("citation"))
    return head.withColumn("book", citation_book(F.col("citation"))).where("book IS NOT NULL").groupBy(query, "book").agg(F.sum("score").alias("total"), F.max("score").alias("best"))

