"""Retrieval from the side of the courts: near decisions lead to the laws they cite."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.vectors import blend, centroids, dot, l2_normalise
from statuta.operators import graph as g
from statuta.operators.dense import dense_top_k
from statuta.operators.scores import local_factor, minmax, ranks, top_k
from statuta.operators.selection import new_first_n

MODES = ("avg-subquery", "english-query", "german-query", "per-subquery", "union-avg-full", "union-avg-german", "union-all-three")


@dataclass(frozen=True)
class CourtConfig:
    mode: str = "avg-subquery"
    top_courts: int = 200
    per_subquery: int = 20
    alpha: float = 0.4
    cocitation_weight: float = 0.0
    cocitation_seeds: int = 10

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown retrieval mode: {self.mode}")
        if not 0 <= self.alpha <= 1 or not 0 <= self.cocitation_weight <= 1:
            raise ValueError("alpha and cocitation_weight must be between 0 and 1")
        if min(self.top_courts, self.per_subquery, self.cocitation_seeds) < 1:
            raise ValueError("sizes must be positive")


def near_courts(queries: DataFrame, full_vector: str, subqueries: DataFrame, sub_vector: str, courts: DataFrame, court: str, vector: str, config: CourtConfig = CourtConfig()) -> DataFrame:
    """``query_id, court, cos``: the decisions nearest to a query in the given mode.

    The mean of the sub-queries, the whole query, each sub-query by itself (best cosine counts), or a union; in a union
    the score is the cosine with the mean where there is one, else the other.
    """
    subs = subqueries.select("query_id", F.col(sub_vector).alias("v"))
    means = centroids(subs, ["query_id"], "v").select("query_id", F.col("centroid").alias("v"))
    whole = queries.select("query_id", F.col(full_vector).alias("v"))
    by = lambda rows: dense_top_k(rows, "query_id", "v", courts, court, vector, config.top_courts).select("query_id", court, "cos")
    if config.mode in ("english-query", "german-query"):
        return by(whole)
    if config.mode == "avg-subquery":
        return by(means)
    if config.mode == "per-subquery":
        tagged = subqueries.select(F.to_json(F.struct("query_id", F.monotonically_increasing_id().alias("n"))).alias("__id"), F.col(sub_vector).alias("v"))
        near = dense_top_k(tagged, "__id", "v", courts, court, vector, config.per_subquery)
        return near.withColumn("query_id", F.get_json_object("__id", "$.query_id")).groupBy("query_id", court).agg(F.max("cos").alias("cos"))
    first = by(means).withColumn("src", F.lit(0))
    other = by(whole).withColumn("src", F.lit(1))
    return first.unionByName(other).groupBy("query_id", court).agg(F.min_by("cos", "src").alias("cos"))


def steer(vectors: DataFrame, seeds: DataFrame, laws: DataFrame, share: float) -> DataFrame:
    """``query_id, v``: query vectors moved by ``share`` towards the mean vector of their seed laws.

    ``vectors(query_id, v)``, ``seeds(query_id, citation)``, ``laws(citation, v)``."""
    middle = centroids(seeds.join(laws, "citation"), ["query_id"], "v").select("query_id", "centroid")
    return vectors.join(middle, "query_id", "left").select("query_id", blend(F.col("v"), F.col("centroid"), share).alias("v"))


def overlap_boost(near: DataFrame, court: str, refs: DataFrame, seeds: DataFrame, boost: float) -> DataFrame:
    """Courts' scores with ``boost`` for every seed law they cite. ``refs(court, citation)``."""
    shared = seeds.select("query_id", "citation").distinct().join(refs.select(court, "citation").distinct(), "citation").groupBy("query_id", court).agg(F.count("*").alias("n"))
    return near.join(shared, ["query_id", court], "left").withColumn("cos", F.col("cos") + boost * F.coalesce("n", F.lit(0))).drop("n")


def enrich_courts(courts: DataFrame, court: str, vector: str, refs: DataFrame, laws: DataFrame, share: float) -> DataFrame:
    """``court, v``: courts' vectors moved by ``share`` towards the mean of the laws they cite."""
    middle = centroids(refs.select(court, "citation").distinct().join(laws, "citation"), [court], "v").select(court, "centroid")
    own = courts.select(court, l2_normalise(F.col(vector)).alias("o"))
    return own.join(middle, court, "left").select(court, blend(F.col("o"), F.col("centroid"), share).alias("v"))


def court_path(near: DataFrame, court: str, refs: DataFrame) -> DataFrame:
    """``query_id, citation, score``: sum of the scores of the near courts that cite a law, repetitions included, times
    the weight of its degree. The references of all courts are aggregated before the join."""
    bag = refs.where("citation IS NOT NULL").groupBy(court, "citation").agg(F.count("*").alias("n"))
    degree = bag.groupBy("citation").agg(F.sum("n").alias("degree"))
    raw = near.join(bag, court).groupBy("query_id", "citation").agg(F.sum(F.col("cos") * F.col("n")).alias("raw"))
    return raw.join(degree, "citation").select("query_id", "citation", F.round(F.col("raw") * g.degree_idf(F.col("degree")), 9).alias("score"))


def cocitation_path(ranked: DataFrame, court: str, refs: DataFrame, seeds: int, idf: bool = True) -> DataFrame:
    """``query_id, citation, score``: decisions that cite any of the first ``seeds`` laws, counted per law they cite;
    with ``idf``, times ``ln(N / df)`` over its largest value."""
    heads = ranked.where(F.col("rank") <= seeds)
    counted = g.two_hops(heads, ["query_id"], "citation", refs, court, "citation").select("query_id", "citation", F.col("n").cast("double").alias("score"))
    if not idf:
        return counted
    pairs = refs.where("citation IS NOT NULL").select(court, "citation").distinct()
    n = pairs.select(court).distinct().count()
    df = pairs.groupBy("citation").agg(F.log(F.lit(float(max(n, 1))) / F.count("*")).alias("w"))
    most = df.agg(F.max("w")).first()[0] or 1.0
    return counted.join(df, "citation").select("query_id", "citation", F.round(F.col("score") * F.col("w") / F.lit(float(most if most > 0 else 1.0)), 9).alias("score"))


def blend_signals(cosine: DataFrame, graph: DataFrame, cocitation: DataFrame, config: CourtConfig = CourtConfig()) -> DataFrame:
    """``query_id, citation, score``: each signal stretched to 0..1 over the laws that have it (0 if all are equal),
    missing ones 0, weighted ``alpha (1 - c)``, ``(1 - alpha)(1 - c)`` and ``c``."""
    c = config.cocitation_weight
    weights = (config.alpha * (1 - c), (1 - config.alpha) * (1 - c), c)
    parts = [minmax(df, ["query_id"], "score", constant=0.0).select("query_id", "citation", (w * F.col("score")).alias("part")) for df, w in zip((cosine, graph, cocitation), weights)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("query_id", "citation").agg(F.round(F.sum("part"), 9).alias("score"))


def add_signal(scores: DataFrame, signal: DataFrame, weight: float, grow: bool = False) -> DataFrame:
    """Scores with ``weight`` times a signal stretched to 0..1; with ``grow``, laws that only have the signal come in."""
    part = minmax(signal, ["query_id"], "score", constant=0.0).select("query_id", "citation", (weight * F.col("score")).alias("plus"))
    joined = scores.join(part, ["query_id", "citation"], "full_outer" if grow else "left")
    return joined.select("query_id", "citation", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("plus", F.lit(0.0)), 9).alias("score"))


def boost_listed(scores: DataFrame, listed: DataFrame, boost: float) -> DataFrame:
    """Scores with a fixed boost for listed laws, which come in if they weren't there."""
    plus = listed.select("query_id", "citation").distinct().select("query_id", "citation", F.lit(float(boost)).alias("score"))
    return scores.select("query_id", "citation", "score").unionByName(plus).groupBy("query_id", "citation").agg(F.sum("score").alias("score"))


def seed_similarity(candidates: DataFrame, seeds: DataFrame, laws: DataFrame, how: str = "mean") -> DataFrame:
    """``query_id, citation, score``: cosine with the mean of the seeds' vectors, or the largest with any of them."""
    unit = laws.select("citation", l2_normalise(F.col("v")).alias("v"))
    mine = candidates.select("query_id", "citation").distinct().join(unit, "citation")
    given = seeds.select("query_id", "citation").distinct().join(unit, "citation")
    target = centroids(given, ["query_id"], "v").select("query_id", F.col("centroid").alias("s")) if how == "mean" else given.select("query_id", F.col("v").alias("s"))
    return mine.join(target, "query_id").groupBy("query_id", "citation").agg(F.round(F.max(dot(F.col("v"), F.col("s"))), 9).alias("score"))


def most_cited(refs: DataFrame, books: DataFrame, n: int) -> DataFrame:
    """``citation, degree``: the ``n`` most cited laws of the given books."""
    degree = refs.groupBy("citation").agg(F.count("*").alias("degree")).withColumn("book", F.element_at(F.split("citation", " "), -1))
    return degree.join(books.select("book").distinct(), "book", "left_semi").orderBy(F.col("degree").desc(), "citation").limit(n).drop("book")


def book_prior(scores: DataFrame, laws: DataFrame, candidates: int, books: int, weight: float) -> DataFrame:
    """Scores with a prior for the books that the best candidates come from. ``laws(citation, book)``."""
    named = scores.join(laws.select("citation", "book").dropDuplicates(["citation"]), "citation", "left")
    head = top_k(named, ["query_id"], candidates, F.col("score").desc(), F.col("citation")).where("book IS NOT NULL")
    sums = head.groupBy("query_id", "book").agg(F.round(F.sum("score"), 9).alias("score"))
    best = minmax(top_k(sums, ["query_id"], books, F.col("score").desc(), F.col("book")), ["query_id"], "score", constant=0.0).select("query_id", "book", F.col("score").alias("prior"))
    return named.join(best, ["query_id", "book"], "left").select("query_id", "citation", F.round(F.col("score") + weight * F.coalesce("prior", F.lit(0.0)), 9).alias("score"))


def book_pool(scores: DataFrame, nearest: DataFrame, laws: DataFrame, candidates: int, books: int, per_book: int, scale: float) -> DataFrame:
    """Scores with new laws of the books that the best candidates come from: the nearest of each book, at ``scale``
    times the book's best score, by cosine. ``nearest(query_id, citation, cos)``, ``laws(citation, book)``."""
    book = laws.select("citation", "book").dropDuplicates(["citation"])
    head = top_k(scores.join(book, "citation"), ["query_id"], candidates, F.col("score").desc(), F.col("citation")).where("book IS NOT NULL")
    sums = head.groupBy("query_id", "book").agg(F.round(F.sum("score"), 9).alias("total"), F.max("score").alias("best"))
    top = top_k(sums, ["query_id"], books, F.col("total").desc(), F.col("best").desc(), F.col("book").desc(), name="r").select("query_id", "book", "best")
    offered = top_k(nearest.join(book, "citation").join(top, ["query_id", "book"]), ["query_id", "book"], 4 * per_book, F.col("cos").desc(), F.col("citation").desc(), name="place")
    offered = local_factor(offered, ["query_id", "book"], "cos", "factor")
    fresh = offered.join(scores.select("query_id", "citation"), ["query_id", "citation"], "left_anti")
    added = top_k(fresh, ["query_id", "book"], per_book, F.col("place"), name="n").select("query_id", "citation", F.round(F.col("best") * scale * F.col("factor"), 9).alias("score"))
    return scores.select("query_id", "citation", "score").unionByName(added)


def inject_by_cosine(pool: DataFrame, nearest: DataFrame, n: int) -> DataFrame:
    """``query_id, citation``: the pool and the ``n`` nearest laws that aren't in it."""
    ranked = ranks(nearest, ["query_id"], F.col("cos").desc(), F.col("citation").desc())
    return pool.select("query_id", "citation").unionByName(new_first_n(ranked, pool, ["query_id"], "citation", "rank", n).select("query_id", "citation"))
