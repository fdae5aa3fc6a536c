"""Rankings and scores as long tables: fusion, normalisation, combination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranks(df: DataFrame, keys: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """Position within ``keys`` from 1 in the given order, which must be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group; the planner cuts each partition to ``k`` before the shuffle."""
    return ranks(df, keys, *order, name=name).where(F.col(name) <= k)


def dedupe_ranking(df: DataFrame, keys: list[str], item: str, pos: str) -> DataFrame:
    """Rankings without repetitions: each item once, at its first place; later items move up. Null items don't count."""
    first = df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.min(pos).alias(pos))
    return ranks(first, keys, F.col(pos), F.col(item))


def fuse_rankings(df: DataFrame, query: str, ranking: str, item: str, pos: str, k: float = 60.0, digits: int = 9) -> DataFrame:
    """``(query, item, rrf)``: sum over the rankings of ``1 / (k + rank)``, repetitions within a ranking left out.

    Sums are rounded, as their terms come in any order and ties must not depend on it.
    """
    if k < 0:
        raise ValueError("rrf_k must be non-negative")
    ranked = dedupe_ranking(df, [query, ranking], item, pos)
    return ranked.groupBy(query, item).agg(F.round(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))), digits).alias("rrf"))


def seed_weight(rank: Column, k: float = 60.0) -> Column:
    """Weight of a rank: one for the first, falling as in reciprocal rank fusion."""
    return (1.0 / (k + rank)) / (1.0 / (k + 1.0))


def minmax(df: DataFrame, keys: list[str], score: str, constant: float = 1.0, name: str | None = None) -> DataFrame:
    """Scores stretched to 0..1 within ``keys``; ``constant`` where all are equal. Null stays null."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(name or score, F.when(F.col(score).isNull(), None).when(hi <= lo, F.lit(float(constant))).otherwise((F.col(score) - lo) / (hi - lo)))


def minmax_within(df: DataFrame, keys: list[str], score: str, name: str | None = None) -> DataFrame:
    """Scores of a fixed list of candidates stretched to 0..1: an absent score counts as 0, one that isn't finite doesn't
    set the range (and is given the place of 0 in it); all 0 if none is finite, all 1 if all are equal."""
    w = Window.partitionBy(*keys)
    value = F.coalesce(F.col(score), F.lit(0.0))
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    lo, hi = F.min(F.when(finite, value)).over(w), F.max(F.when(finite, value)).over(w)
    return df.withColumn(name or score, F.when(lo.isNull(), 0.0).when(hi <= lo, 1.0).otherwise((F.when(finite, value).otherwise(0.0) - lo) / (hi - lo)))


def local_factor(df: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """``0.5 + 0.5 * (score - min) / range`` within ``keys``."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(name, 0.5 + 0.5 * (F.col(score) - lo) / F.greatest(hi - lo, F.lit(1e-9)))


def share_of_max(df: DataFrame, keys: list[str], score: str, name: str | None = None) -> DataFrame:
    """Score divided by the largest of its group; unchanged where that isn't positive."""
    hi = F.max(score).over(Window.partitionBy(*keys))
    return df.withColumn(name or score, F.when(hi > 0, F.col(score) / hi).otherwise(F.col(score)))


def rank_scores(df: DataFrame, keys: list[str], score: str, tie: str, name: str) -> DataFrame:
    """``1 - place / (n - 1)`` by descending score; 1 for a single row, 0 for scores that aren't finite."""
    w = Window.partitionBy(*keys)
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    place = F.row_number().over(w.orderBy(F.when(finite, F.col(score)).desc_nulls_last(), F.col(tie)))
    return df.withColumn(name, F.when(~finite, 0.0).otherwise(1.0 - (place - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))))


def combine_weighted(parts: dict[str, tuple[DataFrame, float]], keys: list[str], score: str = "score") -> DataFrame:
    """``keys`` with the weighted mean of several score tables; a score that is missing counts as 0.

    The tables are stacked and summed, one shuffle instead of a chain of outer joins.
    """
    weights = [w for _, w in parts.values()]
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must be non-negative and sum to more than zero")
    stacked = [df.select(*keys, (F.coalesce(F.col(score), F.lit(0.0)) * w).alias("part")) for df, w in parts.values()]
    return reduce(DataFrame.unionByName, stacked).groupBy(*keys).agg(F.sum("part").alias(score))


def ordered_union(parts: list[DataFrame], keys: list[str], item: str, pos: str) -> DataFrame:
    """Items of the first list in its order, then the new ones of the next, and so on, ranked from 1."""
    stacked = [df.select(*keys, item, F.lit(i).alias("list"), F.col(pos).cast("long").alias("at")) for i, df in enumerate(parts)]
    first = reduce(DataFrame.unionByName, stacked).where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.min(F.struct("list", "at")).alias("first"))
    return ranks(first, keys, F.col("first"), F.col(item)).drop("first")


def ordinals(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``ord``, its row's place from 1 in the order of the given columns, without sorting in one partition.

    The rows are sorted by range; each partition numbers its own, and the sizes of the partitions before are added.
    """
    from statuta.plans.runtime import materialise

    ranged = materialise(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    parts = ranged.groupBy(F.shiftright("__id", 33).alias("__p")).agg(F.count("*").alias("n"))
    before = parts.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__b"))  # one row a partition
    return ranged.withColumn("__p", F.shiftright("__id", 33)).join(F.broadcast(before), "__p").withColumn("ord", F.col("__b") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).drop("__p", "__b", "__id")
