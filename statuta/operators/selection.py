"""Which candidates stay: injection, filling, cuts, frozen places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_first_n(ranking: DataFrame, pool: DataFrame, keys: list[str], item: str, rank: str, n: int) -> DataFrame:
    """The first ``n`` rows of a ranking whose item isn't in the pool yet."""
    fresh = ranking.join(pool.select(*keys, item), [*keys, item], "left_anti")
    return fresh.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, item))).where(F.col("__n") <= n).drop("__n")


def inject(ranking: DataFrame, pool: DataFrame, keys: list[str], item: str, rank: str, n: int, score: str = "score") -> DataFrame:
    """The pool and the first ``n`` new items of the ranking, at the pool's third quartile: the value at place
    ``int(0.75 * size)`` of the ascending scores (0 for an empty pool)."""
    w = Window.partitionBy(*keys)
    placed = pool.withColumn("__p", F.row_number().over(w.orderBy(score, item)) - 1).withColumn("__s", F.count("*").over(w))
    level = placed.where(F.col("__p") == F.floor(F.col("__s") * 0.75)).select(*keys, F.col(score).alias("__level"))
    added = new_first_n(ranking, pool, keys, item, rank, n).select(*keys, item).join(level, keys, "left")
    return pool.select(*keys, item, score).unionByName(added.select(*keys, item, F.coalesce("__level", F.lit(0.0)).alias(score)))


def fill_to_k(chosen: DataFrame, plain: DataFrame, keys: list[str], item: str, rank: str, k: int) -> DataFrame:
    """``keys, item, rank``: the chosen items in their order, then the best others of the plain ranking, up to ``k``
    (all chosen ones, if they are more)."""
    have = chosen.groupBy(*keys).agg(F.max(rank).alias("__have"))
    rest = plain.join(chosen.select(*keys, item), [*keys, item], "left_anti")
    rest = rest.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, item))).join(have, keys, "left")
    added = rest.withColumn("__r", F.coalesce("__have", F.lit(0)) + F.col("__n")).where(F.col("__r") <= k)
    return chosen.select(*keys, item, F.col(rank).cast("long").alias("rank")).unionByName(added.select(*keys, item, F.col("__r").cast("long").alias("rank")))


def dynamic_cut(ranked: DataFrame, keys: list[str], rank: str, score: str, threshold: float, keep_top: int = 0, min_k: int = 0, max_k: int = 2**31 - 1, forced: str | None = None) -> DataFrame:
    """Rows with a score of at least ``threshold``, among the first ``keep_top`` or forced; at most ``max_k``; if fewer
    than ``min_k``, the best of the others are added behind."""
    keep = (F.coalesce(F.col(score), F.lit(float("-inf"))) >= threshold) | (F.col(rank) <= keep_top)
    if forced:
        keep = keep | F.coalesce(F.col(forced), F.lit(False))
    w = Window.partitionBy(*keys)
    marked = ranked.withColumn("__keep", keep)
    order = w.orderBy(F.col("__keep").desc(), rank)
    placed = marked.withColumn("__place", F.row_number().over(order)).withColumn("__kept", F.sum(F.col("__keep").cast("int")).over(w))
    size = F.least(F.lit(max_k), F.greatest(F.col("__kept"), F.lit(min_k)))
    return placed.where(F.col("__place") <= size).withColumn("final_rank", F.col("__place")).drop("__keep", "__place", "__kept")


def permute_free(df: DataFrame, keys: list[str], pos: str, score: str, free: Column, name: str = "final_rank") -> DataFrame:
    """New places by descending score for the free rows, among the places of the free rows; all others keep theirs.

    The places of one ranking are few, so they travel with its rows as an array.
    """
    w = Window.partitionBy(*keys)
    base = df.withColumn("__free", F.coalesce(free, F.lit(False)))
    numbered = base.withColumn("__item", F.row_number().over(Window.partitionBy(*keys, "__free").orderBy(F.col(score).desc_nulls_last(), pos)))
    slots = F.array_sort(F.collect_list(F.when(F.col("__free"), F.col(pos))).over(w))  # bounded: one ranking's places
    return numbered.withColumn("__slots", slots).withColumn(name, F.when(F.col("__free"), F.get("__slots", F.col("__item") - 1)).otherwise(F.col(pos))).drop("__free", "__item", "__slots")


def batches(df: DataFrame, keys: list[str], rank: str, size: int = 4) -> DataFrame:
    """``batch_id`` from 0 and ``label`` A, B, ... within the batch, in order of rank."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(rank)) - 1
    return df.withColumn("batch_id", F.floor(n / size).cast("int")).withColumn("label", F.char(n % size + 65))


def expand_first_parent(parents: DataFrame, keys: list[str], item: str, score: str, links: DataFrame, scale: float, most: int, top: int) -> DataFrame:
    """``keys, item, score``: the pool with what its best ``top`` rows link to, at ``scale`` times the score of the
    first parent that takes them in.

    Parents act in order of score; each takes at most ``most`` targets (0: all) that are new at its turn, in the order
    of its links. That is sequential, so each query's own pool goes through one task: ``top`` parents and their links.
    ``links``: ``src``, ``dst``, ``place``.
    """
    import pandas as pd

    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(item))
    ranked = parents.select(*keys, item, score).withColumn("__r", F.row_number().over(w))
    heads = ranked.where(F.col("__r") <= top)
    offered = heads.join(links.select(F.col("src").alias(item), F.col("dst").alias("__dst"), F.col("place").alias("__place")), item).where(F.col("__dst") != F.col(item))
    fresh = offered.join(parents.select(*keys, F.col(item).alias("__dst")), [*keys, "__dst"], "left_anti").select(*keys, "__r", "__place", "__dst", score)

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__r", "__place", "__dst"], kind="stable")
        seen, count, rows = set(), {}, []
        for r in pdf.itertuples(index=False):
            d = r._asdict() if not keys else dict(zip(pdf.columns, r))
            if d["__dst"] in seen or (most and count.get(d["__r"], 0) >= most):
                continue
            seen.add(d["__dst"])
            count[d["__r"]] = count.get(d["__r"], 0) + 1
            rows.append([*[d[k] for k in keys], d["__dst"], d[score] * scale])
        return pd.DataFrame(rows, columns=[*keys, item, score])

    schema = parents.select(*keys, item, F.col(score).cast("double").alias(score)).schema
    added = fresh.groupBy(*keys).applyInPandas(take, schema)
    return parents.select(*keys, item, F.col(score).cast("double").alias(score)).unionByName(added)
