"""What is cited together: pair counts, confidences, TF-IDF weights, and scores made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.operators.scores import seed_weight, top_k


def citing_sets(refs: DataFrame, doc: str, item: str, known: DataFrame | None = None) -> DataFrame:
    """``(doc, item)``, distinct; with ``known(item)``, only items in it."""
    out = refs.select(F.col(doc).alias("doc"), F.col(item).alias("item")).where("doc IS NOT NULL AND item IS NOT NULL").distinct()
    return out if known is None else out.join(known.select(F.col(known.columns[0]).alias("item")).distinct(), "item", "left_semi")


#: Items of one document that are paired in one row; longer lists are cut into blocks, and each pair of blocks is a row.
BLOCK = 1_000


def pair_counts(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(src, dst, n)``: in how many documents both are cited, either way round.

    The pairs of a document are made from its sorted list, inside one row, so the table isn't shuffled against itself;
    a document of ``m`` items gives ``m * (m - 1)`` pairs, which is what the result counts. A list longer than ``block``
    is cut, and its pairs of blocks are spread over the tasks: no task makes more than ``block`` squared of them a row.
    """
    lists = sets.groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items")).where(F.size("items") >= 2)
    within = lambda rows: rows.select("items", F.posexplode("items").alias("p", "src")).select("src", F.explode(F.slice("items", F.col("p") + 2, F.greatest(F.size("items") - F.col("p") - 1, F.lit(0)))).alias("dst"))
    cut = lists.where(F.size("items") > block).select("doc", "items", F.explode(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / block).cast("int"))).alias("i"))
    part = lambda i: F.slice("items", i * block + 1, F.lit(block))
    both = cut.select("doc", "items", "i", F.explode(F.sequence(F.col("i"), F.floor((F.size("items") - 1) / block).cast("int"))).alias("j")).select("doc", "i", "j", part(F.col("i")).alias("a"), part(F.col("j")).alias("b"))
    spread = both.repartition("doc", "i", "j")
    across = spread.where("i < j").select(F.explode("a").alias("src"), "b").select("src", F.explode("b").alias("dst"))
    half = within(lists.where(F.size("items") <= block)).unionByName(within(spread.where("i = j").withColumnRenamed("a", "items"))).unionByName(across)
    once = half.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))


def support(sets: DataFrame, least: int = 1) -> DataFrame:
    """``(src, docs)``: documents that cite it, counting those with at least ``least`` items."""
    big = sets if least <= 1 else sets.join(sets.groupBy("doc").agg(F.count("*").alias("size")).where(F.col("size") >= least), "doc", "left_semi")
    return big.groupBy(F.col("item").alias("src")).agg(F.count("*").alias("docs"))


def confidence(pairs: DataFrame, sources: DataFrame, min_count: int = 1) -> DataFrame:
    """``(src, dst, weight)``: share of the source's documents that cite the target too; rare pairs left out."""
    return pairs.where((F.col("n") >= min_count) & (F.col("src") != F.col("dst"))).join(sources, "src").select("src", "dst", (F.col("n") / F.col("docs")).alias("weight"))


def tfidf(pairs: DataFrame, sets: DataFrame, min_count: int = 1) -> DataFrame:
    """``(src, dst, weight)``: pair count times ``1 + ln((1 + N) / (1 + df))`` of the target, over the largest of its
    source."""
    total = sets.select("doc").distinct().agg(F.count("*").alias("total")).first()[0]
    df = sets.groupBy(F.col("item").alias("dst")).agg(F.count("*").alias("df"))
    raw = pairs.where(F.col("n") >= min_count).join(df, "dst").withColumn("w", F.col("n") * (1 + F.log((1 + F.lit(total)) / (1 + F.col("df")))))
    return raw.select("src", "dst", (F.col("w") / F.max("w").over(Window.partitionBy("src"))).alias("weight"))


def anchor_scores(anchors: DataFrame, keys: list[str], item: str, index: DataFrame, boost: float, top_targets: int) -> DataFrame:
    """``keys, item, score``: each distinct anchor gives its ``top_targets`` best targets ``boost * weight``; sums."""
    best = top_k(index, ["src"], top_targets, F.col("weight").desc(), F.col("dst").desc()).select("src", "dst", "weight")
    given = anchors.select(*keys, F.col(item).alias("src")).distinct().join(best, "src")
    return given.groupBy(*keys, F.col("dst").alias(item)).agg(F.sum(boost * F.col("weight")).alias("score"))


def rerank_by_cocitation(pool: DataFrame, keys: list[str], item: str, rank: str, index: DataFrame, boost: float, seeds: int, top_targets: int, rrf_k: float = 60.0) -> DataFrame:
    """``keys, item, score, rank``: reciprocal rank, plus what the first ``seeds`` give to targets inside the pool."""
    best = top_k(index, ["src"], top_targets, F.col("weight").desc(), F.col("dst").desc(), name="__r").select("src", "dst", "weight")
    given = pool.where(F.col(rank) <= seeds).select(*keys, F.col(item).alias("src"), (boost * seed_weight(F.col(rank), rrf_k)).alias("w")).join(best, "src")
    plus = given.groupBy(*keys, F.col("dst").alias(item)).agg(F.sum(F.col("w") * F.col("weight")).alias("plus"))
    scored = pool.select(*keys, item, F.col(rank).alias("__old")).join(plus, [*keys, item], "left")
    scored = scored.withColumn("score", F.round(1.0 / (rrf_k + F.col("__old")) + F.coalesce("plus", F.lit(0.0)), 12))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(item).desc()))).drop("plus", "__old")


def spread(seeds: DataFrame, keys: list[str], node: str, networks: list[DataFrame], weight: float) -> DataFrame:
    """``keys, node, seed, score``: seed scores, and ``weight * seed * confidence`` for the neighbours in each network."""
    own = seeds.select(*keys, node, F.col("score").alias("seed"), F.col("score").alias("part"))
    joined = [
        seeds.select(*keys, F.col(node).alias("src"), "score").join(n, "src").select(*keys, F.col("dst").alias(node), F.lit(0.0).alias("seed"), (weight * F.col("score") * F.col("weight")).alias("part"))
        for n in networks
    ]
    return reduce(DataFrame.unionByName, joined, own).groupBy(*keys, node).agg(F.sum("seed").alias("seed"), F.round(F.sum("part"), 9).alias("score"))
