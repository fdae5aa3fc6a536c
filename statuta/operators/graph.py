"""Citation graphs as edge tables ``(src, dst)``; the incoming side is the same table read the other way round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("outgoing", "incoming", "both")


def edges(refs: DataFrame, src: str, dst: str, corpus: DataFrame | None = None, key: str = "citation") -> DataFrame:
    """Distinct edges without loops; with ``corpus``, only those with both ends in it."""
    out = refs.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct()
    if corpus is not None:
        known = corpus.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
        out = out.join(known.withColumnRenamed("k", "dst"), "dst", "left_semi").join(known.withColumnRenamed("k", "src"), "src", "left_semi").select("src", "dst")
    return out


def directed(graph: DataFrame, mode: str = "both") -> DataFrame:
    """``(node, neighbor)`` in the given direction."""
    if mode not in MODES:
        raise ValueError(f"unknown graph mode: {mode}")
    out, back = graph.select(F.col("src").alias("node"), F.col("dst").alias("neighbor")), graph.select(F.col("dst").alias("node"), F.col("src").alias("neighbor"))
    return out if mode == "outgoing" else back if mode == "incoming" else out.unionByName(back).distinct()


def neighbors(nodes: DataFrame, node: str, graph: DataFrame, mode: str = "both") -> DataFrame:
    """``nodes`` with each neighbor of its node."""
    return nodes.withColumnRenamed(node, "node").join(directed(graph, mode), "node").withColumnRenamed("node", node)


def expand(seeds: DataFrame, keys: list[str], node: str, graph: DataFrame, mode: str = "both") -> DataFrame:
    """``keys`` with the set of all neighbors of their seeds, one hop; seeds only if a seed points at them."""
    return neighbors(seeds.select(*keys, node), node, graph, mode).select(*keys, F.col("neighbor").alias(node)).distinct()


def degrees(refs: DataFrame, dst: str) -> DataFrame:
    """How often each record is referred to, repetitions within one referring record included."""
    return refs.where(F.col(dst).isNotNull()).groupBy(F.col(dst).alias("node")).agg(F.count("*").alias("degree"))


def degree_idf(degree):
    """Weight of a record by its degree: ``1 / ln(1 + degree)``, degree at least one."""
    return 1.0 / F.log(1 + F.greatest(F.coalesce(degree, F.lit(1)), F.lit(1)))


def two_hops(seeds: DataFrame, keys: list[str], node: str, refs: DataFrame, doc: str, item: str) -> DataFrame:
    """``keys, item, n``: in how many of the documents that cite any seed each item is cited.

    The documents are made distinct between the hops, so a document with several seeds counts once. References are made
    distinct first, which also halves the second join.
    """
    pairs = refs.select(F.col(doc).alias("__d"), F.col(item).alias("__i")).where("__d IS NOT NULL AND __i IS NOT NULL").distinct()
    docs = seeds.select(*keys, F.col(node).alias("__i")).join(pairs, "__i").select(*keys, "__d").distinct()
    return docs.join(pairs, "__d").groupBy(*keys, F.col("__i").alias(item)).agg(F.count("*").alias("n"))


def families(corpus: DataFrame, citation: str):
    """``(family, citation, place)``: the paragraphs of each article; the article itself first, then by paragraph."""
    from statuta.functions.text import citation_parts, family_key
    from statuta.operators.scores import ranks

    parts = corpus.select(F.col(citation).alias("citation")).distinct().withColumn("p", citation_parts(F.col("citation"))).where("p IS NOT NULL")
    return ranks(parts.withColumn("family", family_key(F.col("citation"))), ["family"], F.col("p.abs"), F.col("citation"), name="place").select("family", "citation", "place")
