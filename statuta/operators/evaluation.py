"""Set-based quality of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f1(predicted: Column, gold: Column, empty_both: float = 1.0) -> Column:
    """F1 of two sets given as arrays; ``empty_both`` if both are empty, 0 if they share nothing."""
    p, g = F.array_distinct(F.coalesce(predicted, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(gold, F.array().cast("array<string>")))
    hits = F.size(F.array_intersect(p, g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(float(empty_both))).when(hits == 0, 0.0).otherwise(2.0 * hits / (F.size(p) + F.size(g)))


def judge(predictions: DataFrame, gold: DataFrame, query: str, predicted: str = "predicted", gold_col: str = "gold", missing_gold: str = "skip") -> DataFrame:
    """Predictions with the gold of their query. ``missing_gold``: ``skip`` leaves out queries without gold, ``empty``
    gives them the empty set."""
    if missing_gold not in ("skip", "empty"):
        raise ValueError(f"unknown rule for missing gold: {missing_gold}")
    how = "inner" if missing_gold == "skip" else "left"
    return predictions.select(query, predicted).join(gold.select(query, gold_col), query, how)


def score(judged: DataFrame, predicted: str = "predicted", gold: str = "gold", empty_both: float = 1.0) -> DataFrame:
    """One row: queries, macro and micro F1, precision, recall, hits and set sizes. All 0 without rows."""
    none = F.array().cast("array<string>")
    p, g = F.array_distinct(F.coalesce(F.col(predicted), none)), F.array_distinct(F.coalesce(F.col(gold), none))
    rows = judged.select(f1(p, g, empty_both).alias("f"), F.size(F.array_intersect(p, g)).alias("h"), F.size(p).alias("p"), F.size(g).alias("g"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    h, np_, ng = total("h"), total("p"), total("g")
    return rows.agg(F.count("*").alias("queries"), F.coalesce(F.avg("f"), F.lit(0.0)).alias("macro_f1"), ratio(2.0 * h, np_ + ng).alias("micro_f1"), ratio(h, np_).alias("precision"), ratio(h, ng).alias("recall"), h.alias("hits"), np_.alias("predicted"), ng.alias("gold"))


def list_sizes(predictions: DataFrame, predicted: str) -> DataFrame:
    """One row: number of lists, mean, smallest and largest size, empty ones."""
    n = F.size(F.coalesce(F.col(predicted), F.array().cast("array<string>")))
    return predictions.agg(F.count("*").alias("lists"), F.avg(n).alias("mean_size"), F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.count_if(n == 0).alias("empty"))
