"""Maximal marginal relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def mmr(pool: DataFrame, query: str, item: str, relevance: str, vector: str, k: int, balance: float = 0.8) -> DataFrame:
    """``query, item, pick``: up to ``k`` items of each query's pool, chosen one by one by ``balance * relevance - (1 -
    balance) * largest similarity to those chosen``; the most relevant comes first, ties go to the earlier in relevance
    (then item).

    Each choice depends on the ones before, so a query's pool is one task; pools are cut to a few dozen candidates
    before. With ``balance`` near one or a pool no larger than ``k`` it is the order of relevance.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([relevance, item], ascending=[False, True], kind="stable").reset_index(drop=True)
        n, take = len(pdf), min(k, len(pdf))
        if balance >= 0.999 or n <= k:
            order = list(range(take))
        else:
            m = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]])
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            rel, order = pdf[relevance].to_numpy(dtype=float), [0]
            nearest = m @ m[0]
            left = np.ones(n, bool)
            left[0] = False
            while len(order) < take:
                value = np.where(left, np.round(balance * rel - (1 - balance) * nearest, 12), -np.inf)
                best = int(np.argmax(value))
                order.append(best)
                left[best] = False
                nearest = np.maximum(nearest, m @ m[best])
        out = pdf.iloc[order][[query, item]].copy()
        out["pick"] = np.arange(1, len(order) + 1)
        return out

    fields = {f.name: f.dataType.simpleString() for f in pool.schema.fields}
    return pool.select(query, item, relevance, vector).groupBy(query).applyInPandas(choose, f"{query} {fields[query]}, {item} {fields[item]}, pick long")
