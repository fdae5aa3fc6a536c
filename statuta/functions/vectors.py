"""Vector expressions on arrays of numbers, computed in DOUBLE."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def usable(v: Column, dim: int) -> Column:
    """Whether the vector has ``dim`` finite numbers, not all zero; false for null."""
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def l2_normalise(v: Column, zero: str = "clip") -> Column:
    """The vector at length one. ``zero`` says what becomes of a zero vector: ``clip`` and ``keep`` leave it zero,
    ``reject`` makes it null."""
    if zero not in ("clip", "keep", "reject"):
        raise ValueError(f"unknown rule for zero vectors: {zero}")
    n = norm(v)
    n = F.greatest(n, F.lit(1e-12)) if zero == "clip" else F.when(n > 0, n).otherwise(F.lit(1.0) if zero == "keep" else F.lit(None))
    out = F.transform(doubles(v), lambda x: x / n)
    return F.when(n.isNotNull(), out) if zero == "reject" else out


def shorten(v: Column, dim: int) -> Column:
    """The first ``dim`` numbers at length one again."""
    return l2_normalise(F.slice(v, 1, dim))


def blend(a: Column, b: Column, share: float) -> Column:
    """``(1 - share) * a + share * b`` at length one; ``a`` where there is no ``b``."""
    return F.coalesce(l2_normalise(F.zip_with(doubles(a), doubles(b), lambda x, y: (1 - share) * x + share * y)), doubles(a))


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys`` with ``centroid`` (mean of the vectors, at length one) and ``n``. Null vectors don't count; partial sums
    are made before the shuffle."""
    rows = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    means = rows.groupBy(*keys, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    one = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"), F.max("n").alias("n"))
    return one.select(*keys, l2_normalise(F.col("mean")).alias("centroid"), "n")


def decode_floats(c: Column) -> Column:
    """Little-endian 32-bit floats written as base64; null and broken input is null."""

    @F.pandas_udf("array<float>")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: np.frombuffer(b, dtype="<f4") if b is not None and len(b) % 4 == 0 else None)

    return decode(F.unbase64(c))
