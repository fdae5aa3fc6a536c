"""Work that goes on where it stopped: what is left to do, parts written one by one, and their consolidation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.sources.sinks import exists


def todo(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet; null keys are always left to do."""
    return source.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def done_keys(spark: SparkSession, base: str | None, shards: str, key: str) -> DataFrame | None:
    """Keys in the base table and in all parts written since; None if there is neither."""
    found = [spark.read.parquet(p).select(key) for p in (base, shards) if p and exists(spark, p)]
    return reduce(DataFrame.unionByName, found).distinct() if found else None


def append_shard(df: DataFrame, path: str) -> None:
    """One more part, committed as a whole by the file committer."""
    df.write.mode("append").parquet(path)


def consolidate(spark: SparkSession, base: str | None, shards: str, target: str, files: int) -> None:
    """Base and parts as one table of ``files`` files; rows aren't deduplicated."""
    parts = [spark.read.parquet(p) for p in (base, shards) if p and exists(spark, p)]
    if not parts:
        raise FileNotFoundError(shards)
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition(files).write.mode("errorifexists").parquet(target)


def resume(source: DataFrame, previous: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``source`` with what was computed before; columns that are missing there are null."""
    have = previous.select(key, *[F.col(c) if c in previous.columns else F.lit(None).cast("string").alias(c) for c in columns]).dropDuplicates([key])
    return source.drop(*columns).join(have, key, "left")


def cache_misses(candidates: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that have no score yet."""
    return candidates.join(cache.where("score IS NOT NULL AND NOT isnan(score)").select(*keys).distinct(), keys, "left_anti")


def rows_between(df: DataFrame, ordinal: str, start: int, end: int | None = None) -> DataFrame:
    """Rows with ``start <= ordinal < end``."""
    out = df.where(F.col(ordinal) >= start)
    return out if end is None else out.where(F.col(ordinal) < end)


def newest(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """One row per key, the last in ``order`` (then ``tie``); aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("__r")).select(*keys, "__r.*")
