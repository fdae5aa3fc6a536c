"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def submission(ranked: DataFrame, query: str, item: str, rank: str, name: str = "predicted_citations") -> DataFrame:
    """One row per query with its items joined by ``;`` in order of rank; nulls left out."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("i"))))
    return ranked.where(F.col(item).isNotNull()).groupBy(query).agg(F.array_join(F.transform(listed, lambda x: x["i"]), ";").alias(name))


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, rows_per_file: int | None = None) -> None:
    """Without ``overwrite``, an existing target is an error; ``rows_per_file`` bounds the size of files."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """Replace a table: written beside it whole, then put in its place by two renames. If the second fails, the old table
    is put back. Between the two a reader finds no table, but never a part of one."""
    spark = df.sparkSession
    beside = path.rstrip("/") + "__next"
    df.write.mode("overwrite").parquet(beside)
    new, fs = _path(spark, beside)
    old, _ = _path(spark, path)
    gone, _ = _path(spark, path.rstrip("/") + "__old")
    fs.delete(gone, True)
    had = fs.exists(old)
    if had and not fs.rename(old, gone):
        raise OSError(f"could not set aside {path}")
    if not fs.rename(new, old):
        if had:
            fs.rename(gone, old)
        raise OSError(f"could not publish {path}")
    fs.delete(gone, True)


def replace_column(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with one column changed, in its place; all others as they are."""
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.withColumn(name, value)


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text per row, keys sorted, nulls left out, numbers at six decimals."""
    cols = [F.bround(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]
    return df.select(F.to_json(F.struct(*cols)).alias(name))
