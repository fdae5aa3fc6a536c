"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once a session, wherever it is installed."""
    sc = spark.sparkContext
    if getattr(sc, "_statuta_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "statuta.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("statuta", os.path.relpath(path, root)))
    sc.addPyFile(archive)  # the driver serves it to the executors
    sc._statuta_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet table ``name`` of ``sf_dir``; with ``columns``, only these are read."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared ``spark.checkpoint.dir``; set one of our own only where it is unset (tests)."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "statuta-checkpoint"))


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail while the plan is built, not while it runs, if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; have {df.columns}")
    return df


def bounded_rows(df: DataFrame, most: int) -> list:
    """All rows of a small table on the driver; more than ``most`` are an error, never cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where a small table is expected")
    return rows
