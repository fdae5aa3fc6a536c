"""Blocks of a table in the shared folder. Tasks that have to see all of it read one block after the other, instead of
getting a copy each by a shuffle: it is on disk once, however many tasks there are."""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import pyarrow.parquet as pq
from pyarrow import RecordBatch, Table, fs
from pyspark.sql import DataFrame

from statuta.plans.runtime import ensure_checkpoint_dir


def shelve(df: DataFrame) -> str:
    """Write each row, a block, as a file of its own in the folder of the checkpoints; gives the place. It goes when the
    driver ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/blocks-{uuid4().hex}"
    df.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(place)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return place


def blocks(place: str) -> tuple[fs.FileSystem, list[str]]:
    """The file system and the files of a place, one a block, in the order of the rows written."""
    system, path = (fs.LocalFileSystem(), "/" + place[len("file:") :].lstrip("/")) if place.startswith("file:") else fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
    order = lambda p: [int(x) for x in re.search(r"part-(\d+)-.*[.-]c(\d+)\.[^/]*$", p).groups()]
    found = sorted((x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")), key=order)
    return system, [p for p in found if pq.read_metadata(system.open_input_file(p)).num_rows]


def read_file(system: fs.FileSystem, file: str, *columns: str) -> Table:
    return pq.ParquetFile(system.open_input_file(file)).read(columns=list(columns) or None)


def read(place: str, *columns: str) -> Iterator[Table]:
    """The blocks, one at a time."""
    system, files = blocks(place)
    for file in files:
        yield read_file(system, file, *columns)


def slabs(batches: Iterator[RecordBatch], size: int) -> Iterator[Table]:
    """The rows of the batches again, ``size`` at a time, or nearly twice as many."""
    held, n = [], 0
    for b in batches:
        for start in range(0, len(b), size):
            held.append(b.slice(start, size))
            n += len(held[-1])
            if n >= size:
                yield Table.from_batches(held)
                held, n = [], 0
    if held:
        yield Table.from_batches(held)
