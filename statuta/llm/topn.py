"""Top N items within every group, by one global sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _first_positions(n: int):
    """Kernel over one sorted partition: its rows at positions up to ``n`` of their group, counted from the partition's
    start, and one row with the size of the last group, which may go on in the next partition."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        current, seen, schema = None, 0, None
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            schema = batch.schema
            group = batch.column(0)
            starts = np.zeros(rows, dtype=bool)
            starts[0] = current is None or group[0].as_py() != current
            if rows > 1:
                starts[1:] = pc.not_equal(group.slice(1), group.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(starts)
            index = np.arange(rows)
            origin = np.full(rows, -seen)  # rows before the first start go on with the group of the batch before
            if len(begin):
                which = np.searchsorted(begin, index, side="right") - 1
                origin = np.where(which >= 0, begin[np.maximum(which, 0)], -seen)
            position = index - origin + 1
            seen, current = int(position[-1]), group[rows - 1].as_py()
            keep = np.flatnonzero(position <= n)
            if len(keep):
                part = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(keep), pid), pa.int32()), pa.array(position[keep], pa.int64()), pa.nulls(len(keep), pa.int64())], names=[*schema.names, "pid", "local", "size"]
                )
        if current is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([current], schema.field(0).type), *[pa.nulls(1, f.type) for f in list(schema)[1:]], pa.array([pid], pa.int32()), pa.nulls(1, pa.int64()), pa.array([seen], pa.int64())], names=[*schema.names, "pid", "local", "size"]
            )

    return kernel


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """``(group, item, score, position)``: the ``n`` best items of every group, score descending, then item descending.

    An item's score is the highest of its rows (aggregated map-side before anything moves). Items are range-partitioned
    on group, score and item and sorted, so a group of any size spreads over as many partitions as it fills. Each
    partition numbers its own rows and drops what is beyond ``n`` already there; the sizes of the groups cut by a
    partition's end are prefix-summed over the partitions to make the numbers exact. The last step sees at most ``n``
    rows a group and partition.
    Rows with null group, item or score, or NaN score, do not count; groups with fewer items give all; repeated rows
    count once; an empty table gives no rows; other columns are left out, whatever their names.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s")).where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    best = rows.groupBy("g", "i").agg(F.max("s").alias("s")).select("g", "s", "i")
    order = [F.col("g"), F.col("s").desc(), F.col("i").desc()]
    ranged = best.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*ranged.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("local", T.LongType()), T.StructField("size", T.LongType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    numbered = ranged.mapInArrow(_first_positions(n), schema)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("g").orderBy("pid").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = numbered.withColumn("position", F.col("local") + before).where(F.col("position") <= n)
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "position")
