"""Documents as they arrive: each is processed once, and late or repeated deliveries change nothing.

An extension: batch jobs resume by anti-join; a stream does the same with a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_arrivals(spark: SparkSession, source: str, schema: str, key: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Apply ``work`` to each new Parquet file's rows and append the result; a key that is done is left out. What is
    there is processed, then the query ends; started again, it goes on with what came since."""
    from statuta.operators.incremental import todo
    from statuta.sources.sinks import exists

    def batch(df: DataFrame, _: int) -> None:
        fresh = df.dropDuplicates([key])
        if exists(spark, target):
            fresh = todo(fresh, spark.read.parquet(target), key)
        work(fresh).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, kind: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``window, kind, n`` of a stream or table: tumbling windows; rows later than ``late`` are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), kind).agg(F.count("*").alias("n"))
