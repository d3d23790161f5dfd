"""Structured Streaming: buffered line processing and running meters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from seqspark.session import written


def line_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Files arriving in a folder; a micro-batch buffers a bounded number of them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def process_in_order(
    stream: DataFrame, process: Callable[[DataFrame], DataFrame], order: list[str], out: str, checkpoint: str
) -> StreamingQuery:
    """Run a batch function on each micro-batch and write its rows in input order.

    Each micro-batch has its own folder, replaced when the batch is replayed after a
    failure, so the output is written exactly once. Processed rows are written before they
    are ordered: the bounds of the order are then sampled without processing them twice.
    """

    def sink(batch: DataFrame, number: int) -> None:
        done = written(process(batch), "processed")
        done.orderBy(*order).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_meters(stream: DataFrame, key: list[str], value: str, n: Column | None = None) -> DataFrame:
    """Weighted sums and counts per key; the state is one row per key."""
    n = F.lit(1).cast("bigint") if n is None else n
    return stream.groupBy(*key).agg(F.sum(F.col(value) * n).alias("sum"), F.sum(n).alias("count"))


def latest(meters: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the current meters in a folder, rewritten by every micro-batch."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return (
        meters.writeStream.outputMode("complete")
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
