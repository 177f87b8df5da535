"""Incremental output: sections that arrive in files are processed as they come and appended once each.

``follow`` compares each micro-batch with the output by key; ``follow_first`` keeps the keys that it has seen in Spark's own state, so that no output is read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.records import append_jsonl


def follow(spark: SparkSession, folder: str, schema: str, transform, out: str, keys: list[str], out_schema: str, checkpoint: str, once: bool = True):
    """Read JSON lines that appear in ``folder``, transform each micro-batch and append what ``out`` lacks by key.

    A batch that runs again after a failure appends nothing twice. Each batch reads the output; for streams of many batches use ``follow_first``.
    """

    def write(batch: DataFrame, _: int) -> None:
        append_jsonl(transform(batch).dropDuplicates(keys), out, keys, out_schema)

    stream = spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def follow_first(spark: SparkSession, folder: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, keys: list[str], checkpoint: str, once: bool = True, arrived: str | None = None, late: str = "7 days", files: int = 1000):
    """Read JSON lines that appear in ``folder`` and append the first row of every key that ``transform`` (a plan without actions) makes of them.

    The keys seen are Spark's state, kept in the checkpoint with the list of files read and of files written, so a stream that starts again goes on where it was, and a
    batch that failed is made again with the same files; nothing of the output is read. Nulls are a key like any other. The state has a row a key; with ``arrived``, a timestamp column, keys are
    forgotten once rows are ``late`` behind the latest, and rows later than that are dropped. ``files``: at most so many a batch.
    """
    rows = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder))
    first = rows.dropDuplicates(keys) if arrived is None else rows.withWatermark(arrived, late).dropDuplicatesWithinWatermark(keys)
    stream = first.writeStream.format("json").option("path", out).option("ignoreNullFields", "false").option("checkpointLocation", checkpoint).outputMode("append")
    return (stream.trigger(availableNow=True) if once else stream).start()
