"""Incremental conversion with Structured Streaming.

Archive-list files (one archive name per line) dropped into ``list_dir`` are
the stream. Each micro-batch is one conversion of the store's ingest log, like
the batch ``convert`` job, whose commit carries the stream's checkpoint and the
number of the batch: a batch replayed after a failure removes what its earlier
attempt wrote, and one that was committed is not repeated. Batch and streaming
conversions share the log, so either skips what the other has done.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.schemas import DEFAULT_BLOCK_SIZE
from gridframe.sources import ingest_log


def _batch_writer(root: str, layout: DataFrame, out_dir: str, block_size: int, checkpoint: str):
    layout_rows = layout.collect()
    layout_schema = layout.schema
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        names = batch.select(F.trim("value").alias("archive_name")).where(F.col("archive_name") != "")
        ingest_log.ingest(spark, names, root, spark.createDataFrame(layout_rows, layout_schema), out_dir, block_size,
                          commit_id=f"stream-{stream}-{epoch_id}")

    return write_batch


def start_ingest(
    spark: SparkSession,
    list_dir: str,
    root: str,
    layout: DataFrame,
    out_dir: str,
    checkpoint: str,
    block_size: int = DEFAULT_BLOCK_SIZE,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
):
    """Start the incremental conversion; returns the ``StreamingQuery``.

    ``available_now`` processes everything present and stops (a resumable
    batch run); otherwise the query keeps watching ``list_dir``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(list_dir)
    writer = lines.writeStream.foreachBatch(_batch_writer(root, layout, out_dir, block_size, checkpoint)).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
