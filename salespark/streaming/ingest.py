"""Incremental load of flat order exports with Structured Streaming.

New CSV files dropped into a folder are read by a file-source stream with
the explicit flat schema; each micro-batch is split into customers,
products and orders (``sources.flatfile.normalize``) and stored as a load of
its own, named after the stream and the batch.  A batch replayed after a
failure replaces its own load, so the load is idempotent end to end and
keeps every order line however files are grouped into batches; the stream's
progress lives in a checkpoint under the session's shared checkpoint folder.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.session import ensure_checkpoint_dir
from ..sources import flatfile, schema


def flat_file_stream(spark: SparkSession, source_dir: str,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.schema(schema.FLAT).option("header", True).option("escape", '"')
              .option("dateFormat", "yyyy-MM-dd").option("mode", "FAILFAST"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(source_dir)


def load_batch(batch: DataFrame, tables_dir: str, load_id: str) -> None:
    """Normalise one micro-batch and store it as the load ``load_id``.

    The batch feeds three writes, so it is persisted for their duration
    instead of being read from the source files three times.
    """
    batch = batch.persist()
    try:
        flatfile.write_tables(*flatfile.normalize(batch), tables_dir, load_id)
    finally:
        batch.unpersist()


def start_flat_file_load(spark: SparkSession, source_dir: str, tables_dir: str,
                         checkpoint_location: str | None = None, available_now: bool = True,
                         processing_time: str | None = None,
                         max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the incremental load.

    ``available_now=True`` processes every file present and stops (a batch
    job with streaming bookkeeping); otherwise the query keeps running with
    ``processing_time`` triggers.  The checkpoint defaults to a folder under
    the session's checkpoint directory, named after the target tables.
    """
    # a stable digest (Python's ``hash`` changes per process), so a restarted
    # stream finds its own progress and names its batches alike
    digest = hashlib.sha1(f"{source_dir}\n{tables_dir}".encode("utf-8")).hexdigest()[:16]
    if checkpoint_location is None:
        checkpoint_location = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{digest}"
    stream = flat_file_stream(spark, source_dir, max_files_per_trigger)
    writer = (stream.writeStream.option("checkpointLocation", checkpoint_location)
              .foreachBatch(lambda batch, epoch: load_batch(batch, tables_dir, f"{digest}-{epoch}")))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
