"""Structured Streaming form of the review-text source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.text import RECORD_DELIMITER, parse_records


def interaction_stream(spark: SparkSession, path: str,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``user_id, item_id, ts`` from review files arriving in ``path``."""
    reader = spark.readStream.option("lineSep", RECORD_DELIMITER)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parse_records(reader.text(path))


def ingest_review_files(spark: SparkSession, source_dir: str, table_dir: str,
                        checkpoint_location: str | None = None,
                        available_now: bool = True) -> StreamingQuery:
    """Append parsed interactions of new files to a Parquet table.

    Exactly-once through the streaming checkpoint, which belongs to the table:
    it is kept beside its files (a hidden folder readers skip) unless given,
    so a later call goes on where the last one ended. With ``available_now`` the query
    processes what is there and stops.
    """
    ckpt = checkpoint_location or f"{table_dir.rstrip('/')}/_ingest_checkpoint"
    writer = (interaction_stream(spark, source_dir).writeStream.format("parquet")
              .option("path", table_dir).option("checkpointLocation", ckpt)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="30 seconds")
    return writer.start()
