"""Incremental feature build: process each census file once, as it arrives.

The reference processes a folder of yearly files in a batch. The streaming
form of the same job watches the folder with Structured Streaming: a
``binaryFile`` stream selecting only the path (file contents are never read
by the stream) records which files were seen in the checkpoint's source log,
and ``foreachBatch`` runs the batch feature build on the new files of each
micro-batch. Each file overwrites its own (year, file) partition and each
micro-batch its own partition of the status table, so a micro-batch replayed
after a failure writes the same again.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import StudyConfig
from ..session import wide_tables

_BINARY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def start_feature_stream(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str,
                         cfg: StudyConfig = StudyConfig(), simple: bool = False,
                         available_now: bool = True, max_files_per_trigger: int = 10):
    """Start the stream; returns the ``StreamingQuery``.

    ``available_now=True`` processes everything present and stops (scheduled
    runs); ``False`` keeps polling every minute.
    """
    from ..plans.jobs import write_feature_file
    from ..sources.csv import scan_csv, write_table

    tables = posixpath.join(output_dir, "tables")
    status_path = posixpath.join(output_dir, "_status")

    def process(batch, epoch_id):
        # one row per newly arrived file (bounded by maxFilesPerTrigger)
        paths = sorted(r[0] for r in batch.select("path").collect())
        rows = []
        for path in paths:
            try:
                raw = scan_csv(spark, path, sep=";", encoding="ISO-8859-1")
                with wide_tables(spark):
                    n = write_feature_file(raw, path, tables, cfg, simple)
                rows.append((path, "ok" if n else "skipped", "" if n else "no rows after filters", n))
            except Exception as e:  # noqa: BLE001 - a bad file is recorded, the stream goes on
                rows.append((path, "failed", f"{type(e).__name__}: {e}", None))
        if rows:  # a replayed micro-batch replaces its own rows
            status = spark.createDataFrame(rows, "file string, status string, reason string, rows_out long")
            write_table(status.withColumn("epoch", F.lit(int(epoch_id))), status_path, partition_by="epoch", mode="overwrite")

    stream = (spark.readStream.format("binaryFile").schema(_BINARY_SCHEMA)
              .option("pathGlobFilter", "*.[cC][sS][vV]")
              .option("maxFilesPerTrigger", str(max_files_per_trigger))
              .load(input_dir).select("path"))
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
