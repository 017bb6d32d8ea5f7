"""Incremental ingestion of snapshot files into the Parquet panel table.

The analyses are batch reports over a whole panel. When the panel grows
by new snapshot CSV files, this module reads the folder as a file stream
(same declared schema and cast projection as the batch reader) and appends
each micro-batch to the panel table; reports then run as batch queries on
that table. No report is computed in the stream.

Each micro-batch is written with dynamic partition overwrite into its own
``ingest_batch`` partition, so a batch replayed after a failure replaces
its own files instead of adding duplicates; stream progress lives in a
checkpoint under the shared ``spark.checkpoint.dir`` folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rosterlens import constants as K
from rosterlens.session import checkpoint_root
from rosterlens.sources.raw_csv import READ_OPTIONS, TEXT_SCHEMA, positioned, typed_panel

INGEST_BATCH = "ingest_batch"
# a snapshot id is the batch, the slot of the split in the batch's files, and the row in the reading task
_ROW_IDS, _SLOTS = 1 << 23, 1 << 18
_BATCHES = (1 << 63) // (_ROW_IDS * _SLOTS)       # 4 million: 8 years at one a minute


def snapshot_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw snapshot rows of the CSV files arriving in ``source_dir`` (streaming)."""
    reader = spark.readStream.schema(TEXT_SCHEMA).options(**READ_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return positioned(reader.csv(source_dir))


def _append_batch(store_path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id >= _BATCHES:
            raise OverflowError(f"snapshot ids end at batch {_BATCHES}; go on with a new panel table")
        typed = typed_panel(batch, row_ids=_ROW_IDS, slots=_SLOTS)
        typed = typed.withColumn(K.SNAPSHOT, F.lit(batch_id * _ROW_IDS * _SLOTS) + F.col(K.SNAPSHOT))
        (
            typed.withColumn(INGEST_BATCH, F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(INGEST_BATCH, K.STATUS_YEAR)
            .parquet(store_path)
        )

    return write


def ingest_snapshots(
    spark: SparkSession,
    source_dir: str,
    store_path: str,
    checkpoint: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start appending the snapshot files of ``source_dir`` to ``store_path``.

    ``available_now`` processes what is there and stops; otherwise the query
    keeps running and picks up new files.
    """
    ckpt = checkpoint or f"{checkpoint_root(spark)}/rosterlens-ingest"
    writer = (
        snapshot_stream(spark, source_dir, max_files_per_trigger)
        .writeStream.foreachBatch(_append_batch(store_path))
        .option("checkpointLocation", ckpt)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
