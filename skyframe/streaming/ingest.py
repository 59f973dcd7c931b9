"""Continuous fetch-parse-upsert: payload files landing in a directory are parsed and
upserted into the day-partitioned observation store.

Late rows are simply upserts into older days, so the query needs no watermark and
no state; each micro-batch is applied with the idempotent persisted upsert, so a
batch replayed after a failure leaves the same store.

Every micro-batch adds a row to the store's ledger in the commit that applies it: files, records,
malformed payloads, inserted, matched, modified, skipped and saved rows. A batch that a restart
replays is known by checkpoint and number and counted once.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..config import STORE_COLS
from ..operators.store import upsert_into_store
from ..sources.payloads import is_malformed, parse_history

# One landing record: the request it answers (place, coordinates), its number in the order of
# fetching (unique per file) and the raw payload.
LANDING_SCHEMA = T.StructType([
    T.StructField("province", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("record", T.LongType()),
    T.StructField("payload", T.StringType()),
])


def parse_landing(records: DataFrame) -> DataFrame:
    """Landing records → store rows with a ``seq`` ordering duplicates: file modification
    time, file name, number of the record, then position of the day and of the hour inside
    the payload, so no two rows are equal in it."""
    return parse_history(with_file_order(records), order_cols=("_ft", "_fn", "record"))


def with_file_order(records: DataFrame) -> DataFrame:
    return records.select("*", F.col("_metadata.file_modification_time").alias("_ft"), F.col("_metadata.file_name").alias("_fn"))


def ingest_stream(spark: SparkSession, landing: str, store_path: str, checkpoint: str, staging_root: str | None = None,
                  max_files_per_trigger: int = 1000, available_now: bool = True):
    """Start the ingest query; returns the ``StreamingQuery``. (``staging_root`` is not used any more.)

    ``available_now=True`` processes everything present and stops (a scheduled daily
    run); ``False`` keeps polling the landing directory.
    """
    stream = (spark.readStream.schema(LANDING_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .json(landing))
    records = with_file_order(stream)

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            told = batch.agg(F.count_distinct("_fn").alias("files"), F.count(F.lit(1)).alias("records"),
                             F.count_if(is_malformed("payload")).alias("malformed")).first().asDict()
            rows = parse_history(batch, order_cols=("_ft", "_fn", "record"))
            upsert_into_store(batch.sparkSession, store_path, rows.select(*STORE_COLS, "seq"),
                              ledger={"writer": checkpoint, "batch": batch_id, **told})
        finally:
            batch.unpersist()

    writer = records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
