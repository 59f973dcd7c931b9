"""Scoring of a stream of requests: every micro-batch is scored with one model version.

The newest complete version is loaded when a micro-batch begins and its number is written with
every row, so a version that appears in between is used from the next batch on and never
half-way. A batch is written to a folder named by its number, which a replay replaces, so each
request comes out once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..operators import modeling

BATCH = "batch"


def score_stream(spark: SparkSession, requests: str, schema: T.StructType, models: str, out: str, checkpoint: str,
                 keep: Sequence[str], available_now: bool = True, max_files_per_trigger: int = 1000):
    """Start scoring the Parquet files that land in ``requests`` with the active model under
    ``models``; returns the ``StreamingQuery``. Rows of ``out`` hold ``keep``, ``prediction``, ``status``
    and ``model_version``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(requests)

    def apply(batch: DataFrame, batch_id: int) -> None:
        model, version = modeling.load_active(models)
        scored = modeling.score(model, batch, keep=keep).withColumn("model_version", F.lit(version))
        scored.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{BATCH}={batch_id}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_scored(spark: SparkSession, out: str) -> DataFrame:
    """All rows scored so far."""
    return spark.read.parquet(out).drop(BATCH)
