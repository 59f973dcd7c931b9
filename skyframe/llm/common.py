"""Small helpers the operators share: table access, scratch tables, partition counts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from skyframe.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor can reread, so a lost executor costs only
    its unfinished tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(compression=compression, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


BATCH_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], text_at: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that the texts of a slice have at most about ``most`` bytes (a longer
    text comes at the end of one). Batches are cut by rows: what a task makes of one at once
    would grow with the length of its texts."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(begin, end - begin)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, which at its task's end gives back what its arrays took. A worker stays for the
    next task, and what it keeps counts beside the sorts of stages that have no Python."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
            if trim is not None:
                trim(0)

    return wrapped
