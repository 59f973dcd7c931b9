"""Keyed observation store: last-wins merge, presence-aware upsert, counters, and the
persisted jobs (upsert, day merge).

Skew: last-wins keeps ``row_number() = 1``. Spark applies that limit per input partition
before the shuffle, so a hot key sends one row per task, not all of them.

Persisted jobs read and write only the day partitions they touch, each once: the new days go to
a folder made for the call, where they stay, and one commit makes it part of the table
(``sources.snapshots``). A job that dies before its commit changes nothing. Of two writers that
change different days both commits stand; if they change the same day, the later one works it
out again on the state the earlier one left.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from ..config import STORE_COLS, STORE_KEYS
from ..functions.scalars import nan_to_null
from ..sources import files, snapshots
from .cleaning import day_slice

MAX_DAYS = 100_000  # day partitions one batch may touch
COUNTERS = ("inserted", "matched", "modified")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the row with the greatest ``order`` tuple (must be unique per key).

    NULL keys form their own group, as in a drop-duplicates.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def nulls_for_nans(df: DataFrame) -> DataFrame:
    """NaN → NULL in every floating column (what a store keeps for a missing number)."""
    return df.select(*[nan_to_null(f.name).cast(f.dataType).alias(f.name)
                       if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields])


def merge_day_into_base(base: DataFrame, store: DataFrame, day: str | _dt.date, keys: Sequence[str] = STORE_KEYS,
                        seq: str | None = "seq", cols: Sequence[str] = STORE_COLS) -> DataFrame:
    """History merge in memory: ``store`` rows of ``day`` (projected to ``cols``) appended to
    ``base``; per key the later source wins, then the larger ``seq`` inside a source."""
    keep = [*cols, seq] if seq else list(cols)
    today = day_slice(store, day, cols=None).select(*keep)
    both = (base.select(*keep).withColumn("_src", F.lit(0))
            .unionByName(today.withColumn("_src", F.lit(1))))
    order = ["_src", seq] if seq else ["_src"]
    return last_wins(both, keys, order).drop("_src")


def day_of_store(spark: SparkSession, path: str, day: str | _dt.date) -> DataFrame:
    """The store's rows of one day: the scan reads that day's partition only."""
    d = day if isinstance(day, _dt.date) else _dt.date.fromisoformat(str(day))
    return day_slice(files.read_store(spark, path, days=[d]), d)


def until(spark: SparkSession, path: str, day: _dt.date) -> DataFrame:
    """The store's rows up to the end of ``day``."""
    return files.read_store(spark, path).where(F.to_date(F.col(STORE_KEYS[0])) <= F.lit(day))


def create_history(df: DataFrame, path: str, keys: Sequence[str] = STORE_KEYS, seq: str = "seq") -> None:
    """First write of a history: deduplicated once, so that later merges need not look back."""
    if snapshots.latest(df.sparkSession, path).version:
        raise ValueError(f"{path} has been written to before")
    files.write_store(nulls_for_nans(last_wins(df, keys, [seq])), path)


def merge_day_into_history(spark: SparkSession, path: str, store: DataFrame, day: str | _dt.date, staging_root: str | None = None,
                           keys: Sequence[str] = STORE_KEYS, seq: str = "seq") -> None:
    """Persisted day merge: ``store`` rows of ``day`` win over the history's rows of that day.
    Only that day's partition is read, merged and written. (``staging_root`` is not used any more.)"""
    d = day if isinstance(day, _dt.date) else _dt.date.fromisoformat(str(day))
    today = last_wins(day_slice(store, d, cols=None).select(*STORE_COLS, seq), keys, [seq]).drop(seq)

    def merged(base: snapshots.Snapshot) -> tuple[DataFrame, None]:
        both = (files.read_store(spark, path, days=[d], snapshot=base).withColumn("_src", F.lit(0))
                .unionByName(nulls_for_nans(today).withColumn("_src", F.lit(1))))
        return last_wins(both, keys, ["_src"]).drop("_src"), None

    _commit_days(spark, path, [d], merged, {})


def _commit_days(spark: SparkSession, path: str, days: Sequence[_dt.date], work: Callable, entry: dict[str, object]) -> dict[str, object]:
    """Write what ``work`` makes of the state's ``days`` and commit it; start over while another
    writer changes one of those days first. ``work`` takes the state and returns the new rows and the
    counters' Observation (or None). Returns the entry of the ledger."""
    named = [str(d) for d in days]
    while True:
        base = snapshots.latest(spark, path)
        if _applied(base, entry):
            return _entry_of(spark, path, entry)
        told, changed = dict(entry), {}
        if named:
            new, observation = work(base)
            commit_id = uuid.uuid4().hex
            folder = snapshots.folder_of(path, commit_id)
            files.write_store(new, folder)
            # a day left without rows has no folder
            changed = {d: commit_id if files.exists(spark, f"{folder}/{files.STORE_PARTITION}={d}") else "" for d in named}
            if observation is not None:
                told |= _totals(observation.get, told)
        head = base
        while all(head.days.get(d) == base.days.get(d) for d in named):
            if _applied(head, entry):
                return _entry_of(spark, path, entry)
            if snapshots.commit(spark, path, head, changed, told):
                return told
            head = snapshots.latest(spark, path)


def _applied(state: snapshots.Snapshot, entry: Mapping[str, object]) -> bool:
    return entry.get("writer") is not None and state.batches.get(entry["writer"], -1) >= entry["batch"]


def _entry_of(spark: SparkSession, path: str, entry: Mapping[str, object]) -> dict[str, object]:
    """What the ledger says of a batch that has been applied before."""
    row = snapshots.ledger(spark, path).where((F.col("writer") == entry["writer"]) & (F.col("batch") == entry["batch"])).first()
    return {**entry, **({} if row is None else row.asDict())}


def _totals(got: Mapping[str, object], entry: Mapping[str, object]) -> dict[str, int]:
    out = {k: int(got.get(k, 0) or 0) for k in COUNTERS}
    return {**out, "skipped": entry["skipped"], "saved": out["inserted"] + out["modified"]}


def _all_keys_present(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def _upsert_join(target: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str | None) -> tuple[DataFrame, list[str]]:
    keys = list(keys)
    valid = nulls_for_nans(batch.where(_all_keys_present(keys)))
    if seq:
        valid = last_wins(valid, keys, [seq]).drop(seq)
    set_cols = [c for c in valid.columns if c not in keys and c in target.columns]
    t = target.select(*[F.col(c) for c in target.columns], F.lit(True).alias("_in_t"))
    b = valid.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in set_cols], F.lit(True).alias("_in_b"))
    return t.join(b, keys, "full"), set_cols


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str] = STORE_KEYS, seq: str | None = "seq") -> DataFrame:
    """Keyed upsert (``$set`` with insert): for every batch key the batch record replaces
    the fields it carries (NULLs overwrite), unseen keys are inserted, fields absent
    from the batch are untouched. Batch rows with a NULL key are skipped; duplicate
    keys inside the batch resolve to the largest ``seq``. Applying twice = once.
    """
    j, set_cols = _upsert_join(target, batch, keys, seq)
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in set_cols:
            cols.append(F.when(F.col("_in_b"), F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def _counter_exprs(set_cols: Sequence[str]) -> dict[str, Column]:
    same = F.lit(True)
    for c in set_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    matched = F.col("_in_b") & F.col("_in_t")
    return {
        "inserted": F.count_if(F.col("_in_b") & F.col("_in_t").isNull()),
        "matched": F.count_if(matched),
        "modified": F.count_if(matched & ~same),
    }


def upsert_counts(target: DataFrame, batch: DataFrame, keys: Sequence[str] = STORE_KEYS,
                  seq: str | None = "seq") -> DataFrame:
    """One row: inserted, matched, modified (a matched key whose fields changed),
    skipped (NULL key), saved = inserted + modified.

    NULL-key rows never enter the join (they would all hash to one partition); they
    are appended to the joined flags and counted by the same single aggregate.
    """
    j, set_cols = _upsert_join(target, batch, keys, seq)
    c = _counter_exprs(set_cols)
    flags = j.withColumn("_skip", F.lit(False))
    invalid = batch.where(~_all_keys_present(keys)).select(F.lit(True).alias("_skip"))
    both = flags.unionByName(invalid, allowMissingColumns=True)
    counts = both.agg(*[v.alias(k) for k, v in c.items()], F.count_if(F.col("_skip")).alias("skipped"))
    return counts.select("inserted", "matched", "modified", "skipped",
                         (F.col("inserted") + F.col("modified")).alias("saved"))


def upsert_into_store(spark: SparkSession, store_path: str, batch: DataFrame, staging_root: str | None = None,
                      keys: Sequence[str] = STORE_KEYS, seq: str | None = "seq",
                      ledger: Mapping[str, object] | None = None) -> dict[str, int]:
    """Persisted upsert into the day-partitioned store; only touched days are written, once.

    1. one aggregate over the (persisted) batch gives its days and its skipped rows; the days
       prune the store scan to their partitions;
    2. the upserted days are written to a folder of their own while an ``Observation`` gathers the
       counters in the same pass;
    3. a commit makes the folder part of the table, and the counters part of its ledger.

    ``ledger`` adds to the ledger's row; with ``writer`` and ``batch`` a batch that the writer has
    applied before is left alone and its first counters are returned. A rerun after a failure is
    idempotent in any case (upsert twice = once). (``staging_root`` is not used any more.)
    """
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        present = _all_keys_present(keys)
        skipped = batch.where(~present).count()
        days = [r[0] for r in batch.where(present).select(F.to_date(F.col(keys[0])).alias("d")).distinct()
                .limit(MAX_DAYS + 1).collect()]
        if len(days) > MAX_DAYS:
            raise ValueError(f"a batch may touch {MAX_DAYS} days at most")

        def merged(base: snapshots.Snapshot) -> tuple[DataFrame, Observation]:
            current = files.read_store(spark, store_path, days=days, snapshot=base)
            j, set_cols = _upsert_join(current, batch, keys, seq)
            observation = Observation("upsert")
            counted = j.observe(observation, *[v.alias(k) for k, v in _counter_exprs(set_cols).items()])
            cols = [F.col(c) if c in keys or c not in set_cols
                    else F.when(F.col("_in_b"), F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) for c in current.columns]
            return counted.select(*cols), observation

        entry = {**(ledger or {}), "skipped": skipped, **dict.fromkeys((*COUNTERS, "saved"), 0)}
        if not days and ledger is None:
            told = entry
        else:
            told = _commit_days(spark, store_path, days, merged, entry)
    finally:
        batch.unpersist()
    return {k: told[k] for k in (*COUNTERS, "skipped", "saved")}
