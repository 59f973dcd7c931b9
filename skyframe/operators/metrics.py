"""Aggregations: class counts/shares, label domain, coverage, classification report,
confusion matrices.

Everything reduces the data with a partial (map-side) aggregate first; the
per-class arithmetic then runs on a table with one row per (truth, prediction)
pair, whose size is bounded by the number of classes squared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DATETIME, LABEL


MAX_CLASSES = 10_000


def label_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def label_shares(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Counts and normalised shares; the global sum runs over the (tiny) count table."""
    counts = label_counts(df, label)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def label_domain(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-null values across several label columns (one column ``label``)."""
    arr = F.array(*[F.col(c).cast("string") for c in cols])
    return (df.select(F.explode(arr).alias("label")).where(F.col("label").isNotNull()).distinct())


def coverage(df: DataFrame, place: str, time_col: str = DATETIME) -> DataFrame:
    """First/last timestamp and row count per place plus an overall row. ``is_total`` tells the
    overall row (place NULL) from the rows of a NULL place."""
    return df.rollup(place).agg((F.grouping(place) == 1).alias("is_total"), F.min(time_col).alias("first_datetime"),
                                F.max(time_col).alias("last_datetime"),
                                F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------------------
# Classification metrics
# ---------------------------------------------------------------------------

def confusion_counts(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(y, yhat, n) over the observed pairs; rows with a NULL on either side are ignored."""
    return (df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
              .groupBy(F.col(y).cast("string").alias("y"), F.col(yhat).cast("string").alias("yhat"))
              .agg(F.count(F.lit(1)).alias("n")))


def _safe_div(num, den):
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))


def classification_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Per-class precision, recall, F1 and support, plus ``macro avg`` and ``weighted avg``
    rows; every row carries the overall ``accuracy``. Classes = labels in y ∪ yhat;
    an undefined ratio is 0.

    One linear plan, so the input is scanned once: confusion counts (partial
    aggregate) → each count row exploded into its per-class contributions → one
    aggregate per class → global sums by a window over the per-class rows → a
    ``rollup`` adds the total level, which is emitted as the two average rows.
    """
    cc = confusion_counts(df, y, yhat)
    parts = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("yhat").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"),
                 F.lit(0).cast("long").alias("tp")))
    per = (cc.select(F.explode(parts).alias("c"))
             .groupBy(F.col("c.label").alias("label"))
             .agg(F.sum("c.t").alias("support"), F.sum("c.p").alias("predicted"), F.sum("c.tp").alias("tp")))
    everyone = Window.partitionBy()
    per = per.select(
        "label", "support",
        _safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
        _safe_div(F.col("tp"), F.col("support")).alias("recall"),
        _safe_div(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        _safe_div(F.sum("tp").over(everyone), F.sum("support").over(everyone)).alias("accuracy"))
    total_s = F.sum("support")
    lvl = per.rollup("label").agg(
        F.grouping("label").alias("g"), total_s.alias("support"), F.first("accuracy").alias("accuracy"),
        *[F.avg(m).alias(f"{m}_m") for m in ("precision", "recall", "f1")],
        *[_safe_div(F.sum(F.col(m) * F.col("support")), total_s).alias(f"{m}_w") for m in ("precision", "recall", "f1")])

    def row(label, suffix):
        return F.struct(label.alias("label"), *[F.col(f"{m}_{suffix}").alias(m) for m in ("precision", "recall", "f1")],
                        F.col("support").alias("support"), F.col("accuracy").alias("accuracy"))

    rows = F.when(F.col("g") == 0, F.array(row(F.col("label"), "m"))).otherwise(
        F.array(row(F.lit("macro avg"), "m"), row(F.lit("weighted avg"), "w")))
    return lvl.select(F.explode(rows).alias("r")).select("r.*")


def class_list(df: DataFrame, y: str, yhat: str) -> list[str]:
    """Sorted distinct labels of y ∪ yhat: the class vocabulary."""
    return collect_labels(label_domain(df, [y, yhat]))


def collect_labels(domain: DataFrame) -> list[str]:
    """A label domain on the driver; a column with more than ``MAX_CLASSES`` values is none."""
    found = [r["label"] for r in domain.limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} distinct labels: not a class column")
    return sorted(found)


def confusion_matrix(df: DataFrame, y: str, yhat: str, classes: Sequence[str] | None = None,
                     normalize: bool = False) -> DataFrame:
    """Long-form confusion matrix over ``classes`` (every pair present, zeros included).

    ``normalize=True`` divides each true-class row by its total; empty rows stay 0.
    The class grid is generated from the class list (no join of two tables).
    """
    cc = confusion_counts(df, y, yhat)
    if classes is None:
        # The counts table (≤ classes² rows) is materialised once in the shared
        # checkpoint folder; the vocabulary and the matrix both read it, so the
        # input is scanned a single time.
        from ..session import checkpoint_root
        checkpoint_root(df.sparkSession)
        cc = cc.checkpoint(eager=True)
        cls = class_list(cc, "y", "yhat")
    else:
        cls = list(classes)
    grid = (df.sparkSession.createDataFrame([(c,) for c in cls], "y string")
            .select("y", F.explode(F.array(*[F.lit(c) for c in cls])).alias("yhat")))
    full = grid.join(cc, ["y", "yhat"], "left").select("y", "yhat", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    if not normalize:
        return full
    row_total = F.sum("n").over(Window.partitionBy("y"))
    return full.select("y", "yhat", _safe_div(F.col("n").cast("double"), row_total).alias("rate"))


def log_loss(df: DataFrame, y: str, probabilities: str, labels: Sequence[str]) -> DataFrame:
    """One row: mean of -ln p(true class) over rows whose label is known, and their number.

    ``probabilities`` is an array in the order of ``labels``; p is clipped away from 0 and 1
    by the spacing of doubles at 1, as is usual.
    """
    code = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col(y).cast("string")).cast("int")
    eps = 2.0 ** -52
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.get(F.col(probabilities), code - 1)))
    return (df.where(code > 0).agg(F.avg(-F.log(p)).alias("log_loss"), F.count(F.lit(1)).alias("n")))
