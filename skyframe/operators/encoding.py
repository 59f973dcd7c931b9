"""Label encoding (sorted vocabulary) and population-std feature scaling.

Fitting collects only the model: the label vocabulary (one entry per class) and
one mean/std pair per feature, computed by distributed aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexerModel
from pyspark.sql import DataFrame, functions as F

from .metrics import collect_labels, label_domain


def fit_labels(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Sorted distinct labels across ``cols`` (codes = position in this list)."""
    return collect_labels(label_domain(df, cols))


def label_indexer(labels: Sequence[str], cols: Sequence[str], out_cols: Sequence[str],
                  handle_invalid: str = "skip") -> StringIndexerModel:
    """One shared vocabulary applied to several columns. ``skip`` drops rows whose label
    is unseen (or NULL); ``keep`` maps them to ``len(labels)``; ``error`` fails."""
    model = StringIndexerModel.from_arrays_of_labels([list(labels)] * len(cols), inputCols=list(cols),
                                                     outputCols=list(out_cols), handleInvalid=handle_invalid)
    return model


def encode_labels(df: DataFrame, labels: Sequence[str], cols: Sequence[str], out_cols: Sequence[str],
                  handle_invalid: str = "skip") -> DataFrame:
    """Integer codes; with ``keep`` an unseen label gets -1."""
    out = label_indexer(labels, cols, out_cols, handle_invalid).transform(df)
    n = len(labels)
    for o in out_cols:
        code = F.col(o).cast("int")
        out = out.withColumn(o, F.when(code == F.lit(n), F.lit(-1)).otherwise(code) if handle_invalid == "keep" else code)
    return out


def decode_labels(df: DataFrame, labels: Sequence[str], col: str, out_col: str) -> DataFrame:
    """Code → label via ``IndexToString``."""
    return IndexToString(inputCol=col, outputCol=out_col, labels=list(labels)).transform(
        df.withColumn(col, F.col(col).cast("double"))).withColumn(col, F.col(col).cast("int"))


def scaler_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table (feature, mean, std_pop, n): one aggregate pass over ``df``."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m__{c}"), F.stddev_pop(c).alias(f"s__{c}")]
    wide = df.agg(*aggs, F.count(F.lit(1)).alias("n"))
    stack = ", ".join(f"'{c}', `m__{c}`, `s__{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, mean, std_pop)", "n")


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Per feature (mean, population std); zero or undefined std → 1."""
    row = scaler_stats(df, cols).collect()
    out = {}
    for r in row:
        std = r["std_pop"]
        out[r["feature"]] = (float(r["mean"]) if r["mean"] is not None else 0.0,
                             float(std) if std not in (None, 0.0) else 1.0)
    return out


def standard_scale(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """(x − mean) / std for each fitted feature (in place, or into ``<col><suffix>``)."""
    scaled = {f"{c}{suffix}": ((F.col(c) - F.lit(mean)) / F.lit(std)).alias(f"{c}{suffix}") for c, (mean, std) in stats.items()}
    return df.select(*[scaled.pop(c, F.col(c)) for c in df.columns], *scaled.values())


def scaler_transformer(stats: dict[str, tuple[float, float]], suffix: str = "_scaled") -> SQLTransformer:
    """The fitted scaler as a persistable pipeline stage."""
    exprs = ", ".join(f"(`{c}` - ({mean!r})) / ({std!r}) AS `{c}{suffix}`" for c, (mean, std) in stats.items())
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")
