"""Multiclass training, scoring, classify-else-predict, incremental training and the
retrain job, on ``pyspark.ml``.

A fitted model is ONE ``PipelineModel``: population-std scaler (SQLTransformer) →
VectorAssembler → classifier → IndexToString. Saving it under ``<root>/v=<n>``
and loading the newest complete version keeps scaler, classes and classifier in
one artifact, so they can never be mixed across versions. The scaler's statistics are kept
beside the stages and come back with the model (``scaler_of``).

``algorithm`` picks ``random_forest`` (default), ``softmax_boost`` (multiclass boosting,
``boosting``; continues from a fitted model and gives a loss per round), ``gbt_ovr``
(OneVsRest over GBT) or ``mlp`` (supports warm start). A boosted model is an artifact of its
own kind, a table of tree nodes, with the same scaler statistics, classes and version marker.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassifier, MultilayerPerceptronClassificationModel,
                                       MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..config import (FEATURES, LABEL, SEED, SOURCE_API, SOURCE_EXCEPTION, SOURCE_MISSING, SOURCE_PRED_ERROR,
                      SOURCE_PREDICTED, TEST_FRACTION, UNKNOWN)
from ..session import ROWS_PER_TASK, materialise, spread
from . import boosting, encoding, metrics, sampling, store
from .boosting import BoostedModel

# ---------------------------------------------------------------------------
# Hyper-parameters
# ---------------------------------------------------------------------------

# The reference's default training configuration.
DEFAULT_PARAMS: dict[str, object] = {
    "n_estimators": 200, "learning_rate": 0.1, "max_depth": 8, "subsample": 0.8, "colsample_bytree": 0.8,
    "gamma": 0, "min_child_weight": 1, "reg_lambda": 1, "reg_alpha": 0, "booster": "gbtree",
    "sampling_method": "uniform", "tree_method": "auto", "random_state": 42,
}
# The other reference configurations (forecaster, full refit).
FORECAST_PARAMS = {**DEFAULT_PARAMS, "n_estimators": 250, "learning_rate": 0.07, "max_depth": 7,
                   "subsample": 0.75, "colsample_bytree": 0.75, "gamma": 0.1}
FULL_REFIT_PARAMS = {**DEFAULT_PARAMS, "n_estimators": 150, "max_depth": 7}

ALIASES = {"lambda": "reg_lambda", "alpha": "reg_alpha"}
# Parameters each algorithm makes use of; no Spark estimator has the booster options and penalties.
EFFECTIVE = {
    "random_forest": ("n_estimators", "max_depth", "subsample", "colsample_bytree", "gamma", "min_child_weight", "random_state"),
    "gbt_ovr": ("n_estimators", "learning_rate", "max_depth", "subsample", "colsample_bytree", "gamma", "min_child_weight",
                "random_state"),
    "softmax_boost": ("n_estimators", "learning_rate", "max_depth", "subsample", "colsample_bytree", "gamma",
                      "min_child_weight", "reg_lambda", "reg_alpha", "random_state"),
    "mlp": ("n_estimators", "learning_rate", "random_state"),
}
MAX_TREE_DEPTH = 30  # Spark's own limit
_ENUMS = {"booster": {"gbtree", "gblinear", "dart"}, "sampling_method": {"uniform", "gradient_based"},
          "tree_method": {"auto", "exact", "approx", "hist"}}


def resolve_params(overrides: Mapping[str, object] | None, defaults: Mapping[str, object] = DEFAULT_PARAMS,
                   algorithm: str = "random_forest") -> tuple[dict[str, object], list[str]]:
    """Overlay ``overrides`` on ``defaults``. ``lambda``/``alpha`` are aliases.

    Returns the parameters that take effect with ``algorithm``, and the names given that do
    not: NULL or unknown ones, and those the estimator has no use for. Out-of-range values
    raise ValueError, whether they would take effect or not.
    """
    if algorithm not in EFFECTIVE:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    useful = EFFECTIVE[algorithm]
    params = {k: v for k, v in defaults.items() if k in useful}
    ignored = []
    for k, v in (overrides or {}).items():
        name = ALIASES.get(k, k)
        if name not in defaults or v is None:
            ignored.append(k)
            continue
        _validate(name, v)
        if name in useful:
            params[name] = v
        else:
            ignored.append(k)
    return params, ignored


def _validate(name: str, v) -> None:
    bad = False
    if name in ("learning_rate",):
        bad = not (float(v) > 0)
    elif name in ("subsample", "colsample_bytree"):
        bad = not (0 < float(v) <= 1)
    elif name in ("gamma", "reg_lambda", "reg_alpha"):
        bad = float(v) < 0
    elif name == "min_child_weight":  # rows, not weights, in Spark: whole numbers only
        bad = float(v) < 0 or float(v) != int(float(v))
    elif name == "max_depth":  # 0 means "no limit", which Spark's trees do not have
        bad = not (1 <= int(v) <= MAX_TREE_DEPTH)
    elif name == "n_estimators":
        bad = int(v) <= 0
    elif name in _ENUMS:
        bad = v not in _ENUMS[name]
    if bad:
        raise ValueError(f"invalid value for {name}: {v!r}")


def spark_estimator(params: Mapping[str, object], algorithm: str, n_features: int, n_classes: int,
                    hidden: Sequence[int] = (16,), features_col: str = "features", label_col: str = "label_idx"):
    """Map resolved parameters onto a ``pyspark.ml`` estimator."""
    common = dict(featuresCol=features_col, labelCol=label_col, seed=int(params["random_state"]))
    if algorithm == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes],
                                              maxIter=int(params["n_estimators"]),
                                              stepSize=float(params["learning_rate"]), **common)
    tree = dict(maxDepth=int(params["max_depth"]), subsamplingRate=float(params["subsample"]),
                featureSubsetStrategy=str(float(params["colsample_bytree"])), minInfoGain=float(params["gamma"]),
                # a leaf has a row at least: 0 and 1 are the same
                minInstancesPerNode=max(1, int(float(params["min_child_weight"]))), **common)
    if algorithm == "random_forest":
        return RandomForestClassifier(numTrees=int(params["n_estimators"]), **tree)
    if algorithm == "gbt_ovr":
        gbt = GBTClassifier(maxIter=int(params["n_estimators"]), stepSize=float(params["learning_rate"]), **tree)
        return OneVsRest(classifier=gbt, featuresCol=features_col, labelCol=label_col)
    raise ValueError(f"unknown algorithm {algorithm!r}")


# ---------------------------------------------------------------------------
# Model assembly, scoring
# ---------------------------------------------------------------------------

SCALED = "_scaled"


def assemble_model(stats: dict[str, tuple[float, float]], fitted_classifier, labels: Sequence[str],
                   features: Sequence[str]) -> PipelineModel:
    """Scoring pipeline: scale → assemble → classify → decode (``predicted_label``)."""
    scaler = encoding.scaler_transformer(stats, SCALED)
    assembler = VectorAssembler(inputCols=[f"{c}{SCALED}" for c in features], outputCol="features",
                                handleInvalid="keep")
    decoder = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=list(labels))
    model = PipelineModel(stages=[scaler, assembler, fitted_classifier, decoder])
    model.scaler_stats = dict(stats)
    return model


def scaler_of(model: PipelineModel) -> dict[str, tuple[float, float]]:
    """(mean, standard deviation) per feature, as fitted with the model."""
    return dict(model.scaler_stats)


def model_algorithm(model: PipelineModel | BoostedModel) -> str:
    if isinstance(model, BoostedModel):
        return "softmax_boost"
    classifier = model.stages[2]
    if isinstance(classifier, MultilayerPerceptronClassificationModel):
        return "mlp"
    return "gbt_ovr" if isinstance(classifier, OneVsRestModel) else "random_forest"


def model_labels(model: PipelineModel | BoostedModel) -> list[str]:
    if isinstance(model, BoostedModel):
        return list(model.labels)
    return list(model.stages[-1].getLabels())


def model_features(model: PipelineModel | BoostedModel) -> list[str]:
    if isinstance(model, BoostedModel):
        return list(model.features)
    return [c[: -len(SCALED)] for c in model.stages[1].getInputCols()]


def _complete(features: Sequence[str]):
    cond = F.lit(True)
    for c in features:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return cond


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Predicted class per row. Rows missing a feature keep their place in the output with
    ``status='missing_features'`` and a NULL prediction (works on streaming frames too)."""
    feats = model_features(model)
    keep = list(keep) if keep is not None else [c for c in df.columns]
    out = model.transform(df.withColumn("_ok", _complete(feats)))
    return out.select(*keep,
                      F.when(F.col("_ok"), F.col("predicted_label")).alias("prediction"),
                      F.when(F.col("_ok"), F.lit("ok")).otherwise(F.lit("missing_features")).alias("status"))


def classify_or_predict(df: DataFrame, model: PipelineModel, label: str = LABEL) -> DataFrame:
    """Keep the description class; rows classed ``unknown`` (or NULL) with all features present
    get the model's prediction (source ``predicted (fallback)``). An unknown row that lacks a
    feature, or whose features are not finite so that no prediction is possible, stays
    ``unknown`` with the tag that says so. One pass, every row comes out once."""
    feats = model_features(model)
    finite = F.lit(True)
    for c in feats:
        finite = finite & (F.abs(F.col(c)) != F.lit(float("inf")))
    known = F.coalesce(F.col(label), F.lit(UNKNOWN))
    scored = model.transform(df.withColumn("_ok", _complete(feats)).withColumn("_finite", finite))
    need = known == F.lit(UNKNOWN)
    usable = F.col("_ok") & F.col("_finite") & F.col("predicted_label").isNotNull()
    source = (F.when(~need, F.lit(SOURCE_API)).when(~F.col("_ok"), F.lit(SOURCE_MISSING))
              .when(usable, F.lit(SOURCE_PREDICTED)).otherwise(F.lit(SOURCE_PRED_ERROR)))
    return scored.select(*[F.when(need & usable, F.col("predicted_label")).otherwise(known).alias(label) if c == label
                           else F.col(c) for c in df.columns], source.alias("condition_source"))


def classify_or_predict_latest(df: DataFrame, root: str, features: Sequence[str] = FEATURES, label: str = LABEL) -> DataFrame:
    """The same with the active model under ``root``. If none can be loaded, the rows that
    would need it stay ``unknown`` with the exception tag, and all others come out as ever."""
    try:
        model = load_latest(root)
    except Exception:  # the tag says that it failed
        known = F.coalesce(F.col(label), F.lit(UNKNOWN))
        source = (F.when(known != F.lit(UNKNOWN), F.lit(SOURCE_API)).when(~_complete(features), F.lit(SOURCE_MISSING))
                  .otherwise(F.lit(SOURCE_EXCEPTION)))
        return df.select(*[known.alias(label) if c == label else F.col(c) for c in df.columns], source.alias("condition_source"))
    return classify_or_predict(df, model, label)


# ---------------------------------------------------------------------------
# Training
# ---------------------------------------------------------------------------

def prepare(df: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL,
            classify_label: bool = True) -> DataFrame:
    """Preprocess: re-classify the label text (idempotent), drop NULL features and unknown.

    The class is never NULL (NULL text → ``unknown``), so one predicate on it suffices;
    referencing it once keeps pushed-down filters small.

    ``classify_label=False`` skips the (idempotent) re-classification for a label that
    the same plan has just classified: classifying twice inside one plan makes
    Catalyst inline one CASE into the other in every pushed-down predicate.
    """
    from ..functions.conditions import classify_description
    out = df.withColumn(label, classify_description(label)) if classify_label else df
    return out.dropna(subset=list(features)).where(F.col(label) != F.lit(UNKNOWN))


def train_classifier(train: DataFrame, labels: Sequence[str], stats: dict[str, tuple[float, float]],
                     params: Mapping[str, object], algorithm: str = "random_forest",
                     features: Sequence[str] = FEATURES, label: str = LABEL,
                     initial_weights=None) -> PipelineModel | BoostedModel:
    if algorithm == "softmax_boost":  # trees split the same way whether features are scaled or not
        return boosting.fit(train, labels, stats, params, features, label)
    rows = _dealt(train, features, label, params, algorithm)
    enc = encoding.encode_labels(rows, labels, [label], ["label_idx"], "skip")
    enc = enc.withColumn("label_idx", F.col("label_idx").cast("double"))
    scaled = encoding.scaler_transformer(stats, SCALED).transform(enc)
    vec = VectorAssembler(inputCols=[f"{c}{SCALED}" for c in features], outputCol="features").transform(scaled)
    est = spark_estimator(params, algorithm, len(features), len(labels))
    if initial_weights is not None and algorithm == "mlp":
        est = est.setInitialWeights(initial_weights)
    return assemble_model(stats, _fit_persisted(est, vec), labels, features)


TASK_BYTES = 512 << 20


def _dealt(rows: DataFrame, features: Sequence[str], label: str, params: Mapping[str, object], algorithm: str) -> DataFrame:
    """Features and label of ``rows``, dealt so that what the estimator keeps of a task's rows has at most
    about TASK_BYTES. A forest keeps a count per tree beside each row's bins. The rows of a
    task are sorted: a fit with one seed sees them in one order."""
    trees = int(params["n_estimators"]) if algorithm == "random_forest" else 1
    row_bytes = 4 * trees + 12 * len(features) + 100
    used = rows.select(*dict.fromkeys([*features, label]))
    return spread(used, min(ROWS_PER_TASK * 4, TASK_BYTES // row_bytes)).sortWithinPartitions(*used.columns)


def _fit_persisted(est, vec: DataFrame):
    """Fit on a persisted (memory, spilling to disk) copy of the training vectors: the
    estimators pass over their input several times (metadata, splits, iterations)."""
    data = vec.select("features", "label_idx").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return est.fit(data)
    finally:
        data.unpersist()


def retrain(spark: SparkSession, df: DataFrame, key: str, overrides: Mapping[str, object] | None = None,
            algorithm: str = "random_forest", features: Sequence[str] = FEATURES, label: str = LABEL,
            balance: bool = False, defaults: Mapping[str, object] = DEFAULT_PARAMS,
            test_fraction: float = TEST_FRACTION, seed: int = SEED, classify_label: bool = True,
            split: str = "random", time_col: str = "datetime"):
    """Prepare → split → fit scaler on train → (undersample) → fit → evaluate on test.

    ``split="random"`` is the exact stratified hash split (as the reference);
    ``split="time"`` holds out the latest rows instead. Returns (model, report
    DataFrame, summary): the summary holds the evaluated metrics, the parameters that took
    effect, the ignored names and the rows of each split."""
    params, ignored = resolve_params(overrides, defaults, algorithm)
    # written once: the classes, the split's quotas and the split read the prepared rows
    clean = spread(materialise(prepare(df, features, label, classify_label), "training-rows"))
    labels = encoding.fit_labels(clean, [label])
    if not labels:
        raise ValueError("no usable training rows")
    if split == "time":
        parts = sampling.time_split(clean, time_col, key, test_fraction)
    elif split == "random":
        parts = sampling.stratified_split(clean, label, key, test_fraction, seed)
    else:
        raise ValueError(f"unknown split {split!r}")
    parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train = parts.where(F.col("split") == "train")
        test = parts.where(F.col("split") == "test")
        stats = encoding.fit_scaler(train, features)
        rows = {r["split"]: r["n"] for r in parts.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
        fitted = sampling.undersample(train, label, key, seed) if balance else train
        model = train_classifier(fitted, labels, stats, params, algorithm, features, label)
        # evaluated here, while the split is at hand; scored once, the report and the loss read the predictions
        scored = materialise(_scored(model, test, label), "scored-test")
        report = _on_driver(spark, metrics.classification_report(scored, label, "prediction"))
        loss = metrics.log_loss(scored.where("_ok"), label, "_p", model_labels(model)).first()
    finally:
        parts.unpersist()
    macro = report.where(F.col("label") == "macro avg").first()
    summary = {"accuracy": macro["accuracy"], "precision_macro": macro["precision"], "recall_macro": macro["recall"],
               "f1_score_macro": macro["f1"], "log_loss": loss["log_loss"], "n_train": rows.get("train", 0),
               "n_test": rows.get("test", 0), "params_used": params, "ignored_params": ignored}
    return model, report, summary


def _on_driver(spark: SparkSession, report: DataFrame) -> DataFrame:
    """A report (a row per class and two averages) evaluated once."""
    return spark.createDataFrame(report.collect(), report.schema)


def evaluate(model: PipelineModel, test: DataFrame, label: str = LABEL) -> DataFrame:
    pred = score(model, test, keep=[label])
    return metrics.classification_report(pred, label, "prediction")


def _scored(model: PipelineModel | BoostedModel, test: DataFrame, label: str = LABEL) -> DataFrame:
    """Label, prediction as ``score`` gives it, probabilities ``_p``, and whether all features are there (``_ok``)."""
    out = class_probabilities(model, test.withColumn("_ok", _complete(model_features(model))))
    return out.select(label, F.when(F.col("_ok"), F.col("predicted_label")).alias("prediction"), "_ok",
                      F.col("probability").alias("_p"))


def evaluate_log_loss(model: PipelineModel, test: DataFrame, label: str = LABEL) -> DataFrame:
    """One row (log_loss, n)."""
    scored = class_probabilities(model, test.where(_complete(model_features(model))))
    return metrics.log_loss(scored.select(label, F.col("probability").alias("_p")), label, "_p", model_labels(model))


def class_probabilities(model: PipelineModel | BoostedModel, df: DataFrame) -> DataFrame:
    """``df`` scored, with ``probability`` as an array in the order of the labels. One-vs-rest
    margins become the binary models' own probabilities, 1 / (1 + exp(-2 margin)), normalised to
    sum up to one."""
    scored = model.transform(df)
    if isinstance(model, BoostedModel):
        return scored
    if model_algorithm(model) != "gbt_ovr":
        return scored.withColumn("probability", vector_to_array("probability"))
    each = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    scored = scored.withColumn("probability", each)
    return scored.withColumn("probability", F.transform(
        "probability", lambda v: v / F.aggregate("probability", F.lit(0.0), lambda a, b: a + b)))


REPORT_FIELDS = T.StructType([T.StructField("label", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("precision", "recall", "f1")],
                              T.StructField("support", T.LongType())])
JOB_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("algorithm", T.StringType()), T.StructField("version", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("accuracy", "precision_macro", "recall_macro", "f1_score_macro", "log_loss")],
    T.StructField("n_train", T.LongType()), T.StructField("n_test", T.LongType()),
    T.StructField("params_used", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ignored_params", T.ArrayType(T.StringType())),
    T.StructField("classification_report", T.ArrayType(REPORT_FIELDS)),
    T.StructField("start_time", T.TimestampNTZType()), T.StructField("end_time", T.TimestampNTZType())])


def retrain_job(spark: SparkSession, df: DataFrame, key: str, root: str, **options) -> tuple[DataFrame, DataFrame | None]:
    """The retrain job: train, evaluate, save the model as the next version under ``root`` (the
    newest complete version is the active one), report the outcome and store it (``job_results``).

    Returns (one-row result with the report per class in it, report or None). A job that fails
    leaves the active version as it was and gives a ``failed`` row with the message instead of raising.
    """
    start = _now()
    algorithm = options.get("algorithm", "random_forest")
    try:
        model, report, summary = retrain(spark, df, key, **options)
        path = save_model(model, root)
        row = {"status": "completed", "message": f"trained on {summary['n_train']} rows, active as {path.rsplit('/', 1)[-1]}",
               "version": path.rsplit("/", 1)[-1], **summary,
               "classification_report": [tuple(r) for r in report.select(*REPORT_FIELDS.names).collect()],
               "params_used": {k: str(v) for k, v in sorted(summary["params_used"].items())}}
    except Exception as e:  # the job's outcome is its result
        report, row = None, {"status": "failed", "message": f"{type(e).__name__}: {str(e)[:500]}", "params_used": {},
                             "ignored_params": []}
    row |= {"algorithm": algorithm, "start_time": start, "end_time": _now()}
    result = spark.createDataFrame([tuple(row.get(f.name) for f in JOB_SCHEMA.fields)], JOB_SCHEMA)
    # a folder of its own, so that jobs that run at the same time do not meet
    result.coalesce(1).write.parquet(f"{root.rstrip('/')}/{JOBS}/job={uuid.uuid4().hex}")
    return result, report


def job_results(spark: SparkSession, root: str) -> DataFrame:
    """Stored results of the retrain jobs on ``root``, a row each with the report per class; none yet: empty."""
    path = f"{root.rstrip('/')}/{JOBS}"
    if not _fs_exists(spark, path):
        return spark.createDataFrame([], JOB_SCHEMA)
    return spark.read.schema(JOB_SCHEMA).parquet(path).select(*JOB_SCHEMA.names)


def job_report(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The stored report of the job that made ``version`` (None: of every job), a row per class and average."""
    rows = job_results(spark, root).where(F.col("version").isNotNull() if version is None else F.col("version") == version)
    return rows.select("version", "accuracy", F.inline("classification_report"))


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def train_incremental(prev: PipelineModel, day_rows: DataFrame, params: Mapping[str, object] | None = None,
                      label: str = LABEL, classify_label: bool = True, history: DataFrame | None = None) -> PipelineModel:
    """Continue training on one day's rows, reusing the saved scaler and classes.

    MLP models warm-start from the previous weights; boosted models add ``n_estimators`` rounds
    behind the ones they have, which stay as they are. Other tree models in Spark cannot
    continue from a fitted model, so they need ``history``, the rows accumulated so far (which include
    the day): the same algorithm is fitted anew on it with the saved scaler and classes.
    """
    algorithm = model_algorithm(prev)
    feats, labels, stats = model_features(prev), model_labels(prev), scaler_of(prev)
    resolved, _ = resolve_params(params or {}, DEFAULT_PARAMS, algorithm)
    if algorithm == "mlp":
        clf = prev.stages[2]
        rows = prepare(day_rows, feats, label, classify_label)  # unseen classes are skipped by the indexer
        return _fit_mlp(rows, labels, stats, resolved, feats, label, clf.getLayers()[1:-1], clf.weights)
    if algorithm == "softmax_boost":
        return boosting.fit(prepare(day_rows, feats, label, classify_label), labels, stats, resolved, feats, label, start=prev)
    if history is None:
        raise ValueError(f"a {algorithm} model cannot continue from its last state: pass the accumulated history")
    return train_classifier(prepare(history, feats, label, classify_label), labels, stats, resolved, algorithm, feats, label)


UPDATE_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("message", T.StringType()), T.StructField("day", T.DateType()),
    T.StructField("n_rows", T.LongType()), T.StructField("from_version", T.StringType()), T.StructField("version", T.StringType())])


def update_from_store(spark: SparkSession, store_path: str, day: _dt.date, root: str,
                      params: Mapping[str, object] | None = None, label: str = LABEL) -> DataFrame:
    """The day's model update: the store's rows of ``day`` (one partition), the active model under ``root``
    continued on them, saved and active as the next version. Trees that cannot continue are
    fitted anew on the whole store up to the day. One row tells the outcome: ``completed``,
    ``no data`` (the day has no usable rows), or ``failed`` with the message; then the active version stays."""
    row = {"day": day}
    try:
        model, row["from_version"] = load_active(root)
        rows = store.day_of_store(spark, store_path, day)
        row["n_rows"] = prepare(rows, model_features(model), label).count()
        if not row["n_rows"]:
            row |= {"status": "no data", "message": f"no usable rows of {day}"}
        else:
            again = model_algorithm(model) in ("random_forest", "gbt_ovr")
            history = store.until(spark, store_path, day) if again else None
            path = save_model(train_incremental(model, rows, params, label, history=history), root)
            row |= {"status": "completed", "message": None, "version": path.rsplit("/", 1)[-1]}
    except Exception as e:  # the job's outcome is its result
        row |= {"status": "failed", "message": f"{type(e).__name__}: {str(e)[:500]}"}
    return spark.createDataFrame([tuple(row.get(f.name) for f in UPDATE_SCHEMA.fields)], UPDATE_SCHEMA)


def _fit_mlp(rows, labels, stats, params, feats, label, hidden, weights):
    dealt = _dealt(rows, feats, label, params, "mlp")
    enc = encoding.encode_labels(dealt, labels, [label], ["label_idx"], "skip")
    enc = enc.withColumn("label_idx", F.col("label_idx").cast("double"))
    scaled = encoding.scaler_transformer(stats, SCALED).transform(enc)
    vec = VectorAssembler(inputCols=[f"{c}{SCALED}" for c in feats], outputCol="features").transform(scaled)
    est = spark_estimator(params, "mlp", len(feats), len(labels), hidden=hidden).setInitialWeights(weights)
    return assemble_model(stats, _fit_persisted(est, vec), labels, feats)


# ---------------------------------------------------------------------------
# Versioned artifacts
# ---------------------------------------------------------------------------

COMPLETE = "_COMPLETE"
JOBS = "jobs"  # results of retrain jobs, beside the versions
BOOSTED = "boosted.json"  # marks a table of tree nodes instead of a pipeline


def save_model(model: PipelineModel, root: str) -> str:
    """Save as the next version ``<root>/v=<n>``.

    The number is claimed by creating a file that must not exist yet, so two writers never
    take the same one. The marker is written last: a version without it is never loaded.
    """
    spark = SparkSession.getActiveSession()
    root = root.rstrip("/")
    n = max(_versions(spark, root), default=0) + 1
    while not _create(spark, f"{root}/_claims/{n}", uuid.uuid4().hex):
        n += 1
    path = f"{root}/v={n}"
    if isinstance(model, BoostedModel):
        _create(spark, f"{path}/{BOOSTED}", boosting.write(model, path, spark))
    else:
        model.write().overwrite().save(path)
    stats = json.dumps({k: list(v) for k, v in scaler_of(model).items()})
    _create(spark, f"{path}/scaler.json", stats)
    _create(spark, f"{path}/{COMPLETE}", "")
    return path


def load_latest(root: str) -> PipelineModel | BoostedModel:
    """The newest version whose marker is there."""
    return load_active(root)[0]


def load_active(root: str) -> tuple[PipelineModel | BoostedModel, str]:
    """The newest version whose marker is there, and its name."""
    spark = SparkSession.getActiveSession()
    for v in sorted(_versions(spark, root), reverse=True):
        path = f"{root.rstrip('/')}/v={v}"
        if _fs_exists(spark, f"{path}/{COMPLETE}"):
            text = spark.read.text(f"{path}/scaler.json", wholetext=True).first()["value"]
            stats = {k: tuple(v) for k, v in json.loads(text).items()}
            if _fs_exists(spark, f"{path}/{BOOSTED}"):
                return boosting.read(path, spark.read.text(f"{path}/{BOOSTED}", wholetext=True).first()["value"], stats, spark), f"v={v}"
            model = PipelineModel.load(path)
            model.scaler_stats = stats
            return model, f"v={v}"
    raise FileNotFoundError(f"no complete model version under {root}")


def _create(spark, path: str, text: str) -> bool:
    """Create a small file that must not exist yet; False if it does."""
    p, fs = _fs(spark, path)
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):  # another writer was first
            return False
        raise e
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return True


def _fs(spark, path):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _fs_exists(spark, path) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def _versions(spark, root) -> list[int]:
    p, fs = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and name[2:].isdigit():
            out.append(int(name[2:]))
    return out
