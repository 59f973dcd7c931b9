from pyspark.sql import functions as F

from skyframe.config import FEATURES, LABEL
from skyframe.operators import encoding, metrics, sampling
from skyframe.plans import catalog

SF = "/root/testdata/sf0.001"


def test_split_exact_disjoint_complete(spark):
    tt = catalog.training_table(spark, SF)
    sp = sampling.stratified_split(tt, LABEL, "obs_id")
    assert sp.count() == tt.count()
    assert sp.select("obs_id").distinct().count() == tt.count()
    per = {r[LABEL]: (r["n"], r["t"]) for r in sp.groupBy(LABEL).agg(
        F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
    for n, t in per.values():
        assert t == int(0.2 * n + 0.5)


def test_split_is_reproducible(spark):
    tt = catalog.training_table(spark, SF)
    a = sampling.stratified_split(tt, LABEL, "obs_id").where("split = 'test'").select("obs_id")
    b = sampling.stratified_split(tt, LABEL, "obs_id").where("split = 'test'").select("obs_id")
    assert a.exceptAll(b).count() == 0


def test_undersample_equal_sizes(spark):
    tt = catalog.training_table(spark, SF)
    us = sampling.undersample(tt, LABEL, "obs_id")
    sizes = [r["count"] for r in us.groupBy(LABEL).count().collect()]
    minority = min(r["count"] for r in tt.groupBy(LABEL).count().collect())
    assert set(sizes) == {minority}


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "y string, yhat string")


def test_report_edge_cases(spark):
    # class 'c' never predicted; class 'd' predicted but absent from truth
    df = _pairs(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("b", "d")])
    rep = {r.label: r for r in metrics.classification_report(df, "y", "yhat").collect()}
    assert rep["c"].precision == 0.0 and rep["c"].recall == 0.0 and rep["c"].f1 == 0.0
    assert rep["d"].support == 0 and rep["d"].precision == 0.0
    assert rep["a"].precision == 0.5 and rep["a"].recall == 0.5
    assert abs(rep["macro avg"].accuracy - 0.4) < 1e-12
    cm = {(r.y, r.yhat): r.n for r in metrics.confusion_matrix(df, "y", "yhat").collect()}
    assert len(cm) == 16 and sum(v for (y, _), v in cm.items() if y == "d") == 0
    norm = metrics.confusion_matrix(df, "y", "yhat", normalize=True).collect()
    rows = {}
    for r in norm:
        rows[r.y] = rows.get(r.y, 0.0) + r.rate
    assert rows["d"] == 0.0 and all(abs(v - 1.0) < 1e-12 for k, v in rows.items() if k != "d")


def test_report_perfect(spark):
    df = _pairs(spark, [("a", "a"), ("b", "b"), ("b", "b")])
    rep = {r.label: r for r in metrics.classification_report(df, "y", "yhat").collect()}
    assert all(rep[k].f1 == 1.0 for k in ("a", "b", "macro avg", "weighted avg"))


def test_scaler_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, z double")
    stats = encoding.fit_scaler(df, ["x", "z"])
    assert stats["z"] == (5.0, 1.0) and stats["x"] == (2.0, 1.0)
    out = encoding.standard_scale(df, stats).collect()
    assert [r.z for r in out] == [0.0, 0.0] and [r.x for r in out] == [-1.0, 1.0]


def test_scaled_train_mean0_std1(spark):
    sp = sampling.stratified_split(catalog.training_table(spark, SF), LABEL, "obs_id")
    train = sp.where("split = 'train'")
    stats = encoding.fit_scaler(train, FEATURES)
    scaled = encoding.standard_scale(train, stats)
    row = scaled.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES],
                     *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]).collect()[0]
    for c in FEATURES:
        assert abs(row[f"m_{c}"]) < 1e-9
        assert abs(row[f"s_{c}"] - 1.0) < 1e-9 or row[f"s_{c}"] == 0.0


def test_label_encoding_roundtrip(spark):
    df = spark.createDataFrame([("sunny",), ("rainy",), ("cloudy",), ("hail",)], "l string")
    labels = ["cloudy", "rainy", "sunny"]
    kept = encoding.encode_labels(df, labels, ["l"], ["code"], "keep").collect()
    assert [r.code for r in kept] == [2, 1, 0, -1]
    skipped = encoding.encode_labels(df, labels, ["l"], ["code"], "skip")
    assert skipped.count() == 3
    back = encoding.decode_labels(skipped, labels, "code", "l2").collect()
    assert all(r.l == r.l2 for r in back)


def test_time_split_latest_rows_are_test(spark):
    tt = catalog.training_table(spark, SF)
    ts = sampling.time_split(tt, "datetime", "obs_id", 0.2)
    n = tt.count()
    test = ts.where("split = 'test'")
    assert test.count() == int(0.2 * n + 0.5)
    first_test = test.agg(F.min("datetime")).first()[0]
    last_train = ts.where("split = 'train'").agg(F.max("datetime")).first()[0]
    assert last_train <= first_test
