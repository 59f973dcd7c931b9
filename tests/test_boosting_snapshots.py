"""Boosted trees, store snapshots and their ledger, threshold sampling, scoring of a stream."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.config import FEATURES, LABEL
from skyframe.operators import boosting, modeling, sampling, store
from skyframe.plans import catalog
from skyframe.session import scratch_path
from skyframe.sources import files, snapshots
from skyframe.streaming import ingest, scoring

PARAMS, _ = modeling.resolve_params({"n_estimators": 3, "max_depth": 3}, algorithm="softmax_boost")


def _rows(spark, n=300):
    return spark.range(n).select(
        F.col("id").alias("obs_id"), *[((F.col("id") * (i + 3)) % (7 + i)).cast("double").alias(c) for i, c in enumerate(FEATURES)],
        F.expr("CASE WHEN id * 3 % 7 < 2 THEN 'cloudy' WHEN id * 3 % 7 < 4 THEN 'rainy' ELSE 'sunny' END").alias(LABEL))


@pytest.fixture(scope="module")
def fitted(spark):
    return boosting.fit(_rows(spark), ["cloudy", "rainy", "sunny"], {c: (0.0, 1.0) for c in FEATURES}, PARAMS, FEATURES)


def test_margins_are_sums_of_leaf_values(spark, fitted):
    rows = _rows(spark).toPandas()
    x = rows[FEATURES].to_numpy()
    margin = np.zeros((len(x), 3))
    for trees in fitted.rounds:
        for k, t in enumerate(trees):
            for i in range(len(x)):
                at = 0
                while t.feature[at] >= 0:
                    at = t.left[at] if x[i, t.feature[at]] <= t.threshold[at] else t.right[at]
                margin[i, k] += t.value[at]
    p = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
    got = fitted.transform(_rows(spark)).orderBy("obs_id").toPandas()
    assert np.allclose(np.array(got["probability"].tolist()), p)
    assert got["predicted_label"].tolist() == [fitted.labels[i] for i in p.argmax(axis=1)]
    assert (got["predicted_label"] == got[LABEL]).mean() > 0.9


def test_losses_of_all_rounds_are_those_of_the_prefixes(spark, fitted):
    rows = _rows(spark)
    staged = [r["log_loss"] for r in boosting.staged_log_loss(fitted, rows).orderBy("round").collect()]
    for r, loss in enumerate(staged, 1):
        prefix = boosting.BoostedModel(fitted.labels, fitted.features, {}, fitted.rounds[:r])
        assert math.isclose(loss, modeling.evaluate_log_loss(prefix, rows).first()["log_loss"], rel_tol=1e-12)
    assert staged == sorted(staged, reverse=True)


def test_training_continues_behind_the_trees_there_are(spark, fitted):
    more = modeling.train_incremental(fitted, _rows(spark, 100), {"n_estimators": 2, "max_depth": 2}, classify_label=False)
    assert len(more.rounds) == 5 and more.labels == fitted.labels
    for old, new in zip(fitted.rounds, more.rounds):
        assert all((a == b).all() for s, t in zip(old, new) for a, b in zip(s, t))


def test_boosted_models_are_versions_like_others(spark, fitted):
    root = scratch_path(spark, "t_boosted")
    modeling.save_model(fitted, root)
    loaded, version = modeling.load_active(root)
    assert version == "v=1" and modeling.model_algorithm(loaded) == "softmax_boost"
    assert loaded.scaler_stats == fitted.scaler_stats and len(loaded.rounds) == len(fitted.rounds)
    assert all((a == b).all() for s, t in zip(sum(fitted.rounds, []), sum(loaded.rounds, [])) for a, b in zip(s, t))
    scored = modeling.score(loaded, _rows(spark).withColumn(FEATURES[0], F.when(F.col("obs_id") > 0, F.col(FEATURES[0]))), keep=["obs_id"])
    assert scored.where("status <> 'ok'").select("obs_id", "prediction").collect() == [(0, None)]


def test_rows_of_unknown_classes_and_empty_tables(spark, fitted):
    odd = _rows(spark, 50).withColumn(LABEL, F.when(F.col("obs_id") % 2 == 0, F.lit("hail")).otherwise(F.col(LABEL)))
    rows = boosting.training_rows(odd, fitted.labels, FEATURES, LABEL, None)
    assert rows.count() == 25
    none = boosting.fit(_rows(spark).where("false"), fitted.labels, {}, PARAMS, FEATURES)
    assert none.rounds == []


def test_regularisation_shrinks_leaves():
    tree = boosting.Tree(np.array([0, -1, -1]), np.array([0.5, 0, 0]), np.array([1, -1, -1]), np.array([2, -1, -1]), np.zeros(3))
    import pandas as pd
    sums = pd.DataFrame({"k": [0, 0], "leaf": [1, 2], "g": [3.0, -0.2], "h": [1.0, 4.0], "n": [4, 9]})
    got = boosting.newton_leaves([tree], sums, {"learning_rate": 0.5, "reg_lambda": 1, "reg_alpha": 0.5})[0]
    assert got.value.tolist() == [0, 0.5 * 2.5 / 2, 0]


def test_large_nodes_are_split_by_the_sums_of_all_tasks(spark, fitted, monkeypatch):
    """The trees do not depend on where a node's rows are."""
    monkeypatch.setattr(boosting, "ROWS_A_TASK", 40)
    monkeypatch.setattr(boosting, "NODES_AT_ONCE", 2)
    spread = boosting.fit(_rows(spark).repartition(3), fitted.labels, fitted.scaler_stats, {**PARAMS, "subsample": 1.0}, FEATURES)
    monkeypatch.undo()
    here = boosting.fit(_rows(spark), fitted.labels, fitted.scaler_stats, {**PARAMS, "subsample": 1.0}, FEATURES)
    a, b = (m.transform(_rows(spark)).orderBy("obs_id").toPandas()["probability"].tolist() for m in (spread, here))
    assert np.allclose(a, b) and [len(t.feature) for r in spread.rounds for t in r] == [len(t.feature) for r in here.rounds for t in r]


def test_a_node_takes_the_split_that_lowers_the_variance_most(monkeypatch):
    rng = np.random.default_rng(3)
    x, r = rng.integers(0, 9, (400, 3)).astype(np.uint8), rng.normal(size=400)
    limits = boosting.Limits(3, 9, 6, 5, 0.0)
    grown = boosting.grow_here(x, r, [0, 2], limits)
    leaves, places = [], {0: np.ones(400, bool)}
    for i, node in enumerate(grown.itertuples()):
        at = places[i]
        assert node.n == at.sum() and math.isclose(node.g, r[at].sum(), abs_tol=1e-9)
        tried = {(f, c): r[at & low].var() * (at & low).sum() + r[at & ~low].var() * (at & ~low).sum()
                 for f in (0, 2) for c in range(8) for low in [x[:, f] <= c] if min((at & low).sum(), (at & ~low).sum()) >= 5}
        if node.feature >= 0:
            assert math.isclose(tried[node.feature, node.cut], min(tried.values()))
            low = x[:, node.feature] <= node.cut
            places[node.left], places[node.right] = at & low, at & ~low
            assert min((at & low).sum(), (at & ~low).sum()) >= 5
        else:
            leaves.append(at)
    assert (sum(q.astype(int) for q in leaves) == 1).all() and grown["feature"].max() == 2 and len(grown) > 20
    monkeypatch.setattr(boosting, "NODES_AT_ONCE", 2)
    assert boosting.grow_here(x, r, [0, 2], limits).equals(grown)


def test_thresholds_come_from_all_rows_and_missing_values_go_right(spark):
    rows = spark.range(3000).select(F.array(F.col("id").cast("double"), (F.col("id") % 3).cast("double"), F.lit(None).cast("double"),
                                            F.when(F.col("id") % 2 == 0, 1.0).otherwise(float("nan"))).alias("x"))
    cuts = boosting.candidate_cuts(rows, 4)
    assert 100 < len(cuts[0]) < boosting.MAX_BINS and np.diff(cuts[0]).max() < 60
    assert [c.tolist() for c in cuts[1:]] == [[0.5, 1.5], [], []]
    got = rows.orderBy(F.col("x")[0]).select(boosting.binned(F.col("x"), cuts).alias("b")).first()["b"]
    assert bytes(got) == b"\0\0\0\0"
    tree = boosting.Tree(np.array([0, -1, -1]), np.array([1.5, 0, 0]), np.array([1, -1, -1]), np.array([2, -1, -1]), np.zeros(3))
    assert tree.leaf(np.array([[1.0], [2.0], [np.nan]])).tolist() == [1, 2, 2]


def test_the_report_is_of_a_model_of_the_whole_configuration(spark, monkeypatch):
    """Not of five rounds of depth 5; each configuration is a model of its own."""
    told = []

    def train(rows, labels, stats, params, algorithm, *rest):
        told.append({p: params[p] for p in ("n_estimators", "max_depth", "subsample", "colsample_bytree")})
        return boosting.fit(rows, labels, stats, {**params, "n_estimators": 2}, FEATURES)

    monkeypatch.setattr(catalog, "training_rows", lambda spark, sf_dir: _rows(spark))
    monkeypatch.setattr(modeling, "train_classifier", train)
    report = catalog.q_boost_report(spark, "whole").collect()
    catalog._boosted(spark, "whole", catalog.BOOST)
    whole = {"n_estimators": 200, "max_depth": 8, "subsample": 0.8, "colsample_bytree": 0.8}
    assert told == [whole, {**whole, **catalog.BOOST}]
    assert len(report) == 5 and all(r["same_by_sql"] for r in report)


def test_one_vs_rest_probabilities(spark):
    params, _ = modeling.resolve_params({"n_estimators": 2, "max_depth": 2}, algorithm="gbt_ovr")
    model = modeling.train_classifier(_rows(spark), ["cloudy", "rainy", "sunny"], {c: (0.0, 1.0) for c in FEATURES}, params, "gbt_ovr")
    for r in modeling.class_probabilities(model, _rows(spark, 20)).collect():
        each = [1 / (1 + math.exp(-2 * m)) for m in r["rawPrediction"]]
        assert np.allclose(r["probability"], np.array(each) / sum(each))
    assert modeling.evaluate_log_loss(model, _rows(spark)).first()["log_loss"] < math.log(3)


# ---- snapshots

def _on(day, h, p, temp, seq=1):
    return (dt.datetime(2024, 1, day, h), p, 50.0, 1.0, 2.0, 1000.0, temp, "rainy", 90.0, 3.0, seq)


def _df(spark, rows):
    from skyframe.config import STORE_SCHEMA
    from pyspark.sql import types as T
    return spark.createDataFrame(rows, T.StructType([*STORE_SCHEMA.fields, T.StructField("seq", T.LongType())]))


def _state(spark, path):
    return {(r.datetime.day, r.province): r.temperature for r in files.read_store(spark, path).collect()}


def test_a_job_that_dies_before_its_commit_changes_nothing(spark, monkeypatch):
    path = scratch_path(spark, "t_snap")
    store.upsert_into_store(spark, path, _df(spark, [_on(1, 0, "A", 1.0), _on(2, 0, "A", 2.0)]))
    before = _state(spark, path)

    def die(*args):
        raise RuntimeError("executor lost")
    monkeypatch.setattr(snapshots, "commit", die)
    with pytest.raises(RuntimeError):
        store.upsert_into_store(spark, path, _df(spark, [_on(1, 0, "A", 10.0), _on(2, 0, "A", 20.0)]))
    assert _state(spark, path) == before == {(1, "A"): 1.0, (2, "A"): 2.0}


def test_two_writers_lose_nothing(spark, monkeypatch):
    path = scratch_path(spark, "t_two")
    store.upsert_into_store(spark, path, _df(spark, [_on(1, 0, "A", 1.0), _on(2, 0, "A", 2.0)]))
    real, raced = snapshots.commit, []

    def race(spark_, path_, head, days, entry):
        if not raced:  # another writer commits between this one's reading and its commit: one day in common
            raced.append(True)
            store.upsert_into_store(spark, path, _df(spark, [_on(1, 0, "B", 5.0), _on(3, 0, "C", 6.0)]))
        return real(spark_, path_, head, days, entry)
    monkeypatch.setattr(snapshots, "commit", race)
    counts = store.upsert_into_store(spark, path, _df(spark, [_on(1, 0, "A", 10.0), _on(2, 0, "D", 7.0)]))
    assert counts == {"inserted": 1, "matched": 1, "modified": 1, "skipped": 0, "saved": 2}
    assert _state(spark, path) == {(1, "A"): 10.0, (1, "B"): 5.0, (2, "A"): 2.0, (2, "D"): 7.0, (3, "C"): 6.0}
    assert snapshots.latest(spark, path).version == 3


def test_only_one_of_two_commits_on_a_state_succeeds(spark):
    path = scratch_path(spark, "t_commit")
    head = snapshots.latest(spark, path)
    assert snapshots.commit(spark, path, head, {"2024-01-01": "a"}, {"writer": "x", "batch": 1})
    assert not snapshots.commit(spark, path, head, {"2024-01-01": "b"}, {})
    assert snapshots.latest(spark, path) == snapshots.Snapshot(1, {"2024-01-01": "a"}, {"x": 1})


def test_a_replayed_batch_is_counted_once(spark):
    path = scratch_path(spark, "t_ledger")
    batch = _df(spark, [_on(1, 0, "A", 1.0), _on(1, 1, None, 1.0)])
    once = [store.upsert_into_store(spark, path, batch, ledger={"writer": "w", "batch": 7, "files": 1, "records": 2, "malformed": 0})
            for _ in range(2)]
    assert once[0] == once[1] == {"inserted": 1, "matched": 0, "modified": 0, "skipped": 1, "saved": 1}
    assert [(r.writer, r.batch, r.inserted, r.skipped) for r in snapshots.ledger(spark, path).collect()] == [("w", 7, 1, 1)]
    assert store.upsert_into_store(spark, path, batch, ledger={"writer": "v", "batch": 0})["matched"] == 1


def test_days_are_written_once_and_pruned(spark):
    path = scratch_path(spark, "t_once")
    files.write_store(_df(spark, [_on(1, 0, "A", 1.0), _on(2, 0, "A", 2.0)]).drop("seq"), path)
    store.upsert_into_store(spark, path, _df(spark, [_on(2, 0, "A", 20.0)]))
    written = files.read_store(spark, path).select(F.input_file_name()).distinct().collect()
    assert len(written) == 2
    day = store.day_of_store(spark, path, "2024-01-02")
    assert [r.temperature for r in day.collect()] == [20.0]
    read = {r[0] for r in day.select(F.input_file_name()).distinct().collect()}
    assert len(read) == 1 and "day=2024-01-02" in read.pop()
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [day" in plan or "day#" in plan.split("PartitionFilters")[1]


def test_ledger_of_an_empty_table(spark):
    assert snapshots.ledger(spark, scratch_path(spark, "t_none")).count() == 0


def test_malformed_payloads_are_counted(spark):
    import json
    landing, path = scratch_path(spark, "t_bad"), scratch_path(spark, "t_bad_store")
    hour = {"time": "300", "humidity": "50", "pressure": "1000", "tempC": "20", "winddirDegree": "1", "windspeedKmph": "1"}
    good = json.dumps({"data": {"weather": [{"date": "2024-01-01", "hourly": [hour]}]}})
    rows = [("A", 1.0, 2.0, i, p) for i, p in enumerate([good, "{", None, "{}", json.dumps({"data": {}})])]
    spark.createDataFrame(rows, "province string, latitude double, longitude double, record long, payload string").write.json(landing)
    checkpoint = scratch_path(spark, "t_bad_ckpt")
    for _ in range(2):
        ingest.ingest_stream(spark, landing, path, checkpoint).awaitTermination()
    told = snapshots.ledger(spark, path).agg(F.sum("records"), F.sum("malformed"), F.sum("inserted")).first()
    assert tuple(told) == (5, 4, 1)


# ---- sampling

def test_split_has_no_exchange_of_the_table_and_refuses_null_labels(spark):
    rows = spark.range(1000).select(F.col("id").alias("obs_id"), F.expr("CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END").alias("c"))
    split = sampling.stratified_split(rows, "c", "obs_id")
    assert {tuple(r) for r in split.where("split = 'test'").groupBy("c").count().collect()} == {("a", 67), ("b", 133)}
    assert "Exchange hashpartitioning" not in split._jdf.queryExecution().executedPlan().toString()
    assert sampling.undersample(rows, "c", "obs_id").groupBy("c").count().select("count").distinct().collect() == [(334,)]
    with pytest.raises(ValueError, match="without a c"):
        sampling.stratified_split(rows.withColumn("c", F.when(F.col("obs_id") > 5, F.col("c"))), "c", "obs_id")
    empty = sampling.stratified_split(rows.where("false"), "c", "obs_id")
    assert empty.count() == 0 and "split" in empty.columns
    one = sampling.stratified_split(rows.where("obs_id < 2"), "c", "obs_id")  # a fifth of one row rounds to none
    assert {r["split"] for r in one.collect()} == {"train"}


# ---- scoring of a stream

def test_a_micro_batch_has_one_version_and_a_restart_repeats_nothing(spark, fitted):
    root, requests, out, checkpoint = (scratch_path(spark, n) for n in ("t_models", "t_req", "t_out", "t_sckpt"))
    rows = _rows(spark, 60)
    for lot, version in ((0, "v=1"), (1, "v=2")):
        assert modeling.save_model(fitted, root).endswith(version)
        rows.where(F.col("obs_id") % 2 == lot).coalesce(1).write.mode("append").parquet(requests)
        for _ in range(2):
            scoring.score_stream(spark, requests, rows.schema, root, out, checkpoint, ["obs_id"]).awaitTermination()
    got = {r["obs_id"]: (r["prediction"], r["model_version"]) for r in scoring.read_scored(spark, out).collect()}
    alone = {r["obs_id"]: r["prediction"] for r in modeling.score(fitted, rows, keep=["obs_id"]).collect()}
    assert got == {i: (p, f"v={1 + i % 2}") for i, p in alone.items()}
    assert scoring.read_scored(spark, out).count() == 60
