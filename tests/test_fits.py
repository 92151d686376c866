"""Fits of different folds and models do not wait for each other, and no step behind them computes its input again and again."""

import threading

import pytest
from pyspark.sql import functions as F

from tideline.operators import folds as fo, models as ml
from tideline.plans import q_models


def together(n):
    """A fit that ends only when n of them run at the same time."""
    gate = threading.Barrier(n)

    def fit(pool, features, make, lo=0.4, hi=0.6):
        gate.wait(timeout=30)
        return None, 0, None

    return fit


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i % 5, f"s{i % 3}", i, i % 7 < 3, True, False, float((i * 37) % 101), float((i * 53) % 89)) for i in range(600)]
    d = spark.createDataFrame(rows, "fold int, series_id string, pos long, y boolean, is_trending boolean, late boolean, a double, b double")
    return d.withColumn("label", F.col("y").cast("long")).drop("y").cache()


def test_folds_are_fitted_side_by_side(table, monkeypatch):
    monkeypatch.setattr(ml, "fit_pool", together(3))
    _, fits = ml.walk(table, ("a", "b"), ml.logistic, [1, 2, 3, 4], 10)
    assert fits == []


def test_models_are_fitted_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(q_models, "rows", lambda s, d: None)
    monkeypatch.setattr(fo, "chronological_split", lambda *_: spark.range(1).selectExpr("'train' AS part", "1L AS label"))
    monkeypatch.setattr(ml, "fit_pool", together(2))
    assert q_models.model_choice(spark, "").count() == 0


def counted(monkeypatch):
    calls, plain = [], ml.roc_auc
    monkeypatch.setattr(ml, "roc_auc", lambda d, keys, *a: calls.append(keys) or plain(d, keys, *a))
    return calls


def test_one_ranking_for_all_folds_and_variants(table, monkeypatch):
    p, fits = ml.walk(table, ("a", "b"), ml.logistic, [1, 2, 3, 4], 10)
    assert [x.fold for x in fits] == [2, 3, 4] and {r.fold for r in p.select("fold").distinct().collect()} == {2, 3, 4}
    assert p.count() == table.filter("fold >= 2").count()
    want = {x.fold: ml.roc_auc(ml.predict(x.model, ml.training_pool(table, x.fold), ("a", "b")), ["is_trending"]).first()["auc"] for x in fits}
    calls = counted(monkeypatch)
    got = {r.fold: r.train_auc for r in ml.train_auc(table, ("a", "b"), fits).collect()}
    assert got == pytest.approx(want) and len(calls) == 1
    calls.clear()
    a = {r.variant: (r.n_features, r.auc) for r in ml.compare({"one": ("a",), "two": ("a", "b")}, table, ml.logistic, [1, 2, 3, 4], 10).collect()}
    assert len(calls) == 1 and {v: n for v, (n, _) in a.items()} == {"one": 1, "two": 2}
    assert a["two"][1] == pytest.approx(ml.roc_auc(p.withColumn("_k", F.lit(1)), ["_k"]).first()["auc"])


def test_permutation_computes_its_scores_once(table):
    model, _, _ = ml.fit_pool(table, ("a", "b"), ml.logistic)
    seen = ml.permutation_importance(model, table, ("a", "b"), 4, F.concat_ws("|", "series_id", "pos"))
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 4, plan.count("Join")  # the ranks and the plain score, not the shuffles behind them
    got = {r.feature: r for r in seen.collect()}
    assert set(got) == {"a", "b"} and all(r.n_repeats == 4 and r.std_loss >= 0 for r in got.values())
