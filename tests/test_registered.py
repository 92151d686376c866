"""Registered queries run the whole study: published settings, folds taken from the data."""
import pytest

from tideline.operators import boosting as bo, hmm, models as ml, stats, walk as wk
from tideline.plans import inputs, q_hmm, q_models, q_stats


class Stop(Exception):
    pass


def stopping(seen):
    def call(*args, **kw):
        seen.append((args, kw))
        raise Stop

    return call


@pytest.mark.parametrize("name, kind, want", [("rf_grid", "getNumTrees", 300), ("feature_importance_rank", "getNumTrees", 300), ("gbt_fit", "getMaxIter", 100),
                                              ("model_choice", "getMaxIter", 100)])
def test_studies_fit_full_models(spark, monkeypatch, name, kind, want):
    seen = []

    def make_only(_, __, make, *rest, **kw):
        seen.append(make(1000))
        if hasattr(seen[-1], kind):
            raise Stop
        return None if rest else (object(), 0, None)

    monkeypatch.setattr(q_models, "rows", lambda s, d: s.range(1))
    monkeypatch.setattr(q_models, "stage", lambda d: d)
    monkeypatch.setattr(q_models.fo, "chronological_split", lambda d, *_: d.selectExpr("id", "'train' AS part", "1L AS label"))
    monkeypatch.setattr(q_models, "folds_of", lambda r: [0])
    monkeypatch.setattr(ml, "walk", make_only)
    monkeypatch.setattr(ml, "fit_pool", make_only)
    monkeypatch.setattr(ml, "predict", lambda m, d, f: d)
    monkeypatch.setattr(q_models.mt, "roc_auc", lambda d, k: d)
    with pytest.raises(Stop):
        getattr(q_models, name)(spark, "")
    assert getattr(seen[-1], kind)() == want


def test_boosting_walk_is_full(spark, monkeypatch):
    seen = []

    def fit(rows, features, folds, key, rules=bo.Rules(), min_pool=500):
        seen.append((rules, list(folds), min_pool))
        raise Stop

    monkeypatch.setattr(q_models, "rows", lambda s, d: s.range(1))
    monkeypatch.setattr(q_models, "folds_of", lambda r: [0, 1])
    monkeypatch.setattr(bo, "fit_folds", fit)
    with pytest.raises(Stop):
        q_models.xgb_walk_forward(spark, "")
    rules, folds, least = seen[0]
    assert (rules.rounds, rules.depth, rules.rate, rules.child, rules.sample, rules.ridge) == (200, 3, 0.05, 50.0, 0.8, 1.0)
    assert (folds, least) == ([0, 1], 500)


def test_fits_and_replicates_are_full(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q_models, "fold_rows", lambda s, d: (None, 60))
    monkeypatch.setattr(q_models, "folds_of", lambda r: [0])
    monkeypatch.setattr(wk, "walk_forward", stopping(seen))
    monkeypatch.setattr(q_hmm, "_valid", lambda s, d: None)
    monkeypatch.setattr(q_hmm, "stage", lambda d: d)
    monkeypatch.setattr(hmm, "fit", stopping(seen))
    monkeypatch.setattr(q_stats, "scored", lambda s, d: None)
    monkeypatch.setattr(stats, "bootstrap_auc", stopping(seen))
    for run in (q_models.walk_forward, q_hmm.restart_log, q_stats.bootstrap_auc_ci):
        with pytest.raises(Stop):
            run(spark, "")
    assert [seen[0][1]["max_iter"], seen[1][1]["max_iter"], seen[2][0][2]] == [100, 100, 2_000]


@pytest.mark.parametrize("name, last", [("k_selection", 20), ("threshold_validation", 10)])
def test_calibration_reads_later_folds(spark, monkeypatch, name, last):
    seen = []
    monkeypatch.setattr(inputs, "valid_rows", lambda *_, **__: spark.range(30).selectExpr("id AS fold"))
    monkeypatch.setattr(q_models, "rows", lambda *_: spark.range(-1, 30).selectExpr("id AS fold"))
    monkeypatch.setattr(q_models, "_split", stopping(seen))
    with pytest.raises(Stop):
        getattr(q_models, name)(spark, "")
    assert {r.fold for r in seen[0][0][0].collect()} == set(range(last + 1))


def test_anchors_follow_the_folds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q_hmm, "_valid", lambda s, d: spark.range(-1, 7).selectExpr("id AS fold"))
    monkeypatch.setattr(q_hmm, "stage", lambda d: d)
    monkeypatch.setattr(q_hmm.walk, "moment_model", lambda rows, cols, base: sorted(r.fold for r in rows.collect()))
    monkeypatch.setattr(hmm, "decode", stopping(seen))
    with pytest.raises(Stop):
        q_hmm.anchor_decode(spark, "")
    v, _, models = seen[0][0]
    assert {r.fold: r.anchor for r in v.collect()} == {f: f // 2 * 2 for f in range(7)}
    assert models == {a: list(range(-1, a)) for a in (0, 2, 4, 6)}


@pytest.mark.parametrize("name", ["hmm_fit", "hmm_restarts", "restart_log", "walk_forward", "lr_walk_forward", "xgb_walk_forward", "gbt_fit", "gate_score", "walk_restart_log", "stage_a_decode"])
def test_fits_return_on_few_rows(spark, name):
    """Too few rows give no model: an empty table, or log rows that say why."""
    from tideline.plans import CATALOG

    got = CATALOG[name](spark, "/root/testdata/sf0.001").collect()
    if name == "restart_log":
        assert {r.error for r in got} == {"0 rows for 2 states", "0 rows for 3 states"}
    assert all(r.ll is None and not r.best for r in got if name in ("hmm_restarts", "restart_log"))
