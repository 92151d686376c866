"""k-means starts, and all folds of a walk fitted and decoded in shared jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import hmm, seeding as sd, walk as wk

COLS = ("u", "v")


def table(spark, n=900, folds=4, changed=None):
    """Two series with gaps, three kinds of rows, `folds` folds and a week of warm-up; the last rows of a fold are late."""
    r = np.random.default_rng(11)
    out = []
    for key in ("a", "b"):
        state = 0
        for i in range(n):
            state = state if r.random() < 0.9 else int(r.integers(3))
            u, v = r.normal([-2, 0, 2][state], 0.5), r.normal([0, 2, -1][state], 0.7)
            f = i * (folds + 1) // n - 1
            if f == changed:
                u, v = 3 * u + 1, -v
            at = i % (n // (folds + 1))
            out.append((key, i + 3 * (i // 100), f, at >= n // (folds + 1) - 5, float(u), float(v)))
    return spark.createDataFrame(out, "series_id string, pos long, fold int, late boolean, u double, v double").repartition(3).cache()


def test_lloyd_equals_a_plain_one(spark):
    rows = table(spark)
    packed = hmm.pack(rows, COLS, size=200)
    jobs = {7: sd.Job(1), 8: sd.Job(2)}
    begin = sd.starts(packed, COLS, 3, jobs, ("series_id",))
    got = sd.lloyd(packed, COLS, jobs, begin, {7: 0.0, 8: 0.0}, steps=6)
    x = np.array([[r.u, r.v] for r in rows.collect()])
    for i, c in begin.items():
        assert c.shape == (3, 2) and all((np.abs(x - row).sum(axis=1) < 50).any() for row in c)
        for _ in range(6):
            near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[near == s].mean(axis=0) if (near == s).any() else c[s] for s in range(3)])
        np.testing.assert_allclose(got[i], c, rtol=1e-9)


def test_starts_do_not_depend_on_chunks(spark):
    rows = table(spark)
    a, b = (sd.starts(hmm.pack(rows, COLS, size=s), COLS, 3, {0: sd.Job(5)}, ("series_id",))[0] for s in (100, 5000))
    np.testing.assert_allclose(a, b, rtol=1e-9)


def test_k_means_starts_need_fewer_iterations(spark):
    rows = table(spark)
    packed = hmm.pack(rows, COLS)
    _, log = hmm.fit(rows, COLS, 3, seeds=(1, 2, 3, 4))
    plain = 0
    for s in (1, 2, 3, 4):
        m, last = hmm.first_guess(rows, COLS, 3, s), -np.inf
        for it in range(101):
            ll, new = hmm.update(hmm.expected_counts(packed, COLS, {s: m})[s], m)
            if ll - last < 1e-2:
                break
            m, last = new, ll
        plain += it
    assert all(e["converged"] for e in log) and sum(e["n_iter"] for e in log) < plain


@pytest.mark.parametrize("size", [None, 64])
def test_folds_equal_single_fits(spark, size):
    """Every fold's model is the one that a fit of its own training rows, scaled by themselves, gives; also over many chunks."""
    rows = table(spark)
    models, views, facts, log = wk.fit_folds(rows, COLS, 3, [0, 1, 2, 3], seeds=(1, 2), max_iter=3, min_train=100, size=size)
    assert sorted(models) == [0, 1, 2, 3] and len(log) == 8
    for f in (0, 3):
        train = rows.filter((F.col("fold") < f) & ~(F.col("late") & (F.col("fold") == f - 1)))
        s = train.agg(*[x(c).alias(f"{n}{c}") for c in COLS for n, x in (("m", F.avg), ("s", F.stddev_pop))]).first()
        np.testing.assert_allclose(views[f].shift, [s.mu, s.mv], atol=1e-12)
        np.testing.assert_allclose(views[f].scale, [s.su, s.sv], rtol=1e-12)
        assert next(x for x in facts if x["fold"] == f)["n_train"] == train.count()
        scaled = train.select("series_id", "pos", *[((F.col(c) - s[f"m{c}"]) / s[f"s{c}"]).alias(c) for c in COLS])
        one, own = hmm.fit(scaled, COLS, 3, seeds=(1, 2), max_iter=3)
        by = lambda m: m[np.lexsort(m.T)]
        np.testing.assert_allclose(by(models[f].mean), by(one.mean), rtol=1e-6, atol=1e-8)  # seeds that tie may name states differently
        np.testing.assert_allclose(sorted(e["ll"] for e in log if e["fold"] == f), sorted(e["ll"] for e in own), rtol=1e-8)


def test_later_rows_change_no_earlier_model(spark):
    fit = lambda t: wk.fit_folds(t, COLS, 3, [0, 1, 2, 3], seeds=(1,), max_iter=2, min_train=100)
    (a, va, *_), (b, vb, *_) = fit(table(spark)), fit(table(spark, changed=2))
    for f in (0, 1, 2):
        np.testing.assert_allclose(va[f].shift + va[f].scale, vb[f].shift + vb[f].scale, rtol=1e-12)
        np.testing.assert_allclose(a[f].mean, b[f].mean, rtol=1e-9)
    assert np.abs(a[3].mean - b[3].mean).max() > 1e-3
    read = lambda t, m, v: {(r.series_id, r.pos): (r.fold, r.state, round(r.confidence, 6), r.duration) for r in wk.decode_folds(
        t, COLS, m, v, COLS[:1], COLS[1:], context=60).filter("fold < 2").collect()}
    assert read(table(spark), a, va) == read(table(spark, changed=2), b, vb)


def test_causal_reading_of_a_fold(spark):
    """Each fold is read by its own model behind its context, as a plain decode of those rows reads it."""
    rows = table(spark)
    models, views, *_ = wk.fit_folds(rows, COLS, 3, [1, 2], seeds=(1,), max_iter=2, min_train=100)
    got = {(r.series_id, r.pos): r for r in wk.decode_folds(rows, COLS, models, views, COLS[:1], COLS[1:], context=40, size=50).collect()}
    for f in (1, 2):
        for key in ("a", "b"):
            mine = rows.filter((F.col("series_id") == key))
            first = mine.filter(F.col("fold") == f).agg(F.min("pos")).first()[0]
            part = mine.filter(((F.col("fold") == f) | (F.col("pos") < first)) & (F.col("pos") >= first - 40) & (F.col("fold") <= f))
            v = views[f]
            scaled = part.select("series_id", "pos", *[((F.col(c) - v.shift[i]) / v.scale[i]).alias(c) for i, c in enumerate(COLS)])
            run, last = 0, None
            for r in hmm.decode(scaled, COLS, models[f]).orderBy("pos").collect():
                run = run + 1 if last is not None and last.pos == r.pos - 1 and last.cstate == r.cstate else 1
                last = r
                if r.pos >= first:
                    g = got.pop((key, r.pos))
                    assert (g.fold, g.state, g.duration) == (f, r.cstate, run)
                    assert abs(g.confidence - r.cpost[r.cstate]) < 1e-9 and abs(g.stay_prob - models[f].trans[r.cstate, r.cstate]) < 1e-12
                    assert abs(g.log1p_duration - np.log1p(run)) < 1e-12
    assert not got


def test_jobs_do_not_grow_with_folds(spark, monkeypatch):
    monkeypatch.setattr(sd, "STEPS", 1)
    jobs = []
    for folds in (2, 6):
        rows = table(spark, folds=folds)
        rows.count()
        group = f"walk-{folds}"
        spark.sparkContext.setJobGroup(group, group)
        wk.fit_folds(rows, COLS, 3, list(range(folds)), seeds=(1, 2), max_iter=1, min_train=50)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[0] - jobs[1]) <= 2, jobs


def test_too_few_rows(spark):
    few = table(spark).limit(2)
    model, log = hmm.fit(few, COLS, 3, seeds=(1, 2))
    assert model is None and [e["error"] for e in log] == ["2 rows for 3 states"] * 2
    assert hmm.model_table(spark, "x", model).count() == 0
    models, _, facts, log = wk.fit_folds(few, COLS, 3, [0, 1], min_train=1)
    assert not models and {x["status"] for x in facts} == {"skipped"}
    assert wk.decode_folds(few, COLS, {}, {}, COLS[:1], COLS[1:]).collect() == []


def test_few_chunks_are_spread_over_tasks(spark, monkeypatch):
    """Two chunks and many fits use more than one task; shares and sums over tasks change no result."""
    rows = table(spark)
    jobs = {i: sd.Job(i) for i in range(7)}
    plain = hmm.pack(rows, COLS, size=5000)
    spread = hmm.pack(rows, COLS, size=5000, fits=len(jobs))
    chunks = plain.select("series_id", "_chunk").distinct().count()
    assert plain.rdd.getNumPartitions() == plain.count() == chunks
    assert spread.rdd.getNumPartitions() == spread.count() > chunks
    a, b = (sd.moments(p, COLS, jobs) for p in (plain, spread))
    assert set(a) == set(b) == set(jobs) and all(a[i][0] == b[i][0] == 1800 for i in jobs)
    models = {i: hmm.first_guess(rows, COLS, 3, i) for i in jobs}
    for crossing in (False, True):
        few = hmm.expected_counts(spread, COLS, models, crossing=crossing)
        one = hmm.expected_counts(plain, COLS, models, crossing=crossing)
        with monkeypatch.context() as m:
            m.setattr(sd, "FEW", 0)
            many = hmm.expected_counts(spread, COLS, models, crossing=crossing)
        for i in jobs:
            np.testing.assert_allclose(few[i], one[i], rtol=1e-9)
            np.testing.assert_allclose(few[i], many[i], rtol=1e-9)
