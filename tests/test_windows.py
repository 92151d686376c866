"""Chunked windows, ranks and percentiles against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tideline.functions import blocks, ordered
from tideline.functions.columns import ahead, back, full
from tideline.operators import features as ft, gaps, metrics as mt, structure as st


def series(seed=0, n=300, keep=0.85):
    r = np.random.default_rng(seed)
    out = []
    for key in ("a", "b"):
        pos = np.flatnonzero(r.random(n) < keep) + 1000
        out.append(pd.DataFrame({"series_id": key, "pos": pos, "x": r.normal(size=len(pos)).round(3), "state": r.integers(0, 3, len(pos))}))
    return pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_bounded_and_running(spark, size):
    pdf = series()
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1))
    got = blocks.over_chunks(df, ["series_id"], lambda d, w: d.withColumns(
        {"lag3": back("x", w, 3), "lead2": ahead("x", w, 2), "mean4": full("x", w, 4, F.avg)}), before=4, after=2, size=size)
    got = got.orderBy("series_id", "pos").toPandas()
    for key, g in pdf.groupby("series_id"):
        s = g.set_index("pos")["x"].reindex(range(1000, 1300))
        me = got[got.series_id == key].set_index("pos")
        whole = lambda k: s.rolling(k, min_periods=k).count().eq(k)
        np.testing.assert_allclose(me["mean4"], s.rolling(4, min_periods=4).mean().loc[me.index], atol=1e-12)
        np.testing.assert_allclose(me["lag3"], s.shift(3).where(whole(4)).loc[me.index], atol=1e-12)
        np.testing.assert_allclose(me["lead2"], s.shift(-2).where(whole(3).shift(-2, fill_value=False)).loc[me.index], atol=1e-12)

    run = blocks.running(df, ["series_id"], chunk=blocks.chunk_of("pos", size), total=("sum", "x"), prior=("last", F.when(F.col("x") > 1, F.col("x")), "before"),
                         top=("max", "x"), all=("total", "x"), begin=("first", "x")).orderBy("series_id", "pos").toPandas()
    rev = blocks.running(df, ["series_id"], chunk=blocks.chunk_of("pos", size), reverse=True, nxt=("last", "x", "before")).orderBy("series_id", "pos").toPandas()
    for key, g in pdf.groupby("series_id"):
        me, back_ = run[run.series_id == key], rev[rev.series_id == key]
        np.testing.assert_allclose(me["total"], g.x.cumsum(), atol=1e-9)
        np.testing.assert_allclose(me["prior"], g.x.where(g.x > 1).ffill().shift(1))
        np.testing.assert_allclose(me["top"], g.x.cummax())
        np.testing.assert_allclose(me["all"], g.x.sum())
        np.testing.assert_allclose(me["begin"], g.x.iloc[0])
        np.testing.assert_allclose(back_["nxt"], g.x.shift(-1))


def test_percentiles_and_auc(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=400), np.zeros(50), r.normal(size=50).round(1), -np.exp(r.normal(size=60) * 5)])
    y = (r.random(len(x)) < 0.4).astype(int)
    pdf = pd.DataFrame({"k": r.integers(0, 2, len(x)), "x": x, "label": y, "score": x.round(1)})
    df = spark.createDataFrame(pdf)
    p = ordered.percentiles(df, ["k"], "x", {"a": 0.01, "b": 0.5, "c": 0.99, "d": 1.0}).toPandas().set_index("k")
    a = mt.roc_auc(df, ["k"]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(p.loc[k, ["a", "b", "c", "d"]].astype(float), np.quantile(g.x, [0.01, 0.5, 0.99, 1.0]), rtol=1e-12)
        pos, neg = g.score[g.label == 1].to_numpy(), g.score[g.label == 0].to_numpy()
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert abs(a.loc[k, "auc"] - want) < 1e-12


@pytest.mark.parametrize("size", [40, 10_000])
def test_ema(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "CHUNK", size)
    pdf = series(5)
    got = ft.ema(spark.createDataFrame(pdf).withColumnRenamed("x", "close"), (3, 8)).toPandas()
    for key, g in pdf.groupby("series_id"):
        s = g.set_index("pos")["x"]
        s = s.reindex(range(s.index[0], s.index[-1] + 1)).ffill()
        me = got[got.series_id == key].set_index("pos").sort_index()
        for span in (3, 8):
            np.testing.assert_allclose(me[f"ema_{span}"], s.ewm(span=span, adjust=False, min_periods=span).mean().loc[me.index], atol=1e-12)


def smooth_loop(runs, least):
    out = []
    for s, m in runs:
        if out and (m < least or out[-1][0] == s):
            out[-1][1] += m
        else:
            out.append([s, m])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_smoothing_equals_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(blocks, "CHUNK", 16)
    pdf = series(seed, n=120, keep=1.0)
    m = blocks.stage(gaps.mark_runs(spark.createDataFrame(pdf).withColumn("ts", F.expr("timestampadd(HOUR, cast(pos as int), TIMESTAMP_NTZ'1970-01-01')"))))
    runs = blocks.stage(gaps.state_runs(m, 60))
    got = gaps.smoothed(gaps.smooth_runs(runs, 120)).orderBy("series_id", "block_start").toPandas()
    for key, g in pdf.groupby("series_id"):
        raw = [(int(s), 60 * len(list(v))) for s, v in __import__("itertools").groupby(g.state)]
        me = got[got.series_id == key]
        assert list(zip(me.state, me.duration_minutes)) == [tuple(x) for x in smooth_loop(raw, 120)]
    assert m.count() == runs.agg(F.sum("n_bars")).first()[0]


def test_swing_vector(spark):
    high = [1, 2, 10, 3, 4, 5, 20, 6, 7, 8]
    df = spark.createDataFrame([("a", i, float(h), float(h)) for i, h in enumerate(high)], "series_id string, pos long, high double, low double")
    assert [r.pos for r in st.swing_points(df, 2).filter("swing_high").orderBy("pos").collect()] == [2, 6]


def test_later_rows_do_not_matter(spark):
    pdf = series(9)
    df = spark.createDataFrame(pdf)
    work = lambda d, w: d.withColumn("m", full("x", w, 3, F.avg))
    whole = blocks.over_chunks(df, ["series_id"], work, before=3, size=32).filter("pos < 1150").orderBy("series_id", "pos").toPandas()
    early = blocks.over_chunks(df.filter("pos < 1150"), ["series_id"], work, before=3, size=32).orderBy("series_id", "pos").toPandas()
    pd.testing.assert_frame_equal(whole, early)


def test_no_task_holds_a_series(spark):
    """The plan of a bounded window partitions by chunk as well as by key."""
    df = spark.createDataFrame(series())
    plan = blocks.over_chunks(df, ["series_id"], lambda d, w: d.withColumn("m", F.avg("x").over(w.rangeBetween(-2, 0))), before=3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(series_id" in plan and "_chunk" in plan
    assert Window is not None
