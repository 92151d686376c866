"""Label, model and resampling rules on tiny inputs."""

import numpy as np
from pyspark.sql import functions as F

from tideline.functions.blocks import stage
from tideline.operators import features as ft, folds as fo, gaps, labels as lb, metrics as mt, models as ml, resample as rs, states as ss, stats
from tideline.schemas import mismatch
from tideline.streaming import sources as ssrc, bars as sbars


def bars(spark, slots, minutes=30, volume=lambda i: 1.0):
    rows = [("a", int(i), 10.0 + i, 12.0 + i, 9.0, 11.0 + i, volume(i), 10.0 + i, 0.5, 0.5, 0.0) for i in slots]
    df = spark.createDataFrame(rows, "series_id string, pos long, open double, high double, low double, close double, volume double, "
                                     "avg_price double, buy_vol double, sell_vol double, ofi double")
    return df.withColumn("ts", F.expr(f"timestampadd(MINUTE, cast(pos * {minutes} as int), TIMESTAMP_NTZ'1970-01-01 00:00:00')"))


def test_complete_buckets_only(spark):
    out = rs.resample_bars(bars(spark, [0, 1, 2, 3, 5, 6, 7], 5), 15, 5).orderBy("pos").collect()
    assert [(r.pos, r.open, r.close, r.high, r.volume) for r in out] == [(0, 10.0, 13.0, 14.0, 3.0)]


def test_grid_and_mask(spark):
    d = rs.fill_grid(bars(spark, [0, 1, 2, 5, 6, 7, 8]), 30)
    v = [r.valid for r in gaps.validity_mask(d, 3).orderBy("pos").collect()]
    assert v == [True, True, True, False, False, False, False, True, True]


def test_asof_uses_closed_bar(spark):
    fine = spark.createDataFrame([("a", "1970-01-01 10:15:00", 1)], "series_id string, t string, n int").select(
        "series_id", F.col("t").cast("timestamp_ntz").alias("ts"), "n")
    coarse = bars(spark, range(18, 22)).withColumn("available_at", F.expr("ts + INTERVAL '30' MINUTE")).withColumn("n", F.lit(0))
    r = rs.asof_backward(fine, coarse, ["series_id"], "ts", "available_at", [F.col("ts").alias("bar")], F.lit(0).cast("long"), "n").first()
    assert str(r.bar) == "1970-01-01 09:30:00"


def test_first_fold(spark):
    last = spark.createDataFrame([("2018-05-10 12:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("last_ts"))
    f = fo.folds_expanding(last, "2017-09-01 00:00:00", "'5' MINUTE").orderBy("fold_id").collect()
    assert [str(f[0][c]) for c in ("train_end", "test_start", "test_end")] == ["2018-02-28 20:00:00", "2018-03-01 00:00:00", "2018-04-01 00:00:00"]
    assert str(f[-1]["test_end"]) == "2018-05-10 12:05:00"


def test_labels_are_strict(spark):
    d = spark.createDataFrame([(0.31, 0.0), (0.3, 0.31), (-0.31, -0.31)], "trend_score double, vol_score double")
    assert [r[0] for r in d.select(ss.label()).collect()] == ["Uptrend / Mid-Vol", "Ranging / High-Vol", "Downtrend / Low-Vol"]


def test_frozen_epsilon(spark):
    r = np.random.default_rng(1)
    rows = [(int(f), float(x), bool(t), int(s)) for f in range(3) for x, t, s in zip(r.normal(size=200), r.random(200) < 0.6, r.choice([-1, 1], 200))]
    df = stage(spark.createDataFrame(rows, "fold long, fwd double, is_trending boolean, trend_sign long"))
    for pool in ("usable", "eligible"):
        _, facts = lb.frozen_epsilon(df, "fwd", [0, 1, 2], 50, pool=pool)
        kept, want = [], []
        for f in range(3):
            own = np.array([abs(x) for g, x, t, _ in rows if g == f and t])
            src = np.concatenate(kept) if kept and sum(map(len, kept)) >= 50 else own
            e = np.quantile(src, 0.1)
            want.append(e)
            kept.append(own[own > e] if pool == "usable" else own)
        np.testing.assert_allclose([x["epsilon"] for x in facts], want, rtol=1e-12)
        assert [x["bootstrap"] for x in facts] == [True, False, False]


def test_logistic_matches_newton(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 2))
    y = (r.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -0.5] + 0.2)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "u double, v double, label long")
    model, n, _ = ml.fit_pool(df, ("u", "v"), ml.logistic, 0.0, 1.0)
    w, design, ridge = np.zeros(3), np.column_stack([x, np.ones(300)]), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (p - y) + ridge @ w)
    np.testing.assert_allclose([*model.coefficients, model.intercept], w, atol=2e-4)


def test_bootstrap_repeats_and_covers(spark):
    r = np.random.default_rng(4)
    rows = [("a", float(s), int(r.random() < 0.3 + 0.4 * s)) for s in r.random(400)]
    df = spark.createDataFrame(rows, "k string, score double, label long")
    a, b = (stats.bootstrap_auc(df, ["k"], 60).first() for _ in range(2))
    assert a == b
    assert a.lo < mt.roc_auc(df, ["k"]).first().auc < a.hi
    u = spark.range(20000).select(stats.poisson(F.lit(3).cast("long"), stats.hash_uniform("id"), F.lit(0.5)).alias("n"))
    m = u.agg(F.avg("n"), F.var_pop("n")).first()
    assert abs(m[0] - 3) < 0.06 and abs(m[1] - 3) < 0.15


def test_kruskal_tail():
    assert abs(mt.chi2_tail(5.991, 2) - 0.05) < 1e-4 and abs(mt.chi2_tail(7.815, 3) - 0.05) < 1e-4


def test_schema_mismatch(spark):
    d = spark.createDataFrame([(1, 2)], "a int, b int")
    assert mismatch(d, ["a", "b"]) == [] and mismatch(d, ["b", "a"]) and mismatch(d, ["a", "c"]) == ["missing c", "unexpected b"]


def test_stream_drops_late_buckets(spark):
    """A bar that comes after its bucket closed is dropped, and the bucket, being incomplete, never appears."""
    path = ssrc.fresh(spark, "late")
    for slots in ([0, 1, 3, 4, 5], [6, 7, 8, 30, 31, 32], [2, 33, 34, 35, 60]):
        bars(spark, slots, 5).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    out = ssrc.run_to_table(sbars.resample(ssrc.file_stream(spark, path, schema, 1), 15, 5, "10 minutes"), "late-out")
    assert sorted(str(r.ts) for r in out.collect()) == ["1970-01-01 00:15:00", "1970-01-01 00:30:00", "1970-01-01 02:30:00", "1970-01-01 02:45:00"]


def test_stream_features_equal_batch(spark):
    path = ssrc.fresh(spark, "feat")
    for slots in (range(0, 20), range(20, 33), range(36, 60)):
        bars(spark, slots, 5, lambda i: 1.0 + (i * 7 % 5)).coalesce(1).write.mode("append").parquet(path)
    whole = spark.read.parquet(path)
    got = sbars.append_features(ssrc.file_stream(spark, path, whole.schema, 1), ft.build_features, ft.LOOKBACK)
    cols = ["pos", "ret_4", "vol_6", "vol_z", "skew_6"]
    a, b = (d.select(*cols).orderBy("pos").toPandas() for d in (got, ft.build_features(whole)))
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), atol=1e-9)


def test_small_volumes_keep_their_digits(spark):
    from tideline.operators.resample import tick_bars

    e = spark.createDataFrame([(1, 2, "a", 3e-7), (2, 3, "a", 2e-7)], "event_id long, user_id long, event_type string, value double").selectExpr(
        "*", "timestamp_ntz'2024-01-01 00:00:00' AS ts")
    bar = tick_bars(e, 60).first()
    assert abs(bar.volume - 5e-7) < 1e-20 and abs(bar.buy_vol - 3e-7) < 1e-20 and abs(bar.ofi - 1e-7) < 1e-20


def test_large_ids_do_not_reach_into_the_time(spark):
    from tideline.operators.resample import tick_bars

    e = spark.createDataFrame([(5 * 10**18, 1, "a", 1.0, 0), (1, 1, "a", 2.0, 2), (-5, 1, "a", 3.0, 2)], "event_id long, user_id long, event_type string, value double, us int").selectExpr(
        "*", "timestampadd(MICROSECOND, us, timestamp_ntz'2024-01-01 00:00:00') AS ts")
    bar = tick_bars(e, 60).first()
    assert (bar.open, bar.close) == (1.0, 2.0)


def test_a_days_state_is_the_commonest_whatever_its_number(spark):
    from tideline.operators.resample import daily_overview

    bars = spark.createDataFrame([("a", i, 1.0) for i in range(4)], "series_id string, pos long, close double").selectExpr(
        "*", "close open", "close high", "close low", "close volume", "close buy_vol", "0.0D sell_vol", "close avg_price")
    states = spark.createDataFrame([("a", 0, 5000), ("a", 1, 5000), ("a", 2, 1), ("a", 3, 7)], "series_id string, pos long, state long")
    assert daily_overview(bars, states, 60).first().state == 5000


def test_ema_goes_on_after_a_long_silence(spark):
    import numpy as np
    import pandas as pd

    from tideline.operators.features import ema

    pos = [*range(20), *range(400, 405), *range(20_000, 20_003)]
    rows = [("a", p, float(10 + p % 7)) for p in pos]
    got = ema(spark.createDataFrame(rows, "series_id string, pos long, close double"), (8,), size=50).toPandas().sort_values("pos").ema_8.to_numpy()
    dense = pd.Series([r[2] for r in rows], index=pos).reindex(range(pos[-1] + 1)).ffill().ewm(span=8, adjust=False, min_periods=8).mean()
    assert np.allclose(got, dense.to_numpy()[pos], rtol=1e-12, equal_nan=True)


def test_training_pool_ends_before_the_embargo(spark):
    from tideline.operators.models import training_pool

    rows = spark.createDataFrame([(0, False), (0, True), (1, False), (1, True), (2, False), (3, False)], "fold int, late boolean")
    assert sorted(map(tuple, training_pool(rows, 2).collect())) == [(0, False), (0, True), (1, False)]


def test_later_folds_change_no_earlier_label(spark):
    from tideline.operators.labels import frozen_epsilon

    def labels(scale):
        rows = [(f, i, True, 1 if i % 2 else -1, (i % 7 - 3) * 0.01 * (scale if f == 2 else 1)) for f in range(3) for i in range(60)]
        d = spark.createDataFrame(rows, "fold int, pos int, is_trending boolean, trend_sign int, fwd_2 double")
        return {(r.fold, r.pos): (r.epsilon, r.label) for r in frozen_epsilon(d, "fwd_2", [0, 1, 2], 20)[0].collect()}

    a, b = labels(1.0), labels(50.0)
    assert all(a[k] == b[k] for k in a if k[0] < 2) and {a[k][0] for k in a if k[0] == 2} == {b[k][0] for k in b if k[0] == 2}


def test_poisson_is_exact_for_large_counts(spark):
    from tideline.operators import stats

    u = spark.range(4000).select(stats.poisson(F.lit(40).cast("long"), stats.hash_uniform("id"), stats.hash_uniform("id", F.lit(1))).alias("n"))
    mean, var = u.agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(mean - 40) < 0.5 and abs(var - 40) < 4
