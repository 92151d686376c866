"""Classifiers walked forward over folds. Fits have no SQL twin; the rules around them do."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.blocks import chunk_of, stage
from ..functions.columns import full, since
from ..operators import boosting as bo, features as ft, folds as fo, labels as lb, metrics as mt, models as ml, stats, structure as st, walk as wk
from . import inputs as inp
from .q_labels import LABEL, labelled
from .q_stats import SCORED, SEGMENTS, scored, segment_dims
from .q_structure import WIDTHS, swings_sql
from .registry import query

BASE = ("confidence", "stay_prob", "log1p_duration", "margin")
THRESHOLD = ("confidence", "px_z", "vol_z", "ofi_z")  # for choices made on rows with threshold states
MODEL_COLS, TREND_COLS, VOL_COLS = (*ft.BASE_FEATURES, "px_z"), ("ret_1", "ret_2", "px_z"), ("vol_4", "vol_6")
STATES, SEEDS = 4, (1, 2, 3, 4, 5)
RAW = ("ret_1", "ret_2", "ret_4", "vol_4", "vol_6", "vol_change", "skew_6", "asym_6")
POOL = 500
EMBARGO_HOURS = 4
WEEK = 7 * 24
TREES = 300
WALK_ITERATIONS = 100
K_FOLDS, THRESHOLD_FOLDS = 20, 10  # last calibration folds of the published studies; of those, the folds that exist are read


_STAGE_A: dict[tuple[str, str], object] = {}  # the labelled table of a folder, by application: fitted once, read by all studies


def fold_rows(spark, folder):
    """Valid rows of bars as fine as the event table fills; those before the first fold train only (fold -1). A forward move that ends in the
    next fold counts as unknown, and rows within the embargo before the next fold are marked late. Returns rows and bar width."""
    m = inp.walk_minutes(spark, folder)
    minute = F.floor(F.pmod(since(inp.WEEK0), F.lit(WEEK * 3_600_000_000)) / 60_000_000)
    v = inp.valid_rows(spark, folder, minutes=m).withColumns({"late": minute >= (WEEK - EMBARGO_HOURS) * 60, "fold": F.greatest("fold", F.lit(-1)).cast("int")})
    return stage(v.withColumns({f"fwd_{h}": F.when(minute + h * m < WEEK * 60, F.col(f"fwd_{h}")) for h in inp.HORIZONS})), m


def stage_a(v):
    """Of every fold a model fitted on the past and its causal reading of the fold; models, views, facts and restart log beside it."""
    models, views, facts, log = wk.fit_folds(v, MODEL_COLS, STATES, folds_of(v), SEEDS, WALK_ITERATIONS, POOL)
    return wk.decode_folds(v, MODEL_COLS, models, views, TREND_COLS, VOL_COLS), facts, log


def rows(spark, folder):
    """Rows of all folds that have a model, with the columns that its causal reading gives and labels that know nothing of later folds: each
    fold's epsilon comes from earlier rows. Written by fold, so that a pool reads only its folds."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STAGE_A:
        v, _ = fold_rows(spark, folder)
        decoded, _, _ = stage_a(v)
        new = [c for c in decoded.columns if c not in ("series_id", "fold", "pos")]
        v = stage(v.drop(*new).join(decoded, ["series_id", "fold", "pos"]))
        folds = folds_of(v)
        labelled_ = lb.frozen_epsilon(v, "fwd_2", folds, min_pool=50)[0] if folds else lb.persistence(
            v.withColumns({"epsilon": F.lit(None).cast("double"), "bootstrap": F.lit(True)}), "fwd_2", F.col("epsilon"))
        _STAGE_A[key] = stage(labelled_, "fold")
    return _STAGE_A[key]


def folds_of(r):
    return [x[0] for x in r.filter("fold >= 0").select("fold").distinct().orderBy("fold").collect()]


def lr(n):
    return ml.logistic(n)


def _fold_auc(p):
    return mt.roc_auc(p, ["fold"])


@query("class_weight_rule", "fold:l n:l pos_rate:d balanced:b w_pos:d w_neg:d", LABEL + """
SELECT fold, n, r AS pos_rate, NOT r BETWEEN 0.4 AND 0.6 AS balanced, CASE WHEN r BETWEEN 0.4 AND 0.6 THEN 1 ELSE 0.5 / r END AS w_pos,
 CASE WHEN r BETWEEN 0.4 AND 0.6 THEN 1 ELSE 0.5 / (1 - r) END AS w_neg FROM (SELECT fold, count(*) AS n, avg(label) AS r FROM lab WHERE label IS NOT NULL GROUP BY 1)""")
def class_weight_rule(spark, folder):
    return ml.class_weights(labelled(spark, folder))


@query("lr_walk_forward", "fold:l n_pos:l n_neg:l auc:d")
def lr_walk_forward(spark, folder):
    r = rows(spark, folder)
    p, _ = ml.walk(r, BASE, lr, folds_of(r), POOL)
    return _fold_auc(p)


@query("rf_walk_forward", "fold:l auc:d train_auc:d")
def rf_walk_forward(spark, folder):
    r = rows(spark, folder)
    p, fits = ml.walk(r, BASE, lambda n: ml.forest(TREES, **ml.RF_BASE), folds_of(r), POOL, lo=0.5, hi=0.5)
    return _fold_auc(p).join(ml.train_auc(r, BASE, fits), "fold")


@query("rf_grid", "setting auc:d train_auc:d gap:d")
def rf_grid(spark, folder):
    r = rows(spark, folder)
    out = None
    for name, kw in ml.RF_GRID.items():
        p, fits = ml.walk(r, BASE, lambda n: ml.forest(TREES, **kw), folds_of(r), POOL, lo=0.5, hi=0.5)
        a = _fold_auc(p).join(ml.train_auc(r, BASE, fits), "fold").groupBy(F.lit(name).alias("setting")).agg(
            F.avg("auc").alias("auc"), F.avg("train_auc").alias("train_auc"))
        out = a if out is None else out.unionByName(a)
    return out.withColumn("gap", F.col("train_auc") - F.col("auc"))


@query("gbt_fit", "part n:l auc:d")
def gbt_fit(spark, folder):
    d = stage(fo.chronological_split(rows(spark, folder), "2024-01-22 00:00:00", "'4' HOUR"))
    m, _, _ = ml.fit_pool(d.filter("part = 'train'"), BASE, lambda n: ml.boosted())
    if m is None:
        return spark.createDataFrame([], "part string, n long, auc double")
    a = mt.roc_auc(ml.predict(m, d.filter("label IS NOT NULL"), BASE), ["part"])
    return a.withColumn("n", F.col("n_pos") + F.col("n_neg"))


@query("xgb_walk_forward", "fold:l auc:d")
def xgb_walk_forward(spark, folder):
    """Boosting of second order with the published settings, all folds in the same jobs."""
    r = rows(spark, folder)
    fits = bo.fit_folds(r, BASE, folds_of(r), F.concat_ws("|", "series_id", "pos"), min_pool=POOL)
    return _fold_auc(bo.predict_folds(r.filter("is_trending"), BASE, fits))


@query("model_choice", "model auc:d chosen:b")
def model_choice(spark, folder):
    """Keeps the model with the better holdout AUC."""
    d = stage(fo.chronological_split(rows(spark, folder), "2024-01-22 00:00:00", "'4' HOUR"))
    train = d.filter("part = 'train'")
    makes = {"logistic": lr, "boosted": lambda n: ml.boosted()}
    fits = ml.side_by_side(spark, lambda make: ml.fit_pool(train, BASE, make)[0], makes.values())
    if any(m is None for m in fits):
        return spark.createDataFrame([], "model string, auc double, chosen boolean")
    test = d.filter("part = 'test' AND label IS NOT NULL")
    p = [ml.predict(m, test, BASE).select("label", "score", F.lit(name).alias("model")) for name, m in zip(makes, fits)]
    out = mt.roc_auc(stage(p[0].unionByName(p[1])), ["model"])
    w = Window.partitionBy(F.lit(0))  # one row per model
    return out.withColumn("chosen", F.col("auc") == F.max("auc").over(w))


@query("gate_score", "series_id ts:t is_trending:b score:d")
def gate_score(spark, folder):
    """The saved gate applied to the latest bar; no answer while ranging."""
    r = rows(spark, folder)
    m, _, _ = ml.fit_pool(r, BASE, lr)
    last = r.groupBy("series_id").agg(F.max_by(F.struct("ts", "is_trending", *BASE), "pos").alias("x")).select("series_id", "x.*")
    if m is None:
        return last.withColumn("score", F.lit(None).cast("double"))
    return ml.predict(m, last, BASE).withColumn("score", F.when(F.col("is_trending"), F.col("score")))


@query("feature_ablation", "variant n_features:l auc:d delta:d")
def feature_ablation(spark, folder):
    variants = {"all": BASE} | {f"without {f}": tuple(x for x in BASE if x != f) for f in BASE}
    r = rows(spark, folder)
    a = ml.compare(variants, r, lr, folds_of(r), POOL)
    full_auc = a.groupBy(F.lit(1).alias("_k")).agg(F.max(F.when(F.col("variant") == "all", F.col("auc"))).alias("_all"))
    return a.withColumn("_k", F.lit(1)).join(full_auc, "_k").withColumn("delta", F.col("_all") - F.col("auc"))


@query("family_test", "variant n_features:l auc:d")
def family_test(spark, folder):
    fam = {"base": (), "returns": ("ret_1", "ret_2", "ret_4"), "volatility": ("vol_4", "vol_6"), "shape": ("skew_6", "asym_6")}
    r = rows(spark, folder)
    return ml.compare({k: (*BASE, *v) for k, v in fam.items()}, r, lr, folds_of(r), POOL)


@query("segment_breakdown_walk", SEGMENTS)
def segment_breakdown_walk(spark, folder):
    """The walked classifier's out-of-sample scores by direction, state label, volatility class, calendar and buckets of what its states tell."""
    r = rows(spark, folder)
    keep = ("series_id", "pos", "ts", "label", "trend_sign", "regime", *BASE, "duration")
    p, _ = ml.walk(r, BASE, lr, folds_of(r), POOL, keep)
    four = {c: (c, 4) for c in ("confidence", "stay_prob", "margin")}
    return stats.segment_breakdown(stage(p), segment_dims(), {**four, "duration": ("duration", 3)})


@query("raw_vs_derived", "variant n_features:l auc:d")
def raw_vs_derived(spark, folder):
    r = rows(spark, folder)
    return ml.compare({"derived": BASE, "raw": RAW, "both": (*BASE, *RAW)}, r, lr, folds_of(r), POOL)


@query("feature_importance_rank", "fold:l feature importance:d rnk:l")
def feature_importance_rank(spark, folder):
    feats = (*BASE, *RAW)
    r = rows(spark, folder)
    _, fits = ml.walk(r, feats, lambda n: ml.forest(TREES, **ml.RF_BASE), folds_of(r), POOL, lo=0.5, hi=0.5)
    t = spark.createDataFrame(ml.importances(fits, feats), "fold long, feature string, importance double")
    return t.withColumn("rnk", F.rank().over(Window.partitionBy("fold").orderBy(F.desc("importance"))))


@query("permutation_importance", "feature n_repeats:l mean_loss:d std_loss:d")
def permutation_importance(spark, folder):
    r = rows(spark, folder)
    _, fits = ml.walk(r, BASE, lr, folds_of(r), POOL)
    if not fits:
        return spark.createDataFrame([], "feature string, n_repeats long, mean_loss double, std_loss double")
    last = stage(r.filter((F.col("fold") == fits[-1].fold) & F.col("is_trending") & F.col("label").isNotNull()))
    return ml.permutation_importance(fits[-1].model, last, BASE, 20, F.concat_ws("|", "series_id", "pos"))


@query("coef_summary", "feature n_folds:l mean_coef:d std_coef:d")
def coef_summary(spark, folder):
    r = rows(spark, folder)
    _, fits = ml.walk(r, BASE, lr, folds_of(r), POOL)
    t = spark.createDataFrame(ml.coefficients(fits, BASE), "fold long, feature string, coef double")
    return t.groupBy("feature").agg(F.count("coef").alias("n_folds"), F.avg("coef").alias("mean_coef"), F.stddev_samp("coef").alias("std_coef"))


@query("train_oos_gap", "model mean_train:d mean_oos:d gap:d", SCORED.replace(";;", ",") + """
pt AS (SELECT a.fold, s.label, s.score, s.score_b FROM au a JOIN sl s ON s.fold < a.fold),
ta AS (SELECT fold, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS ta,
 (sum(rb) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS tb
 FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r,
  rank() OVER (PARTITION BY fold ORDER BY score_b) + (count(*) OVER (PARTITION BY fold, score_b) - 1) / 2.0 AS rb FROM pt) GROUP BY 1)
;;
SELECT m AS model, avg(t) AS mean_train, avg(o) AS mean_oos, avg(t) - avg(o) AS gap FROM (
 SELECT unnest(['a', 'b']) AS m, unnest([ta, tb]) AS t, unnest([auc, auc_b]) AS o FROM ta JOIN au USING (fold)) GROUP BY 1""")
def train_oos_gap(spark, folder):
    """Score quality on each fold's earlier rows against the fold itself, for two scores."""
    s = stage(scored(spark, folder).filter("label IS NOT NULL"))
    out = None
    for name, c in (("a", "score"), ("b", "score_b")):
        tr = stats.pool_auc(s.select("fold", "label", F.col(c).alias("score"))).withColumnRenamed("auc", "train_auc")
        oo = mt.roc_auc(s.select("fold", "label", F.col(c).alias("score")), ["fold"]).select("fold", "auc")
        g = tr.join(oo, "fold").withColumn("model", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return ml.train_oos_gap(out, ["model"])


# choices made on inner splits


def _inner_auc(d, make, features):
    """Fit on the inner part, AUC on the rest."""
    m, _, _ = ml.fit_pool(d.filter("inner"), features, make)
    if m is None:
        return None
    r = mt.roc_auc(ml.predict(m, d.filter("NOT inner AND label IS NOT NULL").withColumn("_k", F.lit(1)), features), ["_k"]).collect()
    return r[0]["auc"] if r else None


def _split(d, share=0.8):
    return stage(fo.inner_split(stage(d), inp.KEYS, ("pos",), chunk_of("pos"), share))


@query("k_selection", "k:d auc:d chosen:b")
def k_selection(spark, folder):
    """Volatility multiple by inner AUC: the larger AUC, the smaller k on ties."""
    v = _split(inp.valid_rows(spark, folder, lambda d, w: d.withColumn("past_vol", full("ret_1", w, 5, F.stddev_samp)), before=5).filter(F.col("fold") <= K_FOLDS))
    got = [(k, _inner_auc(lb.adaptive(v, "fwd_2", "past_vol", k), lr, THRESHOLD)) for k in (0.25, 0.5, 0.75, 1.0)]
    best = max(((a, -k) for k, a in got if a is not None), default=None)
    return spark.createDataFrame([(k, a, a is not None and (a, -k) == best) for k, a in got], "k double, auc double, chosen boolean")


TRIALS = "cut double, status string, n_train long, n_val long, epsilon double, zero_folds long, auc double, pos_rate double, verdict string"


@query("threshold_validation", "cut:d status n_train:l n_val:l epsilon:d zero_folds:l auc:d pos_rate:d verdict")
def threshold_validation(spark, folder):
    """Trend thresholds on decoded states of the calibration folds, 70 to 30 in time, against the baseline 0.30."""
    v = rows(spark, folder).filter(F.col("fold").between(0, THRESHOLD_FOLDS))
    got = ml.threshold_trials(_split(v, 0.7), (0.10, 0.15, 0.20, 0.30), 0.30, BASE, lr)
    return spark.createDataFrame([tuple(t.values()) for t in got], TRIALS)


PK = ",".join(swings_sql(k, f"k{k}_") for k in WIDTHS) + """,
pe AS (""" + " UNION ALL ".join(f"SELECT {k} AS k, series_id, CAST(swing_high AS INT) AS label, close AS score FROM k{k}_ WHERE swing_high OR swing_low" for k in WIDTHS) + """),
pa AS (SELECT k, series_id, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc FROM (
 SELECT *, rank() OVER (PARTITION BY k, series_id ORDER BY score) + (count(*) OVER (PARTITION BY k, series_id, score) - 1) / 2.0 AS r FROM pe) GROUP BY 1, 2),
pm AS (SELECT k, avg(auc) AS mean_auc FROM pa GROUP BY 1)
;;
SELECT k, mean_auc, k = (SELECT min(k) FROM pm WHERE mean_auc >= (SELECT max(mean_auc) FROM pm) - 0.002) AS chosen FROM pm"""


@query("pivot_k_selection", "k:l mean_auc:d chosen:b", PK)
def pivot_k_selection(spark, folder):
    """Mean AUC per swing width; the smallest width within 0.002 of the best."""
    s = st.sweep(inp.bars(spark, folder).select("series_id", "pos", "high", "low", "close"), WIDTHS)
    d = s.select("k", "series_id", F.col("swing_high").cast("long").alias("label"), F.col("close").alias("score"))
    m = mt.roc_auc(d, ["k", "series_id"]).groupBy("k").agg(F.avg("auc").alias("mean_auc"))
    w = Window.partitionBy(F.lit(0))  # one row per k
    near = m.withColumn("_near", F.col("mean_auc") >= F.max("mean_auc").over(w) - 0.002)
    return near.withColumn("chosen", F.col("k") == F.min(F.when(F.col("_near"), F.col("k"))).over(w))


@query("walk_forward", "model_id fold:l n_rows:l n_runs:l ll_per_row:d mean_confidence:d aligned_mean:d mean_minutes:d")
def walk_forward(spark, folder):
    v, minutes = fold_rows(spark, folder)
    d, _ = wk.walk_forward(v, ("ret_1", "px_z", "vol_6"), 3, folds_of(v), "hourly_3", seeds=SEEDS, max_iter=WALK_ITERATIONS,
                           min_train=500, trend_cols=("ret_1", "px_z"), vol_cols=("vol_6",))
    return wk.fold_report(d, v.select("series_id", "pos", "ts", "fwd_2"), minutes)


@query("stage_a_decode", "series_id fold:l ts:t state:l confidence:d margin:d stay_prob:d duration:l log1p_duration:d left_censored:b trend_score:d trend_sign:l is_trending:b regime")
def stage_a_decode(spark, folder):
    v, _ = fold_rows(spark, folder)
    return stage_a(v)[0].join(v.select("series_id", "pos", "ts"), ["series_id", "pos"])


WALK_LOG = "fold long, seed long, n_rows long, ll double, n_iter long, converged boolean, error string, warnings long, seconds double, best boolean"


@query("walk_restart_log", "fold:l seed:l n_rows:l ll:d n_iter:l converged:b error warnings:l best:b")
def walk_restart_log(spark, folder):
    """A row per fold and restart of the walk's fits. Seconds are in the operator's log, not here: they differ between runs."""
    v, _ = fold_rows(spark, folder)
    _, _, _, log = wk.fit_folds(v, MODEL_COLS, STATES, folds_of(v), SEEDS, WALK_ITERATIONS, POOL)
    names = [c.split()[0] for c in WALK_LOG.split(", ")]
    return spark.createDataFrame([tuple(int(e[c]) if c == "warnings" else e[c] for c in names) for e in log], WALK_LOG)
