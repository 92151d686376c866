"""Walk-forward studies: for each fold fit on the past, decode or predict the fold, store, summarise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.blocks import lookup, stage
from ..functions.lattice import Model
from ..sources import stores
from . import gaps, hmm, seeding as sd, states as ss


DECODED = ("series_id string, pos long, state long, regime string, trend_sign long, confidence double, gain double, "
           "model_id string, fold int")


def moment_model(rows: DataFrame, cols, base: Model) -> Model:
    """A model whose means and variances are the moments of given states on these rows (k x F numbers)."""
    aggs = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("v", F.var_pop))]
    got = {r["state"]: r for r in rows.groupBy("state").agg(*aggs).collect()}
    mean, var = base.mean.copy(), base.var.copy()
    for s, r in got.items():
        for i, c in enumerate(cols):
            mean[s, i] = r[f"m_{c}"]
            var[s, i] = max(r[f"v_{c}"] or 0.0, 1e-3)
    return Model(base.start, base.trans, mean, var)


CONTEXT = 500  # slots before a fold that its decode may look back on
STAGE_A = ("series_id string, fold int, pos long, state long, confidence double, margin double, stay_prob double, duration long, log1p_duration double, "
           "left_censored boolean, trend_score double, trend_sign long, is_trending boolean, regime string, gain double")


def fold_moments(rows: DataFrame, cols) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Of every fold the rows, means and deviations of all it may train on: merged from one row per (fold, late)."""
    cols = list(cols)
    late = F.col("late") if "late" in rows.columns else F.lit(False)
    aggs = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("v", F.var_pop))]
    got = rows.groupBy("fold", late.alias("late")).agg(F.count(F.lit(1)).alias("n"), *aggs).collect()  # two rows a fold
    part = {(r["fold"], r["late"]): (r["n"], np.array([r[f"m_{c}"] for c in cols], float), np.array([r[f"v_{c}"] for c in cols], float)) for r in got}

    def merged(a, b):
        n = a[0] + b[0]
        off = b[1] - a[1]
        return n, a[1] + off * b[0] / n, (a[0] * a[2] + b[0] * b[2] + off * off * a[0] * b[0] / n) / n

    out, whole = {}, None
    for f in sorted({f for f, _ in part}):
        out.setdefault(f, whole)  # where the fold right before has no rows
        here = [part[f, x] for x in (False, True) if (f, x) in part]
        # the fold right after leaves this fold's late rows out; later ones take them
        early = part.get((f, False))
        after = whole if early is None else early if whole is None else merged(whole, early)
        out[f + 1] = after
        for p in here:
            whole = p if whole is None else merged(whole, p)
    folds = {f for f, _ in part}
    blank = (0, np.zeros(len(cols)), np.ones(len(cols)))
    return {f: (m[0], m[1], np.where(m[2] > 0, np.sqrt(m[2]), 1.0)) if m else blank for f, m in out.items() if f in folds}


def fit_folds(rows: DataFrame, cols, k: int, folds: list[int], seeds=(1, 2, 3, 4, 5), max_iter: int = 100, min_train: int = 500, min_test: int = 5,
              size: int | None = None) -> tuple[dict[int, Model], dict[int, sd.View], list[dict], list[dict]]:
    """Models of all folds, each of the rows before it, from one set of jobs: rows are packed once and every (fold, seed) sees its own part
    of each chunk, scaled by its own moments. Rows marked late (within the embargo before the fold) don't train.

    ``rows`` must be staged; folds follow time. Returns models and views by fold, a record per fold (skipped ones included) and a log
    entry per (fold, seed)."""
    cols = list(cols)
    held = rows if "late" in rows.columns else rows.withColumn("late", F.lit(False))
    moments = fold_moments(held, cols)
    tests = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    facts, views = [], {}
    for f in folds:
        n, mean, sd_ = moments.get(f, (0, None, None))
        facts.append({"fold": f, "status": "ok", "n_train": n, "n_test": tests.get(f, 0)})
        if n < max(min_train, k) or tests.get(f, 0) < min_test:
            facts[-1]["status"] = "skipped"
        else:
            views[f] = sd.View(f, tuple(mean.tolist()), tuple(sd_.tolist()))
    jobs = {len(seeds) * j + s: sd.Job(seed, views[f]) for j, f in enumerate(views) for s, seed in enumerate(seeds)}
    if not jobs:
        return {}, {}, facts, []
    packed = hmm.pack(held.select("series_id", "pos", *cols, F.col("fold").cast("long"), "late"), cols, size=size, extra=("fold", "late"), fits=len(jobs))
    models, log = hmm.fit_many(packed, cols, k, jobs, max_iter)
    chosen, entries = {}, []
    for f, view in views.items():
        own = {i: log[i] for i, j in jobs.items() if j.view == view}
        best = hmm.best_of(own)
        entries += [e | {"fold": f, "best": i == best} for i, e in own.items()]
        fact = next(x for x in facts if x["fold"] == f)
        if best is None:
            fact["status"] = "failed"
            continue
        chosen[f] = models[best]
        fact |= {"train_ll": log[best]["ll"], "best_seed": log[best]["seed"], "n_converged": sum(e["converged"] for e in own.values()),
                 "n_failed": sum(e["error"] is not None for e in own.values())}
    return chosen, views, facts, entries


def with_context(rows: DataFrame, folds: list[int], context: int = CONTEXT) -> DataFrame:
    """Every row once for its own fold and once for each later fold that begins within `context` slots of it; `own` tells them apart.
    A row is copied as often as folds begin within the context, not once per later fold."""
    begin = rows.filter(F.col("fold").isin(folds)).groupBy("series_id", "fold").agg(F.min("pos").alias("first"))
    begin = begin.groupBy("series_id").agg(F.collect_list(F.struct("fold", "first")).alias("begins"))  # an entry per fold
    near = lambda b: (b["fold"] == F.col("fold")) | ((b["first"] > F.col("pos")) & (b["first"] - context <= F.col("pos")))
    to = lookup(rows, begin, ("series_id",)).withColumn("to", F.explode(F.transform(F.filter("begins", near), lambda b: b["fold"])))
    return to.withColumn("own", F.col("to") == F.col("fold")).drop("begins", "fold").withColumnRenamed("to", "fold")


def scaled_folds(rows: DataFrame, cols, views: dict[int, sd.View], folds: list[int], context: int) -> DataFrame:
    """The rows that each fold's model reads, scaled as that model was, written once."""
    d = with_context(rows.select("series_id", "pos", F.col("fold").cast("int"), *cols), folds, context).filter(F.col("fold").isin(folds))
    names = ["fold int", *[f"m{i} double" for i in range(len(cols))], *[f"s{i} double" for i in range(len(cols))]]
    scale = rows.sparkSession.createDataFrame([(f, *views[f].shift, *views[f].scale) for f in folds], ", ".join(names))
    d = d.join(F.broadcast(scale), "fold")  # a row per fold
    return stage(d.select("series_id", "fold", "pos", "own", *[((F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(c) for i, c in enumerate(cols)]))


def state_names(spark, models: dict[int, Model], cols, trend_cols, vol_cols) -> DataFrame:
    """Per (fold, state): odds to stay, trend score, sign and name."""
    rows = [(str(f), s, float(m.start[s]), m.trans[s].tolist(), m.mean[s].tolist(), m.var[s].tolist()) for f, m in models.items() for s in range(m.k)]
    named = ss.model_profile(spark.createDataFrame(rows, hmm.MODEL_SCHEMA), cols, trend_cols, vol_cols)
    return named.select(F.col("model_id").cast("int").alias("fold"), "state", F.element_at("trans", (F.col("state") + 1).cast("int")).alias("stay_prob"), "trend_score",
                        ss.trend_sign(ss.CUT).alias("trend_sign"), ss.is_trending().alias("is_trending"), ss.label().alias("regime"))


def decode_folds(rows: DataFrame, cols, models: dict[int, Model], views: dict[int, sd.View], trend_cols, vol_cols, context: int = CONTEXT,
                 size: int | None = None) -> DataFrame:
    """Every row of a fold with a model, read causally by that model after at most `context` slots before the fold, and what
    a classifier takes from it: confidence, margin, odds to stay, running duration. One pass over all folds."""
    spark, cols = rows.sparkSession, list(cols)
    if not models:
        return spark.createDataFrame([], STAGE_A)
    key = ("series_id", "fold")
    d = scaled_folds(rows, cols, views, sorted(models), context)
    read = stage(hmm.decode(d, cols, models, ("causal", "score"), keys=key, size=size).join(d.select(*key, "pos", "own"), [*key, "pos"]))
    # runs are marked within (series, fold): the context belongs to the fold that looks back on it
    marked = gaps.mark_runs(read.withColumns({"_series": F.col("series_id"), "series_id": F.struct(*key), "state": F.col("cstate")}))
    duration = gaps.running_duration(None)
    names = state_names(spark, models, cols, trend_cols, vol_cols)
    out = marked.filter("own").join(F.broadcast(names), ["fold", "state"])  # k rows a fold
    return out.select(F.col("_series").alias("series_id"), "fold", "pos", "state", hmm.confidence().alias("confidence"), hmm.margin().alias("margin"),
                      "stay_prob", duration.alias("duration"), F.log1p(duration).alias("log1p_duration"), gaps.left_censored().alias("left_censored"),
                      "trend_score", "trend_sign", "is_trending", "regime", "gain")


def walk_forward(rows: DataFrame, cols, k: int, folds: list[int], model_id: str, seeds=(1, 2), max_iter: int = 5,
                 min_train: int = 500, min_test: int = 5, trend_cols=(), vol_cols=()) -> tuple[DataFrame, list[dict]]:
    """All folds fitted on their past (fit_folds), then each fold's rows read as a whole: best path and smoothed confidence, all folds in one
    pass. Decoded rows go to one table partitioned by fold.

    ``rows`` must be staged. Returns the decoded table and one record per fold (skipped ones included)."""
    spark, cols = rows.sparkSession, list(cols)
    models, views, facts, _ = fit_folds(rows, cols, k, folds, seeds, max_iter, min_train, min_test)
    if not models:
        return spark.createDataFrame([], DECODED), facts
    d = hmm.decode(scaled_folds(rows, cols, views, sorted(models), 0), cols, models, ("path", "smooth", "score"), keys=("series_id", "fold"))
    names = state_names(spark, models, cols, trend_cols or cols[:1], vol_cols or cols[-1:])
    out = d.join(F.broadcast(names.withColumnRenamed("state", "vstate")), ["fold", "vstate"]).select(  # k rows a fold
        "series_id", "pos", F.col("vstate").alias("state"), "regime", "trend_sign", hmm.confidence("spost", "vstate").alias("confidence"), "gain",
        F.lit(model_id).alias("model_id"), "fold")
    path = stores.table_path(spark, "walk")
    stores.write_partitioned(out, path, "fold")
    return spark.read.parquet(path), facts


def fold_report(decoded: DataFrame, times: DataFrame, minutes: int) -> DataFrame:
    """Per fold: rows, runs, mean run length, likelihood per row and mean forward return in trend direction."""
    d = stage(decoded.join(times, ["series_id", "pos"]))
    m = gaps.mark_runs(d)
    g = m.groupBy("model_id", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("new_run").alias("n_runs"), F.avg("gain").alias("ll_per_row"),
        F.avg("confidence").alias("mean_confidence"), F.avg(F.when(F.col("trend_sign") != 0, F.col("trend_sign") * F.col("fwd_2"))).alias("aligned_mean"))
    return g.withColumn("mean_minutes", F.col("n_rows") / F.col("n_runs") * minutes)
