"""Walk-forward classifiers on Spark ML.

Input rows carry fold, label (0/1, null where unusable), is_trending and the feature columns; pass a
staged frame. The driver loops over folds, TOGETHER fits at a time; every fit is a row of Spark jobs, and predictions
land in one table partitioned by fold."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.blocks import stage, with_position
from ..functions.ordered import percentiles
from ..sources import stores
from .metrics import roc_auc

# Fixed values of the forest studies. Spark's trees have no minimum split size, so min_samples_split has no counterpart.
RF_GRID = {
    "RF-1": {"maxDepth": 3, "minInstancesPerNode": 100, "featureSubsetStrategy": "sqrt"},
    "RF-2": {"maxDepth": 5, "minInstancesPerNode": 100, "featureSubsetStrategy": "sqrt"},
    "RF-3": {"maxDepth": 5, "minInstancesPerNode": 250, "featureSubsetStrategy": "sqrt"},
    "RF-4": {"maxDepth": 8, "minInstancesPerNode": 100, "featureSubsetStrategy": "sqrt"},
    "RF-5": {"maxDepth": 8, "minInstancesPerNode": 250, "featureSubsetStrategy": "sqrt"},
    "RF-6": {"maxDepth": 5, "minInstancesPerNode": 100, "featureSubsetStrategy": "0.5"},
    "RF-7": {"maxDepth": 8, "minInstancesPerNode": 250, "featureSubsetStrategy": "0.5"},
}
RF_BASE = {"maxDepth": 8, "minInstancesPerNode": 50, "featureSubsetStrategy": "sqrt"}


RANGE_ROWS = 100_000
TASK_ROWS = 10_000  # a task's least share of a pool in a logistic fit; the cuts and draws of trees follow the tasks
TOGETHER = 4  # fits whose jobs run side by side; each is short of work for all cores most of the time
WRITTEN = 16  # folds whose predictions one job writes


@dataclass
class Fit:
    fold: int
    model: Model
    n_pool: int
    pos_rate: float


def class_weights(rows: DataFrame, lo: float = 0.4, hi: float = 0.6, keys=("fold",)) -> DataFrame:
    """Balanced weights only where the positive share lies outside [lo, hi], else 1."""
    g = rows.filter("label IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("pos_rate"))
    off = ~F.col("pos_rate").between(lo, hi) & (F.col("pos_rate") > 0) & (F.col("pos_rate") < 1)
    return g.withColumns({"balanced": off, "w_pos": F.when(off, 0.5 / F.when(F.col("pos_rate") > 0, F.col("pos_rate"))).otherwise(1.0),
                          "w_neg": F.when(off, 0.5 / F.when(F.col("pos_rate") < 1, 1 - F.col("pos_rate"))).otherwise(1.0)})


def assemble(rows: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(rows)


def logistic(n_weighted: float, c: float = 1.0) -> LogisticRegression:
    """Ridge with inverse strength c on the summed loss; Spark averages the loss, hence the division."""
    return LogisticRegression(labelCol="label", weightCol="weight", regParam=1.0 / (c * n_weighted), elasticNetParam=0.0,
                              standardization=False, maxIter=100)


def forest(trees: int = 300, seed: int = 42, **kw) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, seed=seed, **kw)


def boosted(rounds: int = 100, depth: int = 3, rate: float = 0.1, seed: int = 42, **kw) -> GBTClassifier:
    return GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, **kw)


def fit_pool(pool: DataFrame, features, make, lo: float = 0.4, hi: float = 0.6):
    """Fits on labelled rows with the class-weight rule. make(weighted row count) gives the estimator."""
    w = class_weights(pool.withColumn("_all", F.lit(0)), lo, hi, ("_all",)).collect()
    if not w or not 0 < w[0]["pos_rate"] < 1:
        return None, 0, None
    r = w[0]
    d = pool.filter("label IS NOT NULL").withColumn("weight", F.when(F.col("label") == 1, r["w_pos"]).otherwise(r["w_neg"]))
    d, estimator = assemble(d.withColumn("label", F.col("label").cast("double")), features), make(float(r["n"]))
    if isinstance(estimator, LogisticRegression):
        d = d.coalesce(max(1, r["n"] // TASK_ROWS))
    return estimator.fit(d), r["n"], r["pos_rate"]


def side_by_side(spark, fn, items) -> list:
    """fn of every item, in order, TOGETHER at a time from driver threads."""
    items = list(items)
    if not items:
        return []
    with ThreadPool(min(TOGETHER, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items, chunksize=1)


def predict(model, rows: DataFrame, features) -> DataFrame:
    out = model.transform(assemble(rows, features))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def training_pool(rows: DataFrame, fold: int) -> DataFrame:
    """Rows of earlier folds; if rows carry `late` (within the embargo before the next fold), those right before the fold
    are left out."""
    pool = rows.filter(F.col("fold") < fold)
    return pool.filter(~(F.col("late") & (F.col("fold") == fold - 1))) if "late" in rows.columns else pool


def walk(rows: DataFrame, features, make, folds, min_pool: int = 500, keep=("series_id", "pos", "label"), lo: float = 0.4,
         hi: float = 0.6) -> tuple[DataFrame, list[Fit]]:
    """Each fold is predicted by a model of all earlier folds' labelled rows; only trending rows are scored. Folds with too
    small a pool are left out; if all are, the predictions are an empty table."""
    spark, path = rows.sparkSession, stores.table_path(rows.sparkSession, "predictions")
    later = [f for f in folds if f > min(folds)]
    got = side_by_side(spark, lambda f: fit_pool(training_pool(rows, f), features, make, lo, hi), later)
    fits = [Fit(f, model, n, rate) for f, (model, n, rate) in zip(later, got) if model is not None and n >= min_pool]
    if not fits:
        return rows.select(*keep, F.lit(0.0).alias("score"), F.col("fold").cast("int").alias("fold")).limit(0), fits
    for i in range(0, len(fits), WRITTEN):
        p = [predict(x.model, rows.filter((F.col("fold") == x.fold) & F.col("is_trending")), features).select(
            *keep, "score", F.lit(x.fold).alias("fold")) for x in fits[i:i + WRITTEN]]
        stores.write_partitioned(reduce(DataFrame.unionByName, p), path, "fold")
    return spark.read.parquet(path), fits


def train_auc(rows: DataFrame, features, fits) -> DataFrame:
    """AUC of each fold's model on its own training pool. Scores are written, for the ranks read them twice."""
    parts = []
    for i in range(0, len(fits), WRITTEN):
        p = [predict(x.model, training_pool(rows, x.fold).filter(F.col("label").isNotNull()), features).select(
            "label", "score", F.lit(x.fold).cast("int").alias("fold")) for x in fits[i:i + WRITTEN]]
        parts.append(roc_auc(stage(reduce(DataFrame.unionByName, p)), ["fold"]).select("fold", F.col("auc").alias("train_auc")))
    return reduce(DataFrame.unionByName, parts, rows.sparkSession.createDataFrame([], "fold int, train_auc double"))


def compare(variants: dict, rows: DataFrame, make, folds, min_pool: int) -> DataFrame:
    """Pooled out-of-sample AUC for several feature lists."""
    p = [walk(rows, feats, make, folds, min_pool)[0].withColumns({"variant": F.lit(name), "n_features": F.lit(len(feats))}) for name, feats in variants.items()]
    return roc_auc(reduce(DataFrame.unionByName, p), ["variant", "n_features"])


def threshold_trials(rows: DataFrame, cuts, baseline: float, features, make, trend: str = "trend_score", move: str = "fwd_2", dead: float = 0.1,
                     least: tuple[int, int, int] = (20, 50, 20), slack: float = 0.01) -> list[dict]:
    """Is another trend threshold as good as the baseline? Judged inside the rows given, whose column inner marks the earlier part.

    Per cut: epsilon is the dead-band percentile of the inner part's trending moves, labels are of moves beyond it (1 when the move goes with
    the trend), a classifier of the inner part scores the rest. A cut is "insufficient" with fewer than least[0] moves, least[1] inner or least[2]
    other labels, or one label only. Against a sound baseline its verdict is "validates" (auc within slack, no more folds
    without trending rows), "costs auc", or "mixed". Epsilons, counts and folds of all cuts come from three jobs."""
    at = F.explode(F.array(*[F.lit(float(c)) for c in cuts]))
    size = F.abs(F.col(move))
    many = rows.withColumn("cut", at).withColumn("_on", F.coalesce(F.abs(F.col(trend)) > F.col("cut"), F.lit(False)))
    moves = many.filter(F.col("inner") & F.col("_on") & size.isNotNull()).select("cut", size.alias("_m"))
    eps = {r["cut"]: r for r in percentiles(moves, ["cut"], "_m", {"epsilon": dead}).collect()}
    eps = {c: r["epsilon"] if r["n_all"] >= least[0] else None for c, r in eps.items()}
    empty = many.groupBy("cut", "fold").agg(F.count_if("_on").alias("n")).groupBy("cut").agg(F.count_if(F.col("n") == 0).alias("n"))
    empty = {r["cut"]: r["n"] for r in empty.collect()}

    def labels(cut, epsilon):
        return F.when((F.abs(F.col(trend)) > cut) & (size > epsilon), (F.signum(move) == F.signum(trend)).cast("long"))

    known = {c: e for c, e in eps.items() if e is not None}
    each = F.coalesce(*[F.when(F.col("cut") == c, labels(c, e)) for c, e in known.items()], F.lit(None).cast("long"))
    counts = {(r["cut"], r["inner"]): r for r in many.withColumn("label", each).filter("label IS NOT NULL").groupBy("cut", "inner").agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate")).collect()} if known else {}
    out = []
    for c in map(float, cuts):
        train, val = ({"n": r["n"], "rate": r["rate"]} if (r := counts.get((c, part))) else {"n": 0, "rate": None} for part in (True, False))
        t = {"cut": c, "status": "insufficient", "n_train": train["n"], "n_val": val["n"], "epsilon": eps.get(c), "zero_folds": empty.get(c, 0), "auc": None,
             "pos_rate": val["rate"], "verdict": None}
        if train["n"] >= least[1] and val["n"] >= least[2] and 0 < train["rate"] < 1 and 0 < val["rate"] < 1:
            d = rows.withColumn("label", labels(c, known[c]))
            model, _, _ = fit_pool(d.filter("inner"), features, make, 0.0, 1.0)
            a = roc_auc(predict(model, d.filter("NOT inner AND label IS NOT NULL").withColumn("_k", F.lit(1)), features), ["_k"]).first()
            t |= {"status": "ok", "auc": a["auc"] if a else None}
        out.append(t)
    base = next((t for t in out if t["cut"] == baseline and t["status"] == "ok"), None)
    for t in out:
        if base and t is not base and t["status"] == "ok":
            fine = t["auc"] >= base["auc"] - slack
            t["verdict"] = "costs auc" if not fine else "validates" if t["zero_folds"] <= base["zero_folds"] else "mixed"
    return out


def importances(fits, features):
    """(fold, feature, importance) triples from tree models."""
    return [(x.fold, f, float(v)) for x in fits for f, v in zip(features, x.model.featureImportances.toArray())]


def coefficients(fits, features):
    return [(x.fold, f, float(v)) for x in fits for f, v in zip(features, x.model.coefficients.toArray())]


def permutation_importance(model, rows: DataFrame, features, repeats: int, key: Column, seed: int = 42) -> DataFrame:
    """Loss of AUC when one column is shuffled, for every (feature, repeat) in one set of jobs.

    A shuffle joins two row numberings of the same rows: by key, and by a hash of key, feature and
    repeat. Both numberings are computed in hash ranges, not in one task; what is read twice is written first."""
    feats = list(features)
    base = stage(rows.filter("label IS NOT NULL").select("label", *feats, F.xxhash64(key).alias("_h"), key.cast("string").alias("_id")))
    k = ["feature", "rep"]
    bits = min(24, max(1, (base.count() // RANGE_ROWS).bit_length()))  # hash ranges grow with the rows, so a range keeps its size
    coarse = lambda c: F.shiftright(c, 64 - bits)
    # the order by key is the same for every feature and repeat
    numbered = stage(with_position(base.withColumn("_k", F.lit(1)), ["_k"], ("_h", "_id"), coarse("_h"), "_p").drop("_k"))
    pairs = numbered.select("*", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("rep"))
                                                   for f in feats for r in range(repeats)])))
    pick = F.coalesce(*[F.when(F.col("feature") == f, F.col(f)) for f in feats])
    moved = pairs.select(*k, F.xxhash64("_h", "feature", "rep", F.lit(seed)).alias("_s"), "_id", pick.alias("_v"))
    b = with_position(moved, k, ("_s", "_id"), coarse("_s"), "_p").select(*k, "_p", "_v")
    mixed = pairs.join(b, [*k, "_p"]).withColumns({f: F.when(F.col("feature") == f, F.col("_v")).otherwise(F.col(f)) for f in feats})
    scored = stage(predict(model, mixed, feats).select(*k, "label", "score"))
    shuffled = roc_auc(scored, k).select(*k, F.col("auc").alias("shuffled_auc"), F.lit(1).alias("_k"))
    plain = roc_auc(predict(model, base.withColumn("_k", F.lit(1)), feats), ["_k"]).select("_k", "auc")
    d = shuffled.join(plain, "_k").withColumn("loss", F.col("auc") - F.col("shuffled_auc"))
    return d.groupBy("feature").agg(F.avg("loss").alias("mean_loss"), F.stddev_pop("loss").alias("std_loss"), F.count("loss").alias("n_repeats"))


def train_oos_gap(folds: DataFrame, keys) -> DataFrame:
    return folds.groupBy(*keys).agg(F.avg("train_auc").alias("mean_train"), F.avg("auc").alias("mean_oos"),
                                    (F.avg("train_auc") - F.avg("auc")).alias("gap"))
