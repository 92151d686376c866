"""Forward-looking labels and the walk that freezes their thresholds fold by fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.blocks import lookup
from ..functions.columns import col, safe_div
from ..functions.growing import walk_percentiles
from ..functions.ordered import percentiles


def aligned(forward: str, sign: str = "trend_sign") -> Column:
    """Forward return in the direction of the trend, null without a trend."""
    return F.when(F.col(sign) != 0, F.col(sign) * F.col(forward))


def deadband(rows: DataFrame, forward: str, p: float = 0.10, keys=()) -> DataFrame:
    """Epsilon: a low percentile of the absolute forward return."""
    d = rows.withColumn("_m", F.abs(forward)).withColumn("_all", F.lit(0))
    k = list(keys) or ["_all"]
    return percentiles(d, k, "_m", {"epsilon": p}).drop("n_all", *([] if keys else ["_all"]))


def persistence(rows: DataFrame, forward: str, epsilon: Column) -> DataFrame:
    """usable and label: 1 when the forward move has the trend's sign, null unless usable."""
    usable = F.coalesce(F.col("is_trending") & (F.abs(forward) > epsilon), F.lit(False))
    return rows.withColumn("usable", usable).withColumn(
        "label", F.when(F.col("usable"), (F.signum(forward) == F.col("trend_sign")).cast("long")))


def vol_adjusted(rows: DataFrame, forward: str, vol: str, k: Column) -> DataFrame:
    """Label on the move divided by past volatility."""
    d = rows.withColumn("norm_move", safe_div(forward, vol))
    usable = F.coalesce(F.col("is_trending") & (F.abs("norm_move") > k), F.lit(False))
    return d.withColumn("usable", usable).withColumn(
        "label", F.when(F.col("usable"), (F.signum("norm_move") == F.col("trend_sign")).cast("long")))


def adaptive(rows: DataFrame, forward: str, vol: str, k: float) -> DataFrame:
    """1 when the trend-aligned move exceeds k volatilities."""
    d = rows.withColumn("norm_move", safe_div(aligned(forward), vol))
    return d.withColumn("label", F.when(F.col("norm_move").isNotNull(), (F.col("norm_move") > k).cast("long")))


def frozen_epsilon(rows: DataFrame, forward: str, folds: list[int], min_pool: int, p: float = 0.10,
                   pool: str = "usable", min_own: int = 10):
    """Fold by fold: epsilon from earlier rows, labels frozen, then the fold joins the pool.

    pool="usable" takes rows that passed their own fold's epsilon; pool="eligible" takes all trending rows with a forward value.
    Folds with too small a pool use their own rows and are flagged bootstrap. One scan counts the distinct moves of
    all folds, another writes the labels; between them the walk reads only counts (see functions/growing), so scans and jobs do not
    follow the number of folds. Returns (labelled rows, list of fold facts)."""
    eligible = rows.filter(F.col("is_trending") & F.col(forward).isNotNull())
    facts = walk_percentiles(eligible.select(F.col("fold").alias("group"), F.abs(F.col(forward)).alias("x")), list(folds), p, min_pool,
                             min_own, frozen=pool == "usable")
    kept = [c for c in rows.columns if c not in ("epsilon", "bootstrap")]
    told = rows.sparkSession.createDataFrame([(e["fold"], e["epsilon"], e["bootstrap"]) for e in facts], "fold long, epsilon double, bootstrap boolean")
    d = rows.select(*kept).join(F.broadcast(told), "fold").select(*kept, "epsilon", "bootstrap")  # one row per fold
    return persistence(d, forward, F.col("epsilon")), facts


def target_variants(rows: DataFrame, forward: str, vol: str, epsilon: DataFrame, keys=("series_id",)) -> DataFrame:
    """Shares of positive, negative and excluded rows under several target definitions.

    ``epsilon`` has one row per key with epsilon and q75 (of the absolute move)."""
    d = lookup(rows, epsilon, keys).withColumn("a", aligned(forward)).filter("a IS NOT NULL")
    norm = safe_div("a", vol)
    defs = {"direction": (F.col("a") > 0, F.col("a") <= 0), "epsilon": (F.col("a") > F.col("epsilon"), F.col("a") < -F.col("epsilon")),
            "large_move": (F.col("a") > F.col("q75"), F.col("a") < -F.col("q75")),
            "failure": (F.lit(False), F.col("a") < -F.col("epsilon"))}
    for k in (0.5, 1.0, 1.5, 2.0):
        defs[f"vol_{k}"] = (norm > k, norm < -k)
    rowsets = F.array(*[F.struct(F.lit(n).alias("target"), p.alias("up"), q.alias("down")) for n, (p, q) in defs.items()])
    e = d.select(*keys, F.inline(rowsets))
    pct = lambda c: F.avg(F.coalesce(col(c), F.lit(False)).cast("double")) * 100
    out = ~F.coalesce(F.col("up"), F.lit(False)) & ~F.coalesce(F.col("down"), F.lit(False))
    return e.groupBy(*keys, "target").agg(F.count(F.lit(1)).alias("n"), pct("up").alias("positive_pct"),
                                          pct("down").alias("negative_pct"), pct(out).alias("excluded_pct"))


def label_distribution(rows: DataFrame, by) -> DataFrame:
    """Counts, positive share and coverage of a 0/1 label that is null where unusable."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("n_labelled"), F.count_if(F.col("label") == 1).alias("n_positive"),
        (F.avg("label") * 100).alias("positive_pct"), (F.count("label") / F.count(F.lit(1)) * 100).alias("coverage_pct"))


def common_rows(rows: DataFrame, scores) -> DataFrame:
    """Rows where every model has a prediction."""
    ok = F.lit(True)
    for s in scores:
        ok = ok & F.col(s).isNotNull()
    return rows.filter(ok)
