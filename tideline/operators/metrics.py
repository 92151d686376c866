"""Exact, tie-aware classifier metrics and rank statistics. Each key's rows are reduced to distinct
scores before anything is ordered."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.blocks import lookup
from ..functions.columns import safe_div
from ..functions.ordered import percentiles, ranked

POS, NEG = "label = 1", "label = 0"


def _counts() -> dict[str, Column]:
    return {"p": F.count_if(F.expr(POS)), "q": F.count_if(F.expr(NEG))}


def roc_auc(rows: DataFrame, keys, score: str = "score") -> DataFrame:
    """Share of (positive, negative) pairs ordered correctly, ties half; null with one class only."""
    return auc_of(ranked(rows.filter("label IS NOT NULL"), keys, score, _counts()), keys)


def auc_of(r: DataFrame, keys) -> DataFrame:
    """AUC from positives p and negatives q per distinct score, with q_before, p_all and q_all."""
    won = F.sum(F.col("p").cast("double") * (F.col("q_before") + F.col("q") / 2))
    return r.groupBy(*keys).agg(F.max("p_all").alias("n_pos"), F.max("q_all").alias("n_neg"), won.alias("_w")).withColumn(
        "auc", safe_div("_w", F.col("n_pos").cast("double") * F.col("n_neg"))).drop("_w")


def average_precision(rows: DataFrame, keys, score: str = "score") -> DataFrame:
    """Step rule: sum over falling thresholds of recall gained times precision there."""
    r = ranked(rows.filter("label IS NOT NULL"), keys, score, _counts(), reverse=True)
    tp, fp = F.col("p_before") + F.col("p"), F.col("q_before") + F.col("q")
    return r.groupBy(*keys).agg(F.sum(safe_div("p", "p_all") * tp / (tp + fp)).alias("average_precision"))


def losses(rows: DataFrame, keys, score: str = "score", eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.least(F.col(score), F.lit(1 - eps)), F.lit(eps))
    ll = -F.when(F.expr(POS), F.log(p)).otherwise(F.log(1 - p))
    return rows.filter("label IS NOT NULL").groupBy(*keys).agg(
        F.avg(ll).alias("log_loss"), F.avg((F.col(score) - F.col("label")) ** 2).alias("brier"))


def _zero(a, b) -> Column:
    return F.coalesce(safe_div(a, b), F.lit(0.0))


def classification(rows: DataFrame, keys, predicted: Column) -> DataFrame:
    """2x2 counts and the measures from them; a zero denominator gives 0."""
    d = rows.filter("label IS NOT NULL").withColumn("_y", predicted)
    g = d.groupBy(*keys).agg(F.count_if(F.expr("_y AND label = 1")).alias("tp"), F.count_if(F.expr("_y AND label = 0")).alias("fp"),
                             F.count_if(F.expr("NOT _y AND label = 1")).alias("fn"), F.count_if(F.expr("NOT _y AND label = 0")).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return g.withColumns({
        "accuracy": (tp + tn) / n, "precision": _zero(tp, tp + fp), "recall": _zero(tp, tp + fn),
        "f1": _zero(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (_zero(tp, tp + fn) + _zero(tn, tn + fp)) / 2,
        "pass_rate": (tp + fp) / n, "block_rate": (fn + tn) / n})


def bucket_edges(rows: DataFrame, keys, x: str, n: int) -> DataFrame:
    """Edges of n equal-count buckets, duplicates dropped."""
    p = percentiles(rows, keys, x, {f"_e{i}": i / n for i in range(n + 1)})
    return p.select(*keys, F.array_distinct(F.array(*[f"_e{i}" for i in range(n + 1)])).alias("edges"))


def quantile_bucket(rows: DataFrame, keys, x: str, n: int) -> DataFrame:
    """Adds bucket (from 0): intervals closed on the right, the first on both sides."""
    d = lookup(rows, bucket_edges(rows, keys, x, n), keys)
    below = F.size(F.filter("edges", lambda e: e < F.col(x)))
    return d.withColumn("bucket", F.when(F.col(x).isNotNull(), F.greatest(below - 1, F.lit(0))).cast("long")).drop("edges")


def table_agreement(a: DataFrame, b: DataFrame, keys, at: str, label: str) -> DataFrame:
    """Two labellings of possibly different rows, compared on the times that both have. Per key: rows of each table, common rows, rows of one table
    only, the common share of the larger table, and the share of common rows with equal labels (null without common rows). A null label
    agrees with nothing. Each table holds a time once."""
    side = lambda d, n: d.select(*keys, at, F.lit(True).alias(f"_in_{n}"), F.col(label).alias(f"_l_{n}"))
    d = side(a, "a").join(side(b, "b"), [*keys, at], "full")
    in_a, in_b = (F.coalesce(F.col(f"_in_{n}"), F.lit(False)) for n in "ab")
    same = F.coalesce(F.col("_l_a") == F.col("_l_b"), F.lit(False)).cast("double")
    g = d.groupBy(*keys).agg(F.count_if(in_a).alias("n_a"), F.count_if(in_b).alias("n_b"), F.count_if(in_a & in_b).alias("n_common"),
                             (F.avg(F.when(in_a & in_b, same)) * 100).alias("agree_pct"))
    return g.withColumns({"only_a": F.col("n_a") - F.col("n_common"), "only_b": F.col("n_b") - F.col("n_common"),
                          "common_pct": F.col("n_common") * 100 / F.greatest("n_a", "n_b")})


def calibration(rows: DataFrame, keys, score: str = "score", n: int = 10) -> DataFrame:
    b = quantile_bucket(rows.filter("label IS NOT NULL"), keys, score, n)
    return b.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_predicted"),
                                          F.avg(F.col("label").cast("double")).alias("realised"))


def at_cutoffs(rows: DataFrame, keys, cuts, score: str = "score") -> DataFrame:
    """Signals, hit rate and recall at fixed cut-offs; each row meets the fixed list once."""
    d = rows.filter("label IS NOT NULL").withColumn("cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))
    on = F.col(score) >= F.col("cutoff")
    g = d.groupBy(*keys, "cutoff").agg(F.count_if(on).alias("n_signals"), F.count_if(on & F.expr(POS)).alias("_tp"),
                                       F.count_if(F.expr(POS)).alias("_p"))
    return g.withColumns({"hit_rate": safe_div("_tp", "n_signals"), "recall": _zero("_tp", "_p"),
                          "f1": _zero(2 * F.col("_tp"), F.col("n_signals") + F.col("_p"))}).drop("_tp", "_p")


def best_cutoff(sweep: DataFrame, keys) -> DataFrame:
    """Cut-off with the highest F1; ties go to the largest cut-off."""
    return sweep.groupBy(*keys).agg(F.max_by(F.struct("cutoff", "f1"), F.struct(F.round("f1", 9), "cutoff")).alias("_b")).select(
        *keys, "_b.cutoff", "_b.f1")


def kruskal(rows: DataFrame, keys, group: str, x: str, min_rows: int = 10) -> DataFrame:
    """Tie-corrected rank statistic across groups, from counts per distinct value."""
    d = rows.filter(F.col(x).isNotNull())
    big = d.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_g")).filter(F.col("_g") > min_rows).drop("_g")
    d = lookup(d, big, [*keys, group])
    per = d.groupBy(*keys, group, x).agg(F.count(F.lit(1)).alias("m"))
    r = ranked(d, keys, x, {"n": F.count(F.lit(1))})
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    ties = r.groupBy(*keys).agg(F.max("n_all").alias("_N"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("_t"))
    sums = per.join(r.select(*keys, x, rank.alias("_rank")), [*keys, x]).groupBy(*keys, group).agg(
        F.sum(F.col("m") * F.col("_rank")).alias("_R"), F.sum("m").alias("_m"))
    s = sums.groupBy(*keys).agg(F.sum(F.col("_R") ** 2 / F.col("_m")).alias("_S"), F.count(F.lit(1)).alias("n_groups"))
    n = F.col("_N").cast("double")
    h = (12 / (n * (n + 1)) * F.col("_S") - 3 * (n + 1)) / (1 - F.col("_t") / (n ** 3 - n))
    return s.join(ties, list(keys)).filter("n_groups >= 2").select(*keys, "n_groups", F.col("_N").alias("n"), h.alias("h_stat"))


def chi2_tail(h: float, df: int) -> float:
    """Upper tail of the chi-square distribution by its incomplete-gamma series; driver side, one number."""
    a, x = df / 2, h / 2
    if x <= 0:
        return 1.0
    term = total = 1 / a
    for i in range(1, 2000):
        term *= x / (a + i)
        total += term
        if term < total * 1e-15:
            break
    return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def adjusted_rand(pairs: DataFrame, keys, a: str, b: str) -> DataFrame:
    """Agreement of two labelings up to renaming, from the contingency table."""
    c = pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    nij = c.groupBy(*keys).agg(F.sum(two(F.col("n"))).alias("_ij"), F.sum("n").alias("_n"))
    side = lambda s, o: c.groupBy(*keys, s).agg(F.sum("n").alias("_m")).groupBy(*keys).agg(F.sum(two(F.col("_m"))).alias(o))
    j = nij.join(side(a, "_a"), list(keys)).join(side(b, "_b"), list(keys))
    expected = safe_div(F.col("_a") * F.col("_b"), two(F.col("_n")))
    return j.select(*keys, F.col("_n").cast("long").alias("n"), safe_div(
        F.col("_ij") - expected, (F.col("_a") + F.col("_b")) / 2 - expected).alias("ari"))


def effect_size(rows: DataFrame, keys, in_first: Column, x: str) -> DataFrame:
    """Differences of two groups and the standardised difference with pooled deviation."""
    d = rows.filter(F.col(x).isNotNull()).withColumn("_f", in_first).filter("_f IS NOT NULL")
    med = percentiles(d, [*keys, "_f"], x, {"median": 0.5}).groupBy(*keys).agg(
        F.max(F.when(F.col("_f"), F.col("median"))).alias("_m1"), F.max(F.when(~F.col("_f"), F.col("median"))).alias("_m2"))
    one, two = F.when(F.col("_f"), F.col(x)), F.when(~F.col("_f"), F.col(x))
    g = d.groupBy(*keys).agg(F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("mean1"), F.avg(two).alias("mean2"),
                             F.var_samp(one).alias("_v1"), F.var_samp(two).alias("_v2"),
                             F.avg((one > 0).cast("double")).alias("_p1"), F.avg((two > 0).cast("double")).alias("_p2"))
    pooled = F.sqrt(safe_div((F.col("n1") - 1) * F.col("_v1") + (F.col("n2") - 1) * F.col("_v2"), F.col("n1") + F.col("n2") - 2))
    return g.join(med, list(keys)).select(
        *keys, "n1", "n2", "mean1", "mean2", (F.col("mean1") - F.col("mean2")).alias("mean_diff"),
        (F.col("_m1") - F.col("_m2")).alias("median_diff"), (F.col("_p1") - F.col("_p2")).alias("positive_diff"),
        safe_div(F.col("mean1") - F.col("mean2"), pooled).alias("cohens_d"))
