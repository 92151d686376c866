"""What states mean: profiles, names, thresholds, health of a fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import three_way

CUT = 0.3


def profile(rows: DataFrame, keys, trend_cols, vol_cols) -> DataFrame:
    """Per state the mean of its scaled return columns (trend_score) and volatility columns (vol_score)."""
    avg = lambda cols: sum((F.avg(c) for c in cols[1:]), F.avg(cols[0])) / len(cols)
    return rows.groupBy(*keys, "state").agg(avg(trend_cols).alias("trend_score"), avg(vol_cols).alias("vol_score"))


def model_profile(model_rows: DataFrame, cols, trend_cols, vol_cols) -> DataFrame:
    """The same from the means stored in a model table."""
    at = lambda c: F.element_at("mean", list(cols).index(c) + 1)
    avg = lambda names: sum((at(c) for c in names[1:]), at(names[0])) / len(names)
    return model_rows.withColumns({"trend_score": avg(trend_cols), "vol_score": avg(vol_cols)})


def label(cut: float = CUT) -> Column:
    return F.concat(three_way("trend_score", cut, "Downtrend", "Ranging", "Uptrend"), F.lit(" / "),
                    three_way("vol_score", cut, "Low-Vol", "Mid-Vol", "High-Vol"))


def trend_sign(cut: float | None = None) -> Column:
    """Sign of the score, zero inside the cut when one is given."""
    s = F.signum("trend_score").cast("long")
    return s if cut is None else F.when(F.abs("trend_score") > cut, s).otherwise(0)


def is_trending(cut: float = CUT) -> Column:
    return F.abs("trend_score") > cut


def threshold_classify(profiles: DataFrame, keys, cuts) -> DataFrame:
    """Per fold and threshold the number of up, down and ranging states."""
    d = profiles.withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))
    s = F.col("trend_score")
    g = d.groupBy(*keys, "cut").agg(F.count_if(s > F.col("cut")).alias("n_up"), F.count_if(s < -F.col("cut")).alias("n_down"),
                                    F.count_if(F.abs(s) <= F.col("cut")).alias("n_ranging"))
    return g.withColumn("zero_eligible", (F.col("n_up") + F.col("n_down")) == 0)


def recovering_threshold(classified: DataFrame, keys) -> DataFrame:
    """The strongest threshold under which a fold has a trending state."""
    return classified.groupBy(*keys).agg(F.max(F.when(~F.col("zero_eligible"), F.col("cut"))).alias("recovered_at"))


def adaptive_threshold(profiles: DataFrame, keys, normal: float = 0.30, fallback: float = 0.15) -> DataFrame:
    """Folds without a trending state at the normal threshold use the fallback."""
    none = profiles.groupBy(*keys).agg((F.count_if(is_trending(normal)) == 0).alias("none_trending"))
    return none.withColumn("threshold", F.when(F.col("none_trending"), fallback).otherwise(normal))


def scores_wide(profiles: DataFrame, keys, k: int) -> DataFrame:
    """One column per state, null where a fold lacks it."""
    p = profiles.groupBy(*keys).pivot("state", list(range(k))).agg(F.first("trend_score"))
    return p.select(*keys, *[F.col(str(s)).alias(f"score_{s}") for s in range(k)])


def bic(ll: str, n: str, k: int, f: int) -> Column:
    """k states with f features: starts, transitions, means and variances (rough count)."""
    free = k * k + 2 * k * f
    return -2 * F.col(ll) + free * F.log(F.col(n))


def restart_spread(log: DataFrame, keys) -> DataFrame:
    """Range of likelihoods over restarts, also relative to the best; converged and failed counts."""
    ok = F.col("error").isNull()
    best, worst = F.max(F.when(ok, F.col("ll"))), F.min(F.when(ok, F.col("ll")))
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_restarts"), best.alias("best_ll"), (best - worst).alias("spread"),
        ((best - worst) / F.when(F.abs(best) != 0, F.abs(best))).alias("spread_normalized"),
        F.count_if(ok & F.col("converged")).alias("n_converged"), F.count_if(~ok).alias("n_failed"))


def health_flags(rows: DataFrame, log_summary: DataFrame, keys, k: int, var_cols=(), floor: float = 1e-8) -> DataFrame:
    """Reasons to distrust a fit, as an array of names, per key.

    rows: decoded rows (state, regime, confidence and the columns whose in-state variance is checked)."""
    per = rows.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("_n"), F.least(*[F.var_pop(c) for c in var_cols]).alias("_v"),
                                           F.collect_set(F.split("regime", " / ")[0]).alias("_t"),
                                           F.count_if(F.col("confidence").isNull() | F.isnan("confidence")).alias("_bad"))
    g = per.groupBy(*keys).agg((F.max("_n") / F.sum("_n")).alias("_max"), F.count(F.lit(1)).alias("_seen"), F.min("_v").alias("_v"),
                               F.array_distinct(F.flatten(F.collect_list("_t"))).alias("_t"), F.sum("_bad").alias("_bad"))
    g = g.join(log_summary, list(keys), "left")
    has = lambda name: F.array_contains("_t", name)
    flags = F.array_compact(F.array(
        F.when(F.col("_max") > 0.95, "one_state_domination"), F.when(F.col("_seen") < k, "missing_states"),
        F.when(F.col("n_failed") > 0, "restart_failures"), F.when(F.col("n_converged") < F.col("n_restarts"), "non_converged_restarts"),
        F.when(F.col("_v") < floor, "covariance_collapse"), F.when(~has("Uptrend"), "no_uptrend_state"),
        F.when(~has("Downtrend"), "no_downtrend_state"), F.when(~has("Ranging"), "no_ranging_state"),
        F.when(F.col("_bad") > 0, "nan_or_inf_confidence")))
    return g.select(*keys, flags.alias("flags"))
