"""Winsorising and standardising, always fitted on one frame and applied to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.blocks import lookup
from ..functions.columns import clip
from ..functions.ordered import long_form, percentiles

KEYS = ("series_id",)


def winsor_fit(df: DataFrame, cols, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Exact linear quantiles of several columns in one pass; one row per series."""
    p = percentiles(long_form(df, KEYS, cols), ("series_id", "feature"), "value", {"lo": low, "hi": high})
    pick = lambda c, o: F.max(F.when(F.col("feature") == c, F.col(o))).alias(f"{c}_{o}")
    return p.groupBy("series_id").agg(*[pick(c, o) for c in cols for o in ("lo", "hi")])


def winsor_apply(df: DataFrame, bounds: DataFrame, cols) -> DataFrame:
    j = lookup(df, bounds, KEYS, "left")
    return j.withColumns({c: clip(c, f"{c}_lo", f"{c}_hi") for c in cols}).drop(*[f"{c}_{o}" for c in cols for o in ("lo", "hi")])


def scaler_fit(df: DataFrame, cols, keys=KEYS) -> DataFrame:
    """Mean and population deviation; a zero deviation becomes 1."""
    aggs = []
    for c in cols:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"{c}_sd")]
    return df.groupBy(*keys).agg(*aggs)


def scaler_apply(df: DataFrame, scaler: DataFrame, cols, keys=KEYS) -> DataFrame:
    j = lookup(df, scaler, keys)
    return j.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in cols}).drop(
        *[f"{c}_{o}" for c in cols for o in ("mean", "sd")])


def expanding_scalers(df: DataFrame, cols, fold: str = "fold") -> DataFrame:
    """Scaler of every expanding fold (rows of all earlier folds), from per-fold sums in one pass.

    Sums are taken around the per-series mean so that the variance does not cancel."""
    centre = df.groupBy(*KEYS).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    d = lookup(df, centre, KEYS)
    aggs = [F.count(F.lit(1)).alias("_n"), *[F.max(f"_m_{c}").alias(f"_m_{c}") for c in cols]]
    for c in cols:
        x = F.col(c) - F.col(f"_m_{c}")
        aggs += [F.sum(x).alias(f"_s_{c}"), F.sum(x * x).alias(f"_q_{c}")]
    per = d.groupBy(*KEYS, fold).agg(*aggs)
    w = Window.partitionBy(*KEYS).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("_n").over(w)
    out = {"n_train": n}
    for c in cols:
        mean = F.sum(f"_s_{c}").over(w) / n
        sd = F.sqrt(F.greatest(F.sum(f"_q_{c}").over(w) / n - mean * mean, F.lit(0.0)))
        out[f"{c}_mean"] = mean + F.col(f"_m_{c}")
        out[f"{c}_sd"] = F.when(sd == 0, 1.0).otherwise(sd)
    return per.withColumns(out).filter("n_train > 0").select(*KEYS, fold, *out)
