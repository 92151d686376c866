"""Checks that look at data; each returns check_name, n_checked, n_violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _report(name: str, rows: DataFrame, bad: Column) -> DataFrame:
    return rows.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("n_checked"),
                    F.coalesce(F.count_if(bad), F.lit(0)).alias("n_violations"))


def fold_order(rows: DataFrame, embargo: str, week0: str = "2024-01-08 00:00:00") -> DataFrame:
    """Training ends before the first test row, and no earlier fold's row is later than a fold's start."""
    f = rows.groupBy("fold").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    w = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # one row per fold
    f = f.withColumn("_pool", F.max("last_ts").over(w))
    end = F.expr(f"timestampadd(DAY, cast(7 * fold as int), TIMESTAMP_NTZ'{week0}') - INTERVAL {embargo}")
    return _report("train_before_test", f.filter("fold >= 0"), end >= F.col("first_ts")).unionByName(
        _report("pool_before_fold", f.filter("_pool IS NOT NULL"), F.col("_pool") >= F.col("first_ts")))


def label_needs_forward(rows: DataFrame, forward: str) -> DataFrame:
    return _report("label_has_forward", rows.filter("usable"), F.col(forward).isNull())


def volatility_recomputed(rows: DataFrame, x: str, vol: str, n: int) -> DataFrame:
    """Recomputes rolling deviations by an independent route: a join on the n slot numbers."""
    picked = rows.filter(F.col(vol).isNotNull()).select("series_id", F.col("pos").alias("_at"), F.col(vol).alias("_v"))
    need = picked.withColumn("pos", F.explode(F.sequence(F.col("_at") - (n - 1), F.col("_at"))))
    again = need.join(rows.select("series_id", "pos", x), ["series_id", "pos"]).groupBy("series_id", "_at", "_v").agg(
        F.stddev_samp(x).alias("_r"), F.count(x).alias("_n"))
    return _report("volatility_recomputed", again, (F.col("_n") != n) | (F.abs(F.col("_r") - F.col("_v")) > 1e-6 * F.abs("_v")))
