"""Walk-forward folds, slices and splits. Fold lists are calendar-sized."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.blocks import lookup, with_position


def _monthly(last: DataFrame, start: str, warmup: int, embargo: str) -> DataFrame:
    s = F.lit(start).cast("timestamp_ntz")
    first = F.expr(f"TIMESTAMP_NTZ'{start}' + INTERVAL '{warmup}' MONTH")
    k = F.posexplode(F.sequence(F.date_trunc("month", first).cast("date"), F.date_trunc("month", "last_ts").cast("date"),
                                F.expr("INTERVAL 1 MONTH"))).alias("fold_id", "_d")
    f = last.filter(F.col("last_ts") >= first).select("last_ts", s.alias("train_start"), k)
    test_start = F.col("_d").cast("timestamp_ntz")
    f = f.withColumn("test_start", test_start)
    full_end = F.expr("test_start + INTERVAL '1' MONTH")
    return f.withColumn("train_end", F.expr(f"test_start - INTERVAL {embargo}")).withColumn("_end", full_end)


def folds_expanding(last: DataFrame, start: str, bar: str, warmup: int = 6, embargo: str = "'4' HOUR") -> DataFrame:
    """Monthly test windows after a warm-up, an embargo before each, the last window clipped to
    one bar after the last valid time. ``last`` has one row with last_ts; start is a month start."""
    f = _monthly(last, start, warmup, embargo)
    return f.select("fold_id", "train_start", "train_end", "test_start",
                    F.least("_end", F.expr(f"last_ts + INTERVAL {bar}")).alias("test_end"))


def folds_rolling(last: DataFrame, start: str, bar: str, warmup: int = 6, embargo: str = "'4' HOUR") -> DataFrame:
    """Same test windows, a training window of fixed length."""
    e = folds_expanding(last, start, bar, warmup, embargo)
    return e.withColumn("train_start", F.expr(f"test_start - INTERVAL '{warmup}' MONTH"))


def anchor_of(folds: DataFrame, anchors: DataFrame) -> DataFrame:
    """Latest anchor at or before each fold, else the first one. The sorted anchor list is calendar-sized
    and travels as one array on a constant key."""
    every = anchors.agg(F.array_sort(F.collect_set("anchor")).alias("_a"), F.lit(1).alias("_k"))
    f = folds.withColumn("_k", F.lit(1)).join(every, "_k").drop("_k")
    at = F.array_max(F.filter("_a", lambda x: x <= F.col("fold")))
    return f.withColumn("anchor", F.coalesce(at, F.array_min("_a"))).drop("_a")


def slice_counts(rows: DataFrame, in_embargo: Column, min_train: int, min_test: int, keys=("series_id",)) -> DataFrame:
    """Rows of each expanding fold's train and test slice. Training counts are prefix sums over
    folds, so no row is copied; in_embargo marks rows too close to the next fold to train on."""
    per = rows.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(in_embargo).alias("_tail"))
    w = Window.partitionBy(*keys).orderBy("fold")
    before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    tail = F.when(F.lag("fold").over(w) == F.col("fold") - 1, F.lag("_tail").over(w)).otherwise(0)
    d = per.withColumn("n_train", F.coalesce(before - tail, F.lit(0)))
    return d.select(*keys, "fold", "n_train", F.col("n").alias("n_test"),
                    ((F.col("n_train") >= min_train) & (F.col("n") >= min_test)).alias("enough"))


def chronological_split(rows: DataFrame, holdout: str, embargo: str) -> DataFrame:
    """Adds part: train before holdout - embargo, test from holdout on; rows between are dropped."""
    h = F.lit(holdout).cast("timestamp_ntz")
    cut = F.expr(f"TIMESTAMP_NTZ'{holdout}' - INTERVAL {embargo}")
    part = F.when(F.col("ts") < cut, "train").when(F.col("ts") >= h, "test")
    return rows.withColumn("part", part).filter("part IS NOT NULL")


def inner_split(rows: DataFrame, keys, order, chunk: Column, share: float) -> DataFrame:
    """Adds inner: true for the first share of rows in time order."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = lookup(with_position(rows, keys, order, chunk), n, keys)
    return d.withColumn("inner", F.col("row_pos") < F.floor(F.col("_n") * share)).drop("row_pos", "_n")


def pool_growth(rows: DataFrame, usable: Column, min_rows: int, keys=()) -> DataFrame:
    """Training rows available to each fold: usable rows of all earlier folds."""
    per = rows.groupBy(*keys, "fold").agg(F.count_if(usable).alias("own"))
    w = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("pool", F.coalesce(F.sum("own").over(w), F.lit(0))).withColumn("trainable", F.col("pool") >= min_rows)


