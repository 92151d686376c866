"""Bars and features on a stream."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import EPOCH, micros, safe_div
from .sources import fresh, run_batches


def resample(bars: DataFrame, minutes: int, base_minutes: int, delay: str) -> DataFrame:
    """Coarser bars from a bar stream. A bucket comes out once the watermark has passed its end, and only
    if all its base bars had arrived; a base bar later than that is dropped and its bucket never emitted."""
    n = minutes // base_minutes
    b = bars.withColumn("_t", F.timestamp_micros(micros("ts"))).withWatermark("_t", delay)
    g = b.groupBy("series_id", F.window("_t", f"{minutes} minutes").alias("_w")).agg(
        F.min_by("open", "pos").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "pos").alias("close"), F.sum("volume").alias("volume"), F.sum("buy_vol").alias("buy_vol"),
        F.sum(F.col("avg_price") * F.col("volume")).alias("_paid"), F.count(F.lit(1)).alias("n_base"))
    return g.filter(F.col("n_base") == n).select(
        "series_id", F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, unix_seconds(_w.start))").alias("ts"), "open", "high", "low", "close", "volume",
        F.coalesce(safe_div("_paid", "volume"), F.col("close")).alias("avg_price"), "buy_vol")


def append_features(bars: DataFrame, build, halo_slots: int, name: str = "features") -> DataFrame:
    """Micro-batch refresh. Between batches only a tail is kept: per series the rows within halo_slots of its
    last one. A batch computes features on tail + new rows and stores those after the tail's end; bars that
    come later than that are dropped. Outputs are written per batch number, so a repeated batch
    replaces its own output."""
    spark = bars.sparkSession
    tails, out = fresh(spark, f"{name}-tail"), fresh(spark, name)
    at = lambda root, i: os.path.join(root, f"batch={i}")

    def each(df: DataFrame, batch_id: int) -> None:
        old = spark.read.schema(bars.schema).parquet(at(tails, batch_id - 1)) if batch_id else spark.createDataFrame([], bars.schema)
        mark = old.groupBy("series_id").agg(F.max("pos").alias("_mark"))
        fresh_rows = df.join(mark, "series_id", "left").filter(F.col("_mark").isNull() | (F.col("pos") > F.col("_mark"))).drop("_mark")
        rows = old.unionByName(fresh_rows)
        feats = build(rows).join(mark, "series_id", "left").filter(F.col("_mark").isNull() | (F.col("pos") > F.col("_mark"))).drop("_mark")
        feats.write.mode("overwrite").parquet(at(out, batch_id))
        end = rows.groupBy("series_id").agg(F.max("pos").alias("_end"))
        rows.join(end, "series_id").filter(F.col("pos") > F.col("_end") - halo_slots).select(*bars.columns).write.mode(
            "overwrite").parquet(at(tails, batch_id))

    run_batches(bars, name, each)
    return spark.read.parquet(out).drop("batch")
