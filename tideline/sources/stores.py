"""Model-partitioned tables: serving tables, fold outputs, catalogs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.blocks import work_dir


def table_path(spark: SparkSession, name: str) -> str:
    return os.path.join(work_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")


def write_partitioned(df: DataFrame, path: str, by: str) -> DataFrame:
    """Rewrites only the partitions present in df, so finished work of other folds or models stays."""
    df.write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "dynamic").parquet(path)
    return df.sparkSession.read.parquet(path)


def pending_folds(folds: DataFrame, done: DataFrame) -> DataFrame:
    """Folds without a finished output."""
    return folds.join(done.select("fold_id").distinct(), "fold_id", "left_anti")


def catalog_upsert(catalog: DataFrame, new: DataFrame, key: str = "model_id") -> DataFrame:
    """New entries replace those with the same key."""
    return catalog.join(new.select(key), key, "left_anti").unionByName(new)


def candles(bars: DataFrame, decoded: DataFrame, model_id: str) -> DataFrame:
    d = decoded.select("series_id", "pos", "state", "regime", "confidence", F.col("duration").alias("state_duration"))
    return bars.select("series_id", "pos", "ts", "open", "high", "low", "close", "volume").join(
        d, ["series_id", "pos"], "left").withColumn("model_id", F.lit(model_id))
