"""File streams and the sinks used with them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.blocks import work_dir


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def fresh(spark: SparkSession, name: str) -> str:
    return os.path.join(work_dir(spark), "stream", f"{name}-{uuid.uuid4().hex}")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Processes what is there, into a table with exactly-once file commits, and reads it back."""
    spark = stream.sparkSession
    out, log = fresh(spark, name), fresh(spark, f"{name}-log")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", log).trigger(
        availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, name: str, each) -> None:
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", fresh(stream.sparkSession, f"{name}-log")).trigger(
        availableNow=True).start()
    q.awaitTermination()
