"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.functions.blocks import stage, staged_bytes  # noqa: F401
from tideline.session import ship as _ship_base

BROADCAST_BYTES = 48 << 20  # a staged side above this size is joined by a shuffle

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends both packages to the Python workers, once per application."""
    _ship_base(spark)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="llm-"), "llm"), "zip", root, "llm")
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*(columns or "*"))


def small_side(staged: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast if its files are below BROADCAST_BYTES; else it is joined by a shuffle,
    where adaptive execution splits hot keys. Either way the result is the same."""
    return F.broadcast(staged) if staged_bytes(staged) <= BROADCAST_BYTES else staged


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
