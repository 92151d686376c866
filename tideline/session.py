"""Session settings used by tests and the benchmark; on a cluster the session is given."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | None = None, shuffle: int = 8) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("tideline")
             .config("spark.sql.shuffle.partitions", str(shuffle)).config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tideline-"))
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tideline-"), "tideline"), "zip", os.path.dirname(root), "tideline")
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)
