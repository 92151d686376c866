"""The slices that the stream queries read hold every row once, whatever its time."""

from datetime import datetime

from pyspark.sql import functions as F

from tideline.plans import q_streaming as qs
from tideline.streaming import bars as sbars, sources as ssrc


def test_every_row_is_in_one_slice(spark):
    times = [None, datetime(1850, 1, 1), datetime(2024, 1, 10, 23, 59, 59, 500_000), datetime(2024, 1, 11), datetime(2024, 1, 20, 23, 59, 59, 999_999),
             datetime(2024, 1, 21), datetime(2101, 5, 5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id long, ts timestamp_ntz")
    got = ssrc.run_to_table(qs.arriving(df, "slices"), "slices-out").select("id", "ts").collect()
    assert sorted((r.id, r.ts) for r in got) == list(enumerate(times))


def test_bars_after_2038(spark):
    hour = "TIMESTAMP_NTZ'2040-03-01 00:00:00' + make_dt_interval(0, cast(id AS int))"
    df = spark.range(30).select(F.lit("a").alias("series_id"), F.expr(hour).alias("ts"), F.col("id").alias("pos"),
                                *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume", "buy_vol", "avg_price")])
    out = ssrc.run_to_table(sbars.resample(qs.arriving(df, "late"), 360, 60, "2 hours"), "late-out").collect()
    assert sorted(r.ts for r in out) == [datetime(2040, 3, 1, h) for h in (0, 6, 12, 18)]
