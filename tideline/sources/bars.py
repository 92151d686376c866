"""Bar sources, checks on them, and incremental refresh of a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.blocks import lookup, running
from ..functions.columns import slot
from ..schemas import BAR

KEYS = ("series_id",)


def read_bars_csv(spark: SparkSession, path: str, cols=None) -> DataFrame:
    """Bars from CSV with a fixed schema; only the wanted columns are parsed. No global sort."""
    df = spark.read.schema(BAR).option("header", True).csv(path)
    return df.select("series_id", "ts", *cols) if cols else df


def klines(raw: DataFrame, column: str, minutes: int) -> DataFrame:
    """Positional exchange records (a JSON array per row) to bars.

    0 open time in ms, 1-5 open high low close volume, 7 quote volume, 9 taker-buy volume.
    Average price is quote / volume, or the mean of the four prices without volume."""
    a = F.from_json(F.col(column), "array<string>")
    at = lambda i: F.element_at(a, i + 1).cast("double")
    mean4 = (at(1) + at(2) + at(3) + at(4)) / 4
    d = raw.select("series_id", F.expr("timestampadd(MINUTE, cast(cast(element_at(from_json(%s, 'array<string>'), 1) as bigint)"
                                       " / 60000 as int), TIMESTAMP_NTZ'1970-01-01 00:00:00')" % column).alias("ts"),
                   at(1).alias("open"), at(2).alias("high"), at(3).alias("low"), at(4).alias("close"), at(5).alias("volume"),
                   F.when(at(5) > 0, at(7) / F.when(at(5) != 0, at(5))).otherwise(mean4).alias("avg_price"),
                   at(9).alias("buy_vol"))
    d = d.withColumn("sell_vol", F.col("volume") - F.col("buy_vol")).withColumn("ofi", F.col("buy_vol") - F.col("sell_vol"))
    return d.withColumn("pos", slot(minutes))


def to_klines(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars as the positional JSON arrays an exchange sends (for tests and replays)."""
    s = lambda c: c.cast("string")
    quote = F.col("avg_price") * F.col("volume")
    arr = F.array(s(F.col("pos") * (minutes * 60_000)), s(F.col("open")), s(F.col("high")), s(F.col("low")), s(F.col("close")),
                  s(F.col("volume")), s(F.col("pos") * (minutes * 60_000) + minutes * 60_000 - 1), s(quote),
                  s(F.col("n_ticks")), s(F.col("buy_vol")))
    return bars.select("series_id", F.to_json(arr).alias("kline"))


def range_read(bars: DataFrame, start: str, end: str, day: str | None = None) -> DataFrame:
    """Bars in [start, end]; the predicate reaches the scan, and with a day partition column it prunes files."""
    if day:
        bars = bars.filter(F.col(day).between(F.lit(start[:10]).cast("date"), F.lit(end[:10]).cast("date")))
    return bars.filter(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def recent_n(bars: DataFrame, n: int) -> DataFrame:
    """Last n bars per series; each task first cuts to its own top n."""
    w = Window.partitionBy("series_id").orderBy(F.col("ts").desc())
    return bars.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def contiguity_report(bars: DataFrame) -> DataFrame:
    """Time steps between neighbouring bars and how often each occurs."""
    p = running(bars, KEYS, prev=("last", "pos", "before"))
    return p.filter("prev IS NOT NULL").groupBy("series_id", (F.col("pos") - F.col("prev")).alias("step")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("off_step", F.col("step") != 1)


def require_contiguous(bars: DataFrame) -> DataFrame:
    bad = contiguity_report(bars).filter("off_step").limit(1).count()
    if bad:
        raise ValueError("bars are not contiguous")
    return bars


def duplicate_times(rows: DataFrame, keys=("series_id", "ts")) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def new_feature_rows(bars: DataFrame, done: DataFrame, build, halo_slots: int) -> DataFrame:
    """Rows to append: per series, bars after the last stored one, computed with a look-back halo."""
    mark = done.groupBy("series_id").agg(F.max("pos").alias("_mark"))
    fresh = lookup(bars, mark, KEYS, "left").filter(
        F.col("_mark").isNull() | (F.col("pos") > F.col("_mark") - halo_slots))
    return build(fresh).filter(F.col("_mark").isNull() | (F.col("pos") > F.col("_mark"))).drop("_mark")


