"""How the logical inputs (bars, features, states, folds) are bound to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.blocks import over_chunks, stage
from ..functions.columns import ahead, periods, three_way
from ..operators import features as ft, gaps, resample as rs
from ..sources.tables import table

MINUTES = 60
KEYS = ("series_id",)
STATE_CUT = 0.5
HORIZONS = (1, 2, 4)
REACH = ft.LOOKBACK + 1
WEEK0 = "2024-01-08 00:00:00"


def bars(spark: SparkSession, folder: str, minutes: int = MINUTES) -> DataFrame:
    return rs.tick_bars(table(spark, folder, "events"), minutes)


def bar_table(spark: SparkSession, folder: str) -> DataFrame:
    """The bars written once, for whatever reads them more than once: the event table is scanned one time."""
    return stage(bars(spark, folder))


WIDTHS = (5, 15, 30, 60)
TICKS = 2.0


def walk_minutes(spark: SparkSession, folder: str) -> int:
    """Bar width of the walks: the finest that still has TICKS events per bar and series on average, so that a longer or denser event table
    gives more bars and not only fuller ones. The widest if none has."""
    r = table(spark, folder, "events").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("keys"), (F.max("ts") - F.min("ts")).alias("span")).first()
    span = r["span"].total_seconds() / 60 if r["span"] else 0.0
    return next((m for m in WIDTHS if r["n"] >= TICKS * r["keys"] * span / m > 0), WIDTHS[-1])


def with_features(d, w):
    return ft.add_base(d, w).withColumn("px_z", ft.rolling_zscore("avg_price", w, ft.SPAN))


def state_columns(cut: float = STATE_CUT) -> dict:
    """A state from given thresholds: where the price stands against its own recent mean."""
    z = F.col("px_z")
    trend = three_way(z, cut, "Downtrend", "Ranging", "Uptrend")
    vol = three_way("vol_z", cut, "Low-Vol", "Mid-Vol", "High-Vol")
    return {"state": three_way(z, cut, 0, 1, 2).cast("long"), "trend_sign": three_way(z, cut, -1, 0, 1).cast("long"),
            "is_trending": F.abs(z) > cut, "confidence": F.abs(z) / (1 + F.abs(z)), "score": 1 / (1 + F.exp(-z)),
            "regime": F.concat(trend, F.lit(" / "), vol)}


def week_fold():
    """Weekly test folds after one week of warm-up; rows of the warm-up get a negative number."""
    return periods(WEEK0, 7)


def featured(spark, folder, source: DataFrame | None = None) -> DataFrame:
    """All bars with the base features (null where undefined). One shuffle after the bars."""
    source = bars(spark, folder) if source is None else source
    return over_chunks(source, KEYS, with_features, before=ft.LOOKBACK)


def valid_rows(spark, folder, then=None, before: int = 0, after: int = max(HORIZONS), minutes: int = MINUTES,
               source: DataFrame | None = None) -> DataFrame:
    """Valid rows with state, fold and forward returns, in the same shuffle as the features.

    ``then(d, w)`` may add further bounded windows over the valid rows (before / after slots)."""
    def work(d, w):
        d = with_features(d, w).filter(ft.complete((*ft.BASE_FEATURES, "px_z"))).withColumns(
            {**state_columns(), "fold": week_fold()})
        d = d.withColumns({f"fwd_{h}": ahead(F.log("close"), w, h) - F.log("close") for h in HORIZONS})
        return then(d, w) if then else d

    source = bars(spark, folder, minutes) if source is None else source
    return over_chunks(source, KEYS, work, before=REACH + before, after=after)


def marked(spark, folder, source: DataFrame | None = None) -> DataFrame:
    """Valid rows with segment and run marks. Marking reads its input twice, hence the written table."""
    return gaps.mark_runs(stage(valid_rows(spark, folder, source=source))).withColumn(
        "duration", gaps.running_duration(None)).withColumn("left_censored", gaps.left_censored())


def runs(spark, folder) -> DataFrame:
    return gaps.state_runs(marked(spark, folder), MINUTES)
