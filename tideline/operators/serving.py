"""Range reads over the serving tables (candles, runs, transitions, catalog)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import micros


def _t(x):
    return F.lit(x).cast("timestamp_ntz")


def unix(c: str):
    return F.floor(micros(c) / 1_000_000).cast("long")


def _within(df: DataFrame, start, end, lo: str, hi: str) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(hi) >= _t(start))
    if end is not None:
        df = df.filter(F.col(lo) <= _t(end))
    return df


def _ties(d: DataFrame) -> list:
    """Second keys, so that a limit cuts rows of one time the same way each time."""
    return [F.col(c) for c in ("series_id", "state", "from_state", "to_state") if c in d.columns]


def candles(df: DataFrame, model: str, start=None, end=None, limit: int = 20_000) -> DataFrame:
    """Last rows when unbounded, first rows when bounded; truncated tells whether more exist."""
    d = _within(df.filter(F.col("model_id") == model), start, end, "ts", "ts")
    order = F.col("ts").desc() if start is None and end is None else F.col("ts")
    more = d.agg((F.count(F.lit(1)) > limit).alias("truncated"))  # one row
    return d.orderBy(order, *_ties(d)).limit(limit).crossJoin(more).withColumn("time", unix("ts"))


def segments(runs: DataFrame, model: str, start=None, end=None, limit: int = 5_000) -> DataFrame:
    d = _within(runs.filter(F.col("model_id") == model), start, end, "start_ts", "end_ts")
    return d.orderBy(F.col("start_ts").desc(), *_ties(d)).limit(limit).withColumns({"start_time": unix("start_ts"), "end_time": unix("end_ts")})


def transitions(trans: DataFrame, model: str, start=None, end=None, limit: int = 200) -> DataFrame:
    d = _within(trans.filter(F.col("model_id") == model), start, end, "ts", "ts")
    return d.orderBy(F.col("ts").desc(), *_ties(d)).limit(limit).withColumn("time", unix("ts"))


def state_stats(candle_rows: DataFrame, runs: DataFrame, trans: DataFrame, start=None, end=None) -> DataFrame:
    """Per model: bars, labelled bars, transitions, latest state and duration, longest run, and one row
    per regime with its share of labelled bars."""
    k = ["model_id"]
    bars = _within(candle_rows, start, end, "ts", "ts")
    seen = F.col("state").isNotNull()
    when_seen = F.when(seen, F.col("ts"))
    b = bars.groupBy(*k).agg(F.count(F.lit(1)).alias("bars"), F.count_if(seen).alias("labeled_bars"),
                             F.max_by("state", when_seen).alias("current_state"), F.max_by("state_duration", when_seen).alias("current_duration"))
    longest = _within(runs, start, end, "start_ts", "end_ts").groupBy(*k).agg(F.max("duration_minutes").alias("longest_minutes"))
    t = _within(trans, start, end, "ts", "ts").groupBy(*k).agg(F.count(F.lit(1)).alias("state_transitions"))
    r = bars.filter(seen).groupBy(*k, "regime").agg(F.count(F.lit(1)).alias("n_regime"))
    d = b.join(longest, k, "left").join(t, k, "left").fillna(0, ["state_transitions"]).join(r, k, "left")
    return d.withColumn("regime_pct", F.round(F.col("n_regime") / F.col("labeled_bars") * 100, 2))


def models(candle_rows: DataFrame, runs: DataFrame, trans: DataFrame) -> DataFrame:
    """Catalog entries."""
    k = ["model_id"]
    c = candle_rows.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_candles"), F.count("state").alias("n_matched"), F.countDistinct("state").alias("n_states"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    r = runs.groupBy(*k).agg(F.count(F.lit(1)).alias("n_segments"))
    t = trans.groupBy(*k).agg(F.count(F.lit(1)).alias("n_transitions"))
    return c.join(r, k, "left").join(t, k, "left").fillna(0, ["n_segments", "n_transitions"])


def label_map(candle_rows: DataFrame) -> DataFrame:
    """State to label map of each model: the label most often seen with the state, ties to the first in order."""
    c = candle_rows.filter("state IS NOT NULL").groupBy("model_id", "state", "regime").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("model_id", "state").agg(F.min(F.struct((-F.col("n")).alias("n"), "regime"))["regime"].alias("regime"))
    return best.groupBy("model_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "regime")))).alias("labels"))
