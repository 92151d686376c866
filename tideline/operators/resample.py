"""Bars from ticks, coarser bars from finer ones, and alignment of series in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.blocks import lookup, over_chunks, running
from ..functions.columns import micros, safe_div, since, slot, slot_start

KEYS = ("series_id",)


def tick_bars(events: DataFrame, minutes: int, key: str = "event_type") -> DataFrame:
    """Bars from an event table. First and last go by (ts, event_id); that pair is packed into one
    decimal so that the aggregate keeps a fixed-width buffer and stays a hash aggregate. A microsecond is
    2^64 apart from the next, so no id reaches into it."""
    when = (micros("ts").cast("decimal(18,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")
            + F.col("event_id").cast("decimal(19,0)")).cast("decimal(38,0)")
    bought = F.col("user_id") % 2 == 0
    buy = F.when(bought, F.col("value")).otherwise(F.lit(0.0))
    sell = F.when(bought, F.lit(0.0)).otherwise(F.col("value"))
    e = events.select(F.col(key).alias("series_id"), slot(minutes).alias("pos"), "value",
                      buy.alias("buy"), sell.alias("sell"), when.alias("_when"))
    g = e.groupBy("series_id", "pos").agg(
        F.min_by("value", "_when").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "_when").alias("close"), F.sum("value").alias("volume"),
        F.sum("buy").alias("buy_vol"), F.sum("sell").alias("sell_vol"), F.count(F.lit(1)).alias("n_ticks"))
    return g.select("series_id", "pos", slot_start(minutes).alias("ts"), "open", "high", "low", "close", "volume",
                    (F.col("volume") / F.col("n_ticks")).alias("avg_price"), "buy_vol", "sell_vol",
                    (F.col("buy_vol") - F.col("sell_vol")).alias("ofi"), "n_ticks")


def resample_bars(bars: DataFrame, minutes: int, base_minutes: int, complete: bool = True) -> DataFrame:
    """Coarser bars; a bucket is kept only with its full number of base bars."""
    n = minutes // base_minutes
    paid = F.sum(F.col("avg_price") * F.col("volume"))
    g = bars.withColumn("_fine", F.col("pos")).withColumn("pos", F.floor(F.col("pos") / n).cast("long")).groupBy(
        "series_id", "pos").agg(
        F.min_by("open", "_fine").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "_fine").alias("close"), F.sum("volume").alias("volume"), F.sum("buy_vol").alias("buy_vol"),
        F.sum("sell_vol").alias("sell_vol"), paid.alias("_paid"), F.count(F.lit(1)).alias("n_base"))
    if complete:
        g = g.filter(F.col("n_base") == n)
    return g.select("series_id", "pos", slot_start(minutes).alias("ts"), "open", "high", "low", "close", "volume",
                    F.coalesce(safe_div("_paid", "volume"), F.col("close")).alias("avg_price"), "buy_vol", "sell_vol",
                    (F.col("buy_vol") - F.col("sell_vol")).alias("ofi"), "n_base")


def fill_grid(bars: DataFrame, minutes: int) -> DataFrame:
    """Every slot between a series' first and last bar; a missing bar has volume 0 and no prices.

    Each bar emits the empty slots up to the next bar. The next bar is found by a reverse scan,
    so no task holds a whole series."""
    nxt = running(bars, KEYS, reverse=True, next_pos=("last", "pos", "before"))
    slots = F.sequence(F.col("pos"), F.coalesce(F.col("next_pos") - 1, F.col("pos")))
    d = nxt.withColumn("_at", F.explode(slots))
    here = F.col("_at") == F.col("pos")
    keep = [F.when(here, F.col(c)).alias(c) for c in ("open", "high", "low", "close", "avg_price")]
    flow = [F.when(here, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("volume", "buy_vol", "sell_vol", "ofi")]
    return d.select("series_id", F.col("_at").alias("pos"), slot_start(minutes, "_at").alias("ts"), *keep, *flow)


def daily_overview(bars: DataFrame, states: DataFrame, base_minutes: int) -> DataFrame:
    """One-day candles plus the day's most frequent state; ties go to the smallest state."""
    per_day = 1440 // base_minutes
    day = F.floor(F.col("pos") / per_day).cast("long")
    candles = resample_bars(bars, 1440, base_minutes, complete=False)
    counts = states.groupBy("series_id", day.alias("pos"), "state").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("series_id", "pos").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "state"))["state"].cast("long").alias("state"))
    return candles.join(top, ["series_id", "pos"], "left")


def floor_broadcast(fine: DataFrame, coarse: DataFrame, ratio: int, cols) -> DataFrame:
    """Each coarse row's values on its fine rows, by flooring the slot number."""
    c = coarse.select("series_id", F.col("pos").alias("_coarse"), *cols)
    return fine.withColumn("_coarse", F.floor(F.col("pos") / ratio).cast("long")).join(
        c, ["series_id", "_coarse"], "left").drop("_coarse")


def align_left(bars: DataFrame, decoded: DataFrame, cols) -> DataFrame:
    """Decoded columns on all bars by exact time; bars without one keep nulls."""
    return bars.join(decoded.select("series_id", "pos", *cols), ["series_id", "pos"], "left")


def match_report(left: DataFrame, right: DataFrame, keys=("series_id", "pos")) -> DataFrame:
    """Matched and unmatched keys both ways."""
    a = left.select(*keys, F.lit(1).alias("_l"))
    b = right.select(*keys, F.lit(1).alias("_r"))
    return a.join(b, list(keys), "full_outer").agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
        F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"))


def asof_backward(left: DataFrame, right: DataFrame, keys, left_ts: str, right_ts: str, cols, chunk,
                  tie: str) -> DataFrame:
    """Latest right row at or before each left row; left rows without one are dropped.

    Both sides are stacked and the last right row is carried forward, a linear scan; on equal times
    right rows come first. ``chunk`` maps the time column "_t" to a chunk number; ``tie`` orders
    rows of one side with equal time."""
    payload = F.struct(F.col("_t").alias("right_ts"), *cols)
    r = right.withColumn("_t", F.col(right_ts)).select(
        *keys, "_t", F.lit(0).alias("_side"), F.col(tie).alias("_tie"), payload.alias("_right"))
    lcols = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"),
                    F.struct(*lcols).alias("_left"))
    both = r.unionByName(l, allowMissingColumns=True)
    out = running(both, keys, ("_t", "_side", "_tie"), chunk, hit=("last", "_right"))
    return out.filter("_side = 1 AND hit IS NOT NULL").select(*keys, "_left.*", "hit.*")


def nearest_row(df: DataFrame, at) -> DataFrame:
    """Per series, the row closest to a time; ties go to the earlier row. Two bounded aggregates."""
    t = F.lit(at).cast("timestamp_ntz")
    best = df.groupBy("series_id").agg(
        F.max(F.when(F.col("ts") <= t, F.col("ts"))).alias("_lo"), F.min(F.when(F.col("ts") >= t, F.col("ts"))).alias("_hi"))
    gap_lo, gap_hi = -since(at, "_lo"), since(at, "_hi")
    ts = F.when(F.col("_hi").isNull() | (gap_lo <= gap_hi), F.col("_lo")).otherwise(F.col("_hi"))
    ts = F.when(F.col("_lo").isNull(), F.col("_hi")).otherwise(ts)
    pick = best.select("series_id", ts.alias("ts"), (ts == t).alias("exact"))
    return lookup(df, pick, ["series_id", "ts"])


def lagged(df: DataFrame, exprs, before: int, after: int = 0) -> DataFrame:
    """Columns that look a bounded number of slots back or ahead; exprs maps names to functions of w."""
    return over_chunks(df, KEYS, lambda d, w: d.withColumns({n: f(w) for n, f in exprs.items()}), before, after)
