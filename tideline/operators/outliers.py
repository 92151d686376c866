"""Outlier rows, events and what surrounds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.blocks import chunk_of, lookup, over_chunks, with_position
from ..functions.columns import ahead, back
from ..functions.ordered import percentiles
from . import gaps
from .scaling import scaler_fit

KEYS = ("series_id",)


def zscore_flags(rows: DataFrame, cols, cut: float, levels=()) -> DataFrame:
    """Adds z_<c>, max_z, max_feature, n_over (features beyond cut), over_<level> and is_outlier."""
    d = lookup(rows, scaler_fit(rows, cols), KEYS)
    d = d.withColumns({f"z_{c}": (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in cols}).drop(
        *[f"{c}_{o}" for c in cols for o in ("mean", "sd")])
    z = F.array(*[F.abs(f"z_{c}") for c in cols])
    names = F.array(*[F.lit(c) for c in cols])
    d = d.withColumns({"max_z": F.array_max(z), "n_over": F.size(F.filter(z, lambda v: v > cut)).cast("long"),
                       "max_feature": F.element_at(names, F.array_position(z, F.array_max(z)).cast("int")),
                       "extreme_features": F.array_join(F.filter(F.transform(
                           F.arrays_zip(names.alias("f"), z.alias("v")), lambda p: F.when(p["v"] > cut, p["f"])),
                           lambda f: f.isNotNull()), ";")})
    return d.withColumns({"is_outlier": F.col("max_z") > cut, **{f"over_{i}": F.col("max_z") > lv for i, lv in enumerate(levels)}})


def top_moves(rows: DataFrame, x: str, n: int) -> DataFrame:
    """The n largest absolute values; every task keeps its own n first."""
    return rows.orderBy(F.abs(x).desc(), "ts", "series_id").limit(n)


def tail_state_share(rows: DataFrame, x: str, tails, states) -> DataFrame:
    """For the largest |x| by share of rows, how many fall in each state, states without rows included."""
    d = rows.withColumn("_m", F.abs(x))
    names = {f"t{i}": 1 - t / 100 for i, t in enumerate(tails)}
    cuts = percentiles(d, KEYS, "_m", names).drop("n_all")
    j = lookup(d, cuts, KEYS).select(*KEYS, "state", "_m", F.inline(F.array(
        *[F.struct(F.lit(float(t)).alias("tail_pct"), F.col(f"t{i}").alias("cut")) for i, t in enumerate(tails)]))).filter("_m >= cut")
    g = j.groupBy(*KEYS, "tail_pct").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("state") == s).alias(f"s{s}") for s in states])
    return g.select(*KEYS, "tail_pct", "n", F.inline(F.array(
        *[F.struct(F.lit(s).cast("long").alias("state"), F.col(f"s{s}").alias("n_state")) for s in states]))).withColumn(
        "pct", F.col("n_state") / F.col("n") * 100)


def outlier_events(flagged: DataFrame) -> DataFrame:
    """Consecutive outlier rows inside one segment: start, end, bars, peak."""
    m = gaps.mark_runs(flagged, "is_outlier")
    return m.filter("is_outlier").groupBy("series_id", F.col("run_start").alias("start_pos")).agg(
        F.max("pos").alias("end_pos"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("n_bars"), F.max("max_z").alias("peak_z"))


def major_events(events: DataFrame, n: int) -> DataFrame:
    """The n highest peaks."""
    return events.orderBy(F.col("peak_z").desc(), "series_id", "start_pos").limit(n)


def bar_context(rows: DataFrame, state: int, before=(1, 2), after=(1, 2, 4), vol: int = 6) -> DataFrame:
    """Per bar what an event starting or ending there needs; all looks stay in the segment, deviations in the clock window."""
    def look(d, w):
        logp = F.log("close")
        new = {f"state_before_{k}": back("state", w, k) for k in before}
        new |= {f"state_after_{k}": ahead("state", w, k) for k in after}
        new |= {f"ret_after_{k}": ahead(logp, w, k) - logp for k in after}
        new |= {"vol_before": F.stddev_pop("ret_1").over(w.rangeBetween(-vol, -1)),
                "vol_after": F.stddev_pop("ret_1").over(w.rangeBetween(1, vol - 1)),
                "started_here": (F.col("state") == state) & ~F.coalesce(back("state", w, 1) == state, F.lit(False))}
        return d.withColumns(new)

    return over_chunks(rows, KEYS, look, before=max(max(before), vol), after=max(max(after), vol))


def event_context(events: DataFrame, rows: DataFrame, state: int) -> DataFrame:
    """Joins events with the context of their first and last bar and the rest of the run they start in.

    ``rows`` are marked rows (with run_start)."""
    c = bar_context(rows, state)
    length = rows.groupBy("series_id", "run_start").agg(F.count(F.lit(1)).alias("_len"))
    first = c.join(length, ["series_id", "run_start"]).select(
        "series_id", F.col("pos").alias("start_pos"), F.col("state").alias("state_at_event"), "state_before_1", "state_before_2",
        "vol_before", "started_here",
        F.when(F.col("state") == state, F.col("run_start") + F.col("_len") - F.col("pos")).otherwise(0).alias("rest_of_run"))
    last = c.select("series_id", F.col("pos").alias("end_pos"), *[f"{p}_{k}" for p in ("state_after", "ret_after") for k in (1, 2, 4)], "vol_after")
    return events.join(first, ["series_id", "start_pos"]).join(last, ["series_id", "end_pos"])


def event_class(state: int, sustained: int) -> Column:
    never = ~F.coalesce(F.col("state_after_1") == state, F.lit(False)) & ~F.coalesce(F.col("state_after_2") == state, F.lit(False)) & ~F.coalesce(
        F.col("state_after_4") == state, F.lit(False))
    return F.when(F.col("rest_of_run") >= sustained, "sustained").when(never, "isolated").otherwise("mixed")


def around(rows: DataFrame) -> DataFrame:
    """Flags of the neighbouring rows by row number (gaps ignored): near_outlier, changed, before and after.

    ``rows`` are marked rows with is_outlier, staged."""
    p = with_position(rows, KEYS, ("pos",), chunk_of("pos"))
    p = p.withColumn("changed", F.col("new_run") & ~F.col("new_segment"))
    return over_chunks(p, KEYS, lambda d, w: d.withColumns({
        "near_outlier": F.max(F.col("is_outlier")).over(w.rowsBetween(-1, 1)),
        "changed_before": F.coalesce(F.lag("changed").over(w), F.lit(False)),
        "changed_after": F.coalesce(F.lead("changed").over(w), F.lit(False))}), before=1, after=1, pos="row_pos")
