"""Validity masks, contiguous segments and runs of equal state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.blocks import over_chunks, running
from ..functions.columns import col

KEYS = ("series_id",)


def validity_mask(dense: DataFrame, lookback: int) -> DataFrame:
    """valid is false when any zero-volume bar lies in the look-back; short windows are allowed at the start."""
    zero = F.when(F.col("volume") == 0, 1).otherwise(0)
    return over_chunks(dense, KEYS, lambda d, w: d.withColumn(
        "valid", F.max(zero).over(w.rangeBetween(-(lookback - 1), 0)) == 0), before=lookback)


def new_segment(w: Window, pos: str = "pos", step: int = 1) -> Column:
    """True on the first row of a contiguous stretch."""
    return ~F.coalesce(F.lag(pos).over(w) == F.col(pos) - step, F.lit(False))


def mark_runs(rows: DataFrame, state: str = "state", across_gaps: bool = False, size: int | None = None) -> DataFrame:
    """Adds new_segment, new_run, seg_start, run_start (slot numbers), seg_no (from 1) and prev_state,
    the state of the previous row even across a gap.

    A segment or run is named by the slot of its first row, so no global numbering is needed."""
    def flags(d, w):
        s = new_segment(w)
        return d.withColumns({"new_segment": s, "_same": ~s & F.lag(state).over(w).eqNullSafe(F.col(state))})

    f = over_chunks(rows, KEYS, flags, before=1, size=size)
    extra = {}
    if across_gaps:
        extra["prev_state"] = ("last", state, "before")
    f = f.withColumn("new_run", ~F.col("_same"))
    return running(f, KEYS, seg_start=("last", F.when(F.col("new_segment"), F.col("pos"))),
                   run_start=("last", F.when(F.col("new_run"), F.col("pos"))),
                   seg_no=("sum", F.col("new_segment").cast("long")), **extra).drop("_same")


def running_duration(marked: DataFrame) -> Column:
    """Rows since the run began, from 1; inside a run slots are consecutive."""
    return F.col("pos") - F.col("run_start") + 1


def left_censored() -> Column:
    """The run reaches back to the start of the available window."""
    return F.col("run_start") == F.col("seg_start")


def state_runs(marked: DataFrame, minutes: int, state: str = "state", keys=KEYS) -> DataFrame:
    """One row per run. Partial aggregation keeps even a very long run off a single task."""
    g = marked.groupBy(*keys, "seg_start", "run_start").agg(
        F.first(state).alias("state"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("n_bars"))
    return g.withColumn("duration_minutes", F.col("n_bars") * F.lit(float(minutes)))


def runs_null_aware(rows: DataFrame, state: str = "state") -> DataFrame:
    """Runs of a column with nulls, in row order (gaps in time do not cut): a null ends a run."""
    p = running(rows, KEYS, prev=("last", F.struct(F.col(state).alias("s")), "before"))
    p = p.withColumn("_new", F.col("prev").isNull() | ~F.col("prev.s").eqNullSafe(F.col(state)))
    m = running(p.drop("prev"), KEYS, run_start=("last", F.when(F.col("_new"), F.col("pos"))))
    return m.filter(F.col(state).isNotNull()).groupBy("series_id", "run_start").agg(
        F.first(state).alias("state"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("n_bars"))


def transitions(runs: DataFrame, require_change: bool = True) -> DataFrame:
    """Successive runs, gaps ignored."""
    t = running(runs, KEYS, order=("run_start",), from_state=("last", "state", "before"))
    t = t.filter(F.col("from_state").isNotNull())
    if require_change:
        t = t.filter(F.col("from_state") != F.col("state"))
    return t.select("series_id", F.col("start_ts").alias("ts"), "from_state", F.col("state").alias("to_state"), "run_start")


def smooth_runs(runs: DataFrame, min_minutes: float) -> DataFrame:
    """Runs that are short, or equal to the kept run before them, join that kept run.

    A run is a candidate when it is the first or long enough; a candidate opens a new block when its
    state differs from the last candidate's. No loop is needed. Returns runs with block_start."""
    long = F.when(F.col("duration_minutes") >= min_minutes, F.col("state"))
    p = running(runs, KEYS, order=("run_start",), _kept=("last", long, "before"), _first=("first", "state", "before"))
    candidate = F.col("_first").isNull() | (F.col("duration_minutes") >= min_minutes)
    opens = candidate & ~F.coalesce("_kept", "_first").eqNullSafe(F.col("state"))
    p = p.withColumn("_opens", opens).drop("_kept", "_first")
    return running(p, KEYS, order=("run_start",), block_start=("last", F.when(F.col("_opens"), F.col("run_start"))),
                   block_state=("last", F.when(F.col("_opens"), F.col("state")))).drop("_opens")


def smoothed(runs_with_blocks: DataFrame) -> DataFrame:
    return runs_with_blocks.groupBy("series_id", "block_start").agg(
        F.first("block_state").alias("state"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
        F.sum("n_bars").alias("n_bars"), F.sum("duration_minutes").alias("duration_minutes"))


def relabel(marked: DataFrame, runs_with_blocks: DataFrame) -> DataFrame:
    """Each row's smoothed state, joined on the run it already carries (no range join)."""
    m = runs_with_blocks.select("series_id", "run_start", F.col("block_state").alias("smooth_state"))
    return marked.join(m, ["series_id", "run_start"])


def exclusion_counts(rows: DataFrame, valid, defined) -> DataFrame:
    v, d = col(valid), col(defined)
    return rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~v & d).alias("gap_only"), F.count_if(v & ~d).alias("undefined_only"),
        F.count_if(~v & ~d).alias("gap_and_undefined"), (F.avg((v & d).cast("double")) * 100).alias("valid_pct"))
