"""Masks, segments, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.blocks import over_chunks, stage
from ..operators import features as ft, gaps, resample as rs
from . import inputs as inp
from .registry import query

MASK = "max(CASE WHEN coalesce(volume, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos ROWS 5 PRECEDING) = 0"


@query("validity_mask", "series_id ts:t volume:d valid:b", f"SELECT series_id, ts, coalesce(volume, 0) AS volume, {MASK} AS valid FROM dense")
def validity_mask(spark, folder):
    return gaps.validity_mask(rs.fill_grid(inp.bar_table(spark, folder), inp.MINUTES), 6)


def _masked(spark, folder):
    dense = rs.fill_grid(inp.bar_table(spark, folder), inp.MINUTES)

    def work(d, w):
        zero = F.when(F.col("volume") == 0, 1).otherwise(0)
        return ft.add_base(d, w).withColumn("valid", F.max(zero).over(w.rangeBetween(-5, 0)) == 0)

    return over_chunks(dense, inp.KEYS, work, before=ft.LOOKBACK).withColumn(
        "defined", F.col("ret_4").isNotNull() & F.col("vol_6").isNotNull())


@query("valid_rows", "series_id ts:t usable:b", f"SELECT series_id, ts, {MASK} AND ret_4 IS NOT NULL AND vol_6 IS NOT NULL AS usable FROM f2")
def valid_rows(spark, folder):
    return _masked(spark, folder).withColumn("usable", F.col("valid") & F.col("defined"))


@query("exclusion_counts", "series_id n:l gap_only:l undefined_only:l gap_and_undefined:l valid_pct:d", f"""
SELECT series_id, count(*) AS n, count(*) FILTER (WHERE NOT v AND d) AS gap_only, count(*) FILTER (WHERE v AND NOT d) AS undefined_only,
 count(*) FILTER (WHERE NOT v AND NOT d) AS gap_and_undefined, 100 * avg(CAST(v AND d AS INT)) AS valid_pct
FROM (SELECT series_id, {MASK} AS v, ret_4 IS NOT NULL AND vol_6 IS NOT NULL AS d FROM f2) GROUP BY 1""")
def exclusion_counts(spark, folder):
    return gaps.exclusion_counts(_masked(spark, folder), "valid", "defined")


@query("segment_id", "series_id ts:t seg_no:l seg_start:l", "SELECT * FROM valid")
def segment_id(spark, folder):
    return inp.marked(spark, folder)


@query("segment_lengths", "series_id seg_no:l n:l first_ts:t", "SELECT series_id, seg_no, count(*) AS n, min(ts) AS first_ts FROM valid GROUP BY 1, 2")
def segment_lengths(spark, folder):
    return inp.marked(spark, folder).groupBy("series_id", "seg_no").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query("first_in_segment", "series_id ts:t new_segment:b", "SELECT * FROM valid")
def first_in_segment(spark, folder):
    return inp.valid_rows(spark, folder, lambda d, w: d.withColumn("new_segment", gaps.new_segment(w)), before=1)


@query("running_duration", "series_id ts:t state:l duration:l", "SELECT * FROM valid")
def running_duration(spark, folder):
    return inp.marked(spark, folder)


@query("left_censored", "series_id ts:t left_censored:b", "SELECT * FROM valid")
def left_censored(spark, folder):
    return inp.marked(spark, folder)


@query("state_runs", "series_id state:l start_ts:t end_ts:t n_bars:l duration_minutes:d", "SELECT * FROM runs")
def state_runs(spark, folder):
    return inp.runs(spark, folder)


@query("state_runs_nullaware", "series_id state:l start_ts:t end_ts:t n_bars:l", """
a AS (SELECT b.series_id, b.pos, b.ts, v.state FROM bars b LEFT JOIN valid v ON v.series_id = b.series_id AND v.pos = b.pos),
c AS (SELECT *, state IS DISTINCT FROM lag(state) OVER w OR row_number() OVER w = 1 AS ch FROM a WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
r AS (SELECT *, sum(CAST(ch AS INT)) OVER (PARTITION BY series_id ORDER BY pos) AS rid FROM c)
;;
SELECT series_id, min(state) AS state, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_bars FROM r WHERE state IS NOT NULL GROUP BY series_id, rid""")
def state_runs_nullaware(spark, folder):
    b = inp.bar_table(spark, folder)
    a = rs.align_left(b.select("series_id", "pos", "ts"), inp.valid_rows(spark, folder, source=b), ["state"])
    return gaps.runs_null_aware(stage(a))


@query("state_transitions", "series_id ts:t from_state:l to_state:l", "SELECT * FROM trans")
def state_transitions(spark, folder):
    return gaps.transitions(stage(inp.runs(spark, folder)))


SMOOTH = """
s0 AS (SELECT *, lag(run_start) OVER w IS NULL OR duration_minutes >= 120 AS cand FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY run_start)),
s1 AS (SELECT *, last_value(CASE WHEN cand THEN state END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY run_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM s0),
s2 AS (SELECT *, sum(CASE WHEN cand AND state IS DISTINCT FROM kept THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY run_start) AS block FROM s1),
sm AS (SELECT series_id, block, arg_min(state, run_start) AS state, min(start_ts) AS start_ts, max(end_ts) AS end_ts, CAST(sum(n_bars) AS BIGINT) AS n_bars FROM s2 GROUP BY 1, 2)
"""


@query("run_smoothing", "series_id state:l start_ts:t end_ts:t n_bars:l", SMOOTH + ";; SELECT * FROM sm")
def run_smoothing(spark, folder):
    return gaps.smoothed(gaps.smooth_runs(stage(inp.runs(spark, folder)), 120))


@query("smoothed_transitions", "series_id ts:t from_state:l to_state:l", SMOOTH + """;;
SELECT * FROM (SELECT series_id, start_ts AS ts, lag(state) OVER (PARTITION BY series_id ORDER BY start_ts) AS from_state, state AS to_state FROM sm)
WHERE from_state IS NOT NULL""")
def smoothed_transitions(spark, folder):
    """Every neighbour pair of smoothed runs, without an inequality test."""
    s = gaps.smoothed(gaps.smooth_runs(stage(inp.runs(spark, folder)), 120)).withColumnRenamed("block_start", "run_start")
    return gaps.transitions(s, require_change=False)


@query("relabel_from_runs", "series_id ts:t state:l smooth_state:l", SMOOTH + """;;
SELECT v.series_id, v.ts, v.state, m.state AS smooth_state FROM valid v JOIN s2 r ON r.series_id = v.series_id AND r.run_start = v.run_start
JOIN sm m ON m.series_id = r.series_id AND m.block = r.block""")
def relabel_from_runs(spark, folder):
    m = stage(inp.marked(spark, folder).select("series_id", "pos", "ts", "state", "seg_start", "run_start"))
    return gaps.relabel(m, gaps.smooth_runs(stage(gaps.state_runs(m, inp.MINUTES)), 120))


@query("smoothing_report", "series_id runs_before:l runs_after:l removed_pct:d", SMOOTH + """;;
SELECT a.series_id, a.n AS runs_before, b.n AS runs_after, 100.0 * (a.n - b.n) / a.n AS removed_pct FROM
 (SELECT series_id, count(*) AS n FROM runs GROUP BY 1) a JOIN (SELECT series_id, count(*) AS n FROM sm GROUP BY 1) b USING (series_id)""")
def smoothing_report(spark, folder):
    r = gaps.smooth_runs(stage(inp.runs(spark, folder)), 120)
    return r.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("runs_before"), F.count_if(F.col("block_start") == F.col("run_start")).alias("runs_after")).withColumn(
        "removed_pct", 100.0 * (F.col("runs_before") - F.col("runs_after")) / F.col("runs_before"))
