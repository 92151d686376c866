"""Outliers and serving reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.blocks import stage
from ..operators import gaps, outliers as ou, serving as sv
from ..sources import stores
from . import inputs as inp
from .registry import query

CUT = 2.2
COLS = ("ret_1", "volume", "ofi")
FEATURE = "CASE WHEN abs(z_ret) = max_z THEN 'ret_1' WHEN abs(z_vol) = max_z THEN 'volume' ELSE 'ofi' END"
OVER = "CAST(abs(z_ret) > 2.2 AS INT) + CAST(abs(z_vol) > 2.2 AS INT) + CAST(abs(z_ofi) > 2.2 AS INT)"
LIST = """array_to_string(list_filter([CASE WHEN abs(z_ret) > 2.2 THEN 'ret_1' END, CASE WHEN abs(z_vol) > 2.2 THEN 'volume' END,
 CASE WHEN abs(z_ofi) > 2.2 THEN 'ofi' END], lambda x: x IS NOT NULL), ';')"""
EVENTS = """
oi AS (SELECT *, sum(CASE WHEN new_segment OR is_outlier <> pf THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos) AS isl
 FROM (SELECT *, lag(is_outlier) OVER (PARTITION BY series_id ORDER BY pos) AS pf FROM outl)),
oe AS (SELECT series_id, min(pos) AS start_pos, max(pos) AS end_pos, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_bars, max(max_z) AS peak_z
 FROM oi WHERE is_outlier GROUP BY series_id, isl)"""
CONTEXT = EVENTS + """,
oc AS (
 SELECT *, lag(state, 1) OVER s AS state_before_1, lag(state, 2) OVER s AS state_before_2, lead(state, 1) OVER s AS state_after_1, lead(state, 2) OVER s AS state_after_2,
  lead(state, 4) OVER s AS state_after_4, lead(ln(close), 1) OVER s - ln(close) AS ret_after_1, lead(ln(close), 2) OVER s - ln(close) AS ret_after_2,
  lead(ln(close), 4) OVER s - ln(close) AS ret_after_4,
  stddev_pop(ret_1) OVER (PARTITION BY series_id ORDER BY pos RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING) AS vol_before,
  stddev_pop(ret_1) OVER (PARTITION BY series_id ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS vol_after,
  state = 2 AND coalesce(lag(state) OVER s, -1) <> 2 AS started_here,
  CASE WHEN state = 2 THEN run_start + count(*) OVER (PARTITION BY series_id, run_start) - pos ELSE 0 END AS rest_of_run
 FROM outl WINDOW s AS (PARTITION BY series_id, seg_no ORDER BY pos)),
ox AS (
 SELECT e.*, a.state AS state_at_event, a.state_before_1, a.state_before_2, a.vol_before, a.started_here, a.rest_of_run,
  b.state_after_1, b.state_after_2, b.state_after_4, b.ret_after_1, b.ret_after_2, b.ret_after_4, b.vol_after,
  CASE WHEN a.rest_of_run >= 3 THEN 'sustained' WHEN coalesce(b.state_after_1, -1) <> 2 AND coalesce(b.state_after_2, -1) <> 2 AND coalesce(b.state_after_4, -1) <> 2
   THEN 'isolated' ELSE 'mixed' END AS event_class
 FROM oe e JOIN oc a ON a.series_id = e.series_id AND a.pos = e.start_pos JOIN oc b ON b.series_id = e.series_id AND b.pos = e.end_pos)
"""


def flagged(spark, folder, levels=(2.0, 2.5, 3.0)):
    return ou.zscore_flags(stage(inp.valid_rows(spark, folder)), COLS, CUT, levels)


def flagged_marked(spark, folder):
    return stage(ou.zscore_flags(stage(inp.marked(spark, folder)), COLS, CUT))


@query("zscore_flags", "series_id ts:t max_z:d max_feature n_over:l over_0:b over_1:b over_2:b",
       f"SELECT *, {FEATURE} AS max_feature, {OVER} AS n_over, max_z > 2 AS over_0, max_z > 2.5 AS over_1, max_z > 3 AS over_2 FROM outl")
def zscore_flags(spark, folder):
    return flagged(spark, folder)


@query("outlier_rows", "series_id ts:t close:d state:l max_z:d extreme_features", f"SELECT *, {LIST} AS extreme_features FROM outl WHERE is_outlier")
def outlier_rows(spark, folder):
    return flagged(spark, folder).filter("is_outlier")


@query("top_n_moves", "series_id ts:t ret_1:d state:l", "SELECT * FROM valid ORDER BY abs(ret_1) DESC, ts, series_id LIMIT 100")
def top_n_moves(spark, folder):
    return ou.top_moves(inp.valid_rows(spark, folder), "ret_1", 100)


@query("tail_state_share", "series_id tail_pct:d state:l n:l n_state:l pct:d", """
tq AS (SELECT series_id, quantile_cont(abs(ret_1), [0.999, 0.995, 0.99]) AS q FROM valid GROUP BY 1),
tt AS (SELECT series_id, unnest([0.1, 0.5, 1.0]) AS tail_pct, unnest(q) AS cut FROM tq)
;;
SELECT series_id, tail_pct, s.state, n, n_state, 100.0 * n_state / n AS pct FROM (
 SELECT t.series_id, t.tail_pct, s.state, count(*) AS n, count(*) FILTER (WHERE v.state = s.state) AS n_state
 FROM tt t JOIN valid v ON v.series_id = t.series_id AND abs(v.ret_1) >= t.cut, (SELECT unnest([0, 1, 2]) AS state) s GROUP BY 1, 2, 3) s""")
def tail_state_share(spark, folder):
    return ou.tail_state_share(stage(inp.valid_rows(spark, folder)), "ret_1", (0.1, 0.5, 1.0), (0, 1, 2))


@query("outlier_events", "series_id start_ts:t end_ts:t n_bars:l peak_z:d", EVENTS + ";; SELECT * FROM oe")
def outlier_events(spark, folder):
    return ou.outlier_events(stage(flagged(spark, folder)))


@query("major_events", "series_id start_ts:t n_bars:l peak_z:d", EVENTS + ";; SELECT * FROM oe ORDER BY peak_z DESC, series_id, start_pos LIMIT 30")
def major_events(spark, folder):
    return ou.major_events(ou.outlier_events(stage(flagged(spark, folder))), 30)


CTX = ("series_id start_ts:t end_ts:t state_at_event:l state_before_1:l state_before_2:l state_after_1:l state_after_2:l state_after_4:l "
       "ret_after_1:d ret_after_2:d ret_after_4:d vol_before:d vol_after:d started_here:b rest_of_run:l")


def _context(spark, folder):
    rows = flagged_marked(spark, folder)
    return ou.event_context(ou.outlier_events(rows.drop("new_segment", "new_run", "seg_start", "run_start", "seg_no")), rows, 2)


@query("event_context", CTX, CONTEXT + ";; SELECT * FROM ox")
def event_context(spark, folder):
    return _context(spark, folder)


@query("event_class", "series_id start_ts:t event_class", CONTEXT + ";; SELECT * FROM ox")
def event_class(spark, folder):
    return _context(spark, folder).withColumn("event_class", ou.event_class(2, 3))


@query("state_outlier_share", "series_id state:l n:l over_0:l over_1:l over_2:l pct_0:d", """
SELECT series_id, state, count(*) AS n, count(*) FILTER (WHERE max_z > 2) AS over_0, count(*) FILTER (WHERE max_z > 2.5) AS over_1,
 count(*) FILTER (WHERE max_z > 3) AS over_2, 100.0 * count(*) FILTER (WHERE max_z > 2) / count(*) AS pct_0 FROM outl GROUP BY 1, 2""")
def state_outlier_share(spark, folder):
    f = flagged(spark, folder)
    return f.groupBy("series_id", "state").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(f"over_{i}").alias(f"over_{i}") for i in range(3)],
        (F.avg(F.col("over_0").cast("double")) * 100).alias("pct_0"))


AROUND = """
oa AS (SELECT *, greatest(CAST(is_outlier AS INT), coalesce(CAST(lag(is_outlier) OVER w AS INT), 0), coalesce(CAST(lead(is_outlier) OVER w AS INT), 0)) = 1 AS near_outlier,
 new_run AND NOT new_segment AS chg FROM outl WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
ob AS (SELECT *, coalesce(lag(chg) OVER w, false) AS cb, coalesce(lead(chg) OVER w, false) AS ca FROM oa WINDOW w AS (PARTITION BY series_id ORDER BY pos))
;;
"""


@query("runs_near_outlier", "series_id state:l n_runs:l n_near:l", AROUND + """
SELECT series_id, state, count(*) AS n_runs, count(*) FILTER (WHERE near_outlier) AS n_near FROM ob WHERE new_run GROUP BY 1, 2""")
def runs_near_outlier(spark, folder):
    return ou.around(flagged_marked(spark, folder)).filter("new_run").groupBy("series_id", "state").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if("near_outlier").alias("n_near"))


@query("transition_near_outlier", "series_id is_outlier:b n:l pct_at:d pct_before:d pct_after:d", AROUND + """
SELECT series_id, is_outlier, count(*) AS n, 100 * avg(CAST(chg AS INT)) AS pct_at, 100 * avg(CAST(cb AS INT)) AS pct_before, 100 * avg(CAST(ca AS INT)) AS pct_after
FROM ob GROUP BY 1, 2""")
def transition_near_outlier(spark, folder):
    pct = lambda c: F.avg(F.col(c).cast("double")) * 100
    return ou.around(flagged_marked(spark, folder)).groupBy("series_id", "is_outlier").agg(
        F.count(F.lit(1)).alias("n"), pct("changed").alias("pct_at"), pct("changed_before").alias("pct_before"),
        pct("changed_after").alias("pct_after"))


@query("extreme_feature_counts", "max_feature n:l", f"SELECT {FEATURE} AS max_feature, count(*) AS n FROM outl WHERE is_outlier GROUP BY 1")
def extreme_feature_counts(spark, folder):
    return flagged(spark, folder).filter("is_outlier").groupBy("max_feature").agg(F.count(F.lit(1)).alias("n"))


# serving: the model id is the series, so a store holds many models

CANDLES = """
cd AS (SELECT b.series_id AS model_id, b.ts, b.close, b.volume, state, regime, confidence, duration AS state_duration
 FROM bars b LEFT JOIN valid v ON v.series_id = b.series_id AND v.pos = b.pos)
;;
"""


def _tables(spark, folder):
    b = inp.bar_table(spark, folder)
    m = stage(inp.marked(spark, folder, source=b))
    c = stores.candles(b, m, "x").drop("model_id").withColumnRenamed("series_id", "model_id")
    runs = stage(gaps.state_runs(m, inp.MINUTES))
    t = gaps.transitions(runs).withColumnRenamed("series_id", "model_id")
    return c, runs.withColumnRenamed("series_id", "model_id"), t


@query("q_models", "model_id n_candles:l n_matched:l n_states:l first_ts:t last_ts:t n_segments:l n_transitions:l", CANDLES.replace(";;", "") + """
;;
SELECT c.*, (SELECT count(*) FROM runs r WHERE r.series_id = c.model_id) AS n_segments, (SELECT count(*) FROM trans t WHERE t.series_id = c.model_id) AS n_transitions
FROM (SELECT model_id, count(*) AS n_candles, count(state) AS n_matched, count(DISTINCT state) AS n_states, min(ts) AS first_ts, max(ts) AS last_ts FROM cd GROUP BY 1) c""")
def q_models(spark, folder):
    return sv.models(*_tables(spark, folder))


@query("q_regimes", "model_id label_0 label_1 label_2", """
lc AS (SELECT series_id, state, regime, count(*) AS n FROM valid GROUP BY ALL),
lb AS (SELECT * FROM lc QUALIFY row_number() OVER (PARTITION BY series_id, state ORDER BY n DESC, regime) = 1)
;;
SELECT series_id AS model_id, max(regime) FILTER (WHERE state = 0) AS label_0, max(regime) FILTER (WHERE state = 1) AS label_1, max(regime) FILTER (WHERE state = 2) AS label_2
FROM lb GROUP BY 1""")
def q_regimes(spark, folder):
    v = inp.valid_rows(spark, folder).withColumnRenamed("series_id", "model_id")
    m = sv.label_map(v)
    return m.select("model_id", *[F.try_element_at("labels", F.lit(s).cast("long")).alias(f"label_{s}") for s in range(3)])


@query("q_candles", "time:l close:d volume:d state:l regime confidence:d state_duration:l truncated:b", CANDLES + """
SELECT *, CAST(epoch(ts) AS BIGINT) AS time, (SELECT count(*) FROM cd WHERE model_id = 'click' AND ts >= TIMESTAMP '2024-01-10') > 100 AS truncated
FROM cd WHERE model_id = 'click' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts LIMIT 100""")
def q_candles(spark, folder):
    return sv.candles(_tables(spark, folder)[0], "click", start="2024-01-10 00:00:00", limit=100)


@query("q_candles_recent", "time:l close:d state:l truncated:b", CANDLES + """
SELECT *, CAST(epoch(ts) AS BIGINT) AS time, (SELECT count(*) FROM cd WHERE model_id = 'view') > 150 AS truncated FROM cd WHERE model_id = 'view' ORDER BY ts DESC LIMIT 150""")
def q_candles_recent(spark, folder):
    return sv.candles(_tables(spark, folder)[0], "view", limit=150)


@query("q_segments", "start_time:l end_time:l state:l n_bars:l duration_minutes:d", """
SELECT *, CAST(epoch(start_ts) AS BIGINT) AS start_time, CAST(epoch(end_ts) AS BIGINT) AS end_time FROM runs
WHERE series_id = 'click' AND end_ts >= TIMESTAMP '2024-01-05' AND start_ts <= TIMESTAMP '2024-01-20' ORDER BY start_ts DESC LIMIT 80""")
def q_segments(spark, folder):
    return sv.segments(_tables(spark, folder)[1], "click", "2024-01-05 00:00:00", "2024-01-20 00:00:00", 80)


@query("q_transitions", "time:l from_state:l to_state:l", """
SELECT *, CAST(epoch(ts) AS BIGINT) AS time FROM trans WHERE series_id = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC LIMIT 60""")
def q_transitions(spark, folder):
    return sv.transitions(_tables(spark, folder)[2], "click", "2024-01-05 00:00:00", "2024-01-20 00:00:00", 60)


@query("q_state_stats", "model_id bars:l labeled_bars:l state_transitions:l current_state:l current_duration:l longest_minutes:d regime regime_pct:d", """
cd AS (SELECT b.series_id AS model_id, b.ts, state, regime, duration FROM bars b LEFT JOIN valid v ON v.series_id = b.series_id AND v.pos = b.pos
 WHERE b.ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'),
g AS (SELECT model_id, count(*) AS bars, count(state) AS labeled_bars, arg_max(state, ts) FILTER (WHERE state IS NOT NULL) AS current_state,
 arg_max(duration, ts) FILTER (WHERE state IS NOT NULL) AS current_duration FROM cd GROUP BY 1)
;;
SELECT g.*, (SELECT count(*) FROM trans t WHERE t.series_id = g.model_id AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') AS state_transitions,
 (SELECT max(duration_minutes) FROM runs r WHERE r.series_id = g.model_id AND end_ts >= TIMESTAMP '2024-01-05' AND start_ts <= TIMESTAMP '2024-01-20') AS longest_minutes,
 r.regime, round(100.0 * r.n / g.labeled_bars, 2) AS regime_pct
FROM g LEFT JOIN (SELECT model_id, regime, count(*) AS n FROM cd WHERE regime IS NOT NULL GROUP BY 1, 2) r ON r.model_id = g.model_id""")
def q_state_stats(spark, folder):
    return sv.state_stats(*_tables(spark, folder), "2024-01-05 00:00:00", "2024-01-20 00:00:00")
