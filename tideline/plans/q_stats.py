"""Aggregations and statistics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.blocks import lookup, stage
from ..functions.columns import periods, safe_div, three_way
from ..functions import distributions as ds
from ..operators import gaps, metrics as mt, resample as rs, stats as st
from ..sources.tables import table
from . import inputs as inp
from .q_labels import LABEL, labelled
from .registry import query

K = inp.KEYS
H = {"h1": "fwd_1", "h2": "fwd_2", "h4": "fwd_4"}
LONG = """
lg AS (SELECT series_id, fold, state, regime, trend_sign, px_z, ts, 'h1' AS horizon, fwd_1 AS r FROM valid WHERE fwd_1 IS NOT NULL
 UNION ALL SELECT series_id, fold, state, regime, trend_sign, px_z, ts, 'h2', fwd_2 FROM valid WHERE fwd_2 IS NOT NULL
 UNION ALL SELECT series_id, fold, state, regime, trend_sign, px_z, ts, 'h4', fwd_4 FROM valid WHERE fwd_4 IS NOT NULL)
;;
"""


@query("run_stats", "series_id n_runs:l mean_bars:d median_bars:d min_bars:l max_bars:l pct_1bar:d pct_2bar:d pct_3bar:d pct_le5:d pct_le10:d "
       "pct_gt1h:d pct_gt2h:d pct_gt4h:d pct_gt8h:d n_transitions:l per_1k_bars:d per_day:d per_hour:d", """
a AS (SELECT series_id, count(*) AS n_runs, avg(n_bars) AS mean_bars, median(n_bars) AS median_bars, min(n_bars) AS min_bars, max(n_bars) AS max_bars,
 100 * avg(CAST(n_bars = 1 AS INT)) AS pct_1bar, 100 * avg(CAST(n_bars = 2 AS INT)) AS pct_2bar, 100 * avg(CAST(n_bars = 3 AS INT)) AS pct_3bar,
 100 * avg(CAST(n_bars <= 5 AS INT)) AS pct_le5, 100 * avg(CAST(n_bars <= 10 AS INT)) AS pct_le10, 100 * avg(CAST(duration_minutes > 60 AS INT)) AS pct_gt1h,
 100 * avg(CAST(duration_minutes > 120 AS INT)) AS pct_gt2h, 100 * avg(CAST(duration_minutes > 240 AS INT)) AS pct_gt4h,
 100 * avg(CAST(duration_minutes > 480 AS INT)) AS pct_gt8h FROM runs GROUP BY 1),
b AS (SELECT series_id, count(*) AS n, (epoch(max(ts)) - epoch(min(ts))) / 86400 AS days FROM valid GROUP BY 1),
t AS (SELECT series_id, count(*) AS n_transitions FROM trans GROUP BY 1)
;;
SELECT a.*, n_transitions, 1000.0 * n_transitions / n AS per_1k_bars, n_transitions / days AS per_day, n_transitions / (days * 24) AS per_hour
FROM a JOIN b USING (series_id) JOIN t USING (series_id)""")
def run_stats(spark, folder):
    m = stage(inp.marked(spark, folder))
    r = stage(gaps.state_runs(m, inp.MINUTES))
    return st.run_stats(r, m, gaps.transitions(r))


@query("state_stats", "series_id state:l n_bars:l pct_bars:d n_runs:l mean_minutes:d median_minutes:d max_minutes:d stay_prob:d", """
sp AS (SELECT series_id, prev_state AS state, avg(CASE WHEN state = prev_state THEN 1.0 ELSE 0.0 END) AS stay_prob FROM valid WHERE NOT new_segment GROUP BY 1, 2),
b AS (SELECT series_id, state, count(*) AS n_bars FROM valid GROUP BY 1, 2),
r AS (SELECT series_id, state, count(*) AS n_runs, avg(duration_minutes) AS mean_minutes, median(duration_minutes) AS median_minutes, max(duration_minutes) AS max_minutes FROM runs GROUP BY 1, 2)
;;
SELECT b.*, 100.0 * n_bars / sum(n_bars) OVER (PARTITION BY b.series_id) AS pct_bars, n_runs, mean_minutes, median_minutes, max_minutes, stay_prob
FROM b JOIN r ON r.series_id = b.series_id AND r.state = b.state LEFT JOIN sp ON sp.series_id = b.series_id AND sp.state = b.state""")
def state_stats(spark, folder):
    m = stage(inp.marked(spark, folder))
    return st.state_stats(m, gaps.state_runs(m, inp.MINUTES))


@query("state_occupancy", "series_id fold:l n_rows:l n_states:l n_labels:l max_share:d occ_0:d occ_1:d occ_2:d", """
c AS (SELECT series_id, fold, count(*) AS n_rows, count(DISTINCT state) AS n_states, count(DISTINCT regime) AS n_labels,
 100.0 * count(*) FILTER (WHERE state = 0) / count(*) AS o0, 100.0 * count(*) FILTER (WHERE state = 1) / count(*) AS o1,
 100.0 * count(*) FILTER (WHERE state = 2) / count(*) AS o2 FROM valid GROUP BY 1, 2)
;;
SELECT *, greatest(o0, o1, o2) AS max_share, nullif(o0, 0) AS occ_0, nullif(o1, 0) AS occ_1, nullif(o2, 0) AS occ_2 FROM c""")
def state_occupancy(spark, folder):
    o = st.occupancy(inp.valid_rows(spark, folder), ("series_id", "fold"))
    return o.withColumns({f"occ_{s}": F.try_element_at("occupancy", F.lit(s).cast("long")) for s in range(3)})


@query("forward_return_stats", "series_id state:l horizon n:l mean:d median:d std:d p_up:d p_big_up:d p_big_down:d", LONG + """
SELECT series_id, state, horizon, count(*) AS n, avg(r) AS mean, median(r) AS median, stddev_pop(r) AS std, 100 * avg(CAST(r > 0 AS INT)) AS p_up,
 100 * avg(CAST(r > 0.5 AS INT)) AS p_big_up, 100 * avg(CAST(r < -0.5 AS INT)) AS p_big_down FROM lg GROUP BY 1, 2, 3""")
def forward_return_stats(spark, folder):
    return st.forward_stats(stage(inp.valid_rows(spark, folder)), K, H, 0.5)


@query("return_summary", "regime n:l mean:d std:d std_err:d p5:d p25:d median:d p75:d p95:d pct_pos:d pct_neg:d mean_abs:d", """
SELECT regime, count(fwd_2) AS n, avg(fwd_2) AS mean, stddev_samp(fwd_2) AS std, stddev_samp(fwd_2) / sqrt(count(fwd_2)) AS std_err,
 quantile_cont(fwd_2, 0.05) AS p5, quantile_cont(fwd_2, 0.25) AS p25, median(fwd_2) AS median, quantile_cont(fwd_2, 0.75) AS p75, quantile_cont(fwd_2, 0.95) AS p95,
 100 * avg(CAST(fwd_2 > 0 AS INT)) AS pct_pos, 100 * avg(CAST(fwd_2 < 0 AS INT)) AS pct_neg, avg(abs(fwd_2)) AS mean_abs
FROM valid WHERE fwd_2 IS NOT NULL GROUP BY 1""")
def return_summary(spark, folder):
    return st.return_summary(stage(inp.valid_rows(spark, folder)), ("regime",), "fwd_2")


@query("percentile_table", "event_type n:l mean:d min:d max:d p1:d p5:d p10:d p25:d p50:d p75:d p90:d p95:d p99:d pct_above:d pct_below:d", """
SELECT event_type, count(*) AS n, avg(v) AS mean, min(v) AS min, max(v) AS max, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.1) AS p10,
 quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95,
 quantile_cont(v, 0.99) AS p99, 100 * avg(CAST(v > 0 AS INT)) AS pct_above, 100 * avg(CAST(v < 0 AS INT)) AS pct_below
FROM (SELECT event_type, value - 50 AS v FROM events) GROUP BY 1""")
def percentile_table(spark, folder):
    """Every event, not bars: the percentile of a whole large table."""
    e = table(spark, folder, "events").select("event_type", (F.col("value") - 50).alias("v"))
    return st.percentile_table(e, ("event_type",), "v")


@query("horizon_matrix", "horizon direction:l n:l hit_rate:d mean_aligned:d median_aligned:d auc:d", """
lg AS (SELECT * FROM (SELECT trend_sign, px_z, unnest(['h1', 'h2', 'h4']) AS horizon, unnest([fwd_1, fwd_2, fwd_4]) AS r FROM valid) WHERE r IS NOT NULL AND trend_sign <> 0),
rk AS (SELECT *, CAST(r > 0 AS INT) AS label, rank() OVER (PARTITION BY horizon, trend_sign ORDER BY px_z)
 + (count(*) OVER (PARTITION BY horizon, trend_sign, px_z) - 1) / 2.0 AS rk FROM lg)
;;
SELECT horizon, trend_sign AS direction, count(*) AS n, 100 * avg(CAST(trend_sign * r > 0 AS INT)) AS hit_rate, avg(trend_sign * r) AS mean_aligned, median(trend_sign * r) AS median_aligned,
 (sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc FROM rk GROUP BY 1, 2""")
def horizon_matrix(spark, folder):
    v = stage(inp.valid_rows(spark, folder))
    d = st.unpivot(v, [F.col("trend_sign").alias("direction"), F.col("px_z").alias("score")], H, "horizon", "r").filter("r IS NOT NULL AND direction <> 0")
    d = d.withColumns({"aligned": F.col("direction") * F.col("r"), "label": (F.col("r") > 0).cast("long")})
    k = ["horizon", "direction"]
    a = st.describe(d, k, "aligned", {"median_aligned": 0.5}, {
        "n": F.count("r"), "hit_rate": st.share(F.col("aligned") > 0), "mean_aligned": F.avg("aligned")})
    return a.join(mt.roc_auc(d, k).drop("n_pos", "n_neg"), k)


@query("label_characterisation", "regime n:l pct:d", "SELECT regime, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM valid GROUP BY 1")
def label_characterisation(spark, folder):
    c = stage(inp.valid_rows(spark, folder).groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("_k")))
    total = c.groupBy("_k").agg(F.sum("n").alias("_t"))
    return c.join(total, "_k").withColumns({"pct": F.col("n") / F.col("_t") * 100, "reliable": F.col("n") >= 20})


PAIRS = """
pr AS (SELECT * FROM (SELECT series_id, fold, regime AS from_regime, lead(regime) OVER w AS to_regime, lead(fwd_2) OVER w AS to_fwd_2
 FROM valid WINDOW w AS (PARTITION BY series_id, fold ORDER BY pos)) WHERE to_regime IS NOT NULL)
;;
"""


def _pairs(spark, folder):
    v = stage(inp.valid_rows(spark, folder))
    return st.next_row_pairs(v, ("series_id", "fold"), ("regime",), ("fwd_2",))


@query("label_transitions", "from_regime to_regime n:l reliable:b pct:d mean_ret:d pct_pos:d", PAIRS + """
SELECT from_regime, to_regime, n, n >= 20 AS reliable, pct, mean_ret, pct_pos FROM (
 SELECT from_regime, to_regime, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct, avg(to_fwd_2) AS mean_ret, 100 * avg(CAST(to_fwd_2 > 0 AS INT)) AS pct_pos
 FROM pr GROUP BY 1, 2)""")
def label_transitions(spark, folder):
    p = stage(_pairs(spark, folder).groupBy("from_regime", "to_regime").agg(
        F.count(F.lit(1)).alias("n"), F.avg("to_fwd_2").alias("mean_ret"), st.share(F.col("to_fwd_2") > 0).alias("pct_pos"), F.lit(1).alias("_k")))
    total = p.groupBy("_k").agg(F.sum("n").alias("_t"))
    return p.join(total, "_k").withColumns({"pct": F.col("n") / F.col("_t") * 100, "reliable": F.col("n") >= 20})


@query("transition_category", "category n:l mean_ret:d pct_pos:d", PAIRS.replace(";;", "") + """,
ct AS (SELECT *, split_part(from_regime, ' / ', 1) AS ft, split_part(to_regime, ' / ', 1) AS tt FROM pr)
;;
SELECT CASE WHEN from_regime = to_regime THEN 'SAME_STATE' WHEN ft = tt AND ft <> 'Ranging' THEN 'TREND_CONTINUATION' WHEN ft <> 'Ranging' AND tt = 'Ranging' THEN 'TREND_TO_RANGE'
 WHEN ft = 'Ranging' AND tt <> 'Ranging' THEN 'RANGE_TO_TREND' WHEN ft <> 'Ranging' AND tt <> 'Ranging' THEN 'TREND_REVERSAL' ELSE 'OTHER' END AS category,
 count(*) AS n, avg(to_fwd_2) AS mean_ret, 100 * avg(CAST(to_fwd_2 > 0 AS INT)) AS pct_pos FROM ct GROUP BY 1""")
def transition_category(spark, folder):
    p = _pairs(spark, folder).withColumn("category", st.transition_category("from_regime", "to_regime"))
    return p.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("to_fwd_2").alias("mean_ret"),
                                     st.share(F.col("to_fwd_2") > 0).alias("pct_pos"))


def _matrix_sql(where):
    return f"""
p AS (SELECT series_id, state AS from_state, lead(state) OVER w AS to_state, seg_no, lead(seg_no) OVER w AS ns FROM valid WINDOW w AS (PARTITION BY series_id ORDER BY pos))
;;
SELECT series_id, from_state, to_state, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY series_id, from_state) AS p FROM p WHERE {where} GROUP BY 1, 2, 3"""


@query("transition_matrix", "series_id from_state:l to_state:l n:l p:d", _matrix_sql("to_state IS NOT NULL"))
def transition_matrix(spark, folder):
    return st.transition_matrix(stage(inp.valid_rows(spark, folder).select("series_id", "pos", "state")))


@query("transition_matrix_within", "series_id from_state:l to_state:l n:l p:d", _matrix_sql("ns = seg_no"))
def transition_matrix_within(spark, folder):
    m = stage(inp.marked(spark, folder).select("series_id", "pos", "state", "seg_start"))
    return st.transition_matrix(m, within_segment=True)


@query("fold_label_join", "series_id ts:t fold:l state:l fold_label", """
fl AS (SELECT fold, state, CASE WHEN avg(px_z) > 0.3 THEN 'Uptrend' WHEN avg(px_z) < -0.3 THEN 'Downtrend' ELSE 'Ranging' END AS fold_label FROM valid GROUP BY 1, 2)
;;
SELECT v.series_id, v.ts, v.fold, v.state, fold_label FROM valid v JOIN fl ON fl.fold = v.fold AND fl.state = v.state""")
def fold_label_join(spark, folder):
    v = stage(inp.valid_rows(spark, folder).select("series_id", "ts", "fold", "state", "px_z"))
    labels = v.groupBy("fold", "state").agg(F.avg("px_z").alias("m"))
    return lookup(v, labels.withColumn("fold_label", three_way("m", 0.3, "Downtrend", "Ranging", "Uptrend")).drop("m"), ["fold", "state"])


@query("prev_next_context", "series_id state:l prev_state:l next_state:l n_bars:l", """
SELECT series_id, state, p AS prev_state, q AS next_state, CAST(sum(n_bars) AS BIGINT) AS n_bars FROM (
 SELECT r.*, (SELECT arg_max(state, run_start) FROM runs a WHERE a.series_id = r.series_id AND a.run_start < r.run_start AND a.state <> r.state) AS p,
  (SELECT arg_min(state, run_start) FROM runs a WHERE a.series_id = r.series_id AND a.run_start > r.run_start AND a.state <> r.state) AS q FROM runs r) GROUP BY 1, 2, 3, 4""")
def prev_next_context(spark, folder):
    r = stage(inp.runs(spark, folder).select("series_id", "run_start", "state", "n_bars"))
    return st.prev_next_context(r).groupBy("series_id", "state", "prev_state", "next_state").agg(F.sum("n_bars").alias("n_bars"))


SEGMENTS = ("dim val n:l rate:d mean_score:d tier n_folds:l auc:d average_precision:d fold_auc_mean:d fold_auc_std:d folds_above:l folds_below:l "
            "n_folds_with_auc:l")
DIMS = """
qe AS (SELECT list_distinct(quantile_cont(confidence, [0.0, 0.25, 0.5, 0.75, 1.0])) AS ce, list_distinct(quantile_cont(score, [0.0, 0.25, 0.5, 0.75, 1.0])) AS se,
 list_distinct(quantile_cont(CAST(duration AS DOUBLE), [0.0, 0.3333333333333333, 0.6666666666666666, 1.0])) AS de FROM lab WHERE label IS NOT NULL),
sg AS (SELECT lab.*, greatest(len(list_filter(ce, lambda x: x < confidence)) - 1, 0) AS cq, greatest(len(list_filter(se, lambda x: x < score)) - 1, 0) AS sq,
 greatest(len(list_filter(de, lambda x: x < duration)) - 1, 0) AS dq FROM lab, qe WHERE label IS NOT NULL),
dm AS (SELECT label, score, fold, unnest(['direction', 'state_label', 'volatility', 'weekday', 'session', 'year', 'confidence', 'score', 'duration']) AS dim,
 unnest([CAST(trend_sign AS VARCHAR), regime, split_part(regime, ' / ', 2), CAST(isodow(ts) AS VARCHAR), CASE WHEN hour(ts) < 8 THEN 'night' WHEN hour(ts) < 16 THEN 'day' ELSE 'evening' END,
  CAST(year(ts) AS VARCHAR), CAST(cq AS VARCHAR), CAST(sq AS VARCHAR), CAST(dq AS VARCHAR)]) AS val FROM sg),
rk AS (SELECT *, rank() OVER g + (count(*) OVER (PARTITION BY dim, val, score) - 1) / 2.0 AS rk FROM dm WINDOW g AS (PARTITION BY dim, val ORDER BY score)),
au AS (SELECT dim, val, count(*) AS n, 100 * avg(label) AS rate, avg(score) AS mean_score, count(DISTINCT fold) AS n_folds, sum(label) AS p, count(*) - sum(label) AS q,
 CASE WHEN n < 30 OR p < 10 OR q < 10 THEN 'INSUFFICIENT' WHEN n < 60 OR p < 25 OR q < 25 THEN 'LOW-CONFIDENCE' ELSE 'RELIABLE' END AS tier,
 CASE WHEN p > 0 AND q > 0 THEN (sum(rk) FILTER (WHERE label = 1) - p * (p + 1) / 2.0) / (p * q) END AS auc FROM rk GROUP BY 1, 2),
ap AS (SELECT dim, val, sum(CAST(p AS DOUBLE) / tot * cp / (cp + cq)) AS average_precision FROM (
 SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq, sum(p) OVER (PARTITION BY dim, val) AS tot FROM (
  SELECT dim, val, score, sum(label) AS p, count(*) - sum(label) AS q FROM dm GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY dim, val ORDER BY score DESC)) GROUP BY 1, 2),
fr AS (SELECT *, rank() OVER g + (count(*) OVER (PARTITION BY dim, val, fold, score) - 1) / 2.0 AS rk FROM dm WINDOW g AS (PARTITION BY dim, val, fold ORDER BY score)),
fa AS (SELECT dim, val, fold, (sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS a
 FROM fr GROUP BY 1, 2, 3 HAVING count(*) >= 20 AND sum(label) BETWEEN 1 AND count(*) - 1),
fs AS (SELECT dim, val, avg(a) AS fold_auc_mean, stddev_pop(a) AS fold_auc_std, count(*) FILTER (WHERE a > 0.5) AS up, count(*) FILTER (WHERE a < 0.5) AS down, count(*) AS m FROM fa GROUP BY 1, 2)
;;
"""


def segment_dims():
    h = F.hour("ts")
    return {"direction": F.col("trend_sign"), "state_label": F.col("regime"), "volatility": F.split_part(F.col("regime"), F.lit(" / "), F.lit(2)),
            "weekday": F.weekday("ts") + 1, "session": F.when(h < 8, "night").when(h < 16, "day").otherwise("evening"), "year": F.year("ts")}


@query("segment_breakdown", SEGMENTS, LABEL.replace(";;", ",") + DIMS + """
SELECT au.* REPLACE (CASE WHEN tier <> 'INSUFFICIENT' THEN auc END AS auc), CASE WHEN tier <> 'INSUFFICIENT' AND au.auc IS NOT NULL THEN average_precision END AS average_precision,
 fold_auc_mean, fold_auc_std, coalesce(up, 0) AS folds_above, coalesce(down, 0) AS folds_below, coalesce(m, 0) AS n_folds_with_auc
FROM au JOIN ap USING (dim, val) LEFT JOIN fs USING (dim, val)""")
def segment_breakdown(spark, folder):
    """All dimensions in the same jobs; the threshold states have a score where a decoded state has its stay probability and margin
    (segment_breakdown_walk has those)."""
    lab = labelled(spark, folder, inp.marked(spark, folder))
    return st.segment_breakdown(stage(lab), segment_dims(), {"confidence": ("confidence", 4), "score": ("score", 4), "duration": ("duration", 3)}, 30, 60, 10, 25)


@query("quantile_buckets", "series_id bucket:l n:l lo:d hi:d", """
e AS (SELECT series_id, list_distinct(quantile_cont(confidence, [0.0, 0.25, 0.5, 0.75, 1.0])) AS ed FROM valid GROUP BY 1),
b AS (SELECT v.*, greatest(len(list_filter(ed, lambda x: x < confidence)) - 1, 0) AS bucket FROM valid v JOIN e USING (series_id))
;;
SELECT series_id, bucket, count(*) AS n, min(confidence) AS lo, max(confidence) AS hi FROM b GROUP BY 1, 2""")
def quantile_buckets(spark, folder):
    v = stage(inp.valid_rows(spark, folder).select("series_id", "confidence"))
    return mt.quantile_bucket(v, K, "confidence", 4).groupBy("series_id", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))


@query("sample_tier", "series_id regime n:l tier", LABEL + """
SELECT *, CASE WHEN n < 30 OR p < 10 OR q < 10 THEN 'INSUFFICIENT' WHEN n < 60 OR p < 25 OR q < 25 THEN 'LOW-CONFIDENCE' ELSE 'RELIABLE' END AS tier FROM (
 SELECT series_id, regime, count(label) AS n, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM lab GROUP BY 1, 2)""")
def sample_tier(spark, folder):
    g = labelled(spark, folder).groupBy("series_id", "regime").agg(
        F.count("label").alias("n"), F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    return g.withColumn("tier", st.sample_tier("n", "p", "q", 30, 60, 10, 25))


# scored events: a label for two of the event types, two scores, weekly folds

SCORED = """
sc AS (SELECT CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 604800) AS BIGINT) AS fold, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 END AS label,
 value / 600 AS score, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS score_b, ts FROM events),
sl AS (SELECT * FROM sc WHERE label IS NOT NULL),
au AS (SELECT fold, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc,
 (sum(rb) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc_b, sum(label) AS n_pos, count(*) - sum(label) AS n_neg
 FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r,
  rank() OVER (PARTITION BY fold ORDER BY score_b) + (count(*) OVER (PARTITION BY fold, score_b) - 1) / 2.0 AS rb FROM sl) GROUP BY 1)
;;
"""


def scored(spark, folder):
    week = periods("2024-01-01 00:00:00", 7)
    label = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 0).cast("long")
    return table(spark, folder, "events").select(
        week.alias("fold"), label.alias("label"), (F.col("value") / 600).alias("score"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("double") / 100).alias("score_b"), "ts")


@query("roc_auc", "fold:l n_pos:l n_neg:l auc:d", SCORED + "SELECT * FROM au")
def roc_auc(spark, folder):
    return mt.roc_auc(scored(spark, folder), ["fold"])


@query("pr_auc", "fold:l average_precision:d", SCORED + """
SELECT fold, sum(CAST(p AS DOUBLE) / tot * cp / (cp + cq)) AS average_precision FROM (
 SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq, sum(p) OVER (PARTITION BY fold) AS tot FROM (
  SELECT fold, score, sum(label) AS p, count(*) - sum(label) AS q FROM sl GROUP BY 1, 2) WINDOW w AS (PARTITION BY fold ORDER BY score DESC)) GROUP BY 1""")
def pr_auc(spark, folder):
    return mt.average_precision(scored(spark, folder), ["fold"])


CLIPPED = "greatest(least(score, 1 - 1e-15), 1e-15)"


@query("log_loss", "fold:l log_loss:d", SCORED + f"SELECT fold, avg(-CASE WHEN label = 1 THEN ln({CLIPPED}) ELSE ln(1 - {CLIPPED}) END) AS log_loss FROM sl GROUP BY 1")
def log_loss(spark, folder):
    return mt.losses(scored(spark, folder), ["fold"])


@query("brier", "fold:l brier:d", SCORED + "SELECT fold, avg((score - label) * (score - label)) AS brier FROM sl GROUP BY 1")
def brier(spark, folder):
    return mt.losses(scored(spark, folder), ["fold"])


@query("classification_counts", "fold:l tp:l fp:l fn:l tn:l accuracy:d precision:d recall:d f1:d balanced_accuracy:d pass_rate:d block_rate:d", SCORED + """
SELECT *, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall,
 coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) + coalesce(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 0)) / 2 AS balanced_accuracy,
 (tp + fp) / CAST(tp + fp + fn + tn AS DOUBLE) AS pass_rate, (fn + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS block_rate FROM (
 SELECT fold, count(*) FILTER (WHERE score >= 0.1 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.1 AND label = 0) AS fp,
  count(*) FILTER (WHERE score < 0.1 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.1 AND label = 0) AS tn FROM sl GROUP BY 1)""")
def classification_counts(spark, folder):
    return mt.classification(scored(spark, folder), ["fold"], F.col("score") >= 0.1)


@query("calibration_table", "fold:l bucket:l n:l mean_predicted:d realised:d", SCORED.replace(";;", ",") + """
e AS (SELECT fold, list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS ed FROM sl GROUP BY 1)
;;
SELECT fold, bucket, count(*) AS n, avg(score) AS mean_predicted, avg(label) AS realised FROM (
 SELECT s.*, greatest(len(list_filter(ed, lambda x: x < score)) - 1, 0) AS bucket FROM sl s JOIN e USING (fold)) GROUP BY 1, 2""")
def calibration_table(spark, folder):
    return mt.calibration(scored(spark, folder), ["fold"])


CUT = "SELECT * FROM sl, (SELECT unnest([0.02, 0.05, 0.1, 0.2]) AS cutoff)"


@query("threshold_table", "fold:l cutoff:d n_signals:l hit_rate:d recall:d f1:d", SCORED + f"""
SELECT fold, cutoff, ns AS n_signals, tp / CAST(nullif(ns, 0) AS DOUBLE) AS hit_rate, coalesce(tp / CAST(nullif(p, 0) AS DOUBLE), 0) AS recall, coalesce(2.0 * tp / nullif(ns + p, 0), 0) AS f1 FROM (
 SELECT fold, cutoff, count(*) FILTER (WHERE score >= cutoff) AS ns, count(*) FILTER (WHERE score >= cutoff AND label = 1) AS tp, count(*) FILTER (WHERE label = 1) AS p FROM ({CUT}) GROUP BY 1, 2)""")
def threshold_table(spark, folder):
    return mt.at_cutoffs(scored(spark, folder), ["fold"], (0.02, 0.05, 0.1, 0.2))


@query("threshold_sweep", "cut:d n_eligible:l coverage_pct:d n_folds:l positive_pct:d aligned_mean:d", """
SELECT cut, count(*) FILTER (WHERE hit) AS n_eligible, 100.0 * count(*) FILTER (WHERE hit) / count(*) AS coverage_pct, count(DISTINCT CASE WHEN hit THEN fold END) AS n_folds,
 100 * avg(CASE WHEN hit THEN CAST(sign(px_z) * fwd_2 > 0 AS INT) END) AS positive_pct, avg(CASE WHEN hit THEN sign(px_z) * fwd_2 END) AS aligned_mean FROM (
 SELECT *, abs(px_z) > cut AND fwd_2 IS NOT NULL AS hit FROM valid, (SELECT unnest([0.1, 0.15, 0.2, 0.25, 0.3, 0.5, 1.0]) AS cut)) GROUP BY 1""")
def threshold_sweep(spark, folder):
    """Each row meets the fixed list of thresholds once; folds are counted from per-fold partial counts."""
    v = inp.valid_rows(spark, folder).select("fold", "px_z", "fwd_2", F.explode(F.array(*[F.lit(c) for c in (0.1, 0.15, 0.2, 0.25, 0.3, 0.5, 1.0)])).alias("cut"))
    hit = (F.abs("px_z") > F.col("cut")) & F.col("fwd_2").isNotNull()
    a = F.when(hit, F.signum("px_z") * F.col("fwd_2"))
    f = v.groupBy("cut", "fold").agg(F.count(F.lit(1)).alias("n"), F.count(a).alias("e"), F.count_if(a > 0).alias("p"), F.sum(a).alias("s"))
    g = f.groupBy("cut").agg(F.sum("n").alias("n"), F.sum("e").alias("n_eligible"), F.count_if(F.col("e") > 0).alias("n_folds"),
                             F.sum("p").alias("p"), F.sum("s").alias("s"))
    return g.withColumns({"coverage_pct": F.col("n_eligible") / F.col("n") * 100, "positive_pct": safe_div("p", "n_eligible") * 100,
                          "aligned_mean": safe_div("s", "n_eligible")})


def _fold_aucs(spark, folder):
    s = stage(scored(spark, folder))
    b = s.withColumn("score", F.col("score_b"))
    return mt.roc_auc(s, ["fold"]).withColumn("model", F.lit("a")), mt.roc_auc(b, ["fold"]).withColumn("model", F.lit("b"))


@query("fold_metric_summary", "model n_folds:l mean:d median:d std:d above_50:l above_52:l", SCORED + """
SELECT model, count(*) AS n_folds, avg(x) AS mean, median(x) AS median, stddev_pop(x) AS std, count(*) FILTER (WHERE x > 0.5) AS above_50, count(*) FILTER (WHERE x > 0.52) AS above_52
FROM (SELECT unnest(['a', 'b']) AS model, unnest([auc, auc_b]) AS x FROM au) GROUP BY 1""")
def fold_metric_summary(spark, folder):
    a, b = _fold_aucs(spark, folder)
    return st.fold_metric_summary(a.unionByName(b), ["model"], "auc")


@query("fold_delta", "n_folds:l wins:l mean:d median:d std:d min:d max:d pct_positive:d", SCORED + """
SELECT count(*) AS n_folds, count(*) FILTER (WHERE d > 0) AS wins, avg(d) AS mean, median(d) AS median, stddev_samp(d) AS std, min(d) AS min, max(d) AS max, 100 * avg(CAST(d > 0 AS INT)) AS pct_positive
FROM (SELECT auc - auc_b AS d FROM au)""")
def fold_delta(spark, folder):
    a, b = _fold_aucs(spark, folder)
    return st.fold_delta(a, b, ["fold"], "auc")


@query("verdict_rule", "fold:l d_auc:d train_gap:d rejected:b", SCORED.replace(";;", ",") + """
tr AS (SELECT fold, (sum(rb) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS tb
 FROM (SELECT a.fold, s.label, rank() OVER (PARTITION BY a.fold ORDER BY s.score_b) + (count(*) OVER (PARTITION BY a.fold, s.score_b) - 1) / 2.0 AS rb FROM au a JOIN sl s ON s.fold < a.fold) GROUP BY 1),
lo AS (SELECT fold, avg(-CASE WHEN label = 1 THEN ln(greatest(score, 1e-15)) ELSE ln(1 - score) END) AS la, avg(-CASE WHEN label = 1 THEN ln(greatest(score_b, 1e-15)) ELSE ln(greatest(1 - score_b, 1e-15)) END) AS lb,
 avg((score - label) ** 2) AS ba, avg((score_b - label) ** 2) AS bb FROM sl GROUP BY 1)
;;
SELECT fold, auc_b - auc AS d_auc, tb - auc_b AS train_gap, abs(auc_b - auc) < 0.003 OR (lb > la AND bb > ba) OR coalesce(tb - auc_b > 0.10, false) AS rejected
FROM au JOIN lo USING (fold) LEFT JOIN tr USING (fold)""")
def verdict_rule(spark, folder):
    """Model b against a: rejected when the gain is negligible, both losses are worse, or its AUC on the rows before the fold is
    more than 0.10 above the fold's."""
    s = stage(scored(spark, folder).filter("label IS NOT NULL"))
    train = st.pool_auc(s.select("fold", "label", F.col("score_b").alias("score"))).withColumnRenamed("auc", "_train")
    sb = s.withColumn("score", F.col("score_b"))
    side = lambda d, t: mt.roc_auc(d, ["fold"]).join(mt.losses(d, ["fold"]), "fold").select(
        "fold", *[F.col(c).alias(f"{c}_{t}") for c in ("auc", "log_loss", "brier")])
    j = side(s, "a").join(side(sb, "b"), "fold").join(train, "fold", "left").withColumns(
        {"d_auc": F.col("auc_b") - F.col("auc_a"), "train_gap": F.col("_train") - F.col("auc_b")})
    worse = (F.col("log_loss_b") > F.col("log_loss_a")) & (F.col("brier_b") > F.col("brier_a"))
    return j.withColumn("rejected", (F.abs("d_auc") < 0.003) | worse | F.coalesce(F.col("train_gap") > 0.10, F.lit(False)))


@query("class_balance", "fold:l n:l n_pos:l pos_pct:d pool_pos_pct:d", SCORED + """
SELECT fold, n, n_pos, 100.0 * n_pos / n AS pos_pct, 100.0 * sum(n_pos) OVER w / sum(n) OVER w AS pool_pos_pct FROM (SELECT fold, count(*) AS n, sum(label) AS n_pos FROM sl GROUP BY 1)
WINDOW w AS (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def class_balance(spark, folder):
    g = scored(spark, folder).filter("label IS NOT NULL").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"))
    w = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # one row per fold
    return g.withColumns({"pos_pct": F.col("n_pos") / F.col("n") * 100, "pool_pos_pct": F.sum("n_pos").over(w) / F.sum("n").over(w) * 100})


# two labelings of the same rows: the threshold state and a state from volume

TWO = """
tw AS (SELECT series_id, pos, fold, state, CASE WHEN vol_z > 0.5 THEN 2 WHEN vol_z < -0.5 THEN 0 ELSE 1 END AS state_b FROM valid)
;;
"""


def two_labelings(spark, folder):
    return inp.valid_rows(spark, folder).select("series_id", "pos", "fold", "state", three_way("vol_z", 0.5, 0, 1, 2).cast("long").alias("state_b"))


@query("crosstab", "series_id state:l b_0:l b_1:l b_2:l", TWO + """
SELECT series_id, state, count(*) FILTER (WHERE state_b = 0) AS b_0, count(*) FILTER (WHERE state_b = 1) AS b_1, count(*) FILTER (WHERE state_b = 2) AS b_2 FROM tw GROUP BY 1, 2""")
def crosstab(spark, folder):
    p = two_labelings(spark, folder).groupBy("series_id", "state").pivot("state_b", [0, 1, 2]).count()
    return p.select("series_id", "state", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"b_{i}") for i in range(3)])


@query("label_agreement", "series_id n:l agree_pct:d n_both:l both_pct:d", TWO + """
SELECT series_id, count(*) AS n, 100 * avg(CAST(state = state_b AS INT)) AS agree_pct, count(*) FILTER (WHERE state <> 1 AND state_b <> 1) AS n_both,
 100 * avg(CASE WHEN state <> 1 AND state_b <> 1 THEN CAST(state = state_b AS INT) END) AS both_pct FROM tw GROUP BY 1""")
def label_agreement(spark, folder):
    same = (F.col("state") == F.col("state_b")).cast("double")
    both = (F.col("state") != 1) & (F.col("state_b") != 1)
    return two_labelings(spark, folder).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(same) * 100).alias("agree_pct"), F.count_if(both).alias("n_both"),
        (F.avg(F.when(both, same)) * 100).alias("both_pct"))


@query("table_agreement", "series_id n_a:l n_b:l n_common:l only_a:l only_b:l common_pct:d agree_pct:d", """
tb AS (SELECT series_id, pos, CASE WHEN px_z > 0.3 THEN 2 WHEN px_z < -0.3 THEN 0 ELSE 1 END AS state FROM f2 WHERE px_z IS NOT NULL AND n_ticks >= 2),
tu AS (SELECT series_id, pos, 1 AS a, 0 AS b, state FROM valid UNION ALL SELECT series_id, pos, 0, 1, state FROM tb),
tp AS (SELECT series_id, pos, sum(a) AS a, sum(b) AS b, min(state) = max(state) AS same FROM tu GROUP BY 1, 2)
;;
SELECT series_id, sum(a) AS n_a, sum(b) AS n_b, count(*) FILTER (WHERE a + b = 2) AS n_common, count(*) FILTER (WHERE b = 0) AS only_a, count(*) FILTER (WHERE a = 0) AS only_b,
 100.0 * n_common / greatest(n_a, n_b) AS common_pct, 100 * avg(CAST(same AS INT)) FILTER (WHERE a + b = 2) AS agree_pct FROM tp GROUP BY 1""")
def table_agreement(spark, folder):
    """States of all valid rows against those of a narrower cut, read from bars of at least two events whatever their other features."""
    bars = inp.bar_table(spark, folder)
    b = inp.featured(spark, folder, bars).filter("px_z IS NOT NULL AND n_ticks >= 2")
    return mt.table_agreement(inp.valid_rows(spark, folder, source=bars), b.withColumn("state", three_way("px_z", 0.3, 0, 1, 2).cast("long")), K, "pos", "state")


@query("adjusted_rand", "series_id n:l ari:d", TWO.replace(";;", ",") + """
c AS (SELECT series_id, state, state_b, count(*) AS n FROM tw GROUP BY 1, 2, 3),
ij AS (SELECT series_id, sum(n * (n - 1) / 2.0) AS s, sum(n) AS n FROM c GROUP BY 1),
a AS (SELECT series_id, sum(m * (m - 1) / 2.0) AS s FROM (SELECT series_id, state, sum(n) AS m FROM c GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT series_id, sum(m * (m - 1) / 2.0) AS s FROM (SELECT series_id, state_b, sum(n) AS m FROM c GROUP BY 1, 2) GROUP BY 1)
;;
SELECT series_id, ij.n AS n, (ij.s - a.s * b.s / (ij.n * (ij.n - 1) / 2.0)) / ((a.s + b.s) / 2 - a.s * b.s / (ij.n * (ij.n - 1) / 2.0)) AS ari
FROM ij JOIN a USING (series_id) JOIN b USING (series_id)""")
def adjusted_rand(spark, folder):
    return mt.adjusted_rand(stage(two_labelings(spark, folder)), K, "state", "state_b")


@query("pearson_pair", "series_id horizon n:l r:d", LONG + "SELECT series_id, horizon, count(*) AS n, CASE WHEN count(*) > 10 THEN corr(px_z, r) END AS r FROM lg GROUP BY 1, 2")
def pearson_pair(spark, folder):
    d = st.unpivot(inp.valid_rows(spark, folder), ["series_id", "px_z"], H, "horizon", "f").filter("f IS NOT NULL")
    g = d.groupBy("series_id", "horizon").agg(F.count(F.lit(1)).alias("n"), F.corr("px_z", "f").alias("_r"))
    return g.withColumn("r", F.when(F.col("n") > 10, F.col("_r")))


FEATS = ("ret_1", "ret_4", "vol_6", "vol_z", "ofi_z", "skew_6", "asym_6")


@query("correlation_matrix", "a b r:d", "\nUNION ALL ".join(
    f"SELECT '{x}' AS a, '{y}' AS b, corr({x}, {y}) AS r FROM valid" for x in FEATS for y in FEATS))
def correlation_matrix(spark, folder):
    return st.correlation_matrix(inp.valid_rows(spark, folder), FEATS)


@query("null_counts", "feature n:l n_null:l", "\nUNION ALL ".join(
    f"SELECT '{x}' AS feature, count(*) AS n, count(*) FILTER (WHERE {x} IS NULL) AS n_null FROM f2 WHERE close IS NOT NULL" for x in FEATS))
def null_counts(spark, folder):
    return st.null_counts(inp.featured(spark, folder), FEATS)


@query("kruskal_wallis", "series_id horizon n:l n_groups:l h_stat:d p_value:d", """
lg AS (SELECT * FROM (SELECT series_id, state, unnest(['h1', 'h2', 'h4']) AS horizon, unnest([fwd_1, fwd_2, fwd_4]) AS r FROM valid) WHERE r IS NOT NULL),
ok AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id, horizon, state) AS g FROM lg) WHERE g > 10),
rk AS (SELECT *, rank() OVER (PARTITION BY series_id, horizon ORDER BY r) + (count(*) OVER (PARTITION BY series_id, horizon, r) - 1) / 2.0 AS rk,
 count(*) OVER (PARTITION BY series_id, horizon, r) AS tie FROM ok),
s AS (SELECT series_id, horizon, sum(rs * rs / m) AS s, count(*) AS n_groups FROM (SELECT series_id, horizon, state, sum(rk) AS rs, count(*) AS m FROM rk GROUP BY 1, 2, 3) GROUP BY 1, 2),
t AS (SELECT series_id, horizon, count(*) AS n, sum(CAST(tie AS DOUBLE) * tie - 1) AS t FROM rk GROUP BY 1, 2),
kw AS (SELECT series_id, horizon, n, n_groups, (12.0 / (n * (n + 1.0)) * s - 3 * (n + 1)) / (1 - t / (CAST(n AS DOUBLE) * n * n - n)) AS h_stat, (n_groups - 1) / 2.0 AS a FROM s JOIN t USING (series_id, horizon) WHERE n_groups >= 2)
;;
SELECT series_id, horizon, n, n_groups, h_stat, CASE WHEN h_stat <= 0 THEN 1.0 ELSE greatest(0, 1 - exp(-h_stat / 2 + a * ln(h_stat / 2) - lgamma(a)) * list_reduce(list_prepend(struct_pack(t := CAST(1 / a AS DOUBLE), s := CAST(1 / a AS DOUBLE)),
  list_transform(range(1, 300), lambda i: struct_pack(t := CAST(i AS DOUBLE), s := CAST(0 AS DOUBLE)))), lambda x, y: struct_pack(t := x.t * h_stat / 2 / (a + y.t), s := x.s + x.t * h_stat / 2 / (a + y.t))).s) END AS p_value FROM kw""")
def kruskal_wallis(spark, folder):
    v = inp.valid_rows(spark, folder)
    d = stage(st.unpivot(v, ["series_id", "state"], H, "horizon", "f"))
    return mt.kruskal(d, ["series_id", "horizon"], "state", "f").withColumn("p_value", ds.chi2_tail(F.greatest("h_stat", F.lit(0.0)), F.col("n_groups") - 1))


@query("bootstrap_auc_ci", "fold:l n_replicates:l mean_auc:d lo:d hi:d")
def bootstrap_auc_ci(spark, folder):
    return st.bootstrap_auc(scored(spark, folder), ["fold"], 2_000)


@query("block_bootstrap_ci", "series_id n_replicates:l mean_diff:d lo:d hi:d excludes_zero:b")
def block_bootstrap_ci(spark, folder):
    up = F.when(F.col("trend_sign") == 1, True).when(F.col("trend_sign") == -1, False)
    return st.block_bootstrap(inp.valid_rows(spark, folder), K, up, "fwd_2", 24, 2_000)


def _effect_sql(first, where="true"):
    return f"""
g AS (SELECT series_id, fwd_2 AS x, {first} AS f FROM valid WHERE fwd_2 IS NOT NULL AND {where})
;;
SELECT series_id, n1, n2, mean1, mean2, mean1 - mean2 AS mean_diff, md1 - md2 AS median_diff, p1 - p2 AS positive_diff,
 (mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS cohens_d FROM (
 SELECT series_id, count(*) FILTER (WHERE f) AS n1, count(*) FILTER (WHERE NOT f) AS n2, avg(x) FILTER (WHERE f) AS mean1, avg(x) FILTER (WHERE NOT f) AS mean2,
  median(x) FILTER (WHERE f) AS md1, median(x) FILTER (WHERE NOT f) AS md2, var_samp(x) FILTER (WHERE f) AS v1, var_samp(x) FILTER (WHERE NOT f) AS v2,
  avg(CAST(x > 0 AS INT)) FILTER (WHERE f) AS p1, avg(CAST(x > 0 AS INT)) FILTER (WHERE NOT f) AS p2 FROM g GROUP BY 1)"""


EFFECT = "series_id n1:l n2:l mean1:d mean2:d mean_diff:d median_diff:d positive_diff:d cohens_d:d"


@query("effect_size", EFFECT, _effect_sql("vol_z > 0"))
def effect_size(spark, folder):
    return mt.effect_size(stage(inp.valid_rows(spark, folder)), K, F.col("vol_z") > 0, "fwd_2")


TREND_SCORE = "(ret_1 + ret_2 + ret_4) / 3"


@query("split_by_sign", EFFECT, _effect_sql(f"{TREND_SCORE} > 0", "regime LIKE '%High-Vol'"))
def split_by_sign(spark, folder):
    """High-volatility rows split by the sign of their mean return."""
    v = stage(inp.valid_rows(spark, folder).filter(F.col("regime").endswith("High-Vol")))
    return mt.effect_size(v, K, F.expr(TREND_SCORE) > 0, "fwd_2")


@query("split_by_threshold", EFFECT, _effect_sql(f"CASE WHEN {TREND_SCORE} > 0.3 THEN true WHEN {TREND_SCORE} < -0.3 THEN false END", f"abs({TREND_SCORE}) > 0.3"))
def split_by_threshold(spark, folder):
    v = stage(inp.valid_rows(spark, folder))
    s = F.expr(TREND_SCORE)
    return mt.effect_size(v, K, F.when(s > 0.3, True).when(s < -0.3, False), "fwd_2")


@query("contemporaneous_stats", "regime horizon:l n:l back_mean:d fwd_mean:d back_pos:d fwd_pos:d", """
c AS (SELECT regime, unnest([1, 2, 4]) AS horizon, unnest([ret_1, ret_2, ret_4]) AS b, unnest([fwd_1, fwd_2, fwd_4]) AS f FROM valid)
;;
SELECT regime, horizon, count(*) AS n, avg(b) AS back_mean, avg(f) AS fwd_mean, 100 * avg(CAST(b > 0 AS INT)) AS back_pos, 100 * avg(CAST(f > 0 AS INT)) AS fwd_pos FROM c GROUP BY 1, 2""")
def contemporaneous_stats(spark, folder):
    v = inp.valid_rows(spark, folder)
    d = v.select("regime", F.inline(F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"ret_{h}").alias("b"), F.col(f"fwd_{h}").alias("f")) for h in inp.HORIZONS])))
    return d.groupBy("regime", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("b").alias("back_mean"), F.avg("f").alias("fwd_mean"),
                                              st.share(F.col("b") > 0).alias("back_pos"), st.share(F.col("f") > 0).alias("fwd_pos"))


@query("paired_tests", "n:l wins:l mean:d t_stat:d t_p:d w_plus:d w_minus:d w_p:d first_half:d second_half:d", SCORED.replace(";;", ",") + """
d AS (SELECT fold, auc - auc_b AS d FROM au), m AS (SELECT median(fold) AS h FROM d),
w AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, row_number() OVER (ORDER BY abs(d), fold) AS k FROM d WHERE d <> 0),
dp(k, w, p) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
 SELECT dp.k + 1, dp.w + s.s * CAST(w.r AS DOUBLE), sum(dp.p) / 2 FROM dp JOIN w ON w.k = dp.k + 1 CROSS JOIN (VALUES (0), (1)) s(s) GROUP BY 1, 2),
sr AS (SELECT CASE WHEN max(k) > 0 THEN least(1, 2 * least(sum(p) FILTER (WHERE k = n AND w <= wp), sum(p) FILTER (WHERE k = n AND w >= wp))) END AS w_p
 FROM dp, (SELECT count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS wp FROM w)),
st AS (SELECT count(*) - 1 AS v, abs(avg(d) / (stddev_samp(d) / sqrt(count(*)))) AS t FROM d),
sa AS (SELECT v, atan(t / sqrt(v)) AS q FROM st),
tp AS (SELECT CASE WHEN v % 2 = 1 THEN 1 - 2 / pi() * (q + CASE WHEN v > 1 THEN sin(q) * list_sum(list_transform(range(0, (v - 1) // 2), lambda k:
   pow(cos(q), 2 * k + 1) * coalesce(list_product(list_transform(range(1, k + 1), lambda i: 2.0 * i / (2 * i + 1))), 1))) ELSE 0 END)
  ELSE 1 - sin(q) * list_sum(list_transform(range(0, v // 2), lambda k: pow(cos(q), 2 * k) * coalesce(list_product(list_transform(range(1, k + 1), lambda i: (2.0 * i - 1) / (2 * i))), 1))) END AS t_p FROM sa WHERE v >= 1)
;;
SELECT count(*) AS n, (SELECT t_p FROM tp) AS t_p, (SELECT w_p FROM sr) AS w_p, count(*) FILTER (WHERE d > 0) AS wins, avg(d) AS mean, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t_stat,
 (SELECT sum(r) FILTER (WHERE d > 0) FROM w) AS w_plus, (SELECT sum(r) FILTER (WHERE d < 0) FROM w) AS w_minus,
 avg(d) FILTER (WHERE fold <= h) AS first_half, avg(d) FILTER (WHERE fold > h) AS second_half FROM d, m""")
def paired_tests(spark, folder):
    a, b = _fold_aucs(spark, folder)
    d = a.select("fold", F.col("auc").alias("_a")).join(b.select("fold", F.col("auc").alias("_b")), "fold")
    return st.paired_tests(stage(d.select("fold", (F.col("_a") - F.col("_b")).alias("d"))), "d", "fold").select(
        "*").withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in ("w_plus", "w_minus")})


@query("state_kurtosis", "state:l feature n:l excess_kurtosis:d variance:d mad_variance:d variance_ratio:d", """
u AS (SELECT state, unnest(['ret_1', 'vol_z', 'ofi_z']) AS feature, unnest([ret_1, vol_z, ofi_z]) AS x FROM valid),
m AS (SELECT state, feature, median(x) AS med FROM u GROUP BY 1, 2),
d AS (SELECT state, feature, median(abs(x - med)) AS mad FROM u JOIN m USING (state, feature) GROUP BY 1, 2)
;;
SELECT state, feature, count(*) AS n, kurtosis_pop(x) AS excess_kurtosis, var_pop(x) AS variance, any_value((mad * 1.4826) ** 2) AS mad_variance, var_pop(x) / any_value((mad * 1.4826) ** 2) AS variance_ratio
FROM u JOIN d USING (state, feature) GROUP BY 1, 2""")
def state_kurtosis(spark, folder):
    return st.state_kurtosis(stage(inp.valid_rows(spark, folder)), ("state",), ("ret_1", "vol_z", "ofi_z"))


# fold-level tables

FOLDROW = """
fr AS (SELECT series_id, fold, count(*) AS n, count(*) FILTER (WHERE new_run) AS n_runs, avg(confidence) AS mean_conf, 1000.0 * count(*) FILTER (WHERE new_run) / count(*) AS runs_per_1k FROM valid GROUP BY 1, 2)
;;
"""


def fold_rows(spark, folder):
    return inp.marked(spark, folder).groupBy("series_id", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("new_run").alias("n_runs"), F.avg("confidence").alias("mean_conf"),
        (F.count_if("new_run") / F.count(F.lit(1)) * 1000).alias("runs_per_1k"))


@query("year_breakdown", "o_orderpriority yr:l n:l mean_price:d urgent_rate:d", """
SELECT o_orderpriority, year(o_orderdate) AS yr, count(*) AS n, CASE WHEN count(*) >= 200 THEN avg(o_totalprice) END AS mean_price,
 CASE WHEN count(*) >= 200 THEN 100 * avg(CAST(o_totalprice > 250000 AS INT)) END AS urgent_rate FROM orders GROUP BY 1, 2""")
def year_breakdown(spark, folder):
    """Per calendar year; measures are given only from a minimum number of rows."""
    o = table(spark, folder, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"), st.share(F.col("o_totalprice") > 250_000).alias("u"))
    return o.withColumns({"mean_price": F.when(F.col("n") >= 200, F.col("m")), "urgent_rate": F.when(F.col("n") >= 200, F.col("u"))})


@query("yearly_summary", "model yr:l n_folds:l mean_of_folds:d max_of_folds:d", """
m AS (SELECT o_orderpriority AS model, date_trunc('month', o_orderdate) AS mo, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2)
;;
SELECT model, year(mo) AS yr, count(*) AS n_folds, avg(x) AS mean_of_folds, max(x) AS max_of_folds FROM m GROUP BY 1, 2""")
def yearly_summary(spark, folder):
    """Monthly fold metrics averaged by test year and model."""
    m = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.trunc("o_orderdate", "month").alias("mo")).agg(F.avg("o_totalprice").alias("x"))
    return m.groupBy("model", F.year("mo").alias("yr")).agg(F.count("x").alias("n_folds"), F.avg("x").alias("mean_of_folds"), F.max("x").alias("max_of_folds"))


@query("model_comparison", "series_id n_folds:l mean_runs:d median_runs:d std_runs:d mean_conf:d top_label folds_flagged:l", FOLDROW.replace(";;", ",") + """
lc AS (SELECT series_id, regime, count(*) AS n FROM valid GROUP BY 1, 2),
tl AS (SELECT * FROM lc QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, regime) = 1)
;;
SELECT f.series_id, count(*) AS n_folds, avg(runs_per_1k) AS mean_runs, median(runs_per_1k) AS median_runs, stddev_samp(runs_per_1k) AS std_runs, avg(mean_conf) AS mean_conf,
 any_value(t.regime) AS top_label, count(*) FILTER (WHERE f.n < 90) AS folds_flagged FROM fr f JOIN tl t USING (series_id) GROUP BY 1""")
def model_comparison(spark, folder):
    m = stage(inp.marked(spark, folder).select("series_id", "fold", "new_run", "confidence", "regime"))
    f = m.groupBy("series_id", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"),
                                           (F.count_if("new_run") / F.count(F.lit(1)) * 1000).alias("x"))
    top = m.groupBy("series_id", "regime").agg(F.count(F.lit(1)).alias("n")).groupBy("series_id").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "regime"))["regime"].alias("top_label"))
    g = f.groupBy("series_id").agg(F.count("x").alias("n_folds"), F.avg("x").alias("mean_runs"), F.median("x").alias("median_runs"),
                                   F.stddev_samp("x").alias("std_runs"), F.avg("c").alias("mean_conf"), F.count_if(F.col("n") < 90).alias("folds_flagged"))
    return g.join(top, "series_id")


@query("distribution_quartiles", "series_id n:l mean:d std:d min:d p25:d p50:d p75:d max:d", FOLDROW + """
SELECT series_id, count(*) AS n, avg(runs_per_1k) AS mean, stddev_samp(runs_per_1k) AS std, min(runs_per_1k) AS min, quantile_cont(runs_per_1k, 0.25) AS p25,
 median(runs_per_1k) AS p50, quantile_cont(runs_per_1k, 0.75) AS p75, max(runs_per_1k) AS max FROM fr GROUP BY 1""")
def distribution_quartiles(spark, folder):
    x = F.col("runs_per_1k")
    return fold_rows(spark, folder).groupBy("series_id").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.percentile(x, F.lit(0.25)).alias("p25"),
        F.median(x).alias("p50"), F.percentile(x, F.lit(0.75)).alias("p75"), F.max(x).alias("max"))


@query("coverage_comparison", "series_id n_folds:l folds_whole:l rows_masked:l rows_whole:l", """
d AS (SELECT series_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 86400) AS BIGINT) AS day, count(*) AS n, count(*) FILTER (WHERE close IS NULL) AS gaps,
 count(*) FILTER (WHERE close IS NOT NULL) AS seen FROM dense GROUP BY 1, 2)
;;
SELECT series_id, count(*) AS n_folds, count(*) FILTER (WHERE gaps = 0) AS folds_whole, sum(seen) AS rows_masked, coalesce(sum(seen) FILTER (WHERE gaps = 0), 0) AS rows_whole FROM d GROUP BY 1""")
def coverage_comparison(spark, folder):
    """Daily folds usable when any gap drops the fold, against masking only the gap rows."""
    d = rs.fill_grid(inp.bar_table(spark, folder), inp.MINUTES).withColumn(
        "day", periods("2024-01-01 00:00:00", 1))
    gap = F.col("close").isNull()
    f = d.groupBy("series_id", "day").agg(F.count_if(gap).alias("gaps"), F.count_if(~gap).alias("seen"))
    return f.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_folds"), F.count_if(F.col("gaps") == 0).alias("folds_whole"), F.sum("seen").alias("rows_masked"),
        F.coalesce(F.sum(F.when(F.col("gaps") == 0, F.col("seen"))), F.lit(0)).alias("rows_whole"))


