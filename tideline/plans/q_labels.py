"""Folds, labels and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.blocks import chunk_of, lookup, stage
from ..functions.columns import ahead, full, since
from ..operators import audits, folds as fo, labels as lb, metrics as mt
from ..sources.tables import table
from . import inputs as inp
from .registry import query

FOLD_SQL = """
lastd AS (SELECT max(o_orderdate) AS last_ts FROM orders),
fx AS (
 SELECT row_number() OVER (ORDER BY m) - 1 AS fold_id, TIMESTAMP '1995-01-01' AS train_start, m - INTERVAL 1 DAY AS train_end, m AS test_start,
  least(m + INTERVAL 1 MONTH, last_ts + INTERVAL 1 DAY) AS test_end
 FROM (SELECT unnest(generate_series(TIMESTAMP '1995-07-01', last_ts, INTERVAL 1 MONTH)) AS m, last_ts FROM lastd))
;;
"""


def _last(spark, folder):
    return table(spark, folder, "orders").agg(F.max("o_orderdate").alias("last_ts"))


@query("folds_expanding", "fold_id:l train_start:t train_end:t test_start:t test_end:t", FOLD_SQL + "SELECT * FROM fx")
def folds_expanding(spark, folder):
    return fo.folds_expanding(_last(spark, folder), "1995-01-01 00:00:00", "'1' DAY", 6, "'1' DAY")


@query("folds_rolling", "fold_id:l train_start:t train_end:t test_start:t test_end:t",
       FOLD_SQL + "SELECT * REPLACE (test_start - INTERVAL 6 MONTH AS train_start) FROM fx")
def folds_rolling(spark, folder):
    return fo.folds_rolling(_last(spark, folder), "1995-01-01 00:00:00", "'1' DAY", 6, "'1' DAY")


@query("fold_slice", "series_id fold:l n_train:l n_test:l enough:b", """
SELECT t.series_id, t.fold, count(*) FILTER (WHERE r.ts < TIMESTAMP '2024-01-08' + to_days(CAST(7 * t.fold AS INT)) - INTERVAL 4 HOUR) AS n_train,
 any_value(t.n) AS n_test, n_train >= 100 AND n_test >= 50 AS enough
FROM (SELECT series_id, fold, count(*) AS n FROM valid GROUP BY 1, 2) t JOIN valid r ON r.series_id = t.series_id GROUP BY 1, 2""")
def fold_slice(spark, folder):
    late = F.pmod(since(inp.WEEK0), F.lit(7 * 86_400_000_000)) >= 164 * 3_600_000_000
    return fo.slice_counts(inp.valid_rows(spark, folder), late, 100, 50)


@query("chronological_split", "series_id ts:t part", """
SELECT series_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-22' - INTERVAL 4 HOUR THEN 'train' ELSE 'test' END AS part
FROM valid WHERE ts < TIMESTAMP '2024-01-22' - INTERVAL 4 HOUR OR ts >= TIMESTAMP '2024-01-22'""")
def chronological_split(spark, folder):
    return fo.chronological_split(inp.valid_rows(spark, folder), "2024-01-22 00:00:00", "'4' HOUR")


@query("inner_split", "series_id ts:t inner_part:b", """
SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 < floor(0.7 * count(*) OVER (PARTITION BY series_id)) AS inner_part FROM valid""")
def inner_split(spark, folder):
    v = stage(inp.valid_rows(spark, folder).select("series_id", "pos", "ts"))
    return fo.inner_split(v, inp.KEYS, ("pos",), chunk_of("pos"), 0.7).withColumnRenamed("inner", "inner_part")


@query("forward_return", "series_id ts:t fwd_2:d", "SELECT * FROM valid")
def forward_return(spark, folder):
    return inp.valid_rows(spark, folder)


@query("forward_returns_multi", "series_id ts:t fwd_1:d fwd_2:d fwd_4:d fwd_6:d fwd_8:d", """
SELECT *, CASE WHEN lead(seg_no, 6) OVER w = seg_no THEN lead(ln(close), 6) OVER w - ln(close) END AS fwd_6,
 CASE WHEN lead(seg_no, 8) OVER w = seg_no THEN lead(ln(close), 8) OVER w - ln(close) END AS fwd_8
FROM valid WINDOW w AS (PARTITION BY series_id ORDER BY pos)""")
def forward_returns_multi(spark, folder):
    return inp.valid_rows(spark, folder, lambda d, w: d.withColumns(
        {f"fwd_{h}": ahead(F.log("close"), w, h) - F.log("close") for h in (6, 8)}), after=8)


@query("aligned_return", "series_id ts:t aligned:d", "SELECT *, CASE WHEN trend_sign <> 0 THEN trend_sign * fwd_2 END AS aligned FROM valid")
def aligned_return(spark, folder):
    return inp.valid_rows(spark, folder).withColumn("aligned", lb.aligned("fwd_2"))


EPS = """
el AS (SELECT * FROM valid WHERE is_trending AND fwd_2 IS NOT NULL),
ep AS (SELECT series_id, quantile_cont(abs(fwd_2), 0.1) AS epsilon, quantile_cont(abs(fwd_2), 0.75) AS q75 FROM el GROUP BY 1)"""


@query("epsilon_deadband", "series_id epsilon:d", EPS + ";; SELECT * FROM ep")
def epsilon_deadband(spark, folder):
    return lb.deadband(inp.valid_rows(spark, folder).filter("is_trending AND fwd_2 IS NOT NULL"), "fwd_2", keys=inp.KEYS)


LABEL = EPS + """,
lab AS (SELECT v.*, epsilon, coalesce(is_trending AND abs(fwd_2) > epsilon, false) AS usable,
 CASE WHEN is_trending AND abs(fwd_2) > epsilon THEN CAST(sign(fwd_2) = trend_sign AS BIGINT) END AS label FROM valid v JOIN ep USING (series_id))
;;
"""


def labelled(spark, folder, source=None):
    v = stage(inp.valid_rows(spark, folder) if source is None else source)
    eps = lb.deadband(v.filter("is_trending AND fwd_2 IS NOT NULL"), "fwd_2", keys=inp.KEYS)
    return lb.persistence(lookup(v, eps, inp.KEYS), "fwd_2", F.col("epsilon"))


@query("persistence_label", "series_id ts:t usable:b label:l", LABEL + "SELECT * FROM lab")
def persistence_label(spark, folder):
    return labelled(spark, folder)


PAST = """
pv AS (SELECT *, CASE WHEN count(ret_1) OVER w = 5 THEN stddev_samp(ret_1) OVER w END AS past_vol
 FROM valid WINDOW w AS (PARTITION BY series_id, seg_no ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def with_past_vol(spark, folder):
    return inp.valid_rows(spark, folder, lambda d, w: d.withColumn("past_vol", full("ret_1", w, 5, F.stddev_samp)), before=5)


@query("voladj_label", "series_id ts:t norm_move:d label:l", PAST + """,
kk AS (SELECT series_id, quantile_cont(abs(fwd_2 / past_vol), 0.1) AS k FROM pv WHERE is_trending AND fwd_2 IS NOT NULL AND past_vol <> 0
 AND ts < TIMESTAMP '2024-01-22' GROUP BY 1)
;;
SELECT series_id, ts, fwd_2 / past_vol AS norm_move, CASE WHEN is_trending AND abs(fwd_2 / past_vol) > k THEN CAST(sign(fwd_2) = trend_sign AS BIGINT) END AS label
FROM pv JOIN kk USING (series_id)""")
def voladj_label(spark, folder):
    """k is fitted on the training period only."""
    v = stage(with_past_vol(spark, folder)).withColumn("m", F.expr("fwd_2 / nullif(past_vol, 0)"))
    train = v.filter("is_trending AND m IS NOT NULL AND ts < TIMESTAMP_NTZ'2024-01-22 00:00:00'")
    k = lb.deadband(train, "m", keys=inp.KEYS).withColumnRenamed("epsilon", "k")
    return lb.vol_adjusted(lookup(v, k, inp.KEYS), "fwd_2", "past_vol", F.col("k"))


@query("adaptive_label", "series_id ts:t norm_move:d label:l", PAST + """;;
SELECT *, CASE WHEN trend_sign <> 0 THEN trend_sign * fwd_2 END / past_vol AS norm_move,
 CASE WHEN trend_sign <> 0 AND fwd_2 IS NOT NULL AND past_vol IS NOT NULL THEN CAST(trend_sign * fwd_2 / past_vol > 0.5 AS BIGINT) END AS label FROM pv""")
def adaptive_label(spark, folder):
    return lb.adaptive(with_past_vol(spark, folder), "fwd_2", "past_vol", 0.5)


WALK = """
el AS (SELECT * FROM valid WHERE is_trending AND fwd_2 IS NOT NULL AND fold >= 0),
w0 AS (SELECT quantile_cont(abs(fwd_2), 0.1) AS e FROM el WHERE fold = 0),
p1 AS (SELECT fwd_2 FROM el, w0 WHERE fold = 0 AND abs(fwd_2) > e),
w1 AS (SELECT quantile_cont(abs(fwd_2), 0.1) AS e FROM p1),
p2 AS (SELECT fwd_2 FROM p1 UNION ALL SELECT fwd_2 FROM el, w1 WHERE fold = 1 AND abs(fwd_2) > e),
w2 AS (SELECT quantile_cont(abs(fwd_2), 0.1) AS e FROM p2),
p3 AS (SELECT fwd_2 FROM p2 UNION ALL SELECT fwd_2 FROM el, w2 WHERE fold = 2 AND abs(fwd_2) > e),
w3 AS (SELECT quantile_cont(abs(fwd_2), 0.1) AS e FROM p3),
we AS (SELECT 0 AS fold, e, true AS bootstrap FROM w0 UNION ALL SELECT 1, e, false FROM w1 UNION ALL SELECT 2, e, false FROM w2 UNION ALL SELECT 3, e, false FROM w3)
;;
SELECT v.series_id, v.ts, v.fold, e AS epsilon, bootstrap, coalesce(is_trending AND abs(fwd_2) > e, false) AS usable,
 CASE WHEN is_trending AND abs(fwd_2) > e THEN CAST(sign(fwd_2) = trend_sign AS BIGINT) END AS label FROM valid v JOIN we USING (fold)"""


@query("frozen_epsilon_walk", "series_id ts:t fold:l epsilon:d bootstrap:b usable:b label:l", WALK)
def frozen_epsilon_walk(spark, folder):
    v = stage(inp.valid_rows(spark, folder))
    folds = [r[0] for r in v.filter("fold >= 0").select("fold").distinct().orderBy("fold").collect()]
    return lb.frozen_epsilon(v, "fwd_2", folds, min_pool=50)[0]


@query("pool_growth", "fold:l own:l pool:l trainable:b", LABEL + """
SELECT fold, own, coalesce(sum(own) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pool,
 coalesce(sum(own) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 300 AS trainable
FROM (SELECT fold, count(*) FILTER (WHERE usable) AS own FROM lab GROUP BY 1)""")
def pool_growth(spark, folder):
    return fo.pool_growth(labelled(spark, folder), F.col("usable"), 300)


@query("target_variants", "series_id target n:l positive_pct:d negative_pct:d excluded_pct:d", EPS + "," + PAST + """,
a AS (SELECT v.*, CASE WHEN trend_sign <> 0 THEN trend_sign * fwd_2 END AS a, epsilon, q75 FROM pv v JOIN ep USING (series_id)),
t AS (
 SELECT series_id, 'direction' AS target, a > 0 AS up, a <= 0 AS down FROM a WHERE a IS NOT NULL
 UNION ALL SELECT series_id, 'epsilon', a > epsilon, a < -epsilon FROM a WHERE a IS NOT NULL
 UNION ALL SELECT series_id, 'large_move', a > q75, a < -q75 FROM a WHERE a IS NOT NULL
 UNION ALL SELECT series_id, 'failure', false, a < -epsilon FROM a WHERE a IS NOT NULL
 UNION ALL SELECT series_id, 'vol_' || k, coalesce(a / past_vol > k, false), coalesce(a / past_vol < -k, false) FROM a, (SELECT unnest([0.5, 1.0, 1.5, 2.0]) AS k) WHERE a IS NOT NULL)
;;
SELECT series_id, target, count(*) AS n, 100 * avg(CAST(up AS INT)) AS positive_pct, 100 * avg(CAST(down AS INT)) AS negative_pct,
 100 * avg(CAST(NOT up AND NOT down AS INT)) AS excluded_pct FROM t GROUP BY 1, 2""")
def target_variants(spark, folder):
    from ..functions.ordered import percentiles

    v = stage(with_past_vol(spark, folder))
    el = v.filter("is_trending AND fwd_2 IS NOT NULL").withColumn("m", F.abs("fwd_2"))
    q = percentiles(el, inp.KEYS, "m", {"epsilon": 0.1, "q75": 0.75}).drop("n_all")
    return lb.target_variants(v, "fwd_2", "past_vol", q)


@query("label_distribution", "series_id fold:l n:l n_labelled:l n_positive:l positive_pct:d coverage_pct:d", LABEL + """
SELECT series_id, fold, count(*) AS n, count(label) AS n_labelled, count(*) FILTER (WHERE label = 1) AS n_positive, 100 * avg(label) AS positive_pct,
 100.0 * count(label) / count(*) AS coverage_pct FROM lab GROUP BY 1, 2""")
def label_distribution(spark, folder):
    return lb.label_distribution(labelled(spark, folder), ("series_id", "fold"))


@query("common_eligible", "series_id fold:l n:l", """
SELECT series_id, fold, count(*) AS n FROM valid WHERE is_trending AND abs(vol_z) > 0.5 AND fwd_2 IS NOT NULL GROUP BY 1, 2""")
def common_eligible(spark, folder):
    """Two scores that each leave some rows unanswered are compared only where both, and the outcome, exist."""
    v = inp.valid_rows(spark, folder).withColumns({
        "score_trend": F.when(F.col("is_trending"), F.col("score")), "score_volume": F.when(F.abs("vol_z") > 0.5, F.col("vol_z"))})
    return lb.common_rows(v, ("score_trend", "score_volume", "fwd_2")).groupBy("series_id", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("leakage_checks", "check_name n_checked:l n_violations:l", PAST + """,
fs AS (SELECT fold, min(ts) AS first_ts, max(ts) AS last_ts FROM valid GROUP BY 1)
;;
SELECT 'train_before_test' AS check_name, count(*) AS n_checked, count(*) FILTER (WHERE TIMESTAMP '2024-01-08' + to_days(CAST(7 * fold AS INT)) - INTERVAL 4 HOUR >= first_ts) AS n_violations FROM fs WHERE fold >= 0
UNION ALL SELECT 'pool_before_fold', count(*), count(*) FILTER (WHERE pm >= first_ts) FROM (SELECT fold, first_ts, max(last_ts) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM fs) WHERE pm IS NOT NULL
UNION ALL SELECT 'label_has_forward', count(*), 0 FROM valid WHERE is_trending AND abs(fwd_2) > 0.1
UNION ALL SELECT 'volatility_recomputed', count(*), 0 FROM pv WHERE past_vol IS NOT NULL""")
def leakage_checks(spark, folder):
    v = stage(with_past_vol(spark, folder))
    return audits.fold_order(v, "'4' HOUR").unionByName(audits.label_needs_forward(
        v.withColumn("usable", F.coalesce(F.expr("is_trending AND abs(fwd_2) > 0.1"), F.lit(False))), "fwd_2")).unionByName(
        audits.volatility_recomputed(v, "ret_1", "past_vol", 5))


@query("gate_calibration", "series_id cutoff:d f1:d", LABEL + """
SELECT series_id, cutoff, f1 FROM (
 SELECT series_id, cutoff, coalesce(2.0 * count(*) FILTER (WHERE score >= cutoff AND label = 1)
  / nullif(count(*) FILTER (WHERE score >= cutoff) + count(*) FILTER (WHERE label = 1), 0), 0) AS f1
 FROM lab, (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5]) AS cutoff) WHERE label IS NOT NULL AND ts < TIMESTAMP '2024-01-22' GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(f1, 9) DESC, cutoff DESC) = 1""")
def gate_calibration(spark, folder):
    """Cut-off chosen on the earlier part; ties go to the largest."""
    inner = labelled(spark, folder).filter("ts < TIMESTAMP_NTZ'2024-01-22 00:00:00'")
    return mt.best_cutoff(mt.at_cutoffs(inner, inp.KEYS, (0.3, 0.35, 0.4, 0.45, 0.5)), inp.KEYS)
