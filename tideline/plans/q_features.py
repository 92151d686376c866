"""Bar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.blocks import over_chunks, running_since, stage
from ..functions.columns import full, micros, safe_div
from ..operators import features as ft, gaps, resample as rs, scaling as sc
from . import inputs as inp
from .q_resample import COARSE
from .registry import query

SEEN = "SELECT * FROM f2 WHERE close IS NOT NULL"
TREND_SQL = """
g0 AS (
 SELECT *, ln(close) AS log_price, ln(close) - lag(ln(close), 3) OVER w AS net_3, ln(close) - lag(ln(close), 6) OVER w AS net_6,
  CASE WHEN count(close) OVER w3 = 3 THEN max(ln(close)) OVER w3 END AS roll_high,
  CASE WHEN count(close) OVER w3 = 3 THEN min(ln(close)) OVER w3 END AS roll_low,
  CASE WHEN count(ret_1) OVER w3 = 3 THEN avg(ret_1) OVER w3 END AS mean_short,
  CASE WHEN count(ret_1) OVER w3 = 3 THEN abs(sum(ret_1) OVER w3) / nullif(sum(abs(ret_1)) OVER w3, 0) END AS eff_short,
  CASE WHEN count(ret_1) OVER w6 = 6 THEN abs(sum(ret_1) OVER w6) / nullif(sum(abs(ret_1)) OVER w6, 0) END AS eff_long,
  sign(ret_1) + sign(ret_2) + sign(ret_4) AS mtf_alignment, CAST(sign(ret_1) <> sign(ret_4) AS BIGINT) AS mtf_conflict
 FROM f1 WINDOW w AS (PARTITION BY series_id ORDER BY pos),
  w3 AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  w6 AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
g1 AS (
 SELECT *, sign(roll_high - lag(roll_high, 3) OVER w) + sign(roll_low - lag(roll_low, 3) OVER w) AS structure_score,
  log_price - roll_high AS dist_high, log_price - roll_low AS dist_low, mean_short - lag(mean_short, 3) OVER w AS accel,
  eff_short - lag(eff_short, 3) OVER w AS eff_deterioration, CASE WHEN count(close) OVER (PARTITION BY series_id ORDER BY pos ROWS 3 PRECEDING) = 4
   THEN mtf_alignment - lag(mtf_alignment, 3) OVER w END AS alignment_deterioration
 FROM g0 WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
g AS (SELECT * FROM g1 WHERE close IS NOT NULL)
;;
"""
EMA_SQL = """
dz AS (SELECT series_id, pos, close, last_value(close IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos) AS x,
  row_number() OVER (PARTITION BY series_id ORDER BY pos) AS rn FROM dense),
er AS (
 SELECT series_id, pos, rn, x AS e3, x AS e8 FROM dz WHERE rn = 1
 UNION ALL
 SELECT d.series_id, d.pos, d.rn, e3 + 2.0 / 4 * (d.x - e3), e8 + 2.0 / 9 * (d.x - e8)
 FROM er JOIN dz d ON d.series_id = er.series_id AND d.rn = er.rn + 1),
em AS (SELECT b.*, CASE WHEN e.rn >= 3 THEN e3 END AS ema_3, CASE WHEN e.rn >= 8 THEN e8 END AS ema_8
 FROM dense b JOIN er e ON e.series_id = b.series_id AND e.pos = b.pos),
"""


def base(name, columns, sql=SEEN):
    @query(name, f"series_id ts:t {columns}", sql)
    def run(spark, folder):
        return inp.featured(spark, folder)

    return run


base("log_return_n", "ret_1:d ret_2:d ret_4:d")
base("rolling_vol", "vol_4:d vol_6:d")
base("rolling_zscore", "vol_z:d ofi_z:d")
base("rolling_skew", "skew_6:d")
base("updown_asymmetry", "asym_6:d")


@query("ema", "series_id ts:t ema_3:d ema_8:d", EMA_SQL.rstrip().rstrip(",") + ";; SELECT * FROM em WHERE close IS NOT NULL")
def ema(spark, folder):
    b = inp.bar_table(spark, folder)
    return b.select("series_id", "pos", "ts").join(ft.ema(b, (3, 8)), ["series_id", "pos"])


EMA_FEATURES = EMA_SQL + """
ef AS (SELECT *, ln(close / ema_3) AS ema_dist_fast, ln(close / ema_8) AS ema_dist_slow,
 CASE WHEN lag(close, 2) OVER w IS NOT NULL AND lag(close, 1) OVER w IS NOT NULL THEN ln(ema_3 / lag(ema_3, 2) OVER w) END AS ema_slope_fast
 FROM em WINDOW w AS (PARTITION BY series_id ORDER BY pos))
;;
SELECT * FROM ef WHERE close IS NOT NULL"""


@query("ema_distance", "series_id ts:t ema_dist_fast:d ema_dist_slow:d", EMA_FEATURES)
def ema_distance(spark, folder):
    return ft.ema_features(inp.bar_table(spark, folder), 3, 8, 2)


@query("ema_slope", "series_id ts:t ema_slope_fast:d", EMA_FEATURES)
def ema_slope(spark, folder):
    return ft.ema_features(inp.bar_table(spark, folder), 3, 8, 2)


@query("feature_sets", "feature_set series_id n_valid:l mean_ret:d", EMA_SQL + """
j AS (SELECT v.series_id, v.pos, v.ret_1, e.ema_3, e.ema_8 FROM v0 v JOIN em e ON e.series_id = v.series_id AND e.pos = v.pos),
k AS (SELECT *, ema_3 IS NOT NULL AS h3, ema_8 IS NOT NULL AS h8 FROM j)
;;
SELECT 'base' AS feature_set, series_id, count(*) AS n_valid, avg(ret_1) AS mean_ret FROM k GROUP BY 2
UNION ALL SELECT 'base+ema_3', series_id, count(*), avg(ret_1) FROM k WHERE h3 GROUP BY 2
UNION ALL SELECT 'base+ema_8', series_id, count(*), avg(ret_1) FROM k WHERE h8 GROUP BY 2
UNION ALL SELECT 'base+both', series_id, count(*), avg(ret_1) FROM k WHERE h3 AND h8 GROUP BY 2""")
def feature_sets(spark, folder):
    """Rows valid under each of four feature sets, counted in one pass."""
    b = inp.bar_table(spark, folder)
    v = inp.valid_rows(spark, folder, source=b).select("series_id", "pos", "ret_1")
    d = v.join(ft.ema(b, (3, 8)), ["series_id", "pos"])
    h3, h8 = F.col("ema_3").isNotNull(), F.col("ema_8").isNotNull()
    sets = F.array_compact(F.array(F.lit("base"), F.when(h3, F.lit("base+ema_3")), F.when(h8, F.lit("base+ema_8")),
                                   F.when(h3 & h8, F.lit("base+both"))))
    return d.withColumn("feature_set", F.explode(sets)).groupBy("feature_set", "series_id").agg(
        F.count(F.lit(1)).alias("n_valid"), F.avg("ret_1").alias("mean_ret"))


@query("safe_div", "series_id ts:t sell_per_buy:d", "SELECT *, sell_vol / nullif(buy_vol, 0) AS sell_per_buy FROM bars")
def safe_div_query(spark, folder):
    return inp.bars(spark, folder).withColumn("sell_per_buy", safe_div("sell_vol", "buy_vol"))


QUANT = """
q AS (SELECT series_id, quantile_cont(volume, 0.01) AS vlo, quantile_cont(volume, 0.99) AS vhi, quantile_cont(ofi, 0.01) AS olo,
 quantile_cont(ofi, 0.99) AS ohi FROM bars GROUP BY 1)
;;
"""


@query("winsor_fit", "series_id vlo:d vhi:d olo:d ohi:d", QUANT + "SELECT * FROM q")
def winsor_fit(spark, folder):
    b = sc.winsor_fit(inp.bar_table(spark, folder), ("volume", "ofi"))
    return b.select("series_id", F.col("volume_lo").alias("vlo"), F.col("volume_hi").alias("vhi"),
                    F.col("ofi_lo").alias("olo"), F.col("ofi_hi").alias("ohi"))


@query("winsor_apply", "series_id ts:t volume:d ofi:d", QUANT + """
SELECT series_id, ts, greatest(least(volume, vhi), vlo) AS volume, greatest(least(ofi, ohi), olo) AS ofi FROM bars JOIN q USING (series_id)""")
def winsor_apply(spark, folder):
    b = inp.bar_table(spark, folder)
    return sc.winsor_apply(b, sc.winsor_fit(b, ("volume", "ofi")), ("volume", "ofi"))


@query("winsor_train_only", "series_id ts:t volume:d", """
q AS (SELECT series_id, quantile_cont(volume, 0.01) AS lo, quantile_cont(volume, 0.99) AS hi FROM bars WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)
;;
SELECT series_id, ts, greatest(least(volume, hi), lo) AS volume FROM bars JOIN q USING (series_id)""")
def winsor_train_only(spark, folder):
    """Bounds from the training slice only, so that later rows cannot move earlier features."""
    b = inp.bar_table(spark, folder)
    train = b.filter("ts < TIMESTAMP_NTZ'2024-01-15 00:00:00'")
    return sc.winsor_apply(b, sc.winsor_fit(train, ("volume",)), ("volume",))


@query("volume_change", "series_id ts:t vol_change:d", """
q AS (SELECT series_id, quantile_cont(vol_change, 0.01) AS lo, quantile_cont(vol_change, 0.99) AS hi FROM f2 GROUP BY 1)
;;
SELECT series_id, ts, CASE WHEN vol_change IS NOT NULL THEN greatest(least(vol_change, hi), lo) END AS vol_change
FROM f2 JOIN q USING (series_id) WHERE close IS NOT NULL""")
def volume_change(spark, folder):
    d = stage(inp.featured(spark, folder).select("series_id", "ts", "vol_change"))
    return sc.winsor_apply(d, sc.winsor_fit(d, ("vol_change",)), ("vol_change",))


@query("order_flow", "series_id ts:t ofi:d", QUANT + """
SELECT series_id, ts, greatest(least(ofi, ohi), olo) AS ofi FROM bars JOIN q USING (series_id)""")
def order_flow(spark, folder):
    d = inp.bar_table(spark, folder).withColumn("ofi", F.col("buy_vol") - F.col("sell_vol"))
    return sc.winsor_apply(d, sc.winsor_fit(d, ("ofi",)), ("ofi",))


@query("buy_sell_ratio", "series_id ts:t ratio:d", "SELECT *, buy_vol / nullif(buy_vol + sell_vol, 0) AS ratio FROM bars")
def buy_sell_ratio(spark, folder):
    return inp.bars(spark, folder).withColumn("ratio", safe_div("buy_vol", F.col("buy_vol") + F.col("sell_vol")))


@query("rolling_vwap_distance", "series_id ts:t vwap_dist:d", """
SELECT series_id, ts, CASE WHEN count(close) OVER w = 6 THEN (close - sum(avg_price * volume) OVER w / nullif(sum(volume) OVER w, 0))
 / nullif(close, 0) END AS vwap_dist FROM dense WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
QUALIFY close IS NOT NULL""")
def rolling_vwap_distance(spark, folder):
    return rs.lagged(inp.bars(spark, folder), {"vwap_dist": lambda w: ft.vwap_distance(w, 6)}, before=6)


@query("session_features", "series_id ts:t hour_sin:d hour_cos:d session_asia:l session_europe:l session_us:l "
       "session_asia_europe_overlap:l session_europe_us_overlap:l", """
SELECT *, sin(2 * pi() * h / 24) AS hour_sin, cos(2 * pi() * h / 24) AS hour_cos, CAST(h < 9 AS INT) AS session_asia,
 CAST(h >= 7 AND h < 16 AS INT) AS session_europe, CAST(h >= 12 AND h < 21 AS INT) AS session_us,
 CAST(h >= 7 AND h < 9 AS INT) AS session_asia_europe_overlap, CAST(h >= 12 AND h < 16 AS INT) AS session_europe_us_overlap
FROM (SELECT *, hour(ts) + minute(ts) / 60.0 AS h FROM bars)""")
def session_features(spark, folder):
    return inp.bars(spark, folder).withColumns(ft.session_columns())


@query("feature_row_complete", "series_id ts:t complete:b", """
SELECT *, ret_1 IS NOT NULL AND ret_2 IS NOT NULL AND ret_4 IS NOT NULL AND vol_4 IS NOT NULL AND vol_6 IS NOT NULL AND vol_change IS NOT NULL
 AND vol_z IS NOT NULL AND ofi_z IS NOT NULL AND skew_6 IS NOT NULL AND asym_6 IS NOT NULL AS complete FROM f2 WHERE close IS NOT NULL""")
def feature_row_complete(spark, folder):
    return inp.featured(spark, folder).withColumn("complete", ft.complete())


@query("seg_rolling", "series_id ts:t roll_max:d roll_min:d path:d", """
SELECT series_id, ts, CASE WHEN count(close) OVER w = 4 THEN max(close) OVER w END AS roll_max,
 CASE WHEN count(close) OVER w = 4 THEN min(close) OVER w END AS roll_min,
 CASE WHEN count(ret_1) OVER w = 4 THEN sum(abs(ret_1)) OVER w END AS path
FROM valid WINDOW w AS (PARTITION BY series_id, seg_no ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def seg_rolling(spark, folder):
    return inp.valid_rows(spark, folder, lambda d, w: d.withColumns({
        "roll_max": full("close", w, 4, F.max), "roll_min": full("close", w, 4, F.min),
        "path": full(F.abs("ret_1"), w, 4, F.sum)}), before=4)


@query("causal_volatility", "series_id ts:t past_vol:d", """
SELECT series_id, ts, CASE WHEN count(ret_1) OVER w = 5 THEN stddev_samp(ret_1) OVER w END AS past_vol
FROM valid WINDOW w AS (PARTITION BY series_id, seg_no ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def causal_volatility(spark, folder):
    return inp.valid_rows(spark, folder, lambda d, w: d.withColumn("past_vol", full("ret_1", w, 5, F.stddev_samp)), before=5)


@query("relative_log_price", "series_id ts:t rel_price:d", """
SELECT series_id, ts, sum(CASE WHEN new_segment THEN 0 ELSE ret_1 END) OVER (PARTITION BY series_id, seg_no ORDER BY pos) AS rel_price FROM valid""")
def relative_log_price(spark, folder):
    """Running sum of returns inside a segment, its first return set to 0."""
    d = stage(inp.valid_rows(spark, folder, lambda d, w: d.withColumn("new_segment", gaps.new_segment(w)), before=1).select(
        "series_id", "pos", "ts", "ret_1", "new_segment"))
    return running_since(d, inp.KEYS, "new_segment", rel_price=F.when(F.col("new_segment"), 0.0).otherwise(F.col("ret_1")))


def trend(name, columns):
    @query(name, f"series_id ts:t {columns}", TREND_SQL + "SELECT * FROM g")
    def run(spark, folder):
        return over_chunks(inp.bars(spark, folder), inp.KEYS, lambda d, w: ft.trend_features(ft.add_base(d, w), w),
                           before=ft.TREND_REACH)


trend("structure_score", "structure_score:l dist_high:d dist_low:d")
trend("efficiency_ratio", "eff_short:d eff_long:d")
trend("acceleration", "accel:d")
trend("mtf_alignment", "mtf_alignment:l mtf_conflict:l")
trend("deterioration", "eff_deterioration:d alignment_deterioration:d")


@query("bars_since_flip", "series_id ts:t age:l log_age:d", TREND_SQL.replace(";;", "") + """,
h0 AS (SELECT *, coalesce(sign(structure_score), 0) AS sg FROM g),
h1 AS (SELECT *, coalesce(pos - lag(pos) OVER w <> 1 OR sg <> lag(sg) OVER w, true) AS nf FROM h0 WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
h2 AS (SELECT *, sum(CAST(nf AS INT)) OVER (PARTITION BY series_id ORDER BY pos) AS island FROM h1)
;;
SELECT series_id, ts, row_number() OVER i AS age, ln(1 + row_number() OVER i) AS log_age FROM h2 WINDOW i AS (PARTITION BY series_id, island ORDER BY pos)""")
def bars_since_flip(spark, folder):
    d = over_chunks(inp.bars(spark, folder), inp.KEYS, lambda d, w: ft.trend_features(ft.add_base(d, w), w), before=ft.TREND_REACH)
    d = stage(d.select("series_id", "pos", "ts", F.coalesce(F.signum("structure_score"), F.lit(0.0)).alias("sg")))
    m = gaps.mark_runs(d, "sg").withColumn("age", gaps.running_duration(None))
    return m.withColumn("log_age", F.log1p("age"))


@query("mtf_score", "series_id ts:t mtf_raw:d mtf_weighted:d mtf_bin:l", COARSE.replace(";;", ",") + """
cs AS (SELECT series_id, ts + INTERVAL 6 HOUR AS available_at, ln(close / open) AS c_score, abs(ofi) / nullif(volume, 0) AS c_conf FROM coarse),
j AS (SELECT v.series_id, v.ts, v.px_z, v.confidence, c.c_score, c.c_conf FROM valid v ASOF JOIN cs c ON c.series_id = v.series_id AND c.available_at <= v.ts)
;;
SELECT series_id, ts, 0.6 * px_z + 0.4 * c_score AS mtf_raw, 0.6 * px_z * confidence + 0.4 * c_score * c_conf AS mtf_weighted,
 CASE WHEN 0.6 * px_z + 0.4 * c_score > 0.3 THEN 1 WHEN 0.6 * px_z + 0.4 * c_score < -0.3 THEN -1 ELSE 0 END AS mtf_bin FROM j""")
def mtf_score(spark, folder):
    b = inp.bar_table(spark, folder)
    fine = inp.valid_rows(spark, folder, source=b).select("series_id", "ts", "pos", "px_z", "confidence")
    c = rs.resample_bars(b, 360, 60).select(
        "series_id", "pos", F.expr("timestampadd(HOUR, 6, ts)").alias("available_at"),
        F.log(safe_div("close", "open")).alias("c_score"), safe_div(F.abs("ofi"), "volume").alias("c_conf"))
    week = F.floor(micros("_t") / F.lit(7 * 86_400_000_000)).cast("long")
    j = rs.asof_backward(fine, c, ["series_id"], "ts", "available_at", ["c_score", "c_conf"], week, "pos")
    return ft.blend_scores(j, "px_z", "confidence", "c_score", "c_conf")


@query("expanded_matrix", "series_id n:l null_structure:l null_efficiency:l mean_ret:d", TREND_SQL.replace(";;", "") + """
;;
SELECT g.series_id, count(*) AS n, count(*) FILTER (WHERE structure_score IS NULL) AS null_structure,
 count(*) FILTER (WHERE eff_long IS NULL) AS null_efficiency, avg(v.ret_1) AS mean_ret
FROM valid v JOIN g ON g.series_id = v.series_id AND g.pos = v.pos GROUP BY 1""")
def expanded_matrix(spark, folder):
    """Structure columns joined on the base table; the join may not change the row count."""
    b = inp.bar_table(spark, folder)
    v = inp.valid_rows(spark, folder, source=b).select("series_id", "pos", "ret_1")
    t = over_chunks(b, inp.KEYS, lambda d, w: ft.trend_features(ft.add_base(d, w), w),
                    before=ft.TREND_REACH).select("series_id", "pos", "structure_score", "eff_long")
    return v.join(t, ["series_id", "pos"], "left").groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("structure_score").isNull()).alias("null_structure"),
        F.count_if(F.col("eff_long").isNull()).alias("null_efficiency"), F.avg("ret_1").alias("mean_ret"))
