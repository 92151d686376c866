"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.blocks import over_chunks, stage
from ..operators import features as ft
from ..schemas import mismatch
from ..sources import bars as sb, stores
from ..sources.tables import table
from . import inputs as inp
from .registry import query

BAR_COLS = "series_id ts:t open:d high:d low:d close:d volume:d avg_price:d buy_vol:d sell_vol:d ofi:d"
VALID_COLS = ft.BASE_FEATURES


@query("scan_bars_csv", "series_id ts:t close:d volume:d buy_vol:d", "SELECT * FROM bars")
def scan_bars_csv(spark, folder):
    path = stores.table_path(spark, "bars-csv")
    cols = ["series_id", "ts", "open", "high", "low", "close", "volume", "avg_price", "buy_vol", "sell_vol", "ofi"]
    inp.bars(spark, folder).select(*cols).write.option("header", True).csv(path)
    return sb.read_bars_csv(spark, path, ["close", "volume", "buy_vol"])


@query("klines_normalise", BAR_COLS, """
SELECT * REPLACE (CASE WHEN volume > 0 THEN avg_price * volume / volume ELSE (open + high + low + close) / 4 END AS avg_price) FROM bars""")
def klines_normalise(spark, folder):
    return sb.klines(sb.to_klines(inp.bars(spark, folder), inp.MINUTES), "kline", inp.MINUTES)


@query("range_read", "series_id ts:t close:d volume:d", """
SELECT * FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-12 18:00:00'""")
def range_read(spark, folder):
    """From a store partitioned by day: only the days in range are read."""
    b = inp.bars(spark, folder).withColumn("day", F.to_date("ts"))
    return sb.range_read(stores.write_partitioned(b, stores.table_path(spark, "bars"), "day"), "2024-01-05 03:00:00", "2024-01-12 18:00:00", "day")


@query("recent_n", "series_id ts:t close:d volume:d", """
SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 50""")
def recent_n(spark, folder):
    return sb.recent_n(inp.bars(spark, folder), 50)


@query("contiguity_report", "series_id step:l n:l off_step:b", """
SELECT series_id, step, count(*) AS n, step <> 1 AS off_step FROM (
 SELECT series_id, pos - lag(pos) OVER (PARTITION BY series_id ORDER BY pos) AS step FROM bars) WHERE step IS NOT NULL GROUP BY ALL""")
def contiguity_report(spark, folder):
    return sb.contiguity_report(inp.bar_table(spark, folder))


@query("duplicate_ts_check", "event_type minute:t n:l", """
SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1""")
def duplicate_ts_check(spark, folder):
    e = table(spark, folder, "events").withColumn("minute", F.date_trunc("minute", "ts"))
    return sb.duplicate_times(e, ("event_type", "minute"))


@query("feature_table_read", "series_id n:l valid_rows:l gap_only:l undefined_only:l gap_and_undefined:l", """
SELECT series_id, count(*) AS n, sum(CAST(v AND d AS INT)) AS valid_rows, sum(CAST(NOT v AND d AS INT)) AS gap_only,
 sum(CAST(v AND NOT d AS INT)) AS undefined_only, sum(CAST(NOT v AND NOT d AS INT)) AS gap_and_undefined FROM (
 SELECT series_id, max(CASE WHEN coalesce(volume, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos
   ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 0 AS v, ret_4 IS NOT NULL AND vol_4 IS NOT NULL AS d FROM f2) GROUP BY 1""")
def feature_table_read(spark, folder):
    """A stored feature table with its validity flag, split into model columns and exclusions."""
    from ..operators import gaps, resample as rs

    dense = rs.fill_grid(inp.bar_table(spark, folder), inp.MINUTES)

    def work(d, w):
        d = ft.add_base(d.withColumn("volume", F.when(F.col("close").isNotNull(), F.col("volume"))), w)
        zero = F.when(F.coalesce("volume", F.lit(0.0)) == 0, 1).otherwise(0)
        return d.withColumn("valid", F.max(zero).over(w.rangeBetween(-(ft.LOOKBACK - 1), 0)) == 0)

    stored = stage(over_chunks(dense, inp.KEYS, work, before=ft.LOOKBACK))
    d = F.col("ret_4").isNotNull() & F.col("vol_4").isNotNull()
    v = F.col("valid")
    return stored.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v & d).alias("valid_rows"), F.count_if(~v & d).alias("gap_only"),
        F.count_if(v & ~d).alias("undefined_only"), F.count_if(~v & ~d).alias("gap_and_undefined"))


@query("session_column_drop", "series_id ts:t ret_1:d vol_4:d ofi:d", "SELECT * FROM f2 WHERE close IS NOT NULL")
def session_column_drop(spark, folder):
    d = inp.featured(spark, folder).withColumns(ft.session_columns())
    calendar = [c for c in d.columns if c.startswith(("hour_", "session_"))]
    return d.drop(*calendar)


@query("feature_append", "series_id ts:t " + " ".join(f"{c}:d" for c in VALID_COLS), "SELECT * FROM f2 WHERE close IS NOT NULL")
def feature_append(spark, folder):
    """A table filled up to a cut, then refreshed; must equal one full computation."""
    b = inp.bar_table(spark, folder)
    path = stores.table_path(spark, "features")
    cut = "2024-01-20 07:00:00"
    ft.build_features(b.filter(F.col("ts") <= F.lit(cut).cast("timestamp_ntz"))).write.parquet(path)
    done = spark.read.parquet(path)
    sb.new_feature_rows(b, done, ft.build_features, ft.LOOKBACK).select(*done.columns).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("fold_outputs_concat", "fold:l series_id ts:t state:l score_sign:l", """
SELECT *, CAST(sign(px_z) AS BIGINT) AS score_sign FROM valid WHERE fold >= 0""")
def fold_outputs_concat(spark, folder):
    d = inp.valid_rows(spark, folder).filter("fold >= 0").select("fold", "series_id", "ts", "state", "px_z")
    back = stores.write_partitioned(d, stores.table_path(spark, "folds"), "fold")
    return back.withColumn("score_sign", F.signum("px_z"))


@query("pending_folds", "fold_id:l n_rows:l", """
SELECT fold AS fold_id, count(*) AS n_rows FROM valid WHERE fold >= 0 GROUP BY 1 HAVING fold % 2 = 1""")
def pending_folds(spark, folder):
    d = stage(inp.valid_rows(spark, folder).filter("fold >= 0").withColumn("fold_id", F.col("fold")))
    folds = d.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_rows"))
    finished = d.filter("fold_id % 2 = 0").select("fold_id", "series_id", "ts", "state")
    done = stores.write_partitioned(finished, stores.table_path(spark, "done"), "fold_id")
    return stores.pending_folds(folds, done)


def _serving(spark, folder):
    b = inp.bar_table(spark, folder)
    return b, inp.marked(spark, folder, source=b)


@query("write_candles", "model_id series_id ts:t close:d volume:d state:l regime confidence:d state_duration:l", """
SELECT 'hourly_3' AS model_id, b.series_id, b.ts, b.close, b.volume, state, regime, confidence, duration AS state_duration
FROM bars b LEFT JOIN valid v ON v.series_id = b.series_id AND v.pos = b.pos""")
def write_candles(spark, folder):
    b, m = _serving(spark, folder)
    return stores.write_partitioned(stores.candles(b, m, "hourly_3"), stores.table_path(spark, "candles"), "model_id")


@query("write_runs", "model_id series_id state:l start_ts:t end_ts:t n_bars:l duration_minutes:d",
       "SELECT 'hourly_3' AS model_id, * FROM runs")
def write_runs(spark, folder):
    r = inp.runs(spark, folder).withColumn("model_id", F.lit("hourly_3"))
    return stores.write_partitioned(r, stores.table_path(spark, "runs"), "model_id")


@query("write_transitions", "model_id series_id ts:t from_state:l to_state:l", "SELECT 'hourly_3' AS model_id, * FROM trans")
def write_transitions(spark, folder):
    from ..operators import gaps

    t = gaps.transitions(stage(inp.runs(spark, folder))).withColumn("model_id", F.lit("hourly_3"))
    return stores.write_partitioned(t, stores.table_path(spark, "transitions"), "model_id")


@query("write_regimes", "model_id series_id ts:t state:l regime confidence:d", "SELECT 'hourly_3' AS model_id, * FROM valid")
def write_regimes(spark, folder):
    d = inp.valid_rows(spark, folder).withColumn("model_id", F.lit("hourly_3"))
    return stores.write_partitioned(d.select("model_id", "series_id", "ts", "state", "regime", "confidence"),
                                    stores.table_path(spark, "regimes"), "model_id")


@query("catalog_upsert", "model_id n_candles:l note", """
SELECT event_type AS model_id, CASE WHEN event_type IN ('click', 'view') THEN count(*) FILTER (WHERE value > 50) ELSE count(*) END AS n_candles,
 CASE WHEN event_type IN ('click', 'view') THEN 'new' ELSE 'old' END AS note FROM events GROUP BY 1""")
def catalog_upsert(spark, folder):
    e = table(spark, folder, "events").withColumnRenamed("event_type", "model_id")
    old = e.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_candles"), F.lit("old").alias("note"))
    new = e.filter(F.col("model_id").isin("click", "view")).groupBy("model_id").agg(
        F.count_if(F.col("value") > 50).alias("n_candles"), F.lit("new").alias("note"))
    return stores.catalog_upsert(old, new)


@query("schema_match", "problem n_rows:l", """
SELECT unnest(['missing close', 'unexpected n_ticks', 'unexpected price']) AS problem, (SELECT count(*) FROM bars) AS n_rows""")
def schema_match(spark, folder):
    b = inp.bars(spark, folder)
    wanted = [c for c in b.columns if c != "n_ticks"]
    problems = mismatch(b.withColumnRenamed("close", "price"), wanted)
    return b.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.array(*[F.lit(p) for p in problems])).alias("problem"), "n_rows")
