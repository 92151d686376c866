"""Resampling and time alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import micros, periods
from ..operators import resample as rs
from ..operators.folds import anchor_of
from ..sources.tables import table
from . import inputs as inp
from .registry import query

COARSE = """
coarse AS (
 SELECT series_id, pos // 6 AS pos, TIMESTAMP '1970-01-01' + to_hours(pos // 6 * 6) AS ts, arg_min(open, pos) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, pos) AS close, sum(volume) AS volume,
  coalesce(sum(avg_price * volume) / nullif(sum(volume), 0), arg_max(close, pos)) AS avg_price,
  sum(buy_vol) AS buy_vol, sum(sell_vol) AS sell_vol, sum(buy_vol) - sum(sell_vol) AS ofi
 FROM bars GROUP BY 1, 2, 3 HAVING count(*) = 6)
;;
"""


@query("resample_bars", "series_id ts:t open:d high:d low:d close:d volume:d avg_price:d buy_vol:d sell_vol:d ofi:d",
       COARSE + "SELECT * FROM coarse")
def resample_bars(spark, folder):
    return rs.resample_bars(inp.bars(spark, folder), 360, 60)


@query("daily_overview", "series_id ts:t open:d high:d low:d close:d volume:d state:l", """
cnt AS (SELECT series_id, pos // 24 AS day, state, count(*) AS n FROM valid GROUP BY ALL),
top AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY series_id, day ORDER BY n DESC, state) = 1),
day AS (SELECT series_id, pos // 24 AS day, arg_min(open, pos) AS open, max(high) AS high, min(low) AS low,
 arg_max(close, pos) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)
;;
SELECT d.*, TIMESTAMP '1970-01-01' + to_days(CAST(d.day AS INT)) AS ts, t.state FROM day d LEFT JOIN top t ON t.series_id = d.series_id AND t.day = d.day""")
def daily_overview(spark, folder):
    b = inp.bar_table(spark, folder)
    return rs.daily_overview(b, inp.valid_rows(spark, folder, source=b), 60)


@query("floor_broadcast", "series_id ts:t close:d coarse_close:d coarse_volume:d", COARSE + """
SELECT b.series_id, b.ts, b.close, c.close AS coarse_close, c.volume AS coarse_volume
FROM bars b LEFT JOIN coarse c ON c.series_id = b.series_id AND c.pos = b.pos // 6""")
def floor_broadcast(spark, folder):
    b = inp.bar_table(spark, folder)
    c = rs.resample_bars(b, 360, 60).withColumnsRenamed({"close": "coarse_close", "volume": "coarse_volume"})
    return rs.floor_broadcast(b, c, 6, ["coarse_close", "coarse_volume"])


@query("align_left", "series_id ts:t close:d state:l confidence:d", """
SELECT b.series_id, b.ts, b.close, v.state, v.confidence FROM bars b LEFT JOIN valid v ON v.series_id = b.series_id AND v.pos = b.pos""")
def align_left(spark, folder):
    b = inp.bar_table(spark, folder)
    return rs.align_left(b, inp.valid_rows(spark, folder, source=b), ["state", "confidence"])


@query("match_report", "matched:l left_only:l right_only:l", """
SELECT count(*) FILTER (WHERE b.pos IS NOT NULL AND v.pos IS NOT NULL) AS matched, count(*) FILTER (WHERE v.pos IS NULL) AS left_only,
 count(*) FILTER (WHERE b.pos IS NULL) AS right_only
FROM bars b FULL OUTER JOIN valid v ON v.series_id = b.series_id AND v.pos = b.pos""")
def match_report(spark, folder):
    b = inp.bar_table(spark, folder)
    return rs.match_report(b, inp.valid_rows(spark, folder, source=b))


@query("asof_backward", "event_id:l user_id:l value:d click_value:d click_id:l", """
SELECT p.event_id, p.user_id, p.value, c.value AS click_value, c.event_id AS click_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') c
 ON p.user_id = c.user_id AND c.ts <= p.ts""")
def asof_backward(spark, folder):
    e = table(spark, folder, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    right = e.filter("event_type = 'click'").select("user_id", "ts", "event_id", F.col("value").alias("click_value"))
    day = F.floor(micros("_t") / F.lit(86_400_000_000)).cast("long")
    return rs.asof_backward(left, right, ["user_id"], "ts", "ts", ["click_value", F.col("event_id").alias("click_id")], day, "event_id")


@query("asof_coarse_bars", "series_id ts:t close:d coarse_ts:t coarse_close:d", COARSE + """
SELECT b.series_id, b.ts, b.close, c.ts AS coarse_ts, c.close AS coarse_close FROM bars b ASOF JOIN
 (SELECT *, ts + INTERVAL 6 HOUR AS available_at FROM coarse) c ON b.series_id = c.series_id AND c.available_at <= b.ts""")
def asof_coarse_bars(spark, folder):
    """A coarse bar is known only once it has closed: start + interval <= fine time."""
    b = inp.bar_table(spark, folder)
    c = rs.resample_bars(b, 360, 60).withColumn("available_at", F.expr("timestampadd(HOUR, 6, ts)"))
    day = F.floor(micros("_t") / F.lit(7 * 86_400_000_000)).cast("long")
    return rs.asof_backward(b.select("series_id", "ts", "close", "pos"), c, ["series_id"], "ts", "available_at",
                            [F.col("ts").alias("coarse_ts"), F.col("close").alias("coarse_close")], day, "pos")


@query("nearest_row", "series_id ts:t close:d exact:b", """
SELECT *, ts = TIMESTAMP '2024-01-10 12:29:00' AS exact FROM bars QUALIFY row_number() OVER (PARTITION BY series_id
 ORDER BY abs(epoch(ts) - epoch(TIMESTAMP '2024-01-10 12:29:00')), ts) = 1""")
def nearest_row(spark, folder):
    return rs.nearest_row(inp.bar_table(spark, folder), "2024-01-10 12:29:00")


@query("anchor_asof", "fold:l anchor:l n:l", """
f AS (SELECT fold, count(*) AS n FROM (SELECT CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 86400) AS BIGINT) AS fold FROM events) GROUP BY 1),
a AS (SELECT fold AS anchor FROM f WHERE fold % 7 = 3)
;;
SELECT fold, coalesce(max(anchor) FILTER (WHERE anchor <= fold), min(anchor)) AS anchor, any_value(n) AS n FROM f, a GROUP BY 1""")
def anchor_asof(spark, folder):
    """Each daily fold's latest fitted anchor at or before it, else the earliest anchor."""
    day = periods("2024-01-01 00:00:00", 1)
    f = table(spark, folder, "events").groupBy(day.alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    return anchor_of(f, f.filter("fold % 7 = 3").select(F.col("fold").alias("anchor")))


@query("reindex_values", "series_id ts:t close:d", """
SELECT k.series_id, k.ts, b.close FROM (SELECT DISTINCT event_type AS series_id, date_trunc('hour', ts) + INTERVAL 30 HOUR AS ts FROM events WHERE value > 90) k
LEFT JOIN bars b ON b.series_id = k.series_id AND b.ts = k.ts""")
def reindex_values(spark, folder):
    keys = table(spark, folder, "events").filter("value > 90").select(
        F.col("event_type").alias("series_id"), F.expr("timestampadd(HOUR, 30, date_trunc('hour', ts))").alias("ts")).distinct()
    return keys.join(inp.bars(spark, folder).select("series_id", "ts", "close"), ["series_id", "ts"], "left")
