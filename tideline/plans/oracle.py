"""Common table expressions of the SQL twins. They work on the dense hour grid with plain ROWS
frames over whole series, an independent formulation of what the Spark side does on gapped,
chunked rows."""

HOUR = 60
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in (
    "ret_1", "ret_2", "ret_4", "vol_4", "vol_6", "vol_change", "vol_z", "ofi", "ofi_z", "skew_6", "asym_6", "px_z"))


def bars_sql(minutes: int) -> str:
    us = minutes * 60_000_000
    return f"""
 SELECT series_id, pos, TIMESTAMP '1970-01-01' + to_minutes(pos * {minutes}) AS ts, open, high, low, close, volume,
   volume / n_ticks AS avg_price, buy_vol, sell_vol, buy_vol - sell_vol AS ofi, n_ticks
 FROM (SELECT event_type AS series_id, epoch_us(ts) // {us} AS pos, arg_min(value, (ts, event_id)) AS open,
   max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(value) AS volume,
   sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) AS buy_vol, sum(CASE WHEN user_id % 2 = 0 THEN 0 ELSE value END) AS sell_vol, count(*) AS n_ticks
   FROM events GROUP BY 1, 2)"""


BASE = f"""
bars AS ({bars_sql(60)}),
dense AS (
 SELECT g.series_id, g.pos, TIMESTAMP '1970-01-01' + to_minutes(g.pos * 60) AS ts, open, high, low, close, volume,
   avg_price, buy_vol, sell_vol, ofi, n_ticks
 FROM (SELECT series_id, unnest(generate_series(min(pos), max(pos))) AS pos FROM bars GROUP BY 1) g
 LEFT JOIN bars b ON b.series_id = g.series_id AND b.pos = g.pos),
f1 AS (
 SELECT *, ln(close) - lag(ln(close), 1) OVER w AS ret_1, CASE WHEN count(close) OVER (PARTITION BY series_id ORDER BY pos ROWS 2 PRECEDING) = 3
     THEN ln(close) - lag(ln(close), 2) OVER w END AS ret_2,
   CASE WHEN count(close) OVER (PARTITION BY series_id ORDER BY pos ROWS 4 PRECEDING) = 5
     THEN ln(close) - lag(ln(close), 4) OVER w END AS ret_4,
   (volume - lag(volume) OVER w) / nullif(lag(volume) OVER w, 0) AS vol_change
 FROM dense WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
f2 AS (
 SELECT *,
   CASE WHEN count(ret_1) OVER w4 = 4 THEN stddev_samp(ret_1) OVER w4 END AS vol_4,
   CASE WHEN count(ret_1) OVER w6 = 6 THEN stddev_samp(ret_1) OVER w6 END AS vol_6,
   CASE WHEN count(volume) OVER w6 = 6 THEN (volume - avg(volume) OVER w6) / nullif(stddev_samp(volume) OVER w6, 0) END AS vol_z,
   CASE WHEN count(ofi) OVER w6 = 6 THEN (ofi - avg(ofi) OVER w6) / nullif(stddev_samp(ofi) OVER w6, 0) END AS ofi_z,
   CASE WHEN count(avg_price) OVER w6 = 6 THEN (avg_price - avg(avg_price) OVER w6) / nullif(stddev_samp(avg_price) OVER w6, 0) END AS px_z,
   CASE WHEN count(ret_1) OVER w6 = 6 THEN skewness(ret_1) OVER w6 END AS skew_6,
   CASE WHEN count(ret_1) OVER w6 = 6 THEN avg(greatest(ret_1, 0)) OVER w6
     / nullif(avg(greatest(ret_1, 0)) OVER w6 + avg(greatest(-ret_1, 0)) OVER w6, 0) END AS asym_6
 FROM f1 WINDOW w4 AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
   w6 AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
v0 AS (
 SELECT *, CASE WHEN px_z > 0.5 THEN 2 WHEN px_z < -0.5 THEN 0 ELSE 1 END AS state,
   CASE WHEN px_z > 0.5 THEN 1 WHEN px_z < -0.5 THEN -1 ELSE 0 END AS trend_sign, abs(px_z) > 0.5 AS is_trending,
   abs(px_z) / (1 + abs(px_z)) AS confidence, 1 / (1 + exp(-px_z)) AS score,
   CASE WHEN px_z > 0.5 THEN 'Uptrend' WHEN px_z < -0.5 THEN 'Downtrend' ELSE 'Ranging' END || ' / '
     || CASE WHEN vol_z > 0.5 THEN 'High-Vol' WHEN vol_z < -0.5 THEN 'Low-Vol' ELSE 'Mid-Vol' END AS regime
 FROM f2 WHERE {COMPLETE}),
v1 AS (
 SELECT *, coalesce(pos - lag(pos) OVER w <> 1, true) AS new_segment FROM v0 WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
v2 AS (
 SELECT *, CAST(sum(CAST(new_segment AS INT)) OVER w AS BIGINT) AS seg_no,
   new_segment OR state <> lag(state) OVER w AS new_run, lag(state) OVER w AS prev_state
 FROM v1 WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
v3 AS (
 SELECT *, max(CASE WHEN new_segment THEN pos END) OVER w AS seg_start, max(CASE WHEN new_run THEN pos END) OVER w AS run_start
 FROM v2 WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
valid AS (
 SELECT *, pos - run_start + 1 AS duration, run_start = seg_start AS left_censored,
   CASE WHEN lead(seg_no, 1) OVER w = seg_no THEN lead(ln(close), 1) OVER w - ln(close) END AS fwd_1,
   CASE WHEN lead(seg_no, 2) OVER w = seg_no THEN lead(ln(close), 2) OVER w - ln(close) END AS fwd_2,
   CASE WHEN lead(seg_no, 4) OVER w = seg_no THEN lead(ln(close), 4) OVER w - ln(close) END AS fwd_4,
   CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-08')) / 604800) AS BIGINT) AS fold
 FROM v3 WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
runs AS (
 SELECT series_id, seg_no, seg_start, run_start, min(state) AS state, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_bars,
   count(*) * 60.0 AS duration_minutes
 FROM valid GROUP BY ALL),
trans AS (
 SELECT * FROM (SELECT series_id, start_ts AS ts, lag(state) OVER (PARTITION BY series_id ORDER BY run_start) AS from_state,
   state AS to_state, run_start FROM runs) WHERE from_state <> to_state),
outl AS (
 SELECT *, max_z > 2.2 AS is_outlier FROM (
 SELECT *, greatest(abs(z_ret), abs(z_vol), abs(z_ofi)) AS max_z FROM (
 SELECT *, (ret_1 - avg(ret_1) OVER s) / stddev_pop(ret_1) OVER s AS z_ret,
   (volume - avg(volume) OVER s) / stddev_pop(volume) OVER s AS z_vol, (ofi - avg(ofi) OVER s) / stddev_pop(ofi) OVER s AS z_ofi
 FROM valid WINDOW s AS (PARTITION BY series_id))))"""
