"""Price structure. The SQL side follows pivots one by one in a recursive scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.blocks import stage
from ..operators import structure as st
from . import inputs as inp
from .registry import query

K = 2


def swings_sql(k: int, name: str = "sw") -> str:
    l, r = f"ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING", f"ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING"
    p = "PARTITION BY series_id ORDER BY pos"
    return f"""
{name}0 AS (SELECT *, count(high) OVER ({p} {l}) = {k} AND count(high) OVER ({p} {r}) = {k} AS whole,
  greatest(max(high) OVER ({p} {l}), max(high) OVER ({p} {r})) AS nh, least(min(low) OVER ({p} {l}), min(low) OVER ({p} {r})) AS nl FROM dense),
{name} AS (SELECT *, whole AND high > nh AS swing_high, whole AND low < nl AS swing_low FROM {name}0 WHERE close IS NOT NULL)"""


EVENTS = swings_sql(K) + f""",
ev0 AS (
 SELECT series_id, pos AS pivot_pos, pos + {K} AS conf_pos, 'H' AS kind, high AS price FROM sw WHERE swing_high
 UNION ALL SELECT series_id, pos, pos + {K}, 'L', low FROM sw WHERE swing_low),
ev1 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pivot_pos, kind) AS n,
 lag(price) OVER (PARTITION BY series_id, kind ORDER BY pivot_pos) AS prev FROM ev0)"""
PIVOTS = EVENTS + """,
ev2 AS (SELECT *, CASE WHEN price > prev THEN 1 WHEN price < prev THEN -1 ELSE 0 END AS lean FROM ev1),
ev3 AS (
 SELECT *, 0 AS dh, 0 AS dl, CAST([] AS INT[]) AS hist, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b FROM ev2 WHERE false
 UNION ALL
 SELECT *, CASE WHEN kind = 'H' THEN lean ELSE 0 END, CASE WHEN kind = 'L' THEN lean ELSE 0 END,
  CASE WHEN lean <> 0 THEN [lean] ELSE CAST([] AS INT[]) END, NULL, NULL FROM ev2 WHERE n = 1),
ev4 AS (
 SELECT * FROM ev3
 UNION ALL
 SELECT e.*, CASE WHEN e.kind = 'H' AND e.lean <> 0 THEN e.lean ELSE p.dh END, CASE WHEN e.kind = 'L' AND e.lean <> 0 THEN e.lean ELSE p.dl END,
  CASE WHEN e.lean <> 0 THEN list_slice(list_append(p.hist, e.lean), -8, -1) ELSE p.hist END, p.b, p.price
 FROM ev4 p JOIN ev2 e ON e.series_id = p.series_id AND e.n = p.n + 1),
ev5 AS (SELECT *, CASE WHEN dh = 1 AND dl = 1 THEN 1 WHEN dh = -1 AND dl = -1 THEN -1 ELSE 0 END AS direction, abs(ln(b / a)) AS impulse FROM ev4),
ev AS (SELECT *, CASE WHEN kind = 'H' AND lean = 1 THEN ln(price / prev) ELSE 0 END AS hh_strength,
 CASE WHEN kind = 'H' AND lean = -1 THEN ln(prev / price) ELSE 0 END AS lh_strength,
 CASE WHEN kind = 'L' AND lean = 1 THEN ln(price / prev) ELSE 0 END AS hl_strength,
 CASE WHEN kind = 'L' AND lean = -1 THEN ln(prev / price) ELSE 0 END AS ll_strength,
 CASE WHEN direction <> 0 THEN len(list_filter(hist, lambda x: x = direction)) / CAST(len(hist) AS DOUBLE) END AS consistency,
 CASE WHEN impulse > 0 THEN abs(ln(price / b)) / impulse END AS pullback FROM ev5)"""
ONBARS = PIVOTS + """,
el AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY series_id, conf_pos ORDER BY n DESC) = 1),
lv AS (SELECT series_id, conf_pos, max(price) FILTER (WHERE kind = 'H') AS hi, max(price) FILTER (WHERE kind = 'L') AS lo FROM ev GROUP BY 1, 2),
sb AS (
 SELECT b.series_id, b.pos, b.ts, b.close, coalesce(e.hh_strength, 0) AS hh_strength, coalesce(e.lh_strength, 0) AS lh_strength,
  coalesce(e.hl_strength, 0) AS hl_strength, coalesce(e.ll_strength, 0) AS ll_strength,
  coalesce(last_value(e.direction IGNORE NULLS) OVER w, 0) AS direction, last_value(e.consistency IGNORE NULLS) OVER w AS consistency,
  last_value(e.pullback IGNORE NULLS) OVER w AS pullback, last_value(e.impulse IGNORE NULLS) OVER w AS impulse,
  last_value(l.hi IGNORE NULLS) OVER w AS high_level, last_value(l.lo IGNORE NULLS) OVER w AS low_level
 FROM bars b LEFT JOIN el e ON e.series_id = b.series_id AND e.conf_pos = b.pos LEFT JOIN lv l ON l.series_id = b.series_id AND l.conf_pos = b.pos
 WINDOW w AS (PARTITION BY b.series_id ORDER BY b.pos)),
sc AS (SELECT *, lag(direction) OVER (PARTITION BY series_id ORDER BY pos) AS prior, CAST(close > high_level AS BIGINT) AS bos_up,
 CAST(close < low_level AS BIGINT) AS bos_down, ln(close / high_level) AS dist_swing_high, ln(close / low_level) AS dist_swing_low FROM sb),
sd AS (SELECT *, CASE WHEN prior IS NOT NULL AND bos_up IS NOT NULL THEN CAST(prior = -1 AND bos_up = 1 AS BIGINT) END AS choch_up,
 CASE WHEN prior IS NOT NULL AND bos_down IS NOT NULL THEN CAST(prior = 1 AND bos_down = 1 AS BIGINT) END AS choch_down,
 sum(CASE WHEN prior IS NULL OR prior <> direction THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos) AS era FROM sc)
"""


def _bars(spark, folder):
    return stage(inp.bars(spark, folder).select("series_id", "pos", "ts", "high", "low", "close"))


def _events(bars):
    return stage(st.swing_events(st.swing_points(bars, K), K))


def _on_bars(spark, folder):
    b = _bars(spark, folder)
    p = stage(st.pivot_features(_events(b)))
    return st.scatter(b, st.last_per_bar(p), p)


@query("swing_points", "series_id ts:t swing_high:b swing_low:b", swings_sql(K) + ";; SELECT * FROM sw")
def swing_points(spark, folder):
    return st.swing_points(_bars(spark, folder), K)


@query("swing_events", "series_id pivot_pos:l conf_pos:l kind price:d", EVENTS + ";; SELECT * FROM ev0")
def swing_events(spark, folder):
    return st.swing_events(st.swing_points(_bars(spark, folder), K), K)


def pivot(name, columns, body=";; SELECT * FROM ev"):
    @query(name, f"series_id pivot_pos:l kind {columns}", PIVOTS + body)
    def run(spark, folder):
        return st.pivot_features(_events(_bars(spark, folder)))


pivot("pivot_compare", "hh_strength:d lh_strength:d hl_strength:d ll_strength:d lean:l")
pivot("structure_direction", "direction:l")
pivot("structure_consistency", "consistency:d")
pivot("impulse_pullback", "impulse:d pullback:d")


@query("event_dedupe_last", "series_id conf_pos:l kind price:d direction:l", PIVOTS + """;;
SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY series_id, conf_pos ORDER BY n DESC) = 1""")
def event_dedupe_last(spark, folder):
    return st.last_per_bar(st.pivot_features(_events(_bars(spark, folder))))


def on_bars(name, columns, finish=lambda d: d, body=";; SELECT * FROM sd"):
    @query(name, f"series_id ts:t {columns}", ONBARS + body)
    def run(spark, folder):
        return finish(_on_bars(spark, folder))


on_bars("event_scatter_locf", "hh_strength:d hl_strength:d lh_strength:d ll_strength:d direction:l consistency:d pullback:d impulse:d")
on_bars("break_of_structure", "bos_up:l bos_down:l", st.breaks)
on_bars("change_of_character", "choch_up:l choch_down:l", st.breaks)
on_bars("swing_distance", "dist_swing_high:d dist_swing_low:d", st.breaks)
on_bars("structure_age", "direction:l structure_age:l", lambda d: st.structure_age(stage(d)),
        ";; SELECT *, row_number() OVER (PARTITION BY series_id, era ORDER BY pos) - 1 AS structure_age FROM sd")


WIDTHS = (2, 3, 4, 5, 6, 8, 10)
SWEEP = ",".join(swings_sql(k, f"k{k}_") for k in WIDTHS) + ";;" + " UNION ALL ".join(
    f"SELECT {k} AS k, count(*) FILTER (WHERE swing_high) AS n_high, count(*) FILTER (WHERE swing_low) AS n_low, "
    f"round(corr(high, low), 6) AS hl_corr FROM k{k}_ WHERE swing_high OR swing_low" for k in WIDTHS)


@query("pivot_k_sweep", "k:l n_high:l n_low:l hl_corr:d", SWEEP)
def pivot_k_sweep(spark, folder):
    s = st.sweep(inp.bars(spark, folder).select("series_id", "pos", "high", "low"), WIDTHS)
    return s.groupBy("k").agg(F.count_if("swing_high").alias("n_high"), F.count_if("swing_low").alias("n_low"),
                              F.corr("high", "low").alias("hl_corr"))
