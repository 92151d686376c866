"""Price structure: confirmed swing points, their comparisons, and the columns they leave on bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.blocks import chunk_of, over_chunks, running
from ..functions.columns import safe_div

KEYS = ("series_id",)
CONSISTENCY = 8


def swing_points(bars: DataFrame, k: int) -> DataFrame:
    """Strict fractal highs and lows over k bars each side; null-safe at gaps and ends (never a swing)."""
    def mark(d, w):
        left, right = w.rangeBetween(-k, -1), w.rangeBetween(1, k)
        whole = (F.count("high").over(left) == k) & (F.count("high").over(right) == k)
        return d.withColumns({
            "swing_high": whole & (F.col("high") > F.max("high").over(left)) & (F.col("high") > F.max("high").over(right)),
            "swing_low": whole & (F.col("low") < F.min("low").over(left)) & (F.col("low") < F.min("low").over(right))})

    return over_chunks(bars, KEYS, mark, before=k, after=k)


def swing_events(swings: DataFrame, k: int) -> DataFrame:
    """One row per pivot, known only k bars later; at one bar a high comes before a low."""
    e = F.inline(F.array_compact(F.array(
        F.when(F.col("swing_high"), F.struct(F.lit("H").alias("kind"), F.col("high").alias("price"))),
        F.when(F.col("swing_low"), F.struct(F.lit("L").alias("kind"), F.col("low").alias("price"))))))
    return swings.filter("swing_high OR swing_low").select(
        "series_id", F.col("pos").alias("pivot_pos"), (F.col("pos") + k).alias("conf_pos"), e)


def pivot_features(events: DataFrame) -> DataFrame:
    """Comparison with the previous pivot of the kind, direction, consistency, impulse and pullback.

    The event table is read several times: pass a staged one."""
    order, chunk = ("pivot_pos", "kind"), chunk_of("pivot_pos")
    e = running(events, ("series_id", "kind"), ("pivot_pos",), chunk, prev=("last", "price", "before"))
    up, down = F.col("price") > F.col("prev"), F.col("price") < F.col("prev")
    rise, fall = F.log(safe_div("price", "prev")), F.log(safe_div("prev", "price"))
    high, low = F.col("kind") == "H", F.col("kind") == "L"
    e = e.withColumns({
        "hh_strength": F.when(high & up, rise).otherwise(0.0), "lh_strength": F.when(high & down, fall).otherwise(0.0),
        "hl_strength": F.when(low & up, rise).otherwise(0.0), "ll_strength": F.when(low & down, fall).otherwise(0.0),
        "lean": F.when(up, 1).when(down, -1).otherwise(0).cast("long")}).drop("prev")
    lean = F.when(F.col("lean") != 0, F.col("lean"))
    e = running(e, KEYS, order, chunk, dir_h=("last", F.when(high, lean)), dir_l=("last", F.when(low, lean)),
                ev=("sum", F.lit(1).cast("long")), moves=("sum", F.abs("lean")))
    e = e.withColumn("direction", F.when(F.col("dir_h") == F.col("dir_l"), F.col("dir_h")).otherwise(0)).drop("dir_h", "dir_l")
    
    # impulse and pullback over the last three pivots of either kind
    def three(d, w):
        p1, p0 = F.lag("price", 1).over(w), F.lag("price", 2).over(w)
        imp = F.abs(F.log(safe_div(p1, p0)))
        return d.withColumns({"impulse": imp, "pullback": safe_div(F.abs(F.log(safe_div("price", p1))), imp)})

    e = over_chunks(e, KEYS, three, before=2, pos="ev")
    # consistency: the last eight moves, numbered by `moves`, then carried over unmoved pivots
    moved = e.filter("lean <> 0")
    def share(d, w):
        frame = w.rowsBetween(-(CONSISTENCY - 1), 0)
        return d.withColumns({"_up": F.sum((F.col("lean") == 1).cast("long")).over(frame), "_n": F.count("lean").over(frame)})

    s = over_chunks(moved.select("series_id", "moves", "lean"), KEYS, share, before=CONSISTENCY, pos="moves").drop("lean")
    e = e.join(s, ["series_id", "moves"], "left")
    agree = F.when(F.col("direction") == 1, F.col("_up")).when(F.col("direction") == -1, F.col("_n") - F.col("_up"))
    return e.withColumn("consistency", agree / F.col("_n")).drop("_up", "_n", "moves")


def last_per_bar(events: DataFrame) -> DataFrame:
    """Two events confirmed on one bar: the later stays."""
    cols = [c for c in events.columns if c not in ("series_id", "conf_pos", "ev")]
    return events.groupBy("series_id", "conf_pos").agg(F.max_by(F.struct(*cols), "ev").alias("_e")).select(
        "series_id", "conf_pos", "_e.*")


def scatter(bars: DataFrame, last_events: DataFrame, levels: DataFrame) -> DataFrame:
    """Event values on bars: one-shot columns zero-filled, state columns carried forward.

    A null event value does not clear the carried one. ``levels`` holds all pivots (before the
    per-bar reduction), since a high and a low can be confirmed on the same bar."""
    shots = ["hh_strength", "hl_strength", "lh_strength", "ll_strength"]
    states = ["direction", "consistency", "pullback", "impulse"]
    e = last_events.select("series_id", F.col("conf_pos").alias("pos"), *shots, *[F.col(s).alias(f"_{s}") for s in states])
    lv = levels.groupBy("series_id", F.col("conf_pos").alias("pos")).agg(
        F.max(F.when(F.col("kind") == "H", F.col("price"))).alias("_hi"),
        F.max(F.when(F.col("kind") == "L", F.col("price"))).alias("_lo"))
    d = bars.join(e, ["series_id", "pos"], "left").join(lv, ["series_id", "pos"], "left").fillna(0.0, shots)
    d = running(d, KEYS, **{s: ("last", f"_{s}") for s in states}, high_level=("last", "_hi"), low_level=("last", "_lo"),
                prior_direction=("last", "_direction", "before"), bar_no=("sum", F.lit(1).cast("long")))
    d = d.withColumn("direction", F.coalesce("direction", F.lit(0)).cast("long"))
    return d.drop("_hi", "_lo", *[f"_{s}" for s in states])


def breaks(d: DataFrame) -> DataFrame:
    """Break of structure, change of character and distances, from the carried levels."""
    up, down = (F.col("close") > F.col("high_level")).cast("long"), (F.col("close") < F.col("low_level")).cast("long")
    prior = F.when(F.col("bar_no") > 1, F.coalesce("prior_direction", F.lit(0)))
    d = d.withColumns({"bos_up": up, "bos_down": down})
    both = lambda want, b: F.when(prior.isNotNull() & F.col(b).isNotNull(), ((prior == want) & (F.col(b) == 1)).cast("long"))
    return d.withColumns({"choch_up": both(-1, "bos_up"), "choch_down": both(1, "bos_down"),
                          "dist_swing_high": F.log(safe_div("close", "high_level")),
                          "dist_swing_low": F.log(safe_div("close", "low_level"))})


def structure_age(d: DataFrame) -> DataFrame:
    """Bars since the direction changed, from 0, not reset by gaps."""
    changed = (F.col("bar_no") == 1) | (F.coalesce("prior_direction", F.lit(0)) != F.col("direction"))
    a = running(d, KEYS, since=("last", F.when(changed, F.col("bar_no"))))
    return a.withColumn("structure_age", F.col("bar_no") - F.col("since")).drop("since")


def sweep(bars: DataFrame, ks) -> DataFrame:
    """Swings for several k in one pass over the bars: one row per (swing bar, k)."""
    top = max(ks)

    def mark(d, w):
        flags = []
        for k in ks:
            left, right = w.rangeBetween(-k, -1), w.rangeBetween(1, k)
            whole = (F.count("high").over(left) == k) & (F.count("high").over(right) == k)
            h = whole & (F.col("high") > F.max("high").over(left)) & (F.col("high") > F.max("high").over(right))
            l = whole & (F.col("low") < F.min("low").over(left)) & (F.col("low") < F.min("low").over(right))
            flags.append(F.struct(F.lit(k).cast("long").alias("k"), h.alias("swing_high"), l.alias("swing_low")))
        return d.withColumn("_k", F.array(*flags))

    d = over_chunks(bars, KEYS, mark, before=top, after=top)
    return d.select(*bars.columns, F.inline("_k")).filter("swing_high OR swing_low")
