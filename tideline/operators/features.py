"""Causal bar features. Every look-back is gap-aware: a frame that meets a missing bar gives null."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.blocks import chunk_of, halo, over_chunks, running
from ..functions.columns import back, full, safe_div, sample_skew, three_way

KEYS = ("series_id",)
RETURNS = (1, 2, 4)
VOLS = (4, 6)
SPAN = 6
BASE_FEATURES = ("ret_1", "ret_2", "ret_4", "vol_4", "vol_6", "vol_change", "vol_z", "ofi", "ofi_z", "skew_6", "asym_6")
LOOKBACK = SPAN + 1


def log_return(w: Window, n: int):
    return F.log("close") - back(F.log("close"), w, n)


def rolling_zscore(x, w: Window, n: int):
    return safe_div(F.col(x) - full(x, w, n, F.avg), full(x, w, n, F.stddev_samp))


def asymmetry(x, w: Window, n: int):
    """Mean up move over mean up move plus mean down move."""
    up, down = F.greatest(F.col(x), F.lit(0.0)), F.greatest(-F.col(x), F.lit(0.0))
    frame = w.rangeBetween(-(n - 1), 0)
    u, d = F.avg(F.when(F.col(x).isNotNull(), up)).over(frame), F.avg(F.when(F.col(x).isNotNull(), down)).over(frame)
    return F.when(F.count(F.col(x)).over(frame) == n, safe_div(u, u + d))


def vwap_distance(w: Window, n: int):
    paid = full(F.col("avg_price") * F.col("volume"), w, n, F.sum)
    return safe_div(F.col("close") - safe_div(paid, full("volume", w, n, F.sum)), "close")


def add_base(d: DataFrame, w: Window) -> DataFrame:
    """The base feature set on rows that carry their halo (LOOKBACK slots)."""
    d = d.withColumns({f"ret_{n}": log_return(w, n) for n in RETURNS})
    frame = w.rangeBetween(-(SPAN - 1), 0)
    prev = back("volume", w, 1)
    new = {f"vol_{n}": full("ret_1", w, n, F.stddev_samp) for n in VOLS}
    new |= {"vol_change": safe_div(F.col("volume") - prev, prev), "vol_z": rolling_zscore("volume", w, SPAN),
            "ofi_z": rolling_zscore("ofi", w, SPAN),
            "skew_6": F.when(F.count("ret_1").over(frame) == SPAN, sample_skew("ret_1", frame, SPAN)),
            "asym_6": asymmetry("ret_1", w, SPAN)}
    return d.withColumns(new)


def build_features(bars: DataFrame, size: int | None = None) -> DataFrame:
    return over_chunks(bars, KEYS, add_base, before=LOOKBACK, size=size)


def complete(cols=BASE_FEATURES):
    """True when every feature is defined."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return ok


def session_columns(ts: str = "ts") -> dict:
    """Hour of day on the circle, three trading sessions (UTC hours) and their two overlaps."""
    h = F.hour(ts) + F.minute(ts) / 60.0
    turn = F.lit(2 * math.pi) * h / 24.0
    asia, europe, us = (h >= 0) & (h < 9), (h >= 7) & (h < 16), (h >= 12) & (h < 21)
    one = lambda c: c.cast("long")
    return {"hour_sin": F.sin(turn), "hour_cos": F.cos(turn), "session_asia": one(asia), "session_europe": one(europe),
            "session_us": one(us), "session_asia_europe_overlap": one(asia & europe),
            "session_europe_us_overlap": one(europe & us)}


def memory(span: int) -> int:
    """Slots after which an exponential mean has forgotten its past below double precision."""
    return max(span, math.ceil(math.log(1e-18) / math.log(1 - 2 / (span + 1))))


def smooth_slots(pos: np.ndarray, x: np.ndarray, before: np.ndarray, spans, reach: int) -> np.ndarray:
    """Exponential means at the given slots, a missing slot repeating the last value. before: each slot's last value before it,
    nan for a series' first. After a silence of more than `reach` slots the mean has become that value, so it goes
    on from there."""
    out = np.full((len(pos), len(spans)), np.nan)
    cuts = [0, *(np.flatnonzero(np.diff(pos) > reach) + 1), len(pos)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        seeded = int(not np.isnan(before[lo]))
        at = pos[lo:hi] - pos[lo] + seeded
        values, slots = (np.append(before[lo], x[lo:hi]), np.append(0, at)) if seeded else (x[lo:hi], at)
        grid = pd.Series(values, index=slots).reindex(range(int(at[-1]) + 1)).ffill()
        for i, s in enumerate(spans):
            out[lo:hi, i] = grid.ewm(span=s, adjust=False, min_periods=1 if seeded else s).mean().to_numpy()[at]
    return out


def ema(bars: DataFrame, spans, column: str = "close", size: int | None = None) -> DataFrame:
    """Exponential means with alpha = 2 / (span + 1), seeded with the first value, defined from bar `span`.

    A missing bar repeats the last value. The recurrence forgets (1 - alpha) per slot, so a chunk
    plus memory(span) slots of halo gives the full-history value to double precision; each task
    holds one chunk. A silence longer than that memory leaves the last value as the mean, which is carried into
    the chunk."""
    reach = max(memory(s) for s in spans)
    names = [f"ema_{s}" for s in spans]
    keep = [f for f in bars.schema.fields if f.name in ("series_id", "pos")]
    schema = T.StructType([*keep, *[T.StructField(n, T.DoubleType()) for n in names]])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out = pdf[["series_id", "pos"]].reset_index(drop=True)
        e = smooth_slots(pdf["pos"].to_numpy(), pdf[column].to_numpy(float), pdf["_before"].to_numpy(float), spans, reach)
        for i, n in enumerate(names):
            out[n] = e[:, i]
        return out[(pdf["_home"] == pdf["_chunk"]).to_numpy()]

    carried = running(bars.select("series_id", "pos", column), KEYS, chunk=chunk_of("pos", size), _before=("last", column, "before"))
    rows = halo(carried, reach, size=size)
    return rows.groupBy("series_id", "_chunk").applyInPandas(scan, schema)


def ema_features(bars: DataFrame, fast: int, slow: int, lag: int) -> DataFrame:
    """Distances of the close from two means and the slope of the fast one."""
    e = bars.join(ema(bars, (fast, slow)), ["series_id", "pos"])
    f, s = F.col(f"ema_{fast}"), F.col(f"ema_{slow}")
    return over_chunks(e, KEYS, lambda d, w: d.withColumns({
        "ema_dist_fast": F.log(safe_div("close", f)), "ema_dist_slow": F.log(safe_div("close", s)),
        "ema_slope_fast": F.log(safe_div(f, back(f, w, lag)))}), before=lag)


def blend_scores(d: DataFrame, fine: str, fine_conf: str, coarse: str, coarse_conf: str) -> DataFrame:
    """0.6 fine + 0.4 coarse, plain and confidence-weighted, and a three-way bin at 0.3."""
    f, c = F.col(fine), F.col(coarse)
    raw = 0.6 * f + 0.4 * c
    return d.withColumns({"mtf_raw": raw, "mtf_weighted": 0.6 * f * F.col(fine_conf) + 0.4 * c * F.col(coarse_conf),
                          "mtf_bin": three_way(raw, 0.3, -1, 0, 1)})


TREND_REACH = 13  # slots that trend_features may look back, for short = 3 and long = 6


def trend_features(d: DataFrame, w: Window, short: int = 3, long: int = 6) -> DataFrame:
    """Structure, efficiency, acceleration and alignment inside contiguous stretches."""
    net = lambda n: full("ret_1", w, n, F.sum)
    path = lambda n: full(F.abs("ret_1"), w, n, F.sum)
    logp = F.log("close")
    d = d.withColumns({"log_price": logp, "roll_high": full(logp, w, short, F.max), "roll_low": full(logp, w, short, F.min),
                       "eff_short": safe_div(F.abs(net(short)), path(short)),
                       "eff_long": safe_div(F.abs(net(long)), path(long)),
                       "mean_short": full("ret_1", w, short, F.avg),
                       "mtf_alignment": F.signum("ret_1") + F.signum("ret_2") + F.signum("ret_4"),
                       "mtf_conflict": (F.signum("ret_1") != F.signum("ret_4")).cast("long")})
    return d.withColumns({
        "structure_score": F.signum(F.col("roll_high") - back("roll_high", w, short))
        + F.signum(F.col("roll_low") - back("roll_low", w, short)),
        "dist_high": F.col("log_price") - F.col("roll_high"), "dist_low": F.col("log_price") - F.col("roll_low"),
        "accel": F.col("mean_short") - back("mean_short", w, short),
        "eff_deterioration": F.col("eff_short") - back("eff_short", w, short),
        "alignment_deterioration": F.col("mtf_alignment") - back("mtf_alignment", w, short)})
