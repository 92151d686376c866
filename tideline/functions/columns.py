"""Small column expressions shared by every operator (JVM side only)."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def micros(ts: str = "ts") -> Column:
    """Microseconds since the epoch of a zone-less timestamp (independent of the session zone)."""
    return F.expr(f"({ts} - {EPOCH}) div INTERVAL '0.000001' SECOND")


def since(origin: str, ts: str = "ts") -> Column:
    """Microseconds since a zone-less origin."""
    return F.expr(f"({ts} - TIMESTAMP_NTZ'{origin}') div INTERVAL '0.000001' SECOND")


def periods(origin: str, days: int, ts: str = "ts") -> Column:
    """Number of the period of so many days since the origin, negative before it."""
    return F.floor(since(origin, ts) / F.lit(days * 86_400_000_000)).cast("long")


def slot(minutes: int, ts: str = "ts") -> Column:
    """Number of the clock-aligned bucket a timestamp falls in; closed and labelled left."""
    return F.floor(micros(ts) / F.lit(minutes * 60_000_000)).cast("long")


def slot_start(minutes: int, pos: str = "pos") -> Column:
    return F.expr(f"timestampadd(MINUTE, cast({pos} * {minutes} as int), {EPOCH})")


def safe_div(a, b) -> Column:
    """a / b, null when b is 0."""
    return F.try_divide(col(a), F.when(col(b) != 0, col(b)))


def not_nan(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x), x)


def full(x, w: Window, n: int, agg) -> Column:
    """agg over the last n slots, null unless all n hold a defined value.

    The frame is a range over the slot number, so a missing bar leaves it short and gives null.
    """
    frame = w.rangeBetween(-(n - 1), 0)
    return F.when(F.count(col(x)).over(frame) == n, agg(col(x)).over(frame))


def back(x, w: Window, n: int, pos: str = "pos") -> Column:
    """Value exactly n slots ago; null when any gap makes the n-th row back an older one."""
    return F.when(F.lag(pos, n).over(w) == F.col(pos) - n, F.lag(col(x), n).over(w))


def ahead(x, w: Window, n: int, pos: str = "pos") -> Column:
    """Value exactly n slots later; null when the contiguous stretch ends before that."""
    return F.when(F.lead(pos, n).over(w) == F.col(pos) + n, F.lead(col(x), n).over(w))


def clip(x, lo, hi) -> Column:
    """Clip to bounds, keeping null (greatest/least alone would skip it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, col(hi)), col(lo)))


def sample_skew(x, frame, n: int) -> Column:
    """Bias-corrected skewness over a full frame of n; Spark's own is the population form."""
    g = F.skewness(col(x)).over(frame)
    return not_nan(g) * F.lit((n * (n - 1)) ** 0.5 / (n - 2))


def three_way(x, t: float, low, mid, high) -> Column:
    x = col(x)
    return F.when(x > t, F.lit(high)).when(x < -t, F.lit(low)).when(x.isNotNull(), F.lit(mid))
