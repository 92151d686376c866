"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

BAR = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    *[T.StructField(c, T.DoubleType()) for c in
      ("open", "high", "low", "close", "volume", "avg_price", "buy_vol", "sell_vol", "ofi")]])


def mismatch(df, wanted) -> list[str]:
    """Differences in name or order between a frame and a required column list."""
    have = list(df.columns)
    out = [f"missing {c}" for c in wanted if c not in have] + [f"unexpected {c}" for c in have if c not in wanted]
    return out or [f"position {i}: {h} for {w}" for i, (h, w) in enumerate(zip(have, wanted)) if h != w]


def require(df, wanted) -> None:
    problems = mismatch(df, wanted)
    if problems:
        raise ValueError("; ".join(problems))
