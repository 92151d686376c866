"""Rank-based statistics (percentiles, tie-aware ranks) without a global sort.

Rows are first reduced to distinct values with counts (map-side combined), and the distinct
values are cut into bins by magnitude. The bin number never decreases with the value, so
``running`` over (bin, value) gives exact ranks while each task sees one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import lookup, running
from .columns import col

PER_OCTAVE = 1_024  # bins per doubling of |x|
_SHIFT = 1_100  # beyond the smallest double exponent, keeps every magnitude positive


def value_bin(x) -> Column:
    x = col(x).cast("double")
    size = F.floor(F.log2(F.abs(x)) * PER_OCTAVE) + F.lit(_SHIFT * PER_OCTAVE)
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("long")


def ranked(df, keys, x: str, aggs: dict[str, Column], reverse: bool = False) -> DataFrame:
    """One row per distinct value with, for each aggregate a, a, a_before (sum over smaller values,
    or larger ones when reverse) and a_all."""
    vals = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(*[c.alias(n) for n, c in aggs.items()])
    return cumulate(vals, keys, x, aggs, reverse)


def cumulate(vals, keys, x: str, names, reverse: bool = False) -> DataFrame:
    """ranked() for a table that already has one row per distinct value."""
    specs = {}
    for n in names:
        specs[f"{n}_before"] = ("sum", n, "before")
        specs[f"{n}_all"] = ("total", n)
    return running(vals, keys, (x,), value_bin(x), reverse, **specs)


def _ranks(probs: dict[str, float]) -> dict[str, Column]:
    return {o: F.floor((F.col("n_all") - 1) * F.lit(p)).cast("long") for o, p in probs.items()}


def _interpolate(g: DataFrame, keys, probs, extra=()) -> DataFrame:
    outs = []
    for o, p in probs.items():
        h = (F.col("n_all") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{o}"), F.coalesce(F.col(f"_hi_{o}"), F.col(f"_lo_{o}"))
        outs.append((lo + (hi - lo) * (h - F.floor(h))).alias(o))
    return g.select(*keys, "n_all", *outs, *extra)


def _picks(probs, x: str) -> list[Column]:
    """Values at the lower and upper rank of each probability, from distinct values with counts."""
    def at(rank):
        return F.max(F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n")), F.col(x)))

    return [c for o, r in _ranks(probs).items() for c in (at(r).alias(f"_lo_{o}"), at(r + 1).alias(f"_hi_{o}"))]


def percentiles(df, keys, x: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles per key; probs maps output name to probability.

    First only counts per value bin are shuffled; they tell which bins hold the wanted ranks. Then the
    rows of just those bins are ordered. df is read twice."""
    d = df.filter(F.col(x).isNotNull()).withColumn("_bin", value_bin(x))
    bins = d.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_m"))
    by = Window.partitionBy(*keys)
    bins = bins.withColumns({"_below": F.sum("_m").over(by.orderBy("_bin")) - F.col("_m"), "n_all": F.sum("_m").over(by)})
    hit = F.lit(False)
    for r in _ranks(probs).values():
        for k in (r, r + 1):
            hit = hit | ((F.col("_below") <= k) & (k < F.col("_below") + F.col("_m")))
    few = lookup(d.select(*keys, "_bin", x), bins.filter(hit).drop("_m"), [*keys, "_bin"])
    vals = few.groupBy(*keys, "_bin", x).agg(F.count(F.lit(1)).alias("n"), F.first("_below").alias("_below"), F.first("n_all").alias("n_all"))
    inside = F.sum("n").over(Window.partitionBy(*keys, "_bin").orderBy(x)) - F.col("n")
    r = vals.withColumn("n_before", F.col("_below") + inside)
    return _interpolate(r.groupBy(*keys).agg(F.max("n_all").alias("n_all"), *_picks(probs, x)), keys, probs)


def value_summary(df, keys, x: str, probs: dict[str, float], extra: dict[str, Column]) -> DataFrame:
    """Percentiles of a column with few distinct values (run lengths, replicates) together with aggregates
    over its distinct values, where column n is the multiplicity."""
    r = ranked(df, keys, x, {"n": F.count(F.lit(1))})
    aggs = [F.max("n_all").alias("n_all"), *_picks(probs, x), *[c.alias(n) for n, c in extra.items()]]
    return _interpolate(r.groupBy(*keys).agg(*aggs), keys, probs, extra)


def long_form(df, keys, cols, name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (row, column); the several columns then share one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*keys, F.inline(pairs))
