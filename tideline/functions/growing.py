"""Percentiles of pools that grow group by group, where what joins a pool depends on the percentile before.

The values are counted once per (group, distinct value); that index is written. Counts per (group, bin of values) then go to the driver,
which walks the groups with bounds: a percentile known to lie within some bins leaves only the rows of those bins in doubt. The bins
in doubt, of all groups together, are cut finer and counted again until every percentile is exact. Each round reads only the bins in
doubt and cuts them by about BINS, so the number of rounds follows the logarithm of the rows and not the number of groups.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .blocks import stage

BINS = 1_024
FEW = 200_000  # counts of single values that the driver takes at most; more are cut into bins first


@dataclass
class _Bins:
    low: np.ndarray  # smallest and largest value of each bin, in ascending order
    high: np.ndarray
    counts: np.ndarray  # rows of each group (first axis) and bin

    @property
    def single(self) -> np.ndarray:
        return self.low == self.high


def _number(edges: np.ndarray, open_from: np.ndarray, open_to: np.ndarray):
    """Bin of a value by its edges, -1 outside the open intervals."""

    @F.pandas_udf("int")
    def number(x: pd.Series) -> pd.Series:
        v = x.to_numpy()
        at = np.searchsorted(open_from, v, side="right") - 1
        inside = (at >= 0) & (v <= open_to[at])
        return pd.Series(np.where(inside, np.searchsorted(edges, v, side="right"), -1).astype(np.int32))

    return number


def _refined(index: DataFrame, groups: list, bins: _Bins | None, doubt: np.ndarray | None) -> _Bins:
    """Cuts the bins in doubt (all values if there are no bins yet)."""
    first = bins is None
    open_from, open_to = (np.array([-np.inf]), np.array([np.inf])) if first else (bins.low[doubt], bins.high[doubt])
    rows = index if first else index.filter(F.col("x").between(float(open_from[0]), float(open_to[-1])))
    rows = rows if first else rows.filter(_number(np.array([]), open_from, open_to)("x") >= 0)
    place = {g: i for i, g in enumerate(groups)}
    if rows.limit(FEW + 1).count() <= FEW:
        got = rows.toPandas()
        low, at = np.unique(got["x"].to_numpy(float), return_inverse=True)
        high = low
    else:
        probs = [i / BINS for i in range(1, BINS)]
        cut = np.unique(np.array(rows.agg(F.percentile_approx("x", probs, 10 * BINS)).first()[0], float))
        edges = np.unique(np.concatenate([cut, np.nextafter(cut, np.inf), open_from]))  # a value that is an edge has a bin of its own
        got = (rows.withColumn("bin", _number(edges, open_from, open_to)("x")).groupBy("group", "bin")
               .agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).toPandas())
        span = got.groupby("bin").agg(low=("low", "min"), high=("high", "max")).sort_index()
        low, high = span["low"].to_numpy(float), span["high"].to_numpy(float)
        at = np.searchsorted(span.index.to_numpy(), got["bin"].to_numpy())
    counts = np.zeros((len(groups), len(low)), np.int64)
    np.add.at(counts, (got["group"].map(place).to_numpy(int), at), got["n"].to_numpy(np.int64))
    if not first:
        low, high = np.concatenate([bins.low[~doubt], low]), np.concatenate([bins.high[~doubt], high])
        counts = np.concatenate([bins.counts[:, ~doubt], counts], axis=1)
    by = np.argsort(low, kind="stable")
    return _Bins(low[by], high[by], counts[:, by])


def _reach(sure: np.ndarray, possible: np.ndarray, p: float) -> tuple[int, int]:
    """First and last bin that can hold the ranks of percentile p, of a pool with sure to possible rows in each bin."""
    a, b = np.cumsum(sure), np.cumsum(possible)
    least, most = b + (a[-1] - a), a + (b[-1] - b)  # size of the pool if all that is in doubt lies below, or above
    from_ = b >= np.floor(p * (least - 1)) + 1
    to = a >= np.minimum(np.floor(p * (most - 1)) + 2, np.maximum(most, 1))
    return int(np.argmax(from_)), int(np.argmax(to)) if to.any() else len(a) - 1


def _percentile(bins: _Bins, pool: np.ndarray, p: float) -> float:
    """Linear between the values at the ranks below and above; the bins that hold them have one value each."""
    up_to, h = np.cumsum(pool), (int(pool.sum()) - 1) * p
    rank = math.floor(h)
    a, b = (bins.low[np.searchsorted(up_to, min(r, int(up_to[-1]) - 1), side="right")] for r in (rank, rank + 1))
    return float(a + (b - a) * (h - rank))


def _walk(bins: _Bins, groups: list, p: float, min_pool: int, min_own: int, frozen: bool):
    """Facts of every group as far as the bins tell, and the bins in doubt."""
    sure = np.zeros(bins.counts.shape[1], np.int64)
    possible, doubt, facts = sure.copy(), np.zeros(len(sure), bool), []
    for i, g in enumerate(groups):
        own = bins.counts[i]
        fewest, most = int(sure.sum()), int(possible.sum())
        choices = {fewest < min_pool, most < min_pool}  # whether the pool is too small
        reach, none = [], False
        for small in choices:
            a, b = (own, own) if small else (sure, possible)
            if (small and own.sum() <= min_own) or not b.any():
                none = True
            else:
                reach.append((*_reach(a, b, p), a, b))
        epsilon, e_low, e_high = None, math.inf, -math.inf
        for first, last, a, b in reach:
            here = np.zeros(len(sure), bool)
            here[first:last + 1] = True
            doubt |= here & ~bins.single
            e_low, e_high = min(e_low, bins.low[first]), max(e_high, bins.high[last])
            if len(choices) == 1 and np.array_equal(a, b) and bins.single[here].all():
                epsilon = e_low = e_high = _percentile(bins, a, p)
        facts.append({"fold": g, "epsilon": epsilon, "pool_rows": fewest, "bootstrap": fewest < min_pool})
        if reach:
            possible = possible + np.where(bins.high > e_low, own, 0) if frozen else possible + own
            if not none:
                sure = sure + np.where(bins.low > e_high, own, 0) if frozen else sure + own
    return facts, doubt


def walk_percentiles(values: DataFrame, groups: list, p: float, min_pool: int, min_own: int, frozen: bool) -> list[dict]:
    """For each group in order: the exact percentile p of the pool of earlier groups, or of its own values if the pool has fewer than
    min_pool (flagged bootstrap; none if it has min_own values or fewer). With frozen only values above their own group's percentile
    join the pool, else all; a group without a percentile adds nothing.

    values: group and x (double). Null and NaN are no values. Returns dicts of fold, epsilon, pool_rows and bootstrap."""
    if not groups:
        return []
    index = stage(values.filter(F.col("group").isin(groups) & F.col("x").isNotNull() & ~F.isnan("x"))
                  .groupBy("group", F.col("x").cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n")))
    bins, doubt = None, None
    while True:
        bins = _refined(index, groups, bins, doubt)
        if not len(bins.low):
            return [{"fold": g, "epsilon": None, "pool_rows": 0, "bootstrap": min_pool > 0} for g in groups]
        facts, doubt = _walk(bins, groups, p, min_pool, min_own, frozen)
        if not doubt.any():
            return facts
