"""Boosted trees of second order for expanding pools of folds.

A tree splits where the gain in first and second derivatives of the logistic loss is largest, a leaf is a Newton step with
a ridge, and a child needs a least sum of second derivatives. Rows are packed into chunks once; a chunk also carries the margin
of each of its rows under each fold's model. One job per level adds up derivatives per (fold, node, feature, bin) for all folds of
a batch, so the number of jobs follows rounds and levels. The driver sees these sums only: TOGETHER x nodes x features x bins at most,
from each of FEW tasks, or added up over more tasks by a tree. A task takes ROWS rows or more, so that small pools make small jobs.
The chunks stay in the executors' storage between levels; what is lost or has no room there is read again from the written table.

Derivatives are added as whole numbers (UNIT to one), so sums and trees do not depend on the order of tasks, and a retried
task repeats its share. Which rows a round sees follows from a hash of their key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.blocks import stage

UNIT = float(1 << 24)
LEAST_GAIN = 1e-6
TOGETHER = 16  # folds whose sums one job brings to the driver
FEW = 32  # tasks whose sums come to the driver as they are
ROWS = 10_000  # a task's least share of the rows
REFRESH = 20  # rounds after which the margins in the chunks are written anew
PACKED = "x binary, y binary, key binary, fold binary, late binary, margins binary"


@dataclass(frozen=True)
class Rules:
    rounds: int = 200
    depth: int = 3
    rate: float = 0.05
    child: float = 50.0  # least sum of second derivatives on either side of a split
    sample: float = 0.8  # share of the rows that a round sees
    ridge: float = 1.0
    bins: int = 256
    accuracy: int = 10_000  # of the quantiles that the cuts are taken from; pools of fewer rows give exact ones
    seed: int = 42


class Tree:
    """Node i has children 2i + 1 (below the cut) and 2i + 2; feature -1 marks a leaf."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.feature, self.cut, self.value = np.full(n, -1), np.zeros(n), np.zeros(n)

    def nodes(self, x: np.ndarray, steps: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(steps):
            f = self.feature[at]
            above = x[np.arange(len(x)), np.maximum(f, 0)] >= self.cut[at]
            at = np.where(f < 0, at, 2 * at + 1 + above)
        return at

    def margin(self, x: np.ndarray, depth: int) -> np.ndarray:
        return self.value[self.nodes(x, depth)]


@dataclass
class Fit:
    fold: int
    trees: list[Tree]
    n_pool: int
    pos_rate: float


def _drawn(key: np.ndarray, turn: int, rules: Rules) -> np.ndarray:
    """Which rows the round sees: a 64-bit mix of key, round and seed."""
    z = key.view(np.uint64) + np.uint64(((rules.seed << 32) + turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) < rules.sample * 2.0**64


def derivatives(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) * UNIT), np.rint(np.maximum(p * (1 - p), 1e-16) * UNIT)


def _in_pool(fold: np.ndarray, late: np.ndarray, f: int) -> np.ndarray:
    return (fold < f) & ~(late & (fold == f - 1))


def _pack(n_features: int, n_models: int):
    def pack(batches):
        for b in batches:
            x = np.stack([b[f"x{i}"].to_numpy(np.float64) for i in range(n_features)], axis=1)
            yield pd.DataFrame({"x": [x.tobytes()], "y": [b["y"].to_numpy(np.float64).tobytes()], "key": [b["key"].to_numpy(np.int64).tobytes()],
                                "fold": [b["fold"].to_numpy(np.int32).tobytes()], "late": [b["late"].to_numpy(bool).tobytes()],
                                "margins": [np.zeros((n_models, len(b))).tobytes()]})
    return pack


def _chunks(records, n_features: int, n_models: int):
    for r in records:
        y = np.frombuffer(r.y)
        yield (np.frombuffer(r.x).reshape(len(y), n_features), y, np.frombuffer(r.key, np.int64), np.frombuffer(r.fold, np.int32),
               np.frombuffer(r.late, bool), np.frombuffer(r.margins).reshape(n_models, len(y)), r)


def _level(folds, cuts, done, growing, turn: int, level: int, rules: Rules):
    """Sums of derivatives per cell = ((model x node) x feature) x bin, for the nodes of one level that may still split."""
    d, nodes, first = len(cuts[0]), 2**level, 2**level - 1

    def sums(records):
        total = np.zeros((2, len(folds) * nodes * d * rules.bins), np.int64)
        for x, y, key, fold, late, margins, _ in _chunks(records, d, len(folds)):
            drawn = _drawn(key, turn, rules)
            for i, f in enumerate(folds):
                use = np.flatnonzero(drawn & _in_pool(fold, late, f))
                at = growing[i].nodes(x[use], level) - first
                use, at = use[at >= 0], at[at >= 0]
                if not len(use):
                    continue
                xs = x[use]
                margin = margins[i][use] + sum((t.margin(xs, rules.depth) for t in done[i]), np.zeros(len(use)))
                for w, out in zip(derivatives(margin, y[use]), total):
                    for j in range(d):
                        cell = ((i * nodes + at) * d + j) * rules.bins + np.searchsorted(cuts[i][j], xs[:, j], side="right")
                        low = (i * nodes * d) * rules.bins
                        part = np.bincount(cell - low, weights=w, minlength=nodes * d * rules.bins)
                        out[low:low + len(part)] += part.astype(np.int64)
        yield total
    return sums


def _added(packed: RDD, sums) -> np.ndarray:
    """Sums of both derivatives per cell, over all tasks."""
    parts = packed.mapPartitions(sums)
    return parts.reduce(np.add) if packed.getNumPartitions() <= FEW else parts.treeReduce(np.add)


def _refreshed(n_features: int, n_models: int, done, depth: int):
    def update(batches):
        for b in batches:
            for x, _, _, _, _, margins, r in _chunks(b.itertuples(index=False), n_features, n_models):
                new = np.stack([m + sum((t.margin(x, depth) for t in trees), np.zeros(len(x))) for m, trees in zip(margins, done)])
                yield pd.DataFrame([r._replace(margins=new.tobytes())])
    return update


def _split(tree: Tree, level: int, g: np.ndarray, h: np.ndarray, cuts, rules: Rules) -> None:
    """Splits the nodes of a level where that gains most; g and h: node x feature x bin. Of equal gains the first feature and smallest cut win."""
    for k in range(len(g)):
        node = 2**level - 1 + k
        all_g, all_h = g[k, 0].sum(), h[k, 0].sum()
        if not all_h:
            continue
        lg, lh = np.cumsum(g[k], axis=1)[:, :-1] / UNIT, np.cumsum(h[k], axis=1)[:, :-1] / UNIT
        tg, th = all_g / UNIT, all_h / UNIT
        gain = lg**2 / (lh + rules.ridge) + (tg - lg) ** 2 / (th - lh + rules.ridge) - tg**2 / (th + rules.ridge)
        gain[(lh < rules.child) | (th - lh < rules.child)] = -np.inf
        for j, c in enumerate(cuts):
            gain[j, len(c):] = -np.inf
        j, b = np.unravel_index(np.argmax(gain), gain.shape)
        tree.value[node] = -rules.rate * tg / (th + rules.ridge)
        if gain[j, b] > LEAST_GAIN:
            tree.feature[node], tree.cut[node] = j, cuts[j][b]
            tree.value[2 * node + 1] = -rules.rate * lg[j, b] / (lh[j, b] + rules.ridge)
            tree.value[2 * node + 2] = -rules.rate * (tg - lg[j, b]) / (th - lh[j, b] + rules.ridge)


def _fit_batch(rows: DataFrame, folds: list[int], n_features: int, rules: Rules, n_rows: int) -> list[list[Tree]]:
    names = [f"x{i}" for i in range(n_features)]
    inside = lambda f: (F.col("fold") < f) & ~(F.col("late") & (F.col("fold") == f - 1))
    at = F.array(*[F.lit(i / rules.bins) for i in range(1, rules.bins)])
    q = rows.agg(*[F.percentile_approx(F.when(inside(f), F.col(c)), at, rules.accuracy).alias(f"q_{f}_{c}") for f in folds for c in names]).first()
    cuts = [[np.unique(q[f"q_{f}_{c}"]) for c in names] for f in folds]
    packed = stage(rows.coalesce(max(1, n_rows // ROWS)).mapInPandas(_pack(n_features, len(folds)), PACKED))
    held = packed.rdd.persist(StorageLevel.MEMORY_AND_DISK)  # read by every level of the next REFRESH rounds
    trees, written = [[] for _ in folds], 0
    try:
        for turn in range(rules.rounds):
            if turn - written == REFRESH:
                packed = stage(packed.mapInPandas(_refreshed(n_features, len(folds), [t[written:] for t in trees], rules.depth), PACKED))
                held.unpersist()
                held, written = packed.rdd.persist(StorageLevel.MEMORY_AND_DISK), turn
            growing, done = [Tree(rules.depth) for _ in folds], [t[written:] for t in trees]
            for level in range(rules.depth):
                total = _added(held, _level(folds, cuts, done, growing, turn, level, rules))
                g, h = total.reshape(2, len(folds), 2**level, n_features, rules.bins)
                for i, tree in enumerate(growing):
                    _split(tree, level, g[i], h[i], cuts[i], rules)
                if not any((t.feature[2**level - 1:2 ** (level + 1) - 1] >= 0).any() for t in growing):
                    break
            for t, tree in zip(trees, growing):
                t.append(tree)
    finally:
        held.unpersist()
    return trees


def fit_folds(rows: DataFrame, features, folds, key: Column, rules: Rules = Rules(), min_pool: int = 500) -> list[Fit]:
    """A model per fold, of the labelled rows of all earlier folds. Rows: fold, label (0, 1 or null), features, and optionally late (within
    the embargo before the next fold: no part of that fold's pool). Rows with a null or NaN feature take no part; folds whose pool has fewer
    than min_pool rows or one label only get no model. key tells rows apart; repeated rows are seen together."""
    late = F.coalesce(F.col("late"), F.lit(False)) if "late" in rows.columns else F.lit(False)
    new = {f"x{i}": F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for i, c in enumerate(features)}
    d = rows.filter("label IS NOT NULL").select(F.col("fold").cast("int").alias("fold"), late.alias("late"), F.col("label").cast("double").alias("y"),
                                                F.xxhash64(key).alias("key"), *[c.alias(n) for n, c in new.items()]).dropna(subset=list(new))
    d = stage(d)
    per = d.groupBy("fold", "late").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).collect()
    pools = []
    for f in sorted(folds):
        mine = [r for r in per if r["fold"] < f and not (r["late"] and r["fold"] == f - 1)]
        n, pos = sum(r["n"] for r in mine), sum(r["pos"] for r in mine)
        if n >= max(1, min_pool) and 0 < pos < n:
            pools.append((f, n, pos / n))
    out = []
    for i in range(0, len(pools), TOGETHER):
        part = pools[i:i + TOGETHER]
        n_rows = sum(r["n"] for r in per if r["fold"] < part[-1][0])
        fitted = _fit_batch(d.filter(F.col("fold") < part[-1][0]), [p[0] for p in part], len(new), rules, n_rows)
        out += [Fit(f, trees, n, rate) for (f, n, rate), trees in zip(part, fitted)]
    return out


def predict_folds(rows: DataFrame, features, fits: list[Fit], rules: Rules = Rules()) -> DataFrame:
    """Rows of folds that have a model, with its score (chance of label 1; null where a feature is null or NaN)."""
    models = {f.fold: f.trees for f in fits}

    @F.pandas_udf("double")
    def score(fold: pd.Series, x: pd.DataFrame) -> pd.Series:
        v = x.to_numpy(np.float64)
        out = np.full(len(v), np.nan)
        ok = ~np.isnan(v).any(axis=1)
        for f in np.unique(fold):
            mine = np.flatnonzero(ok & (fold.to_numpy() == f))
            out[mine] = 1 / (1 + np.exp(-sum((t.margin(v[mine], rules.depth) for t in models[f]), np.zeros(len(mine)))))
        return pd.Series(out).astype(object).where(ok, None)

    x = F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    return rows.filter(F.col("fold").isin(list(models))).withColumn("score", score(F.col("fold").cast("int"), x))
