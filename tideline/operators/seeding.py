"""Starts of a model fit: k-means over packed chunks, for many fits in the same jobs.

Seeds are drawn by k-means||: a first row by hash, then rounds that draw every row with odds in proportion to its squared
distance from what is drawn already, a few rows a round whatever the number of rows. The drawn rows, weighted by the rows nearest to
them, are reduced to k on the driver; Lloyd steps over all rows follow. A draw depends on key, slot, seed and round alone, so a
lost task draws the same rows again. A job serves all fits: the number of jobs depends on rounds and steps only.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

ROUNDS = 2
STEPS = 50
FEW = 64  # tasks whose sums come to the driver as they are; those of more tasks are added up in a shuffle first
MOVED = 1e-4  # steps end when centres move less than this share of the mean variance


@dataclass(frozen=True)
class View:
    """What one fit sees of the rows: earlier folds without the late rows right before the fold, scaled. Folds follow time."""

    fold: int
    shift: tuple
    scale: tuple

    def keep(self, rec) -> np.ndarray:
        fold, late = np.asarray(rec.fold), np.asarray(rec.late, bool)
        return (fold < self.fold) & ~(late & (fold == self.fold - 1))

    def of(self, rec, x: np.ndarray, reset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, segment starts and slots."""
        keep, pos = self.keep(rec), np.asarray(rec.pos)
        if not keep.any():
            return x[:0], reset[:0], pos[:0]
        fresh = reset | np.r_[False, ~keep[:-1]]
        return (x[keep] - np.array(self.shift)) / np.array(self.scale), fresh[keep], pos[keep]


@dataclass(frozen=True)
class Job:
    seed: int
    view: View | None = None


def chunks_of(pdf, cols):
    for rec in pdf.itertuples(index=False):
        x = np.column_stack([np.asarray(getattr(rec, c), float) for c in cols])
        yield rec, x, np.asarray(rec.new_segment, bool)


def seen(rec, x, reset, jobs: dict[int, Job]):
    """For every job that this copy of the chunk serves and that has rows in it: its number, rows, segment starts and slots; each view is made once."""
    made: dict = {}
    for n, (i, job) in enumerate(jobs.items()):
        if n % rec.turns != rec.turn:
            continue
        if job.view not in made:
            made[job.view] = (x, reset, np.asarray(rec.pos)) if job.view is None else job.view.of(rec, x, reset)
        if len(made[job.view][0]):
            yield i, *made[job.view]


def summed(src: DataFrame, cols, jobs: dict[int, Job], each: Callable, packed: DataFrame | None = None) -> dict[int, np.ndarray]:
    """Adds up each(number, rec, x, reset, pos) over chunks: in the task first, then over tasks. Jobs without rows are missing.
    packed: the written chunks, if src joins something to them."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for rec, x, reset in chunks_of(pdf, cols):
                for i, xs, rs, pos in seen(rec, x, reset, jobs):
                    v = each(i, rec, xs, rs, pos)
                    total[i] = total[i] + v if i in total else v
        yield pd.DataFrame([{"job": i, "stat": v.tolist()} for i, v in total.items()], columns=["job", "stat"])

    parts = src.mapInPandas(run, "job long, stat array<double>")
    if (src if packed is None else packed).rdd.getNumPartitions() <= FEW:
        total: dict[int, np.ndarray] = {}
        for r in parts.collect():  # tasks x jobs x a fixed number of sums, in the order of the files
            v = np.array(r["stat"], float)
            total[r["job"]] = total[r["job"]] + v if r["job"] in total else v
        return total
    sums = parts.select("job", F.posexplode("stat").alias("i", "v")).groupBy("job", "i").agg(F.sum("v").alias("v"))
    out: dict[int, dict] = {}
    for r in sums.collect():  # jobs x a fixed number of sums
        out.setdefault(r["job"], {})[r["i"]] = r["v"]
    return {j: np.array([v[i] for i in range(len(v))]) for j, v in out.items()}


def chance(key: str, pos: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in [0, 1) for every row, by hash."""
    with np.errstate(over="ignore"):
        z = pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((zlib.crc32(f"{key}|{seed}|{turn}".encode()) * 0xD1B54A32D192ED03) % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)


def _drawn(src: DataFrame, cols, keys, jobs, take: Callable) -> dict[int, np.ndarray]:
    """Rows that take(number, x, chances) picks, per job, in a fixed order."""

    def run(batches):
        for pdf in batches:
            rows = []
            for rec, x, reset in chunks_of(pdf, cols):
                key = "|".join(str(getattr(rec, k)) for k in keys)
                for i, xs, _, pos in seen(rec, x, reset, jobs):
                    u = take[1](i, key, pos)
                    rows += [(i, float(u[r]), xs[r].tolist()) for r in np.flatnonzero(take[0](i, xs, u))]
            yield pd.DataFrame(rows, columns=["job", "u", "row"])

    found = src.mapInPandas(run, "job long, u double, row array<double>")
    out: dict[int, list] = {}
    for r in found.orderBy("job", "u", "row").collect():
        out.setdefault(r["job"], []).append(r["row"])
    return {i: np.array(v) for i, v in out.items()}


def reduced(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted points by k-means++ and weighted Lloyd steps among them; points are few."""
    rng = np.random.default_rng(seed)
    picked = [int(rng.choice(len(points), p=weight / weight.sum()))]
    while len(picked) < k:
        d = distances(points, points[picked]).min(axis=1) * weight
        picked.append(int(rng.choice(len(points), p=d / d.sum())) if d.sum() > 0 else picked[-1])
    centres = points[picked]
    for _ in range(STEPS):
        near = distances(points, centres).argmin(axis=1)
        new = np.array([np.average(points[near == c], axis=0, weights=weight[near == c]) if weight[near == c].sum() > 0 else centres[c] for c in range(k)])
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def lloyd(src: DataFrame, cols, jobs: dict[int, Job], centres: dict[int, np.ndarray], spread: dict[int, float], steps: int | None = None) -> dict[int, np.ndarray]:
    """Lloyd steps over all rows; a centre that loses its rows stays where it is."""
    centres, active = dict(centres), dict(jobs)
    for _ in range(STEPS if steps is None else steps):
        now = {i: centres[i] for i in active}

        def each(i, rec, x, reset, pos):
            near = distances(x, now[i]).argmin(axis=1)
            k = len(now[i])
            sums = np.stack([np.bincount(near, x[:, f], k) for f in range(x.shape[1])], axis=1)
            return np.concatenate([np.bincount(near, minlength=k).astype(float), sums.ravel()])

        for i, v in summed(src, cols, active, each).items():
            k = len(now[i])
            n, s = v[:k, None], v[k:].reshape(k, -1)
            centres[i] = np.where(n > 0, s / np.maximum(n, 1), now[i])
        active = {i: j for i, j in active.items() if ((centres[i] - now[i]) ** 2).sum() > MOVED * spread[i]}
        if not active:
            break
    return centres


def moments(src: DataFrame, cols, jobs: dict[int, Job]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Rows, means and population variances of what each job sees."""
    got = summed(src, cols, jobs, lambda i, rec, x, reset, pos: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    out, f = {}, len(cols)
    for i, v in got.items():
        mean = v[1:1 + f] / v[0]
        out[i] = int(v[0]), mean, np.maximum(v[1 + f:] / v[0] - mean ** 2, 0.0)
    return out


def starts(src: DataFrame, cols, k: int, jobs: dict[int, Job], keys) -> dict[int, np.ndarray]:
    """k seeds for every job, before Lloyd steps. Jobs see k rows at least."""
    ids = [jobs[i].seed for i in jobs]
    assert len(ids) == len(jobs)
    draw = lambda turn: (lambda i, key, pos: chance(key, pos, jobs[i].seed, turn))
    lowest = _lowest(src, cols, keys, jobs, draw(0))
    centres = {i: lowest[i][None] for i in jobs}
    for turn in range(1, ROUNDS + 1):
        now = dict(centres)
        cost = summed(src, cols, jobs, lambda i, rec, x, reset, pos: np.array([distances(x, now[i]).min(axis=1).sum()]))
        total = {i: float(v[0]) for i, v in cost.items()}
        more = _drawn(src, cols, keys, jobs, (lambda i, x, u: u * total[i] < 2 * k * distances(x, now[i]).min(axis=1), draw(turn)))
        centres = {i: np.vstack([c, more[i]]) if i in more else c for i, c in centres.items()}
    now = dict(centres)
    weight = summed(src, cols, jobs, lambda i, rec, x, reset, pos: np.bincount(distances(x, now[i]).argmin(axis=1), minlength=len(now[i])).astype(float))
    return {i: reduced(centres[i], weight[i], k, jobs[i].seed) for i in jobs}


def _lowest(src, cols, keys, jobs, draw) -> dict[int, np.ndarray]:
    """Of each job the row with the smallest chance."""

    def run(batches):
        best: dict[int, tuple] = {}
        for pdf in batches:
            for rec, x, reset in chunks_of(pdf, cols):
                key = "|".join(str(getattr(rec, k)) for k in keys)
                for i, xs, _, pos in seen(rec, x, reset, jobs):
                    u = draw(i, key, pos)
                    at = int(u.argmin())
                    best[i] = min(best.get(i, (2.0, [])), (float(u[at]), xs[at].tolist()))
        yield pd.DataFrame([(i, u, row) for i, (u, row) in best.items()], columns=["job", "u", "row"])

    found = src.mapInPandas(run, "job long, u double, row array<double>")
    return {r["job"]: np.array(r["row"]) for r in found.groupBy("job").agg(F.min_by("row", F.struct("u", "row")).alias("row")).collect()}
