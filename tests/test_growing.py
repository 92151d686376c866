"""Percentiles of growing pools against a plain walk, and sums that start anew."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import growing
from tideline.functions.blocks import running_since
from tideline.functions.ordered import percentiles
from tideline.operators import labels as lb


def plain(rows, groups, p, min_pool, min_own, frozen):
    pool, out = np.zeros(0), []
    for g in groups:
        own = np.array([x for h, x in rows if h == g and x is not None])
        small = len(pool) < min_pool
        source = own if small else pool
        e = None if not len(source) or (small and len(own) <= min_own) else float(np.quantile(source, p))
        out.append((g, e, len(pool), small))
        if e is not None:
            pool = np.concatenate([pool, own[own > e] if frozen else own])
    return out


def made(seed, kind, folds, n):
    r = np.random.default_rng(seed)
    draw = {"smooth": lambda k: np.abs(r.normal(size=k)), "ties": lambda k: r.integers(0, 6, k) * 0.25,
            "heavy": lambda k: np.where(r.random(k) < 0.4, 0.0, r.pareto(0.5, k))}[kind]
    rows = [(f, float(x)) for f in range(folds) for x in draw(n if f % 4 else 7)]  # every fourth fold is nearly empty
    return rows + [(0, None), (99, 1.0)]


@pytest.mark.parametrize("kind,bins,few", [("smooth", 8, 30), ("smooth", 1024, 200_000), ("ties", 4, 5), ("heavy", 8, 30)])
def test_walk_equals_a_plain_one(spark, monkeypatch, kind, bins, few):
    monkeypatch.setattr(growing, "BINS", bins)
    monkeypatch.setattr(growing, "FEW", few)
    rows = made(3, kind, 9, 60)
    df = spark.createDataFrame(rows, "group long, x double")
    for p, min_pool, frozen in ((0.1, 50, True), (0.5, 90, False)):
        got = growing.walk_percentiles(df, list(range(9)), p, min_pool, 10, frozen)
        want = plain(rows, range(9), p, min_pool, 10, frozen)
        assert [(g["fold"], g["pool_rows"], g["bootstrap"]) for g in got] == [(g, n, b) for g, _, n, b in want]
        for a, (_, e, *_) in zip(got, want):
            assert (a["epsilon"] is None) == (e is None) and (e is None or math.isclose(a["epsilon"], e, rel_tol=1e-12, abs_tol=1e-15))


def test_walk_reads_follow_no_fold(spark, monkeypatch):
    reads = []
    refined = growing._refined
    monkeypatch.setattr(growing, "_refined", lambda *a: reads.append(1) or refined(*a))
    for folds in (3, 40):
        reads.clear()
        df = spark.createDataFrame(made(5, "smooth", folds, 20), "group long, x double")
        growing.walk_percentiles(df, list(range(folds)), 0.1, 50, 10, True)
        assert len(reads) == 1


def test_walk_without_rows(spark):
    none = spark.createDataFrame([], "fold long, fwd double, is_trending boolean, trend_sign long")
    rows, facts = lb.frozen_epsilon(none, "fwd", [], 50)
    assert rows.count() == 0 and facts == []
    rows, facts = lb.frozen_epsilon(none, "fwd", [0, 1], 50)
    assert rows.count() == 0 and [f["epsilon"] for f in facts] == [None, None]


def test_the_interpolation_is_that_of_percentiles(spark):
    df = spark.createDataFrame([(0, x * 0.37) for x in range(23)], "group long, x double")
    want = percentiles(df, ["group"], "x", {"e": 0.1}).first()["e"]
    assert growing.walk_percentiles(df, [0], 0.1, 5, 3, True)[0]["epsilon"] == want


@pytest.mark.parametrize("size", [4, 7, 1000])
def test_sums_start_anew(spark, size):
    r = np.random.default_rng(1)
    rows, want = [], {}
    for key in ("a", "b"):
        total, total2 = 0.0, 0.0
        for pos in range(200):
            cut = bool(r.random() < (0.02 if key == "a" else 0.4)) or None
            x = None if r.random() < 0.1 else float(r.normal())
            rows.append((key, pos, cut, x))
            total, total2 = (0.0, 0.0) if cut else (total, total2)
            total, total2 = total + (x or 0.0), total2 + 1
            want[key, pos] = (total, total2)
    df = spark.createDataFrame(rows, "k string, pos long, cut boolean, x double")
    got = running_since(df, ["k"], "cut", chunk=F.floor(F.col("pos") / size).cast("long"), s=F.col("x"), n=F.lit(1.0)).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"k", "pos", "cut", "x", "s", "n"}
    assert all(math.isclose(g.s, want[g.k, g.pos][0], abs_tol=1e-12) and g.n == want[g.k, g.pos][1] for g in got)


def test_a_long_past_does_not_blur_a_segment(spark):
    n = 10_000_000
    df = spark.range(0, n + 100).select(F.lit("a").alias("k"), F.col("id").alias("pos"), (F.col("id") == n).alias("cut"),
                                        F.when(F.col("id") < n, F.lit(1e6) / 3).otherwise(F.lit(1e-3) / 3).alias("x"))
    got = running_since(df, ["k"], "cut", s=F.col("x")).filter(F.col("pos") >= n).select("pos", "s").collect()
    x = 1e-3 / 3
    assert len(got) == 100 and all(abs(g.s - x * (g.pos - n + 1)) < 1e-12 for g in got)
