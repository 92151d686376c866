"""Second-order boosting against a plain version that holds all rows and tries every split."""

import math

import numpy as np
import pytest

from tideline.operators import boosting as bo

RULES = bo.Rules(rounds=25, child=4.0, rate=0.3)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    out = []
    for i in range(500):
        a, b, c = r.normal(), float(r.integers(0, 6)), r.normal()
        p = 1 / (1 + math.exp(-(1.5 * a * (b > 2) + 0.4 * c)))
        out.append((i, i // 100, i % 100 >= 95, int(r.random() < p), a, b, c))
    out[7] = (*out[7][:3], None, *out[7][4:])
    out[8] = (*out[8][:4], None, *out[8][5:])
    out[9] = (*out[9][:4], float("nan"), *out[9][5:])
    return out


SCHEMA = "id long, fold int, late boolean, label long, a double, b double, c double"
FEATURES = ("a", "b", "c")


def plain(pool, keys, rules):
    """Trees as nested tuples; tries every value of every feature as a cut."""
    x = [r[4:] for r in pool]
    y = [r[3] for r in pool]
    margin = [0.0] * len(pool)
    cuts = []
    for j in range(3):
        v = sorted(r[j] for r in x)
        cuts.append(sorted({v[max(0, math.ceil(len(v) * i / rules.bins) - 1)] for i in range(1, rules.bins)}))
    trees = []
    for turn in range(rules.rounds):
        seen = [i for i in range(len(pool)) if bo._drawn(np.array([keys[pool[i][0]]], np.int64), turn, rules)[0]]
        gh = {}
        for i in seen:
            p = 1 / (1 + math.exp(-margin[i]))
            gh[i] = round((p - y[i]) * bo.UNIT) / bo.UNIT, round(p * (1 - p) * bo.UNIT) / bo.UNIT

        def grow(mine, depth):
            g, h = sum(gh[i][0] for i in mine), sum(gh[i][1] for i in mine)
            best = None
            if depth:
                for j in range(3):
                    for c in cuts[j]:
                        left = [i for i in mine if x[i][j] < c]
                        lg, lh = sum(gh[i][0] for i in left), sum(gh[i][1] for i in left)
                        if lh < rules.child or h - lh < rules.child:
                            continue
                        gain = lg**2 / (lh + rules.ridge) + (g - lg) ** 2 / (h - lh + rules.ridge) - g**2 / (h + rules.ridge)
                        if gain > 1e-6 and (best is None or gain > best[0]):
                            best = gain, j, c
            if best is None:
                return -rules.rate * g / (h + rules.ridge)
            _, j, c = best
            return j, c, grow([i for i in mine if x[i][j] < c], depth - 1), grow([i for i in mine if x[i][j] >= c], depth - 1)

        trees.append(grow(seen, rules.depth))
        margin = [m + value(trees[-1], v) for m, v in zip(margin, x)]
    return trees


def value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree


def test_equals_a_plain_version(spark, rows):
    from pyspark.sql import functions as F

    from tideline.session import ship

    ship(spark)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    fits = bo.fit_folds(df, FEATURES, range(5), F.col("id"), RULES, min_pool=150)
    assert [f.fold for f in fits] == [2, 3, 4]  # fold 1 has fewer than 150 rows behind it
    got = {r.id: r.score for r in bo.predict_folds(df, FEATURES, fits, RULES).collect()}
    assert set(got) == set(range(200, 500))
    keys = {r.id: r.k for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    usable = [r for r in rows if r[3] is not None and r[4] is not None and r[4] == r[4]]
    for f in (2, 4):
        pool = [r for r in usable if r[1] < f and not (r[2] and r[1] == f - 1)]
        assert next(x for x in fits if x.fold == f).n_pool == len(pool)
        trees = plain(pool, keys, RULES)
        for r in rows:
            if r[1] == f:
                assert abs(got[r[0]] - 1 / (1 + math.exp(-sum(value(t, r[4:]) for t in trees)))) < 1e-6, r[0]
    # later folds change no earlier model, and a rerun over other partitions gives the same scores to the last bit
    part = bo.fit_folds(df.filter("fold < 3").repartition(7), FEATURES, range(3), F.col("id"), RULES, min_pool=150)
    again = {r.id: r.score for r in bo.predict_folds(df, FEATURES, part, RULES).collect()}
    assert again == {i: s for i, s in got.items() if i < 300}


def test_odd_input(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    assert bo.fit_folds(df.limit(0), FEATURES, range(5), F.col("id"), RULES) == []
    assert bo.fit_folds(df.withColumn("label", F.lit(1)), FEATURES, range(5), F.col("id"), RULES, min_pool=10) == []
    assert bo.predict_folds(df, FEATURES, [], RULES).count() == 0
    few = bo.fit_folds(df, FEATURES, [1], F.col("id"), bo.Rules(rounds=2, child=1e6), min_pool=50)  # nothing may split: one leaf
    assert all((t.feature < 0).all() for t in few[0].trees)
    nulls = bo.predict_folds(df.withColumn("fold", F.lit(1)).filter("id IN (8, 9)"), FEATURES, few, RULES).collect()
    assert [r.score for r in nulls] == [None, None]


def test_a_level_is_one_job(spark, rows):
    from pyspark.sql import functions as F

    from tideline.session import ship

    ship(spark)
    sc = spark.sparkContext
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sc.setJobGroup("levels", "boosting")
    try:
        bo.fit_folds(df, FEATURES, range(5), F.col("id"), bo.Rules(rounds=10, child=4.0), min_pool=150)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("levels")) <= 10 * 3 + 12  # counts, cuts and the written tables beside the levels


def test_sums_of_many_tasks_are_the_same(spark, rows, monkeypatch):
    from pyspark.sql import functions as F

    from tideline.session import ship

    ship(spark)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    few = bo.fit_folds(df, FEATURES, [4], F.col("id"), bo.Rules(rounds=3, child=4.0), min_pool=150)
    monkeypatch.setattr(bo, "FEW", 2)
    monkeypatch.setattr(bo, "ROWS", 20)
    many = bo.fit_folds(df, FEATURES, [4], F.col("id"), bo.Rules(rounds=3, child=4.0), min_pool=150)
    for a, b in zip(few[0].trees, many[0].trees):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.value == b.value).all()
