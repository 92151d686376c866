"""Tail probabilities against closed forms, printed tables and enumeration."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tideline.functions import distributions as ds


def values(spark, rows, schema, column):
    return [r.p for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").withColumn("p", column).orderBy("i").collect()]


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.5, 30.0, 170.5]
    assert values(spark, [(x,) for x in xs], "x double", ds.log_gamma(F.col("x"))) == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)


def test_chi_square(spark):
    rows = [(x, d) for x in (0.0, 0.01, 1.0, 3.0, 10.0, 40.0) for d in (1, 2, 4)]
    closed = {1: lambda x: math.erfc(math.sqrt(x / 2)), 2: lambda x: math.exp(-x / 2), 4: lambda x: math.exp(-x / 2) * (1 + x / 2)}
    assert values(spark, rows, "x double, d int", ds.chi2_tail(F.col("x"), F.col("d"))) == pytest.approx([closed[d](x) for x, d in rows], rel=1e-10, abs=1e-15)
    table = [(3.841458821, 1), (7.814727903, 3), (18.30703805, 10), (124.3421134, 100)]  # the 5 % points
    assert values(spark, table, "x double, d int", ds.chi2_tail(F.col("x"), F.col("d"))) == pytest.approx([0.05] * 4, rel=1e-8)


def test_student(spark):
    table = [(12.70620474, 1), (4.30265273, 2), (2.77644511, 4), (-2.22813885, 10), (2.00855911, 50), (1.98397152, 100)]
    got = values(spark, table, "t double, d int", ds.t_two_sided(F.col("t"), F.col("d")))
    assert got == pytest.approx([0.05] * 6, rel=1e-7)
    rows = [(t, d) for t in (0.0, 0.3, 5.0) for d in (1, 2)]
    closed = {1: lambda t: 1 - 2 / math.pi * math.atan(t), 2: lambda t: 1 - t / math.sqrt(2 + t * t)}
    assert values(spark, rows, "t double, d int", ds.t_two_sided(F.col("t"), F.col("d"))) == pytest.approx([closed[d](t) for t, d in rows], rel=1e-10)
    assert values(spark, [(1.0, 0)], "t double, d int", ds.t_two_sided(F.col("t"), F.col("d"))) == [None]


def test_signed_rank(spark):
    def plain(ranks, w):
        sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(ranks))]
        return min(1.0, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums))

    rows = [([1.0, 2.0, 3.0, 4.0], 10.0), ([1.0, 2.0, 3.0, 4.0, 5.0], 3.0), ([1.5, 1.5, 3.0, 4.5, 4.5, 6.0], 4.5), ([float(i) for i in range(1, 11)], 8.0), ([1.0], 1.0)]
    got = values(spark, rows, "r array<double>, w double", ds.signed_rank_two_sided(F.col("r"), F.col("w")))
    assert got == pytest.approx([plain(r, w) for r, w in rows], rel=1e-12)
    many = [float(i) for i in range(1, 61)]
    (approx,) = values(spark, [(many, 600.0)], "r array<double>, w double", ds.signed_rank_two_sided(F.col("r"), F.col("w")))
    z = (600 - 60 * 61 / 4) / math.sqrt(60 * 61 * 121 / 24)
    assert approx == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-10)
    assert values(spark, [([], 0.0)], "r array<double>, w double", ds.signed_rank_two_sided(F.col("r"), F.col("w"))) == [None]
