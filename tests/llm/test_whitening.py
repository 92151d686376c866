"""Whitening against plain integers and numpy."""

import math

import numpy as np
import pytest

pytest.importorskip("llm.queries")

from llm import whitening  # noqa: E402
from llm.queries import QUERIES  # noqa: E402


def plain(vectors):
    rows = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, dims = len(rows), len(rows[0])
    sums = [sum(r[d] for r in rows) for d in range(dims)]
    cov = np.array([[(n * sum(r[i] * r[j] for r in rows) - sums[i] * sums[j]) / n ** 2 for j in range(dims)] for i in range(dims)])
    return rows, n, sums, cov


def check(got, named, components):
    rows, n, sums, cov = plain(list(named.values()))
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    want = {}
    for key, r in zip(named, rows):
        off = [n * x - s for x, s in zip(r, sums)]
        for k in range(components):
            want[key, k + 1] = (sum(o * o for o in off), float(np.array(off, float) / n @ axes[:, k] / math.sqrt(values[k])), values[k] / cov.trace())
    assert len(got) == len(want)
    sign = {}
    for r in got:
        deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert r["n"] == n and int(r["deviation"]) == deviation and math.isclose(r["explained"], explained, rel_tol=1e-9)
        if abs(whitened) > 1e-3:
            s = sign.setdefault(r["component"], math.copysign(1, r["whitened"] * whitened))
            assert math.isclose(r["whitened"], s * whitened, rel_tol=1e-6, abs_tol=1e-9)
        assert r["identity_error"] < 1e-6


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for x in (rng.integers(-5, 1000, (130, 7)), rng.integers(-2 ** 52, 2 ** 52, (65, 3)), np.zeros((4, 3), np.int64), np.full((1, 2), -7)):
        sums, products = whitening.block_products(x)
        big = x.astype(object)
        assert (sums == big.sum(axis=0)).all() and (products == big.T @ big).all()


def test_rows_that_take_no_part(shipped):
    rng = np.random.default_rng(3)
    fine = {i: [float(np.float32(v)) for v in rng.normal(size=10) * (1 + np.arange(10))] for i in range(90)}
    fine[90] = fine[4]  # a repeated vector
    bad = [(100, None), (101, [1.0] * 9 + [None]), (102, [math.nan] + [0.0] * 9), (103, [0.0] * 9 + [math.inf]), (104, []), (105, [1.0, 2.0])]
    df = shipped.createDataFrame([(k, v, 7, "x") for k, v in [*fine.items(), *bad]], "vec_id long, embedding array<float>, n int, deviation string").repartition(5)
    check(whitening.whiten(df).collect(), fine, 8)


def test_far_apart_values_and_few_rows(shipped):
    make = lambda rows: whitening.whiten(shipped.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    named = {1: [9e4, -3.5, 0.25], 2: [-2e4, 4.0, 8.0], 3: [5e3, 100.0, 1.0], 4: [0.0, -50.0, -9.0], 5: [7.0, 1.5, 70.0]}
    check(make(list(named.items())), named, 3)
    assert make([]) == [] and make([(1, None)]) == []
    alone = make([(None, [1.0, 2.0])])
    assert [(r["vec_id"], r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in alone] == [(None, 1, 0, None, 0.0)] * 2


def test_query_on_its_table(shipped):
    folder = "/root/testdata/sf0.01"
    table = shipped.read.parquet(f"{folder}/embeddings.parquet").collect()
    check(QUERIES["op11_bit_sliced_whitening"](shipped, folder).collect(), {r["vec_id"]: r["embedding"] for r in table}, 8)
