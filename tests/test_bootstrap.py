"""The bootstrap of an AUC against one replicate after the other."""

import numpy as np
import pytest

from tideline.operators import stats as st

REPLICATES = 60


def plain(rows, key):
    cells = {}
    for k, score, label in rows:
        if k == key and label is not None and score is not None:
            cells.setdefault(score, [0, 0])[0 if label == 1 else 1] += 1
    drawn = {s: (st.draws((key,), s, "p", p, REPLICATES, 42), st.draws((key,), s, "q", q, REPLICATES, 42)) for s, (p, q) in cells.items()}
    aucs = []
    for b in range(REPLICATES):
        pos = [(s, d[0][b]) for s, d in drawn.items()]
        neg = [(s, d[1][b]) for s, d in drawn.items()]
        n = sum(w for _, w in pos) * sum(w for _, w in neg)
        if n:
            aucs.append(sum(w * v * (1.0 if s > t else 0.5 if s == t else 0.0) for s, w in pos for t, v in neg) / n)
    return len(aucs), np.mean(aucs), *np.percentile(aucs, [2.5, 97.5])


@pytest.mark.parametrize("cells,ranges,parts", [(512, 64, 4), (3, 2, 9)])
def test_equals_plain(spark, monkeypatch, cells, ranges, parts):
    monkeypatch.setattr(st, "CELLS", cells)
    monkeypatch.setattr(st, "RANGES", ranges)
    r = np.random.default_rng(2)
    rows = [(f, float(r.integers(40)) / 8, int(r.random() < 0.5)) for f in (1, 2, 3) for _ in range(25 * f)]
    rows += [(1, 9.0, 1)] * 30 + [(2, None, 1), (2, 1.0, None), (4, 1.0, 1)]  # ties, nulls, a fold with one class
    df = spark.createDataFrame(rows, "fold int, score double, label int").repartition(5)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {x.fold: x for x in st.bootstrap_auc(df, ["fold"], REPLICATES).collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(got) == [1, 2, 3]
    for f, x in got.items():
        assert (x.n_replicates, x.mean_auc, x.lo, x.hi) == pytest.approx(plain(rows, f), rel=1e-9)
    assert st.bootstrap_auc(df.limit(0), ["fold"], REPLICATES).collect() == []


def test_draws():
    d = np.concatenate([st.draws(("a",), float(s), "p", 3, 200, 1) for s in range(200)])
    assert abs(d.mean() - 3) < 0.03 and abs(d.var() - 3) < 0.06
    assert (st.draws(("a",), 1.0, "p", 2, 50, 1) == st.draws(("a",), 1.0, "p", 2, 50, 1)).all()


@pytest.mark.parametrize("cells,ranges,parts", [(512, 64, 4), (2, 2, 9)])
def test_pools_equal_plain(spark, monkeypatch, cells, ranges, parts):
    monkeypatch.setattr(st, "CELLS", cells)
    monkeypatch.setattr(st, "RANGES", ranges)
    r = np.random.default_rng(8)
    rows = [(f, float(r.integers(12)) / 4, int(r.random() < 0.4)) for f in (0, 1, 3, 4) for _ in range(40)] + [(-1, 1.0, 1), (-1, 0.5, 1), (3, None, 1), (1, 2.0, None)]
    df = spark.createDataFrame(rows, "fold int, score double, label int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {x.fold: x.auc for x in st.pool_auc(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for f in (0, 1, 3, 4):
        pos = [s for g, s, y in rows if g < f and y == 1 and s is not None]
        neg = [s for g, s, y in rows if g < f and y == 0 and s is not None]
        want[f] = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    assert got.pop(0) is None and want.pop(0) is None and got == pytest.approx(want, rel=1e-12)
    assert st.pool_auc(df.limit(0)).collect() == []
