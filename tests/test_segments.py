"""Segment metrics and threshold trials against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import metrics as mt, models as ml, stats as st


def plain_auc(pairs):
    pos, neg = [s for y, s in pairs if y == 1], [s for y, s in pairs if y == 0]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None


def plain_precision(pairs):
    total, out, hit, seen = sum(y for y, _ in pairs), 0.0, 0, 0
    for s in sorted({s for _, s in pairs}, reverse=True):
        same = [y for y, t in pairs if t == s]
        hit, seen = hit + sum(same), seen + len(same)
        out += sum(same) / total * hit / seen
    return out


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(3)
    return [(int(f), None if i % 40 == 0 else int(r.random() < s), float(round(s, 2)), float(round(r.normal(), 1)), "a" if i % 3 else None)
            for i, (f, s) in enumerate(zip(r.integers(0, 4, 400), r.random(400)))]


def test_segments(spark, points):
    df = spark.createDataFrame(points, "fold int, label long, score double, x double, side string")
    got = {(r.dim, r.val): r for r in st.segment_breakdown(df, {"side": F.col("side"), "fold": F.col("fold")}, {"x": ("x", 4)}, 60, 200, 10, 50).collect()}
    usable = [p for p in points if p[1] is not None]
    edges = np.unique(np.percentile([p[3] for p in usable], [0, 25, 50, 75, 100]))
    groups = {}
    for p in usable:
        for key in (("side", p[4] or "-"), ("fold", str(p[0])), ("x", str(max(0, int((edges < p[3]).sum()) - 1)))):
            groups.setdefault(key, []).append(p)
    assert set(got) == set(groups)
    for key, rows in groups.items():
        g, pairs = got[key], [(p[1], p[2]) for p in rows]
        assert g.n == len(rows) and g.tier != "INSUFFICIENT"
        assert abs(g.auc - plain_auc(pairs)) < 1e-9 and abs(g.average_precision - plain_precision(pairs)) < 1e-9
        folds = [plain_auc([(p[1], p[2]) for p in rows if p[0] == f]) for f in range(4) if sum(p[0] == f for p in rows) >= 20]
        assert g.n_folds_with_auc == len(folds) and (not folds or abs(g.fold_auc_mean - np.mean(folds)) < 1e-9 and abs(g.fold_auc_std - np.std(folds)) < 1e-9)
        assert g.folds_above == sum(a > 0.5 for a in folds)
    few = st.segment_breakdown(df, {"side": F.col("side")}, {}).collect()
    assert all((r.auc is None) == (r.tier == "INSUFFICIENT") for r in few) and any(r.tier == "INSUFFICIENT" for r in few)
    assert st.segment_breakdown(df.limit(0), {"side": F.col("side")}, {"x": ("x", 4)}).count() == 0


def plain_logistic(x, y, c=1.0):
    x1 = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x1.shape[1]), np.diag([0.0] + [1 / c] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        w -= np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge, x1.T @ (p - y) + ridge @ w)
    return w


def test_threshold_trials(spark):
    r = np.random.default_rng(11)
    rows = []
    for i in range(600):
        trend, a = float(r.normal() * (0.05 if i // 100 == 2 else 0.3)), float(r.normal())
        move = None if i % 50 == 0 else float((1 if r.random() < 1 / (1 + math.exp(-a)) else -1) * np.sign(trend) * abs(r.normal()))
        rows.append((i, i // 100, i < 420, trend, move, a))
    df = spark.createDataFrame(rows, "id long, fold int, inner boolean, trend_score double, fwd_2 double, a double")
    got = {t["cut"]: t for t in ml.threshold_trials(df, (0.1, 0.15, 0.3, 5.0), 0.3, ("a",), ml.logistic)}
    for cut in (0.1, 0.15, 0.3):
        t = got[cut]
        on = [x for x in rows if abs(x[3]) > cut and x[4] is not None]
        eps = np.percentile([abs(x[4]) for x in on if x[2]], 10)
        lab = [(x, int(np.sign(x[4]) == np.sign(x[3]))) for x in on if abs(x[4]) > eps]
        train, val = [l for l in lab if l[0][2]], [l for l in lab if not l[0][2]]
        assert t["status"] == "ok" and abs(t["epsilon"] - eps) < 1e-12 and (t["n_train"], t["n_val"]) == (len(train), len(val))
        assert t["zero_folds"] == sum(not any(abs(x[3]) > cut for x in rows if x[1] == f) for f in range(6))
        w = plain_logistic(np.array([[x[5]] for x, _ in train]), np.array([y for _, y in train], float))
        assert abs(t["auc"] - plain_auc([(y, w[1] * x[5]) for x, y in val])) < 1e-3
        if cut != 0.3:
            fine = t["auc"] >= got[0.3]["auc"] - 0.01
            assert t["verdict"] == ("costs auc" if not fine else "validates" if t["zero_folds"] <= got[0.3]["zero_folds"] else "mixed")
    assert got[0.3]["verdict"] is None and got[5.0]["status"] == "insufficient" and got[5.0]["epsilon"] is None and got[5.0]["zero_folds"] == 6
    assert [t["status"] for t in ml.threshold_trials(df.limit(0), (0.1, 0.3), 0.3, ("a",), ml.logistic)] == ["insufficient"] * 2


def test_two_tables(spark):
    a = spark.createDataFrame([("x", i, i % 3) for i in range(20)] + [("y", 1, 0), ("z", 1, None)], "k string, t long, l int")
    b = spark.createDataFrame([("x", i, 1) for i in range(5, 30)] + [("w", 1, 0), ("z", 1, None)], "k string, t long, l int")
    got = {r.k: r for r in mt.table_agreement(a, b, ("k",), "t", "l").collect()}
    assert set(got) == set("wxyz")
    x = got["x"]
    assert (x.n_a, x.n_b, x.n_common, x.only_a, x.only_b) == (20, 25, 15, 5, 10) and abs(x.agree_pct - 100 / 3) < 1e-9 and abs(x.common_pct - 60) < 1e-9
    assert got["y"].agree_pct is None and got["w"].only_b == 1 and got["z"].agree_pct == 0
    assert mt.table_agreement(a.limit(0), b.limit(0), ("k",), "t", "l").count() == 0
