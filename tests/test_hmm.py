"""The chunked lattice against a plain row-by-row one, and the fit on a known chain."""

import numpy as np
import pytest

from tideline.functions.lattice import Chunk, Model, log_emission, scan_summaries
from tideline.operators import hmm


@pytest.fixture(scope="module")
def chain():
    r = np.random.default_rng(7)
    m = Model(np.array([0.5, 0.3, 0.2]), np.array([[0.9, 0.07, 0.03], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]]),
              np.array([[-2.0, 0.0], [0.0, 1.0], [2.0, -1.0]]), np.array([[0.5, 1.0], [0.4, 0.7], [0.6, 0.5]]))
    n, s, states = 1200, 0, []
    reset = np.zeros(n, bool)
    reset[[0, 300, 307, 900]] = True
    for i in range(n):
        s = r.choice(3, p=m.start if reset[i] else m.trans[s])
        states.append(s)
    x = m.mean[states] + r.normal(size=(n, 2)) * np.sqrt(m.var[states])
    return m, x, reset


def plain(m, x, reset):
    """One step at a time over separate segments."""
    lb = log_emission(x, m)
    n, k = lb.shape
    a, d, b, path, gain = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k)), np.zeros(n, int), np.zeros(n)
    cuts = [*np.flatnonzero(reset), n]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        ptr = np.zeros((n, k), int)
        for t in range(lo, hi):
            p = m.start if t == lo else a[t - 1] @ m.trans
            v = p * np.exp(lb[t])
            gain[t], a[t] = np.log(v.sum()), v / v.sum()
            if t == lo:
                d[t] = np.log(m.start) + lb[t]
            else:
                c = d[t - 1][:, None] + np.log(m.trans)
                ptr[t], d[t] = c.argmax(0), c.max(0) + lb[t]
        b[hi - 1] = 1
        for t in range(hi - 2, lo - 1, -1):
            b[t] = m.trans @ (np.exp(lb[t + 1]) * b[t + 1])
            b[t] /= b[t].sum()
        path[hi - 1] = d[hi - 1].argmax()
        for t in range(hi - 2, lo - 1, -1):
            path[t] = ptr[t + 1][path[t + 1]]
    g = a * b
    return a, d.argmax(1), g / g.sum(1, keepdims=True), path, gain


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
def test_chunks_equal_plain(chain, size):
    m, x, reset = chain
    parts = [(x[i:i + size], reset[i:i + size]) for i in range(0, len(x), size)]
    chunks = [Chunk(xx, rr, m) for xx, rr in parts]
    s = [c.summary() for c in chunks]
    a_in, d_in, b_out, entry, leave = scan_summaries(*zip(*s))
    a, ends, smooth, path, gain = plain(m, x, reset)
    fa = [c.forward(v) for c, v in zip(chunks, a_in)]
    np.testing.assert_allclose(np.vstack([f[0] for f in fa]), a, atol=1e-9)
    np.testing.assert_allclose(np.concatenate([f[1] for f in fa]), gain, atol=1e-8)
    assert (np.concatenate([c.best_ends(v) for c, v in zip(chunks, d_in)]) == ends).all()
    assert (np.concatenate([c.best_path(e, l) for c, e, l in zip(chunks, entry, leave)]) == path).all()
    g = np.vstack([f[0] * c.backward(v) for f, c, v in zip(fa, chunks, b_out)])
    np.testing.assert_allclose(g / g.sum(1, keepdims=True), smooth, atol=1e-9)
    tot = sum(c.counts(xx, av, bv) for c, (xx, _), av, bv in zip(chunks, parts, a_in, b_out))
    np.testing.assert_allclose(tot[0], gain.sum(), rtol=1e-10)
    np.testing.assert_allclose(tot[1:4].sum(), reset.sum(), rtol=1e-9)
    np.testing.assert_allclose(tot[4:13].sum(), (~reset).sum(), rtol=1e-9)


def test_fit_and_decode_on_spark(spark, chain):
    m, x, reset = chain
    pos = np.arange(len(x)) + 5 * np.cumsum(reset)
    rows = spark.createDataFrame([("k", int(p), float(v[0]), float(v[1])) for p, v in zip(pos, x)], "series_id string, pos long, u double, v double")
    a, ends, smooth, path, gain = plain(m, x, reset)
    for size in (64, 4096):
        out = hmm.decode(rows, ("u", "v"), m, ("causal", "path", "smooth", "score"), size=size).orderBy("pos").toPandas()
        assert (out.cstate.to_numpy() == ends).all() and (out.vstate.to_numpy() == path).all()
        np.testing.assert_allclose(np.vstack(out.cpost), a, atol=1e-9)
        np.testing.assert_allclose(np.vstack(out.spost), smooth, atol=1e-9)
        np.testing.assert_allclose(out.gain.sum(), gain.sum(), rtol=1e-10)
    slow = hmm.decode_windows(rows, ("u", "v"), m, 700).orderBy("pos").toPandas()
    assert (slow.cstate.to_numpy() == ends).all()
    one, log1 = hmm.fit(rows, ("u", "v"), 3, seeds=(1, 2), max_iter=4, size=4096)
    two, log2 = hmm.fit(rows, ("u", "v"), 3, seeds=(1, 2), max_iter=4, size=100)
    np.testing.assert_allclose([e["ll"] for e in log1], [e["ll"] for e in log2], rtol=1e-9)
    np.testing.assert_allclose(one.mean, two.mean, rtol=1e-7)


def test_likelihood_rises(spark, chain):
    m, x, reset = chain
    rows = spark.createDataFrame([("k", int(p), float(v[0]), float(v[1])) for p, v in zip(np.arange(len(x)) + 3 * np.cumsum(reset), x)],
                                 "series_id string, pos long, u double, v double")
    packed = hmm.pack(rows, ["u", "v"])
    g, last = hmm.first_guess(rows, ["u", "v"], 3, 4), -np.inf
    for _ in range(5):
        ll, g = hmm.update(hmm.expected_counts(packed, ["u", "v"], {4: g})[4], g, var_floor=0.0)
        assert ll >= last - 1e-6
        last = ll
