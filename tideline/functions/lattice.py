"""Numpy steps for a state lattice over one chunk of rows.

A segment start is just another step: its transition matrix has the start probabilities in every
row, so segments need no separate handling. A chunk of n rows is folded into about sqrt(n) blocks
that advance together, and whole chunks are summarised by one k x k matrix, which makes the lattice
an associative scan: summarise chunks, scan the summaries, fill the chunks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np

TINY = 1e-300


@dataclass(frozen=True)
class Model:
    """Start and transition probabilities, means and variances (k states, F features)."""

    start: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    @property
    def k(self) -> int:
        return len(self.start)


def log_emission(x: np.ndarray, m: Model) -> np.ndarray:
    d = (x[:, None, :] - m.mean[None]) ** 2 / m.var[None]
    return -0.5 * (d.sum(axis=2) + np.log(2 * np.pi * m.var).sum(axis=1)[None])


def _log(x):
    return np.log(np.maximum(x, TINY))


class Chunk:
    """Steps of one chunk, padded with identity steps to m blocks of L rows."""

    def __init__(self, x: np.ndarray, reset: np.ndarray, model: Model):
        self.n, self.k, self.model = len(x), model.k, model
        self.L = max(1, math.ceil(math.sqrt(self.n)))
        self.m = math.ceil(self.n / self.L)
        pad = self.m * self.L - self.n
        lb = log_emission(x, model)
        self.reset = reset.astype(bool)
        t = np.where(self.reset[:, None, None], model.start[None, None, :], model.trans[None])
        if pad:
            lb = np.concatenate([lb, np.zeros((pad, self.k))])
            t = np.concatenate([t, np.broadcast_to(np.eye(self.k), (pad, self.k, self.k))])
        self.scale = lb.max(axis=1).reshape(self.m, self.L)
        self.w = (t * np.exp(lb - lb.max(axis=1, keepdims=True))[:, None, :]).reshape(self.m, self.L, self.k, self.k)
        self.steps = t, lb

    @cached_property
    def logw(self):
        """Only best paths need logarithms of the steps."""
        t, lb = self.steps
        with np.errstate(divide="ignore"):
            return (np.log(t) + lb[:, None, :]).reshape(self.m, self.L, self.k, self.k)

    def _rows(self, a):
        return a.reshape(self.m * self.L, *a.shape[2:])[: self.n]

    @cached_property
    def block_sums(self):
        """Per block the row-normalised product of steps and the log scale of each row."""
        p = np.broadcast_to(np.eye(self.k), (self.m, self.k, self.k)).copy()
        ls = np.zeros((self.m, self.k))
        for t in range(self.L):
            p = p @ self.w[:, t]
            s = np.maximum(p.sum(axis=2), TINY)
            p /= s[:, :, None]
            ls += np.log(s) + self.scale[:, t, None]
        return p, ls

    def block_bests(self):
        """Per block the best score from each entry state to each exit state."""
        b = np.where(np.eye(self.k, dtype=bool), 0.0, -np.inf)[None].repeat(self.m, axis=0)
        for t in range(self.L):
            b = (b[:, :, :, None] + self.logw[:, t][:, None]).max(axis=2)
        return b

    def summary(self):
        p, ls = self.block_sums
        P, l, B = p[0], ls[0], None
        for i in range(1, self.m):
            P, l = join_sums(P, l, p[i], ls[i])
        bests = self.block_bests()
        B = bests[0]
        for i in range(1, self.m):
            B = (B[:, :, None] + bests[i][None]).max(axis=1)
        return P, l, B

    def forward(self, a_in):
        """Filtered state probabilities, the log-likelihood gained per row, and the entering vectors."""
        p, ls = self.block_sums
        starts = np.empty((self.m, self.k))
        a = np.asarray(a_in, float)
        for i in range(self.m):
            starts[i] = a
            a = push(a, p[i], ls[i])
        out, gain = np.empty((self.m, self.L, self.k)), np.empty((self.m, self.L))
        a = starts
        for t in range(self.L):
            a = np.einsum("mi,mij->mj", a, self.w[:, t])
            s = np.maximum(a.sum(axis=1), TINY)
            a = a / s[:, None]
            out[:, t], gain[:, t] = a, np.log(s) + self.scale[:, t]
        return self._rows(out), self._rows(gain)

    def backward(self, b_out):
        """Normalised backward vectors at each row."""
        p, ls = self.block_sums
        ends = np.empty((self.m, self.k))
        b = np.asarray(b_out, float)
        for i in range(self.m - 1, -1, -1):
            ends[i] = b
            b = pull(b, p[i], ls[i])
        out = np.empty((self.m, self.L, self.k))
        b = ends
        for t in range(self.L - 1, -1, -1):
            out[:, t] = b
            b = np.einsum("mij,mj->mi", self.w[:, t], b)
            b = b / np.maximum(b.sum(axis=1), TINY)[:, None]
        return self._rows(out)

    def best_ends(self, d_in):
        """State with the best score ending at each row (nothing later is used)."""
        bests = self.block_bests()
        starts = np.empty((self.m, self.k))
        d = np.asarray(d_in, float)
        for i in range(self.m):
            starts[i] = d
            d = (d[:, None] + bests[i]).max(axis=0)
            d = d - d.max()
        out = np.empty((self.m, self.L), dtype=np.int64)
        d = starts
        for t in range(self.L):
            d = (d[:, :, None] + self.logw[:, t]).max(axis=1)
            d = d - d.max(axis=1, keepdims=True)
            out[:, t] = d.argmax(axis=1)
        return self._rows(out)

    def best_path(self, entry: int, leave: int):
        """Best path given the state before the first row and the state at the last row."""
        bests = self.block_bests()
        d = np.full(self.k, -np.inf)
        d[entry] = 0.0
        seen = [d]
        for i in range(self.m):
            d = (d[:, None] + bests[i]).max(axis=0)
            seen.append(d)
        ends = np.empty(self.m, dtype=np.int64)
        s = leave
        for i in range(self.m - 1, -1, -1):
            ends[i] = s
            s = int((seen[i] + bests[i][:, s]).argmax())
        begins = np.concatenate([[entry], ends[:-1]])
        d = np.full((self.m, self.k), -np.inf)
        d[np.arange(self.m), begins] = 0.0
        ptr = np.empty((self.m, self.L, self.k), dtype=np.int64)
        for t in range(self.L):
            c = d[:, :, None] + self.logw[:, t]
            ptr[:, t], d = c.argmax(axis=1), c.max(axis=1)
        out, s, at = np.empty((self.m, self.L), dtype=np.int64), ends, np.arange(self.m)
        for t in range(self.L - 1, -1, -1):
            out[:, t] = s
            s = ptr[at, t, s]
        return self._rows(out)

    def counts(self, x, a_in, b_out):
        """Expected counts of one pass: log-likelihood, starts, transitions, occupancy, sums and squares."""
        a, gain = self.forward(a_in)
        b = self.backward(b_out)
        g = a * b
        g /= np.maximum(g.sum(axis=1, keepdims=True), TINY)
        prev = np.vstack([np.asarray(a_in, float)[None], a[:-1]])
        w = self.w.reshape(-1, self.k, self.k)[: self.n]
        xi = prev[:, :, None] * w * b[:, None, :]
        xi /= np.maximum(xi.sum(axis=(1, 2), keepdims=True), TINY)
        inner = ~self.reset
        return np.concatenate([[gain.sum()], g[self.reset].sum(axis=0), xi[inner].sum(axis=0).ravel(), g.sum(axis=0),
                               (g.T @ x).ravel(), (g.T @ (x * x)).ravel()])


def join_sums(p1, l1, p2, l2):
    top = l2.max()
    r = p1 @ (np.exp(l2 - top)[:, None] * p2)
    s = np.maximum(r.sum(axis=1), TINY)
    return r / s[:, None], l1 + top + np.log(s)


def push(a, p, l):
    """State probabilities after a block."""
    z = a * np.exp(l - l.max())
    r = z @ p
    return r / max(r.sum(), TINY)


def pull(b, p, l):
    """Backward vector before a block."""
    r = np.exp(l - l.max()) * (p @ b)
    return r / max(r.sum(), TINY)


def scan_summaries(P, l, B):
    """From chunk summaries in order: what enters each chunk from the left and from the right."""
    c, k = len(P), len(l[0])
    a, d = np.full(k, 1 / k), np.zeros(k)
    a_in, d_in = [], []
    for i in range(c):
        a_in.append(a)
        d_in.append(d)
        a = push(a, P[i], l[i])
        d = (d[:, None] + B[i]).max(axis=0)
        d = d - d.max()
    b, s = np.full(k, 1 / k), int(d.argmax())
    b_out, entry, leave = [None] * c, [0] * c, [0] * c
    for i in range(c - 1, -1, -1):
        b_out[i], leave[i] = b, s
        b = pull(b, P[i], l[i])
        s = int((d_in[i] + B[i][:, s]).argmax())
        entry[i] = s
    return a_in, d_in, b_out, entry, leave
