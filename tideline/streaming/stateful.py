"""Operators that keep state per series between micro-batches.

Each takes a stream of rows keyed by series_id with a slot number pos. Inside a batch a key's rows are
put in order; rows at or before the last slot already processed are late and dropped. The rows of one
key handled together are bounded by the trigger size (maxFilesPerTrigger / maxBytesPerTrigger)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.lattice import Chunk, Model
from ..operators.features import memory


def _keyed(stream: DataFrame, out_schema: str, state_schema: str, step) -> DataFrame:
    """step(pdf, state or None) -> (output frame, new state tuple); state[0] is the last slot."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("pos").drop_duplicates("pos")
        if old is not None:
            pdf = pdf[pdf["pos"] > old[0]]
        if len(pdf):
            out, new = step(pdf.reset_index(drop=True), old)
            state.update(new)
            yield out

    return stream.groupBy("series_id").applyInPandasWithState(run, out_schema, state_schema, "append", "NoTimeout")


def running_duration(stream: DataFrame, state_col: str = "state") -> DataFrame:
    """Rows in the same state without a missing slot, from 1."""

    def step(pdf, old):
        pos, s = pdf["pos"].to_numpy(), pdf[state_col].to_numpy()
        last_pos, last_s, n = old or (None, None, 0)
        same = np.zeros(len(pos), bool)
        same[1:] = (np.diff(pos) == 1) & (s[1:] == s[:-1])
        same[0] = last_pos is not None and pos[0] == last_pos + 1 and s[0] == last_s
        i = np.arange(len(pos))
        begin = np.maximum.accumulate(np.where(same, -1, i))
        dur = np.where(begin >= 0, i - begin + 1, n + i + 1)
        out = pdf[["series_id", "pos"]].assign(state=s, duration=dur)
        return out, (int(pos[-1]), int(s[-1]), int(dur[-1]))

    return _keyed(stream, "series_id string, pos long, state long, duration long", "pos long, state long, n long", step)


def ema(stream: DataFrame, span: int, column: str = "close") -> DataFrame:
    """Exponential mean with the batch operator's rules for start, gaps and long silences: after a silence longer than
    the mean's memory the last value is the mean.

    State: last slot, last value, mean there, slots since the series began."""
    reach, alpha = memory(span), 2 / (span + 1)

    def step(pdf, old):
        pos, x = pdf["pos"].to_numpy(), pdf[column].to_numpy(float)
        e, n = np.empty(len(pos)), np.empty(len(pos), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(pos) > reach) + 1), len(pos)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            p, v, count = pos[lo:hi], x[lo:hi], pos[lo:hi] - pos[lo] + 1
            lead = 0
            last = old if lo == 0 else (pos[lo - 1], x[lo - 1], e[lo - 1], n[lo - 1])
            if last is not None:
                gap = int(p[0] - last[0]) - 1  # empty slots repeat the stored value
                v = np.concatenate([[last[1] + (1 - alpha) ** gap * (last[2] - last[1])], v])
                count = p - last[0] + last[3]
                p, lead = np.concatenate([[p[0] - 1], p]), 1
            at = p - p[0]
            grid = pd.Series(v, index=at).reindex(range(int(at[-1]) + 1))
            # the carried mean is a seed, not a value to repeat; it is directly followed by a row
            e[lo:hi] = grid.ffill().ewm(span=span, adjust=False).mean().to_numpy()[at][lead:]
            n[lo:hi] = count
        out = pdf[["series_id", "pos"]].assign(ema=np.where(n >= span, e, np.nan))
        return out, (int(pos[-1]), float(x[-1]), float(e[-1]), int(n[-1]))

    return _keyed(stream, "series_id string, pos long, ema double", "pos long, x double, e double, n long", step)


def causal_decode(stream: DataFrame, cols, model: Model) -> DataFrame:
    """The causal read of the sequence model, its lattice vectors kept as state; a missing slot resets it."""
    cols, k = list(cols), model.k

    def step(pdf, old):
        pos = pdf["pos"].to_numpy()
        reset = np.concatenate([[old is None or pos[0] != old[0] + 1], np.diff(pos) != 1])
        a, d = (np.full(k, 1 / k), np.zeros(k)) if old is None else (np.asarray(old[1]), np.asarray(old[2]))
        ch = Chunk(pdf[cols].to_numpy(float), reset, model)
        post, _ = ch.forward(a)
        best = (d[:, None] + ch.summary()[2]).max(axis=0)
        out = pdf[["series_id", "pos"]].assign(cstate=ch.best_ends(d), cpost=[p.tolist() for p in post])
        return out, (int(pos[-1]), post[-1].tolist(), (best - best.max()).tolist())

    return _keyed(stream, "series_id string, pos long, cstate long, cpost array<double>",
                  "pos long, a array<double>, d array<double>", step)
