"""Hidden-state model with diagonal Gaussian emissions over segments of keyed series.

Spark partitions the work by (key, chunk); Python sees one chunk at a time. Three passes make any
sequence length exact: summarise each chunk, scan the summaries per key, fill each chunk."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.blocks import chunk_of, halo, lookup, over_chunks, stage
from ..functions.lattice import Chunk, Model, log_emission, scan_summaries
from . import gaps, seeding as sd

KEYS = ("series_id",)
CHUNK = 65_536
_A = T.ArrayType(T.DoubleType())


def _fields(df: DataFrame, names):
    return [f for f in df.schema.fields if f.name in names]


def _flat(vs):
    return [np.asarray(v, float).ravel().tolist() for v in vs]


def prepare(rows: DataFrame, cols, keys=KEYS, size: int | None = None, extra=()) -> DataFrame:
    """Keys, slot, segment-start flag, features, extra columns and the chunk number."""
    d = over_chunks(rows, keys, lambda r, w: r.withColumn("new_segment", gaps.new_segment(w)), before=1)
    return d.select(*keys, "pos", "new_segment", *[F.col(c).cast("double").alias(c) for c in cols], *extra,
                    chunk_of("pos", size or CHUNK).alias("_chunk"))


def _summaries(d: DataFrame, cols, pick, keys):
    schema = T.StructType([*_fields(d, keys), T.StructField("_chunk", T.LongType()), T.StructField("p", _A),
                           T.StructField("l", _A), T.StructField("b", _A)])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        ch = Chunk(pdf[cols].to_numpy(float), pdf["new_segment"].to_numpy(), pick(pdf))
        out = pdf[[*keys, "_chunk"]].iloc[:1].reset_index(drop=True)
        for name, v in zip(("p", "l", "b"), ch.summary()):
            out[name] = _flat([v])
        return out

    return d.groupBy(*keys, "_chunk").applyInPandas(one, schema)


def _carries(summ: DataFrame, keys):
    schema = T.StructType([*_fields(summ, keys), T.StructField("_chunk", T.LongType()), T.StructField("a_in", _A),
                           T.StructField("d_in", _A), T.StructField("b_out", _A), T.StructField("entry", T.LongType()),
                           T.StructField("leave", T.LongType())])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        k = len(pdf["l"].iloc[0])
        mats = lambda c: [np.asarray(v, float).reshape(k, k) for v in pdf[c]]
        a, d, b, entry, leave = scan_summaries(mats("p"), [np.asarray(v, float) for v in pdf["l"]], mats("b"))
        out = pdf[[*keys, "_chunk"]].reset_index(drop=True)
        out["a_in"], out["d_in"], out["b_out"], out["entry"], out["leave"] = _flat(a), _flat(d), _flat(b), entry, leave
        return out

    return summ.groupBy(*keys).applyInPandas(scan, schema)


def decode(rows: DataFrame, cols, model: Model | dict, want=("causal",), keys=KEYS, size: int | None = None) -> DataFrame:
    """Per row, any of: causal (cstate, cpost: the terminal read at each bar), path (vstate),
    smooth (spost), score (gain of log-likelihood).

    ``model`` is one model, or a dict by the value of the last key column (many models in one pass)."""
    cols, keys = list(cols), list(keys)
    pick = (lambda pdf: model[pdf[keys[-1]].iloc[0]]) if isinstance(model, dict) else (lambda pdf: model)
    d = stage(prepare(rows, cols, keys, size))
    carry = _carries(_summaries(d, cols, pick, keys), keys)
    extra = {"causal": [("cstate", T.LongType()), ("cpost", _A)], "path": [("vstate", T.LongType())],
             "smooth": [("spost", _A)], "score": [("gain", T.DoubleType())]}
    schema = T.StructType([*_fields(d, (*keys, "pos")), *[T.StructField(n, t) for x in want for n, t in extra[x]]])

    def fill(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("pos")
        ch = Chunk(left[cols].to_numpy(float), left["new_segment"].to_numpy(), pick(left))
        c = right.iloc[0]
        out = left[[*keys, "pos"]].reset_index(drop=True)
        a, gain = ch.forward(c["a_in"])
        if "causal" in want:
            out["cstate"], out["cpost"] = ch.best_ends(c["d_in"]), _flat(a)
        if "path" in want:
            out["vstate"] = ch.best_path(int(c["entry"]), int(c["leave"]))
        if "smooth" in want:
            g = a * ch.backward(c["b_out"])
            out["spost"] = _flat(g / g.sum(axis=1, keepdims=True))
        if "score" in want:
            out["gain"] = gain
        return out[[f.name for f in schema]]

    return d.groupBy(*keys, "_chunk").cogroup(carry.groupBy(*keys, "_chunk")).applyInPandas(fill, schema)


def decode_windows(rows: DataFrame, cols, model: Model, width: int, size: int | None = None) -> DataFrame:
    """Terminal read of a window of at most `width` rows ending at each bar, inside its segment.

    O(rows x width): the slow definition that the one-pass causal decode is checked against."""
    cols = list(cols)
    d = over_chunks(rows, KEYS, lambda r, w: r.withColumn("new_segment", gaps.new_segment(w)), before=1).select(
        "series_id", "pos", "new_segment", *[F.col(c).cast("double").alias(c) for c in cols])
    schema = T.StructType([*_fields(d, ("series_id", "pos")), T.StructField("cstate", T.LongType()), T.StructField("cpost", _A)])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        n, i = len(pdf), np.arange(len(pdf))
        fresh = pdf["new_segment"].to_numpy().copy()
        fresh[0] = True
        first = np.maximum(np.maximum.accumulate(np.where(fresh, i, 0)), i - width + 1)
        lb = log_emission(pdf[cols].to_numpy(float), model)
        with np.errstate(divide="ignore"):
            ls, lt = np.log(model.start), np.log(model.trans)
        at = first.copy()
        d = ls[None] + lb[at]
        a = np.exp(d - d.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        for _ in range(int((i - first).max())):
            go = at < i
            at = np.where(go, at + 1, at)
            nd = (d[:, :, None] + lt[None]).max(axis=1) + lb[at]
            na = (a @ model.trans) * np.exp(lb[at] - lb[at].max(axis=1, keepdims=True))
            na /= na.sum(axis=1, keepdims=True)
            d, a = np.where(go[:, None], nd, d), np.where(go[:, None], na, a)
        out = pdf[["series_id", "pos"]].copy()
        out["cstate"], out["cpost"] = d.argmax(axis=1), _flat(a)
        return out[(pdf["_home"] == pdf["_chunk"]).to_numpy()]

    return halo(d, width, size=size).groupBy("series_id", "_chunk").applyInPandas(one, schema)


def pack(rows: DataFrame, cols, keys=KEYS, size: int | None = None, extra=(), fits: int = 1) -> DataFrame:
    """One record per chunk with its rows as arrays, written once; EM then re-reads it without a shuffle.

    A few chunks would end in one file and so in one task. They get a file each, and where they are fewer than cores they are written
    several times: the copy of turn t serves every fit whose number modulo turns is t. Copies stay below three times the cores."""
    d = prepare(rows, cols, keys, size, extra)
    names = ("pos", "new_segment", *cols, *extra)
    g = d.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("r"))
    packed = stage(g.select(*keys, "_chunk", *[F.col(f"r.{c}").alias(c) for c in names]))
    chunks, cores = packed.count(), rows.sparkSession.sparkContext.defaultParallelism
    if not chunks or chunks >= 4 * cores:
        return packed.withColumns({"turn": F.lit(0), "turns": F.lit(1)})
    turns = min(range(1, max(1, min(fits, math.ceil(2 * cores / chunks))) + 1), key=lambda t: (math.ceil(chunks * t / cores) / t, t))
    copies = packed.withColumns({"turn": F.explode(F.array(*[F.lit(t) for t in range(turns)])), "turns": F.lit(turns)})
    return stage(copies.repartition(chunks * turns))


def _crossing_carries(packed, cols, models, jobs, keys):
    """Entering vectors per (chunk, fit), needed only when a segment crosses chunks."""
    schema = T.StructType([T.StructField("job", T.LongType()), *_fields(packed, keys), T.StructField("_chunk", T.LongType()),
                           T.StructField("p", _A), T.StructField("l", _A), T.StructField("b", _A)])

    def summ(batches):
        for pdf in batches:
            out = []
            for chunk, (rec, x, reset) in zip(pdf["_chunk"], sd.chunks_of(pdf, cols)):
                for i, xs, rs, _ in sd.seen(rec, x, reset, jobs):
                    out.append([i, *[getattr(rec, k) for k in keys], chunk, *_flat(Chunk(xs, rs, models[i]).summary())])
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    carry = _carries(packed.mapInPandas(summ, schema), ["job", *keys])
    return carry.groupBy(*keys, "_chunk").agg(F.collect_list(F.struct("job", "a_in", "b_out")).alias("carry"))


def expected_counts(packed, cols, models: dict[int, Model], keys=KEYS, crossing: bool = False, jobs: dict[int, sd.Job] | None = None) -> dict[int, np.ndarray]:
    """Summed expected counts per fit, all fits in one pass. Every task adds up its own chunks before anything is sent."""
    src, jobs = packed, jobs or {i: sd.Job(i) for i in models}
    if crossing:
        # a few numbers per chunk and fit go to the packed rows, which stay where they are
        src = lookup(packed, _crossing_carries(packed, cols, models, jobs, keys), [*keys, "_chunk"], "left")
    known: dict = {}

    def each(i, rec, x, reset, pos):
        m = models[i]
        if crossing and known.get("rec") is not rec:
            known["rec"], known["carry"] = rec, {c["job"]: (c["a_in"], c["b_out"]) for c in (rec.carry if rec.carry is not None else ())}
        flat = np.full(m.k, 1 / m.k)
        a_in, b_out = known["carry"].get(i, (flat, flat)) if crossing else (flat, flat)
        return Chunk(x, reset, m).counts(x, a_in, b_out)

    return sd.summed(src, cols, jobs, each, packed)


def update(stat: np.ndarray, old: Model, var_floor: float = 1e-2) -> tuple[float, Model]:
    """New parameters from expected counts; var_floor is added to the summed squares of each state."""
    k, f = old.mean.shape
    ll, rest = stat[0], stat[1:]
    cut = np.cumsum([k, k * k, k, k * f])
    start, trans, occ, s1, s2 = np.split(rest, cut)
    trans, s1, s2 = trans.reshape(k, k), s1.reshape(k, f), s2.reshape(k, f)
    n = np.maximum(occ, 1e-5)[:, None]
    rows = trans.sum(axis=1, keepdims=True)
    mean = np.where(occ[:, None] > 1e-5, s1 / n, old.mean)
    var = (var_floor + s2 - 2 * mean * s1 + mean**2 * occ[:, None]) / n
    return float(ll), Model(start / max(start.sum(), 1e-300), np.where(rows > 0, trans / np.maximum(rows, 1e-300), old.trans),
                            mean, np.maximum(var, 1e-10))


def sticky(means: np.ndarray, var: np.ndarray, stay: float = 0.8) -> Model:
    """Given means, one variance per feature for all states, even starts and transitions that stay with odds `stay`."""
    k = len(means)
    trans = np.full((k, k), (1 - stay) / max(k - 1, 1))
    np.fill_diagonal(trans, stay if k > 1 else 1.0)
    return Model(np.full(k, 1 / k), trans, np.asarray(means, float), np.tile(np.maximum(var, 1e-3), (k, 1)))


def first_guess(rows: DataFrame, cols, k: int, seed: int, keys=KEYS) -> Model:
    """k rows drawn by hash as means: the plain start that k-means improves on."""
    picks = rows.select(*keys, "pos", *cols).orderBy(F.xxhash64(F.lit(seed), *keys, "pos")).limit(k).collect()
    v = rows.agg(*[F.var_pop(c).alias(c) for c in cols]).collect()[0]
    return sticky(np.array([[r[c] for c in cols] for r in picks], float), np.array([v[c] or 0.0 for c in cols], float))


def first_models(packed: DataFrame, cols, k: int, jobs: dict[int, sd.Job], keys=KEYS) -> tuple[dict[int, Model], dict[int, int]]:
    """A start by k-means for every job that sees k rows at least, and the rows that each job sees."""
    spread = sd.moments(packed, cols, jobs)
    enough = {i: j for i, j in jobs.items() if i in spread and spread[i][0] >= k}
    rows = {i: spread[i][0] if i in spread else 0 for i in jobs}
    if not enough:
        return {}, rows
    centres = sd.lloyd(packed, cols, enough, sd.starts(packed, cols, k, enough, keys), {i: float(spread[i][2].mean()) for i in enough})
    return {i: sticky(centres[i], spread[i][2]) for i in enough}, rows


def fit_many(packed: DataFrame, cols, k: int, jobs: dict[int, sd.Job], max_iter: int = 100, tol: float = 1e-2, keys=KEYS) -> tuple[dict[int, Model], dict[int, dict]]:
    """Expectation-maximisation of many fits over the same packed rows, each with its own view of them.

    One job per iteration serves all fits that have not converged, so the number of jobs does not grow with the number of folds or
    restarts. Returns models and log entries by fit; a fit that sees fewer rows than states has an entry, but no model."""
    began, cols = time.monotonic(), list(cols)
    crossing = packed.filter(~F.element_at("new_segment", 1)).limit(1).count() > 0
    models, rows = first_models(packed, cols, k, jobs, keys)
    log = {i: {"seed": j.seed, "ll": None, "n_iter": 0, "converged": False, "error": None if i in models else f"{rows[i]} rows for {k} states",
               "n_rows": rows[i], "warnings": 0, "seconds": 0.0} for i, j in jobs.items()}
    active = [i for i in jobs if i in models]
    for it in range(max_iter + 1):
        if not active:
            break
        stats = expected_counts(packed, cols, {i: models[i] for i in active}, keys, crossing, {i: jobs[i] for i in active})
        still = []
        for i in active:
            ll, new = update(stats[i], models[i])
            entry = log[i]
            entry["seconds"] = time.monotonic() - began
            if not np.isfinite(ll):
                entry["error"] = "likelihood is not finite"
                continue
            gain = None if entry["ll"] is None else ll - entry["ll"]
            entry["warnings"] += gain is not None and gain < 0  # the likelihood fell
            entry["ll"] = ll
            if gain is not None and gain < tol:
                entry["converged"] = True
            elif it < max_iter:
                models[i], entry["n_iter"] = new, it + 1
                still.append(i)
        active = still
    return models, log


def fit(rows: DataFrame, cols, k: int, seeds=(1, 2, 3, 4, 5), max_iter: int = 100, tol: float = 1e-2, keys=KEYS,
        size: int | None = None) -> tuple[Model | None, list[dict]]:
    """Several starts in the same jobs; the best training likelihood wins.

    ``rows`` should be staged. Returns the model and one log entry per seed; no model if rows are fewer than states or no start
    gave a finite likelihood (the entries' error says so)."""
    cols = list(cols)
    models, log = fit_many(pack(rows, cols, keys, size, fits=len(seeds)), cols, k, {s: sd.Job(s) for s in seeds}, max_iter, tol, keys)
    best = best_of(log)
    return models.get(best), [log[s] | {"best": s == best} for s in seeds]


def best_of(log: dict[int, dict]) -> int | None:
    good = [i for i, e in log.items() if e["error"] is None and e["ll"] is not None]
    return max(good, key=lambda i: log[i]["ll"], default=None)


LOG_SCHEMA = "seed long, ll double, n_iter long, converged boolean, error string, best boolean"
MODEL_SCHEMA = ("model_id string, state long, start double, trans array<double>, mean array<double>, var array<double>")


def log_table(spark: SparkSession, log: list[dict]) -> DataFrame:
    return spark.createDataFrame([(e["seed"], e["ll"], e["n_iter"], e["converged"], e["error"], e["best"]) for e in log], LOG_SCHEMA)


def model_table(spark: SparkSession, model_id: str, m: Model | None) -> DataFrame:
    """A row per state; none without a model."""
    if m is None:
        return spark.createDataFrame([], MODEL_SCHEMA)
    return spark.createDataFrame([(model_id, s, float(m.start[s]), m.trans[s].tolist(), m.mean[s].tolist(), m.var[s].tolist())
                                  for s in range(m.k)], MODEL_SCHEMA)


def load_model(table: DataFrame, model_id: str) -> Model:
    r = table.filter(F.col("model_id") == model_id).orderBy("state").collect()  # k rows
    return Model(np.array([x["start"] for x in r]), np.array([x["trans"] for x in r]), np.array([x["mean"] for x in r]),
                 np.array([x["var"] for x in r]))


def confidence(post: str = "cpost", state: str = "cstate"):
    return F.element_at(post, (F.col(state) + 1).cast("int"))


def margin(post: str = "cpost"):
    top = F.sort_array(post, asc=False)
    return F.element_at(top, 1) - F.element_at(top, 2)


def stay_prob(model: Model, state: str = "cstate"):
    return F.element_at(F.array(*[F.lit(float(p)) for p in np.diag(model.trans)]), (F.col(state) + 1).cast("int"))

