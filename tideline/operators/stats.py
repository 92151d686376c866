"""Breakdown statistics of runs, states, returns and folds."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.blocks import lookup, running, stage
from ..functions.columns import safe_div
from ..functions.distributions import signed_rank_two_sided, t_two_sided
from ..functions.ordered import cumulate, percentiles, ranked, value_summary
from .metrics import auc_of, average_precision, bucket_edges, roc_auc

PCT = 100.0


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double")) * PCT


def describe(rows: DataFrame, keys, x: str, probs: dict[str, float], aggs: dict[str, Column]) -> DataFrame:
    """Plain aggregates joined with exact percentiles."""
    d = rows.filter(F.col(x).isNotNull())
    a = d.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return a.join(percentiles(d, keys, x, probs).drop("n_all"), list(keys))


def unpivot(rows: DataFrame, keep, cols: dict, name: str, value: str) -> DataFrame:
    """One row per (row, column); cols maps a label to a column name."""
    return rows.select(*keep, F.inline(F.array(*[F.struct(F.lit(k).alias(name), F.col(c).alias(value)) for k, c in cols.items()])))


def run_stats(runs: DataFrame, bars: DataFrame, transitions: DataFrame, keys=("series_id",), slots_per_day: int = 24) -> DataFrame:
    """Run lengths and transition rates; everything about lengths comes from counts per distinct length."""
    n, x = F.col("n"), F.col("n_bars")
    total = F.sum("n")
    part = lambda c: F.sum(F.when(c, n).otherwise(0)) / total * PCT
    extra = {"n_runs": total, "mean_bars": F.sum(x * n) / total, "min_bars": F.min(x), "max_bars": F.max(x),
             "pct_1bar": part(x == 1), "pct_2bar": part(x == 2), "pct_3bar": part(x == 3), "pct_le5": part(x <= 5), "pct_le10": part(x <= 10),
             "pct_gt1h": part(x > 1), "pct_gt2h": part(x > 2), "pct_gt4h": part(x > 4), "pct_gt8h": part(x > 8)}
    lengths = value_summary(runs, keys, "n_bars", {"median_bars": 0.5}, extra).drop("n_all")
    b = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars_total"), (F.max("pos") - F.min("pos")).alias("_span"))
    t = transitions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_transitions"))
    d = lengths.join(b, list(keys)).join(t, list(keys), "left").fillna(0, ["n_transitions"])
    days = F.greatest(F.col("_span"), F.lit(1)) / slots_per_day
    return d.withColumns({"per_1k_bars": F.col("n_transitions") / F.col("n_bars_total") * 1000,
                          "per_day": F.col("n_transitions") / days, "per_hour": F.col("n_transitions") / (days * 24)}).drop("_span")


def state_stats(rows: DataFrame, runs: DataFrame, keys=("series_id",)) -> DataFrame:
    """Per state: bars, share of bars, runs and run lengths, and the share of steps that stay."""
    k = [*keys, "state"]
    b = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("n_bars"))
    w = Window.partitionBy(*keys)
    b = b.withColumn("pct_bars", F.col("n_bars") / F.sum("n_bars").over(w) * PCT)
    x, n = F.col("duration_minutes"), F.col("n")
    r = value_summary(runs, k, "duration_minutes", {"median_minutes": 0.5}, {
        "n_runs": F.sum("n"), "mean_minutes": F.sum(x * n) / F.sum("n"), "max_minutes": F.max(x)}).drop("n_all")
    # every bar but a segment's last has a step to the next bar; the step stays if no run begins there
    last = runs.groupBy(*keys, "seg_start").agg(F.max_by("state", "run_start").alias("state")).groupBy(*k).agg(F.count(F.lit(1)).alias("_ends"))
    stay = rows.groupBy(*k).agg(F.count_if(~F.col("new_run")).alias("_stays")).join(last, k, "left")
    b = b.join(stay, k).withColumn("stay_prob", safe_div(F.col("_stays").cast("double"), F.col("n_bars") - F.coalesce("_ends", F.lit(0)))).drop("_stays", "_ends")
    return b.join(r, k, "left")


def occupancy(rows: DataFrame, keys) -> DataFrame:
    """Share of rows per state as a map, its largest share, distinct states and labels."""
    c = rows.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("n"), F.collect_set("regime").alias("labels"))
    return c.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("state", (F.col("n")).alias("n")))).alias("_m"), F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_states"), F.size(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("n_labels")).withColumn(
        "occupancy", F.transform_values("_m", lambda k, v: v / F.col("n_rows") * PCT)).withColumn(
        "max_share", F.array_max(F.map_values("occupancy"))).drop("_m")


def forward_stats(rows: DataFrame, keys, horizons: dict, big: float) -> DataFrame:
    """Per state and horizon: n, mean, median, population deviation and shares beyond 0 and +-big."""
    d = unpivot(rows, [*keys, "state"], horizons, "horizon", "r")
    r = F.col("r")
    return describe(d, [*keys, "state", "horizon"], "r", {"median": 0.5}, {
        "n": F.count(r), "mean": F.avg(r), "std": F.stddev_pop(r), "p_up": share(r > 0), "p_big_up": share(r > big),
        "p_big_down": share(r < -big)})


def return_summary(rows: DataFrame, keys, x: str) -> DataFrame:
    r = F.col(x)
    return describe(rows, keys, x, {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}, {
        "n": F.count(r), "mean": F.avg(r), "std": F.stddev_samp(r), "std_err": F.stddev_samp(r) / F.sqrt(F.count(r)),
        "pct_pos": share(r > 0), "pct_neg": share(r < 0), "mean_abs": F.avg(F.abs(r))})


def percentile_table(rows: DataFrame, keys, x: str) -> DataFrame:
    r = F.col(x)
    ps = {f"p{p}": p / 100 for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)}
    return describe(rows, keys, x, ps, {"n": F.count(r), "mean": F.avg(r), "min": F.min(r), "max": F.max(r),
                                        "pct_above": share(r > 0), "pct_below": share(r < 0)})


def next_row_pairs(rows: DataFrame, keys, cols, arrival=()) -> DataFrame:
    """Each row with columns of its successor under the key, gaps ignored."""
    nxt = F.struct(*[F.col(c).alias(f"to_{c}") for c in (*cols, *arrival)])
    d = running(rows, keys, ("pos",), reverse=True, nxt=("last", nxt, "before"))
    return d.filter("nxt IS NOT NULL").select(*keys, *[F.col(c).alias(f"from_{c}") for c in cols], "nxt.*")


def transition_category(a: str, b: str) -> Column:
    trend = lambda c: F.split(F.col(c), " / ")[0]
    moving = lambda c: trend(c).isin("Uptrend", "Downtrend")
    return (F.when(F.col(a) == F.col(b), "SAME_STATE").when(moving(a) & (trend(a) == trend(b)), "TREND_CONTINUATION")
            .when(moving(a) & (trend(b) == "Ranging"), "TREND_TO_RANGE").when((trend(a) == "Ranging") & moving(b), "RANGE_TO_TREND")
            .when(moving(a) & moving(b), "TREND_REVERSAL").otherwise("OTHER"))


def transition_matrix(rows: DataFrame, keys=("series_id",), state: str = "state", within_segment: bool = False) -> DataFrame:
    """Row-normalised counts of neighbour states; across gaps unless within_segment."""
    cols = (state, "seg_start") if within_segment else (state,)
    p = next_row_pairs(rows, keys, cols)
    if within_segment:
        p = p.filter("from_seg_start = to_seg_start")
    c = p.groupBy(*keys, F.col(f"from_{state}").alias("from_state"), F.col(f"to_{state}").alias("to_state")).agg(
        F.count(F.lit(1)).alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "from_state")))


def prev_next_context(runs: DataFrame) -> DataFrame:
    """Adds prev_state and next_state to runs: the nearest different state on each side.

    Neighbouring runs of equal state can only meet across a gap; the value found where such a block
    opens is carried through it. The run table is read several times: pass a staged one."""
    order = ("run_start",)

    def one_side(d, name, reverse):
        d = running(d, ("series_id",), order, reverse=reverse, _n=("last", "state", "before"))
        differs = F.when(F.col("_n") != F.col("state"), F.col("_n"))
        return running(d, ("series_id",), order, reverse=reverse, **{name: ("last", differs)}).drop("_n")

    return one_side(one_side(runs, "prev_state", False), "next_state", True)


def sample_tier(n, pos, neg, insufficient: int, reliable: int, few: int = 20, enough: int = 100) -> Column:
    n, pos, neg = F.col(n), F.col(pos), F.col(neg)
    return (F.when((n < insufficient) | (pos < few) | (neg < few), "INSUFFICIENT")
            .when((n < reliable) | (pos < enough) | (neg < enough), "LOW-CONFIDENCE").otherwise("RELIABLE"))


def segment_breakdown(rows: DataFrame, dims: dict[str, Column], buckets: dict[str, tuple[str, int]], insufficient: int = 200, reliable: int = 1000,
                      few: int = 20, enough: int = 100, fold_rows: int = 20) -> DataFrame:
    """Metrics of (label, score) per value of each dimension, all dimensions in the same jobs.

    dims are columns; buckets (name: column, number) are quantile buckets over all labelled rows, numbered from 0, equal edges merged. Values
    come as text, null is a value of its own. auc and average_precision are null below the lowest tier and with one label only; the fold columns
    are of folds with fold_rows rows and both labels. rows: fold, label, score and whatever the dimensions read; pass a staged frame."""
    base = rows.filter("label IS NOT NULL").withColumn("_all", F.lit(0))
    d = base
    for name, (x, n) in buckets.items():
        d = lookup(d, bucket_edges(base, ["_all"], x, n).select("_all", F.col("edges").alias(f"_e_{name}")), ["_all"])
        number = F.greatest(F.size(F.filter(f"_e_{name}", lambda e: e < F.col(x))) - 1, F.lit(0))
        dims = {**dims, name: F.when(F.col(x).isNotNull(), number)}
    pairs = F.array(*[F.struct(F.lit(k).alias("dim"), F.coalesce(c.cast("string"), F.lit("-")).alias("val")) for k, c in dims.items()])
    d = stage(d.select("fold", "label", "score", F.inline(pairs)))
    k = ["dim", "val"]
    count = F.count(F.lit(1))
    g = d.groupBy(*k).agg(count.alias("n"), (F.avg("label") * PCT).alias("rate"), F.avg("score").alias("mean_score"), F.count_if(F.col("label") == 1).alias("_p"),
                          F.count_if(F.col("label") == 0).alias("_q"), F.count_distinct("fold").alias("n_folds"))
    g = g.withColumn("tier", sample_tier("n", "_p", "_q", insufficient, reliable, few, enough))
    a = roc_auc(d, [*k, "fold"]).filter((F.col("n_pos") + F.col("n_neg") >= fold_rows) & F.col("auc").isNotNull())
    a = a.groupBy(*k).agg(F.avg("auc").alias("fold_auc_mean"), F.stddev_pop("auc").alias("fold_auc_std"), F.count_if(F.col("auc") > 0.5).alias("folds_above"),
                          F.count_if(F.col("auc") < 0.5).alias("folds_below"), count.alias("n_folds_with_auc"))
    g = g.join(roc_auc(d, k).select(*k, "auc"), k).join(average_precision(d, k).select(*k, "average_precision"), k).join(a, k, "left")
    fair = (F.col("tier") != "INSUFFICIENT") & F.col("auc").isNotNull()
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("folds_above", "folds_below", "n_folds_with_auc")}
    return g.withColumns({**zero, "average_precision": F.when(fair, F.col("average_precision")), "auc": F.when(fair, F.col("auc"))}).drop("_p", "_q")


def correlation_matrix(rows: DataFrame, cols) -> DataFrame:
    """Feature by feature correlations over rows where both are defined; all pairs in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"{a}|{b}").alias("r"))
             for a, b in pairs for x, y in ({(a, b), (b, a)})]
    return one.select(F.inline(F.array(*cells)))


def null_counts(rows: DataFrame, cols) -> DataFrame:
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col("n"), F.col(c).alias("n_null")) for c in cols])))


def fold_metric_summary(folds: DataFrame, keys, metric: str) -> DataFrame:
    """Fold values are few: built-in percentile is bounded here."""
    m = F.col(metric)
    return folds.groupBy(*keys).agg(
        F.count(m).alias("n_folds"), F.avg(m).alias("mean"), F.median(m).alias("median"), F.stddev_pop(m).alias("std"),
        F.count_if(m > 0.5).alias("above_50"), F.count_if(m > 0.52).alias("above_52"))


def fold_delta(a: DataFrame, b: DataFrame, keys, metric: str) -> DataFrame:
    """Per-fold difference of two models: wins, mean, median, sample deviation, extremes."""
    j = a.select(*keys, F.col(metric).alias("_a")).join(b.select(*keys, F.col(metric).alias("_b")), list(keys))
    d = F.col("_a") - F.col("_b")
    return j.agg(F.count(d).alias("n_folds"), F.count_if(d > 0).alias("wins"), F.avg(d).alias("mean"), F.median(d).alias("median"),
                 F.stddev_samp(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"), share(d > 0).alias("pct_positive"))


def bootstrap_auc(rows: DataFrame, keys, replicates: int, seed: int = 42) -> DataFrame:
    """Percentile interval of the AUC. Rows are first reduced to counts per distinct score and label; a
    resample then draws a Poisson count per cell (a sum of n Poisson(1) draws is Poisson(n)).

    Distinct scores are ordered once. A task reads its range of them with all replicates at once as vectors: positives, negatives and
    the pairs won inside the range. Ranges are joined pairwise in order (a later range's positives also win over all earlier negatives), many
    at a time, so what moves is three vectors a range whatever the number of scores. A cell's draws depend on key, score and seed
    alone, so neither ranges nor retries change them. Null scores don't count."""
    keys = list(keys)
    cells = score_cells(rows, keys)
    parts = over_ranges(cells, keys, lambda key, part: _cells_won(key, part, replicates, seed), _joined)
    won = F.filter(F.transform(F.arrays_zip("p", "q", "u"), lambda r: F.when((r["p"] > 0) & (r["q"] > 0), r["u"] / (r["p"] * r["q"]))), lambda v: v.isNotNull())
    auc = parts.select(*keys, F.array_sort(won).alias("_auc")).filter(F.size("_auc") > 0)
    n = F.size("_auc")

    def at_share(share):
        where = (n - 1) * share
        low = F.element_at("_auc", (F.floor(where) + 1).cast("int"))
        high = F.element_at("_auc", (F.ceil(where) + 1).cast("int"))
        return low + (high - low) * (where - F.floor(where))

    mean = F.aggregate("_auc", F.lit(0.0), lambda a, x: a + x) / n
    return auc.select(*keys, n.cast("long").alias("n_replicates"), mean.alias("mean_auc"), at_share(0.025).alias("lo"), at_share(0.975).alias("hi"))


CELLS = 512  # cells read at a time: as many rows of `replicates` numbers
RANGES = 64  # ranges joined by one task


def score_cells(rows: DataFrame, keys) -> DataFrame:
    """Positives p and negatives q of every distinct score, written."""
    return stage(rows.filter("label IS NOT NULL AND score IS NOT NULL").groupBy(*keys, F.col("score").cast("double").alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")))


def over_ranges(cells: DataFrame, keys, won, joined, order=("score",)) -> DataFrame:
    """One row per key with vectors p, q, u: won(key, cells in order) gives them for some cells, joined(low, high) for two neighbours.

    Cells are ordered once, by ranges; a task walks its range and gives one row per key. Neighbouring ranges are then joined, RANGES
    at a time, until one is left."""
    schema = T.StructType([*[cells.schema[k] for k in keys], T.StructField("at", T.LongType()), *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in "pqu"]])
    names = [f.name for f in schema]
    row = lambda key, at, state: pd.DataFrame([[*key, at, *[np.asarray(v, float).tolist() for v in state]]], columns=names)

    def ranges(batches):
        at, held, state = TaskContext.get().partitionId(), None, None
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]:
                if held is not None and not _same(key, held):
                    yield row(held, at, state)
                    state = None
                held = key
                for i in range(0, len(part), CELLS):
                    new = won(key, part.iloc[i:i + CELLS])
                    state = new if state is None else joined(state, new)
        if state is not None:
            yield row(held, at, state)

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state = pdf.sort_values("at", kind="stable"), None
        for vectors in zip(pdf["p"], pdf["q"], pdf["u"]):
            new = tuple(np.asarray(v, float) for v in vectors)
            state = new if state is None else joined(state, new)
        return row([pdf[k].iloc[0] for k in keys], int(pdf["at"].iloc[0]), state)

    parts = stage(cells.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInPandas(ranges, schema))
    most = parts.agg(F.max("at")).first()[0] or 0
    while most:
        parts = stage(parts.groupBy(*keys, F.floor(F.col("at") / RANGES)).applyInPandas(together, schema).withColumn("at", F.floor(F.col("at") / RANGES).cast("long")))
        most //= RANGES
    return parts


def pool_auc(rows: DataFrame) -> DataFrame:
    """fold, auc: of every fold the AUC of all rows of earlier folds, from rows with fold, label and score. Null where a class is missing.

    A pool's won pairs are those of its positives' and negatives' folds, so one matrix of won pairs by (fold of the positive, fold of the negative)
    serves all pools. It is summed in score order: a cell's positives win over the negatives seen so far, by fold. Rows are read and ordered
    once, no row is copied into later pools; a range gives folds x folds numbers."""
    spark = rows.sparkSession
    cells = score_cells(rows.select(F.col("fold").cast("long").alias("fold"), "label", "score"), ["fold"])
    folds = np.array([r[0] for r in cells.select("fold").distinct().orderBy("fold").collect()], np.int64)
    n = len(folds)
    if not n:
        return spark.createDataFrame([], "fold long, auc double")

    def won(_, part):
        f, p, q = np.searchsorted(folds, part["fold"].to_numpy()), part["p"].to_numpy(float), part["q"].to_numpy(float)
        own, cell = np.eye(n)[f], np.unique(part["score"].to_numpy(), return_inverse=True)[1]
        at = np.zeros((cell.max() + 1, 2, n))
        np.add.at(at, (cell, 0), own * p[:, None])
        np.add.at(at, (cell, 1), own * q[:, None])
        before = np.cumsum(at[:, 1], axis=0) - at[:, 1]
        return at[:, 0].sum(axis=0), at[:, 1].sum(axis=0), (at[:, 0].T @ (before + at[:, 1] / 2)).ravel()

    def joined(a, b):
        return a[0] + b[0], a[1] + b[1], a[2] + b[2] + np.outer(b[0], a[1]).ravel()

    def pools(batches):
        for pdf in batches:
            for p, q, u in zip(pdf["p"], pdf["q"], pdf["u"]):
                p, q, u = np.cumsum(p), np.cumsum(q), np.asarray(u, float).reshape(n, n)
                pairs = [u[:k, :k].sum() for k in range(1, n)]
                yield pd.DataFrame({"fold": folds[1:], "auc": [w / (p[k] * q[k]) if p[k] * q[k] > 0 else None for k, w in enumerate(pairs)]})

    # one cell may lie in two blocks of CELLS rows: cells of one score and several folds are rows of one group first
    grouped = cells.groupBy("score").agg(F.collect_list(F.struct("fold", "p", "q")).alias("c"))  # an entry per fold
    flat = lambda key, part: won(key, part.explode("c").assign(**{x: lambda d, x=x: d["c"].map(lambda c: c[x]) for x in ("fold", "p", "q")}))
    return over_ranges(grouped, [], flat, joined).mapInPandas(pools, "fold long, auc double")


def _same(a, b) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _joined(a, b):
    """Positives, negatives and pairs won of two ranges, the second with the higher scores."""
    return a[0] + b[0], a[1] + b[1], a[2] + b[2] + b[0] * a[1]


def draws(key, score: float, tag: str, count: int, replicates: int, seed: int) -> np.ndarray:
    """Poisson(count) for every replicate."""
    if not count:
        return np.zeros(replicates)
    raw = hashlib.blake2b(f"{key}|{score!r}|{tag}|{seed}".encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(raw, np.uint64))).poisson(count, replicates).astype(float)


def _cells_won(key, part: pd.DataFrame, replicates: int, seed: int):
    key = tuple(None if v != v else v.item() if hasattr(v, "item") else v for v in key)
    draw = lambda tag: np.array([draws(key, s, tag, n, replicates, seed) for s, n in zip(part["score"].tolist(), part[tag].tolist())])
    p, q = draw("p"), draw("q")
    before = np.cumsum(q, axis=0) - q
    return p.sum(axis=0), q.sum(axis=0), (p * (before + q / 2)).sum(axis=0)


def hash_uniform(*cols) -> Column:
    """A number in (0, 1) that depends only on its inputs."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def _poisson_steps(lam: int) -> list[float]:
    """Cumulative probabilities up to where the rest is below double precision."""
    p = c = math.exp(-lam)
    steps, k = [c], 0
    while c < 1 - 1e-15 and k < 80:
        k += 1
        p *= lam / k
        c += p
        steps.append(c)
    return steps


def poisson_one(u: Column) -> Column:
    draw = F.lit(0)
    for k, c in enumerate(_poisson_steps(1)):
        draw = F.when(u > c, k + 1).otherwise(draw)
    return draw


def poisson(lam: Column, u: Column, v: Column, part: int = 12) -> Column:
    """Poisson(lam) draw for whole lam, exact for every lam: the sum of draws for parts of 12 and the rest, each by inversion
    of a fixed table with a uniform number of its own. lam = 1, the usual case, is a plain comparison chain."""
    tables = F.array(*[F.array(*[F.lit(c) for c in _poisson_steps(i)]) for i in range(1, part + 1)])
    draw = lambda n, x: F.size(F.filter(F.element_at(tables, n), lambda c: c < x)).cast("long")
    whole, rest = F.floor(lam / part).cast("int"), F.pmod(lam, F.lit(part)).cast("int")
    many = F.when(whole > 0, F.aggregate(F.sequence(F.lit(1), whole), F.lit(0).cast("long"), lambda acc, i: acc + draw(F.lit(part), hash_uniform(u, v, i))))
    some = F.when(rest > 0, draw(rest, u))
    return F.when(lam == 1, poisson_one(u).cast("long")).otherwise(F.coalesce(many, F.lit(0)) + F.coalesce(some, F.lit(0))).cast("long")


def block_bootstrap(rows: DataFrame, keys, in_first: Column, x: str, block: int, replicates: int, seed: int = 42) -> DataFrame:
    """Interval of the difference of two group means, resampling blocks of `block` slots as wholes.

    Rows shrink to one line of sums per block first; a replicate weights each block by a Poisson draw."""
    d = rows.filter(F.col(x).isNotNull()).withColumn("_f", in_first).filter("_f IS NOT NULL")
    one, two = F.when(F.col("_f"), F.col(x)), F.when(~F.col("_f"), F.col(x))
    blocks = d.groupBy(*keys, F.floor(F.col("pos") / block).alias("_b")).agg(
        F.sum(one).alias("_s1"), F.count(one).alias("_n1"), F.sum(two).alias("_s2"), F.count(two).alias("_n2"))
    rep = blocks.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    w = poisson_one(hash_uniform("replicate", "_b", *keys, F.lit(seed)))
    rep = rep.withColumn("_w", w).filter("_w > 0")
    s = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("_w"))
    g = rep.groupBy(*keys, "replicate").agg(safe_div(s("_s1"), s("_n1")).alias("_m1"), safe_div(s("_s2"), s("_n2")).alias("_m2"))
    g = g.withColumn("diff", F.col("_m1") - F.col("_m2")).filter("diff IS NOT NULL")
    p = value_summary(g, keys, "diff", {"lo": 0.025, "hi": 0.975}, {"mean_diff": F.sum(F.col("diff") * F.col("n")) / F.sum("n")})
    return p.withColumnRenamed("n_all", "n_replicates").withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def state_kurtosis(rows: DataFrame, keys, cols) -> DataFrame:
    """Excess kurtosis (population) and the variance implied by the median absolute deviation, per feature."""
    d = unpivot(rows, keys, {c: c for c in cols}, "feature", "x").filter("x IS NOT NULL")
    k = [*keys, "feature"]
    med = percentiles(d, k, "x", {"med": 0.5}).drop("n_all")
    dev = lookup(d, med, k).withColumn("dev", F.abs(F.col("x") - F.col("med")))
    mad = percentiles(dev, k, "dev", {"mad": 0.5}).drop("n_all")
    g = d.groupBy(*k).agg(F.count("x").alias("n"), F.kurtosis("x").alias("excess_kurtosis"), F.var_pop("x").alias("variance"))
    robust = (F.col("mad") * 1.4826) ** 2
    return g.join(mad, k).withColumns({"mad_variance": robust, "variance_ratio": safe_div("variance", robust)})


def paired_tests(deltas: DataFrame, delta: str, order: str) -> DataFrame:
    """Paired t and signed-rank sum with two-sided p-values, wins and half means of per-fold differences (fold-sized input)."""
    d = deltas.filter(F.col(delta).isNotNull())
    nz = d.filter(F.col(delta) != 0).withColumn("_abs", F.abs(delta)).withColumn("_all", F.lit(0))
    r = ranked(nz, ["_all"], "_abs", {"n": F.count(F.lit(1)), "up": F.count_if(F.col(delta) > 0)})
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    ranks = F.flatten(F.collect_list(F.array_repeat(rank, F.col("n").cast("int"))))  # one per fold
    w = r.agg(ranks.alias("_ranks"), F.sum(rank * F.col("up")).alias("w_plus"), F.sum(rank * (F.col("n") - F.col("up"))).alias("w_minus"), F.lit(1).alias("_k"))
    half = d.agg(F.median(order).alias("_h"), F.lit(1).alias("_k"))
    x = F.col(delta)
    g = d.withColumn("_k", F.lit(1)).join(half, "_k").groupBy("_k").agg(
        F.count(x).alias("n"), F.count_if(x > 0).alias("wins"), F.avg(x).alias("mean"),
        safe_div(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x))).alias("t_stat"),
        F.avg(F.when(F.col(order) <= F.col("_h"), x)).alias("first_half"), F.avg(F.when(F.col(order) > F.col("_h"), x)).alias("second_half"))
    plus = F.coalesce(F.col("w_plus"), F.lit(0)).cast("double")
    return g.join(w, "_k").withColumns({"t_p": t_two_sided(F.col("t_stat"), F.col("n") - 1), "w_p": signed_rank_two_sided(F.col("_ranks").cast("array<double>"), plus)}).drop("_k", "_ranks")
