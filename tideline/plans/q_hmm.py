"""Scaling, the sequence model, and what its states mean.

Decoding is checked with given parameters by a row-by-row recursive scan in SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.blocks import stage
from ..functions.lattice import Model
from ..operators import gaps, hmm, scaling as sc, states as ss, walk
from ..sources import stores
from ..sources.tables import table
from . import inputs as inp
from .registry import query

COLS = ("px_z", "ofi_z")
SEEDS = (1, 2, 3, 4, 5)
ANCHOR_EVERY = 2  # folds
START = (0.3, 0.4, 0.3)
TRANS = ((0.8, 0.15, 0.05), (0.1, 0.8, 0.1), (0.05, 0.15, 0.8))
MEAN = ((-0.9, -0.3), (0.0, 0.0), (0.9, 0.3))
VAR = ((0.5, 1.0), (0.4, 0.9), (0.5, 1.0))
MODEL = Model(np.array(START), np.array(TRANS), np.array(MEAN), np.array(VAR))


def _emit(j: int) -> str:
    terms = [f"({c} - ({MEAN[j][i]})) ^ 2 / {VAR[j][i]} + {math.log(2 * math.pi * VAR[j][i])!r}" for i, c in enumerate(COLS)]
    return f"-0.5 * ({' + '.join(terms)})"


def _into(j: int, v: str) -> str:
    return f"CASE WHEN h.new_segment THEN {START[j]} ELSE " + " + ".join(f"p.{v}{i} * {TRANS[i][j]}" for i in range(3)) + " END"


def _best(j: int) -> str:
    return (f"CASE WHEN h.new_segment THEN {math.log(START[j])!r} ELSE greatest("
            + ", ".join(f"p.d{i} + ({math.log(TRANS[i][j])!r})" for i in range(3)) + f") END + h.e{j}")


LATTICE = f"""
hx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY series_id) AS nn,
 {_emit(0)} AS e0, {_emit(1)} AS e1, {_emit(2)} AS e2 FROM valid),
fw AS (
 SELECT series_id, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS a0, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2, 0.0::DOUBLE AS d0, 0.0::DOUBLE AS d1, 0.0::DOUBLE AS d2, 0.0::DOUBLE AS gain
 FROM (SELECT DISTINCT series_id FROM hx)
 UNION ALL
 SELECT series_id, n, r0 / (r0 + r1 + r2), r1 / (r0 + r1 + r2), r2 / (r0 + r1 + r2), q0 - greatest(q0, q1, q2), q1 - greatest(q0, q1, q2), q2 - greatest(q0, q1, q2), ln(r0 + r1 + r2) FROM (
  SELECT h.series_id, h.n, ({_into(0, 'a')}) * exp(h.e0) AS r0, ({_into(1, 'a')}) * exp(h.e1) AS r1, ({_into(2, 'a')}) * exp(h.e2) AS r2,
   {_best(0)} AS q0, {_best(1)} AS q1, {_best(2)} AS q2
  FROM fw p JOIN hx h ON h.series_id = p.series_id AND h.n = p.n + 1)),
cd AS (
 SELECT h.*, f.a0, f.a1, f.a2, f.gain, f.d0, f.d1, f.d2, CASE WHEN f.d0 >= greatest(f.d1, f.d2) THEN 0 WHEN f.d1 >= f.d2 THEN 1 ELSE 2 END AS cstate
 FROM fw f JOIN hx h ON h.series_id = f.series_id AND h.n = f.n)"""
READ = LATTICE + """,
cr AS (SELECT *, CASE cstate WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END AS conf,
 greatest(a0, a1, a2) - (a0 + a1 + a2 - greatest(a0, a1, a2) - least(a0, a1, a2)) AS marg,
 CASE WHEN new_segment OR cstate <> lag(cstate) OVER (PARTITION BY series_id ORDER BY n) THEN n END AS chg FROM cd),
cq AS (SELECT *, n - max(chg) OVER (PARTITION BY series_id ORDER BY n) + 1 AS cdur FROM cr)
"""
BACKWARD = LATTICE + f""",
bw AS (
 SELECT series_id, nn AS n, 1.0 / 3 AS b0, 1.0 / 3 AS b1, 1.0 / 3 AS b2 FROM hx WHERE n = nn
 UNION ALL
 SELECT series_id, n, r0 / (r0 + r1 + r2), r1 / (r0 + r1 + r2), r2 / (r0 + r1 + r2) FROM (
  SELECT h.series_id, h.n - 1 AS n, {", ".join(
      "CASE WHEN h.new_segment THEN 1.0 ELSE " + " + ".join(f"{TRANS[i][j]} * exp(h.e{j}) * p.b{j}" for j in range(3)) + f" END AS r{i}" for i in range(3))}
  FROM bw p JOIN hx h ON h.series_id = p.series_id AND h.n = p.n WHERE h.n > 1)),
sp AS (SELECT c.*, a0 * b0 / (a0 * b0 + a1 * b1 + a2 * b2) AS g0, a1 * b1 / (a0 * b0 + a1 * b1 + a2 * b2) AS g1, a2 * b2 / (a0 * b0 + a1 * b1 + a2 * b2) AS g2
 FROM cd c JOIN bw b ON b.series_id = c.series_id AND b.n = c.n)
"""


def _pick(s):
    xs = [f"c.d{i} + CASE p.vstate " + " ".join(f"WHEN {j} THEN ({math.log(TRANS[i][j])!r})" for j in range(3)) + " END" for i in range(3)]
    return xs[s]


VITERBI = LATTICE + f""",
vt AS (
 SELECT series_id, n, cstate AS vstate FROM cd WHERE n = nn
 UNION ALL
 SELECT series_id, n, CASE WHEN x0 >= greatest(x1, x2) THEN 0 WHEN x1 >= x2 THEN 1 ELSE 2 END FROM (
  SELECT c.series_id, c.n, CASE WHEN h.new_segment THEN c.d0 ELSE {_pick(0)} END AS x0, CASE WHEN h.new_segment THEN c.d1 ELSE {_pick(1)} END AS x1,
   CASE WHEN h.new_segment THEN c.d2 ELSE {_pick(2)} END AS x2
  FROM vt p JOIN cd c ON c.series_id = p.series_id AND c.n = p.n - 1 JOIN hx h ON h.series_id = p.series_id AND h.n = p.n))
"""


def _valid(spark, folder):
    return inp.valid_rows(spark, folder)


def _post(d, name, prefix):
    return d.withColumns({f"{prefix}{i}": F.element_at(name, i + 1) for i in range(3)})


def decoded(spark, folder, want=("causal",), source=None):
    """Decoded rows with their time; the valid rows are written once and read for both."""
    v = stage(inp.valid_rows(spark, folder, source=source))
    return hmm.decode(v, COLS, MODEL, want).join(v.select("series_id", "pos", "ts"), ["series_id", "pos"])


@query("hmm_decode_causal", "series_id ts:t cstate:l a0:d a1:d a2:d", LATTICE + ";; SELECT * FROM cd")
def hmm_decode_causal(spark, folder):
    return _post(decoded(spark, folder), "cpost", "a")


@query("hmm_posterior", "series_id ts:t g0:d g1:d g2:d", BACKWARD + ";; SELECT * FROM sp")
def hmm_posterior(spark, folder):
    return _post(decoded(spark, folder, ("smooth",)), "spost", "g")


@query("hmm_viterbi", "series_id ts:t vstate:l", VITERBI + ";; SELECT v.series_id, h.ts, v.vstate FROM vt v JOIN hx h ON h.series_id = v.series_id AND h.n = v.n")
def hmm_viterbi(spark, folder):
    return decoded(spark, folder, ("path",))


@query("hmm_decode_smooth", "series_id ts:t vstate:l conf:d", BACKWARD + "," + VITERBI[len(LATTICE) + 1:] + """;;
SELECT s.series_id, s.ts, v.vstate, CASE v.vstate WHEN 0 THEN g0 WHEN 1 THEN g1 ELSE g2 END AS conf FROM sp s JOIN vt v ON v.series_id = s.series_id AND v.n = s.n""")
def hmm_decode_smooth(spark, folder):
    """Best path with its smoothed probability; sees the whole segment, unlike the causal read."""
    return decoded(spark, folder, ("path", "smooth")).withColumn("conf", hmm.confidence("spost", "vstate"))


@query("hmm_score", "series_id n:l ll:d ll_per_row:d", LATTICE + ";; SELECT series_id, count(*) AS n, sum(gain) AS ll, avg(gain) AS ll_per_row FROM cd GROUP BY 1")
def hmm_score(spark, folder):
    return hmm.decode(_valid(spark, folder), COLS, MODEL, ("score",)).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gain").alias("ll"), F.avg("gain").alias("ll_per_row"))


@query("bic", "series_id n:l bic:d", LATTICE + ";; SELECT series_id, count(*) AS n, -2 * sum(gain) + 21 * ln(count(*)) AS bic FROM cd GROUP BY 1")
def bic(spark, folder):
    s = hmm.decode(_valid(spark, folder), COLS, MODEL, ("score",)).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("gain").alias("ll"))
    return s.withColumn("bic", ss.bic("ll", "n", 3, 2))


@query("hmm_decode_window", "series_id ts:t cstate:l a0:d a1:d a2:d", LATTICE + ";; SELECT * FROM cd")
def hmm_decode_window(spark, folder):
    """Windows of up to 500 rows; every segment here is shorter, so the result is the one-pass read."""
    v = stage(_valid(spark, folder))
    return _post(hmm.decode_windows(v, COLS, MODEL, 500), "cpost", "a").join(v.select("series_id", "pos", "ts"), ["series_id", "pos"])


@query("decode_agreement", "n:l state_mismatch:l post_mismatch:l", "SELECT count(*) AS n, 0 AS state_mismatch, 0 AS post_mismatch FROM valid")
def decode_agreement(spark, folder):
    v = stage(_valid(spark, folder))
    a = hmm.decode(v, COLS, MODEL)
    b = hmm.decode_windows(v, COLS, MODEL, 500).withColumnsRenamed({"cstate": "wstate", "cpost": "wpost"})
    far = F.exists(F.arrays_zip("cpost", "wpost"), lambda p: F.abs(p["cpost"] - p["wpost"]) > 1e-3)
    return a.join(b, ["series_id", "pos"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cstate") != F.col("wstate")).alias("state_mismatch"),
                                               F.count_if(far).alias("post_mismatch"))


@query("confidence", "series_id ts:t cstate:l conf:d", READ + ";; SELECT * FROM cq")
def confidence(spark, folder):
    return decoded(spark, folder).withColumn("conf", hmm.confidence())


@query("margin", "series_id ts:t marg:d", READ + ";; SELECT * FROM cq")
def margin(spark, folder):
    return decoded(spark, folder).withColumn("marg", hmm.margin())


@query("stay_prob", "series_id ts:t stay:d", READ + ";; SELECT *, CASE cstate WHEN 0 THEN 0.8 WHEN 1 THEN 0.8 ELSE 0.8 END AS stay FROM cq")
def stay_prob(spark, folder):
    return decoded(spark, folder).withColumn("stay", hmm.stay_prob(MODEL))


def decoded_duration(spark, folder):
    d = stage(decoded(spark, folder))
    return gaps.mark_runs(d, "cstate").withColumn("cdur", gaps.running_duration(None))


@query("duration_log1p", "series_id ts:t cdur:l log_duration:d", READ + ";; SELECT *, ln(1 + cdur) AS log_duration FROM cq")
def duration_log1p(spark, folder):
    return decoded_duration(spark, folder).withColumn("log_duration", F.log1p("cdur"))


@query("gate_features", "series_id ts:t conf:d stay:d log_duration:d marg:d censored:b", READ + """;;
SELECT series_id, ts, conf, 0.8 AS stay, ln(1 + cdur) AS log_duration, marg, n - cdur + 1 = max(CASE WHEN new_segment THEN n END) OVER (PARTITION BY series_id ORDER BY n) AS censored
FROM cq QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC) = 1""")
def gate_features(spark, folder):
    d = decoded_duration(spark, folder)
    last = d.groupBy("series_id").agg(F.max_by(F.struct("ts", "cstate", "cpost", "cdur", "run_start", "seg_start"), "pos").alias("r")).select("series_id", "r.*")
    return last.select("series_id", "ts", hmm.confidence().alias("conf"), hmm.stay_prob(MODEL).alias("stay"), F.log1p("cdur").alias("log_duration"),
                       hmm.margin().alias("marg"), gaps.left_censored().alias("censored"))


@query("current_state", "series_id ts:t available:b cstate:l conf:d", READ + """,
lb AS (SELECT series_id, max(pos) AS pos, max(ts) AS ts FROM bars GROUP BY 1)
;;
SELECT l.series_id, l.ts, c.pos IS NOT NULL AS available, c.cstate, c.conf FROM lb l LEFT JOIN cq c ON c.series_id = l.series_id AND c.pos = l.pos""")
def current_state(spark, folder):
    """Latest bar's state; not available when that bar is invalid."""
    b = inp.bar_table(spark, folder)
    latest = b.groupBy("series_id").agg(F.max("pos").alias("pos"), F.max("ts").alias("ts"))
    d = decoded(spark, folder, source=b).drop("ts")
    return latest.join(d, ["series_id", "pos"], "left").withColumns({"available": F.col("cstate").isNotNull(), "conf": hmm.confidence()})


@query("hmm_fit", "model_id state:l start:d m0:d m1:d v0:d v1:d")
def hmm_fit(spark, folder):
    m, _ = hmm.fit(stage(_valid(spark, folder)), COLS, 3, seeds=SEEDS, max_iter=100)
    t = hmm.model_table(spark, "hourly_3", m)
    return t.withColumns({"m0": F.element_at("mean", 1), "m1": F.element_at("mean", 2), "v0": F.element_at("var", 1), "v1": F.element_at("var", 2)})


@query("hmm_restarts", "seed:l ll:d n_iter:l converged:b best:b")
def hmm_restarts(spark, folder):
    _, log = hmm.fit(stage(_valid(spark, folder)), COLS, 3, seeds=SEEDS, max_iter=100)
    return hmm.log_table(spark, log)


@query("restart_log", "model_id seed:l ll:d n_iter:l converged:b error best:b")
def restart_log(spark, folder):
    """The log as a table partitioned by model, one append per fit."""
    v = stage(_valid(spark, folder))
    path = stores.table_path(spark, "restart-log")
    for k in (2, 3):
        _, log = hmm.fit(v, COLS, k, seeds=SEEDS, max_iter=100)
        hmm.log_table(spark, log).withColumn("model_id", F.lit(f"hourly_{k}")).write.mode("append").partitionBy("model_id").parquet(path)
    return spark.read.parquet(path)


@query("anchor_decode", "series_id ts:t anchor:l cstate:l a0:d")
def anchor_decode(spark, folder):
    """All test weeks decoded in one pass, each by the model of its latest anchor week.

    An anchor's model has moments of the threshold states on rows before it."""
    rows = stage(_valid(spark, folder))
    v = rows.filter("fold >= 0").withColumn("anchor", (F.col("fold") - F.pmod("fold", F.lit(ANCHOR_EVERY))).cast("long"))
    anchors = [x[0] for x in v.select("anchor").distinct().orderBy("anchor").collect()]
    models = {a: walk.moment_model(rows.filter(F.col("fold") < a), COLS, MODEL) for a in anchors}
    d = hmm.decode(v, COLS, models, keys=("series_id", "anchor"))
    return _post(d, "cpost", "a").join(v.select("series_id", "pos", "ts"), ["series_id", "pos"])


# scaling

SCALE = """
sk AS (SELECT series_id, avg(ret_1) AS rm, stddev_pop(ret_1) AS rs, avg(volume) AS vm, stddev_pop(volume) AS vs FROM valid WHERE ts < TIMESTAMP '2024-01-22' GROUP BY 1)
;;
"""


def _train(v):
    return v.filter("ts < TIMESTAMP_NTZ'2024-01-22 00:00:00'")


@query("scaler_fit", "series_id rm:d rs:d vm:d vs:d", SCALE + "SELECT * FROM sk")
def scaler_fit(spark, folder):
    return sc.scaler_fit(_train(_valid(spark, folder)), ("ret_1", "volume")).toDF("series_id", "rm", "rs", "vm", "vs")


@query("scaler_apply", "series_id ts:t ret_1:d volume:d", SCALE + "SELECT v.series_id, v.ts, (ret_1 - rm) / rs AS ret_1, (volume - vm) / vs AS volume FROM valid v JOIN sk USING (series_id)")
def scaler_apply(spark, folder):
    v = stage(_valid(spark, folder).select("series_id", "ts", "ret_1", "volume"))
    return sc.scaler_apply(v, sc.scaler_fit(_train(v), ("ret_1", "volume")), ("ret_1", "volume"))


@query("scaler_embeddings", "label:l dim:l n:l mean:d sd:d", """
SELECT label, i AS dim, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2""")
def scaler_embeddings(spark, folder):
    """Mean and population deviation per label and dimension of a wide feature matrix."""
    e = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", (F.col("i") + 1).alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))


@query("expanding_scalers", "series_id fold:l n_train:l ret_1_mean:d ret_1_sd:d volume_mean:d volume_sd:d", """
SELECT f.series_id, f.fold, count(*) AS n_train, avg(v.ret_1) AS ret_1_mean, stddev_pop(v.ret_1) AS ret_1_sd, avg(v.volume) AS volume_mean, stddev_pop(v.volume) AS volume_sd
FROM (SELECT DISTINCT series_id, fold FROM valid) f JOIN valid v ON v.series_id = f.series_id AND v.fold < f.fold GROUP BY 1, 2""")
def expanding_scalers(spark, folder):
    return sc.expanding_scalers(stage(_valid(spark, folder)), ("ret_1", "volume"))


# state meaning: profiles of the threshold states per fold, from columns scaled per series

PROFILE = """
zz AS (SELECT series_id, pos, fold, state, (ret_1 - avg(ret_1) OVER s) / stddev_pop(ret_1) OVER s AS a, (ret_2 - avg(ret_2) OVER s) / stddev_pop(ret_2) OVER s AS b,
 (vol_4 - avg(vol_4) OVER s) / stddev_pop(vol_4) OVER s AS c, (vol_6 - avg(vol_6) OVER s) / stddev_pop(vol_6) OVER s AS d FROM valid WINDOW s AS (PARTITION BY series_id)),
pf AS (SELECT series_id, fold, state, (avg(a) + avg(b)) / 2 AS trend_score, (avg(c) + avg(d)) / 2 AS vol_score FROM zz GROUP BY 1, 2, 3),
pl AS (SELECT *, CASE WHEN trend_score > 0.3 THEN 'Uptrend' WHEN trend_score < -0.3 THEN 'Downtrend' ELSE 'Ranging' END || ' / '
 || CASE WHEN vol_score > 0.3 THEN 'High-Vol' WHEN vol_score < -0.3 THEN 'Low-Vol' ELSE 'Mid-Vol' END AS label FROM pf)
;;
"""


def _profiles(spark, folder):
    v = stage(_valid(spark, folder).select("series_id", "pos", "fold", "state", "ret_1", "ret_2", "vol_4", "vol_6"))
    cols = ("ret_1", "ret_2", "vol_4", "vol_6")
    return ss.profile(sc.scaler_apply(v, sc.scaler_fit(v, cols), cols), ("series_id", "fold"), cols[:2], cols[2:])


@query("state_profile", "series_id fold:l state:l trend_score:d vol_score:d", PROFILE + "SELECT * FROM pl")
def state_profile(spark, folder):
    return _profiles(spark, folder)


@query("state_label", "series_id fold:l state:l label", PROFILE + "SELECT * FROM pl")
def state_label(spark, folder):
    return _profiles(spark, folder).withColumn("label", ss.label())


@query("trend_sign", "series_id fold:l state:l sgn:l", PROFILE + "SELECT *, sign(trend_score) AS sgn FROM pl")
def trend_sign(spark, folder):
    return _profiles(spark, folder).withColumn("sgn", ss.trend_sign())


@query("is_trending", "series_id fold:l state:l trending:b", PROFILE + "SELECT *, abs(trend_score) > 0.3 AS trending FROM pl")
def is_trending(spark, folder):
    return _profiles(spark, folder).withColumn("trending", ss.is_trending())


CUTS = (0.15, 0.3, 0.5, 0.8)
TC = PROFILE.replace(";;", ",") + """
tc AS (SELECT series_id, fold, cut, count(*) FILTER (WHERE trend_score > cut) AS n_up, count(*) FILTER (WHERE trend_score < -cut) AS n_down,
 count(*) FILTER (WHERE abs(trend_score) <= cut) AS n_ranging, count(*) FILTER (WHERE abs(trend_score) > cut) = 0 AS zero_eligible
 FROM pl, (SELECT unnest([0.15, 0.3, 0.5, 0.8]) AS cut) GROUP BY 1, 2, 3)
;;
"""


@query("threshold_classify", "series_id fold:l cut:d n_up:l n_down:l n_ranging:l zero_eligible:b", TC + "SELECT * FROM tc")
def threshold_classify(spark, folder):
    return ss.threshold_classify(_profiles(spark, folder), ("series_id", "fold"), CUTS)


@query("threshold_recovery", "series_id fold:l recovered_at:d", TC + "SELECT series_id, fold, max(cut) FILTER (WHERE NOT zero_eligible) AS recovered_at FROM tc GROUP BY 1, 2")
def threshold_recovery(spark, folder):
    k = ("series_id", "fold")
    return ss.recovering_threshold(ss.threshold_classify(_profiles(spark, folder), k, CUTS), k)


@query("adaptive_threshold", "series_id fold:l none_trending:b threshold:d", PROFILE + """
SELECT series_id, fold, count(*) FILTER (WHERE abs(trend_score) > 0.9) = 0 AS none_trending, CASE WHEN count(*) FILTER (WHERE abs(trend_score) > 0.9) = 0 THEN 0.15 ELSE 0.9 END AS threshold FROM pl GROUP BY 1, 2""")
def adaptive_threshold(spark, folder):
    return ss.adaptive_threshold(_profiles(spark, folder), ("series_id", "fold"), normal=0.9)


@query("state_scores_wide", "series_id fold:l score_0:d score_1:d score_2:d score_3:d", PROFILE + """
SELECT series_id, fold, max(trend_score) FILTER (WHERE state = 0) AS score_0, max(trend_score) FILTER (WHERE state = 1) AS score_1,
 max(trend_score) FILTER (WHERE state = 2) AS score_2, CAST(NULL AS DOUBLE) AS score_3 FROM pl GROUP BY 1, 2""")
def state_scores_wide(spark, folder):
    return ss.scores_wide(_profiles(spark, folder), ("series_id", "fold"), 4)


RLOG = """
rl AS (SELECT event_type AS series_id, user_id % 5 AS seed, CASE WHEN sum(value) % 11 < 1 THEN NULL ELSE -round(sum(value), 2) END AS ll, count(*) % 3 <> 0 AS converged FROM events GROUP BY 1, 2),
rs AS (SELECT series_id, count(*) AS n_restarts, max(ll) AS best_ll, max(ll) - min(ll) AS spread, (max(ll) - min(ll)) / abs(max(ll)) AS spread_normalized,
 count(*) FILTER (WHERE ll IS NOT NULL AND converged) AS n_converged, count(*) FILTER (WHERE ll IS NULL) AS n_failed FROM rl GROUP BY 1)
"""


def _log_like(spark, folder):
    """A restart log in shape, with values summed from the event table (a real one comes from a fit)."""
    g = table(spark, folder, "events").groupBy(F.col("event_type").alias("series_id"), (F.col("user_id") % 5).alias("seed")).agg(
        F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    bad = F.col("s") % 11 < 1
    return g.select("series_id", "seed", F.when(~bad, -F.round("s", 2)).alias("ll"), (F.col("n") % 3 != 0).alias("converged"),
                    F.when(bad, F.lit("failed")).alias("error"))


@query("restart_spread", "series_id n_restarts:l best_ll:d spread:d spread_normalized:d n_converged:l n_failed:l", RLOG + ";; SELECT * FROM rs")
def restart_spread(spark, folder):
    return ss.restart_spread(_log_like(spark, folder), ("series_id",))


@query("fit_health_flags", "series_id fold:l flags", RLOG + """,
ps AS (SELECT series_id, fold, state, count(*) AS n, least(var_pop(ret_1), var_pop(vol_6)) AS v FROM valid GROUP BY 1, 2, 3),
pt AS (SELECT series_id, fold, bool_or(regime LIKE 'Uptrend%') AS up, bool_or(regime LIKE 'Downtrend%') AS dn, bool_or(regime LIKE 'Ranging%') AS rg FROM valid GROUP BY 1, 2),
pg AS (SELECT series_id, fold, max(n) / sum(n) AS mx, count(*) AS seen, min(v) AS v FROM ps GROUP BY 1, 2)
;;
SELECT g.series_id, g.fold, array_to_string(list_filter([CASE WHEN mx > 0.95 THEN 'one_state_domination' END, CASE WHEN seen < 3 THEN 'missing_states' END,
 CASE WHEN n_failed > 0 THEN 'restart_failures' END, CASE WHEN n_converged < n_restarts THEN 'non_converged_restarts' END, CASE WHEN v < 0.3 THEN 'covariance_collapse' END,
 CASE WHEN NOT up THEN 'no_uptrend_state' END, CASE WHEN NOT dn THEN 'no_downtrend_state' END, CASE WHEN NOT rg THEN 'no_ranging_state' END], lambda x: x IS NOT NULL), ';') AS flags
FROM pg g JOIN pt USING (series_id, fold) JOIN rs USING (series_id)""")
def fit_health_flags(spark, folder):
    v = stage(_valid(spark, folder))
    log = ss.restart_spread(_log_like(spark, folder), ("series_id",)).select("series_id", "n_restarts", "n_converged", "n_failed")
    folds = v.select("series_id", "fold").distinct().join(log, "series_id")
    h = ss.health_flags(v, folds, ("series_id", "fold"), 3, ("ret_1", "vol_6"), floor=0.3)
    return h.withColumn("flags", F.array_join("flags", ";"))


