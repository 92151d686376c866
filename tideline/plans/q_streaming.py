"""The same operators as streams; each must give what its batch form gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.blocks import stage
from ..operators import features as ft
from ..streaming import bars as sbars, sources as ssrc, stateful
from . import inputs as inp
from .q_features import EMA_SQL
from .q_hmm import COLS, LATTICE, MODEL
from .q_resample import COARSE
from .registry import query

SLICES = ("2024-01-11", "2024-01-21")


def arriving(df, name):
    """Writes rows as time slices cut at SLICES, one file each, and streams them a file at a time. The first slice reaches back and the last one
    on without end, so that every row is in exactly one; rows without a time come first."""
    spark, path = df.sparkSession, ssrc.fresh(df.sparkSession, f"{name}-in")
    df = stage(df)
    later = F.lit(0)
    for cut in SLICES:
        later = later + F.coalesce((F.col("ts") >= F.lit(f"{cut} 00:00:00").cast("timestamp_ntz")).cast("int"), F.lit(0))
    for i in range(len(SLICES) + 1):
        df.filter(later == i).coalesce(1).write.mode("append").parquet(path)
    return ssrc.file_stream(spark, path, df.schema, 1)


@query("stream_resample", "series_id ts:t open:d high:d low:d close:d volume:d avg_price:d buy_vol:d",
       COARSE + "SELECT * FROM coarse WHERE ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM bars) - INTERVAL 2 HOUR")
def stream_resample(spark, folder):
    b = arriving(inp.bars(spark, folder), "bars")
    return ssrc.run_to_table(sbars.resample(b, 360, 60, "2 hours"), "coarse")


@query("stream_append_features", "series_id ts:t " + " ".join(f"{c}:d" for c in ft.BASE_FEATURES), "SELECT * FROM f2 WHERE close IS NOT NULL")
def stream_append_features(spark, folder):
    return sbars.append_features(arriving(inp.bars(spark, folder), "bars"), ft.build_features, ft.LOOKBACK)


@query("stream_running_duration", "series_id pos:l state:l duration:l", "SELECT * FROM valid")
def stream_running_duration(spark, folder):
    v = inp.valid_rows(spark, folder).select("series_id", "pos", "ts", "state")
    return ssrc.run_to_table(stateful.running_duration(arriving(v, "states")), "duration")


@query("stream_causal_decode", "series_id pos:l cstate:l a0:d a1:d a2:d", LATTICE + ";; SELECT * FROM cd")
def stream_causal_decode(spark, folder):
    v = inp.valid_rows(spark, folder).select("series_id", "pos", "ts", *COLS)
    d = ssrc.run_to_table(stateful.causal_decode(arriving(v, "decode"), COLS, MODEL), "decode")
    return d.withColumns({f"a{i}": F.element_at("cpost", i + 1) for i in range(3)})


@query("stream_ema", "series_id pos:l ema:d", EMA_SQL.rstrip().rstrip(",") + ";; SELECT *, ema_8 AS ema FROM em WHERE close IS NOT NULL")
def stream_ema(spark, folder):
    b = inp.bars(spark, folder).select("series_id", "pos", "ts", "close")
    out = ssrc.run_to_table(stateful.ema(arriving(b, "ema"), 8), "ema")
    return out.withColumn("ema", F.when(~F.isnan("ema"), F.col("ema")))
