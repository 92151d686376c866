"""Windows over series of any length without putting a whole series in one task.

A series is cut into chunks of consecutive slots; the window partition is (key, chunk).

* ``over_chunks`` serves frames of bounded width. Each chunk also receives the neighbouring
  rows its frames can reach (the halo); copies are dropped afterwards. One shuffle.
* ``running`` serves unbounded frames (running sum, last non-null). Each chunk is summarised
  to one row, the summaries are scanned per key, and the value carried into a chunk is joined
  back. The only per-key window is over one row per chunk.

Both give exactly what the plain ``Window.partitionBy(key)`` gives.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .columns import col

CHUNK = 16_384


def chunk_of(pos="pos", size: int | None = None) -> Column:
    return F.floor(col(pos) / F.lit(size or CHUNK)).cast("long")


def halo(df: DataFrame, before: int, after: int = 0, size: int | None = None, pos: str = "pos") -> DataFrame:
    """Adds _chunk (where a copy goes) and _home (where the row belongs)."""
    size = max(size or CHUNK, before, after)
    home, at = chunk_of(pos, size), F.pmod(F.col(pos), F.lit(size))
    copies = [home]
    if before:
        copies.append(F.when(at >= size - before, home + 1))
    if after:
        copies.append(F.when(at < after, home - 1))
    return df.withColumn("_home", home).withColumn("_chunk", F.explode(F.array_compact(F.array(*copies))))


def over_chunks(df, keys, fn, before: int = 0, after: int = 0, size: int | None = None, pos: str = "pos"):
    """fn(rows, w) adds columns using w; before / after are the slots all its frames reach in total."""
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    out = fn(halo(df, before, after, size, pos), w)
    return out.filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")


def running(df, keys, order=("pos",), chunk: Column | None = None, reverse: bool = False, **specs) -> DataFrame:
    """Unbounded running values. specs: name=(kind, column[, "before"]).

    kind is sum, first / last (non-null), max, min, or total (over the whole key). "before"
    leaves the current row out. ``chunk`` must not decrease along ``order``; ``reverse``
    scans from the end, so that "last" is the nearest following value.
    """
    keys, order = list(keys), list(order)
    chunk = chunk_of(order[0]) if chunk is None else chunk
    src = {n: f"_v_{n}" for n in specs}
    rows = df.withColumn("_chunk", chunk).withColumns({src[n]: col(s[1]) for n, s in specs.items()})
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    pick = F.min_by if reverse else F.max_by
    fold = {"sum": F.sum, "total": F.sum, "max": F.max, "min": F.min}

    aggs, carried = [], []
    step = F.col("_chunk").desc() if reverse else F.col("_chunk")
    earlier = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    for n, s in specs.items():
        x = F.col(src[n])
        if s[0] == "first":
            aggs.append((F.max_by if reverse else F.min_by)(x, F.when(x.isNotNull(), rank)).alias(src[n]))
            carried.append(F.first(src[n], ignorenulls=True).over(earlier).alias(f"_c_{n}"))
        elif s[0] == "last":
            aggs.append(pick(x, F.when(x.isNotNull(), rank)).alias(src[n]))
            carried.append(F.last(src[n], ignorenulls=True).over(earlier).alias(f"_c_{n}"))
        else:
            aggs.append(fold[s[0]](x).alias(src[n]))
            carried.append(fold[s[0]](src[n]).over(whole if s[0] == "total" else earlier).alias(f"_c_{n}"))
    carry = rows.groupBy(*keys, "_chunk").agg(*aggs).select(*keys, "_chunk", *carried)

    w = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(o).desc() if reverse else F.col(o) for o in order])
    new = {}
    for n, s in specs.items():
        x, c = F.col(src[n]), F.col(f"_c_{n}")
        frame = w.rowsBetween(Window.unboundedPreceding, -1 if len(s) > 2 else 0)
        if s[0] == "total":
            new[n] = c
        elif s[0] == "first":
            new[n] = F.coalesce(c, F.first(x, ignorenulls=True).over(frame))
        elif s[0] == "last":
            new[n] = F.coalesce(F.last(x, ignorenulls=True).over(frame), c)
        elif s[0] == "sum":
            new[n] = F.coalesce(F.sum(x).over(frame), F.lit(0)) + F.coalesce(c, F.lit(0))
        else:
            both = F.greatest if s[0] == "max" else F.least
            new[n] = both(fold[s[0]](x).over(frame), c)
    out = rows.join(carry, [*keys, "_chunk"], "left").withColumns(new)
    return out.drop("_chunk", *src.values(), *[f"_c_{n}" for n in specs])


def running_since(df, keys, reset, order: str = "pos", chunk: Column | None = None, **sums) -> DataFrame:
    """Running sums (name=column) that start anew at every row where ``reset`` is true; that row's value counts. Nulls add nothing.

    No sum reaches over a reset: a chunk is summarised by its sum behind its last reset, summaries are added up from the last
    chunk with a reset on, and what is carried into a chunk reaches to its first reset. So a segment's sums carry no rounding of
    what went before it."""
    keys = list(keys)
    chunk = chunk_of(order) if chunk is None else chunk
    rows = df.withColumn("_chunk", chunk).withColumn("_cut", F.coalesce(col(reset), F.lit(False)).cast("long"))
    rows = rows.withColumns({f"_v_{n}": F.coalesce(col(c), F.lit(0.0)) for n, c in sums.items()})
    rows = rows.withColumn("_part", F.sum("_cut").over(Window.partitionBy(*keys, "_chunk").orderBy(order)))
    parts = rows.groupBy(*keys, "_chunk", "_part").agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums])
    ends = parts.groupBy(*keys, "_chunk").agg(F.max("_part").alias("_cuts"), *[F.max_by(f"_v_{n}", "_part").alias(f"_v_{n}") for n in sums])
    by = Window.partitionBy(*keys).orderBy("_chunk")
    ends = ends.withColumn("_run", F.sum((F.col("_cuts") > 0).cast("long")).over(by))
    since = Window.partitionBy(*keys, "_run").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumns({f"_o_{n}": F.sum(f"_v_{n}").over(since) for n in sums})
    carry = ends.select(*keys, "_chunk", *[F.lag(f"_o_{n}").over(by).alias(f"_c_{n}") for n in sums])
    w = Window.partitionBy(*keys, "_chunk", "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = {n: F.when(F.col("_part") == 0, F.coalesce(F.col(f"_c_{n}"), F.lit(0.0))).otherwise(0.0) for n in sums}
    out = rows.join(carry, [*keys, "_chunk"], "left").withColumns({n: F.sum(f"_v_{n}").over(w) + carried[n] for n in sums})
    return out.drop("_chunk", "_cut", "_part", *[f"_v_{n}" for n in sums], *[f"_c_{n}" for n in sums])


def with_position(df, keys, order, chunk: Column, name: str = "row_pos") -> DataFrame:
    """Dense 0-based row number per key, in order."""
    return running(df, keys, order, chunk, **{name: ("sum", F.lit(1).cast("long"), "before")})


def work_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster. Only a local session may go without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors,
    and keeps column pruning and pushdown for whatever reads it next. ``by`` lays the files out by a column with few
    values, so that a filter on it reads only what it needs."""
    path = os.path.join(work_dir(df.sparkSession), "tideline", uuid.uuid4().hex)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


LOOKUP_BYTES = 32 << 20


def staged_bytes(df: DataFrame) -> int:
    """Size of the files behind a staged table, asked of the file system that holds them."""
    spark = df.sparkSession
    conf, total = spark._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def lookup(df: DataFrame, small: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Joins a table of per-key values to a big one. The values are written first, so their size is known:
    a small file is broadcast and the big side is not shuffled; a large one takes a shuffle join, where adaptive
    execution splits partitions that hold a hot key."""
    small = stage(small)
    return df.join(F.broadcast(small) if staged_bytes(small) <= LOOKUP_BYTES else small, list(keys), how)
