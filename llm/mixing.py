"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target number of words and a schedule of weights over the training time 0 to 1. The integral of the
schedule is the source's cumulative demand; a document that covers words a to b of its source's supply is due when the
demand reaches the middle of a and b, so the inverse of the integral gives its training position. Sorting by range of position
lays the documents out in training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import small_side, stage

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (1.0, 2.0, 3.0)
#: weight at the start and at the end of training, by a source's place in CYCLE: light sources first, heavy ones later
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MOST_REPEATS = 3


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle=CYCLE, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, place (in the cycle), target. sizes: source, size.

    Sources in code point order, null last, weigh as the cycle says. All words are shared by weight; a target above
    `most` times its source's size stops there and the excess is shared again. In ascending order of what a source can
    give per weight, the sources that stop come first, so one pass finds them. One row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*map(F.lit, cycle))
    per = per.withColumn("place", F.pmod(rank, F.lit(len(cycle))).cast("int")).withColumn("_w", F.element_at(weights, F.col("place") + 1))
    by = Window.orderBy(F.col("source_size") * most / F.col("_w"), F.col("source").asc_nulls_last())
    up_to, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    limit = (F.col("source_size") * most).cast("double")
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    level = (total - F.coalesce(F.sum(limit).over(up_to), F.lit(0.0))) / F.sum("_w").over(after)
    per = per.withColumn("_level", level).withColumn("_stops", limit <= F.col("_w") * F.col("_level"))
    common = F.min(F.when(~F.col("_stops"), F.struct(F.col("source_size") * most / F.col("_w"), F.col("_level")))).over(Window.partitionBy())
    return per.select("source", "source_size", "place", F.when(F.col("_stops"), limit).otherwise(F.col("_w") * common["_level"]).alias("target"))


def due(share: Column, start: Column, end: Column) -> Column:
    """Time at which a source with linear weights start to end has met the given share of its demand."""
    slope = end - start
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + slope * (start + end) * share))
    return F.when(F.abs(slope) < 1e-12, share).otherwise((root - start) / slope)


def mix(docs: DataFrame, cycle=CYCLE, schedule=SCHEDULE, most: int = MOST_REPEATS, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, whole, rest, before, place and `extra` columns: one row per input row.

    A source's documents stand in the order of a hash of their ids. The mix takes the whole source `whole` times and
    then `rest` words more from the start of that order, so at most one document of a source is taken in part.
    taken never exceeds `most` times the size, and each source's sum is its target to the nearest word. Null texts
    have size 0 and are taken with 0 words; null sources form one source; repeated rows are documents of their own.
    Running sums are cut by the hash, so a source that holds a third of all rows spreads over many tasks."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = stage(docs.select("doc_id", "source", n_words().alias("size"), key.alias("_key"), *extra)
                 .withColumn("_part", F.substring("_key", 1, 3)))  # at most 4,096 parts of a source
    aims = stage(targets(rows.select("source", "size"), cycle, most))
    parts = rows.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("source").alias("_source"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    order = Window.partitionBy("source", "_part").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in", F.coalesce(F.sum("size").over(order), F.lit(0)))
    out = out.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_p"))).drop("_source", "_p")
    out = out.join(small_side(aims.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    need = F.floor(F.col("target") + 0.5).cast("long")
    size = F.col("source_size")
    out = (out.withColumn("before", F.col("_start") + F.col("_in"))
           .withColumn("whole", F.when(size > 0, F.floor(need / size)).otherwise(0).cast("long"))
           .withColumn("rest", need - F.col("whole") * size))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("whole") + part).cast("long").alias("taken"),
                      "whole", "rest", "before", "place", *extra)


def copies(mixed: DataFrame, schedule=SCHEDULE) -> DataFrame:
    """One row per copy that the mix takes: the columns of `mix`, copy, words (of this copy), position (0 to 1)."""
    last = F.col("taken") - F.col("size") * F.col("whole")
    number = (F.col("whole") + F.when(last > 0, 1).otherwise(0)).cast("int")
    out = mixed.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), number - 1)))
    out = out.withColumn("words", F.when(F.col("copy") < F.col("whole"), F.col("size")).otherwise(last))
    return out.withColumn("position", _position(F.col("copy"), F.col("words"), schedule))


def _position(copy: Column, words: Column, schedule) -> Column:
    at = F.col("place") + 1
    start, end = (F.element_at(F.array(*[F.lit(float(s[i])) for s in schedule]), at) for i in (0, 1))
    need = F.col("whole") * F.col("source_size") + F.col("rest")
    middle = copy * F.col("source_size") + F.col("before") + words / 2
    return due(middle / need, start, end)


def in_training_order(rows: DataFrame, position: str = "position") -> DataFrame:
    """Range partitions by position, sorted inside: read in order, they are the training order."""
    order = [F.col(position).asc_nulls_last(), F.col("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def first_position(mixed: DataFrame, schedule=SCHEDULE) -> Column:
    """Position of a document's first copy, null if the mix takes none of it."""
    return F.when(F.col("taken") > 0, _position(F.lit(0), F.when(F.col("whole") > 0, F.col("size")).otherwise(F.col("taken")), schedule))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    gaps, words = F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(words, F.lit(1), n), lambda g, w: F.array(g, w))), "")


def mixed_documents(docs: DataFrame, cycle=CYCLE, schedule=SCHEDULE, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of docs in training order, each as often as the mix takes it; a copy taken in part ends after its last
    word. Rows are told apart by doc_id and text, so repeated rows must have been removed. Documents without words
    have nothing to take. n_chars, if there is such a column, follows the text."""
    key = F.xxhash64("text")
    mixed = mix(docs.withColumn("_text", key), cycle, schedule, most, extra=("_text",))
    taken = stage(copies(mixed, schedule).select(F.col("doc_id").alias("_id"), "_text", F.col("size").alias("_size"), F.col("words").alias("_words"), F.col("position").alias("_position")))
    rows = docs.withColumn("_k", key).join(small_side(taken), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_text")))
    text = F.when(F.col("_words") < F.col("_size"), first_words(F.col("text"), F.col("_words").cast("int"))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return in_training_order(rows.select(*docs.columns, "_position"), "_position").drop("_position")
