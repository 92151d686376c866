"""Vector best-fit packing of pieces into bins.

A bin has three capacities: tokens, number of pieces, and attention cost (the sum of squared lengths). Items are taken
from the longest to the shortest. Each goes into the open bin that fits it under every capacity and scores best: the smallest
weighted norm of what is left afterwards, or the largest weighted dot product of demand and residual. Only if none
fits is a new bin opened.

What an item demands follows from its length alone, and there are at most `tokens` lengths. So the choice is made on
the number of items of each length (at most `tokens` rows on the driver, whatever the input) for whole groups of
equal bins at once. Its result is a list of moves: items of one length, ranks a to b, go to bins s to s + b - a at one
offset. Spark ranks the pieces within their length and looks the move up. No piece passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

RANK_ROWS = 200_000  # rows of one length ranked by one task


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    pieces: int = 2048
    attention: float = 2048.0 ** 2
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"  # or "dot"

    def demand(self, length: int) -> np.ndarray:
        """Shares of the three capacities."""
        return np.array([length / self.tokens, 1 / self.pieces, length * length / self.attention])


def plan(counts: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, rank_from, rank_to, bin_from, place): see the module. counts: items of each length."""
    if cap.rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {cap.rule}")
    weights, moves, bins = np.array(cap.weights), [], 0
    size = 1024
    free = np.zeros((size, 3))
    first, many, used = (np.zeros(size, np.int64) for _ in range(3))
    n = 0

    def add(start: int, number: int, place: int, left: np.ndarray) -> None:
        nonlocal n, size, free, first, many, used
        if n == size:
            size *= 2
            free = np.concatenate([free, np.zeros_like(free)])
            first, many, used = (np.concatenate([x, np.zeros_like(x)]) for x in (first, many, used))
        free[n], first[n], many[n], used[n] = left, start, number, place
        n += 1

    for length in sorted(counts, reverse=True):
        need, left, rank = cap.demand(length), counts[length], 0
        if (need > 1 + 1e-9).any():
            raise ValueError(f"a piece of {length} tokens does not fit an empty bin")
        while left:
            fits = (free[:n] >= need - 1e-9).all(axis=1) & (many[:n] > 0)
            if fits.any():
                at = np.flatnonzero(fits)
                rest = free[at] if cap.rule == "dot" else free[at] - need
                score = -(rest * need * weights).sum(axis=1) if cap.rule == "dot" else (rest * rest * weights).sum(axis=1)
                g = int(at[np.argmin(score)])  # the oldest of equals
                k = min(left, int(many[g]))
                start, place, room = int(first[g]), int(used[g]), free[g].copy()
                first[g] += k
                many[g] -= k
                if not many[g]:  # the last group takes the place of an emptied one
                    n -= 1
                    free[g], first[g], many[g], used[g] = free[n], first[n], many[n], used[n]
            else:
                alone = int(min(cap.tokens // length, cap.pieces, cap.attention // (length * length)))
                k = min(left, -(-left // max(1, alone)))
                start, place, room = bins, 0, np.ones(3)
                bins += k
            moves.append((length, rank, rank + k, start, place))
            add(start, k, place + length, room - need)
            rank += k
            left -= k
    return moves


def pack(pieces: DataFrame, cap: Capacity = Capacity(), length: str = "length") -> DataFrame:
    """Adds sequence_id and offset (place in the sequence, without gaps from 0) to a table of pieces.

    Pieces are told apart by nothing, so repeated rows are packed one by one. Lengths null or below 1 take no
    room: they get null in both columns. A piece longer than the capacity raises ValueError. An empty table stays
    empty. Columns sequence_id and offset of the input are replaced."""
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    full = F.col(length) == cap.tokens  # alone in its bin, and often the commonest length: needs no rank
    rows = stage(pieces.withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    # the row number is part of the written table, so ranks by it do not change if a task is repeated
    real = F.col(length) >= 1
    counts = stage(rows.filter(real & ~full).groupBy(F.col(length).alias("_len"), "_task").agg(F.count(F.lit(1)).alias("_n")))
    total = {r[0]: r[1] for r in counts.groupBy("_len").agg(F.sum("_n")).collect()}
    moves = plan({int(k): int(v) for k, v in total.items()}, cap)
    if any(m[0] > cap.tokens for m in moves):
        raise ValueError("a piece is longer than the capacity")
    bins = max((m[3] + m[2] - m[1] for m in moves), default=0)

    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy("_len").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = Window.partitionBy(length, "_task").orderBy("_row")
    ranked = (rows.filter(real & ~full).withColumn("_rank", F.row_number().over(rank) - 1)
              .join(before, (F.col(length) == F.col("_len")) & (rows["_task"] == before["_task"])).drop(before["_task"])
              .withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_len", "_before"))
    table = spark.createDataFrame(moves, "_len long, _from long, _to long, _bin long, _place long")
    packed = ranked.join(F.broadcast(table), (F.col(length) == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).select(
        *pieces.columns, (F.col("_bin") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_place").alias("offset"))
    alone = rows.filter(full).select(*pieces.columns, (F.lit(bins) + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    none = rows.filter(~F.coalesce(real, F.lit(False))).select(
        *pieces.columns, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return packed.unionByName(alone).unionByName(none)
