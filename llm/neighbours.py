"""Nearest neighbours by multi-index hashing.

Vectors become binary codes: a rotation learned on a bounded sample (principal axes, then iterative quantization), and the
sign of each coordinate. A code is split into substrings, and each substring has a table from its value to the rows that hold
it. Two codes within a Hamming radius r agree in some substring up to r / (number of substrings) bits, so probing
every table at all values that near retrieves every code within the radius. Those are ranked by the cosine of the
original vectors.

The rows are dealt into blocks by a hash of their id, the queries too, and each pair of blocks is searched by one
task, which builds the block's tables. A task holds two blocks at most, whatever the size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

BYTE = 8
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass(frozen=True)
class Settings:
    sample: int = 8192  # rows that the rotation and the radius are learned from, at most about
    most_bits: int = 64
    recall: float = 0.97  # share of true neighbours in the sample that the radius must cover
    block_rows: int = 16_384
    query_rows: int = 2_048
    rounds: int = 30


@dataclass(frozen=True)
class Coder:
    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """One byte per substring."""
        return np.packbits((unit - self.centre) @ self.rotation > 0, axis=1)


def learn(sample: np.ndarray, k: int, settings: Settings) -> Coder:
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    d = unit.shape[1]
    bits = BYTE * max(1, min(settings.most_bits, d) // BYTE)
    random = np.random.default_rng(7)
    centre = unit.mean(axis=0)
    axes = np.linalg.eigh((unit - centre).T @ (unit - centre))[1][:, ::-1]  # a small square matrix, however large the sample
    if d < bits:
        axes = np.hstack([axes, random.normal(size=(d, bits - d))])
    axes = axes[:, :bits]
    flat = (unit - centre) @ axes
    turn = np.linalg.qr(random.normal(size=(bits, bits)))[0]
    for _ in range(settings.rounds):
        left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (left @ right).T
    coder = Coder(centre, axes @ turn, bits)
    asked = unit[:512]
    cosine = asked @ unit.T
    cosine[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-cosine, axis=1)[:, :k]
    codes = coder.codes(unit)
    apart = _ONES[codes[:len(asked), None, :] ^ codes[near]].sum(axis=2, dtype=np.int64)
    radius = int(np.quantile(apart, settings.recall, method="higher")) if apart.size else bits
    return Coder(centre, axes @ turn, radius)


class Tables:
    """One table per substring: rows in order of the substring's value, and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.begin = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are within the radius."""
        reach, seen = radius // len(code), np.zeros(len(self.codes), bool)
        for j, value in enumerate(code):
            for probe in np.flatnonzero(_ONES[np.arange(256) ^ int(value)] <= reach):
                seen[self.order[j][self.begin[j][probe]:self.begin[j][probe + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[_ONES[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64) <= radius]


def best(ids, vectors, norms, rows, query, query_norm, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the rows: cosines (equal vectors get equal ones) and ids, ties to the smaller id."""
    rough = vectors[rows] @ query / (norms[rows] * query_norm)
    if len(rows) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        rows = rows[rough >= least - 1e-9]
    score = (vectors[rows] * query).sum(axis=1) / (norms[rows] * query_norm)
    top = np.lexsort((ids[rows], -score))[:k]
    return score[top], ids[rows][top]


def _usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vector (doubles as bytes) of rows that take part."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            keep, raw = [], []
            for i, v in enumerate(lists):
                if ids[i].is_valid and v.is_valid and v.values is not None and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                    if np.isfinite(x).all() and x.any():
                        keep.append(i)
                        raw.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pc.take(ids, pa.array(keep, pa.int64())), pa.array(raw, pa.binary())], ["id", "vector"])

    return table.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "id long, vector binary")


def _matrix(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, d)


def search(table: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row for which is_query(Column) holds.

    Candidates are all rows but the query's own id. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do vectors of another length than the longest group's. Of rows with one id the first
    in byte order counts. A query that finds fewer than k within the radius in a block is compared with the whole block,
    so no query goes short. An empty table gives an empty result."""
    spark = table.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = stage(_usable(table, key, vector))
    lengths = rows.groupBy(F.octet_length("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, many = lengths[0][0] // 8, lengths[0][1]
    rows = rows.filter(F.octet_length("vector") == 8 * d)
    share = min(1.0, settings.sample / many)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < max(1, int(share * (1 << 30)))).limit(4 * settings.sample).toPandas().sort_values(["id", "vector"])
    if not len(sample):
        sample = rows.limit(1).toPandas()
    coder = spark.sparkContext.broadcast(learn(_matrix(sample.vector, d), k, settings))
    blocks = -(-many // settings.block_rows)
    asked = rows.filter(is_query(F.col("id")))
    query_blocks = max(1, -(-asked.count() // settings.query_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "vector", block.alias("b"), every(query_blocks).alias("q"))
    right = asked.select("id", "vector", every(blocks).alias("b"), query_block.alias("q"))

    def run(index, queries):
        import pandas as pd

        c = coder.value
        index, queries = (x.sort_values(["id", "vector"]).drop_duplicates("id") for x in (index, queries))
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(index) and len(queries):
            ids, vectors = index.id.to_numpy(), _matrix(index.vector, d)
            norms = np.linalg.norm(vectors, axis=1)
            tables = Tables(c.codes(vectors / norms[:, None]))
            asked_ids, asked_vectors = queries.id.to_numpy(), _matrix(queries.vector, d)
            asked_norms = np.linalg.norm(asked_vectors, axis=1)
            codes = c.codes(asked_vectors / asked_norms[:, None])
            for own, query, norm, code in zip(asked_ids, asked_vectors, asked_norms, codes):
                found = tables.within(code, c.radius)
                found = found[ids[found] != own]
                if len(found) < k:
                    found = np.flatnonzero(ids != own)
                score, near = best(ids, vectors, norms, found, query, norm, k)
                out["query_id"] += [own] * len(near)
                out["vec_id"] += near.tolist()
                out["score"] += score.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
