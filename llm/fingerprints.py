"""Lempel-Ziv phrase fingerprints and the likeness of neighbouring and edited texts.

A text is read once from left to right; each time the characters read since the last cut form a phrase that is not yet in
the text's dictionary, the phrase is added and a new one begins (LZ78). The set of phrases is hashed and the smallest hashes
are kept: a minimum-hash signature. The share of common values among the smallest of two signatures' union estimates the
likeness of the phrase sets, which is high when one text helps to compress the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shingles import mix, powers

KEPT = 64  # hashes in a signature
CHUNK_BYTES = 4 << 20
MOST_CHUNKS = 10_000


def parse(text: str, known: set[str], phrase: str = "") -> tuple[list[str], str]:
    """New phrases in order, and the unfinished one at the end. known grows."""
    new = []
    for c in text:
        phrase += c
        if phrase not in known:
            known.add(phrase)
            new.append(phrase)
            phrase = ""
    return new, phrase


def hashes(phrases: list[str]) -> np.ndarray:
    """32-bit hash of each phrase."""
    if not phrases:
        return np.zeros(0, np.uint32)
    points = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
    end = np.cumsum(sizes)
    begin = end - sizes
    up, down = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(0x632BE59BD9B4E019)) * up[:len(points)], out=total[1:])
    return (mix((total[end] - total[begin]) * down[begin]) >> np.uint64(32)).astype(np.uint32)


def signature(values: np.ndarray, kept: int = KEPT) -> np.ndarray:
    return np.unique(values)[:kept]


def written(sign: np.ndarray) -> str:
    return sign.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """0 to 1; two empty signatures are alike, an empty and another one not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = np.union1d(a, b)[:kept]
    return float(np.isin(low, a).__and__(np.isin(low, b)).sum() / len(low))


class Parsed:
    """A text's signature, and the state of its parse where an edit of its second half begins."""

    def __init__(self, text: str, kept: int):
        self.text, self.kept, self.cut = text, kept, len(text) - len(text) // 2
        known: set[str] = set()
        head, self.phrase = parse(text[:self.cut], known)
        self.known = known.copy()
        tail, _ = parse(text[self.cut:], known, self.phrase)
        values = hashes(head + tail)
        self.head, self.sign = values[:len(head)], signature(values, kept)

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The text with its second half replaced by the start of another, and that text's signature."""
        new = following[:len(self.text) // 2]
        tail, _ = parse(new, self.known, self.phrase)
        return self.text[:self.cut] + new, signature(np.concatenate([self.head, hashes(tail)]), self.kept)


def fingerprint(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next of every row.

    Documents stand in descending order of doc_id, null ids last, equal ids by text; after the last comes the first. Null
    texts count as empty: they have an empty fingerprint. A single document is its own next. Repeated rows follow each
    other; other columns are ignored.

    The order is cut into chunks by quantiles of the ids; the first document of a chunk is also sent to the chunk
    before it. So texts are shuffled once, a task reads its chunks as a stream, and a text waits only for the next one."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(min(MOST_CHUNKS, max(1, size // CHUNK_BYTES)))
    cuts = np.zeros(0, np.int64)
    if chunks > 1:
        got = rows.agg(F.percentile_approx(order, [i / chunks for i in range(1, chunks)], 20 * chunks)).first()[0]
        cuts = np.unique(np.array(got, np.int64))

    @F.pandas_udf("int")
    def chunk_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, ids.to_numpy(), "left")).astype("int32")

    rows = rows.withColumn("_order", order).withColumn("_home", chunk_of("_order"))
    tops = sorted(rows.groupBy("_home").agg(F.max("_order")).collect())  # a row per chunk
    first_of = {tops[i][1]: tops[i - 1][0] for i in range(len(tops))}  # the first chunk's goes to the last
    ids = np.array(sorted(first_of), np.int64)
    goes = np.array([first_of[i] for i in ids.tolist()], np.int32)

    @F.pandas_udf("int")
    def also(ids_: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(ids, ids_.to_numpy()), len(ids) - 1)
        return pd.Series(goes[at]).where(ids[at] == ids_.to_numpy()).astype("Int32")

    copy = lambda c, extra: F.struct(c.alias("chunk"), F.lit(extra).alias("extra"))
    rows = rows.withColumn("_also", also("_order"))
    places = F.when(F.col("_also").isNull(), F.array(copy(F.col("_home"), False))).otherwise(
        F.array(copy(F.col("_home"), False), copy(F.col("_also"), True)))
    rows = rows.select("doc_id", "text", "_order", F.explode(places).alias("_to")).select("doc_id", "text", "_order", "_to.*")
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "extra", F.col("_order").desc(), "text")

    def run(batches):
        out, before, place = [], None, None
        for doc_id, text, chunk, extra in _rows(batches):
            if chunk != place:
                before, place = None, chunk
            if extra and before is None:
                continue
            now = Parsed(text, kept)
            if before is not None:
                last_id, last = before
                edit, sign = last.edited(text)
                out.append((last_id, len(last.text), hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest(), written(last.sign),
                            written(sign), likeness(last.sign, sign, kept), likeness(last.sign, now.sign, kept)))
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
            before = None if extra else (doc_id, now)
        if out:
            yield _batch(out)

    return rows.select("doc_id", "text", "chunk", "extra").mapInArrow(run, _SCHEMA)


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(c.to_pylist() for c in part.columns))


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], [c.split()[0] for c in _SCHEMA.split(", ")])
