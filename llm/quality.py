"""Quality by a vote of the nearest labelled documents in a latent-semantic space.

Terms are hashed byte pairs of the text and a few counted events (repeated words, capitals, marks behind words, bars,
short and long words). Counts become tf-idf weights; a truncated SVD of a bounded sample of labelled rows gives the
latent space. The labelled vectors of that sample are sent to every task, and each document's cosine with all of them
is one blocked matrix product. The nearest `neighbours` vote with weights that fall with the distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shingles import pieces, text_buffer

PAIRS, EVENTS = 1024, 10
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@dataclass(frozen=True)
class Settings:
    sample: int = 8192  # labelled rows that take part in the fit, at most about
    rank: int = 48
    neighbours: int = 9
    sharpness: float = 30.0
    event_weight: float = 2.0
    prior_weight: float = 0.02


def terms(column) -> np.ndarray:
    """One row of term counts per text; null counts as empty and gives zeros."""
    data, offsets = text_buffer(column)
    out = np.zeros((len(offsets) - 1, PAIRS + EVENTS), np.float32)
    for first, last in pieces(offsets):
        at = (offsets[first:last + 1] - offsets[first]).astype(np.int64)
        raw = data[int(offsets[first]):int(offsets[last])]
        n = last - first
        if not len(raw):
            continue
        doc = np.repeat(np.arange(n), np.diff(at))
        pair = (raw[:-1].astype(np.int64) * 167 + raw[1:].astype(np.int64) * 3571) % PAIRS
        same = doc[1:] == doc[:-1]
        out[first:last, :PAIRS] = np.bincount(doc[1:][same] * PAIRS + pair[same], minlength=n * PAIRS).reshape(n, PAIRS)
        space, mark, upper = _SPACE[raw], _MARK[raw], _UPPER[raw]
        inside = ~space
        start = inside.copy()
        start[1:] &= space[:-1] | ~same
        begin = np.flatnonzero(start)
        if not len(begin):
            continue
        marks, uppers, chars = (np.add.reduceat(x.astype(np.int64), begin) for x in (mark, upper, inside))
        # a word's bytes plus their places: equal neighbours are very likely equal words
        place = np.arange(len(raw)) - begin[np.maximum(0, np.cumsum(start) - 1)]
        code = np.add.reduceat(np.where(inside, raw * (1 + 31 * place), 0), begin)
        owner = doc[begin]
        again = np.zeros(len(begin), bool)
        again[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
        events = (np.ones(len(begin), bool), again, (uppers >= 2) & (uppers + marks == chars), marks >= 2, marks == chars, chars <= 2,
                  chars >= 15, np.add.reduceat(_DIGIT[raw].astype(np.int64), begin) > 0)
        for k, e in enumerate(events):
            out[first:last, PAIRS + k] = np.bincount(owner, weights=e, minlength=n)
        out[first:last, PAIRS + 8] = np.bincount(doc, weights=raw == 10, minlength=n)
        out[first:last, PAIRS + 9] = np.bincount(doc, weights=raw >= 128, minlength=n)
    return out


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    settings: Settings

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """Pairs and events are scaled to a fixed length each, so that the few events are heard."""
        out = np.sqrt(counts) * self.idf
        for part in (slice(0, PAIRS), slice(PAIRS, None)):
            out[:, part] /= np.maximum(np.linalg.norm(out[:, part], axis=1, keepdims=True), 1e-9)
        out[:, PAIRS:] *= self.settings.event_weight
        return out

    def latent(self, counts: np.ndarray) -> np.ndarray:
        z = self.weights(counts) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, column) -> np.ndarray:
        """Share of good labels among the nearest, from 0 to 1. An empty text, or no labelled row at all, gets the prior."""
        counts, out = terms(column), np.full(len(column), self.prior)
        k = min(self.settings.neighbours, len(self.vectors))
        for at in range(0, len(counts) if k else 0, 512):
            z = self.latent(counts[at:at + 512])
            cosine = z @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            near.sort(axis=1)
            weight = np.exp(self.settings.sharpness * (np.take_along_axis(cosine, near, 1).astype(np.float64) - 1))
            vote = (weight * self.labels[near]).sum(1) + self.settings.prior_weight * self.prior
            vote /= weight.sum(1) + self.settings.prior_weight
            out[at:at + 512] = np.where(np.abs(z).sum(1) > 0, vote, self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """labels: doc_id, label (0 or 1); null ids and labels are dropped, repeated rows count with their mean.

    At most about settings.sample labelled documents take part: those with the smallest hashes of their ids, so a
    rerun takes the same ones. Only their term counts reach the driver."""
    rated = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.avg("label").alias("label"))
    many = rated.count()
    share = min(1.0, settings.sample / max(1, many))
    chosen = rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by settings.sample
             .repartition(8, "doc_id").dropDuplicates(["doc_id"]))

    def run(batches):
        for batch in batches:
            counts = terms(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([c.tobytes() for c in counts], pa.binary())],
                                             ["doc_id", "label", "counts"])

    rows = texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label double, counts binary").toPandas().sort_values("doc_id")
    counts = np.frombuffer(b"".join(rows.counts), np.float32).reshape(-1, PAIRS + EVENTS)
    seen = counts.sum(axis=1) > 0
    counts, marks = counts[seen], rows.label.to_numpy(np.float64)[seen]
    prior = float(marks.mean()) if len(marks) else 0.5
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 0.1
    model = Model(idf, np.zeros((PAIRS + EVENTS, 0), np.float32), np.zeros((0, 0), np.float32), marks, prior, settings)
    if len(counts):
        x = model.weights(counts)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        basis = vectors[:, np.argsort(-values)[:settings.rank]].astype(np.float32)
        model = Model(idf, basis, np.zeros((0, 0)), marks, prior, settings)
        model = Model(idf, basis, np.ascontiguousarray(model.latent(counts)), marks, prior, settings)
    return model


def score(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """Adds the score (0 to 1) to every row; a column of that name is replaced. Null and empty texts get the prior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != column]
    schema = docs.select(*kept).schema.add(column, "double")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column("text")), pa.float64())],
                                             [*batch.schema.names, column])

    return docs.select(*kept).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of ids that no fit may see."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def training_labels(labels: DataFrame, name: str = "quality") -> DataFrame:
    return labels.filter(~held_out()).select(F.col("doc_id").cast("long"), F.col(name).cast("double").alias("label"))
