"""Cross-entropy difference of two matched n-gram language models.

Target and background model have the same form and share one vocabulary, the V distinct words (lower-cased) of all documents.
p(w | v) = (c(v, w) + m p(w)) / (c(v) + m) with p(w) = (c(w) + 1) / (N + V). All counts are exact: words, contexts and pairs are
counted by 62 bits of hash (two different ones count as one with odds of 2^-62), in tables that grow with the documents.

`difference` scores the documents that the models are made of, each by all others: its own words, contexts and pairs are taken off the
counts of every model that holds it, so that a loss tells how like the others it is and not whether it was among them. `score` is for
documents that were not counted.

No table is gathered in one place. Documents are read in blocks of BLOCK words; a block sends each of its distinct keys once, with
its own counts, to the key's bucket (a range of the hashes), so a frequent word weighs no more than a rare one. The
bucket adds the counts up and sends back the totals, and the block's texts are scored where the answers meet.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .shingles import mix, pieces, text_buffer, word_hashes

BLOCK = 3 << 19  # words
SLICE = 1 << 17  # words scored at a time (a longer text is scored alone)
BUCKET_BYTES = 16 << 20  # of text, for each bucket
BACKOFF = 20.0
_START = np.uint64(0)  # before the first word
_KIND, _PAIR, _WORD = ~np.uint64(3), np.uint64(0), np.uint64(1)
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_COLUMNS = ["block", "bucket", "ids", "keys", "background", "target"]
_ROW = "block long, bucket int, ids array<long>, keys binary, background binary, target binary"


def _packed(x: np.ndarray) -> bytes:
    """Bytes of like rank together, deflated. Hashes (uint64) are sorted, so their steps are kept."""
    x = np.diff(x, prepend=np.uint64(0)) if x.dtype == np.uint64 else np.ascontiguousarray(x)
    return zlib.compress(x.view(np.uint8).reshape(x.size, x.itemsize).T.tobytes(), 1)


def _unpacked(raw: bytes, kind) -> np.ndarray:
    size, raw = np.dtype(kind).itemsize, zlib.decompress(raw)
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if kind is np.uint64 else x


def _rows(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], _COLUMNS)


@dataclass(frozen=True)
class _Block:
    words: np.ndarray  # hashes of the distinct words
    at: np.ndarray  # of each word, its place among them
    sizes: np.ndarray  # words of each text

    def keys(self):
        """All distinct keys, sorted; for each pair that of its word, its context and its own place in them; the pair of each word."""
        own = self.words[self.at]
        before = np.concatenate([[_START], own[:-1]])[:len(own)]
        first = np.cumsum(self.sizes) - self.sizes
        before[first[self.sizes > 0]] = _START
        pairs, one, which = np.unique(mix(before * _TIMES + own) & _KIND | _PAIR, return_index=True, return_inverse=True)
        word, context = own[one] & _KIND | _WORD, before[one] & _KIND | _WORD
        every = np.concatenate([pairs, np.unique(np.concatenate([self.words & _KIND | _WORD, context]))])
        every.sort()
        return every, np.searchsorted(every, word), np.searchsorted(every, context), np.searchsorted(every, pairs), which

    def counts(self, keys, of, chosen):
        """Times of every key, and as a context (two rows), in all texts and in the chosen ones."""
        word, context, pair, which = of
        for texts in (None, np.repeat(chosen, self.sizes)):
            n = np.bincount(which if texts is None else which[texts], minlength=len(pair))
            yield np.array([np.bincount(word, n, len(keys)) + np.bincount(pair, n, len(keys)), np.bincount(context, n, len(keys))]).astype(np.int64)


def _blocks(docs: DataFrame, bits: int, flag: str | None, texts: bool) -> DataFrame:
    """One row for each block and bucket with the keys it asks for and its counts (zero without flag), and with texts a
    row (bucket -1) with the block's ids and words. docs: doc_id, text and, if given, flag."""

    def send(block, ids, hashes, sizes, chosen):
        words, at = np.unique(np.concatenate(hashes), return_inverse=True)
        held = _Block(words, at, np.array(sizes, np.int64))
        keys, *of = held.keys()
        none = np.zeros((2, len(keys)), np.int64)
        background, target = held.counts(keys, of, np.array(chosen, bool)) if flag else (none, none)
        edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(keys)]
        if texts:
            yield _rows([(block, -1, ids, _packed(words), _packed(at.astype(np.int32)), _packed(np.array([held.sizes, chosen], np.int64)))])
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                yield _rows([(block, k, None, _packed(keys[a:b]), _packed(background[:, a:b]), _packed(target[:, a:b]))])

    def run(batches):
        n, ids, hashes, sizes, chosen, held = TaskContext.get().partitionId() << 32, [], [], [], [], 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            mine, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, last in pieces(offsets):
                words, at = word_hashes(data, offsets[first:last + 1])
                ids += mine[first:last]
                hashes.append(words)
                sizes += np.diff(at).tolist()
                chosen += flags[first:last]
                held += len(words)
                if held >= BLOCK:
                    yield from send(n, ids, hashes, sizes, chosen)
                    n, ids, hashes, sizes, chosen, held = n + 1, [], [], [], [], 0
        if ids:
            yield from send(n, ids, hashes, sizes, chosen)

    chosen = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    doc_id = F.col("doc_id").cast("long") if texts else F.lit(None).cast("long")
    return docs.select(doc_id.alias("doc_id"), "text", chosen.alias("chosen")).mapInArrow(run, _ROW)


def _bits(docs: DataFrame) -> int:
    """Buckets of about BUCKET_BYTES of text, as a power of two."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(3, (size // BUCKET_BYTES).bit_length())


def _added(rows: DataFrame, bits: int, table: bool) -> DataFrame:
    """Adds up the counts of each bucket. Rows of a block get the totals of their keys; a row without a block has the bucket's
    numbers of distinct keys, and background and target counts, of pairs, words and contexts, and with table its keys and totals."""

    def answer(bucket, asked):
        of = [_unpacked(x[1], np.uint64) for x in asked]
        keys, which = np.unique(np.concatenate(of), return_inverse=True)
        totals = []
        for i in (2, 3):
            n = np.concatenate([_unpacked(x[i], np.int64).reshape(2, -1) for x in asked], axis=1)
            totals.append(np.array([np.bincount(which, x, len(keys)) for x in n]).astype(np.int64))  # exact below 2^53
        word = keys & ~_KIND == _WORD
        parts = [(t[0][~word], t[0][word], t[1]) for t in totals]
        sums = [int(np.count_nonzero(x)) for x in parts[0]] + [int(x.sum()) for t in parts for x in t]
        held = [_packed(x) for x in (keys, *totals)] if table else [None] * 3
        yield _rows([(None, bucket, sums, *held)])
        end = 0
        for (block, *_), mine in zip(asked, of):
            start, end = end, end + len(mine)
            if block is not None and not table:
                yield _rows([(block, bucket, None, None, *(_packed(t[:, which[start:end]]) for t in totals))])

    def run(batches):
        now, asked = None, []
        for batch in batches:
            for block, bucket, ids, keys, background, target in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket < 0:
                    yield _rows([(block, bucket, ids, keys, background, target)])
                    continue
                if bucket != now and asked:
                    yield from answer(now, asked)
                    asked = []
                now = bucket
                asked.append((block, keys, background, target))
        if asked:
            yield from answer(now, asked)

    where = F.when(F.col("bucket") < 0, F.col("block")).otherwise(F.col("bucket"))
    return stage(rows.repartition(1 << bits, where).sortWithinPartitions("bucket").mapInArrow(run, _ROW))


def _sums(added: DataFrame) -> np.ndarray:
    """Distinct keys, background and target counts (rows) of pairs, words and contexts."""
    got = added.filter("block IS NULL").agg(*[F.sum(F.col("ids")[i]).alias(f"s{i}") for i in range(9)]).first()
    return np.array([x or 0 for x in got], np.int64).reshape(3, 3)


def _own(text: np.ndarray, ids: np.ndarray, among: int) -> np.ndarray:
    """Of each word, how often its text has the same id (below among)."""
    _, which, n = np.unique(text * among + ids, return_inverse=True, return_counts=True)
    return n[which]


def _scored(added: DataFrame, bits: int, sums: np.ndarray, apart: bool) -> DataFrame:
    """With apart, every text is scored by the counts of all others."""
    distinct, totals = int(sums[0, 1]), [int(sums[1, 1]), int(sums[2, 1])]

    def score(ids, held, chosen, answers):
        keys, word, context, pair, which = held.keys()
        counts = [np.concatenate([_unpacked(x[i], np.int64).reshape(2, -1) for x in answers] or [np.zeros((2, 0), np.int64)], axis=1) for i in (0, 1)]
        member = np.array([np.ones(len(ids), np.int64), chosen]) * apart  # whose own counts are in the background, in the target
        starts = np.cumsum(held.sizes) - held.sizes
        edges = [0, *(np.flatnonzero(np.diff(starts // SLICE)) + 1).tolist(), len(ids)]
        losses = np.zeros((2, len(ids)))
        for first, last in zip(edges, edges[1:]):
            sizes, at = held.sizes[first:last], which[starts[first]:starts[last - 1] + held.sizes[last - 1]]
            text, words, contexts = np.repeat(np.arange(last - first), sizes), word[at], context[at]
            own = [_own(text, x, len(keys)) for x in (at, words, contexts)] if apart else [0, 0, 0]
            for i, ((n, before), total) in enumerate(zip(counts, totals)):
                mine = member[i, first:last]
                of, rest = mine[text], np.maximum(total - mine * sizes + distinct, 1)[text]
                alone = (n[words] - of * own[1] + 1.0) / rest
                loss = -np.log((n[pair[at]] - of * own[0] + BACKOFF * alone) / (before[contexts] - of * own[2] + BACKOFF))
                losses[i, first:last] = np.bincount(text, loss, last - first)
        some = held.sizes > 0
        background, target = (np.divide(x, held.sizes, where=some, out=np.zeros(len(ids))) for x in losses)
        columns = [pa.array(x, pa.float64(), mask=~some) for x in (target, background, target - background)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held.sizes, pa.int64()), *columns],
                                          ["doc_id", "n_words", "target_loss", "background_loss", "difference"])

    def run(batches):
        ids, held, chosen, answers = None, None, None, []
        for batch in batches:
            for _, bucket, mine, keys, background, target in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket >= 0:
                    answers.append((background, target))
                    continue
                if held is not None:
                    yield score(ids, held, chosen, answers)
                ids, answers = mine, []
                sizes, chosen = _unpacked(target, np.int64).reshape(2, -1)
                held = _Block(_unpacked(keys, np.uint64), _unpacked(background, np.int32), sizes)
        if held is not None:
            yield score(ids, held, chosen, answers)

    met = added.filter("block IS NOT NULL").repartition(1 << bits, "block").sortWithinPartitions("block", "bucket")
    return met.mapInArrow(run, "doc_id long, n_words long, target_loss double, background_loss double, difference double")


@dataclass(frozen=True)
class Counts:
    distinct: int  # in the background
    total: int

    def sum(self) -> int:
        return self.total


@dataclass(frozen=True)
class Model:
    words: Counts  # times a word occurs
    contexts: Counts  # times a word (or the start) precedes another
    pairs: Counts
    table: DataFrame  # keys and counts of each bucket, of both models
    bits: int


def fit(docs: DataFrame, target: str) -> tuple[Model, Model]:
    """Target and background model. target names a boolean column; the background is all documents, the target rows of it.

    Null flags count as false, null texts as empty. Without target rows the target model is uniform."""
    bits = _bits(docs)
    table = _added(_blocks(docs, bits, target, False), bits, True)
    sums = _sums(table)
    background, aim = (Model(*(Counts(int(sums[0, k]), int(row[k])) for k in (1, 2, 0)), table, bits) for row in sums[1:])
    return aim, background


def score(docs: DataFrame, aim: Model, background: Model) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (means per word) and difference (target less background: the lower, the more
    like the target) by the two models of one fit, for documents that the fit has not seen (see `difference` for those it has).
    Texts without words get null losses. Repeated rows score alike; other columns are ignored."""
    if aim.table is not background.table:
        raise ValueError("the two models are of different fits")
    bits = background.bits
    asked = _blocks(docs, bits, None, True)
    added = _added(asked.unionByName(background.table), bits, False)
    return _scored(added, bits, _sums(added), apart=False)


def difference(docs: DataFrame, target: str) -> DataFrame:
    """The columns of `score` for the documents that the models are made of, each row scored by the counts of all other rows; the vocabulary
    stays that of all. One pass: what a block asks for is also what it adds to the counts.

    Null flags count as false. Texts without words get null losses. A row that repeats is seen in its other copies; other columns are
    ignored. A target row is taken off both models, another one off the background."""
    bits = _bits(docs)
    added = _added(_blocks(docs, bits, target, True), bits, False)
    return _scored(added, bits, _sums(added), apart=True)
