"""Long byte strings that occur again, over all documents, found with suffix arrays.

A string of `width` bytes that also begins earlier (in a document with a smaller id, or earlier in the same one) is a repeat, and the bytes it
covers go. Every string is known by its anchor: the gram of `width` // 3 bytes with the smallest hash in it, the leftmost of
several. Equal strings have equal anchors at equal places, and consecutive strings share one, so text falls into
stretches of strings with one anchor, about one in 35 bytes, and only stretches with equal anchors need comparing.

1. Texts are packed into blocks of about a megabyte, written once, bucketed by block: later joins do not move them.
2. Blocks ask which of their anchors occur elsewhere: each distinct anchor goes to a bucket once per block, a bit comes back.
3. Stretches with such anchors are pre-aggregated: of equal ones (anchor, content) only the first can hold first strings,
   the others are repeats as a whole. This happens in the block and then over all blocks.
4. Different stretches of one anchor are cut from the texts and meet in a task, which builds their suffix array by two-stage
   sorting; strings whose neighbours share `width` symbols are equal, and all but the first are repeats.
   An anchor with more than GROUP different stretches is dealt over several tasks, by content; then the first of each
   task's equal strings are compared once more by hash.
5. A block gets its repeats back and its texts lose the bytes that they cover.

Anchors and stretches are compared by hashes, 64 bits for an anchor and 64 for the content; two different stretches are taken for equal with odds of about 2^-128 a pair.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tideline.functions.blocks import work_dir

from .common import small_side, stage
from .shingles import mix, powers
from .suffixes import common_prefixes, layout, suffix_array, words_of

WIDTH = 100
BLOCK_BYTES, BLOCK_TEXTS = 1 << 20, 1 << 16
BUCKET_BYTES = 16 << 20  # of texts in a bucket of blocks
ASKED_BYTES = 8 << 20  # of anchors in a bucket of anchors
GROUP = 2048  # different stretches of an anchor in one task
BATCH_BYTES = 1 << 20  # of stretches in one suffix array
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_FIRST = np.uint64(0x9FB21C651E98DF25)


def gram(width: int) -> int:
    return max(1, width // 3)


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    return total


def stretches(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of the texts data[at[i]:at[i + 1]]: anchor hash, content hash, text number, first byte in the text and number of strings of every stretch."""
    n, k = len(data), gram(width)
    none = np.zeros(0, np.uint64)
    if n < width:
        return none, none, *[np.zeros(0, np.int64)] * 3
    total, (_, down) = prefix_sums(data), powers(n + 1)
    hashes = mix((total[k:] - total[:n - k + 1]) * down[:n - k + 1])
    low = np.uint64((1 << n.bit_length()) - 1)
    best = lowest(hashes & ~low | np.arange(n - k + 1, dtype=np.uint64), width - k + 1)
    whole = np.zeros(n + 1, np.int64)  # strings that would reach into the next text
    begin, end = at[:-1], at[1:]
    np.add.at(whole, np.maximum(begin, end - width + 1), 1)
    np.add.at(whole, end, -1)
    first = np.flatnonzero(np.cumsum(whole)[:n - width + 1] == 0)
    if not len(first):
        return none, none, *[np.zeros(0, np.int64)] * 3
    anchor = (best[first] & low).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)])
    many = np.diff(np.r_[edge, len(first)])
    start, anchor = first[edge], anchor[edge]
    stop = start + many - 1 + width
    content = mix((total[stop] - total[start]) * down[start] + mix(((anchor - start) * (width + 1) + many).astype(np.uint64)))
    text = np.searchsorted(at, start, "right") - 1
    return hashes[anchor], content, text, start - at[text], many


def dealt(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each anchor; sorted anchors have sorted buckets."""
    return ((anchors >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


# ---- blocks


def packed(docs: DataFrame) -> DataFrame:
    """block, doc_ids, sizes, text: texts (null: empty) one after the other, in blocks."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def made():
            nonlocal ids, texts, size, number
            row = [pa.array([task << 20 | number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                   pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary())]
            ids, texts, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays(row, ["block", "doc_ids", "sizes", "text"])

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_buffer()
                text = text.to_pybytes() if text is not None else b""
                ids.append(batch.column(0)[i].as_py())
                texts.append(text)
                size += len(text)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_TEXTS:
                    yield made()
        if ids:
            yield made()

    return docs.mapInArrow(run, "block long, doc_ids array<long>, sizes array<long>, text binary")


def by_block(blocks: DataFrame, buckets: int) -> DataFrame:
    """Written once, bucketed by block."""
    spark, name = blocks.sparkSession, f"blocks_{uuid.uuid4().hex}"
    blocks.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", f"{work_dir(spark)}/tideline/{name}").saveAsTable(name)
    return spark.table(name)


def _read(batches):
    """Rows of a batch of blocks: (block, ids, offsets, bytes, the row's place in the batch, the batch)."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes = np.array(batch.column("sizes")[i].values.to_numpy(zero_copy_only=False), np.int64)
            text = np.frombuffer(batch.column("text")[i].as_buffer(), np.uint8)
            yield batch.column("block")[i].as_py(), batch.column("doc_ids")[i].values, np.r_[0, np.cumsum(sizes)], text, i, batch


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*[c.split() for c in schema.split(", ")])
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


# ---- which anchors occur again

_ASK, _FOUND = "bucket int, block long, asked binary", "block long, bucket int, found binary"


def ask(blocks: DataFrame, width: int, buckets: int) -> DataFrame:
    def run(batches):
        for block, _, at, text, _, _ in _read(batches):
            anchors, often = np.unique(stretches(text, at, width)[0], return_counts=True)
            to = dealt(anchors, buckets)
            twice = np.minimum(often, 2)
            goes, cut = np.unique(to, return_index=True)
            asked = [np.repeat(anchors[a:b], twice[a:b]).tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(to)])]
            if asked:
                yield _batch(_ASK, goes.astype(np.int32), np.full(len(goes), block), asked)

    return blocks.mapInArrow(run, _ASK)


def tell(asked: DataFrame) -> DataFrame:
    """For each block and bucket a bit per distinct anchor, in order: does it occur again, here or elsewhere?"""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("asked")]
        anchors, often = np.unique(np.concatenate(parts), return_counts=True)
        again = anchors[often > 1]
        found = []
        for part in parts:
            mine = np.unique(part)
            at = np.minimum(np.searchsorted(again, mine), max(0, len(again) - 1))
            found.append(np.packbits(again[at] == mine if len(again) else np.zeros(len(mine), bool)).tobytes())
        return pa.Table.from_arrays([table.column("block"), table.column("bucket"), pa.array(found, pa.binary())], ["block", "bucket", "found"])

    return asked.groupBy("bucket").applyInArrow(run, _FOUND)


_HIT = "anchor long, content long, doc_id long, place long, start int, many int"


def hits(blocks: DataFrame, told: DataFrame, width: int, buckets: int) -> DataFrame:
    """Stretches whose anchor occurs again. Of equal ones in a block only the first has anchor and content; the rest are repeats."""

    def run(batches):
        for block, ids, at, text, i, batch in _read(batches):
            anchor, content, of, start, many = stretches(text, at, width)
            if not len(anchor):
                continue
            distinct, back = np.unique(anchor, return_inverse=True)
            to, again = dealt(distinct, buckets), np.zeros(len(distinct), bool)
            for reply in batch.column("told")[i].as_py():
                a, b = np.searchsorted(to, [reply["bucket"], reply["bucket"] + 1])
                again[a:b] = np.unpackbits(np.frombuffer(reply["found"], np.uint8), count=b - a).astype(bool)
            mine = np.flatnonzero(again[back])
            anchor, content, of, start, many = (x[mine] for x in (anchor, content, of, start, many))
            known = ids.fill_null(0).to_numpy(zero_copy_only=False)
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((np.arange(len(ids)), known, ids.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(ids))
            by = np.lexsort((start, rank[of], content, anchor))
            anchor, content, of, start, many = (x[by] for x in (anchor, content, of, start, many))
            copy = np.r_[False, (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])] if len(by) else np.zeros(0, bool)
            yield _batch(_HIT, pa.array(anchor.view(np.int64), mask=copy), pa.array(content.view(np.int64), mask=copy), ids.take(pa.array(of)),
                         (block << 16) + of, start.astype(np.int32), many.astype(np.int32))

    replies = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "found")).alias("told"))
    return blocks.join(replies, "block").mapInArrow(run, _HIT)


# ---- different stretches of one anchor

_CUT = "anchor long, part int, parts int, doc_id long, place long, start int, many int, bytes binary"
_SEEN = "anchor long, string long, doc_id long, place long, start int, many int"


def cut(blocks: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The bytes of the wanted stretches."""

    def run(batches):
        for block, ids, at, text, i, batch in _read(batches):
            rows = batch.column("wanted")[i].values
            field = {n: rows.field(k) for k, n in enumerate(["anchor", "part", "parts", "place", "start", "many"])}
            of = field["place"].to_numpy() - (block << 16)
            begin = at[of] + field["start"].to_numpy()
            stop = begin + field["many"].to_numpy() + width - 1
            raw = text.tobytes()
            yield _batch(_CUT, field["anchor"], field["part"], field["parts"], ids.take(pa.array(of)), field["place"], field["start"], field["many"],
                         [raw[a:b] for a, b in zip(begin.tolist(), stop.tolist())])

    rows = wanted.groupBy(F.shiftright("place", 16).alias("block")).agg(F.collect_list(F.struct("anchor", "part", "parts", "place", "start", "many")).alias("wanted"))
    return blocks.join(rows, "block").mapInArrow(run, _CUT)


def equal_strings(strings: list[bytes], many: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String number, offset in it and class of the first `many` strings of `width` bytes of each; equal ones share a class."""
    symbols, begin = layout(strings)
    words = words_of(symbols)
    wanted = np.zeros(len(symbols), bool)
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    wanted[np.repeat(begin, many) + within] = True
    order = suffix_array(symbols, words)
    order = order[wanted[order]]
    kind = np.cumsum(common_prefixes(order, words, width) < width)
    of = np.searchsorted(begin, order, "right") - 1
    return of, order - begin[of], kind


def compared(cuts: DataFrame, width: int) -> DataFrame:
    """Repeats (anchor null), and of anchors in several parts the part's first of every string, with a hash of the string."""

    def solve(rows: pa.Table):
        strings = rows.column("bytes").to_pylist()
        ids = rows.column("doc_id").combine_chunks()
        start, many, place = (rows.column(c).to_numpy().astype(np.int64) for c in ("start", "many", "place"))
        of, offset, kind = equal_strings(strings, many, width)
        null, known = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        by = np.lexsort((start[of] + offset, place[of], known[of], null[of], kind))
        of, offset, kind = of[by], offset[by], kind[by]
        later = np.r_[False, kind[1:] == kind[:-1]] if len(kind) else np.zeros(0, bool)
        o, p = of[later], offset[later]
        by = np.lexsort((p, o))
        o, p = o[by], p[by]
        edge = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)]) if len(o) else np.zeros(0, np.int64)
        if len(edge):
            run_of, run_many = o[edge], np.diff(np.r_[edge, len(o)])
            blank = pa.nulls(len(edge), pa.int64())
            yield _batch(_SEEN, blank, blank, ids.take(pa.array(run_of)), place[run_of], (start[run_of] + p[edge]).astype(np.int32), run_many.astype(np.int32))
        split = rows.column("parts").to_numpy()[of] > 1
        o, p = of[~later & split], offset[~later & split]
        if len(o):
            data = np.frombuffer(b"".join(strings), np.uint8)
            total, (_, down) = prefix_sums(data), powers(len(data) + 1)
            at = (np.cumsum([len(s) for s in strings]) - [len(s) for s in strings])[o] + p
            string = mix((total[at + width] - total[at]) * down[at] + _FIRST)
            yield _batch(_SEEN, rows.column("anchor").combine_chunks().take(pa.array(o)), string.view(np.int64), ids.take(pa.array(o)), place[o],
                         (start[o] + p).astype(np.int32), np.ones(len(o), np.int32))

    def run(batches):
        """Rows come sorted by anchor and part; whole groups are gathered until a batch is full."""
        held, size, last = [], 0, None
        for batch in batches:
            key = np.stack([batch.column("anchor").to_numpy(), batch.column("part").to_numpy().astype(np.int64)], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if b <= a:
                    continue
                if size >= BATCH_BYTES and tuple(key[a]) != last:
                    yield from solve(pa.Table.from_batches(held))
                    held, size = [], 0
                part = batch.slice(a, b - a)
                held.append(part)
                size += int(part.column("many").to_numpy().sum()) + (b - a) * width
                last = tuple(key[a])
        if held:
            yield from solve(pa.Table.from_batches(held))

    return cuts.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(run, _SEEN)


# ---- the whole

_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove(blocks: DataFrame, repeats: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for block, ids, at, text, i, batch in _read(batches):
            cover = np.zeros(len(text) + 1, np.int64)
            if batch.column("repeats")[i].is_valid:
                rows = batch.column("repeats")[i].values
                of, start, many = (rows.field(k).to_numpy().astype(np.int64) for k in range(3))
                begin = at[of - (block << 16)] + start
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + many + width - 1, -1)
            gone = np.cumsum(cover)[:-1] > 0
            sums = np.r_[0, np.cumsum(gone)]
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            edges = at[:-1][at[:-1] < len(text)]
            opens[edges] = gone[edges]
            spans = np.r_[0, np.cumsum(opens)]
            left = text[~gone].tobytes()
            keep = at - sums[at]
            sizes = np.diff(at)
            for a in range(0, len(sizes), 4096):
                b = min(len(sizes), a + 4096)
                yield _batch(_OUT, ids.slice(a, b - a), sizes[a:b], np.diff(sums[at[a:b + 1]]), np.diff(spans[at[a:b + 1]]),
                             [left[x:y] for x, y in zip(keep[a:b].tolist(), keep[a + 1:b + 1].tolist())])

    rows = repeats.groupBy(F.shiftright("place", 16).alias("block")).agg(F.collect_list(F.struct("place", "start", "many")).alias("repeats"))
    return blocks.join(rows, "block", "left").mapInArrow(run, _OUT)


def removed_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of every row of docs.

    Texts are UTF-8 bytes; a null text is empty. Texts below `width` bytes stay whole. Rows with one doc_id are documents of their own, in
    some order; of repeated rows one stays and the others lose everything. Rows without doc_id come after all others. What
    is left may cut a character. Other columns are ignored; an empty table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = by_block(packed(docs), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    buckets = int(min(1 << 24, 1 + 2 * 8 * size // (width - gram(width) + 2) // ASKED_BYTES))
    told = tell(ask(blocks, width, buckets))
    found = stage(hits(blocks, told, width, buckets))

    order = [F.col("doc_id").asc_nulls_last(), "place", "start"]
    seen = stage(found.filter("anchor IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("anchor", "content").orderBy(*order))))
    firsts = seen.filter("n = 1")
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    several = small_side(stage(several.select("anchor", F.ceil(F.col("many") / GROUP).cast("int").alias("parts"))))
    wanted = firsts.join(several, "anchor").withColumn("part", F.pmod(F.shiftright("content", 8), F.col("parts")).cast("int"))
    again = stage(compared(cut(blocks, wanted, width), width))
    crossed = again.filter("anchor IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("anchor", "string").orderBy(*order)))

    at = ("place", "start", "many")
    repeats = found.filter("anchor IS NULL").select(*at).unionByName(seen.filter("n > 1").select(*at)).unionByName(
        again.filter("anchor IS NULL").select(*at)).unionByName(crossed.filter("n > 1").select(*at))
    return remove(blocks, repeats, width)


def digested(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

