"""Token ids and token counts, both exact, without running a tokenizer over every text from end to end.

A text splits into units that the tokenizer treats on their own, and a task remembers the answer for each unit
it has met (a bounded memory, emptied when full and at the task's end). Texts repeat their words, so few units reach the tokenizer.
"""

from __future__ import annotations

import ctypes
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

UNITS_KEPT = 600_000
PAIRS_KEPT = 1_000_000
UNIT_LONGEST = 200  # longer units are not remembered
_loaded: dict[tuple, object] = {}


def release() -> None:
    """Gives freed memory back to the system, as far as its allocators offer that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class WordTokenizer:
    """Ids of a `tokenizers` file whose pre-tokenizer never crosses white space. Units are what lies between
    spaces and line feeds; special strings hold neither, so they stay whole inside a unit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        ends = [i for piece, i in self.library.get_vocab().items() if piece.endswith("</w>")]
        self.ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.known: dict[str, bytes] = {"": b""}
        # lower-case ASCII words need neither the normalizer nor the pattern of the pre-tokenizer
        from tokenizers import pre_tokenizers

        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()

    def forget(self) -> None:
        """A worker lives on for other stages, which need its memory."""
        self.known = {"": b""}
        release()

    def _each(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(units, add_special_tokens=False)]

    def _words(self, words: list[str], library) -> list[str]:
        """Many words are encoded as one text and told apart by the ends of words; what doesn't come out as
        one end a word is given back."""
        known, left = self.known, []
        parts = [words[at:at + 1000] for at in range(0, len(words), 1000)]
        for part, encoding in zip(parts, library.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(encoding.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                left += part
                continue
            raw, last = ids.tobytes(), 0
            for word, stop in zip(part, (stops * 4).tolist()):
                known[word] = raw[last:stop]
                last = stop
        return left

    def _learn(self, units: list[str]) -> None:
        """Runs of letters and runs of ASCII marks are words of their own, unless an apostrophe or a special string
        is about; each is looked up alone, in lower case if it is ASCII. Other units go to the library whole."""
        known, plain, words, other, made, rest = self.known, set(), set(), set(), [], []
        for u in units:  # nearly all are a run of letters with or without marks behind
            if len(u) > UNIT_LONGEST:
                other.add(u)
                continue
            w = u.rstrip(_MARKS)
            if not w.isalpha():
                rest.append(u)
                continue
            marks = u[len(w):]
            if "<|" in marks:
                other.add(u)
                continue
            if w.isascii():
                w = w.lower()
                if w not in known:
                    plain.add(w)
            elif w not in known:
                words.add(w)
            if w != u:
                if marks and marks not in known:
                    other.add(marks)
                made.append((u, w, marks))
        joined = []
        for u in rest:
            parts = _PARTS(u)
            if "<|" in u or "".join(parts) != u or not all(p.isalpha() or p.isascii() for p in parts):
                other.add(u)
                continue
            parts = [p.lower() if p.isascii() else p for p in parts]
            joined.append((u, parts))
            for p in parts:
                if p not in known:
                    (other if not p.isalpha() else plain if p.isascii() else words).add(p)
        other = [*other, *self._words(list(plain), self.plain), *self._words(list(words), self.library)]
        for at in range(0, len(other), 1000):
            part = other[at:at + 1000]
            known.update(zip(part, self._each(part)))
        for u, w, marks in made:
            known[u] = known[w] + known[marks]
        for u, parts in joined:
            known[u] = b"".join([known[p] for p in parts])

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > UNITS_KEPT:
            self.forget()
        known = self.known
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = [u for u in set().union(*split) if u not in known]
        if new:
            self._learn(new)
        out = [b"".join(map(known.__getitem__, units)) for units in split]
        for u in new:
            if len(u) > UNIT_LONGEST:
                del known[u]
        return out


class PieceCounter:
    """Prefix counts of a sentencepiece BPE model with byte fallback and no text normalization.

    No piece holds a space mark after another character or a line feed, so a text falls apart before every run
    of spaces and around line feeds. Inside a unit, the count of a prefix follows from shorter ones. A prefix that ends
    with a piece of the unit's encoding has one token more than the prefix without it. A prefix that ends inside
    a piece t, after a piece s, has the tokens up to s and those of t's own beginning, if the first of these may
    follow s; so the counts inside t depend on (s, t) alone and are kept. If it may not follow, dynamic
    programming over the earlier prefixes finds the one piece that ends there and may follow what is left. Whether one piece may follow another
    is asked of the library once per pair. Each text is stored as one signed byte per character: the change of the
    token count when that character is added."""

    BREAK = "\ue000"

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(self.size)]
        self.is_byte = [m.is_byte(i) for i in range(self.size)]
        self.ids = {p: i for i, p in enumerate(self.pieces)
                    if not (self.is_byte[i] or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        odd = [p for p in self.ids if re.search("[^▁]▁", p) or self.BREAK in p or "\n" in p]
        if odd or not any(self.is_byte) or m.encode("ａ \t", out_type=str)[1] != "<0xEF>":
            raise ValueError("the model needs byte fallback, no normalization and no piece with a space or line feed inside")
        self.longest = max(map(len, self.ids))
        self.break_ids = len(m.encode(self.BREAK))
        self.pairs: dict[int, bool] = {}
        self.inner: dict[str, tuple[int, int, int]] = {}  # of a piece's beginning: its tokens, the first and the last
        self.inside: dict[int, tuple | None] = {}
        self.known: dict[str, bytes] = {}

    def forget(self) -> None:
        """A worker lives on for other stages, which need its memory."""
        self.known = {}

    def _encode(self, units: list[str]) -> list[list[int]]:
        """The library puts one space mark before a text; other units are set behind a character that joins nothing."""
        got = self.library.encode([u[1:] if u[0] == "▁" else self.BREAK + u for u in units], num_threads=1)
        return [[self.ids["▁"]] if u == "▁" else ids if u[0] == "▁" else ids[self.break_ids:] for u, ids in zip(units, got)]

    def _follows(self, left: int, right: int) -> bool:
        """left is -1 at the start of a unit and after a character outside the vocabulary."""
        ok = self.pairs.get(left * self.size + right)
        if ok is None:
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs = {}
            ids = [i for i in (left, right) if i >= 0]
            ok = self.pairs[left * self.size + right] = self._encode(["".join([self.pieces[i] for i in ids])])[0] == ids
        return ok

    def _inside(self, left: int, piece: int) -> tuple[list[int], list[int]] | None:
        """Token count (from the piece's start) and last token after each of its characters; None if its beginnings
        join with what is left of it."""
        text, counts, lasts = self.pieces[piece], [], []
        for n in range(1, len(text)):
            if text[:n] not in self.inner:
                ids = self._encode([text[:n]])[0]
                self.inner[text[:n]] = len(ids), ids[0], ids[-1]
            count, first, last = self.inner[text[:n]]
            if self.is_byte[last] or self.is_byte[first] or not self._follows(left, first):
                return None
            counts.append(count)
            lasts.append(last)
        return [*counts, 1], [*lasts, piece]

    def _unit(self, unit: str, ids: list[int]) -> bytes:
        count, last, skip, inside, size, pieces = [0], [-1], 0, self.inside, self.size, self.ids
        for piece in ids:
            if skip:
                skip -= 1
                continue
            at, left = len(count) - 1, last[-1]
            if self.is_byte[piece]:
                skip = len(unit[at].encode("utf-8", "surrogatepass")) - 1
                count.append(count[-1] + skip + 1)
                last.append(-1)
                continue
            key = left * size + piece
            if key in inside:
                got = inside[key]
            else:
                if len(inside) > PAIRS_KEPT:
                    inside.clear()
                got = inside[key] = self._inside(left, piece)
            if got:
                base = count[-1]
                count += [base + x for x in got[0]]
                last += got[1]
                continue
            for end in range(at + 1, at + len(self.pieces[piece])):
                for begin in range(max(0, end - self.longest), end):
                    other = pieces.get(unit[begin:end])
                    if other is not None:
                        ok = self.pairs.get(last[begin] * size + other)
                        if ok or ok is None and self._follows(last[begin], other):
                            count.append(count[begin] + 1)
                            last.append(other)
                            break
                else:  # a character outside the vocabulary: one token a byte
                    count.append(count[-1] + len(unit[end - 1].encode("utf-8", "surrogatepass")))
                    last.append(-1)
            count.append(count[at] + 1)
            last.append(piece)
        return bytes([(y - x) & 255 for x, y in zip(count, count[1:])])

    def deltas(self, texts: list[str]) -> list[bytes]:
        """Of each text, one signed byte per character: by how much the token count changes there."""
        if len(self.known) > UNITS_KEPT:
            self.known = {}
        known = self.known
        split = [_UNITS("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
        new = set()
        for units in split:
            new.update([u for u in units if u not in known])
        new = list(new)
        look, extra = known, {}
        for u, ids in zip(new, self._encode(new) if new else ()):
            (known if len(u) <= UNIT_LONGEST else extra)[u] = self._unit(u, ids)
        if extra:
            look = {u: extra.get(u) or known[u] for units in split for u in units}
        out = []
        for units in split:
            d = bytearray(b"".join([look[u] for u in units]))
            if d:
                d[1] = (d[0] + d[1]) % 256  # the leading mark is no character of the text
            out.append(bytes(d[1:]))
        return out


_UNITS = re.compile("▁+[^▁\n]*|[^▁\n]+|\n").findall
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # the marks of _PARTS
_PARTS = re.compile(r"[^\W\d_]+|[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+").findall


def loaded(kind, path: str):
    """One per worker process."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def _groups(column, most: int = 2 << 20) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column (null: empty) in groups of bounded length, with the index of the first."""
    part, first, size = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        part.append(t)
        size += len(t)
        if size > most:
            yield first, part
            part, first, size = [], i + 1, 0
    if part:
        yield first, part


def token_pieces(docs: DataFrame, path: str, most: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and an end id, cut into pieces of `most` ids.

    A null or empty text has only the end id: one piece of length 1. Repeated rows give repeated pieces, a
    null doc_id stays null, other columns are ignored."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokenizer = loaded(WordTokenizer, path)
        for batch in batches:
            ids = batch.column(0)
            for first, texts in _groups(batch.column(1)):
                rows = ([], [], [], [], [])
                for i, raw in enumerate(tokenizer.ids(texts)):
                    raw += end
                    total = len(raw) // 4
                    for k, start in enumerate(range(0, total, most)):
                        length = min(most, total - start)
                        for values, v in zip(rows, (first + i, k, start, length, zlib.crc32(raw[4 * start:4 * (start + length)]))):
                            values.append(v)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(v, pa.int64()) for v in rows[2:])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
        tokenizer.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, prefix_deltas of every text. The running sum of prefix_deltas (signed bytes, one
    per character) is the exact token count of every prefix; its total is n_tokens.

    A null or empty text has no bytes and no tokens. Repeated rows give repeated results, other columns are ignored."""

    def run(batches):
        counter = loaded(PieceCounter, path)
        for batch in batches:
            for first, texts in _groups(batch.column(1)):
                deltas = counter.deltas(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), batch.column(2).slice(first, len(texts)),
                     pa.array([int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in deltas], pa.int64()),
                     pa.array(deltas, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "prefix_deltas"])
        counter.forget()

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, prefix_deltas binary")


def tokens_before(deltas: bytes, n_chars: int) -> int:
    """Token count of the first n_chars characters."""
    return int(np.frombuffer(deltas, np.int8)[:n_chars].sum(dtype=np.int64))


def longest_prefix(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most `budget` tokens. Counts can fall when a character is added,
    so the last prefix within the budget is looked for, not the first beyond it."""
    within = np.flatnonzero(np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def truncate(counted: DataFrame, budget: int) -> DataFrame:
    """Adds keep_chars: how much of each text fits the budget. Reads the stored counts, encodes nothing."""
    schema = T.StructType([*counted.schema.fields, T.StructField("keep_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            keep = [longest_prefix(d.as_py() or b"", budget) for d in batch.column("prefix_deltas")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keep, pa.int64())], [*batch.schema.names, "keep_chars"])

    return counted.mapInArrow(run, schema)
