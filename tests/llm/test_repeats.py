"""Suffix arrays and repeats against plain versions."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("llm.queries")

from llm import repeats, suffixes  # noqa: E402
from llm.queries import QUERIES  # noqa: E402


def plain(rows, width):
    """rows: (doc_id, text) -> sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), []
    for _, doc_id, raw in sorted((r[0] is None, r[0] or 0, (r[1] or "").encode()) for r in rows):
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            s = raw[i:i + width]
            if s in seen:
                gone[i:i + width] = b"\1" * width
            seen.add(s)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((None if _ else doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect()], key=str)


def texts(seed, many, letters="ab", longest=400):
    rng = random.Random(seed)
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(many)]
    for _ in range(many):
        a, b = rng.choice(out), rng.choice(out)
        cut = rng.randrange(len(a) + 1)
        out.append(a[:cut] + b[cut // 2:])
    return out + ["a" * 500, "ab" * 300, "", "é" * 200, "b" * 20]


def test_suffix_array_and_prefixes():
    for seed in range(6):
        strings = [t.encode() for t in texts(seed, 12, "abc" if seed % 2 else "a", 60)]
        symbols, begin = suffixes.layout(strings)
        words = suffixes.words_of(symbols)
        order = suffixes.suffix_array(symbols, words)
        places = [(s[i:], int(b) + i) for s, b in zip(strings, begin) for i in range(len(s))]
        assert order.tolist() == [p for _, p in sorted(places, key=lambda x: ([c + 1 for c in x[0]] + [0], x[1]))]
        by_place = {p: s for s, p in places}
        long = order[[len(by_place[p]) >= 9 for p in order.tolist()]]
        want = [0] + [next((k for k in range(9) if by_place[a][k] != by_place[b][k]), 9) for a, b in zip(long.tolist(), long[1:].tolist())]
        assert suffixes.common_prefixes(long, words, 9).tolist() == want[:len(long)]


def test_prefixes_near_powers_of_two():
    strings = [bytes([255] * 7 + [255, 254, x]) + b"zzzzzzz" for x in (0, 1, 127, 128, 255)] + [bytes([255] * 17)]
    symbols, begin = suffixes.layout(strings)
    words = suffixes.words_of(symbols)
    assert suffixes.common_prefixes(begin, words, 12).tolist() == [0, 9, 9, 9, 9, 8]


@pytest.mark.parametrize("width,group,batch", [(100, 2048, 1 << 20), (12, 3, 200), (7, 2, 1)])
def test_against_plain(shipped, monkeypatch, width, group, batch):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "BATCH_BYTES", batch)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(repeats, "ASKED_BYTES", 4000)
    rows = list(enumerate(texts(width, 40, "ab" if width < 50 else "abcdefgh ")))
    random.Random(1).shuffle(rows)
    rows = [(3 * i - 50, t) for i, t in rows] + [(None, "ab" * 60), (900, None)]
    df = shipped.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(repeats.digested(repeats.removed_repeats(df, width))) == plain(rows, width)


def test_one_passage_in_all_documents(shipped, monkeypatch):
    """A hot passage with other bytes around it in every document: its outer anchors are dealt over several parts."""
    monkeypatch.setattr(repeats, "GROUP", 16)
    rng = random.Random(4)
    rand = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = rand(260)
    rows = [(i, rand(rng.randrange(150)) + passage + rand(rng.randrange(150))) for i in range(400)]
    df = shipped.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(repeats.digested(repeats.removed_repeats(df))) == plain(rows, 100)


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(repeats.digested(repeats.removed_repeats(odd))) == plain(rows, 100)
    assert repeats.removed_repeats(nothing).collect() == []


def test_query_on_its_table(shipped):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in shipped.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got(QUERIES["op13_two_stage_suffix_dedup"](shipped, folder)) == plain(rows, 100)
    assert np.mean([r[2] > 0 for r in plain(rows, 100)]) > 0
