"""Manifest against a plain tree; the query's SQL twin is compared by the driver and in test_query."""

import hashlib
import zlib

import pytest

pytest.importorskip("llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from llm import merkle  # noqa: E402
from llm.queries import ORACLE, QUERIES  # noqa: E402


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def grow(nodes):
    """Levels of one tree from its leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        out.append(("".join(level[first:at]), "".join(level[at + 1:first + 16])))
        at //= 16
    return out


def plain(rows):
    """(doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: grow([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    over = grow([grown[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, x in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            out.append((x[1] if x[0] else None, x[2], grown[s][-1][0], over[-1][0], way(grown[s], i) + way(over, k)))
    return sorted(out, key=str)


def made(df):
    leaf = merkle.digest(merkle.encoded(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    return merkle.manifest(df, leaf)


def listed(df):
    return sorted([(r["key"], r["leaf"], r["subroot"], r["root"], [(s["left"], s["right"]) for s in r["proof"]]) for r in df.collect()], key=str)


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd.collect()]
    assert listed(made(odd)) == plain(rows)
    assert made(nothing).collect() == []


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17}, {"b": 300, None: 2, "": 1, "é": 33}, {f"s{i}": 1 + i % 3 for i in range(40)} | {"hot": 4200}])
def test_heights(shipped, sizes):
    rows, k = [], 0
    for source, many in sizes.items():
        for _ in range(many):
            rows.append(((k * 7919) % 100_003, source, "en", k, f"text {k}"))
            k += 1
    df = shipped.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    got = made(df)
    assert listed(got) == plain(rows)
    assert got.filter(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_query(shipped):
    import duckdb

    folder = "/root/testdata/sf0.001"
    got = QUERIES["op12_merkle_manifest"](shipped, folder).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cur = con.execute(ORACLE["op12_merkle_manifest"])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(cur.fetchall())
    for r in got:  # what was tampered with and has capitals no longer leads to the root
        assert r["verified"] or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    assert not all(r["verified"] for r in got)
