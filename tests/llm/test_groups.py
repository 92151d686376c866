"""Operators on several rows at once, each against brute force."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import components, jaccard, neighbours, urls


def closure(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(shipped):
    pick = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(pick.randrange(200, 300), pick.randrange(200, 300)) for _ in range(70)] + [(500, 501)] * 2
    pick.shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(shipped.createDataFrame(edges + [(5, 5), (None, 3)], "a long, b long")).collect()}
    assert got == closure(edges, {x for e in edges if e[0] != e[1] for x in e})
    assert components.connected_components(shipped.createDataFrame([], "a long, b long")).count() == 0


def plain_join(rows, words, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w)} if 0 < len(w) < words else {tuple(w[i:i + words]) for i in range(len(w) - words + 1)})
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    top = closure(pairs, range(len(rows)))
    low = {}
    for i, t in top.items():
        low.setdefault(t, []).append(rows[i][0])
    return [(rows[i][0], len(sets[i]), rows[i][0] if not sets[i] else min((x for x in low[t] if x is not None), default=None)) for i, t in top.items()], low, top


@pytest.mark.parametrize("words, percent", [(4, 85), (2, 60)])
def test_join(shipped, odd, words, percent, monkeypatch):
    """Families of near copies around the limit, passages shared by many, and the odd rows; small blocks and few queries a task."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "QUERIES", 5)
    pick = random.Random(words)
    word = lambda: f"w{pick.randrange(3000)}"
    passage, rows = [word() for _ in range(30)], []
    for _ in range(25):
        text = [word() for _ in range(pick.randrange(5, 90))] + passage * pick.randrange(2)
        rows.append(text)
        for _ in range(pick.randrange(12)):
            copy = list(pick.choice(rows[-3:]))
            for _ in range(pick.randrange(4)):
                copy[pick.randrange(len(copy))] = word()
            rows.append(copy)
    pick.shuffle(rows)
    rows = [(i * 3 % 1000, " ".join(t)) for i, t in enumerate(rows)] + [(r.doc_id if r.doc_id is None else r.doc_id + 5000, r.text) for r in odd.collect()]
    got = jaccard.join(shipped.createDataFrame(rows, "doc_id long, text string").repartition(6), jaccard.Rule(words, percent))
    want = plain_join(rows, words, percent)[0]
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str) == sorted(want, key=str)


def test_keep_one(shipped, odd, nothing):
    got = [r.doc_id for r in jaccard.keep_one(odd).collect()]
    assert sorted(got, key=str) == sorted([1, 4, 5, 6, 7, 9, 10, 11, None], key=str)  # 2 and 3 are copies of 1, 8 of 7
    assert jaccard.keep_one(nothing).count() == 0


def test_search(shipped):
    pick = np.random.default_rng(4)
    x = pick.normal(size=(900, 24)).astype(np.float32)
    x[10:20] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] + [1.0] * 23), (2050, [1.0, 2.0]), (None, [1.0] * 24), (0, x[0].tolist())]
    table = shipped.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = neighbours.search(table, lambda c: c % 50 == 0, settings=neighbours.Settings(block_rows=200, query_rows=7)).collect()
    unit = x.astype(float)
    norms = np.linalg.norm(unit, axis=1)
    hits, by = 0, {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(by) == list(range(0, 900, 50))
    for q, found in by.items():
        score = unit @ unit[q] / (norms * norms[q])
        assert [f[0] for f in sorted(found)] == [1, 2, 3, 4, 5] and all(abs(score[f[1]] - f[2]) < 1e-12 and f[1] != q for f in found)
        score[q] = -9
        hits += len({f[1] for f in found} & set(np.lexsort((np.arange(900), -score))[:5].tolist()))
    assert hits >= 0.9 * 5 * len(by) and [f[1] for f in sorted(by[0])] == [10, 11, 12, 13, 14]
    assert neighbours.search(table.limit(0), lambda c: c % 50 == 0).count() == 0
    two = shipped.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(two, lambda c: c % 50 == 0).collect()] == [(0, 1, 1)]


def test_tables_hold_the_radius():
    pick = np.random.default_rng(1)
    codes = pick.integers(0, 256, (500, 4), dtype=np.uint8)
    tables = neighbours.Tables(codes)
    for q in codes[:20]:
        for radius in (0, 3, 9, 14):
            want = np.flatnonzero([bin(int.from_bytes((c ^ q).tobytes(), "big")).count("1") <= radius for c in codes])
            assert (tables.within(q, radius) == want).all()


def test_urls(shipped):
    to = '<link rel="canonical" href="%s">'
    rows = [(1, "http://a.net/x#f", to % "http://b.example.org/es/1"), (2, "http://c.net/", to % "http://a.net/x"), (3, "http://b.example.org/es/1", ""),
            (4, "http://free.org/q", to % "http://c.net/"), (5, None, None), (6, "nourl", ""), (7, "HTTP://A.COM/de/x?y", ""), (7, "HTTP://A.COM/de/x?y", ""),
            (8, "http://d.net/p", '<META http-equiv="refresh" content="0; url=/q">'), (9, "http://d.net/q", to % "http://e.com/de/1"), (10, "http://EXAMPLE.org", None), (11, "http://xorg.net/", None)]
    pages = shipped.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' AS host", "'old' AS verdict", "'x' AS action")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == {1: ("a.net", "/x", None, "allow"), 2: ("c.net", "/", None, "allow"), 3: ("b.example.org", "/es/1", "example.org/es/", "block"),
                   4: ("free.org", "/q", "org/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("a.com", "/de/x", "com/de/", "block"),
                   8: ("d.net", "/p", None, "block"), 9: ("d.net", "/q", None, "block"), 10: ("example.org", "", None, "allow"), 11: ("xorg.net", "/", None, "allow")}
    more = shipped.createDataFrame([("http://xorg.net/", "http://d.net/p"), (None, "x")], "source string, target string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, redirects=more).collect()}[11] == "block"
    assert urls.judge(pages.limit(0)).count() == 0


def test_tags_are_read_attribute_by_attribute(shipped):
    cases = {"""<link rel="canonical" href="https://x.com/de/it's">""": ["https://x.com/de/it's"], """<LINK HREF='/a"b' REL=canonical/>""": ['/a"b'],
             '<link data-href="/no" rel="canonical" href="/yes">': ["/yes"], '<link rel="alternate Canonical" href=/yes>': ["/yes"],
             '<link title="a > b" rel="canonical" href="/yes">': ["/yes"], '<!-- <link rel="canonical" href="/no"> --><p>': [],
             '<script>"<link rel=canonical href=/no>"</script><link rel=canonical href=/yes>': ["/yes"], '<!--><link rel=canonical href=/yes>': ["/yes"],
             '<link rel="canonical" href="/first" href="/second">': ["/first"], '<link rel="canonical" href="/never ended>': [], "<link rel=canonical": [],
             '<linked rel=canonical href=/no>': [], '<link rel="canonical" href="">': [], "<link rel=canonical href=it's-me >": ["it's-me"],
             '<link rel="not-canonical" href="/no">': [], '<a title="<!--"><link rel="canonical" href="/yes">': ["/yes"], '<link rel="canonical" href="/a?x=1&amp;y=2">': ["/a?x=1&y=2"],
             '<meta http-equiv=refresh content="0; url=/q r">': ["/q r"], """<meta content="5;URL='/it'" http-equiv="Refresh">""": ["/it"], '<meta http-equiv=refresh content=5>': [],
             '<meta http-equiv="refresh" content="3, /next">': ["/next"], '<meta http-equiv="refresh" content="url=/n">': ["/n"], "<p title='a>b' x=\"<link rel=canonical href=/no>\"><title><link rel=canonical href=/no></title>": [], '<meta name="refresh" content="0; url=/no">': [], "": []}
    for html, want in cases.items():
        assert urls.references(html) == ("", want), html
    assert urls.references("<base target=x><base href=/one/><base href=/two/><link rel=canonical href=a>") == ("/one/", ["a"])
    source = "http://x.com/p"
    pages = shipped.createDataFrame([(source, h) for h in cases if "it's\"" in h], "url string, html string")
    assert [(r.source, r.target) for r in urls.declared_links(pages).collect()] == [(source, "https://x.com/de/it's")]


def test_columns_of_any_name_stay(shipped):
    rows = [(1, "http://a.net/x", '<link rel="canonical" href="http://e.com/de/1">')]
    pages = shipped.createDataFrame(rows, "page_id long, url string, html string")
    clash = ["_node", "_rule", "_blocked", "_page", "_at", "action", "component", "source", "node", "a.b"]
    pages = pages.select("*", *[F.lit(c).alias(c) for c in clash])
    got = urls.judge(pages)
    assert got.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    assert got.collect()[0].asDict() == {**pages.collect()[0].asDict(), "host": "a.net", "path": "/x", "rule": None, "verdict": "block"}


def test_every_form_of_target(shipped):
    page = "http://Q.net/a/b/c?x=1#f"
    forms = {"p2.html": "/a/b/p2.html", "./p": "/a/b/p", "../x": "/a/x", "../../../x": "/x", "?id=3": "/a/b/c?id=3", "/r/./s/../t": "/r/t", "..": "/a/",
             "/u?a=1&amp;b=2": "/u?a=1&b=2", "//q.net/v//w": "/v//w", "HTTP://Q.NET/y": "/y", "http:z": "/a/b/z", "go?to=http://else.net/": "/a/b/go?to=http://else.net/"}
    rows = [(i, page, f'<link rel="canonical" href="{to}">') for i, to in enumerate(forms)]
    rows += [(50, page, '<meta http-equiv="refresh" content="0; url=n1">'), (51, page, '<base href="/k/"><link href="n2" rel="canonical">'),
             (52, page, '<link rel="canonical" href="mailto:me@q.net">'), (53, "http://q.net", '<link rel="canonical" href="top">'), (54, "http://q.net/l/../m?n", "")]
    pages = shipped.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.source, r.target) for r in urls.declared_links(pages).collect()}
    at = "http://q.net"
    assert got == {(at + "/a/b/c?x=1", at + to) for to in [*forms.values(), "/a/b/n1", "/k/n2"]} | {(at, at + "/top"), (at + "/l/../m?n", at + "/m?n")}
    alias = shipped.createDataFrame([(1, "http://c.com/fr2/a", '<link rel="canonical" href="../de/1?x=1&amp;b=2">'), (2, "http://c.com/de/1?x=1&b=2", "")], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge(alias).collect()} == {1: "block", 2: "block"}


def test_keep_one_loses_no_component(shipped):
    """One doc_id over texts of two components, clashing column names, repeated rows, rows without words."""
    words = lambda p: " ".join(f"{p}{i}" for i in range(80))
    near = words("a").replace("a79", "other")
    rows = [(5, words("a")), (7, near), (5, words("b")), (9, words("b")), (9, words("c")), (9, words("c")), (None, words("d")), (None, words("d")), (None, near),
            (4, None), (4, None), (4, " ")]
    df = shipped.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, id string, key string, often string").repartition(4)
    kept = jaccard.keep_one(df, jaccard.Rule(words=5, percent=80))
    assert kept.columns == df.columns
    want = [(5, words("a")), (5, words("b")), (9, words("c")), (None, words("d")), (4, None), (4, None), (4, " ")]
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == sorted(want, key=str)
