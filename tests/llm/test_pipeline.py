"""The pipeline on a small corpus, each stage against a plain version of what it has to do."""
import random
import re

import corpus_pipeline as cp
from llm import secrets
from test_groups import plain_join


def corpus():
    pick = random.Random(11)
    good = lambda n: " ".join(pick.choice(["plain", "words", "of", "prose", "and", "rest", "more", "text", "here", "now"]) + str(pick.randrange(40)) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(160):
        if i % 8 == 7:
            text = " ".join(pick.choice(["BUY", "NOW!!", "###", "CLICK", "***"]) for _ in range(50))
        elif i % 8 == 6 and i > 8:
            text = rows[i - 6][1].replace(" ", " ", 1) + (" tail" if i % 16 == 6 else "")
        else:
            text = good(pick.randrange(20, 90))
        if i % 20 == 3:
            text += ' token="abcdefghij12" and ' + "ab12" * 9
        rows.append((i, text, "en", f"s{i % 4}" if i % 5 else None, len(text)))
        labels.append((i, 0 if i % 8 == 7 else 1, 0))
    rows += [rows[2], (500, None, "en", "s1", None), (501, "", "en", "s1", 0)]
    return rows, labels


def test_stages(shipped, tmp_path):
    rows, labels = corpus()
    shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shipped.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, out = shipped.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for i, (name, function) in enumerate(cp.STAGES):
        function(shipped, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = shipped.read.parquet(f"{tmp_path}/{i}")
        out.append(docs.collect())
        assert i == 4 or docs.columns == columns, name
    rated, single, clean, mixed, packed = out

    assert {r.doc_id for r in rated} == {r[0] for r in rows if r[0] % 8 != 7 or r[0] >= 500}

    want, low, top = plain_join([(r.doc_id, r.text) for r in rated], 5, 80)
    keep = {min(ids) for t, ids in low.items()}
    assert sorted(r.doc_id for r in single) == sorted(keep)

    text = {r.doc_id: r.text for r in single}
    for r in clean:
        if r.text is not None:
            assert r.n_chars == len(r.text) and not any(len(m.group(x.group)) >= x.least for x in secrets.RULES for m in re.finditer(x.pattern, r.text, re.ASCII))
            assert ("[SECRET]" in r.text) == (r.text != text[r.doc_id])

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source, taken = {}, {}
    for r in clean:
        source[r.source] = source.get(r.source, 0) + size(r.text)
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        assert ({x.doc_id: x.text for x in clean}[r.doc_id]).startswith(r.text)
    order = sorted(s for s in source if s) + [None]
    total, weight = sum(source.values()), {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    for s in order:  # no source reaches three times its size here
        assert abs(taken[s] - total * weight[s] / sum(weight.values())) <= 1

    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= cp.SEQUENCE and sorted(b)[0][0] == 0 for b in bins.values())
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(r.doc_id for r in mixed)
    again = cp.run(shipped, str(tmp_path))
    assert sorted(map(str, again.drop("sequence_id", "offset").collect())) == sorted(map(str, [type(r)(**{k: v for k, v in r.asDict().items() if k not in ("sequence_id", "offset")}) for r in packed]))
