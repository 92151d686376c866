"""Operators on single texts, each against a plain version, on odd input too."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import fingerprints, lm, mixing, packing, quality, secrets, shingles, tokens
from llm.queries import tokenizer_file

WORDS, PIECES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("piece_bpe_32k.model")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_pieces_equal_the_library(odd, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    got = sorted((r for r in tokens.token_pieces(odd, WORDS, 256).collect()), key=str)
    want = []
    for doc_id, text in texts(odd):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[start:start + 256], "<u4")
            want.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted((type(got[0])(doc_id=w[0], piece=w[1], start=w[2], length=w[3], ids_crc32=w[4]) for w in want), key=str)]
    assert tokens.token_pieces(nothing, WORDS, 256).count() == 0


def test_word_units():
    tokenizer = tokens.WordTokenizer(WORDS)
    some = ["don't it's, I'M <|endoftext|>x<|ENDOFTEXT|>", "a\tb\x1cc\x85d e", "12 3,4..5 ,, .a", "ΑΣ, Ḵ é́ İI", "", "  a  b ", "raóes### A!!"]
    for text, raw in zip(some, tokenizer.ids(some)):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.library.encode(text, add_special_tokens=False).ids


def test_every_prefix_is_exact():
    counter = tokens.PieceCounter(PIECES)
    pick = random.Random(5)
    some = ["".join(pick.choice("ab  the\n▁é日<s>0 .,ingXß") for _ in range(pick.randrange(1, 40))) for _ in range(300)] + ["", " ", "x" * 300, "<unk> <0x0A>"]
    for text, deltas in zip(some, counter.deltas(some)):
        counts = [len(counter.library.encode(text[:j])) if j else 0 for j in range(len(text) + 1)]
        assert [tokens.tokens_before(deltas, j) for j in range(len(text) + 1)] == counts
        fits = [j for j, c in enumerate(counts) if c <= 7 and j]
        assert tokens.longest_prefix(deltas, 7) == (fits[-1] if fits else 0)


def test_counts(odd, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.prefix_counts(odd, PIECES).collect()), key=str)
    assert got == sorted(((i, len(t.encode()), len(library.encode(t))) for i, t in texts(odd)), key=str)
    kept = tokens.truncate(tokens.prefix_counts(odd, PIECES), 5).filter("doc_id = 1").first()
    assert len(library.encode(dict(texts(odd))[1][:kept.keep_chars])) <= 5
    assert tokens.prefix_counts(nothing, PIECES).count() == 0


@pytest.mark.parametrize("cap", [packing.Capacity(16, 16, 256.0), packing.Capacity(16, 3, 256.0), packing.Capacity(16, 16, 140.0), packing.Capacity(16, 4, 200.0, rule="dot")])
def test_packing_keeps_every_capacity(shipped, cap):
    pick = random.Random(3)
    top = int(min(16, cap.attention ** 0.5))
    lengths = [pick.choice([1, 2, 3, 5, 5, 5, 7, 9, top]) for _ in range(400)] + [0, None]
    df = shipped.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(5)
    rows = packing.pack(df.withColumn("sequence_id", F.lit("old")), cap).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    bins = {}
    for r in rows:
        assert (r.sequence_id is None) == (not r.length)
        if r.length:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))]
        assert sum(n for _, n in b) <= cap.tokens and len(b) <= cap.pieces and sum(n * n for _, n in b) <= cap.attention + 1e-6
    if cap.pieces == 16 and cap.attention == 256.0:
        assert len(bins) <= -(-sum(n or 0 for n in lengths) // 16) + 1
    assert packing.pack(df.limit(0), cap).count() == 0
    with pytest.raises(ValueError):
        packing.pack(shipped.createDataFrame([(1, 17)], "doc_id long, length long"), cap)


def plain_spans(text):
    out = []
    for rank, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text, re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), rank, m.end(), r.kind))
    return [(a, c, d) for a, _, c, d in sorted(out)]


def test_secrets(odd, nothing):
    pick = random.Random(8)
    made = ["".join(pick.choice(['password', '="', 'Token: ', 'api_key', "='", 'AKIA', 'ABCDEF012345', 'deadbeef' * 4, ' ', 'é😀', 'abcdefghij', '\n', 'sEcReT=']) for _ in range(pick.randrange(30)))
            for _ in range(200)]
    df = odd.sparkSession.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    for frame in (df, odd):
        for r in secrets.scan(frame).collect():
            assert [tuple(s) for s in r.secret_spans] == plain_spans(r.text or "")
    clean = {r.doc_id: r.text for r in secrets.redact(secrets.scan(odd)).collect()}
    assert clean[11] == '[SECRET]" [SECRET]' and clean[4] is None
    assert secrets.scan(nothing).count() == 0


def test_trigram_queries_never_miss():
    assert secrets.trigram_query("[0-9a-f]+") is None and secrets.trigram_query("ab|xyz") is None

    def fits(q, t):
        return q is None or (q[1] in t if q[0] == "tri" else all(fits(x, t) for x in q[1:]) if q[0] == "and" else any(fits(x, t) for x in q[1:]))

    samples = {"(?:foo|barb)+[0-9]{2}key": ["foo12key", "barbfoo99key"], "se(cr)?et_[ab]": ["seet_a", "secret_b"], "x{0,3}token(?:=|:)\\w+": ["token=a", "xxtoken:z"]}
    assert not fits(secrets.trigram_query("(?i:abcd)x?"), "abce bcf") and fits(secrets.trigram_query("(?i:abcd)x?"), "abcd")
    for pattern, matches in samples.items():
        assert all(re.search(pattern, m) and fits(secrets.trigram_query(pattern), m) for m in matches)


def test_mixing(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    for s in order:
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] and r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 0.5 + 1e-6
    copies = mixing.copies(mixing.mix(odd)).collect()
    assert sum(c.words for c in copies) == sum(r.taken for r in rows) and all(0 <= c.position <= 1 for c in copies)
    out = mixing.mixed_documents(odd.dropDuplicates(["doc_id", "text"])).collect()
    assert sum(len(re.findall(mixing.WORD, r.text)) for r in out) == sum(r.taken for r in mixing.mix(odd.dropDuplicates(["doc_id", "text"])).collect())
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0



def test_training_order_follows_the_schedule(shipped):
    """Files read in order give positions that never fall, and by any time a source has given its integrated weight's share of words."""
    docs = shipped.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 7 = 0 THEN 'b' ELSE 'c' END AS source",
                                          "repeat('w ', CAST(1 + id % 11 AS INT)) AS text")
    mixed = mixing.mix(docs)
    ordered = mixing.in_training_order(mixing.copies(mixed))
    copies = ordered.collect()
    at = [r.position for r in copies]
    assert len(at) > 4000 and at == sorted(at)
    found = {}
    for r in copies:
        found.setdefault((r.place, r.source), []).append((r.position, r.words))
    for (place, _), rows in found.items():
        start, end = mixing.SCHEDULE[place]
        total = sum(w for _, w in rows)
        for t in (0.1, 0.25, 0.5, 0.8, 1.0):
            due = total * (start * t + (end - start) * t * t / 2) / ((start + end) / 2)
            assert abs(sum(w for p, w in rows if p <= t) - due) <= 11
    first = {r.doc_id: r.position for r in mixed.withColumn("position", mixing.first_position(mixed)).collect()}
    least = {}
    for r in copies:
        least[r.doc_id] = min(r.position, least.get(r.doc_id, 2.0))
    assert {d: p for d, p in first.items() if p is not None} == least


def test_due_inverts_the_schedule(shipped):
    for start, end in mixing.SCHEDULE:
        for share in (0.0, 0.1, 0.5, 0.9, 1.0):
            t = shipped.range(1).select(mixing.due(F.lit(share), F.lit(start), F.lit(end))).first()[0]
            assert abs((start * t + (end - start) * t * t / 2) / ((start + end) / 2) - share) < 1e-9


def test_fingerprints(odd, nothing, monkeypatch):
    monkeypatch.setattr(fingerprints, "CHUNK_BYTES", 9000)
    rows = [(-(10**18) if i is None else i, t) for i, t in texts(odd)]
    rows.sort(key=lambda r: (-r[0], r[1]))

    def sign(t):
        return fingerprints.signature(fingerprints.hashes(fingerprints.parse(t, set())[0]))

    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edit = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        want.append((None if i == -(10**18) else i, len(t), hashlib.sha256(edit.encode()).hexdigest(), fingerprints.written(sign(t)), fingerprints.written(sign(edit)),
                     fingerprints.likeness(sign(t), sign(edit)), fingerprints.likeness(sign(t), sign(after))))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.fingerprint(odd).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert fingerprints.fingerprint(nothing).count() == 0


def test_lm_counts(odd, nothing):
    flagged = odd.withColumn("good", F.when(F.col("doc_id") < 4, True))
    aim, background = lm.fit(flagged, "good")
    assert background.words.sum() == sum(len(re.findall(mixing.WORD, t)) for _, t in texts(odd))
    assert aim.words.sum() == 180 and aim.pairs.sum() == aim.contexts.sum() == 180
    got = {r.doc_id: r for r in lm.score(odd, aim, background).collect()}
    assert got[4].n_words == 0 and got[4].difference is None and got[1].difference < got[7].difference
    aim, background = lm.fit(flagged.limit(0), "good")
    assert lm.score(nothing, aim, background).count() == 0 and background.words.sum() == 0


@pytest.mark.parametrize("block", [lm.BLOCK, 500])
def test_lm_scores_equal_exact_counts(shipped, odd, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "SLICE", block // 5)
    pick = random.Random(4)
    made = [(100 + i, " ".join(f"w{int(pick.paretovariate(0.1)) % 10**6}" for _ in range(pick.randrange(300)))) for i in range(400)]
    docs = odd.select("doc_id", "text").union(shipped.createDataFrame(made, "doc_id long, text string")).repartition(3)
    docs = docs.withColumn("good", F.when(F.col("doc_id") % 3 == 0, True))
    rows = [(i, re.findall(mixing.WORD, t.translate({c: c + 32 for c in range(65, 91)}))) for i, t in texts(docs)]
    models = []
    for chosen in ([w for i, w in rows if i is not None and i % 3 == 0], [w for _, w in rows]):
        words, contexts, pairs = Counter(), Counter(), Counter()
        for w in chosen:
            words.update(w)
            contexts.update([None, *w[:-1]][:len(w)])
            pairs.update(zip([None, *w], w))
        models.append((words, contexts, pairs))
    v = len(models[1][0])
    assert v > 15_000

    def loss(model, w, less):
        words, contexts, pairs = model
        own_words, own_contexts, own_pairs = (Counter(x) if less else Counter() for x in (w, [None, *w[:-1]], zip([None, *w], w)))
        n = sum(words.values()) - sum(own_words.values()) + v
        return sum(-np.log((pairs[a, b] - own_pairs[a, b] + 20 * (words[b] - own_words[b] + 1) / n) / (contexts[a] - own_contexts[a] + 20))
                   for a, b in zip([None, *w], w)) / len(w)

    for scored, apart in ((lm.difference(docs, "good"), True), (lm.score(docs, *lm.fit(docs, "good")), False)):
        held = [(i, w, (apart and i is not None and i % 3 == 0, apart)) for i, w in rows]
        want = sorted(((i, len(w), *([loss(m, w, x) for m, x in zip(models, less)] if w else (None, None))) for i, w, less in held), key=str)
        got = sorted(((r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in scored.collect()), key=str)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a[:2] == b[:2] and (a[2:] == b[2:] or np.allclose(a[2:], b[2:], rtol=1e-9))


def test_lm_tells_kind_not_membership(shipped):
    """Unlabelled documents of the target's kind score like target documents, and a text that occurs twice is known to the background."""
    pick = random.Random(9)

    def text(words):
        return " ".join([pick.choice(words) for _ in range(60)] + [f"own{pick.randrange(10**9)}" for _ in range(20)])

    kinds = [["plain", "prose", "of", "the", "town", "and", "rest"], ["buy", "now", "the", "cheap", "and", "best"]]
    made = [(i, text(kinds[i % 2]), i % 4 == 0) for i in range(200)]
    docs = shipped.createDataFrame(made + [(1000, made[2][1], False)], "doc_id long, text string, good boolean")
    got = {r.doc_id: r for r in lm.difference(docs, "good").collect()}
    labelled, same, other = (np.mean([got[i].difference for i in range(k, 200, 4)]) for k in (0, 2, 1))
    assert abs(labelled - same) < 0.1 * (other - same)
    assert got[2].background_loss == got[1000].background_loss < min(got[i].background_loss for i in range(200) if i != 2) - 1


def test_quality(shipped, odd, nothing):
    pick = random.Random(2)
    good = [" ".join(pick.choice(["plain", "words", "of", "prose", "and", "rest"]) for _ in range(60)) + "." for _ in range(120)]
    bad = [" ".join(pick.choice(["BUY", "NOW!!", "###", "CLICK", "***"]) for _ in range(60)) for _ in range(60)]
    docs = shipped.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = shipped.createDataFrame([(i, int(i < 120), 0) for i in range(180)] + [(0, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.training_labels(labels))
    rows = quality.score(docs.withColumn("_score", F.lit(9)), model, "_score").collect()
    assert all((r._score >= 0.5) == (r.doc_id < 120) for r in rows) and len(model.vectors) < 180
    assert all(0 <= r.quality_score <= 1 for r in quality.score(odd, model).collect())
    assert quality.score(nothing, model).count() == 0
    empty = quality.fit(docs, labels.limit(0).select("doc_id", F.col("quality").alias("label")))
    assert {r.quality_score for r in quality.score(docs, empty).collect()} == {0.5}


def test_terms_do_not_leak_between_texts():
    import pyarrow as pa

    some = ["AB cd cd!! 12", None, "", "zz", "AB cd cd!! 12"]
    together = quality.terms(pa.array(some))
    for row, text in zip(together, some):
        assert (row == quality.terms(pa.array([text], pa.string()))[0]).all()
    assert together[0][quality.PAIRS] == 4 and together[1].sum() == 0


def test_shingles():
    import pyarrow as pa

    sets = list(shingles.shingle_sets(pa.array(["a b c d e", "A B c d\te", "a b", "b a", None, " ", "a b c"]), 4))
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 1] and (sets[0] == sets[1]).all() and sets[2] != sets[3]


def test_quality_votes_equal_a_plain_vote(shipped):
    """Every score is the plain vote: cosines with all labelled vectors, one by one, the nearest ones weighted by similarity."""
    pick = random.Random(6)
    words = ["plain", "prose", "of", "the", "TOWN", "and", "rest!!", "###", "buy", "1999", "it's"]
    texts_ = [" ".join(pick.choice(words) for _ in range(pick.randrange(1, 40))) for _ in range(300)]
    docs = shipped.createDataFrame(list(enumerate(texts_)) + [(300, ""), (301, None), (302, texts_[0])], "doc_id long, text string").repartition(5)
    labels = shipped.createDataFrame([(i, int("###" in t), 0) for i, t in enumerate(texts_)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.training_labels(labels))
    fitted = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    assert len(model.vectors) == len(fitted) and sorted(model.labels) == sorted(float("###" in texts_[i]) for i in fitted)

    def vector(text):
        counts = quality.terms(pa.array([text]))[0].astype(float)
        x = np.sqrt(counts) * model.idf
        pairs, events = x[:quality.PAIRS], x[quality.PAIRS:]
        x = np.concatenate([pairs / max(np.linalg.norm(pairs), 1e-9), model.settings.event_weight * events / max(np.linalg.norm(events), 1e-9)])
        z = x @ model.basis.astype(float)
        return z / max(np.linalg.norm(z), 1e-9)

    def vote(text):
        if not text:
            return model.prior
        z, s = vector(text), model.settings
        cosines = sorted(((float(np.dot(z, v)), y) for v, y in zip(model.vectors.astype(float), model.labels)), reverse=True)
        weights = [(np.exp(s.sharpness * (c - 1)), y) for c, y in cosines[:s.neighbours]]
        return (sum(w * y for w, y in weights) + s.prior_weight * model.prior) / (sum(w for w, _ in weights) + s.prior_weight)

    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    for i, t in [*enumerate(texts_), (300, ""), (301, None), (302, texts_[0])]:
        assert abs(got[i] - vote(t)) < 2e-4, (i, t)
    held = [i for i in range(300) if i not in fitted]
    assert np.mean([(got[i] >= 0.5) == ("###" in texts_[i]) for i in held]) > 0.9
