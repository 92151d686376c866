"""Exact n-gram Jaccard join with a token-group matrix.

Sets of hashed shingles that are equal count once. Then, in two rounds:

1. Grouping. Sets that share a band of minimum hashes are compared with one set of that band, the leader; verified
   links make groups of similar sets. A large group of near copies becomes few groups at a cost linear in its size.
2. Joining. The matrix holds, for every group, the union of its members' prefixes: the tokens of which a set must share
   one with any set it links with. Rows of the matrix are spread by token. Groups that share a token, and whose sizes and
   places allow a link, are paired; pairs within a group are never made. The smaller group's sets are then the queries. A
   query's overlap with the token union of a block of the other group bounds its overlap with every member, so only
   blocks that reach the bound are opened, and a query stops at its first link with a group.

Tokens are ordered by how common they are, then by hash. A count sketch of fixed size over all documents tells how
common; it affects the order alone, and any common order keeps the join exact. Links within a group and one link between two groups
connect the same sets as all links do, so components are exact. Two different shingles are taken for one with odds
of about 2^-64 a pair, two different sets likewise.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_side, stage
from .components import connected_components
from .shingles import mix, shingle_sets

SKETCH_BITS = 20
BANDS, BAND_WIDTH = 6, 3
BLOCK = 64  # members of a group that are opened together
QUERIES = 512  # queries of a block in one task
PAIRS_KEPT = 1_000_000  # pairs a task remembers, so as not to make them again
_TURNS = mix(np.arange(1, 2 * BANDS * BAND_WIDTH + 1, dtype=np.uint64)).reshape(2, -1)


@dataclass(frozen=True)
class Rule:
    words: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def linked(self, both, n, m):
        return (100 + self.percent) * both >= self.percent * (n + m)


def set_id(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        a, b = mix(tokens).sum(dtype=np.uint64), (tokens * np.uint64(0xA0761D6478BD642F) ^ (tokens >> np.uint64(29))).sum(dtype=np.uint64)
        return int(mix(np.array([a ^ mix(np.array([b + np.uint64(len(tokens))], np.uint64))[0]], np.uint64)).view(np.int64)[0])


def bands(tokens: np.ndarray) -> list[int]:
    low = np.array([(tokens * (a | np.uint64(1)) + b).min() for a, b in _TURNS.T], np.uint64).reshape(BANDS, BAND_WIDTH)
    return mix((low * _TURNS[0, :BAND_WIDTH] | np.uint64(1)).sum(axis=1, dtype=np.uint64) + mix(low[:, 0])).view(np.int64).tolist()


def parity(tokens: np.ndarray) -> bytes:
    """A bit per cell, about as many cells as tokens: whether an odd number of tokens falls there. Tokens of two sets' difference
    alone change bits, so the number of unequal bits is at most the size of the difference."""
    cells = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the size of the difference of two sets; the longer parity is folded to the shorter."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    long, short = max(len(a), len(b)) * 8, min(len(a), len(b)) * 8
    if len(a) < len(b):
        x, y = y, x
    while long > short:
        long //= 2
        x = (x >> long) ^ (x & ((1 << long) - 1))
    return (x ^ y).bit_count()


def profile(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_key, n, sid, bands, parity of every row (bands and parity once per set and batch); and per task one row that has only a sketch: how many sets have a token, by the
    first bits of the token."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            sizes, sids, lows, odds, seen = [], [], [], [], set()
            for tokens in shingle_sets(batch.column(1), rule.words):
                sid = set_id(tokens) if len(tokens) else None
                sizes.append(len(tokens))
                sids.append(sid)
                if sid is None or sid in seen:
                    lows.append(None)
                    odds.append(None)
                    continue
                lows.append(bands(tokens))
                odds.append(parity(tokens))
                seen.add(sid)
                np.add.at(counts, (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield _table([batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array(sids, pa.int64()), pa.array(lows, pa.list_(pa.int64())),
                          pa.array(odds, pa.binary()), pa.nulls(len(sizes), pa.binary())])
        yield _table([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())),
                      pa.nulls(1, pa.binary()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())])

    def _table(columns):
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "sid", "bands", "parity", "sketch"])

    return stage(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, n int, sid long, bands array<long>, parity binary, sketch binary"))


def commonness(profiled: DataFrame) -> np.ndarray:
    """Level of each sketch cell: 0 up to the usual count, then eight levels per doubling. Sketches are summed in a tree, so
    the driver gets a few of fixed size."""
    read = lambda raw: np.frombuffer(zlib.decompress(raw), np.int32).astype(np.int64)
    rows = profiled.filter("sketch IS NOT NULL").select("sketch")
    many = rows.count()

    def add(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += read(raw.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)], pa.binary())], ["sketch"])

    while many > 32:
        many = -(-many // 32)
        rows = stage(rows.repartition(many).mapInArrow(add, "sketch binary"))
    total = sum((read(r[0]) for r in rows.collect()), np.zeros(1 << SKETCH_BITS, np.int64))
    usual = max(1.0, float(np.median(total[total > 0]))) if (total > 0).any() else 1.0
    return np.clip(np.floor(8 * np.log2(np.maximum(total, 1) / usual)), 0, 255).astype(np.uint8)


def in_order(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Rare tokens first, then by hash."""
    return tokens[np.argsort(level[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]


def open_groups(docs: DataFrame, places: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) of queries with members. places: doc_id, sid, grp, block, part, query (boolean) and n; a block has a bounded number
    of members, each part of it all of them and a bounded number of queries."""
    listed = places.groupBy("doc_id", "sid").agg(F.collect_list(F.struct("grp", "block", "part", "query")).alias("at"))
    listed = stage(listed.withColumnRenamed("doc_id", "_doc"))
    rows = docs.select("doc_id", "text").join(small_side(listed), F.col("doc_id").eqNullSafe(F.col("_doc")))

    def tokens_of(batches):
        for batch in batches:
            columns = [[], [], [], [], [], []]
            for tokens, sid, at in zip(shingle_sets(batch.column(0), rule.words), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if len(tokens) and set_id(tokens) == sid:
                    raw = tokens.tobytes()
                    for p in at:
                        for values, v in zip(columns, (p["grp"], p["block"], p["part"], p["query"], sid, raw)):
                            values.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["grp", "block", "part", "query", "sid", "tokens"])

    rows = rows.select("text", "sid", "at").mapInArrow(tokens_of, "grp long, block int, part int, query boolean, sid long, tokens binary")
    rows = rows.repartition("grp", "block", "part").sortWithinPartitions("grp", "block", "part", "query")

    def compare(batches):
        place, members, union, owners = None, {}, None, None
        for batch in batches:
            a, b = [], []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for i, (key, query, sid) in enumerate(zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                if key != place:
                    place, members, union = key, {}, None
                tokens = np.frombuffer(batch.column(5)[i].as_py(), np.uint64)
                if not query:
                    members[sid] = tokens
                    continue
                if not members:
                    continue
                if union is None:
                    ids, sizes = list(members), np.array([len(t) for t in members.values()])
                    owners = np.repeat(np.arange(len(ids)), sizes)
                    every = np.concatenate(list(members.values()))
                    order = np.argsort(every, kind="stable")
                    every, owners = every[order], owners[order]
                    union = np.unique(every)
                n = len(tokens)
                bound = np.isin(tokens, union, assume_unique=True).sum()
                if not rule.linked(np.minimum(bound, sizes), n, sizes).any():
                    continue
                first, last = np.searchsorted(every, tokens, "left"), np.searchsorted(every, tokens, "right")
                hit = np.repeat(first, last - first) + np.arange((last - first).sum()) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
                shared = np.bincount(owners[hit], minlength=len(ids))
                good = np.flatnonzero(rule.linked(shared, n, sizes))
                good = [g for g in good.tolist() if ids[g] != sid][:1]
                a += [sid] * len(good)
                b += [ids[g] for g in good]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return stage(rows.mapInArrow(compare, "a long, b long"))


def leaders(sets: DataFrame, rule: Rule) -> DataFrame:
    """places for the first round: the most central set of a band is the member, the others of the band the queries.

    Central is the set whose bands are shared by most sets in all: in a family of edited copies that is the text they come
    from, which links with copies that do not link with each other."""
    banded = stage(sets.select("sid", "n", "doc_id", F.posexplode("bands").alias("band", "low")))
    shared = banded.groupBy("band", "low").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    banded = stage(banded.join(shared, ["band", "low"]))
    central = banded.groupBy("sid").agg(F.sum("many").alias("weight"))
    banded = stage(banded.join(central, "sid"))
    rank = F.struct(F.col("weight"), F.col("sid"))
    lead = banded.groupBy("band", "low").agg(F.max_by("sid", rank).alias("grp"), F.max_by("n", rank).alias("m"), F.max_by("doc_id", rank).alias("lead_doc"))
    pairs = stage(banded.join(lead, ["band", "low"]).filter("sid <> grp AND 100 * least(n, m) >= %d * greatest(n, m)" % rule.percent)
                  .groupBy("grp", "sid").agg(F.min("doc_id").alias("doc_id"), F.min("lead_doc").alias("lead_doc")))
    parts = pairs.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"), F.min("lead_doc").alias("doc_id"))
    parts = stage(parts)
    part = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    queries = pairs.join(small_side(parts.select("grp", "parts")), "grp").select("doc_id", "sid", "grp", F.lit(0).alias("block"), part.alias("part"), F.lit(True).alias("query"))
    members = parts.select("doc_id", F.col("grp").alias("sid"), "grp", F.lit(0).alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("query"))
    return queries.unionByName(members)


def matrix(docs: DataFrame, grouped: DataFrame, level: np.ndarray, rule: Rule) -> DataFrame:
    """token, grp, least, most, rest: a group's prefix tokens; sizes of the sets that have the token there, and how many tokens
    such a set has from that token on, at most. grouped: doc_id, sid, grp of sets in groups of several."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        levels = shared.value
        for batch in batches:
            own = {}
            for tokens, sid, grp in zip(shingle_sets(batch.column(0), rule.words), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not len(tokens):
                    continue
                this = set_id(tokens)
                grp = grp if sid == this else this
                known = own.setdefault(grp, {})
                if this not in known:
                    known[this] = len(tokens), in_order(tokens, levels)[:rule.prefix(len(tokens))]
            for whole in (False, True):  # groups with one set in this batch go as they are
                some = [(g, n, t) for g, k in own.items() if (len(k) > 1) == whole for n, t in k.values()]
                if not some:
                    continue
                token = np.concatenate([t for _, _, t in some])
                times = [len(t) for _, _, t in some]
                grp = np.repeat(np.array([g for g, _, _ in some], np.int64), times)
                n = np.repeat(np.array([n for _, n, _ in some], np.int32), times)
                rest = n - np.concatenate([np.arange(k, dtype=np.int32) for k in times])
                least = most = n
                if whole:
                    token, grp, least, most, rest = merged(token, grp, n, n, rest)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (token.view(np.int64), grp, least, most, rest)], ["token", "grp", "least", "most", "rest"])

    rows = docs.select("doc_id", "text").join(small_side(stage(grouped.withColumnRenamed("doc_id", "_doc"))), F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return rows.select("text", "sid", "grp").mapInArrow(run, "token long, grp long, least int, most int, rest int")


def merged(token, grp, least, most, rest):
    order = np.lexsort((grp, token))
    token, grp, least, most, rest = (x[order] for x in (token, grp, least, most, rest))
    first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (grp[1:] != grp[:-1])])
    return token[first], grp[first], np.minimum.reduceat(least, first), np.maximum.reduceat(most, first), np.maximum.reduceat(rest, first)


def group_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """Distinct pairs (a < b) of groups that share a matrix token and may hold a link."""
    rows = rows.repartition("token").sortWithinPartitions("token")

    def pairs_of(columns):
        token, grp, least, most, rest = merged(*columns)
        edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
        for begin, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if end - begin < 2:
                continue
            order = begin + np.argsort(least[begin:end], kind="stable")
            g, lo, hi, r = grp[order], least[order].astype(np.int64), most[order].astype(np.int64), rest[order].astype(np.int64)
            for i in range(len(g) - 1):  # partners of larger sizes, up to what similarity allows
                stop = np.searchsorted(lo, 100 * hi[i] // rule.percent, "right")
                if stop > i + 1:
                    j = slice(i + 1, stop)
                    ok = rule.linked(np.minimum(r[i], r[j]), lo[i], lo[j])
                    if ok.any():
                        other = g[j][ok]
                        yield np.stack([np.minimum(other, g[i]), np.maximum(other, g[i])])

    def run(batches):
        held, made = None, set()
        for batch in batches_with_end(batches):
            columns = None if batch is None else tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if held is not None and columns is not None:
                columns = tuple(np.concatenate([a, b]) for a, b in zip(held, columns))
            if columns is None:
                done, held = held, None
            else:
                cut = np.searchsorted(columns[0], columns[0][-1], "left") if len(columns[0]) else 0
                done, held = tuple(c[:cut] for c in columns), tuple(c[cut:] for c in columns)
            if done is None or not len(done[0]):
                continue
            found = list(pairs_of(done))
            if found:
                fresh = set(zip(*np.concatenate(found, axis=1).tolist())) - made
                if len(made) > PAIRS_KEPT:
                    made = set()
                made |= fresh
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in fresh], pa.int64()), pa.array([y for _, y in fresh], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def possible(pairs: DataFrame, grouped: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose parities allow a link. A group of several sets has no parity, so its pairs stay."""
    alone = stage(grouped.filter("parity IS NOT NULL").select("grp", "n", "parity"))
    side = lambda c: alone.select(F.col("grp").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "n_a", "p_a", "n_b", "p_b")

    def run(batches):
        for batch in batches:
            keep = []
            for n, p, m, q in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                keep.append(p is None or q is None or bool(rule.linked((n + m - least_difference(p, q)) / 2, n, m)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def batches_with_end(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def blocks(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """places for the second round. sets: sid, doc_id, grp. The group with fewer sets (then the smaller id) asks."""
    sizes = stage(sets.groupBy("grp").agg(F.count(F.lit(1)).alias("many")))
    side = lambda c: sizes.select(F.col("grp").alias(c), F.col("many").alias(f"many_{c}"))
    p = pairs.join(small_side(side("a")), "a").join(small_side(side("b")), "b")
    asks = F.expr("many_a < many_b OR (many_a = many_b AND a < b)")
    p = stage(p.select(F.when(asks, F.col("a")).otherwise(F.col("b")).alias("asking"), F.when(asks, F.col("b")).otherwise(F.col("a")).alias("grp"),
                       F.when(asks, F.col("many_b")).otherwise(F.col("many_a")).alias("many")))
    p = p.withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
    asking = p.join(sets.select(F.col("grp").alias("asking"), "sid", "doc_id"), "asking").select("doc_id", "sid", "grp", "blocks")
    parts = stage(asking.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"), F.max("blocks").alias("blocks")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asking = asking.join(small_side(parts.select("grp", "parts")), "grp").select(
        "doc_id", "sid", "grp", every("blocks").alias("block"), F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("query"))
    members = sets.join(small_side(parts), "grp").select(
        "doc_id", "sid", "grp", F.pmod(F.xxhash64("sid", F.lit(2)), F.col("blocks")).cast("int").alias("block"), every("parts").alias("part"), F.lit(False).alias("query"))
    return asking.unionByName(members)


def components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The columns of join() and component, a set's id that all rows of a component share; null for texts without words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = profile(docs, rule)
    level = commonness(seen)
    rows = seen.filter("sketch IS NULL")
    sets = stage(rows.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bands").alias("bands"), F.max("parity").alias("parity")))

    first = open_groups(docs, leaders(sets, rule), rule)
    groups = stage(connected_components(first))
    ids = sets.select("sid", "doc_id", "n", "parity")
    grouped = ids.join(small_side(groups.withColumnRenamed("node", "sid")), "sid", "left").select(
        "sid", "doc_id", "n", F.coalesce("component", "sid").alias("grp"), F.when(F.col("component").isNull(), F.col("parity")).alias("parity"))
    grouped = stage(grouped)

    # every row of a document in a group of several learns its group, copies included
    member = rows.filter("sid IS NOT NULL").select("doc_id", "sid").join(
        small_side(groups.select(F.col("node").alias("sid"), F.col("component").alias("grp"))), "sid").distinct()
    pairs = stage(group_pairs(matrix(docs, member, level, rule), rule))
    pairs = stage(possible(pairs, grouped, rule))
    second = open_groups(docs, blocks(pairs, grouped, rule), rule)
    of = lambda c: grouped.select(F.col("sid").alias(c), F.col("grp").alias(f"g_{c}"))
    joined = connected_components(second.join(of("a"), "a").join(of("b"), "b").select(F.col("g_a").alias("a"), F.col("g_b").alias("b")))
    whole = grouped.join(small_side(stage(joined).withColumnRenamed("node", "grp")), "grp", "left").select("sid", "doc_id", F.coalesce("component", "grp").alias("grp"))
    lowest = stage(whole.groupBy("grp").agg(F.min("doc_id").alias("component_id")))
    answer = stage(whole.join(small_side(lowest), "grp").select("sid", "grp", "component_id"))
    return rows.join(small_side(answer), "sid", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "text_key", F.col("grp").alias("component"))


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key (a hash of the text) of every row. component_id: the smallest doc_id that links reach, itself included.

    Texts without words (null, empty, blank) have the empty set, link with nothing and are their own component. A text with
    fewer words than a shingle has one shingle, its whole sequence. Repeated rows and equal sets are linked. A null doc_id gets
    the component of its set, null if no other id is in it. Other columns are ignored; an empty table gives no rows."""
    return components(docs, rule).drop("component")


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest doc_id (null after all others; of several texts with that id, the
    one with the smallest hash), once. A doc_id that repeats over texts of different components stays with each of them. Documents
    without words all stay, repeated ones too. Columns are those of docs, whatever they are called; an empty table stays empty."""
    rows = components(docs, rule)
    known = rows.filter("component IS NOT NULL").groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    low = known.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "n")).alias("low"))
    keys = low.select("low.doc_id", "low.text_key", (F.col("low.n") > 1).alias("often"))
    wordless = rows.filter("component IS NULL").select("doc_id", "text_key", F.lit(False).alias("often")).distinct()
    keys = small_side(stage(keys.unionByName(wordless))).alias("k")
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    kept = held.join(keys, F.col("id").eqNullSafe(F.col("k.doc_id")) & (F.col("key") == F.col("k.text_key")))
    once = kept.filter("NOT often").select("row.*")
    return once.unionByName(kept.filter("often").dropDuplicates(["id", "key"]).select("row.*"))
