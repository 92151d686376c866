"""Secret scans with a trigram index, in DataFrame functions only.

For each rule's pattern a Boolean query over trigrams is derived: what any match must contain. The index holds postings
(trigram, document) for the trigrams of these queries; the postings of a document are intersected to see which rules it can
match, and only those patterns are run on its text. A rule without a mandatory trigram is run on every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from .common import small_side, stage, text_of

MOST_STRINGS = 16  # alternatives kept apart while a pattern is followed


@dataclass(frozen=True)
class Rule:
    """pattern: Java regular expression that RE2 and Python read alike; group `group` must have `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)


# Boolean queries: None (anything), ("tri", t), ("and", parts), ("or", parts)

def both(parts) -> tuple | None:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def either(parts) -> tuple | None:
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def of_string(s: str) -> tuple | None:
    return both(("tri", s[i:i + 3]) for i in range(len(s) - 2))


def trigram_query(pattern: str) -> tuple | None:
    """What the lower-cased text must contain for the pattern to match; None if no trigram is certain."""
    from re import _parser

    def letters(op, arg) -> set[str] | None:
        if str(op) == "LITERAL":
            return {chr(arg).lower()}
        if str(op) == "IN":
            got = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    got.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < MOST_STRINGS:
                    got.update(chr(i).lower() for i in range(x[0], x[1] + 1))
                else:
                    return None
            return got if len(got) <= 3 else None
        return None

    def walk(nodes) -> tuple[set[str] | None, tuple | None]:
        """All strings the nodes can match, if few; and what every match must contain besides."""
        known: set[str] | None = {""}
        exact, needs = True, []

        def flush():
            nonlocal known, exact
            if known:
                needs.append(either([of_string(s) for s in known]))
            known, exact = {""}, False

        for op, arg in nodes:
            name, strings, inner = str(op), None, None
            if (chars := letters(op, arg)) is not None:
                strings = chars
            elif name == "SUBPATTERN":
                strings, inner = walk(arg[3])
            elif name == "BRANCH":
                branches = [walk(b) for b in arg[1]]
                if all(s is not None for s, _ in branches):
                    strings = set().union(*(s for s, _ in branches))
                else:
                    inner = either([both([q, either([of_string(x) for x in s]) if s else None]) for s, q in branches])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, body = arg
                strings_in, query_in = walk(body)
                if strings_in is not None and high == 1:
                    strings = strings_in | {""}
                elif low:
                    inner = both([query_in, either([of_string(x) for x in strings_in]) if strings_in else None])
            elif name == "AT":
                continue
            if strings is None:
                flush()
                needs.append(inner)
                continue
            if len(known) * len(strings) > MOST_STRINGS:
                flush()
            known = {a + b for a, b in product(known, strings)}
        if exact:
            return known, both(needs)
        flush()
        return None, both(needs)

    strings, needs = walk(_parser.parse(pattern))
    return both([needs, either([of_string(s) for s in strings]) if strings else None])


def trigrams(query: tuple | None) -> set[str]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams(q) for q in query[1:]))


def holds(query: tuple, has) -> Column:
    if query[0] == "tri":
        return has(query[1])
    parts = [holds(q, has) for q in query[1:]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(trigram, key): one row per wanted trigram that occurs in a document, its case put aside. docs: key, text."""
    low = docs.select("key", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select("key", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, tuple]) -> DataFrame:
    """key and, per rule, whether the document's postings satisfy its query; documents that satisfy none are left out."""
    has = lambda t: F.max(F.col("trigram") == t)
    got = index.groupBy("key").agg(*[holds(q, has).alias(f"can_{k}") for k, q in queries.items()])
    return got.filter(reduce(lambda a, b: a | b, [F.col(f"can_{k}") for k in queries]))


def found_spans(rule: Rule, text: Column) -> Column:
    """Spans (start, end, rank) of a rule's matches, leftmost without overlap; those too short are dropped. Starts and ends
    count code points: the parts between matches and the matches, laid end to end."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("held"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        keep = F.coalesce(F.length(x["held"]) >= rule.least, F.lit(False))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, empty, step, lambda acc: acc["spans"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds secret_spans: array of (start, end, kind) sorted by start, then by the rules' order.

    Null and empty texts have no spans. Repeated rows are scanned alike. A column secret_spans, key or can_... of the input
    is replaced or kept out of the way. Kinds must be different names."""
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("two rules of one kind")
    kept = [c for c in docs.columns if c != "secret_spans"]
    rows = docs.select(F.struct(*kept).alias("_row"), text_of(text).alias("text"))
    # Two texts of one key would only make both candidates for what either can match.
    rows = rows.withColumn("key", F.xxhash64("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    if queries:
        wanted = sorted(set().union(*map(trigrams, queries.values())))
        found = stage(candidates(postings(rows, wanted), queries))
        rows = rows.join(small_side(found), "key", "left")

    def named(rank: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))

    spans = []
    for rank, r in enumerate(rules):
        none = F.array().cast("array<struct<start:int,end:int>>")
        got = found_spans(r, F.col("text"))
        if r.kind in queries:
            got = F.when(F.col(f"can_{r.kind}"), got).otherwise(none)
        spans.append(F.transform(got, named(rank, r.kind)))
    ordered = F.transform(F.array_sort(F.concat(*spans)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.select("_row", ordered.alias("secret_spans")).select("_row.*", "secret_spans")


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Puts a mark in place of every span of the text; spans that overlap are covered together. Drops secret_spans."""
    t = F.col(text)
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(t, acc["at"] + 1, s["start"] - acc["at"])
        new = F.concat(acc["out"], gap, F.lit(mark))
        return F.when(s["end"] <= acc["at"], acc).when(s["start"] < acc["at"], F.struct(s["end"].alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), new.alias("out")))

    done = F.aggregate("secret_spans", empty, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return scanned.withColumn(text, F.when(F.size("secret_spans") > 0, done).otherwise(t)).drop("secret_spans")
