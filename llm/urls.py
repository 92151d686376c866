"""URL rules that reach the aliases of a page.

A rule names a host (with all its subdomains) and a path prefix; the longest fitting rule decides. A page without a
rule takes part in its redirect class: the connected component over redirects and canonical links. If a member of the class
is blocked by a rule, so is the page, unless a member is explicitly allowed; an explicit allow thus takes precedence
over what other addresses of the page get. Otherwise the page is allowed.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_side, stage
from .components import connected_components

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"),
         UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What names a page in links: scheme and host in lower case, no fragment. Null without ://."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), rest))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, action) of the longest rule that fits, null if none does. The rules are a list of the driver's, so one
    chain of conditions holds them; of equally long ones the earlier counts."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


_TARGET = re.compile(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?")
_PAGE = re.compile(r"(?s)(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?")


def _without_dots(path: str) -> str:
    out, steps = [], path.split("/")
    for i, step in enumerate(steps):
        if step == ".." and len(out) > 1:
            out.pop()
        if step not in (".", ".."):
            out.append(step)
        elif i == len(steps) - 1:
            out.append("")
    return "/".join(out)


def resolve(base: str, to: str) -> str | None:
    """The target of a reference on a page at base (a url with ://), by RFC 3986 and without the fragment. Null for a target without a
    host of its own whose scheme is not the page's (mailto:, data:)."""
    scheme, host, path, query = _TARGET.match(to).groups()
    at, site, place, asked = _PAGE.match(base).groups()
    if host is None:
        if scheme and scheme.lower() != at.lower():
            return None
        scheme, host = at, site
        if not path:
            path, query = place, asked if query is None else query
        elif not path.startswith("/"):
            path = (place[:place.rfind("/") + 1] or "/") + path
    return f"{scheme or at}://{host}{_without_dots(path)}{query or ''}"


_MARK = re.compile(r"<(?:!--|([A-Za-z][^\s/>]*+))")
_OTHER = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+>""")  # the rest of a tag whose attributes do not matter
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*|(?=>))))?(?!\s*=\s*["'])""")
_TAG_END = re.compile(r"[\s/]*>")
_CLOSES = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in ("script", "style", "title", "textarea")}
_REFRESH = re.compile(r"""(?is)\s*(?:[\d.]+(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?|url\s*=\s*)(?:"([^"]*)|'([^']*)|(.*))""")


def tags(html: str):
    """(name, attributes) of the link, meta and base tags outside comments, other tags' attributes and what is plain text by its tag
    (scripts, styles). Each attribute is read with its own quoting; the first of a name counts. A tag that the text ends in is none."""
    at = 0
    while mark := _MARK.search(html, at):
        at = mark.end()
        if mark[1] is None:
            if (end := html.find("-->", at - 2)) < 0:
                return
            at = end + 3
            continue
        name, held = mark[1].lower(), {}
        if name not in ("link", "meta", "base"):
            if not (end := _OTHER.match(html, at)):
                return
            at = end.end()
            if name in _CLOSES:
                if not (close := _CLOSES[name].search(html, at)):
                    return
                at = close.end()
            continue
        while not (end := _TAG_END.match(html, at)):
            if not (one := _ATTRIBUTE.match(html, at)):
                return
            held.setdefault(one[1].lower(), entities.unescape(one[2] or one[3] or one[4] or ""))
            at = one.end()
        at = end.end()
        yield name, held


def references(html: str) -> tuple[str, list[str]]:
    """The first base address of a page (empty without one), and what its canonical links and refresh tags refer to."""
    base, found = "", []
    for name, held in tags(html):
        href = held.get("href", "").strip()
        if name == "base":
            base = base or href
        elif name == "link" and "canonical" in held.get("rel", "").lower().rstrip("/").split():
            found.append(href)
        elif name == "meta" and held.get("http-equiv", "").strip().lower() == "refresh":
            to = _REFRESH.match(held.get("content", ""))
            found.append((to[1] or to[2] or to[3] or "").strip() if to else "")
    return base, [to for to in found if to]


def declared_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) addresses from <link rel=canonical href> and <meta http-equiv=refresh content=...url=> tags. Targets have their
    entities decoded and are resolved against the first <base href>, if there is one, and the page's url. An url with dot
    segments is linked to the one without."""
    at, text = F.col(f"`{url}`"), F.col(f"`{html}`")
    # text search is far cheaper than reading tags, and most pages declare nothing
    says = F.coalesce(text.rlike(r"(?i)canonical|http-equiv"), F.lit(False))
    pages = pages.filter(F.contains(at, F.lit("://")))
    found = pages.filter(says).select(at.alias("source"), text.alias("html"))
    dotted = pages.filter(at.rlike(r"/\.\.?(?:[/?#]|$)")).select(at.alias("source"), F.lit(None).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            sources, targets = [], []
            for source, page in zip(*(c.to_pylist() for c in batch.columns)):
                base, to = ("", [source]) if page is None else references(page)
                start = base and resolve(source, base) or source
                sources += [source] * len(to)
                targets += [resolve(start, t) for t in to]
            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(targets, pa.string())], ["source", "target"])

    links = found.unionByName(dotted).mapInArrow(run, "source string, target string")
    return links.select(address(F.col("source")).alias("source"), address(F.col("target")).alias("target")).filter("source IS NOT NULL AND target IS NOT NULL")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """Adds host, path, rule and verdict (allow or block). redirects: further (source, target) urls.

    Null urls and urls without :// have empty host and path, fit no rule with a path and are allowed. Repeated rows are judged
    alike; columns of the same names are replaced. Addresses are joined by a 64-bit hash (a pair of different ones is taken
    for one with odds of 2^-64)."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    links = declared_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select(address(F.col("source")).alias("source"), address(F.col("target")).alias("target")).dropna())
    links = stage(links.distinct())
    node = lambda c: F.xxhash64(c)
    at = F.col(f"`{url}`")
    judged = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_page"), at.alias("_at"), host_of(at).alias("host"), path_of(at).alias("path"))
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("_node", F.when(F.col("_rule").isNull(), node(address(F.col("_at")))))
    classes = connected_components(links.select(node("source").alias("a"), node("target").alias("b")))
    ends = links.select(F.col("source").alias("at")).union(links.select(F.col("target").alias("at"))).distinct()
    acts = ends.select(node("at").alias("node"), rule_of(host_of(F.col("at")), path_of(F.col("at")), rules)["action"].alias("action"))
    said = classes.join(acts, "node").groupBy("component").agg(
        F.max(F.col("action") == "block").alias("blocked"), F.max(F.col("action") == "allow").alias("allowed"))
    blocked = said.filter("blocked AND NOT coalesce(allowed, false)").select("component")
    blocked = stage(classes.join(blocked, "component").select(F.col("node").alias("_node"), F.lit(True).alias("_blocked")))
    out = judged.join(small_side(blocked), "_node", "left")
    verdict = F.coalesce(F.col("_rule")["action"], F.when(F.col("_blocked"), "block"), F.lit("allow"))
    return out.select(*[F.col("_page").getField(c).alias(c) for c in kept], "host", "path", F.col("_rule")["rule"].alias("rule"), verdict.alias("verdict"))
