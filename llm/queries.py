"""The registered queries of this subpackage: each applies one operator, with production parameters, to its table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fingerprints, jaccard, lm, merkle, mixing, neighbours, packing, quality, repeats, secrets, tokens, urls, whitening
from .common import documents, ship, small_side, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_best_fit_packing")
def best_fit_packing(spark, folder):
    pieces = tokens.token_pieces(documents(spark, folder), tokenizer_file("word_bpe_49k.json"), 2048)
    return packing.pack(pieces, packing.Capacity(tokens=2048)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op3_token_counts")
def token_counts(spark, folder):
    counted = tokens.prefix_counts(documents(spark, folder), tokenizer_file("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


_SIZES = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0 AS w,
         [1.5, 1.0, 0.5][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w0, [0.5, 1.0, 1.5][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w1
       FROM d GROUP BY source),
s1 AS (SELECT *, source_size * 3 / w AS ratio FROM s0),
s2 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(source_size * 3) OVER (ORDER BY ratio, source NULLS LAST
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, source NULLS LAST
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, arg_min(level, ratio) FILTER (source_size * 3 > w * level) OVER () AS common FROM s2),
s AS (SELECT source, source_size, CAST(w0 AS DOUBLE) AS w0, CAST(w1 AS DOUBLE) AS w1, CASE WHEN source_size * 3 <= w * level THEN CAST(source_size * 3 AS DOUBLE) ELSE w * common END AS target FROM s3),
o AS (SELECT d.*, s.source_size, s.target, s.w0, s.w1, CAST(floor(s.target + 0.5) AS BIGINT) AS need,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
t AS (SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (need // source_size) + greatest(0, least(size, need % source_size - before)) END AS BIGINT) AS taken FROM o),
m AS (SELECT *, CASE WHEN taken > 0 THEN (before + CAST(CASE WHEN need >= source_size THEN size ELSE taken END AS DOUBLE) / 2) / need END AS share FROM t)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN w0 = w1 THEN share ELSE (sqrt(greatest(0.0, w0 * w0 + (w1 - w0) * (w0 + w1) * share)) - w0) / (w1 - w0) END END AS "position"
FROM m"""


@query("op5_curriculum_mix", _SIZES)
def curriculum_mix(spark, folder):
    """position: when training meets the document first (0 to 1, null if the mix takes none of it); rows come in that order."""
    mixed = mixing.mix(documents(spark, folder, "doc_id", "source", "text"))
    ordered = mixing.in_training_order(mixed.withColumn("position", mixing.first_position(mixed)))
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "position")


@query("op10_quality_vote")
def quality_vote(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    model = quality.fit(docs, quality.training_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    return quality.score(docs, model, "score").select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


_KINDS = ("assign", "access", "hex")
_FOUND = r"""
{kind} AS (SELECT r, doc_id, unnest(spans) AS s FROM (
  SELECT r, doc_id, list_filter(list_transform(generate_series(1, len(hits)), lambda i: {{
      'a': CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS BIGINT),
      'n': length(hits[i]), 'ok': length(held[i]) >= {least}, 'rank': {rank}, 'kind': '{kind}'}}), lambda x: x.ok) AS spans
  FROM (SELECT r, doc_id, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS held,
          string_split_regex(t, '{pattern}') AS gaps FROM d)))"""


def _sql_pattern(rule: secrets.Rule) -> str:
    """Letters in either case, spelled out: RE2 would also fold letters outside ASCII."""
    found = re.search(r"\(\?i:(.*?\))\)", rule.pattern)
    pattern = rule.pattern
    if found:
        folded = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", found[1])
        pattern = pattern.replace(found[0], folded)
    return pattern.replace("'", "''")


_SECRETS = ("WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),"
            + ",".join(_FOUND.format(kind=r.kind, least=r.least, rank=i, group=r.group, pattern=_sql_pattern(r)) for i, r in enumerate(secrets.RULES))
            + """, al AS (SELECT r, s FROM assign UNION ALL SELECT r, s FROM access UNION ALL SELECT r, s FROM hex),
g AS (SELECT r, count(*) FILTER (s.kind = 'assign') AS n_assign, count(*) FILTER (s.kind = 'access') AS n_access,
  count(*) FILTER (s.kind = 'hex') AS n_hex, string_agg(s.kind || ':' || s.a || ':' || (s.a + s.n), ',' ORDER BY s.a, s.rank) AS spans FROM al GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)""")


@query("op4_secret_scan", _SECRETS)
def secret_scan(spark, folder):
    found = secrets.scan(documents(spark, folder, "doc_id", "text"))
    spans = F.col("secret_spans")
    of_kind = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in _KINDS]
    listed = lambda of: F.concat_ws(",", F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter(spans, lambda s: s["kind"].isin(*_KINDS))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


_URLS = r"""
WITH RECURSIVE rules(action, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url LIKE '%://%'),
goes AS (SELECT url, CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS t FROM tags),
link0 AS (SELECT url AS a, CASE WHEN t LIKE '//%' THEN split_part(url, '://', 1) || ':' || t WHEN t LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t ELSE t END AS b
  FROM goes WHERE t <> ''),
urls AS (SELECT url AS u FROM pages WHERE url LIKE '%://%' UNION SELECT b FROM link0 WHERE b LIKE '%://%'),
parts AS (SELECT u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls),
known AS (SELECT u, parts.host, parts.path, lower(split_part(u, '://', 1)) || '://' || parts.host || regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS at,
  arg_max(struct_pack(rule := rules.host || rules.path, action := action), length(rules.host || rules.path)) AS r FROM parts
  LEFT JOIN rules ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host)) AND starts_with(parts.path, rules.path) GROUP BY u, parts.host, parts.path),
link AS (SELECT x.at AS a, y.at AS b FROM link0 JOIN known x ON link0.a = x.u JOIN known y ON link0.b = y.u),
step AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM step UNION SELECT reach.a, step.b FROM reach JOIN step ON reach.b = step.a),
said AS (SELECT reach.a, bool_or(known.r.action = 'block') AS blocked, bool_or(known.r.action = 'allow') AS allowed FROM reach JOIN known ON known.at = reach.b GROUP BY reach.a)
SELECT page_id, coalesce(known.host, '') AS host, coalesce(known.path, '') AS path, known.r.rule AS rule,
  coalesce(known.r.action, CASE WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN known ON pages.url = known.u LEFT JOIN said ON said.a = known.at"""


@query("op6_url_rules", _URLS)
def url_rules(spark, folder):
    return urls.judge(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")).select(
        "page_id", "host", "path", "rule", "verdict")


@query("op7_lz_fingerprint")
def lz_fingerprint(spark, folder):
    return fingerprints.fingerprint(documents(spark, folder, "doc_id", "text")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op8_multi_index_search")
def multi_index_search(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    return neighbours.search(table, lambda vec_id: vec_id % 50 == 0, k=5)


@query("op9_token_group_join")
def token_group_join(spark, folder):
    return jaccard.join(documents(spark, folder, "doc_id", "text"), jaccard.Rule(words=4, percent=85))


@query("op2_cross_entropy_difference")
def cross_entropy_difference(spark, folder):
    """Target: documents labelled good and not toxic; background: all documents."""
    docs = documents(spark, folder, "doc_id", "text")
    good = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("_id"), F.lit(True).alias("good")).distinct()
    flagged = docs.join(small_side(stage(good)), F.col("doc_id") == F.col("_id"), "left")
    return lm.difference(flagged, "good")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_MANIFEST = f"""
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS r, doc_id, source, {_LEAF.format(text='text')} AS leaf,
    {_LEAF.format(text=f"translate(text, '{_UPPER}', '{_LOWER}')")} AS tampered,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))),
      lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS crc FROM documents),
d AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM raw),
up(tree, level, pos, n, digest) AS (SELECT tree, 0, pos, n, leaf FROM d UNION ALL
  SELECT tree, level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 16),
sub AS (SELECT tree, digest FROM up WHERE n = 1),
over_(level, pos, n, digest) AS (SELECT 0, tree, (SELECT count(*) FROM sub), digest FROM sub UNION ALL
  SELECT level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM over_ WHERE n > 1 GROUP BY level, pos // 16),
top AS (SELECT digest FROM over_ WHERE n = 1),
way AS (SELECT r, u.level AS step, u.pos, u.digest, u.pos = d.pos // CAST(pow(16, u.level) AS BIGINT) AS own
    FROM d JOIN up u ON u.tree = d.tree AND u.n > 1 AND u.pos // 16 = d.pos // CAST(pow(16, u.level + 1) AS BIGINT)
  UNION ALL SELECT r, 1000 + o.level, o.pos, o.digest, o.pos = d.tree // CAST(pow(16, o.level) AS BIGINT)
    FROM d JOIN over_ o ON o.n > 1 AND o.pos // 16 = d.tree // CAST(pow(16, o.level + 1) AS BIGINT)),
steps AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY step) AS k, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos < mine), '') AS l,
    coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos > mine), '') AS r_ FROM (SELECT *, max(pos) FILTER (own) OVER (PARTITION BY r, step) AS mine FROM way) GROUP BY r, step),
folded(r, k, digest) AS (SELECT r, CAST(0 AS BIGINT), CASE WHEN crc IS NOT NULL AND xor(crc, CAST(4294967295 AS BIGINT)) % 5 = 0 THEN tampered ELSE leaf END FROM d UNION ALL
  SELECT folded.r, folded.k + 1, sha256(l || digest || r_) FROM folded JOIN steps ON steps.r = folded.r AND steps.k = folded.k + 1),
last AS (SELECT r, arg_max(digest, k) AS folded_root FROM folded GROUP BY r),
proof AS (SELECT r, sha256(string_agg(digest, '' ORDER BY step, pos)) AS p FROM way WHERE NOT own GROUP BY r)
SELECT doc_id, leaf, sub.digest AS subroot, top.digest AS root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = top.digest AS verified
FROM d JOIN sub USING (tree) CROSS JOIN top JOIN last USING (r) LEFT JOIN proof USING (r)"""


@query("op12_merkle_manifest", _MANIFEST)
def merkle_manifest(spark, folder):
    """Every fifth document, by the checksum of its id, is tampered with: its text loses its capitals."""
    docs = documents(spark, folder)
    of = lambda text: merkle.digest(merkle.encoded(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    tampered = F.when(hit, of(F.translate("text", _UPPER, _LOWER)))
    made = merkle.manifest(docs, of(F.col("text")), carry={"tampered": tampered})
    out = made.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op11_bit_sliced_whitening")
def bit_sliced_whitening(spark, folder):
    """deviation is exact; beyond the range of a long it is null."""
    made = whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return made.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


@query("op13_two_stage_suffix_dedup")
def two_stage_suffix_dedup(spark, folder):
    return repeats.digested(repeats.removed_repeats(documents(spark, folder, "doc_id", "text")))
