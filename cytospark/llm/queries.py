"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, infill, language, near_dedup, packing, prefix_trie, quality, quality_classifier, secrets, substring_dedup, url_filter, warc
from .common import table

#: Rules of the URL query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: URLs to block, each with all that lies beneath it.
BLOCKED = [f"{scheme}://{name}.example.{top}{end}" for name in ("spam-farm", "free-bets", "adult-x") for scheme, top, end in (("HTTP", "COM", ":80"), ("https", "net", "/#top"), ("http", "org.", "/x/../"))]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    blocked = spark.createDataFrame([(u,) for u in BLOCKED], "url string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed, blocked=blocked).select("page_id", "host", "path", "rule", "verdict")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), *language.learned(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_report(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.parsed(warc.archived(table(spark, sf_dir, "pages")).select("page_id", "record"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_report(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_report(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.paths_of(prefix_trie.rebuilt(prefix_trie.turns_of(table(spark, sf_dir, "conversations")))))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.scored(docs, quality_classifier.learned(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [v for k, v in globals().items() if k.startswith("op") and callable(v) and k[2].isdigit()]
    return {f.__name__: f for f in sorted(own, key=lambda f: int(f.__name__[2:].split("_")[0]))}


SQL = {
    "op2_near_dedup": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM reached r JOIN edges e ON e.u = r.v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT u, min(v) AS m FROM reached GROUP BY u) ON u = d.doc_id""",
    "op4_url_filter": r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
listed(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM parted JOIN listed ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host, '(^|\.)(spam-farm|free-bets|adult-x)\.example\.(com|net|org)$') THEN 'block' ELSE 'allow' END) AS verdict FROM parted LEFT JOIN fits USING (page_id)""",
    "op7_substring_dedup": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows JOIN firsts USING (s) WHERE first < doc_id),
places AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY k) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM words) w
  ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.k = w.k GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words w LEFT JOIN places USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_warc": """
WITH own AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
rows_ AS (SELECT page_id, payload, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM own),
owners AS (SELECT payload, max(page_id) AS owner FROM rows_ WHERE payload_bytes >= 1000 GROUP BY payload)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN owner <> page_id THEN owner END AS refers_to FROM rows_ LEFT JOIN owners USING (payload)""",
    "op11_fill_in_middle": r"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM own),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM drawn),
parts AS (SELECT doc_id, t, n, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts""",
    "op12_prefix_trie": r"""
WITH turns AS (SELECT conv_id AS c, turn, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS w FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS i FROM turns),
wanted AS (SELECT c, c - c % 20 AS base, xor(list_reduce([CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')], lambda a, b: list_reduce(CAST(range(8) AS BIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (SELECT t.c, i, k, w FROM wanted t JOIN own o ON o.c = base WHERE i <= h UNION ALL SELECT t.c, i + 1000000, k, w FROM wanted t JOIN own o ON o.c = t.c WHERE i > h),
paths AS (SELECT t.c, coalesce(ks, []) AS ks, coalesce(ws, []) AS ws FROM wanted t LEFT JOIN (SELECT c, list(k ORDER BY i) AS ks, list(w ORDER BY i) AS ws FROM rebuilt GROUP BY c) USING (c)),
prefixes AS (SELECT c, d, len(ks) = d AS over_, sha256(array_to_string(ks[1:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(ks[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM paths)),
nodes AS (SELECT node, d, up, min(c) AS c, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (over_), '')) AS ends FROM prefixes GROUP BY node, d, up),
kids AS (SELECT up, count(*) AS n FROM nodes GROUP BY up),
own_ AS (SELECT a.*, coalesce(k.n, 0) AS kids, (a.n - 1) * a.w AS saved FROM nodes a LEFT JOIN kids k ON k.up = a.node),
beneath AS (SELECT p.node, CAST(count(*) FILTER (x.kids = 0) AS BIGINT) AS leaves, CAST(sum(x.saved) AS BIGINT) AS saved FROM own_ x JOIN prefixes p ON p.c = x.c AND p.d <= x.d GROUP BY p.node)
SELECT o.c AS conv_id, o.d AS depth, u.c AS parent_conv_id, o.n AS n_convs, o.kids AS n_children, leaves AS n_leaves, b.saved AS saved_tokens, o.ends AS ends_sha256
FROM own_ o JOIN beneath b ON b.node = o.node LEFT JOIN nodes u ON u.node = o.up""",
}
