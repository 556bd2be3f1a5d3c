"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.llm.bytebpe import bpe_digests
from pliego.llm.common import table
from pliego.llm.covertree import embedding_links
from pliego.llm.htmltext import extract_text
from pliego.llm.linededup import line_dedup
from pliego.llm.mixing import DOMAINS, mix
from pliego.llm.packing import pack
from pliego.llm.quality import quality_verdicts
from pliego.llm.resample import importance_ranks
from pliego.llm.sharding import kd_shards
from pliego.llm.simhash import simhash_components
from pliego.llm.toxicity import toxicity
from pliego.llm.trie import conversation_trie
from pliego.llm.urlrules import PATTERN_RULES, judge_urls


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text", "n_chars")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op4_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies")


def op5_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kd_shards(table(spark, sf_dir, "documents"), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_cover_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


SHARDS = 24

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_filters": op3_url_filters,
    "op4_mixing_weights": op4_mixing_weights,
    "op5_kd_tree_sharding": op5_kd_tree_sharding,
    "op6_cover_tree_links": op6_cover_tree_links,
    "op7_pattern_packing": op7_pattern_packing,
    "op8_toxicity": op8_toxicity,
    "op9_html_extraction": op9_html_extraction,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_conversation_trie": op13_conversation_trie,
}

# Lines as the operators compare them; the SQL compares the lines themselves
# where Spark compares their hashes.
_NORMAL = r"trim(translate(regexp_replace(lower({x}), '[ \t\x0B\x0C\r]+', ' ', 'g'), '123456789', '000000000'))"
_WORDS = r"len(regexp_extract_all({x}, '[^\x20\x09-\x0D]+'))"

_OP1 = rf"""
WITH s AS (
  SELECT doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS l FROM documents
), o AS (
  SELECT doc_id, site, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM s
), n AS (
  SELECT doc_id, site, pos, line, {_NORMAL.format(x="line")} AS norm FROM o
), b AS (
  SELECT norm, min((doc_id, pos)) AS first FROM n WHERE {_WORDS.format(x="norm")} >= 3
  GROUP BY norm HAVING count(DISTINCT site) >= 5
), k AS (
  SELECT n.*, b.norm IS NOT NULL AND (n.doc_id, n.pos) <> b.first AS gone FROM n LEFT JOIN b ON n.norm = b.norm
), t AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM k GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
  t.text AS text, length(t.text) AS n_chars
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
"""

_OP2 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), o AS (
  SELECT doc_id, host, md5(t) AS t, unnest(l) AS line FROM d
), n AS (
  SELECT doc_id, host, ('0x' || substr(t, 1, 15))::BIGINT AS t, line, {_NORMAL.format(x="line")} AS norm FROM o
), dup AS (
  SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, count(*) AS c FROM n WHERE norm <> '' GROUP BY doc_id, line) GROUP BY doc_id
), hosts AS (
  SELECT host, count(DISTINCT t) AS n_all FROM n WHERE norm <> '' GROUP BY host
), often AS (
  SELECT host, norm, min(t) AS first FROM n JOIN hosts USING (host) WHERE norm <> ''
  GROUP BY host, norm, n_all HAVING count(DISTINCT t) > 10 AND count(DISTINCT t) > n_all * 0.001
), lost AS (
  SELECT doc_id, sum({_WORDS.format(x="norm")}) AS n FROM n JOIN often USING (host, norm) WHERE t <> first GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(w) - coalesce(lost.n, 0) AS words_left
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND words_left >= 0.2 * n_words AS kept, CAST(words_left AS BIGINT) AS words_left
FROM f
"""

_FIRST_PATTERN = " ".join(f"WHEN regexp_matches(low, '{r.regex}') THEN '{r.regex}'" for r in PATTERN_RULES)

_OP3 = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM u
), p AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path,
    translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM h
), r(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT page_id, arg_max((action, rhost || rpath), length(rhost || rpath)) AS best FROM p JOIN r
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
), f AS (
  SELECT p.*, m.best[2] AS rule, m.best[1] AS action, CASE {_FIRST_PATTERN} END AS found FROM p LEFT JOIN m USING (page_id)
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN action WHEN found IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN found END AS pattern
FROM f
"""

# CRC-32 of a string's bytes: the table of 256 entries from the polynomial, then a fold.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({x})), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"""

_OP11 = rf"""
WITH tab AS (
  SELECT {_CRC_TABLE} AS tab
), w AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS (
  SELECT kind, id, unnest(w) AS word FROM w
), b AS (
  SELECT word, {_CRC.format(x="word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM f), tab
), h AS (
  SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f JOIN b USING (word) GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM h
), d AS (
  SELECT f.id, count(*) AS n, sum(gain) AS weight FROM f JOIN b USING (word) JOIN g USING (bucket) WHERE kind = 0 GROUP BY f.id
), s AS (
  SELECT doc_id, len(w.w) AS n_features, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score, coalesce(weight, 0) AS weight
  FROM documents JOIN w ON w.id = doc_id AND w.kind = 0 LEFT JOIN d ON d.id = doc_id
), r AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM s
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN place <= floor(10 * (SELECT count(*) FROM s WHERE n_features >= 20) / 100) THEN place END AS rank
FROM r
"""

# A node is a list of turns here, found by equality of the whole lists.
_OP13 = rf"""
WITH tab AS (
  SELECT {_CRC_TABLE} AS tab
), own AS (
  SELECT conv_id AS c, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT c, l, {_CRC.format(x="CAST(c AS VARCHAR)")} % 4 AS h, c - c % 20 AS b FROM own, tab
), r AS (
  SELECT h.c, list_concat(coalesce(o.l, [])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN own o ON o.c = h.b
), p AS (
  SELECT c, l, unnest(range(0, len(l) + 1)) AS depth FROM r
), m AS (
  SELECT c, depth, l[1:depth] AS k, l[1:depth - 1] AS up, len(l) AS n FROM p
), n AS (
  SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(k)[depth][2], '[^\x20\x09-\x0D]+')) END AS w
  FROM m GROUP BY depth, k
), e AS (
  SELECT m.c, m.depth, n.conv_id, n.n_convs, n.w, n.ends_sha256 FROM m JOIN n ON m.depth = n.depth AND m.k = n.k
), ch AS (
  SELECT up.conv_id, up.depth, count(DISTINCT lo.conv_id) AS n_children FROM e up JOIN e lo ON lo.c = up.c AND lo.depth = up.depth + 1 GROUP BY up.conv_id, up.depth
), v AS (
  SELECT e.*, CASE WHEN e.c = e.conv_id THEN (n_convs - 1) * w ELSE 0 END AS saved,
    CASE WHEN e.c = e.conv_id AND ch.conv_id IS NULL THEN 1 ELSE 0 END AS leaf
  FROM e LEFT JOIN ch ON ch.conv_id = e.conv_id AND ch.depth = e.depth
), s AS (
  SELECT conv_id, depth, c, n_convs, ends_sha256, lag(conv_id) OVER up AS parent_conv_id, sum(saved) OVER down AS saved, sum(leaf) OVER down AS leaves
  FROM v WINDOW up AS (PARTITION BY c ORDER BY depth), down AS (PARTITION BY c ORDER BY depth DESC)
)
SELECT s.conv_id, s.depth, any_value(parent_conv_id) AS parent_conv_id, any_value(n_convs) AS n_convs, coalesce(any_value(n_children), 0) AS n_children,
  CAST(sum(leaves) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens, any_value(ends_sha256) AS ends_sha256
FROM s LEFT JOIN ch ON ch.conv_id = s.conv_id AND ch.depth = s.depth GROUP BY s.conv_id, s.depth
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": _OP1,
    "op2_quality_rules": _OP2,
    "op3_url_filters": _OP3,
    "op11_importance_resampling": _OP11,
    "op13_conversation_trie": _OP13,
}
