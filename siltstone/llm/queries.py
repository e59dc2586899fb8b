"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import merkle, packing, pii, preference, quality, simhash, token_counts, toxicity, url_filter, word_bpe
from siltstone.session import table

#: Of so many pages one is on the list: no host tells which.
LISTED = 7


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list stands for one that was made elsewhere: the canonical URLs of the pages whose id is divisible by 7, on any host, ruled or not."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    listed = pages.where(F.col("page_id") % LISTED == 0).select(url_filter.canonical(host, path).alias("listed"))
    return url_filter.filter_urls(pages, listed).drop("by")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with the assistant against one whose last reply repeats what was said before; masks as start:end,..."""
    talks = preference.grouped(table(spark, sf_dir, "conversations"))
    pairs = talks.select(F.col("conv_id"), F.col("turns").alias("chosen"), preference.repeating(F.col("turns")).alias("rejected")).where("rejected is not null")
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    formatted = preference.format_pairs(pairs, id_col="conv_id")
    return formatted.select("conv_id", "n_prompt_turns", "prompt", "chosen", spans("chosen_mask"), "rejected", spans("rejected_mask"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_decode(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_url_filter, op2_pii, op3_quality_rules, op4_preference_format, op5_simhash, op6_word_bpe, op7_packing, op8_toxicity, op9_token_counts, op10_fingerprints)
    return {f.__name__: f for f in every}


_OP1 = r"""
WITH s AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') END AS canon FROM s),
l AS (SELECT DISTINCT canon FROM c WHERE page_id % 7 = 0),
r AS (
  SELECT page_id, host, path, canon, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM c)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN l ON r.canon = l.canon
"""

_OP3 = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
a AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS soft FROM f),
h AS (SELECT source, count(*) AS n, sum(soft::INT) AS f FROM a GROUP BY source),
b AS (SELECT least(greatest(avg(f / n), 1e-6), 1 - 1e-6) AS mu, var_pop(f / n) AS v, avg(1.0::DOUBLE / n) AS c FROM h),
p AS (SELECT mu, least(greatest(mu * (1 - mu) / greatest(v - mu * (1 - mu) * c, 1e-12) - 1, 1e-3), 1e3) AS wt FROM b),
s AS (SELECT source, mu, (f + mu * wt) / (n + wt) AS r, n + wt + 1 AS w FROM h, p),
t AS (SELECT source, CASE
    WHEN r - 2 * sqrt(r * (1 - r) / w) > mu + (1 - mu) / 3.0::DOUBLE THEN 'rejected'
    WHEN r + 2 * sqrt(r * (1 - r) / w) < 0.5 * mu THEN 'trusted' ELSE 'watched' END AS verdict FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND CASE verdict WHEN 'rejected' THEN false WHEN 'trusted' THEN true ELSE NOT soft END AS kept, verdict AS host_verdict
FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source
"""


_OP4 = r"""
WITH d AS (SELECT DISTINCT conv_id, coalesce(turn, -9223372036854775807 - 1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM d),
l AS (SELECT conv_id, max(i) AS last FROM n WHERE role = 'assistant' GROUP BY conv_id),
b AS (SELECT l.conv_id, last, max(CASE WHEN i < last AND role = 'assistant' THEN i END) AS said FROM l JOIN n ON l.conv_id = n.conv_id GROUP BY l.conv_id, last),
t AS (SELECT b.conv_id, last, coalesce(n.text, '') AS text FROM b LEFT JOIN n ON n.conv_id = b.conv_id AND n.i = coalesce(said, last - 1)),
r AS (SELECT n.conv_id, n.i, n.role, n.text AS c, CASE WHEN n.i = t.last THEN t.text ELSE n.text END AS r FROM n JOIN t ON n.conv_id = t.conv_id),
p AS (SELECT conv_id, coalesce(min(CASE WHEN c <> r THEN i END) - 1, max(i)) AS n FROM r GROUP BY conv_id),
e AS (SELECT r.conv_id, n, i, role, '<|im_start|>' || role || chr(10) || c || '<|im_end|>' || chr(10) AS ct, '<|im_start|>' || role || chr(10) || r || '<|im_end|>' || chr(10) AS rt FROM r JOIN p ON r.conv_id = p.conv_id),
o AS (
  SELECT *, sum(CASE WHEN i > n THEN length(ct) ELSE 0 END) OVER w AS ce, sum(CASE WHEN i > n THEN length(rt) ELSE 0 END) OVER w AS re
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id, n AS n_prompt_turns, coalesce(string_agg(ct, '' ORDER BY i) FILTER (WHERE i <= n), '') AS prompt,
       coalesce(string_agg(ct, '' ORDER BY i) FILTER (WHERE i > n), '') AS chosen,
       coalesce(string_agg((ce - length(ct) + 13 + length(role))::BIGINT || ':' || (ce - 1)::BIGINT, ',' ORDER BY i) FILTER (WHERE i > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(rt, '' ORDER BY i) FILTER (WHERE i > n), '') AS rejected,
       coalesce(string_agg((re - length(rt) + 13 + length(role))::BIGINT || ':' || (re - 1)::BIGINT, ',' ORDER BY i) FILTER (WHERE i > n AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY conv_id, n
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1, "op3_quality_rules": _OP3, "op4_preference_format": _OP4}
