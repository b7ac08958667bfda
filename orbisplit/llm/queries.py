"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbisplit.llm import (
    centroid_clustering,
    chat_format,
    decontaminate,
    embedding_dedup,
    mixing,
    ngram_join,
    prefix_trie,
    quality_rules,
    secret_scan,
    substring_dedup,
    token_counts,
    url_filter,
    warc,
)
from orbisplit.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    book = quality_rules.apply_policy(book, quality_rules.BASE, into="_base")
    book = quality_rules.apply_policy(book, quality_rules.PRODUCTION)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("_base")).alias("base_failed"), "kept", "failed_bits",
    )


SQL["op1_quality_rules"] = r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM a WHERE len(w) >= 8),
text_win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM win),
twice AS (SELECT doc_id, i FROM text_win QUALIFY count(*) OVER (PARTITION BY doc_id, s) >= 2),
gaps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS g FROM twice),
rep AS (SELECT doc_id, sum(g)::BIGINT AS n_repeat_words FROM gaps GROUP BY doc_id),
m AS (
  SELECT a.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_adj
  FROM a LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
    + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT
    + 16 * (10 * n_adj > 2 * n_words)::BIGINT + 32 * (2 * n_upper > word_chars)::BIGINT
    + 64 * (word_chars < 2 * n_words OR word_chars > 16 * n_words)::BIGINT)::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b
"""


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.joined(F.col("spans"), secret_scan.BASE_KINDS), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(rows.unionByName(extra))


SQL["op8_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(role) + length(regexp_replace(text, '\\|###|</turn>', 'x\0', 'g')))::BIGINT AS formatted_chars,
       true AS round_trip
FROM c GROUP BY conv_id
"""


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


SQL["op7_substring_dedup"] = r"""
WITH a AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM a WHERE len(w) >= 13)),
low AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, list(i) AS places FROM win JOIN low USING (s) WHERE doc_id > d GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT doc_id, unnest(places) AS i FROM hit)),
n AS (SELECT doc_id, count(*) AS c, list(p) AS ps FROM gone GROUP BY doc_id),
k AS (
  SELECT a.doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, w, coalesce(ps, []) AS ps FROM a LEFT JOIN n USING (doc_id)),
alive AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM k) u
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = u.doc_id AND g.p = u.p) GROUP BY doc_id)
SELECT k.doc_id, n_words, n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM k LEFT JOIN alive USING (doc_id)
"""


@query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


SQL["op9_ngram_join"] = r"""
WITH RECURSIVE a AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM a WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(d, c) AS (SELECT doc_id, doc_id FROM a UNION SELECT reach.d, both_ways.b FROM reach JOIN both_ways ON reach.c = both_ways.a)
SELECT d AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = d GROUP BY d
"""


@query
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text", "n_chars")


SQL["op2_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, lang, source,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n,
         (['web', 'books', 'news', 'forum'])[1 + coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS BIGINT), 0) % 4] AS dom,
         coalesce(lang, 'unknown') AS l, coalesce(source, 'unknown') AS s
  FROM documents),
leaf AS (SELECT dom, l, s, sum(n)::BIGINT AS tokens, (4 * sum(n))::BIGINT AS cap FROM d GROUP BY ALL),
n1 AS (SELECT dom, sum(cap)::BIGINT AS cap, (SELECT sum(tokens)::BIGINT FROM leaf) AS budget,
              CASE dom WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'news' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY dom),
f1 AS (SELECT *, cap * sum(w) OVER t <= w * (budget - coalesce(sum(cap) OVER b, 0)) AS is_full, sum(w) OVER t AS r, coalesce(sum(cap) OVER b, 0) AS p FROM n1
       WINDOW t AS (ORDER BY cap / w, dom ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (ORDER BY cap / w, dom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a1 AS (SELECT dom, CASE WHEN is_full THEN cap ELSE (w * (budget - min(p) FILTER (NOT is_full) OVER ())) // max(r) FILTER (NOT is_full) OVER () END AS budget FROM f1),
n2 AS (SELECT dom, l, sum(cap)::BIGINT AS cap, any_value(budget) AS budget,
              CASE l WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w FROM leaf JOIN a1 USING (dom) GROUP BY dom, l),
f2 AS (SELECT *, cap * sum(w) OVER t <= w * (budget - coalesce(sum(cap) OVER b, 0)) AS is_full, sum(w) OVER t AS r, coalesce(sum(cap) OVER b, 0) AS p FROM n2
       WINDOW t AS (PARTITION BY dom ORDER BY cap / w, l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
              b AS (PARTITION BY dom ORDER BY cap / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a2 AS (SELECT dom, l, CASE WHEN is_full THEN cap ELSE (w * (budget - min(p) FILTER (NOT is_full) OVER q)) // max(r) FILTER (NOT is_full) OVER q END AS budget
       FROM f2 WINDOW q AS (PARTITION BY dom)),
n3 AS (SELECT leaf.*, budget, 1 AS w FROM leaf JOIN a2 USING (dom, l)),
f3 AS (SELECT *, cap * sum(w) OVER t <= w * (budget - coalesce(sum(cap) OVER b, 0)) AS is_full, sum(w) OVER t AS r, coalesce(sum(cap) OVER b, 0) AS p FROM n3
       WINDOW t AS (PARTITION BY dom, l ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
              b AS (PARTITION BY dom, l ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a3 AS (SELECT dom, l, s, tokens, CASE WHEN is_full THEN cap ELSE (w * (budget - min(p) FILTER (NOT is_full) OVER q)) // max(r) FILTER (NOT is_full) OVER q END AS alloc
       FROM f3 WINDOW q AS (PARTITION BY dom, l)),
plan AS (SELECT dom, l, s, CASE WHEN tokens > 0 THEN alloc // tokens ELSE 0 END AS whole,
                alloc - CASE WHEN tokens > 0 THEN alloc // tokens ELSE 0 END * tokens AS rest FROM a3),
o AS (SELECT d.*, whole, rest, ('0x' || substr(md5('17:' || whole || ':' || doc_id), 1, 8))::BIGINT AS u FROM d JOIN plan USING (dom, l, s)),
c AS (SELECT *, sum(n) OVER (PARTITION BY dom, l, s ORDER BY u, doc_id, n) AS upto FROM o),
e AS (SELECT *, (whole + (rest > 0 AND upto <= rest)::BIGINT)::BIGINT AS epochs FROM c)
SELECT doc_id, lang, source, dom AS domain, n AS n_tokens, epochs FROM e WHERE epochs > 0
"""


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.report(table(spark, sf_dir, "embeddings"))


def _rounds(n: int) -> str:
    """The rounds of clustering, written out: a{i} assigns to the centroids c{i}, which come from a{i - 1}."""
    parts = []
    for i in range(n + 1):
        parts.append(f"""
d{i} AS (SELECT v.vec_id, v.x, c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - k.x[i]) * (v.x[i] - k.x[i])))::BIGINT AS d FROM v, c{i} k),
a{i} AS (SELECT vec_id, x, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if i < n:
            parts.append(f"""
s{i} AS (SELECT c, i, sum(y)::BIGINT AS s, count(*) AS m FROM (SELECT c, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY c, i),
n{i} AS (SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY i) AS x FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(n{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN n{i} USING (c))""")
    return ",".join(parts)


SQL["op11_centroid_clustering"] = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS c, x FROM (SELECT x, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT 40)),{_rounds(5)}
SELECT vec_id, a5.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a5.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (c)
"""


@query
def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op13_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS n
  FROM (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)
  WHERE len(list_filter(x, lambda e: e <> 0)) > 0),
link AS (SELECT l.vec_id AS a, r.vec_id AS b FROM v l JOIN v r ON l.vec_id <> r.vec_id AND list_inner_product(l.x, r.x) / (l.n * r.n) >= 0.9),
reach(d, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.d, link.b FROM reach JOIN link ON reach.c = link.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT d AS vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(c) AS component_id, d = min(c) AS kept FROM reach LEFT JOIN n ON n.a = d GROUP BY d
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a number's digits, bit by bit.
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT), lambda acc, d:
  list_reduce([xor(acc, d)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)))"""

SQL["op12_prefix_trie"] = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT c, p, role, text FROM t JOIN ids USING (c) WHERE p > h
  UNION ALL SELECT ids.c, p, role, text FROM ids JOIN t ON t.c = ids.c - ids.c % 5 AND p <= h),
s AS (SELECT c, p, role, text, row_number() OVER (PARTITION BY c ORDER BY p) AS depth, count(*) OVER (PARTITION BY c) AS n FROM r),
k AS (
  SELECT c, depth, n, octet_length(encode(text)) AS size,
         sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY c ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS k FROM s
  UNION ALL SELECT ids.c, 0, coalesce(max(depth), 0), 0, 'root' FROM ids LEFT JOIN s USING (c) GROUP BY ids.c),
node AS (
  SELECT k, min(c) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(size) AS size,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = n), '')) AS ends_sha256 FROM k GROUP BY k),
up AS (
  SELECT node.k, p.k AS pk, p.conv_id AS parent_conv_id FROM node JOIN k b ON b.c = node.conv_id AND b.depth = node.depth - 1 JOIN node p ON p.k = b.k),
kids AS (SELECT pk AS k, count(*) AS n_children FROM up GROUP BY pk),
full_node AS (SELECT node.*, parent_conv_id, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN up USING (k) LEFT JOIN kids USING (k)),
below AS (
  SELECT a.k, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved_tokens
  FROM full_node f JOIN k a ON a.c = f.conv_id AND a.depth <= f.depth GROUP BY a.k)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM full_node JOIN below USING (k)
"""
