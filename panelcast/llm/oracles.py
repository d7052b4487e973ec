"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from panelcast.llm.linktrust import DAMPING, ROUNDS
from panelcast.llm.mixing import BLOCK_TOKENS, STEPS
from panelcast.llm.queries import ENTROPY, HARD_CASE, RULES

CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{HARD_CASE}'), (-1, 1, 'assistant', '{HARD_CASE}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n')) + 1
      + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

MIXING = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
n AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS n FROM t GROUP BY source HAVING sum(tokens) > 0),
s AS (SELECT list(n / total ORDER BY source) AS s, any_value(total) AS total FROM n, (SELECT sum(n) AS total FROM n)),
b AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
  FROM (SELECT step, low, high, mid, -list_sum(list_transform(w, lambda x: x / list_sum(w) * ln(x / list_sum(w)))) >= {ENTROPY} * ln(len(w)) AS ok
        FROM (SELECT step, low, high, mid, list_transform(s.s, lambda x: pow(x, mid)) AS w
              FROM (SELECT *, (low + high) / 2 AS mid FROM b WHERE step < {STEPS}), s))),
x AS (SELECT CASE WHEN -list_sum(list_transform(s.s, lambda x: x * ln(x))) >= {ENTROPY} * ln(len(s.s)) THEN 1.0 ELSE low END AS x
      FROM b, s WHERE step = {STEPS}),
w AS (SELECT source, n, CAST(floor(pow(n / total, x) / sum(pow(n / total, x)) OVER () * total + 0.5) AS BIGINT) AS budget FROM n, s, x),
r AS (SELECT source, budget // n AS reads, budget % n AS rest, greatest(1, n // {BLOCK_TOKENS}) AS blocks FROM w),
d AS (SELECT *, CAST('0x' || substr(md5('5:' || doc_id), 1, 12) AS BIGINT) AS draw FROM t),
o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS sofar FROM d)
SELECT doc_id, o.source, CAST(tokens AS BIGINT) AS tokens, CAST(coalesce(reads + CASE WHEN sofar < rest THEN 1 ELSE 0 END, 0) AS BIGINT) AS copies
FROM o LEFT JOIN r ON o.source IS NOT DISTINCT FROM r.source
"""

WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS origin FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM g
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id
"""


def _ranks() -> str:
    """The rounds of the link graph, one table each."""
    rounds = [f"""r{k} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (
  SELECT r.kind, e.other AS host, r.rank * e.part * {DAMPING} AS rank FROM r{k - 1} r JOIN edges e ON e.kind = r.kind AND e.host = r.host
  UNION ALL SELECT kind, host, rank FROM r0) GROUP BY kind, host)""" for k in range(1, ROUNDS + 1)]
    return ",\n".join(rounds)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
URLS = f"""
WITH rules(ending, start, rule, verdict) AS (VALUES {", ".join(
    f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{v}')" for r, v in RULES)}),
u AS (SELECT page_id, html, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
paths AS (SELECT DISTINCT host, path FROM u),
fits AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM paths JOIN rules
  ON (host = ending OR ends_with(host, '.' || ending)) AND starts_with(path, start) GROUP BY host, path),
judged AS (SELECT u.*, rule, verdict FROM u LEFT JOIN fits USING (host, path)),
found AS (SELECT host AS src, {_LOWER.format("unnest(regexp_extract_all(html, '(?i)<a[ \\t\\n\\x0B\\f\\r][^>]*?href[ \\t\\n\\x0B\\f\\r]*=[ \\t\\n\\x0B\\f\\r]*[\"'']?[ \\t\\n\\x0B\\f\\r]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'' \\t\\n\\x0B\\f\\r>]+)', 1))")} AS dst FROM u),
links AS (SELECT src, dst, count(*) AS links FROM found WHERE src <> dst AND src <> '' GROUP BY src, dst),
edges AS MATERIALIZED (
  SELECT 't' AS kind, src AS host, dst AS other, links / sum(links) OVER (PARTITION BY src) AS part FROM links
  UNION ALL SELECT 'd', dst, src, links / sum(links) OVER (PARTITION BY dst) FROM links
  UNION ALL SELECT 'e', dst, src, links / sum(links) OVER (PARTITION BY src) FROM links),
seeds AS (SELECT host, count(*) FILTER (verdict = 'allow') / count(*) AS trust, count(*) FILTER (verdict = 'block') / count(*) AS distrust
  FROM judged WHERE host <> '' GROUP BY host),
r0 AS MATERIALIZED (SELECT 't' AS kind, host, trust * (1 - {DAMPING}) AS rank FROM seeds WHERE trust > 0
  UNION ALL SELECT unnest(['d', 'e']), host, distrust * (1 - {DAMPING}) FROM seeds WHERE distrust > 0),
{_ranks()},
standing AS (SELECT host, coalesce(sum(rank) FILTER (kind = 't'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'd'), 0) AS distrust,
    coalesce(sum(rank) FILTER (kind = 'e'), 0) AS exposure FROM r{ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust > trust AND exposure >= (1 - {DAMPING}) / 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN standing USING (host)
"""

EXACT = """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

ORACLES = {"op1_chat_format": CHAT, "op3_mixing": MIXING, "op6_warc": WARC, "op7_vector_dedup": VECTORS, "op9_url_filter": URLS,
           "op11_exact_dedup": EXACT}
