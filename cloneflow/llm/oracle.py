"""The queries of this package as SQL, where SQL can express them."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE["op1_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(min(embedding), lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE["op3_decontaminate"] = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
  FROM items, unnest(generate_series(1, greatest(len(w) - 9, least(len(w), 1)))) AS t(i)),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT DISTINCT size FROM windows), docs, unnest(generate_series(1, len(w) - size + 1)) AS t(i)),
found AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows USING (words)),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM found), unnest(generate_series(i, i + size - 1)) AS t(j)
  GROUP BY doc_id),
shared AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN shared USING (doc_id)
"""

_STRIPPED = "regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"
ORACLE["op4_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate({_STRIPPED}, '{UPPER}', '{LOWER}') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.keeper AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _level(source: str) -> str:
    """The moment estimate of a prior's strength, as in the operator."""
    return f"""
  SELECT least(greatest(CASE WHEN rho > 0 THEN (1 - rho) / rho WHEN rho IS NULL THEN 1.0 ELSE 1000.0 END, 1.0), 1000.0) AS strength FROM (
    SELECT CASE WHEN room > 0 THEN (square - total * p * p - p * (1 - p) * (k - 1)) / room END AS rho FROM (
      SELECT *, p * (1 - p) * (total - sizes / total - (k - 1)) AS room FROM (
        SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS total, sum(bad)::DOUBLE / sum(n) AS p,
          sum(bad::DOUBLE * bad / n) AS square, sum(n * n)::DOUBLE AS sizes
        FROM {source} WHERE n > 0)))"""


ORACLE["op7_url_filter"] = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
marks AS (SELECT doc_id, max(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
    count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM urls LEFT JOIN marks ON page_id = doc_id GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
overall AS (SELECT (sum(bad) + 1.0) / (sum(n) + 2.0) AS mean FROM suffixes),
of_suffix AS ({_level("suffixes")}), of_domain AS ({_level("domains")}), of_host AS ({_level("hosts")}),
suffix_means AS (SELECT suffix, (bad + strength * mean) / (n + strength) AS mean FROM suffixes, of_suffix, overall),
domain_means AS (
  SELECT domain, (bad + strength * mean) / (n + strength) AS mean FROM domains JOIN suffix_means USING (suffix), of_domain),
host_means AS (
  SELECT host, n, strength, (bad + strength * mean) / (n + strength) AS mean FROM hosts JOIN domain_means USING (domain), of_host),
methods AS (
  SELECT host, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (n + strength + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS method FROM host_means),
rules(of, start, said) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fitting AS (
  SELECT host, path, arg_max(of || start, length(of || start)) AS rule, arg_max(said, length(of || start)) AS said
  FROM (SELECT DISTINCT host, path FROM urls) JOIN rules
    ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start) GROUP BY host, path)
SELECT page_id, urls.host, urls.path, rule, coalesce(said, method) AS verdict
FROM urls JOIN methods USING (host) LEFT JOIN fitting ON urls.host = fitting.host AND urls.path = fitting.path
"""

ORACLE["op10_warc"] = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM payloads LEFT JOIN firsts USING (payload_digest)
"""

# Shares by sources in order of size over weight; the large documents of a source one after the other, then the rest at one rate.
ORACLE["op11_mix"] = """
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce('s' || source, 'z') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
sources AS (SELECT key, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY key) - 1 AS rank FROM sized GROUP BY key),
weighed AS (
  SELECT *, sum(source_size) OVER () AS total, row_number() OVER w AS k,
    sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM (SELECT key, source_size, ([5.0, 2.0, 1.0])[rank % 3 + 1]::DOUBLE AS weight FROM sources) WINDOW w AS (ORDER BY source_size / weight, key)),
shares AS (SELECT *, ((total - 3 * coalesce(before, 0)) / open)::DOUBLE AS share FROM weighed),
share AS (SELECT k, share FROM shares WHERE weight * share <= 3 * source_size ORDER BY k LIMIT 1),
targets AS (
  SELECT key, source_size, CASE WHEN weighed.k < coalesce(share.k, 1 << 62) THEN (3 * source_size)::DOUBLE ELSE weight * share.share END AS target,
    ('0x' || substr(md5('42:' || key[2:]), 1, 6))::BIGINT * 4 AS shift
  FROM weighed LEFT JOIN share ON true),
aimed AS (SELECT *, coalesce(size > target * 0.005 AND target > 0, false) AS is_large FROM sized JOIN targets USING (key)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key, is_large ORDER BY size DESC, doc_id NULLS FIRST) AS i FROM aimed),
walk AS (
  SELECT key, 0::BIGINT AS i, NULL::BIGINT AS doc_id, NULL::BIGINT AS size, 0::BIGINT AS place, 0::BIGINT AS move, 0::BIGINT AS pos, target AS lacks, source_size AS has, shift FROM targets
  UNION ALL
  SELECT key, i, doc_id, size, pos, move, pos + move, lacks - (((pos + move + shift) >> 26) - ((pos + shift) >> 26)) * size, has - size, shift
  FROM (SELECT w.key, n.i, n.doc_id, n.size, w.pos, w.lacks, w.has, w.shift,
      least(3::BIGINT << 26, floor(greatest(w.lacks, 0) / w.has * 67108864.0)::BIGINT, floor(greatest(w.lacks, 0) / n.size)::BIGINT << 26) AS move
    FROM walk w JOIN numbered n ON n.is_large AND n.key = w.key AND n.i = w.i + 1)),
ends AS (
  SELECT key, pos, CASE WHEN has > 0 THEN least(3::BIGINT << 26, floor(greatest(lacks, 0) / has * 67108864.0)::BIGINT) ELSE 0 END AS move
  FROM walk QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1),
places AS (
  SELECT key, doc_id, size, place, move FROM walk WHERE i > 0
  UNION ALL
  SELECT key, doc_id, size, pos + (i - 1) * move, move FROM numbered JOIN ends USING (key) WHERE NOT is_large)
SELECT doc_id, size, source_size, target, (((place + move + shift) >> 26) - ((place + shift) >> 26)) * size AS taken
FROM places JOIN targets USING (key)
"""
