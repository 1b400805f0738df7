"""SQL counterparts of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

SOURCE_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (gn.total + v.v) AS p
  FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
lp AS (
  SELECT lang, term, 1 + 1000000000 * (sum(n) + 1)::BIGINT // (any_value(t.total) + any_value(v.v)) AS p
  FROM c JOIN (SELECT lang, sum(total)::BIGINT AS total FROM gn GROUP BY lang) t USING (lang) JOIN v USING (lang) GROUP BY lang, term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sums.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (
  SELECT p.lang, p.source, p.term AS item, (p.p - lp.p) * (p.p - lp.p) // lp.p AS value
  FROM p JOIN lp ON p.lang = lp.lang AND p.term = lp.term WHERE p.n > 0 AND p.p > lp.p),
ranked AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

URL_RULES = r"""
WITH sites(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
patterns(name, exception, regex) AS (VALUES
  ('||cheap-pills.', false, '^[^/?#]*://([^/?#]*\.)?cheap-pills\.'), ('||spam-farm.', false, '^[^/?#]*://([^/?#]*\.)?spam-farm\.'),
  ('||casino.', false, '^[^/?#]*://([^/?#]*\.)?casino\.'), ('||malware.', false, '^[^/?#]*://([^/?#]*\.)?malware\.'),
  ('||phishing.', false, '^[^/?#]*://([^/?#]*\.)?phishing\.'), ('-casino-', false, '-casino-'),
  ('^viagra^', false, '[^a-z0-9_.%-]viagra([^a-z0-9_.%-]|$)'), ('^porn^', false, '[^a-z0-9_.%-]porn([^a-z0-9_.%-]|$)'),
  ('^xxx^', false, '[^a-z0-9_.%-]xxx([^a-z0-9_.%-]|$)'), ('^free-download^', false, '[^a-z0-9_.%-]free-download([^a-z0-9_.%-]|$)'),
  ('^warez^', false, '[^a-z0-9_.%-]warez([^a-z0-9_.%-]|$)'), ('^torrent^', false, '[^a-z0-9_.%-]torrent([^a-z0-9_.%-]|$)'),
  ('/wp-login.php', false, '/wp-login\.php'), ('^clickbait^', false, '[^a-z0-9_.%-]clickbait([^a-z0-9_.%-]|$)'), ('*.exe|', false, '\.exe$'),
  ('@@||help.*^warez^', true, '^[^/?#]*://([^/?#]*\.)?help\.(.|\n)*[^a-z0-9_.%-]warez([^a-z0-9_.%-]|$)'), ('@@^recovery^', true, '[^a-z0-9_.%-]recovery([^a-z0-9_.%-]|$)')),
u AS (
  SELECT row_number() OVER () AS r, page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
s AS (
  SELECT u.r, arg_max(sites.host || sites.path, length(sites.host || sites.path)) AS rule, arg_max(sites.verdict, length(sites.host || sites.path)) AS verdict
  FROM u JOIN sites ON (u.host = sites.host OR ends_with(u.host, '.' || sites.host)) AND starts_with(u.path, sites.path) GROUP BY u.r),
p AS (
  SELECT u.r, max((exception::INTEGER, name)) AS best FROM u JOIN patterns ON regexp_matches(u.low, regex) GROUP BY u.r)
SELECT page_id, host, path, s.rule, coalesce(s.verdict, CASE WHEN p.r IS NULL OR p.best[1] = 1 THEN 'allow' ELSE 'block' END) AS verdict,
  coalesce(s.rule, p.best[2]) AS matched
FROM u LEFT JOIN s ON u.r = s.r LEFT JOIN p ON u.r = p.r
"""
