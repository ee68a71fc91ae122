"""DuckDB SQL for the numbered queries, over the whole tables."""

from __future__ import annotations

from splicework.llm import line_rules as lr

_WORD = r"[^\x20\x09-\x0D]+"

OP6 = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents
), l AS (
  SELECT rid, doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w
), each AS (SELECT rid, unnest(ls) AS line FROM l),
measured AS (
  SELECT rid, line, len(regexp_extract_all(line, '{_WORD}')) AS n, len(regexp_extract_all(line, '{lr.MARKS}')) AS marks,
    len(regexp_extract_all(line, '{lr.NAV_MARKS}')) AS nav, len(regexp_extract_all(line, '{lr.LINK}')) AS links,
    length(regexp_replace(line, '{lr.NO_LETTERS}', '', 'g')) AS letters, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS solid,
    regexp_matches(line, '{lr.CLOSED.replace("'", "''")}') AS closed, regexp_matches(line, '{lr.BOILERPLATE.replace("'", "''")}') AS boiler FROM each
), passed AS (
  SELECT DISTINCT rid, line, n FROM measured
  WHERE NOT (marks * 100 >= n * {lr.LOUD} OR (n < {lr.LEAST_WORDS} AND NOT closed) OR letters * 100 < solid * {lr.LETTERS} OR links * 100 >= n * {lr.LINKS}
    OR (nav >= {lr.NAV_LEAST} AND nav * 100 >= n * {lr.NAV}) OR (n <= {lr.BOILERPLATE_WORDS} AND boiler))
), stay AS (SELECT rid, sum(n) AS stay FROM passed GROUP BY rid),
win AS (
  SELECT rid, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM l)
), twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
counts AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{lr.SYMBOLS}'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (len(ws) - coalesce(stay.stay, 0))::BIGINT AS lost_words
  FROM l LEFT JOIN rep USING (rid) LEFT JOIN stay USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_words * 100 <= n_words * {lr.MOST_LOST} AS kept, lost_words
FROM counts
"""

OP8 = r"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id, md5(coalesce(url, ''))[1] IN ('0', '1', '2', '3') AS held,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u
), s AS (
  SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said,
    '^^' || regexp_replace(regexp_replace(lower(host || path), '[0-9]', '0', 'g'), '[^a-z0./_-]', '~', 'g') || '$' AS signs FROM r
), g AS (SELECT rid, held, said, substring(signs, i, 3) AS gram FROM (SELECT rid, held, said, signs, unnest(range(1, length(signs) - 1)) AS i FROM s)),
ch AS (SELECT unnest(string_split('^$~0./_-abcdefghijklmnopqrstuvwxyz', '')) AS c),
every AS (SELECT a.c || b.c || x.c AS gram FROM ch a, ch b, ch x WHERE a.c <> '$' AND b.c <> '$' AND x.c <> '^'),
seen AS (SELECT gram, count(*) FILTER (said = 'allow') AS allow, count(*) FILTER (said = 'block') AS block FROM g WHERE NOT held AND said IS NOT NULL GROUP BY gram),
grams AS (SELECT gram, cls, coalesce(CASE cls WHEN 'allow' THEN allow ELSE block END, 0) AS n FROM every LEFT JOIN seen USING (gram), (VALUES ('allow'), ('block')) c(cls)),
o2 AS (SELECT cls, gram[1:2] AS c, sum(n) AS total, count(*) FILTER (n > 0) AS kinds FROM grams GROUP BY ALL),
bi AS (SELECT cls, gram[2:3] AS b, sum(n) AS n FROM grams GROUP BY ALL),
o1 AS (SELECT cls, b[1:1] AS c, sum(n) AS total, count(*) FILTER (n > 0) AS kinds FROM bi GROUP BY ALL),
un AS (SELECT cls, gram[3:3] AS x, sum(n) AS n FROM grams GROUP BY ALL),
o0 AS (SELECT cls, sum(n) AS total, count(*) FILTER (n > 0) AS kinds FROM un GROUP BY ALL),
p0 AS (SELECT cls, x, CASE WHEN total > 0 THEN (n + kinds * (1.0::DOUBLE / 34)) / (total + kinds) ELSE 1.0::DOUBLE / 34 END AS p FROM un JOIN o0 USING (cls)),
p1 AS (SELECT bi.cls, b, CASE WHEN total > 0 THEN (bi.n + kinds * p) / (total + kinds) ELSE p END AS p
  FROM bi JOIN o1 ON o1.cls = bi.cls AND o1.c = b[1:1] JOIN p0 ON p0.cls = bi.cls AND x = b[2:2]),
p2 AS (SELECT grams.cls, gram, CASE WHEN total > 0 THEN (grams.n + kinds * p) / (total + kinds) ELSE p END AS p
  FROM grams JOIN o2 ON o2.cls = grams.cls AND o2.c = gram[1:2] JOIN p1 ON p1.cls = grams.cls AND b = gram[2:3]),
m AS (SELECT gram, round((ln(max(p) FILTER (cls = 'allow')) - ln(max(p) FILTER (cls = 'block'))) * 1000000)::BIGINT AS d FROM p2 GROUP BY gram),
t AS (SELECT rid, sum(d) AS total, count(*) AS n FROM g JOIN m USING (gram) GROUP BY rid),
sc AS (SELECT s.*, floor(total / n)::BIGINT AS score, greatest(-2000, least(2000, floor(floor(total / n) / 10000)))::INTEGER AS bin FROM s JOIN t USING (rid)),
h AS (SELECT bin, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS b FROM sc WHERE said IS NOT NULL AND held GROUP BY bin),
v AS (SELECT bin, sum(a) OVER () AS sa, sum(b) OVER () AS sb,
  sum(a) OVER (ORDER BY bin DESC) * sum(b) OVER () + coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * sum(a) OVER () AS value FROM h),
cut AS (SELECT floor((coalesce(lag(bin) OVER (ORDER BY bin), bin - 1) + bin + 1) / 2)::INTEGER AS edge FROM v WHERE sa > 0 AND sb > 0 ORDER BY value DESC, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bin >= coalesce((SELECT edge FROM cut), -2000) THEN 'allow' ELSE 'block' END) AS verdict FROM sc
"""

OP9 = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k(kind, ord, before, rx) AS (VALUES
  ('email', 1, '', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'),
  ('ip', 2, '', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  ('card', 3, '', '[0-9](?:[\x20-]?[0-9])+'),
  ('phone', 4, '', '\+[0-9][\x20().0-9-]+[0-9]'),
  ('iban', 5, '(?:^|[^A-Za-z0-9])', '[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[0-9]{1,3})?)'),
  ('secret', 6, '', '[A-Za-z0-9_/+-]{20,}')),
c(kind, words, alone, more, less) AS (VALUES
  ('email', 'mail|contact|write to', 80, 15, 20), ('ip', '\bip\b|address|host|server', 60, 30, 20), ('card', 'card|visa|payment|credit', 80, 15, 20),
  ('phone', 'phone|tel|call|mobile|fax', 60, 30, 20), ('iban', 'iban|account|bank|konto|cuenta|compte', 60, 30, 20),
  ('secret', 'token|secret|passw|\bkey\b|api[_-]?key|access[_-]?key|credential|bearer|authorization', 30, 40, 30)),
m AS (SELECT rid, kind, ord, regexp_extract_all(t, '(?s)(.*?' || before || ')(' || rx || ')', 1) AS g,
  regexp_extract_all(t, '(?s)(.*?' || before || ')(' || rx || ')', 2) AS h FROM t, k),
e AS (SELECT rid, kind, ord, g[i] AS gap, h[i] AS hit, i FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m)),
s AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i)::BIGINT AS stop FROM e),
d AS (SELECT *, stop - length(hit) AS start, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, replace(hit, ' ', '') AS bare,
  alone + CASE WHEN regexp_matches(lower(right(gap, 40)), words) THEN more ELSE 0 END
    - CASE WHEN regexp_matches(lower(right(gap, 40)), 'example|sample|dummy|placeholder|\bcommit\b|checksum|\bsha-?[0-9]|\bmd5\b|digest') THEN less ELSE 0 END AS score FROM s JOIN c USING (kind)),
ok AS (SELECT rid, kind, ord, start, stop, score FROM d WHERE CASE kind
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda p: coalesce(try_cast(p AS HUGEINT) <= 255, false)))
  WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda p:
    CASE WHEN (length(digits) - p) % 2 = 0 THEN digits[p]::INT WHEN digits[p]::INT > 4 THEN digits[p]::INT * 2 - 9 ELSE digits[p]::INT * 2 END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  WHEN 'iban' THEN length(bare) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(bare[5:] || bare[:4], ''), lambda x: ascii(x)::BIGINT), lambda a, x:
    CASE WHEN x < 65 THEN (a * 10 + x - 48) % 97 ELSE (a * 100 + x - 55) % 97 END, 0::BIGINT) = 1 AND score >= 50
  WHEN 'secret' THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND score >= 50
  ELSE true END)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) FILTER (ord <= 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) FILTER (kind IS NOT NULL), '') AS spans,
  coalesce(string_agg(score::VARCHAR, ',' ORDER BY ord, start) FILTER (kind IS NOT NULL), '') AS scores
FROM t LEFT JOIN ok USING (rid) GROUP BY rid
"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source),
w AS (SELECT *, CASE src % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * n / w, src) AS k FROM w),
v AS (SELECT *, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
  sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, sum(n) OVER () AS total FROM o),
first AS (SELECT full_before, open_w, k FROM v WHERE (3 * total - 4 * full_before) * w <= 2 * n * 2 * open_w ORDER BY k LIMIT 1),
g AS (SELECT v.source, v.src, v.n, v.total, CASE WHEN v.k < f.k THEN 2.0::DOUBLE * v.n ELSE ((3 * total - 4 * f.full_before) * w)::DOUBLE / (2 * f.open_w)::DOUBLE END AS target FROM v, first f),
h AS (SELECT *, floor(target + 0.5)::BIGINT AS goal, count(*) OVER () AS n_sources FROM g),
e AS (SELECT *, floor(coalesce(sum(target) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (3.0 * total) * 2147483648)::BIGINT + src * 2147483648 // (2 * n_sources) AS lo,
  floor(sum(target) OVER (ORDER BY src) / (3.0 * total) * 2147483648)::BIGINT + (src + 1) * 2147483648 // (2 * n_sources) AS hi FROM h WHERE total > 0),
sl AS (SELECT i, (i * 1327217885) % 2147483648 AS x FROM (SELECT unnest(range((SELECT greatest(65536, 128 * count(*)) FROM s))) AS i)),
rk AS (SELECT src, n, goal, count(*) OVER (PARTITION BY src) AS slots, row_number() OVER (PARTITION BY src ORDER BY i) - 1 AS r FROM sl JOIN e ON x >= lo AND x < hi WHERE goal > 0),
bl AS (SELECT *, greatest(1, slots::HUGEINT * n // goal)::BIGINT AS nb FROM rk),
pos AS (SELECT *, r % nb AS blk, (r % nb)::HUGEINT * n // nb AS st, (r % nb + 1)::HUGEINT * n // nb AS en FROM bl),
tk AS (SELECT src, blk, st, en - st AS len, greatest(0, least(en - st, goal - (r // nb) * n - st)) AS take FROM pos),
tm AS (SELECT src, blk, any_value(st) AS st, any_value(len) AS len, list(take) AS takes FROM tk GROUP BY src, blk),
nb AS (SELECT src, any_value(nb) AS nb FROM bl GROUP BY src),
p AS (SELECT d.rid, d.doc_id, d.size, h.src, h.n, h.target, nb.nb, coalesce(sum(size) OVER (PARTITION BY h.src ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source LEFT JOIN nb ON nb.src = h.src),
q AS (SELECT p.*, unnest(CASE WHEN size > 0 AND nb > 0 THEN range((((a + 1)::HUGEINT * nb - 1) // n)::BIGINT, (((a + size)::HUGEINT * nb - 1) // n)::BIGINT + 1) ELSE [NULL] END) AS blk FROM p)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(q.n)::BIGINT AS source_size, any_value(target) AS target,
  coalesce(sum(list_sum(list_transform(takes, lambda t: greatest(0, least(a + size - st, t) - greatest(a - st, 0))))), 0)::BIGINT AS taken
FROM q LEFT JOIN tm ON tm.src = q.src AND tm.blk = q.blk GROUP BY rid
"""

_CLEAN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id AS id, regexp_extract_all({_ASCII_LOWER}, '{_CLEAN}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS rid, item_id AS id, regexp_extract_all({_ASCII_LOWER}, '{_CLEAN}') AS w FROM benchmark),
ds AS (SELECT DISTINCT rid, id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)),
bs AS (SELECT DISTINCT rid, id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM b)),
n AS (SELECT rid, count(*) AS n FROM bs GROUP BY rid)
SELECT ds.id AS doc_id, bs.id AS item_id, n.n AS n_shingles, count(*) AS n_shared, count(*) / n.n AS containment
FROM ds JOIN bs USING (s) JOIN n ON n.rid = bs.rid GROUP BY ds.rid, ds.id, bs.rid, bs.id, n.n HAVING count(*) >= 0.8 * n.n
"""

OP3 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS hex, coalesce(html, '') AS body FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLES = {"op1_decontamination": OP1, "op3_warc": OP3, "op6_line_rules": OP6, "op8_url_filter": OP8, "op9_pii": OP9, "op10_mixing": OP10}
