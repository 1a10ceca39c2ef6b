"""The same results as SQL over the base tables, for the operators that SQL can express."""

from __future__ import annotations

from tripleweave.llm.licenses import GAP, RULES, SENTENCES
from tripleweave.llm.urls import LEVELS

OP1 = r"""
WITH a AS (SELECT page_id, url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl FROM pages),
b AS (SELECT *, 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: '
    || octet_length(encode(html)) || nl || nl || html AS block FROM a),
c AS (SELECT *, 'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(html) AS payload_digest,
    md5('response' || length(coalesce(page_id::VARCHAR, '')) || ':' || coalesce(page_id::VARCHAR, '')
      || length(coalesce(url, '')) || ':' || coalesce(url, '') || '64:' || sha256(block)) AS h FROM b),
d AS (SELECT *, '<urn:uuid:' || regexp_replace(h, '^(.{8})(.{4}).(.{3}).(.{3})(.{12})$', '\1-\2-5\3-8\4-\5')
    || '>' AS id FROM c),
e AS (SELECT *, regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)', ' ', 'g'),
      '(?is)<head\b.*?</head>', ' ', 'g'), '(?is)<nav\b.*?</nav>', ' ', 'g'), chr(13) || chr(10) || chr(9) || chr(11) || chr(12), '     '),
      '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|main|body|html)\b[^>]*>',
      chr(10), 'g'), '<[^>]*>', '', 'g') AS raw,
    regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1) AS title,
    regexp_extract(html, '(?is)<html\b[^>]*\blang="([^"]*)"', 1) AS lang,
    regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1) AS links,
    md5('conversion' || length(id) || ':' || id) AS ch, md5('metadata' || length(id) || ':' || id) AS mh FROM d),
f AS (SELECT *, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(raw,
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'),
      ' +', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text,
    '<urn:uuid:' || regexp_replace(ch, '^(.{8})(.{4}).(.{3}).(.{3})(.{12})$', '\1-\2-5\3-8\4-\5') || '>' AS cid,
    '<urn:uuid:' || regexp_replace(mh, '^(.{8})(.{4}).(.{3}).(.{3})(.{12})$', '\1-\2-5\3-8\4-\5') || '>' AS mid
  FROM e),
g AS (SELECT *, 'http-status: 200' || nl || 'http-content-type: text/html; charset=utf-8' || nl
      || 'http-header: Content-Type: text/html; charset=utf-8' || nl
      || 'http-header: Content-Length: ' || octet_length(encode(html)) || nl
      || 'source-block-digest: ' || block_digest || nl || 'source-payload-digest: ' || payload_digest || nl
      || CASE WHEN trim(title) <> '' THEN 'title: ' || regexp_replace(trim(title), ' *[\r\n]+ *', ' ', 'g') || nl ELSE '' END
      || CASE WHEN lang <> '' THEN 'language: ' || regexp_replace(lang, ' *[\r\n]+ *', ' ', 'g') || nl ELSE '' END
      || coalesce(array_to_string(list_transform(links,
        lambda x: 'outlink: ' || regexp_replace(x, ' *[\r\n]+ *', ' ', 'g') || nl), ''), '') AS about FROM f),
r AS (SELECT cid AS record_id, 'conversion' AS type, url AS uri, 'text/plain; charset=utf-8' AS content_type,
    id AS refers_to, NULL AS concurrent_to, text AS content FROM g
  UNION ALL SELECT mid, 'metadata', url, 'application/warc-fields', id, cid, about FROM g)
SELECT *, '2024-01-01T00:00:00Z' AS date, 'sha256:' || sha256(content) AS block_digest,
  NULL::VARCHAR AS payload_digest FROM r
"""

OP2 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>|/?SYS>>|pad>|unk>|mask>)', '\1\\\2\3', 'g')
    AS escaped, regexp_replace(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>|/?SYS>>|pad>|unk>|mask>)',
    '\1\\\2\3', 'g'), '(\|)(\\*)(>)', '\1\\\2\3', 'g') AS escaped_role FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256, sum(length(escaped) + length(escaped_role) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, CASE WHEN lead(x, 4) OVER p IS NOT NULL THEN concat_ws(' ', x, lead(x) OVER p,
    lead(x, 2) OVER p, lead(x, 3) OVER p, lead(x, 4) OVER p) END AS five
  FROM u WINDOW p AS (PARTITION BY r ORDER BY i)),
hot AS (SELECT r, unnest(list(i)) AS i FROM g WHERE five IS NOT NULL GROUP BY r, five HAVING count(*) > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM hot, range(5) AS t(k) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN cover USING (r)),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
    + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words OR word_chars > 12 * n_words)::BIGINT
    + 32 * (10 * n_capitals > 3 * word_chars)::BIGINT AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""


def _values(rows) -> str:
    quoted = lambda x: "'" + x + "'" if isinstance(x, str) else str(x)
    return ", ".join(f"({', '.join(map(quoted, row))})" for row in rows)


STEPS = [(i, licence, k, name) for i, (licence, names) in enumerate(RULES) for k, name in enumerate(names)]
QUALITY_ABLATIONS = OP3[: OP3.rindex("SELECT doc_id, n_words::BIGINT")].rstrip() + r""",
rules(rule, bit) AS (VALUES ('too_few_words', 1), ('repeated_windows', 2), ('symbol_heavy', 4), ('repeated_lines', 8),
    ('word_length', 16), ('shouting', 32)),
policies(policy, mask) AS (VALUES ('2024-base', 3), ('2024-full', 63)),
c AS (SELECT policy, failed & mask AS bits, count(*) AS n FROM f, policies GROUP BY ALL)
SELECT policy, rule, coalesce(sum(n) FILTER ((bits & bit) <> 0), 0)::BIGINT AS n_failing,
  coalesce(sum(n) FILTER (bits = bit), 0)::BIGINT AS n_only_this,
  coalesce(sum(n) FILTER ((bits & ~bit) = 0), 0)::BIGINT AS n_kept_without
FROM policies JOIN rules ON (mask & bit) <> 0 LEFT JOIN c USING (policy) GROUP BY policy, rule
"""

OP4 = rf"""
WITH RECURSIVE known(name, said) AS (VALUES {_values(SENTENCES.items())}),
steps(rule, license, k, name) AS (VALUES {_values(STEPS)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(coalesce(text, ''),
    '(?:[.!?;]+[\x20\x09-\x0D]+|\n)') AS parts FROM documents),
s AS (SELECT r, doc_id, list_transform(parts, lambda x: trim(regexp_replace(translate(x,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z]+', ' ', 'g'))) AS said FROM d),
u AS (SELECT r, unnest(said) AS said, generate_subscripts(said, 1) - 1 AS place FROM s),
hits AS (SELECT r, place, name FROM u JOIN known USING (said)),
f(r, rule, k, first, last) AS (
  SELECT r, rule, k, place, place FROM hits JOIN steps USING (name) WHERE k = 0
  UNION ALL SELECT r, rule, k, first, last FROM (
    SELECT f.r, f.rule, steps.k, f.first, min(place) AS last FROM f
    JOIN steps ON steps.rule = f.rule AND steps.k = f.k + 1
    JOIN hits ON hits.r = f.r AND hits.name = steps.name AND place > f.last AND place <= f.last + {GAP} + 1
    GROUP BY f.r, f.rule, steps.k, f.first)),
ends AS (SELECT rule, license, max(k) AS k FROM steps GROUP BY rule, license),
l AS (SELECT r, license, min(first) AS place, count(DISTINCT first) AS n FROM f JOIN ends USING (rule, k)
  GROUP BY r, license),
h AS (SELECT r, string_agg(place || ':' || name, ',' ORDER BY place) AS t FROM hits GROUP BY r),
m AS (SELECT r, string_agg(license || ':' || place || ':' || n, ',' ORDER BY place, license) AS t FROM l GROUP BY r)
SELECT doc_id, len(list_filter(said, lambda x: x <> ''))::BIGINT AS n_sentences,
  coalesce(h.t, '') AS sentences, coalesce(m.t, '') AS licenses
FROM s LEFT JOIN h USING (r) LEFT JOIN m USING (r)
"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT item_id, least(len(ws), 10) AS k, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p
  FROM b WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS w FROM bw),
sizes AS (SELECT DISTINCT k FROM windows),
dw AS (SELECT r, k, ws, unnest(range(1, len(ws) - k + 2)) AS p FROM d, sizes WHERE len(ws) >= k),
found AS (SELECT r, p, k, item_id FROM (SELECT r, k, p, array_to_string(ws[p:p + k - 1], ' ') AS w FROM dw)
  JOIN windows USING (k, w)),
hits AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM found) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

#: One level of the tree: variable children of a node become one, before the next level is counted.
OP9_LEVEL = r"""
wide{d} AS (SELECT host, node FROM (SELECT host, node, segs[{d} + 1] AS seg, sum(pages) AS n FROM level{d}
  WHERE len(segs) > {d} GROUP BY ALL) GROUP BY ALL HAVING count(*) > 50 AND 10 * max(n) <= sum(n)),
level{e} AS MATERIALIZED (SELECT l.host AS host, shape, pages, segs, CASE WHEN len(segs) <= {d} THEN l.node ELSE
  {before} (CASE WHEN w.host IS NULL THEN segs[{d} + 1] ELSE '*' END) END AS node
  FROM level{d} AS l LEFT JOIN wide{d} AS w ON l.host = w.host AND l.node = w.node),"""
OP9_LEVELS = "".join(
    OP9_LEVEL.format(d=d, e=d + 1, before="l.node || '/' ||" if d else "") for d in range(LEVELS + 1)
)
OP9 = r"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://')
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS whole FROM b),
p AS MATERIALIZED (SELECT r, page_id, host, path, array_to_string(list_concat(list_transform(whole[1:8],
    lambda x: CASE WHEN regexp_matches(x, '^[0-9]+(\.[A-Za-z]+)?$')
        THEN '<n>' || regexp_extract(x, '^[0-9]+(\.[A-Za-z]+)?$', 1)
      WHEN regexp_matches(x, '^[0-9A-Za-z_-]{12,}(\.[A-Za-z]+)?$') AND regexp_matches(x, '^[^.]*[0-9]')
        THEN '<t>' || regexp_extract(x, '^[0-9A-Za-z_-]{12,}(\.[A-Za-z]+)?$', 1)
      ELSE x END), CASE WHEN len(whole) > 8 THEN ['<rest>'] ELSE [] END), '/') AS shape,
    try_cast(nullif(regexp_extract(path, '([0-9]+)(\.[A-Za-z]+)?/?$', 1), '') AS BIGINT) AS doc_id FROM s),
rules(verdict, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hit AS MATERIALIZED (SELECT r, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY r),
l AS (SELECT doc_id, bool_and(quality = 1 AND toxic = 0) AS good FROM labels GROUP BY doc_id),
marks AS (SELECT page_id, bool_and(good) AS good FROM p JOIN l USING (doc_id) GROUP BY page_id),
known AS (SELECT host, shape, good, verdict IS NULL AS free,
    coalesce(substr(md5(page_id::VARCHAR), 1, 1) < '4', false) AS held
  FROM p LEFT JOIN marks USING (page_id) LEFT JOIN hit USING (r)),
shapes AS MATERIALIZED (SELECT host, shape, count(*) AS pages, count(good) FILTER (NOT held) AS n,
    count(*) FILTER (good AND NOT held) AS good, count(good) FILTER (held AND free) AS held_n,
    count(*) FILTER (good AND held AND free) AS held_good FROM known GROUP BY host, shape),
level0 AS MATERIALIZED (SELECT host, shape, pages, string_split(shape, '/') AS segs, '' AS node FROM shapes),
""" + OP9_LEVELS + r"""
named AS MATERIALIZED (SELECT host, shape, node AS template FROM level9),
labelled AS MATERIALIZED (SELECT host, template, sum(n) AS n, sum(good) AS good, sum(held_n) AS held_n,
    sum(held_good) AS held_good FROM named JOIN shapes USING (host, shape) GROUP BY host, template),
t AS (SELECT *, string_split(template, '/') AS segs FROM labelled),
ladder AS MATERIALIZED (SELECT * EXCLUDE (segs), array_to_string(segs[1:depth], '/') AS node
  FROM (SELECT *, unnest(range(len(segs) + 1)) AS depth FROM t)),
stats AS MATERIALIZED (SELECT host, depth, node, sum(n) AS n, sum(good) AS good FROM ladder GROUP BY ALL),
pairs AS (SELECT c.*, (u.good + 1) / (u.n + 2) AS share FROM stats AS c JOIN stats AS u ON c.host = u.host
  AND c.depth = u.depth + 1 AND u.node = array_to_string(string_split(c.node, '/')[1:u.depth], '/')),
alone AS (SELECT host, depth, node FROM pairs
  WHERE n > 0 AND abs(good / n - share) > 2.576 * sqrt(share * (1 - share) / n)),
placed AS MATERIALIZED (SELECT ladder.host, template, any_value(n) AS n, any_value(good) AS good,
    any_value(held_n) AS held_n, any_value(held_good) AS held_good,
    arg_max(node, depth) AS branch FROM ladder LEFT JOIN alone USING (host, depth, node)
  WHERE depth = 0 OR alone.host IS NOT NULL GROUP BY ladder.host, template),
rate AS (SELECT coalesce(sum(good)::DOUBLE / sum(n)::DOUBLE, 0.0::DOUBLE) AS rate FROM placed),
pooled AS MATERIALIZED (SELECT host, branch, sum(held_n) AS held_n, sum(held_good) AS held_good,
    (sum(good) + 2.0::DOUBLE * any_value(rate)) / (sum(n) + 2.0::DOUBLE) AS purity, any_value(rate) AS rate
  FROM placed, rate GROUP BY host, branch),
tried AS (SELECT k, sum(CASE WHEN purity < rate * k / 20 THEN held_n - held_good ELSE 0 END) AS hit_bad,
    sum(CASE WHEN purity < rate * k / 20 THEN held_good ELSE 0 END) AS hit_good,
    sum(held_n - held_good) AS bad, sum(held_good) AS good
  FROM pooled, range(1, 19) AS ks(k) WHERE held_n > 0 GROUP BY k),
best AS (SELECT k FROM (SELECT k, hit_bad * good - hit_good * bad AS gain FROM tried) WHERE gain > 0
  ORDER BY gain DESC, k LIMIT 1),
bad AS (SELECT host, branch FROM pooled, best WHERE purity < rate * k / 20)
SELECT page_id, p.host AS host, path, rule,
  coalesce(verdict, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN hit USING (r) JOIN named ON p.host = named.host AND p.shape = named.shape
JOIN placed ON p.host = placed.host AND named.template = placed.template
LEFT JOIN bad ON bad.host = placed.host AND bad.branch = placed.branch
"""


OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS total, sum(len(terms))::BIGINT AS words FROM d),
e AS (SELECT r, doc_id, unnest(terms) AS term, len(terms) AS n FROM d),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM e SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term),
i AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // words))) AS score
  FROM t JOIN f USING (term), s),
g AS (SELECT item_id, doc_id, r, sum(times * score)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id
  ORDER BY score DESC, doc_id) AS rank FROM g WHERE score > 0) WHERE rank <= 10
"""

# A CRC-32 by its bits (reflected polynomial 0xEDB88320), all word pairs of a lag as islands, the least lag of each.
OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS t, coalesce(text, '') AS text FROM documents),
c AS (SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length(t) + 1), lambda i: ascii(substr(t, i, 1))::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS h FROM d),
w AS (SELECT r, doc_id, h, h // 10 AS g,
  list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d JOIN c USING (r)),
a AS (SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN g % len(words) END AS a FROM w),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
x AS (SELECT r, n, unnest(range(n)) AS i,
  unnest(CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN words[i + 1]
    ELSE words[a + (i - a) % p + 1] END) END) AS word FROM p),
same AS (SELECT u.r, u.i, v.i - u.i AS q FROM x u JOIN x v ON u.r = v.r AND u.word = v.word AND v.i > u.i
  AND 2 * (v.i - u.i) <= u.n),
islands AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM
  (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same)
  GROUP BY r, q, island HAVING count(*) >= q AND count(*) + q >= 12),
runs AS (SELECT r, start, length, min(q) AS period FROM islands GROUP BY r, start, length),
told AS (SELECT r, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'p': period}, [-length, start, period]) AS top,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period,
  (1000 * top.l) // top.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_derivatives": OP1,
        "op2_chat_prefix_tree": OP2,
        "op3_quality_ledger": OP3,
        "quality_ablations": QUALITY_ABLATIONS,
        "op4_license_rules": OP4,
        "op8_decontamination": OP8,
        "op9_url_templates": OP9,
        "op12_lexical_search": OP12,
        "op13_periodic_runs": OP13,
    }
