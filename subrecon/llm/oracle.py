"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from subrecon.llm.decontamination import SLACK
from subrecon.llm.quality_rules import RULES, STOP_WORDS
from subrecon.llm.substring_dedup import MIN_WORDS, UNITS

_WORD = r"[^\x20\x09-\x0D]+"


def _failed() -> str:
    out = []
    for r in RULES:
        tests = ([f"{r.metric} >= {r.low}"] if r.low is not None else []) + (
            [f"{r.metric} <= {r.high}"] if r.high is not None else [])
        out.append(f"CASE WHEN NOT coalesce({' AND '.join(tests)}, true) THEN '{r.name}' END")
    return f"array_to_string(list_filter([{', '.join(out)}], lambda x: x IS NOT NULL), ',')"


OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
   length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
   length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
   (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
   coalesce(c, 0)::BIGINT AS n_repeat_words,
   len(list_filter(w, lambda x: lower(x) IN ({', '.join(f"'{s}'" for s in STOP_WORDS)}))) AS n_stop_words,
   len(l) AS n_lines,
   len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS n_bullets,
   len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '(\.\.\.|…)$'))) AS n_dots
   FROM w LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_length, n_symbols / nullif(n_words, 0) AS symbol_ratio,
   n_upper / nullif(word_chars, 0) AS upper_ratio, n_stop_words / nullif(n_words, 0) AS stop_word_ratio,
   n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio, n_bullets / nullif(n_lines, 0) AS bullet_line_ratio,
   n_dots / nullif(n_lines, 0) AS ellipsis_line_ratio,
   (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
f AS (SELECT *, {_failed()} AS failed_rules FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{UNITS["sentence"]}') AS us FROM documents),
e AS (SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) AS k FROM d),
p AS (SELECT doc_id, k, u, trim(regexp_replace(lower(u), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ') AS norm,
             sum(length(u)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM e),
w AS (SELECT doc_id, norm, stop - length(u) AS start, stop, len(string_split(norm, ' ')) AS words,
             row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos FROM p WHERE norm <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) AS place FROM w),
runs AS (SELECT doc_id, start, stop, words, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run
         FROM r WHERE place > 1),
spans AS (SELECT doc_id, min(start)::BIGINT AS s, max(stop)::BIGINT AS e FROM runs GROUP BY doc_id, run
          HAVING sum(words) >= {MIN_WORDS}),
g AS (SELECT doc_id, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM spans GROUP BY doc_id)
SELECT doc_id, CASE WHEN ss IS NULL THEN text ELSE array_to_string(list_transform(range(0, len(ss) + 1), lambda i:
           substr(text, coalesce(es[i], 0) + 1, coalesce(ss[i + 1], length(text)) - coalesce(es[i], 0))), '') END AS text,
       coalesce(array_to_string(list_transform(range(1, len(ss) + 1), lambda i: ss[i] || '-' || es[i]), ','), '') AS removed_spans,
       length(text)::BIGINT AS original_chars
FROM documents LEFT JOIN g USING (doc_id)
"""


def _page_text(column: str) -> str:
    """Plain text of a page, written for DuckDB's own functions: one alternative per hidden element, references by number
    through ``chr``."""
    hidden = [f"<{e}(?:[[:space:]/>].*?</{e}[[:space:]]*>|[[:space:]/>].*|$)"
              for e in ("script", "style", "title", "noscript", "template")]
    out = f"coalesce({column}, '')"
    out = f"regexp_replace({out}, '(?is){'|'.join(['<!--(?:.*?-->|.*)', *hidden])}', ' ', 'g')"
    blocks = "p div li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer".replace(" ", "|")
    out = f"regexp_replace({out}, '(?i)<br[[:space:]]*/?>|</(?:{blocks})[[:space:]]*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '</?[A-Za-z!?][^<>]*>?', '', 'g')"
    number = ("CASE WHEN regexp_matches(p, '^0*[0-9]{1,7};') THEN regexp_extract(p, '^0*([0-9]{1,7});', 1)::BIGINT "
              "WHEN regexp_matches(p, '^[xX]0*[0-9A-Fa-f]{1,6};') "
              "THEN ('0x' || regexp_extract(p, '^[xX]0*([0-9A-Fa-f]{1,6});', 1))::BIGINT END")
    char = (f"CASE WHEN coalesce({number}, 0) BETWEEN 1 AND 1114111 AND NOT {number} BETWEEN 55296 AND 57343 "
            f"THEN chr(({number})::INTEGER) || substr(p, strpos(p, ';') + 1) ELSE '&#' || p END")
    out = (f"list_aggregate(list_transform(string_split({out}, '&#'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {char} END), "
           "'string_agg', '')")
    for name, to in (("nbsp", "' '"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("apos", "chr(39)"), ("amp", "'&'")):
        out = f"replace({out}, '&{name};', {to})"
    out = f"regexp_replace({out}, '[ \\t\\r]+', ' ', 'g')"
    out = f"regexp_replace({out}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"trim({out}, ' ' || chr(10))"


def _uuid(text: str) -> str:
    return f"'<urn:uuid:' || regexp_replace(md5({text}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.*)$', '\\1-\\2-\\3-\\4-\\5') || '>'"


_CRLF = "chr(13) || chr(10)"
OP9 = rf"""
WITH s AS (SELECT url, coalesce(html, '') AS h, '2024-01-01T00:00:00Z' AS date FROM pages),
r AS (SELECT {_uuid("concat_ws(chr(10), 'response', coalesce(url, ''), date, h)")} AS refers_to, url AS target_uri, date, h,
      octet_length(encode(h)) AS n, 'sha256:' || sha256(h) AS source_payload_digest, {_page_text("h")} AS t FROM s),
b AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
   'source-content-length: ' || n || {_CRLF} || 'source-payload-digest: ' || source_payload_digest || {_CRLF}
   || 'converted-content-length: ' || octet_length(encode(t)) || {_CRLF}
   || 'source-header: HTTP/1.1 200 OK' || {_CRLF} || 'source-header: Content-Type: text/html; charset=utf-8' || {_CRLF}
   || 'source-header: Content-Length: ' || n || {_CRLF} AS block FROM r
   UNION ALL SELECT *, 'conversion', 'text/plain', t FROM r)
SELECT {_uuid("concat_ws(chr(10), record_type, refers_to)")} AS record_id, record_type, refers_to, target_uri, date,
       content_type, octet_length(encode(block))::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest,
       source_payload_digest, block FROM b
"""

_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_TERM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_TERM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1:i + 13], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, k)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id),
dp AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
cnt AS (SELECT t, count(*) AS c FROM dp GROUP BY t),
wt AS (SELECT item_id, k, n, unnest(ts) AS t, generate_subscripts(ts, 1) AS j
       FROM (SELECT *, string_split(k, ' ') AS ts FROM bw)),
rare AS (SELECT item_id, k, n, t FROM (SELECT wt.*, row_number() OVER (PARTITION BY item_id, k ORDER BY coalesce(c, 0), j) AS r
         FROM wt LEFT JOIN cnt USING (t)) WHERE r = 1),
occ AS (SELECT item_id, k, n, doc_id, p FROM rare JOIN dp USING (t)),
close AS (SELECT o.doc_id, o.item_id, o.k, o.p, count(DISTINCT x.t) AS m
          FROM occ o JOIN dp x ON x.doc_id = o.doc_id AND abs(x.p - o.p) <= o.n + {SLACK} - 1
          JOIN (SELECT DISTINCT item_id, k, t FROM wt) y ON y.item_id = o.item_id AND y.k = o.k AND y.t = x.t GROUP BY ALL),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM close
         JOIN (SELECT item_id, k, count(DISTINCT t) AS m FROM wt GROUP BY ALL) USING (item_id, k, m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN near USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_NEAREST = """
a{n} AS (SELECT r, k, d FROM (SELECT r, k, d, row_number() OVER (PARTITION BY r ORDER BY d, k) AS place
         FROM (SELECT r, k, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{n} c USING (j) GROUP BY r, k))
         WHERE place = 1)"""
_MOVED = """
c{m} AS (SELECT k, j, coalesce(m, c.x) AS x FROM c{n} c LEFT JOIN
         (SELECT k, j, (s - ((s % n) + n) % n) // n AS m
          FROM (SELECT k, j, sum(x.x) AS s, count(*) AS n FROM x JOIN a{n} USING (r) GROUP BY k, j)) USING (k, j))"""
OP11 = """
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
x AS (SELECT r, j, floor(64 * e::DOUBLE)::BIGINT AS x
      FROM (SELECT r, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS j FROM v)),
c0 AS (SELECT k, j, x FROM x JOIN (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS k
                                   FROM v) USING (r) WHERE k < 16),""" + ",".join(
    _NEAREST.format(n=n) + "," + _MOVED.format(n=n, m=n + 1) for n in range(3)) + "," + _NEAREST.format(n=3) + """,
h AS (SELECT k, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c3 GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN v USING (r) JOIN h USING (k)
"""

OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                    regexp_matches(t, '[#$%&*|]'),
                    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS x,
             doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
             doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad
      FROM (SELECT *, regexp_extract_all(t, '{_WORD}') AS w FROM d)),
n AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM n a, n b, n c, n d, n e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, n.i AS step, o[n.i] AS own, o[1:n.i - 1] AS before FROM o, n),
m AS (SELECT part, o, step, own, x[own] AS fails, good, bad,
             len(list_filter(before, lambda b: x[b])) > 0 AS gone, len(list_filter(x, lambda y: y)) AS n_fails FROM f, s),
g AS (SELECT part, o, step, own, count(*) FILTER (NOT gone AND NOT fails) AS kept,
             count(*) FILTER (NOT gone AND fails) AS removed, count(*) FILTER (gone AND fails) AS redundant,
             count(*) FILTER (fails AND n_fails = 1) AS unique_fails,
             count(*) FILTER (NOT gone AND fails AND good) AS good_lost,
             count(*) FILTER (NOT gone AND fails AND bad) AS toxic_lost FROM m GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step::INTEGER AS step,
       kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g
"""

OP13 = rf"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS w FROM documents),
e AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w
             ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM d),
u AS (SELECT s, row_number() OVER (ORDER BY min(doc_id)) AS id, len(s) AS n FROM e WHERE len(s) > 0 GROUP BY s),
x AS (SELECT id, n, unnest(s) AS g FROM u),
l AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b USING (g)
      WHERE a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
y AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT id, id FROM u UNION SELECT r.a, y.b FROM r JOIN y ON r.b = y.a),
c AS (SELECT b AS id, min(a) AS root FROM r GROUP BY b),
m AS (SELECT root, min(doc_id) AS low FROM c JOIN u USING (id) JOIN e USING (s) GROUP BY root),
k AS (SELECT doc_id, len(e.s)::BIGINT AS n_shingles, coalesce(low, doc_id) AS component_id
      FROM e LEFT JOIN u USING (s) LEFT JOIN c USING (id) LEFT JOIN m USING (root))
SELECT *, doc_id = component_id AS kept FROM k
"""

SQL = {"op1_decontamination": OP1, "op2_substring_dedup": OP2, "op7_quality_rules": OP7, "op9_warc_derivatives": OP9,
       "op11_bitplane_kmeans": OP11, "op12_filter_audit": OP12, "op13_setsketch_near_dedup": OP13}
