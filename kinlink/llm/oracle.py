"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .quality import GROWTH, LEAST, LIMITS, PRIOR, REACH, ZERO

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK = r"[\x20\x09-\x0D]"
_PLAIN = rf"list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '')"

DECONTAMINATE = f"""WITH
it AS (SELECT CAST(item_id AS VARCHAR) AS item, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, w[i:i + least(10, len(w)) - 1] AS x, least(10, len(w)) AS k FROM it, range(1, 100000) r(i) WHERE i <= greatest(1, len(w) - 9)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i, k, w[i:i + k - 1] AS x FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT k FROM win) WHERE i + k - 1 <= len(w)),
hit AS (SELECT doc_id, i, dw.k, item FROM dw JOIN win ON dw.x = win.x),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""

LINE_DEDUP = rf"""WITH
l AS (SELECT doc_id, i, regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
r AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE x <> ''),
w AS (SELECT a.doc_id, a.p, [a.x, b.x, c.x] AS x FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.p = a.p + 1 JOIN r c ON a.doc_id = c.doc_id AND c.p = a.p + 2),
later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT r.doc_id, r.i FROM later JOIN r ON r.doc_id = later.doc_id AND r.p BETWEEN later.p AND later.p + 2),
kept AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(coalesce(g, []), i)) AS t, len(string_split(text, chr(10))) AS n, coalesce(len(g), 0) AS k
  FROM documents LEFT JOIN (SELECT doc_id, list(i) AS g FROM gone GROUP BY 1) USING (doc_id))
SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL WHEN k = 0 THEN text ELSE array_to_string(t, chr(10)) END AS text, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(k AS BIGINT) AS n_removed FROM documents d JOIN kept USING (doc_id)"""

WARC = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
t AS (SELECT *, octet_length(h) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM t"""


def _quality() -> str:
    names = list(LIMITS)
    bins = lambda c: f"CASE WHEN {c} > {LEAST} THEN CAST(ceil(ln({c}) / ln({GROWTH!r}::DOUBLE)) AS INTEGER) ELSE {ZERO} END"
    each = " UNION ALL ".join(f"SELECT lang, source, '{c}' AS f, {bins(c)} AS b FROM m WHERE NOT base_failed" for c in names)
    value = lambda b: f"CASE WHEN {b} = {ZERO} THEN 0.0 ELSE 2 / (1 + {GROWTH!r}::DOUBLE) * pow({GROWTH!r}::DOUBLE, {b}) END AS {b}"

    def level(k: str) -> str:
        summed = f"SELECT {k}f, b, sum(c) OVER (PARTITION BY {k}f ORDER BY b) AS u, sum(c) OVER (PARTITION BY {k}f) AS n FROM (SELECT {k}f, b, count(*) AS c FROM bins GROUP BY {k}f, b)"
        return f"SELECT {k}f, n, {value('lo')}, {value('mid')} FROM (SELECT {k}f, any_value(n) AS n, min(CASE WHEN u >= 0.25 * n THEN b END) AS lo, min(CASE WHEN u >= 0.5 * n THEN b END) AS mid FROM ({summed}) GROUP BY {k}f)"

    drawn = lambda q: f"(g.{q} * g.n + (l.{q} * l.n + p.{q} * {PRIOR}) / (l.n + {PRIOR}) * {PRIOR}) / (g.n + {PRIOR})"
    spread = "CASE g.f " + " ".join(f"WHEN '{c}' THEN {v[0]}" for c, v in LIMITS.items()) + " END"
    most = "CASE g.f " + " ".join(f"WHEN '{c}' THEN {v[1]}" for c, v in LIMITS.items()) + " END"
    return rf"""WITH
t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_PLAIN} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM (SELECT doc_id, i, w[i:i + 4] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM v WHERE c > 1) GROUP BY 1),
a AS (SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines FROM t LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(word_chars, 1)::DOUBLE AS symbol_ratio, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio, word_chars / greatest(n_words, 1)::DOUBLE AS long_word FROM a),
bins AS ({each}),
g AS ({level('lang, source, ')}), l AS ({level('lang, ')}), p AS ({level('')}),
fence AS (SELECT g.lang, g.source, g.f, least({drawn('mid')} + {REACH} * greatest({drawn('mid')} - {drawn('lo')}, {spread}), {most}) AS most FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.f = l.f JOIN p ON p.f = g.f),
over AS (SELECT DISTINCT m.doc_id FROM m JOIN fence ON m.lang IS NOT DISTINCT FROM fence.lang AND m.source IS NOT DISTINCT FROM fence.source WHERE CASE f {' '.join(f"WHEN '{c}' THEN {c}" for c in names)} END > most)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM over) AS kept FROM m"""


NEAR_DUP = rf"""WITH RECURSIVE
t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{_BLANK}+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, hash(x) AS x, row_number() OVER (PARTITION BY doc_id, x) AS k FROM (SELECT doc_id, w[i:i + least(5, len(w)) - 1] AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM t WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
both AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON reach.b = e.a)
SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1""".replace("both AS MATERIALIZED", "both_ways AS MATERIALIZED")

ORACLE = {"op2_decontaminate": DECONTAMINATE, "op6_line_dedup": LINE_DEDUP, "op7_warc": WARC, "op8_quality": _quality(), "op10_near_dup": NEAR_DUP}
