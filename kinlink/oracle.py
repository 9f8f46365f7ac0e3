"""DuckDB SQL of the record-linkage queries, built from the same fixed values.

DuckDB's patterns know no Unicode word boundaries, so a boundary is a neighbour that is no letter, mark, digit or joiner; as neighbours
are used up, such a replacement is made twice.
"""

from __future__ import annotations

import re

from .functions.text import ABBREVIATIONS, ADDRESS_STOPWORDS, COUNTRIES, NAME_STOPWORDS, SUFFIXES
from .operators.blocking import ADDRESS_BUCKET, MAX_FREQUENCY, NAME_BUCKET, WEIGHTS

_SPLIT = r"'[\s\x0b\x1c-\x1f\x85\p{Z}\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+'"
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _clean_text(x: str) -> str:
    bare = f"regexp_replace({x}, '[\\x{{200B}}-\\x{{200D}}\\x{{AD}}\\x{{FEFF}}\\x{{200E}}\\x{{200F}}\\x{{202A}}-\\x{{202E}}]', '', 'g')"
    return f"trim(regexp_replace(nfc_normalize({bare}), '{_SPACE}+', ' ', 'g'))"


def _single(x: str) -> str:
    for c in (r"\.", ",", "-", "/", r"\(", r"\)"):
        plain = c.removeprefix("\\")
        x = f"regexp_replace({x}, '{c}({_SPACE}*{c})+', '{plain}', 'g')"
    return x


def _clean_name(x: str) -> str:
    s = _single(f"lower({_clean_text(x)})")
    for _ in (1, 2):
        s = f"regexp_replace({s}, '(^|{_SPACE})&({_SPACE}|$)', '\\1and\\2', 'g')"
    return f"trim(trim({s}, {_q('.,;:!?' + chr(34) + chr(39))}))"


def _strip_suffix(x: str) -> str:
    variants = sorted({v for vs in SUFFIXES.values() for v in vs}, key=lambda v: (-len(v), v))
    pattern = _q(f"[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}},]+(?:{'|'.join(re.escape(v) for v in variants)}){_SPACE}*$")
    s = _strip(x)
    return f"CASE WHEN regexp_matches({s}, {pattern}) THEN trim({_strip(f'regexp_replace({s}, {pattern}, {_q('')})')}, '.,;: ') ELSE {s} END"


def _clean_address(x: str) -> str:
    s, word = f"lower({_clean_text(x)})", r"\p{L}\p{M}\p{N}\p{Pc}"
    for pattern, full in ABBREVIATIONS:
        core = pattern.replace(r"\b\.?", "").replace(r"\b", "")
        if "(?=" in core:
            core = core[: core.index("(?=")]
            for _ in (1, 2):
                s = f"regexp_replace({s}, '(^|[^{word}]){core}(?:\\.({_SPACE}*\\p{{Nd}})|({_SPACE}+\\p{{Nd}}))', '\\1{full}\\2\\3', 'g')"
            continue
        for _ in (1, 2):
            s = f"regexp_replace({s}, '(^|[^{word}]){core}\\.', '\\1{full}', 'g')"
            s = f"regexp_replace({s}, '(^|[^{word}]){core}($|[^{word}])', '\\1{full}\\2', 'g')"
    return f"trim(regexp_replace({_single(s)}, '{_SPACE}+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split_regex(lower({_clean_text(x)}), {_SPLIT}), lambda t: t <> '')))"


def _numbers(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({_clean_text(x)}, '\\p{{Nd}}+')))"


def _core_name(x: str) -> str:
    s = f"regexp_replace(lower({x}), '^(https?://)?(www\\.)?', '')"
    word = r"\p{L}\p{M}\p{N}\p{Pc}"
    for _ in (1, 2):
        s = f"regexp_replace({s}, '(\\.com|\\.org|\\.net|\\.in|\\.co|\\.io|\\.biz|\\.info|\\.us|\\.fr)($|[^{word}])', ' \\2', 'g')"
    return s


def _country(x: str) -> str:
    return f"coalesce(map {{{', '.join(f'{_q(a)}: {_q(n)}' for a, n in COUNTRIES.items())}}}[lower({_clean_text(x)})], lower({_clean_text(x)}))"


def _distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_PARTS = {
    "rec": r"""SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id,
      array_to_string(list_concat(w[1:3], [(['Inc', 'Pvt Ltd', 'LLC', 'GmbH', 'Co', 'Group'])[doc_id % 6 + 1]]), ' ') AS business_name,
      array_to_string(list_concat(list_concat([CAST(len(w) AS VARCHAR)], w[4:5]), [(['St', 'Rd', 'Ave', 'Blvd'])[doc_id % 4 + 1], lpad(CAST(len(w) * 37 % 100000 AS VARCHAR), 5, '0')]), ' ') AS business_address,
      CASE WHEN doc_id % 17 = 0 THEN '' WHEN lang = 'en' THEN (['USA', 'US'])[doc_id % 2 + 1] WHEN lang = 'fr' THEN 'FR' WHEN lang = 'de' THEN 'Germany' ELSE 'Spain' END AS country,
      doc_id AS pos, 'S' || (doc_id % 3 + 1) AS source, array_to_string(w[6:17], ' ') AS truth_key, len(w) AS no
      FROM (SELECT doc_id, lang, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)""",
    "ids": "SELECT entity_id AS source1_entity_id FROM rec WHERE source = 'S1'",
    "truth": """SELECT o.id AS source1_entity_id, b.entity_id AS candidate_entity_id FROM rec b JOIN (SELECT truth_key, arg_min(entity_id, pos) AS id FROM rec WHERE source = 'S1' AND truth_key <> '' AND no >= 17 GROUP BY 1) o USING (truth_key)
      WHERE b.source <> 'S1' AND b.no >= 17""",
    "prep0": f"SELECT *, {_core_name('business_name')} AS core_name, {_tokens('business_address')} AS addr_all, {_clean_address('business_name')} AS name_address, {_country('country')} AS norm_country, {_numbers('business_address')} AS nums FROM rec",
    "prep1": f"SELECT *, {_strip_suffix('core_name')} AS core_text FROM prep0",
    "prep": f"""SELECT *, list_filter({_tokens('core_text')}, lambda t: length(t) >= 2 AND NOT list_contains({_list(NAME_STOPWORDS)}, t)) AS core_tokens,
      list_filter(addr_all, lambda t: length(t) >= 3 AND NOT list_contains({_list(ADDRESS_STOPWORDS)}, t) AND NOT regexp_full_match(t, '\\p{{Nd}}+')) AS address_words,
      {_distinct_in_order("list_transform(nums, lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END)")} AS address_numbers,
      list_filter({_tokens('name_address')}, lambda t: length(t) >= 3) AS name_words FROM prep1""",
    "k0": """SELECT entity_id, source, pos, country, 'exact' AS index, array_to_string(core_tokens, ' ') AS key FROM prep WHERE len(core_tokens) > 0
      UNION ALL SELECT entity_id, source, pos, country, 'concat', array_to_string(core_tokens[1:4], '') FROM prep WHERE length(array_to_string(core_tokens[1:4], '')) >= 5
      UNION ALL SELECT entity_id, source, pos, country, 'sorted', array_to_string(core_tokens, ' ') FROM prep WHERE len(core_tokens) > 1
      UNION ALL SELECT entity_id, source, pos, country, 'pair', core_tokens[i] || '+' || core_tokens[j] FROM prep, range(1, 40) a(i), range(1, 40) b(j) WHERE j > i AND j <= i + 3 AND j <= len(core_tokens)
      UNION ALL SELECT entity_id, source, pos, country, 'rare', unnest(core_tokens) FROM prep
      UNION ALL SELECT DISTINCT entity_id, source, pos, country, 'number_word', n || '+' || w FROM (SELECT *, unnest(address_numbers[1:2]) AS n FROM prep) t, unnest(t.address_words) u(w) WHERE length(w) >= 4
      UNION ALL SELECT entity_id, source, pos, country, 'number_prefix', address_numbers[1] || '+' || name_words[1][1:3] FROM prep WHERE len(address_numbers) > 0 AND len(name_words) > 0""",
    "freq": "SELECT key, count(*) AS df FROM k0 WHERE index = 'rare' AND source <> 'S1' GROUP BY 1",
    "freq_c": "SELECT country, key, count(*) AS df FROM k0 WHERE index = 'rare' AND source <> 'S1' GROUP BY ALL",
}


def _indexed(frequency: str, by: str) -> str:
    rare = f"k.index <> 'rare' OR f.df <= {MAX_FREQUENCY} AND length(k.key) >= 3 OR f.df <= {2 * MAX_FREQUENCY} AND length(k.key) >= 6"
    cap = f"CASE WHEN index IN ('number_word', 'number_prefix') THEN {ADDRESS_BUCKET} ELSE {NAME_BUCKET} END"
    on = "k.key = f.key" + (" AND k.country = f.country" if by else "")
    return f"""SELECT entity_id, country, index, key FROM (SELECT *, row_number() OVER (PARTITION BY {by} index, key ORDER BY pos, entity_id) AS r
      FROM (SELECT k.* FROM k0 k LEFT JOIN {frequency} f ON {on} WHERE k.source <> 'S1' AND ({rare}))) WHERE r <= {cap}"""


_WEIGHT = "CASE index " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in WEIGHTS.items()) + " END"
_PARTS |= {
    "ix": _indexed("freq", ""),
    "ix_c": _indexed("freq_c", "country,"),
    "hits": f"SELECT a.entity_id AS source1_entity_id, b.entity_id AS candidate_entity_id, sum({_WEIGHT.replace('index', 'b.index', 1)})::DOUBLE AS weight FROM k0 a JOIN ix b ON a.index = b.index AND a.key = b.key WHERE a.source = 'S1' GROUP BY 1, 2",
    "cand": """SELECT source1_entity_id, candidate_entity_id, weight FROM (SELECT h.*, row_number() OVER (PARTITION BY source1_entity_id ORDER BY 2 * len(list_intersect(a.core_tokens, b.core_tokens)) + len(list_intersect(a.address_words, b.address_words)) DESC, candidate_entity_id DESC) AS r
      FROM hits h JOIN prep a ON a.entity_id = h.source1_entity_id JOIN prep b ON b.entity_id = h.candidate_entity_id WHERE a.norm_country = '' OR b.norm_country = '' OR a.norm_country = b.norm_country) WHERE r <= 80""",
    "found": "SELECT source1_entity_id, candidate_entity_id FROM cand WHERE weight >= 100",
    "lists": "SELECT i.source1_entity_id, count(candidate_entity_id) AS n, count_if(candidate_entity_id LIKE 'S2-%') AS s2, count_if(candidate_entity_id LIKE 'S3-%') AS s3 FROM ids i LEFT JOIN truth t USING (source1_entity_id) GROUP BY 1",
    "found_lists": "SELECT r.entity_id AS source1_entity_id, r.pos, coalesce(string_agg(candidate_entity_id, ',' ORDER BY candidate_entity_id), '') AS ids FROM rec r LEFT JOIN found f ON f.source1_entity_id = r.entity_id WHERE r.source = 'S1' GROUP BY 1, 2",
    "paired": "SELECT source1_entity_id, candidate_entity_id, p, t FROM (SELECT *, 1 AS p FROM found) FULL JOIN (SELECT *, 1 AS t FROM truth) USING (source1_entity_id, candidate_entity_id)",
}


def _rated(d: str) -> str:
    """d: n_pred, n_true, tp by id."""
    side = lambda n: f"CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 ELSE tp / greatest({n}, 1) END"
    return f"SELECT *, CASE WHEN precision <= 0 OR recall <= 0 THEN 0.0 ELSE 1.25 * precision * recall / (0.25 * precision + recall) END AS f05 FROM (SELECT *, {side('n_pred')} AS precision, {side('n_true')} AS recall FROM ({d}))"


_COUNTS = "count(p) AS n_pred, count(t) AS n_true, count_if(p IS NOT NULL AND t IS NOT NULL) AS tp"
_PARTS["scored"] = _rated(f"SELECT source1_entity_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp FROM ids LEFT JOIN (SELECT source1_entity_id, {_COUNTS} FROM paired GROUP BY 1) USING (source1_entity_id)")
_MEANS = """round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f05), 6) AS macro_f05, round(coalesce(avg(CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END END), 1.0), 6) AS singleton_accuracy,
  round(coalesce(avg(CASE WHEN n_true > 0 THEN f05 END), 0.0), 6) AS non_singleton_f05"""
_TOTALS = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_pred - tp) AS BIGINT) AS fp, CAST(sum(n_true - tp) AS BIGINT) AS fn"


def _sql(body: str) -> str:
    """body with the tables that it reads, and those that these read."""
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name, part in _PARTS.items():
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                todo.append(part)
    parts = ",\n".join(f"{name} AS MATERIALIZED ({part})" for name, part in _PARTS.items() if name in need)
    return f"WITH {parts} {body}"


def _profile(alias: bool = True) -> str:
    parts = ["count(*) AS rows"]
    for c in ("entity_id", "business_name", "business_address", "country"):
        n = f"CASE WHEN trim({c}) = '' THEN 0 ELSE length({c}) END"
        parts += [f"count_if(trim({c}) = '') AS missing_{c}", f"min({n}) AS min_{c}", f"max({n}) AS max_{c}"] + [f"round(avg({n}), 2) AS mean_{c}"] * alias
    return _sql("SELECT " + ", ".join(parts + [f"count_if(entity_id LIKE '{p}-%') AS prefix_{p}" for p in ("S1", "S2", "S3")]) + " FROM rec")


def _joined(c: str, name: str | None = None) -> str:
    return f"array_to_string({c}, '|') AS {name or c}"


def _jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE {common} / greatest(len({a}) + len({b}) - {common}, 1) END"


def _dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE 2 * len(list_intersect({a}, {b})) / greatest(len({a}) + len({b}), 1) END"


def _grams(x: str) -> str:
    return f"CASE WHEN length({x}) < 3 THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - 1), lambda i: {x}[i:i + 2])) END"


def _guarded(a: str, b: str, value: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE {value} END"


_SIMILAR = _sql(f"""SELECT source1_entity_id, candidate_entity_id, round({_jaccard('x', 'y')}, 6) AS jaccard, round({_dice('x', 'y')}, 6) AS dice, round({_guarded('la', 'lb', _jaccard('g', 'h'))}, 6) AS ngram FROM (
  SELECT c.*, a.business_name AS a, b.business_name AS b, lower(a.business_name) AS la, lower(b.business_name) AS lb, {_tokens('a.business_name')} AS x, {_tokens('b.business_name')} AS y, {_grams('lower(a.business_name)')} AS g, {_grams('lower(b.business_name)')} AS h
  FROM cand c JOIN rec a ON a.entity_id = c.source1_entity_id JOIN rec b ON b.entity_id = c.candidate_entity_id)""")

_HELD = """(SELECT CASE WHEN pos % 13 = 0 THEN 'S1-x' || pos ELSE source1_entity_id END AS s, CASE WHEN pos % 7 = 0 THEN 'S2-0,S2-0,S1-5,X-1' ELSE ids END AS ids FROM found_lists WHERE pos % 11 <> 0)"""


def _finding(kind: str, offenders: str) -> str:
    return f"SELECT '{kind}' AS finding, 'error' AS level, count(*) AS n, coalesce(array_to_string(list_sort(list(o))[1:5], ','), '') AS examples FROM ({offenders})"


_EACH = "(SELECT DISTINCT s, unnest(string_split(ids, ',')) AS x FROM t WHERE ids <> '')"
_VALIDATION = "\nUNION ALL ".join([
    _finding("duplicate_row", "SELECT s AS o FROM t GROUP BY s HAVING count(*) > 1"),
    _finding("repeated_id", "SELECT DISTINCT s AS o FROM t WHERE ids = 'S2-0,S2-0,S1-5,X-1'"),
    _finding("self_match", f"SELECT DISTINCT x AS o FROM {_EACH} WHERE x LIKE 'S1-%'"),
    _finding("wrong_prefix", f"SELECT DISTINCT x AS o FROM {_EACH} WHERE NOT regexp_matches(x, '^S[123]-')"),
    _finding("missing_row", "SELECT source1_entity_id AS o FROM ids WHERE source1_entity_id NOT IN (SELECT s FROM t)"),
    _finding("extra_row", "SELECT DISTINCT s AS o FROM t WHERE s NOT IN (SELECT source1_entity_id FROM ids)"),
    _finding("unknown_id", f"SELECT DISTINCT x AS o FROM {_EACH} WHERE regexp_matches(x, '^S[23]-') AND x NOT IN (SELECT entity_id FROM rec WHERE source <> 'S1')"),
])
_SAMPLE = "(SELECT source1_entity_id FROM ids ORDER BY md5(source1_entity_id || '#42'), 1 LIMIT 100)"


def _sampled_source(i: int) -> str:
    true = f"SELECT DISTINCT candidate_entity_id FROM truth WHERE candidate_entity_id LIKE 'S{i}-%' AND source1_entity_id IN (SELECT source1_entity_id FROM {_SAMPLE})"
    return f"""SELECT 'train_source{i}' AS file, candidate_entity_id AS entity_id FROM ({true}) UNION ALL SELECT 'train_source{i}', entity_id FROM (SELECT entity_id, row_number() OVER (ORDER BY md5(entity_id || '#{41 + i}'), entity_id) AS r FROM rec
      WHERE source = 'S{i}' AND entity_id NOT IN ({true})) WHERE r <= (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM ({true}))"""


_TAUS = "(SELECT round(0.05 * i, 2) AS tau FROM range(1, 20) r(i))"
ORACLE = {
    "records": _sql("SELECT entity_id, business_name, business_address, country, source FROM rec"),
    "normalized": _sql(f"""SELECT entity_id, {_country('country')} AS norm_country, {_joined(_tokens('business_address'), 'address_tokens')}, {_joined(_numbers('business_address'), 'numbers')},
      {_joined('list_transform(' + _numbers('business_address') + ", lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END)", 'plain_numbers')}, CASE source WHEN 'S1' THEN 'source1' WHEN 'S2' THEN 'source2' ELSE 'source3' END AS label FROM rec"""),
    "names": _sql(f"""SELECT entity_id, clean, s1 AS stripped, {_strip_suffix('s5')} AS bare, address, core FROM (SELECT *, {_strip_suffix('s4')} AS s5 FROM (SELECT *, {_strip_suffix('s3')} AS s4 FROM (SELECT *, {_strip_suffix('s2')} AS s3 FROM (SELECT *, {_strip_suffix('s1')} AS s2 FROM (
      SELECT *, {_strip_suffix('clean')} AS s1 FROM (SELECT entity_id, {_clean_name('business_name')} AS clean, {_clean_address('business_address')} AS address, array_to_string(core_tokens, ' ') AS core FROM prep))))))"""),
    "preprocessed": _sql(f"""SELECT entity_id, business_name, business_address, country, n AS norm_business_name, a AS norm_address, {_country('country')} AS norm_country, ns AS norm_business_name_no_suffix, {_joined(_tokens('n'), 'name_tokens')}, {_joined(_tokens('ns'), 'name_tokens_no_suffix')},
      {_joined(_numbers('n'), 'name_numeric_tokens')}, {_joined(_tokens('a'), 'address_tokens')}, {_joined(_numbers('a'), 'address_numeric_tokens')} FROM (SELECT *, {_strip_suffix('n')} AS ns FROM (SELECT *, {_clean_name('business_name')} AS n, {_clean_address('business_address')} AS a FROM rec))"""),
    "prepared": _sql(f"""SELECT entity_id, {_joined('core_tokens')}, {_joined('address_words')}, {_joined('address_numbers')}, {_joined('name_words')}, {_joined('list_sort(' + _grams('clean') + ')', 'name_grams')}, {_strip_suffix('s5')} AS core
      FROM (SELECT *, {_strip_suffix('s4')} AS s5 FROM (SELECT *, {_strip_suffix('s3')} AS s4 FROM (SELECT *, {_strip_suffix('s2')} AS s3 FROM (SELECT *, {_strip_suffix('s1')} AS s2 FROM (SELECT *, {_strip_suffix('clean')} AS s1 FROM (SELECT *, {_clean_name('business_name')} AS clean FROM prep))))))"""),
    "token_frequencies": _sql("SELECT key, df FROM freq"),
    "blocking_keys": _sql("SELECT index, key, entity_id FROM ix"),
    "name_candidates": _sql("SELECT DISTINCT a.entity_id AS source1_entity_id, b.entity_id AS candidate_entity_id FROM k0 a JOIN ix b ON a.index = b.index AND a.key = b.key WHERE a.source = 'S1' AND a.index NOT IN ('number_word', 'number_prefix')"),
    "address_candidates": _sql("SELECT DISTINCT a.entity_id AS source1_entity_id, b.entity_id AS candidate_entity_id FROM k0 a JOIN ix b ON a.index = b.index AND a.key = b.key WHERE a.source = 'S1' AND a.index IN ('number_word', 'number_prefix')"),
    "candidate_pairs": _sql("SELECT source1_entity_id, candidate_entity_id, weight FROM cand"),
    "fast_candidate_pairs": _sql(f"""SELECT source1_entity_id, candidate_entity_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY weight DESC, candidate_entity_id) AS r FROM (
      SELECT a.entity_id AS source1_entity_id, b.entity_id AS candidate_entity_id, sum({_WEIGHT.replace('index', 'b.index', 1)})::DOUBLE AS weight FROM k0 a JOIN ix_c b ON a.index = b.index AND a.key = b.key AND a.country = b.country WHERE a.source = 'S1' GROUP BY 1, 2)) WHERE r <= 80"""),
    "candidate_lists": _sql("SELECT source1_entity_id, coalesce(candidate_entity_id, '') AS candidate_entity_id, CASE WHEN candidate_entity_id LIKE 'S2-%' THEN 'S2' ELSE 'S3' END AS source FROM ids LEFT JOIN cand USING (source1_entity_id)"),
    "blocking_quality": _sql("""SELECT * REPLACE (round(avg_candidates, 6) AS avg_candidates, round(recall, 6) AS recall, round(reduction, 6) AS reduction) FROM (SELECT any_value(true_pairs) AS true_pairs, any_value(true_retrieved) AS true_retrieved, any_value(CASE WHEN true_pairs = 0 THEN 1.0 ELSE true_retrieved / greatest(true_pairs, 1) END) AS recall, CAST(sum(n) AS BIGINT) AS n_candidates, avg(n) AS avg_candidates, median(n) AS median_candidates, min(n) AS min_candidates, max(n) AS max_candidates,
      1 - sum(n) / greatest(count(*) * (SELECT count(*) FROM rec WHERE source <> 'S1'), 1) AS reduction FROM (SELECT source1_entity_id, count(candidate_entity_id) AS n FROM ids LEFT JOIN cand USING (source1_entity_id) GROUP BY 1)
      CROSS JOIN (SELECT count(*) AS true_pairs, count(c) AS true_retrieved FROM truth LEFT JOIN (SELECT *, 1 AS c FROM cand) USING (source1_entity_id, candidate_entity_id)))"""),
    "blocking_recall": _sql("SELECT true_pairs, retrieved, round(CASE WHEN true_pairs = 0 THEN 1.0 ELSE retrieved / greatest(true_pairs, 1) END, 6) AS recall FROM (SELECT count(*) AS true_pairs, count(c) AS retrieved FROM truth LEFT JOIN (SELECT *, 1 AS c FROM cand) USING (source1_entity_id, candidate_entity_id))"),
    "listed_matches": _sql("SELECT source1_entity_id, coalesce(string_agg(candidate_entity_id, ',' ORDER BY CAST(string_split(candidate_entity_id, '-')[2] AS BIGINT), candidate_entity_id), '') AS matched_entity_ids FROM ids LEFT JOIN (SELECT * FROM cand WHERE weight >= 50) USING (source1_entity_id) GROUP BY 1"),
    "file_records": _sql("SELECT entity_id, business_name, business_address, country FROM rec WHERE source = 'S1'"),
    "merged_checkpoints": _sql("SELECT source1_entity_id, CASE WHEN pos % 2 = 0 THEN ids ELSE '' END AS candidate_entity_ids, CASE WHEN pos % 2 = 0 THEN string_split(ids, ',')[1] ELSE '' END AS matched_entity_ids FROM found_lists"),
    "remaining_records": _sql("SELECT entity_id FROM rec WHERE source = 'S1' AND entity_id NOT IN (SELECT source1_entity_id FROM truth)"),
    "threshold_search": _sql(f"""SELECT tau, round(avg(f05), 6) AS macro_f05 FROM ({_rated(f'''SELECT tau, i.source1_entity_id, count(p) AS n_pred, count(t) AS n_true, count_if(p IS NOT NULL AND t IS NOT NULL) AS tp FROM {_TAUS} CROSS JOIN ids i LEFT JOIN (
      SELECT source1_entity_id, candidate_entity_id, tau, p, t FROM (SELECT source1_entity_id, candidate_entity_id, tau, 1 AS p FROM cand, {_TAUS} WHERE least(1.0, weight / 300) >= tau) FULL JOIN (SELECT *, 1 AS t FROM truth, {_TAUS}) USING (source1_entity_id, candidate_entity_id, tau)) b USING (tau, source1_entity_id) GROUP BY 1, 2''')}) GROUP BY 1"""),
    "profile_sources": _profile(),
    "merged_profiles": _profile(False),
    "countries": _sql("SELECT country, count(*) AS n FROM rec GROUP BY 1 ORDER BY n DESC, country LIMIT 15"),
    "profile_truth": _sql("SELECT count(*) AS rows, count_if(n = 0) AS singletons, count_if(n > 0) AS has_matches, CAST(sum(s2) AS BIGINT) AS s2_matches, CAST(sum(s3) AS BIGINT) AS s3_matches FROM lists"),
    "match_counts": _sql("SELECT CAST(n AS INTEGER) AS match_count, count(*) AS n FROM lists GROUP BY 1"),
    "entity_scores": _sql("SELECT source1_entity_id, n_pred, n_true, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f05, 6) AS f05 FROM scored"),
    "macro_scores": _sql(f"SELECT {_MEANS} FROM scored"),
    "pair_scores": _sql("""SELECT source, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p <= 0 OR r <= 0 THEN 0.0 ELSE 1.25 * p * r / (0.25 * p + r) END, 6) AS f05 FROM (
      SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM (SELECT substr(candidate_entity_id, 1, 2) AS source, count_if(p IS NOT NULL AND t IS NOT NULL) AS tp, count_if(t IS NULL) AS fp, count_if(p IS NULL) AS fn FROM paired GROUP BY 1))"""),
    "country_scores": _sql(f"SELECT upper(country) AS country, count(*) AS entities, {_MEANS}, {_TOTALS} FROM scored JOIN rec ON rec.entity_id = scored.source1_entity_id GROUP BY 1"),
    "source_scores": _sql(f"SELECT source, count(*) AS entities, {_MEANS}, {_TOTALS} FROM (" + _rated(f"SELECT source, i.source1_entity_id, {_COUNTS} FROM (SELECT unnest(['S2', 'S3']) AS source) CROSS JOIN ids i LEFT JOIN (SELECT *, substr(candidate_entity_id, 1, 2) AS source FROM paired) b USING (source1_entity_id, source) GROUP BY 1, 2") + ") GROUP BY 1"),
    "set_similarity": _SIMILAR,
    "sampled_ids": _sql("SELECT source1_entity_id FROM ids ORDER BY md5(source1_entity_id || '#42'), 1 LIMIT 20"),
    "grouped_split": _sql("""SELECT t.*, v.source1_entity_id IS NOT NULL AS is_val FROM truth t LEFT JOIN (SELECT source1_entity_id FROM (SELECT source1_entity_id, row_number() OVER (ORDER BY md5(source1_entity_id || '#42'), source1_entity_id) AS r, count(*) OVER () AS n
      FROM (SELECT DISTINCT source1_entity_id FROM truth)) WHERE r <= greatest(1, CAST(floor(n * 0.2) AS BIGINT))) v ON t.source1_entity_id = v.source1_entity_id"""),
    "sampled_targets": _sql("""SELECT DISTINCT candidate_entity_id AS entity_id FROM truth UNION ALL SELECT entity_id FROM (SELECT entity_id, row_number() OVER (ORDER BY md5(entity_id || '#42'), entity_id) AS r FROM rec WHERE source <> 'S1' AND entity_id NOT IN (SELECT candidate_entity_id FROM truth))
      WHERE r <= (SELECT CAST(floor(count(DISTINCT candidate_entity_id) * 0.2) AS BIGINT) FROM truth)"""),
    "sampled_entities": _sql(f"SELECT 'train_source1' AS file, source1_entity_id AS entity_id FROM {_SAMPLE} UNION ALL {_sampled_source(2)} UNION ALL {_sampled_source(3)} UNION ALL SELECT 'train_ground_truth', source1_entity_id FROM {_SAMPLE}"),
    "validation": _sql(f"SELECT * FROM (WITH t AS (SELECT * FROM {_HELD} UNION ALL SELECT * FROM {_HELD} WHERE ids = 'S2-0,S2-0,S1-5,X-1') {_VALIDATION})"),
    "submission": _sql("""SELECT * FROM (WITH m AS (SELECT source1_entity_id FROM found_lists WHERE ids <> '' AND pos % 2 = 0) SELECT 'matching' AS file, 'matches_outside_candidates' AS finding, 'warning' AS level, count(*) AS n, array_to_string(list_sort(list(source1_entity_id))[1:5], ',') AS examples FROM m HAVING count(*) > 0
      UNION ALL SELECT 'matching', 'unknown_id', 'error', 1, 'S3-none' FROM m HAVING count(*) > 0)"""),
    "final_check": _sql("""SELECT "check", CAST(n AS BIGINT) AS n, n = 0 AS ok FROM (SELECT 'candidates_row_count_off' AS "check", 0 AS n UNION ALL SELECT 'candidates_duplicate_rows', 0 UNION ALL SELECT 'candidates_extra_rows', 0 UNION ALL SELECT 'candidates_missing_rows', 0
      UNION ALL SELECT 'matches_row_count_off', count(*) FROM found_lists WHERE pos % 9 = 0 UNION ALL SELECT 'matches_duplicate_rows', 0 UNION ALL SELECT 'matches_extra_rows', 0 UNION ALL SELECT 'matches_missing_rows', count(*) FROM found_lists WHERE pos % 9 = 0
      UNION ALL SELECT 'matches_outside_candidates', count(*) FROM found_lists WHERE pos % 9 <> 0 AND pos % 10 = 0 UNION ALL SELECT 'matches_unknown', count(*) FROM found_lists WHERE pos % 9 <> 0 AND pos % 10 = 0)"""),
    "recovery": _sql("""SELECT CAST(sum(CASE WHEN l.pos % 5 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS rows, count(*) AS records, count_if(l.pos % 5 = 0) AS duplicate_rows, count_if(l.pos % 5 = 0) AS wrong_ids, count_if(r.country <> 'FR') AS outside_partition,
      (SELECT count(*) FROM rec WHERE source = 'S1' AND country = 'FR' AND pos % 4 = 0) AS remaining, 0 AS malformed_rows FROM found_lists l JOIN rec r ON r.entity_id = l.source1_entity_id WHERE l.pos % 4 <> 0"""),
    "outside_candidates": _sql("SELECT source1_entity_id, candidate_entity_id FROM truth EXCEPT SELECT source1_entity_id, candidate_entity_id FROM cand"),
}
