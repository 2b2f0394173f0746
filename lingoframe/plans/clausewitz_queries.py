"""Queries over Clausewitz entries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingoframe.functions import clausewitz as C
from lingoframe.operators import clausewitz as O
from lingoframe.operators import findings
from lingoframe.operators.common import duplicates, last_of
from lingoframe.plans.bindings import BINDINGS, view, with_
from lingoframe.sources import clausewitz as source


def _en(s, d):
    return view(s, d, "cwz_en")


def _other(s, d):
    return view(s, d, "cwz_other")


def _keys(s, d):
    rows = O.keyed(_en(s, d).select("key").distinct())
    return rows.select("key", "dotted", "namespace", "event_id", "part", "part_kind", "tag", "suffix")


def _colours(s, d):
    return O.unbalanced(_en(s, d)).select("ord", "key", "opens", "closes")


QUERIES = {
    "cwz_census": lambda s, d: O.census(_en(s, d)),
    "cwz_versions": lambda s, d: O.versions(_en(s, d)),
    "cwz_key_parts": _keys,
    "cwz_key_catalogue": lambda s, d: O.catalogue(_en(s, d)),
    "cwz_inventory": lambda s, d: O.inventory(_en(s, d)),
    "cwz_var_formats": lambda s, d: O.formats(_en(s, d)),
    "cwz_scope_forms": lambda s, d: O.scope_forms(_en(s, d)),
    "cwz_clean_text": lambda s, d: _en(s, d).select("ord", C.clean_text(F.col("value")).alias("words")),
    "cwz_colour_balance": _colours,
    "cwz_drift": lambda s, d: O.drift(_en(s, d)),
    "cwz_references": lambda s, d: O.references(_en(s, d)).groupBy("kind").agg(F.count("*").alias("n")),
    "cwz_dangling_topk": lambda s, d: O.top(O.dangling(O.references(_en(s, d))), 40),
    "cwz_event_coverage": lambda s, d: O.event_coverage(_en(s, d)),
    "cwz_token_preservation": lambda s, d: O.token_preservation(_en(s, d), _other(s, d)),
    "cwz_length_reference": lambda s, d: O.length_reference(_en(s, d), _other(s, d)).withColumn("ratio", F.round("ratio", 6)),
    "cwz_length_topk": lambda s, d: O.furthest(O.length_reference(_en(s, d), _other(s, d)), 30).withColumn("ratio", F.round("ratio", 6)),
    "cwz_select": lambda s, d: O.select(_en(s, d), file="f3", tag="GER", style="underscore", clean=True).select("ord", "key", "value"),
    "cwz_duplicate_keys": lambda s, d: duplicates(_en(s, d), "key", "ord").select("key", "n", F.array_join(F.transform("places", lambda p: p.cast("string")), ",").alias("places")),
    "cwz_part_examples": lambda s, d: O.part_examples(_en(s, d), 6),
    "cwz_findings": lambda s, d: findings.summary(O.validate(_en(s, d), source.warnings(source.parsed(view(s, d, "cwz_lines"))))),
    "cwz_parse_lines": lambda s, d: source.entries(source.parsed(view(s, d, "cwz_lines"))),
    "cwz_parse_warnings": lambda s, d: source.warnings(source.parsed(view(s, d, "cwz_lines"))),
    "cwz_align_pivot": lambda s, d: O.aligned(_en(s, d).unionByName(_other(s, d)), ["english", "polish"]),
    "last_wins_dedup": lambda s, d: last_of(_en(s, d).select("key", "ord", "value"), ["key"], ["ord"]),
}

_W = f"WITH {with_('cwz_en', 'cwz_other')}"
_KEYED = """, pieces AS (SELECT *, string_split(key, '.') AS p FROM cwz_en), at_ AS (SELECT *, coalesce(list_position(list_transform(p, lambda s: regexp_full_match(s, '[0-9]+')), true), 0) AS a FROM pieces),
keyed0 AS (SELECT *, contains(key, '.') AND a > 0 AS dotted, CASE WHEN NOT contains(key, '.') THEN '' WHEN a > 0 THEN array_to_string(list_slice(p, 1, a - 1), '.') ELSE key END AS namespace,
  CASE WHEN a > 0 THEN p[a] ELSE '' END AS event_id, CASE WHEN a > 0 THEN array_to_string(list_slice(p, a + 1, len(p)), '.') ELSE '' END AS part,
  regexp_extract(key, '^([A-Z]{3})(_|$)', 1) AS tag, regexp_extract(key, '_([a-zA-Z][a-zA-Z0-9]*)$', 1) AS suffix FROM at_),
keyed1 AS (SELECT *, split_part(part, '.', 1) AS head, regexp_replace(split_part(part, '.', 1), '[0-9]+$', '') AS base FROM keyed0),
keyed AS (SELECT *, CASE WHEN part = '' THEN 'none' WHEN contains(part, '.tt') OR base = 'tt' THEN 'tooltip' WHEN base IN ('t', 'title') THEN 'title' WHEN base IN ('d', 'desc', 'warning') THEN 'body'
  WHEN base IN ('do', 'opt') THEN 'option' WHEN regexp_full_match(base, '[a-z]') OR regexp_full_match(head, '[0-9]+') THEN 'option' ELSE 'named-variant' END AS part_kind FROM keyed1)
"""
_CLEAN = "{0}"
for _p in ("\\[[^\\]]*\\]", "\\$[^$]*\\$", "£\\w+", "@[A-Z]{{3}}", "§[A-Za-z]", "§!", "\\\\n", "\\\\t"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', ' ', 'g')"
_CLEAN = f"trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g'))"
_CLASSES = (("colour-open", "§[a-zA-Z]"), ("colour-close", "§!"), ("icon", "£\\w+"), ("flag", "@[A-Z]{3}"), ("variable", "\\$[^$]*\\$"), ("scope-fn", "\\[[^\\]]*\\]"), ("newline", "\\\\n"))
_TOKENS = " UNION ALL ".join(f"SELECT ord, key, '{n}' AS cls, unnest(regexp_extract_all(value, '{p}')) AS token FROM cwz_en" for n, p in _CLASSES)
_REFS = """, used AS (SELECT ord, key, unnest(regexp_extract_all(value, '\\$([^$|]+)(\\|[^$]*)?\\$', 1)) AS name FROM cwz_en),
refs AS (SELECT used.*, CASE WHEN k.key IS NOT NULL THEN 'resolved' WHEN regexp_full_match(name, '[A-Z][A-Z0-9_]*') THEN 'engine' ELSE 'dangling' END AS kind FROM used LEFT JOIN (SELECT DISTINCT key FROM cwz_en) k ON k.key = name)
"""
_SIG = " UNION ALL ".join(f"SELECT key, {e} AS token FROM (SELECT key, unnest(regexp_extract_all({{0}}, '{p}', {g})) AS t FROM pairs)" for p, g, e in (("\\$([^$]*)\\$", 1, "'$' || split_part(t, '|', 1) || '$'"), ("\\[[^\\]]*\\]", 0, "t"), ("£\\w+", 0, "t"), ("@[A-Z]{3}", 0, "t"))).replace("{3}", "{{3}}")
_PAIRS = """, a AS (SELECT key, max_by(value, ord) AS source FROM cwz_en GROUP BY key), b AS (SELECT key, max_by(value, ord) AS target FROM cwz_other GROUP BY key), pairs AS (SELECT * FROM a JOIN b USING (key))"""
_LINES = f"""WITH {with_("cwz_lines")}, heads AS (SELECT *, CASE WHEN regexp_matches(text, '^\\s*l_[a-z_]+:\\s*(#.*)?$') THEN regexp_extract(text, '^\\s*l_([a-z_]+):', 1) END AS header FROM cwz_lines),
filled AS (SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY file ORDER BY line), '?') AS lang FROM heads),
kept AS (SELECT *, regexp_matches(text, '^\\s*([A-Za-z0-9_.\\-]+):\\s*(\\d+)?\\s*"(.*)"\\s*(#.*)?$') AS is_entry FROM filled WHERE header IS NULL AND NOT regexp_matches(text, '^\\s*(#.*)?$'))
"""
_E = "'^\\s*([A-Za-z0-9_.\\-]+):\\s*(\\d+)?\\s*\"(.*)\"\\s*(#.*)?$'"

ORACLES = {
    "cwz_census": _W + _KEYED + """SELECT count(DISTINCT file) AS files, count(DISTINCT lang) AS langs, count(*) AS entries, count(DISTINCT key) AS unique_keys, CAST(count_if(dotted) AS BIGINT) AS dotted,
      CAST(count_if(NOT dotted) AS BIGINT) AS underscore, CAST(count_if(value = '') AS BIGINT) AS empty FROM keyed""",
    "cwz_versions": _W + "SELECT version, count(*) AS n FROM cwz_en GROUP BY version",
    "cwz_key_parts": _W + _KEYED + "SELECT DISTINCT key, dotted, namespace, event_id, part, part_kind, tag, suffix FROM keyed",
    "cwz_key_catalogue": _W + _KEYED + """SELECT what, name, count(*) AS n FROM (SELECT 'namespace' AS what, namespace AS name FROM keyed WHERE dotted UNION ALL SELECT 'part-kind', part_kind FROM keyed WHERE dotted
      UNION ALL SELECT 'tag', tag FROM keyed WHERE NOT dotted UNION ALL SELECT 'suffix', suffix FROM keyed WHERE NOT dotted) WHERE name <> '' GROUP BY ALL""",
    "cwz_inventory": _W + f"SELECT cls, count(*) AS occurrences, count(DISTINCT ord) AS entries, min_by(key, ord) AS first_key FROM ({_TOKENS}) GROUP BY cls",
    "cwz_var_formats": _W + """SELECT format, count(*) AS n, min(ord) AS first_ord FROM (SELECT ord, regexp_extract(t, '\\|(.*)\\$$', 1) AS format, t FROM (SELECT ord, unnest(regexp_extract_all(value, '\\$[^$]*\\$')) AS t FROM cwz_en)) WHERE contains(t, '|') GROUP BY format""",
    "cwz_scope_forms": _W + """, t AS (SELECT unnest(regexp_extract_all(value, '\\[([^\\]]*)\\]', 1)) AS i FROM cwz_en)
      SELECT form, count(*) AS n FROM (SELECT CASE WHEN starts_with(i, '?') THEN 'optional-' ELSE '' END || CASE WHEN contains(split_part(i, '|', 1), '.') THEN 'scoped' ELSE 'bare' END AS form FROM t UNION ALL SELECT '+|fmt' FROM t WHERE contains(i, '|')) GROUP BY form""",
    "cwz_clean_text": _W + f"SELECT ord, {_CLEAN.format('value')} AS words FROM cwz_en",
    "cwz_colour_balance": _W + """SELECT * FROM (SELECT ord, key, CAST(len(regexp_extract_all(value, '§[A-Za-z]')) AS INTEGER) AS opens, CAST(len(regexp_extract_all(value, '§!')) AS INTEGER) AS closes FROM cwz_en) WHERE opens <> closes""",
    "cwz_drift": _W + """SELECT tier, name, count(*) AS n, min(ord) AS first_ord FROM (
      SELECT ord, 1 AS tier, 'other-escape' AS name FROM cwz_en WHERE regexp_matches(value, '\\\\[a-mo-su-zA-Z]') UNION ALL SELECT ord, 1, 'newstyle-fmt' FROM cwz_en WHERE regexp_matches(value, '#\\w+\\b[^#]*#!')
      UNION ALL SELECT ord, 1, 'newstyle-icon' FROM cwz_en WHERE regexp_matches(value, '@\\w+!') UNION ALL SELECT ord, 1, 'curly-brace' FROM cwz_en WHERE regexp_matches(value, '\\{[^}]*\\}')
      UNION ALL SELECT ord, 1, 'unknown-color §' || l FROM (SELECT ord, unnest(regexp_extract_all(value, '§([A-Za-z])', 1)) AS l FROM cwz_en) WHERE NOT contains('YGRHLTWOgbB', l)
      UNION ALL SELECT ord, 2, 'escaped-quote' FROM cwz_en WHERE contains(value, chr(92) || '"') UNION ALL SELECT ord, 2, 'unclosed-color' FROM cwz_en WHERE len(regexp_extract_all(value, '§[A-Za-z]')) <> len(regexp_extract_all(value, '§!'))) GROUP BY ALL""",
    "cwz_references": _W + _REFS + "SELECT kind, count(*) AS n FROM refs GROUP BY kind",
    "cwz_dangling_topk": _W + _REFS + "SELECT name, count(*) AS n, min(ord) AS first_ord, min_by(key, ord) AS first_key FROM refs WHERE kind = 'dangling' GROUP BY name ORDER BY n DESC, first_ord LIMIT 40",
    "cwz_event_coverage": _W + _KEYED + """SELECT namespace, event_id, array_to_string(list_sort(list(DISTINCT part_kind)), ',') AS kinds, bool_or(part_kind = 'title') AS has_title, bool_or(part_kind = 'body') AS has_body FROM keyed WHERE dotted GROUP BY ALL""",
    "cwz_token_preservation": _W + _PAIRS + f""", sa AS (SELECT key, token, count(*) AS n FROM ({_SIG.format("source")}) GROUP BY ALL), sb AS (SELECT key, token, count(*) AS n FROM ({_SIG.format("target")}) GROUP BY ALL),
      gap AS (SELECT key, token, coalesce(sa.n, 0) - coalesce(sb.n, 0) AS g FROM sa FULL JOIN sb USING (key, token))
      SELECT key, coalesce(string_agg(token || 'x' || g, ' ' ORDER BY token) FILTER (g > 0), '') AS dropped, coalesce(string_agg(token || 'x' || (-g), ' ' ORDER BY token) FILTER (g < 0), '') AS added FROM gap WHERE g <> 0 GROUP BY key""",
    "cwz_length_reference": _W + _PAIRS + f""", l AS (SELECT key, CAST(length({_CLEAN.format("source")}) AS INTEGER) AS source_length, CAST(length({_CLEAN.format("target")}) AS INTEGER) AS length FROM pairs)
      SELECT key, source_length, length, round(CAST(length AS DOUBLE) / source_length, 6) AS ratio FROM l WHERE source_length > 0 AND (CAST(length AS DOUBLE) / source_length >= 1.6 OR CAST(length AS DOUBLE) / source_length <= 1 / CAST(1.6 AS DOUBLE))""",
    "cwz_length_topk": _W + _PAIRS + f""", l AS (SELECT key, CAST(length({_CLEAN.format("source")}) AS INTEGER) AS source_length, CAST(length({_CLEAN.format("target")}) AS INTEGER) AS length FROM pairs),
      r AS (SELECT *, CAST(length AS DOUBLE) / source_length AS q FROM l WHERE source_length > 0) SELECT key, source_length, length, round(q, 6) AS ratio FROM r WHERE q >= 1.6 OR q <= 1 / CAST(1.6 AS DOUBLE) ORDER BY q DESC, key DESC LIMIT 30""",
    "cwz_select": _W + f"SELECT ord, key, {_CLEAN.format('value')} AS value FROM cwz_en WHERE contains(file, 'f3') AND regexp_matches(key, '^GER(_|$)') AND NOT contains(key, '.')",
    "cwz_duplicate_keys": _W + "SELECT key, count(*) AS n, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS places FROM cwz_en GROUP BY key HAVING count(*) > 1",
    "cwz_part_examples": _W + _KEYED + """SELECT part_kind, CAST(turn AS INTEGER) AS turn, part FROM (SELECT part_kind, part, row_number() OVER (PARTITION BY part_kind ORDER BY min(ord)) AS turn FROM keyed WHERE dotted GROUP BY part_kind, part) WHERE turn <= 6""",
    "cwz_findings": f"WITH {with_('cwz_en', 'cwz_other')}" + _REFS + _LINES[_LINES.index(", heads AS"):].replace(", heads AS", ", cwz_lines AS (" + BINDINGS["cwz_lines"] + "), heads AS", 1) + """SELECT severity, rule, count(*) AS n FROM (SELECT 'INFO' AS severity, 'cwz.duplicate_key' AS rule FROM cwz_en GROUP BY key HAVING count(*) > 1
      UNION ALL SELECT 'NOTED', 'cwz.unbalanced_colour' FROM cwz_en WHERE len(regexp_extract_all(value, '§[A-Za-z]')) <> len(regexp_extract_all(value, '§!')) UNION ALL SELECT 'NOTED', 'cwz.escaped_quote' FROM cwz_en WHERE contains(value, chr(92) || '"')
      UNION ALL SELECT 'ERROR', 'cwz.dangling_reference' FROM refs WHERE kind = 'dangling' UNION ALL SELECT 'INFO', 'cwz.parse_warning' FROM kept WHERE NOT is_entry) GROUP BY ALL""",
    "cwz_parse_lines": _LINES + f"SELECT regexp_extract(text, {_E}, 1) AS key, TRY_CAST(nullif(regexp_extract(text, {_E}, 2), '') AS BIGINT) AS version, regexp_extract(text, {_E}, 3) AS value, lang, file, line FROM kept WHERE is_entry",
    "cwz_parse_warnings": _LINES + """SELECT file, line, CASE WHEN len(regexp_extract_all(text, '"')) % 2 = 1 THEN 'multiline?' ELSE 'malformed' END AS kind, text[1:80] AS text FROM kept WHERE NOT is_entry""",
    "cwz_align_pivot": _W + """SELECT key, max_by(value, ord) FILTER (lang = 'english') AS english, max_by(value, ord) FILTER (lang = 'polish') AS polish FROM (SELECT key, lang, value, ord FROM cwz_en UNION ALL SELECT key, lang, value, ord FROM cwz_other) GROUP BY key""",
    "last_wins_dedup": _W + "SELECT key, max(ord) AS ord, max_by(value, ord) AS value FROM cwz_en GROUP BY key",
}
