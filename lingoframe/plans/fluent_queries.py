"""Queries over Fluent units and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingoframe.bundle import mono
from lingoframe.functions import fluent as L
from lingoframe.functions import scanners
from lingoframe.operators import findings
from lingoframe.operators import fluent as O
from lingoframe.plans.bindings import view, with_
from lingoframe.sources import fluent as source


def units(s, d):
    rows = view(s, d, "ftl_src")
    kind = F.when(F.col("id").startswith("-"), "term").otherwise("message")
    return rows.withColumns({"kind": kind, "role": L.attribute_role(F.col("attr")), "empty": L.is_empty(F.col("text")), "comment": F.when(F.col("ord") % 4 == 1, F.concat(F.lit("on "), "id")), "section": F.when(F.col("ord") % 5 != 2, F.concat(F.lit("part of "), "file"))})


def targets(s, d):
    return view(s, d, "ftl_tr")


def _counts(found):
    return found.groupBy("locale", "severity", "rule").agg(F.count("*").alias("n"))


def _read(s, d):
    """The units as Fluent files of a bounded size, and read again."""
    blocks = view(s, d, "ftl_files").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "pos", "ord", "block"))).alias("b"))
    return source.parsed(blocks.select("file", F.concat(F.array_join(F.transform("b", lambda x: x["block"]), "\n"), F.lit("\n")).alias("text")))


def _read_units(s, d):
    return source.units(_read(s, d), True).select("file", (F.col("ord") + 1).alias("turn"), "pos", "id", "kind", "attr", "role", "text", "empty", "comment", "section")


def _pairs(s, d):
    rows = O.crosslocale(view(s, d, "ftl_src"), targets(s, d))
    return rows.select("locale", F.col("unit_id").alias("id"), F.coalesce("attr", F.lit("")).alias("attr"), "rule", F.coalesce("detail", F.lit("")).alias("detail"))


def _flat_bundle(s, d):
    """The bundle's rows, with what they nest side by side and the spans as text."""
    spans = F.array_join(F.transform("placeholders", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"), p["kind"], p["origin"], F.coalesce(p["detail"], F.lit("-")), p["token"])), "|")
    return mono.rows(units(s, d)).select("line_id", "seq", "native_ref.kind", "native_ref.attr", "file", "line_no", "key", "source_text", spans.alias("spans"), "structural_role", F.coalesce("empty", F.lit(False)).alias("empty"), "empty_reason", "context.comment", "context.section")


QUERIES = {
    "ftl_read_units": _read_units,
    "ftl_read_census": lambda s, d: _read(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size("attributes")).alias("attributes")),
    "ftl_census": lambda s, d: O.census(view(s, d, "ftl_src")),
    "ftl_roles": lambda s, d: O.roles(view(s, d, "ftl_src")),
    "ftl_prefixes": lambda s, d: O.prefixes(view(s, d, "ftl_src")),
    "ftl_key_outliers": lambda s, d: O.key_outliers(view(s, d, "ftl_src")).select("ord", "id"),
    "ftl_select": lambda s, d: O.select(view(s, d, "ftl_src"), file="f1", prefix="msg-", roles_=["value", "metadata"], with_variable=True).select("ord", "id", "attr", "text"),
    "ftl_variables_charset": lambda s, d: O.variable_inventory(view(s, d, "ftl_src")),
    "ftl_variant_keys": lambda s, d: O.variant_keys(view(s, d, "ftl_src")),
    "ftl_gender_pairs": lambda s, d: O.gender_sets(view(s, d, "ftl_src")),
    "ftl_brace_balance": lambda s, d: view(s, d, "ftl_src").select("ord", scanners.is_balanced("text").alias("balanced")),
    "ftl_placeable_kinds": lambda s, d: O.placeable_kinds(view(s, d, "ftl_src")),
    "ftl_placeable_tokens": lambda s, d: O.tokens(view(s, d, "ftl_src"), ["ord"]).groupBy("syntax", "payload").agg(F.count("*").alias("n")),
    "ftl_complement": lambda s, d: view(s, d, "ftl_src").select("ord", F.array_join(scanners.complement_of("text"), "|").alias("words")),
    "ftl_findings": lambda s, d: findings.summary(O.validate(view(s, d, "ftl_src"))),
    "ftl_drift": lambda s, d: O.drift(view(s, d, "ftl_src")),
    "ftl_crosslocale": _pairs,
    "ftl_missing_gender": lambda s, d: O.missing_gender(view(s, d, "ftl_src"), targets(s, d)),
    "ftl_pair_counts": lambda s, d: O.pair_counts(view(s, d, "ftl_src"), targets(s, d)),
    "ftl_sweep_rollup": lambda s, d: findings.by_locale(O.crosslocale(view(s, d, "ftl_src"), targets(s, d))),
    "ftl_bundle_rows": _flat_bundle,
    "ftl_bundle_statistics": lambda s, d: mono.statistics(mono.rows(units(s, d)), units(s, d)),
    "ftl_bundle_files": lambda s, d: mono.files_index(mono.rows(units(s, d)), view(s, d, "ftl_src")),
    "ftl_bundle_verify": lambda s, d: mono.verify(mono.rows(units(s, d))),
}

_W = f"WITH {with_('ftl_src', 'ftl_tr')}"
_EMPTY = "trim({0}) IN ('', '{{\"\"}}', '{{ \"\" }}')"
_ROLE = "CASE WHEN attr IS NULL THEN 'value' WHEN attr IN ('desc', 'stat') THEN 'metadata' WHEN attr IN ('fem', 'masc', 'neut') THEN 'gender' WHEN regexp_full_match(attr, 'a[0-9]+') THEN 'variant' WHEN attr IN ('burning') THEN 'enum' ELSE 'other' END"
_VARS = "regexp_extract_all({0}, '\\$([a-zA-Z][-_a-zA-Z0-9]*)', 1)"
_SET = f"list_sort(list_distinct({_VARS}))"
_BARE = "regexp_replace({0}, '\"[^\"]*\"', '', 'g')"
_BALANCED = f"length(replace({_BARE}, '{{{{', '')) = length(replace({_BARE}, '}}}}', ''))"
_PAIRS = f""", s AS (SELECT id, attr, max_by(text, ord) AS source FROM ftl_src GROUP BY ALL), t AS (SELECT locale, id, attr, max_by(text, ord) AS target FROM ftl_tr GROUP BY ALL),
both_ AS (SELECT t.*, source, s.id IS NULL AS orphan, {_ROLE.replace("attr", "t.attr")} AS role FROM t LEFT JOIN s ON t.id = s.id AND t.attr IS NOT DISTINCT FROM s.attr),
live AS (SELECT *, {_BALANCED.format("target")} AS ok, array_to_string(list_filter({_SET.format("target")}, lambda v: NOT list_contains({_SET.format("source")}, v) AND NOT (v IN ('gender', 'attacker_gender', 'player_gender', 'user_gender', 'victim_gender') OR ends_with(v, '_gender'))), ',') AS invented,
  array_to_string(list_filter({_SET.format("source")}, lambda v: NOT list_contains({_SET.format("target")}, v)), ',') AS dropped FROM both_ WHERE NOT orphan AND NOT ({_EMPTY.format("target")}) AND NOT ({_EMPTY.format("source")}))
"""
_MARKS = """, marks AS (SELECT id, trim(m[2:-2]) AS p FROM (SELECT id, unnest(regexp_extract_all(text, '\\{(?:[^{}"]|"[^"]*"|\\{[^{}]*\\})*\\}')) AS m FROM ftl_src)),
kinds AS (SELECT id, p, CASE WHEN contains(p, '->') THEN 'selector' WHEN starts_with(p, '$') THEN 'var' WHEN starts_with(p, '-') THEN 'term-ref' WHEN starts_with(p, '"') THEN 'literal'
  WHEN regexp_matches(p, '^[A-Z][_A-Z0-9]+\\s*\\(') THEN 'function' WHEN regexp_full_match(p, '[a-zA-Z][-_a-zA-Z0-9]*(\\.[a-zA-Z][-_a-zA-Z0-9]*)?') THEN 'msg-ref' ELSE 'other' END AS kind FROM marks),
detailed AS (SELECT id, p, kind, CASE kind WHEN 'selector' THEN regexp_extract(p, '\\$([a-zA-Z][-_a-zA-Z0-9]*)', 1) WHEN 'var' THEN regexp_extract(p, '^\\$([a-zA-Z][-_a-zA-Z0-9]*)', 1) WHEN 'term-ref' THEN regexp_extract(p, '^-[a-zA-Z][-_a-zA-Z0-9]*')
  WHEN 'literal' THEN p[2:-2] WHEN 'function' THEN regexp_extract(p, '^[A-Z][_A-Z0-9]+') ELSE p END AS detail FROM kinds)
"""
_LOST = """, g AS (SELECT id, list_sort(list(DISTINCT attr)) AS forms FROM ftl_src WHERE attr IN ('fem', 'masc', 'neut') GROUP BY id),
h AS (SELECT locale, id, coalesce(list(DISTINCT attr) FILTER (attr IN ('fem', 'masc', 'neut')), []) AS have FROM ftl_tr GROUP BY ALL),
lost AS (SELECT locale, id, array_to_string(forms, ',') AS forms FROM h JOIN g USING (id) WHERE NOT list_has_any(forms, have))
"""
# Pieces of syntax: a selector's head, a placeable, a key that begins a line, a selector's end. What selectors of these tables nest are plain placeables.
_PIECE = "\\{[^{}]*->|\\{(?:[^{}\"]|\"[^\"]*\")*\\}|\\n *\\*?\\[[^\\]\\n]*\\]|\\}"
_BEFORE = "(length({0}) - length(ltrim({0}, chr(10) || ' ')))"
_PIECES = f""", texts AS (SELECT DISTINCT text FROM ftl_src), cut AS (SELECT text, regexp_extract_all(text, '{_PIECE}') AS ms, string_split_regex(text, '{_PIECE}') AS gaps FROM texts),
each_ AS (SELECT text, k, ms[k] AS m, CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda g: length(g))), 0) AS BIGINT) AS began FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM cut)),
piece AS (SELECT text, k, began + {_BEFORE.format("m")} AS a, began + length(m) AS z, ltrim(m, chr(10) || ' ') AS token FROM each_),
read_ AS (SELECT *, CASE WHEN ends_with(token, '->') THEN 'selector-head' WHEN ends_with(token, ']') THEN 'selector-key' WHEN token = '}}' THEN 'selector-close' ELSE 'placeable' END AS syntax FROM piece),
inner_ AS (SELECT *, CASE syntax WHEN 'selector-head' THEN regexp_extract(token, '\\$([a-zA-Z][-_a-zA-Z0-9]*)', 1) WHEN 'selector-key' THEN trim(ltrim(token, '*')[2:-2]) WHEN 'placeable' THEN trim(token[2:-2]) END AS payload FROM read_),
kinded AS (SELECT *, CASE WHEN syntax <> 'placeable' THEN 'selector' WHEN starts_with(payload, '$') THEN 'var' WHEN starts_with(payload, '-') THEN 'term-ref' WHEN starts_with(payload, '"') THEN 'literal' WHEN regexp_matches(payload, '^[A-Z][_A-Z0-9]+\\s*\\(') THEN 'function'
  WHEN regexp_full_match(payload, '[a-zA-Z][-_a-zA-Z0-9]*(\\.[a-zA-Z][-_a-zA-Z0-9]*)?') THEN 'msg-ref' ELSE 'other' END AS kind FROM inner_),
named AS (SELECT *, nullif(CASE kind WHEN 'var' THEN regexp_extract(payload, '^\\$([a-zA-Z][-_a-zA-Z0-9]*)', 1) WHEN 'term-ref' THEN regexp_extract(payload, '^-[a-zA-Z][-_a-zA-Z0-9]*') WHEN 'literal' THEN payload[2:-2] WHEN 'function' THEN regexp_extract(payload, '^[A-Z][_A-Z0-9]+') ELSE payload END, '') AS detail FROM kinded),
span AS (SELECT *, CASE WHEN kind = 'other' THEN 'unknown' WHEN kind = 'function' THEN CASE WHEN detail IN ('NUMBER', 'DATETIME') THEN 'spec' WHEN detail = 'TAIL' THEN 'project' ELSE 'unknown' END
  WHEN syntax = 'selector-key' AND NOT (payload IN ('few', 'many', 'one', 'other', 'two', 'zero') OR regexp_full_match(payload, '-*[0-9]+')) THEN 'unknown' ELSE 'spec' END AS origin FROM named),
masks AS (SELECT text, string_agg(concat_ws(':', a, z, kind, origin, coalesce(detail, '-'), token), '|' ORDER BY k) AS spans, count(*) = 1 AND min(a) = 0 AND max(z) = length(text) AS whole FROM span GROUP BY text),
unit AS (SELECT s.*, CASE WHEN starts_with(id, '-') THEN 'term' ELSE 'message' END AS kind, {_ROLE} AS role, {_EMPTY.format("s.text")} AS blank, CASE WHEN ord % 4 = 1 THEN 'on ' || id END AS comment, CASE WHEN ord % 5 <> 2 THEN 'part of ' || file END AS section, spans, coalesce(whole, false) AS whole
  FROM ftl_src s LEFT JOIN masks m ON s.text = m.text WHERE s.text <> ''),
made AS (SELECT *, sha256(kind || chr(31) || id || chr(31) || coalesce(attr, ''))[1:16] AS line_id FROM unit)
"""
_LABELLED = "FROM made JOIN span ON made.text = span.text"
_TERMS = "list_sort(list_distinct(list_transform(list_filter(list_transform(regexp_extract_all({0}, '\\{{(?:[^{{}}\"]|\"[^\"]*\"|\\{{[^{{}}]*\\}})*\\}}'), lambda m: trim(m[2:-2])), lambda p: starts_with(p, '-') AND NOT contains(p, '->')), lambda p: regexp_extract(p, '^-[a-zA-Z][-_a-zA-Z0-9]*'))))"
_BROKEN = """SELECT locale, id, coalesce(attr, '') AS attr, rule, detail FROM (SELECT *, 'ftl.pair.orphan' AS rule, '' AS detail FROM (SELECT locale, id, attr FROM both_ WHERE orphan) UNION ALL
      SELECT locale, id, attr, 'ftl.pair.unbalanced', '' FROM live WHERE NOT ok UNION ALL SELECT locale, id, attr, 'ftl.pair.invented_var', invented FROM live WHERE ok AND role <> 'variant' AND invented <> ''
      UNION ALL SELECT locale, id, attr, 'ftl.pair.dropped_var', dropped FROM live WHERE ok AND role <> 'variant' AND NOT contains(source, '->') AND dropped <> ''
      UNION ALL SELECT locale, id, attr, 'ftl.pair.dropped_selector', '' FROM live WHERE ok AND role <> 'variant' AND contains(source, '->') AND NOT contains(target, '->')
      UNION ALL SELECT locale, id, attr, 'ftl.pair.invented_term', terms FROM (SELECT *, array_to_string(list_filter(""" + _TERMS.format("target") + """, lambda t: NOT list_contains(""" + _TERMS.format("source") + """, t)), ',') AS terms FROM live) WHERE ok AND terms <> ''
      UNION ALL SELECT locale, id, NULL, 'ftl.pair.missing_gender', forms FROM lost)"""
_VARIANTS = "regexp_extract_all({0}, '\\*?\\[\\s*[- ._a-zA-Z0-9]+?\\s*\\]')"

# Entries in the order of their files; a line of a text is read without the blanks around it, a section holds until the next one.
_FILES = f"""WITH {with_("ftl_files")}, heads AS (SELECT file, line, ord AS first, id FROM ftl_files WHERE attr IS NULL), said AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, first) AS turn,
  CASE WHEN line % 3 = 1 THEN 'on ' || id END AS comment, last_value(CASE WHEN line % 3 = 0 THEN 'Part ' || line END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line, first) AS section FROM heads),
read_ AS (SELECT u.file, said.turn, u.pos, u.id, u.attr, array_to_string(list_transform(string_split(u.text, chr(10)), lambda x: trim(x)), chr(10)) AS text, comment, section FROM ftl_files u JOIN said ON u.file = said.file AND u.line = said.line)
"""
ORACLES = {
    "ftl_read_units": _FILES + f"""SELECT file, CAST(turn AS INTEGER) AS turn, CAST(pos AS INTEGER) AS pos, id, CASE WHEN starts_with(id, '-') THEN 'term' ELSE 'message' END AS kind, attr, {_ROLE} AS role, trim(text) AS text, {_EMPTY.format("text")} AS empty, comment, section FROM read_""",
    "ftl_read_census": _FILES + "SELECT CASE WHEN starts_with(id, '-') THEN 'term' ELSE 'message' END AS kind, CAST(count_if(attr IS NULL) AS BIGINT) AS n, CAST(count_if(attr IS NOT NULL) AS BIGINT) AS attributes FROM read_ GROUP BY ALL",
    "ftl_census": _W + f"""SELECT CAST(count_if(attr IS NULL AND NOT starts_with(id, '-')) AS BIGINT) AS messages, CAST(count_if(attr IS NULL AND starts_with(id, '-')) AS BIGINT) AS terms, CAST(count_if(attr IS NOT NULL) AS BIGINT) AS attributes,
      CAST(count_if({_EMPTY.format("text")}) AS BIGINT) AS empty, CAST(count_if(NOT {_EMPTY.format("text")}) AS BIGINT) AS translatable FROM ftl_src""",
    "ftl_roles": _W + f"SELECT {_ROLE} AS role, count(*) AS n FROM ftl_src GROUP BY ALL",
    "ftl_prefixes": _W + "SELECT regexp_extract(id, '^-?([A-Za-z]+)', 1) AS prefix, count(*) AS n FROM ftl_src WHERE attr IS NULL GROUP BY ALL",
    "ftl_key_outliers": _W + "SELECT ord, id FROM ftl_src WHERE attr IS NULL AND NOT regexp_full_match(id, '-?[a-z][a-z0-9_-]*')",
    "ftl_select": _W + f"SELECT ord, id, attr, text FROM ftl_src WHERE NOT ({_EMPTY.format('text')}) AND contains(file, 'f1') AND starts_with(id, 'msg-') AND {_ROLE} IN ('value', 'metadata') AND len({_VARS.format('text')}) > 0",
    "ftl_variables_charset": _W + f"""SELECT variable, CASE WHEN regexp_matches(variable, '[A-Z]') AND NOT regexp_matches(variable, '[a-z]') THEN 'UPPER' WHEN contains(variable, '-') THEN 'has-hyphen' WHEN regexp_matches(variable, '[0-9]') THEN 'has-digit' ELSE 'lower_snake' END AS charset,
      count(*) AS occurrences, count(DISTINCT id) AS ids, CAST(count_if(attr IS NULL) AS BIGINT) AS in_values, CAST(count_if(attr IS NOT NULL) AS BIGINT) AS in_attributes FROM (SELECT id, attr, unnest({_VARS.format("text")}) AS variable FROM ftl_src) GROUP BY ALL""",
    "ftl_variant_keys": _W + f"""SELECT key, starred, CASE WHEN key IN ('few', 'many', 'one', 'other', 'two', 'zero') OR regexp_full_match(key, '-*[0-9]+') THEN 'fluent' ELSE 'unknown' END AS origin, count(*) AS n
      FROM (SELECT trim(ltrim(m, '*')[2:-2]) AS key, starts_with(m, '*') AS starred FROM (SELECT unnest({_VARIANTS.format("text")}) AS m FROM ftl_src WHERE contains(text, '->'))) GROUP BY ALL""",
    "ftl_gender_pairs": _W + """SELECT id, coalesce(max_by(text, ord) FILTER (attr = 'masc'), '') AS masc, coalesce(max_by(text, ord) FILTER (attr = 'fem'), '') AS fem, coalesce(max_by(text, ord) FILTER (attr = 'neut'), '') AS neut,
      count_if(attr = 'masc') > 0 AND count_if(attr = 'fem') > 0 AS complete FROM ftl_src WHERE attr IN ('masc', 'fem', 'neut') GROUP BY id""",
    "ftl_brace_balance": _W + f"SELECT ord, {_BALANCED.format('text')} AS balanced FROM ftl_src",
    "ftl_placeable_kinds": _W + _MARKS + "SELECT kind, detail, count(*) AS n FROM detailed GROUP BY ALL",
    "ftl_drift": _W + _MARKS + f"""SELECT 'attribute' AS category, attr AS name, count(*) AS n FROM ftl_src WHERE {_ROLE} = 'other' GROUP BY ALL UNION ALL SELECT 'function', detail, count(*) FROM detailed WHERE kind = 'function' AND detail NOT IN ('NUMBER', 'DATETIME', 'TAIL') GROUP BY ALL
      UNION ALL SELECT 'placeable', p[1:40], count(*) FROM detailed WHERE kind = 'other' GROUP BY ALL UNION ALL SELECT 'variant-key', key, count(*) FROM (SELECT trim(ltrim(m, '*')[2:-2]) AS key FROM (SELECT unnest({_VARIANTS.format("p")}) AS m FROM detailed WHERE kind = 'selector'))
      WHERE key NOT IN ('few', 'many', 'one', 'other', 'two', 'zero') AND NOT regexp_full_match(key, '-*[0-9]+') GROUP BY ALL""",
    "ftl_crosslocale": _W + _PAIRS + _LOST + _BROKEN,
    "ftl_sweep_rollup": _W + _PAIRS + _LOST + f"""SELECT coalesce(locale, '*') AS locale, coalesce(rule, '*') AS rule, count(*) AS n, CAST(count_if(error) AS BIGINT) AS errors, CAST(count_if(NOT error) AS BIGINT) AS warnings
      FROM (SELECT locale, rule, rule IN ('ftl.pair.unbalanced', 'ftl.pair.invented_var', 'ftl.pair.dropped_var') AS error FROM ({_BROKEN})) GROUP BY ROLLUP (locale, rule)""",
    "ftl_missing_gender": _W + _LOST + "SELECT * FROM lost",
    "ftl_placeable_tokens": _W + _PIECES + "SELECT syntax, payload, count(*) AS n FROM ftl_src JOIN inner_ USING (text) GROUP BY ALL",
    "ftl_complement": _W + _PIECES + f"""SELECT ord, words FROM ftl_src JOIN (SELECT text, array_to_string(list_filter(list_transform(range(1, len(gaps) + 1), lambda k: gaps[k] || coalesce(ms[k][1:{_BEFORE.format("ms[k]")}], '')), lambda x: x <> ''), '|') AS words FROM cut) USING (text)""",
    "ftl_findings": _W + _PIECES + f"""SELECT severity, rule, count(*) AS n FROM (SELECT text, 'ERROR' AS severity, 'ftl.brace_balance' AS rule FROM ftl_src WHERE NOT {_BALANCED.format("text")}
      UNION ALL SELECT text, 'WARN', 'ftl.unclassified_placeable' FROM ftl_src JOIN span USING (text) WHERE kind = 'other' AND {_BALANCED.format("text")}
      UNION ALL SELECT text, 'WARN', 'ftl.variant_key' FROM ftl_src JOIN span USING (text) WHERE syntax = 'selector-key' AND origin = 'unknown' AND {_BALANCED.format("text")}
      UNION ALL SELECT text, 'ERROR', 'ftl.selector_default' FROM ftl_src JOIN (SELECT text FROM span GROUP BY text HAVING count_if(syntax = 'selector-head') > 0 AND count_if(syntax = 'selector-key' AND starts_with(token, '*')) <> count_if(syntax = 'selector-head')) USING (text) WHERE {_BALANCED.format("text")})
      GROUP BY ALL""",
    "ftl_bundle_rows": _W + _PIECES + """SELECT line_id, row_number() OVER (ORDER BY file, ord, pos) AS seq, kind, attr, file, line AS line_no, id AS key, text AS source_text, coalesce(spans, '') AS spans, role AS structural_role, blank AS empty,
      CASE WHEN blank THEN 'fluent {""} intentional blank' END AS empty_reason, comment, section FROM made""",
    "ftl_bundle_statistics": _W + _PIECES + f"""SELECT what, name, count(*) AS n FROM (SELECT 'kind' AS what, span.kind AS name {_LABELLED} UNION ALL SELECT 'origin', origin {_LABELLED} UNION ALL SELECT 'unit', 'placeholders' {_LABELLED}
      UNION ALL SELECT 'unit', unnest(list_filter(['rows', CASE WHEN blank THEN 'empty' END, CASE WHEN comment IS NOT NULL OR section IS NOT NULL THEN 'with_context' END, CASE WHEN comment IS NOT NULL THEN 'with_comment' END, CASE WHEN section IS NOT NULL THEN 'with_section' END,
        CASE WHEN whole AND blank THEN 'fully_masked_empty' END, CASE WHEN whole AND NOT blank THEN 'fully_masked_nonempty' END, CASE WHEN role = 'other' THEN 'role_other' END], lambda x: x IS NOT NULL)) FROM made
      UNION ALL SELECT 'unit', CASE WHEN attr IS NULL THEN 'skipped_absent_value' ELSE 'skipped_absent_attr' END FROM ftl_src WHERE text = '') GROUP BY ALL""",
    "ftl_bundle_files": _W + "SELECT file AS path, CAST(count_if(text <> '') AS BIGINT) AS line_count, 'utf-8' AS encoding FROM ftl_src GROUP BY file",
    "ftl_bundle_verify": _W + _PIECES + f"""SELECT line_id, 'duplicate_id' AS problem FROM made GROUP BY line_id HAVING count(*) > 1 UNION ALL SELECT line_id, 'leak' FROM made WHERE regexp_matches(regexp_replace(text, '{_PIECE}', '', 'g'), '[{{}}]')""",
    "ftl_pair_counts": _W + _PAIRS + f"""SELECT locale, CAST(count_if(NOT orphan AND NOT gone) AS BIGINT) AS translated, CAST(count_if(NOT orphan AND gone) AS BIGINT) AS skipped_empty, CAST(count_if(orphan) AS BIGINT) AS orphans
      FROM (SELECT *, {_EMPTY.format("target")} OR coalesce({_EMPTY.format("source")}, false) AS gone FROM both_) GROUP BY locale""",
}
