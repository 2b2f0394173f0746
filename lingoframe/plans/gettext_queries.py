"""Queries over gettext entries and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lingoframe.bundle import bilingual
from lingoframe.functions import gettext as G
from lingoframe.functions.strings import unescaped
from lingoframe.operators import common, findings
from lingoframe.operators import gettext as O
from lingoframe.plans.bindings import view, with_
from lingoframe.sources import gettext as source
from lingoframe.sources.gettext import finished


def entries(s, d, name: str = "po_src"):
    one = F.array("msgstr_0")
    forms = F.when(F.col("msgid_plural").isNull(), one).otherwise(F.array_compact(F.array("msgstr_0", "msgstr_1", "msgstr_2")))
    few = lambda c: F.array_compact(F.array(c))
    none = F.array().cast("array<string>")
    comments = F.struct(none.alias("translator"), few("extracted").alias("extracted"), few("ref").alias("refs"), none.alias("previous"))
    rows = view(s, d, name).withColumns({"msgstr": forms, "flags": few("flag"), "comments": comments, "is_header": F.lit(False), "file": F.concat("domain", F.lit("/pl.po"))})
    return finished(rows).drop("msgstr_0", "msgstr_1", "msgstr_2", "flag", "extracted", "ref")


def _src(s, d):
    return entries(s, d)


def _tr(s, d):
    return entries(s, d, "po_tr")


def _flat_bundle(s, d):
    rows = bilingual.rows(_src(s, d))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("seq", "segment_id", "file", "textdomain", "source_en", "target_pl", "msgctxt", "source_en_display", "target_pl_display", "fuzzy", joined("placeholders"), joined("markup_flags"), "string_class", F.col("neighbours.prev").alias("prev"), F.col("neighbours.next").alias("next"), "pool", "placeholder_check", F.array_join(F.coalesce("source_ref", F.array().cast("array<string>")), ",").alias("source_ref"), F.size("plural_forms.target_forms").alias("forms"), F.array_join("plural_forms.target_forms", "|").alias("form_texts"))


def _pairs(s, d):
    found = O.crosslocale(_src(s, d), _tr(s, d))
    return found.select(F.col("line").alias("ord"), "severity", "rule", F.coalesce("form_idx", F.lit(-1)).alias("form"), F.coalesce("detail", F.lit("")).alias("detail"))


def _lines(s, d):
    return O.markup_findings(_src(s, d), "msgid", ["ord"])


def _read(s, d):
    """The entries as text files of a bounded size, and read again."""
    blocks = view(s, d, "po_files").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ord", "block"))).alias("b"))
    head = 'msgid ""\nmsgstr ""\n"Plural-Forms: nplurals=3; plural=0;\\n"\n"PO-Revision-Date: 2024-01-01\\n"\n\n'
    return source.parsed(blocks.select("file", F.concat(F.lit(head), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), F.lit("\n")).alias("text")))


def _read_entries(s, d):
    rows = source.strings(_read(s, d))
    joined = lambda c: F.array_join(c, "|")
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("ord")).alias("turn"), "domain", "msgctxt", "msgid", "msgid_plural", joined("msgstr").alias("forms"), joined("flags").alias("flags"), joined("comments.extracted").alias("extracted"), joined("comments.refs").alias("refs"), "context_prefix", "display")


def _angles(s, d):
    pages = s.read.parquet(f"{d}/pages.parquet")
    return pages.select(F.inline(G.angles(F.col("html")))).groupBy("name", "kind").agg(F.count("*").alias("n"))


QUERIES = {
    "po_read_entries": _read_entries,
    "po_read_headers": lambda s, d: source.header_facts(_read(s, d)),
    "po_summary": lambda s, d: O.summary(_src(s, d)),
    "po_token_inventory": lambda s, d: O.token_inventory(_src(s, d)),
    "po_prefix_registry": lambda s, d: O.prefix_registry(_src(s, d)),
    "po_families": lambda s, d: O.families(_src(s, d)),
    "po_completeness": lambda s, d: O.completeness(_src(s, d)).withColumn("percent", F.round("percent", 6)),
    "po_coverage": lambda s, d: O.coverage(_src(s, d)),
    "po_flags": lambda s, d: O.flags(_src(s, d)),
    "po_unknown_angles": lambda s, d: O.unknown_angles(_src(s, d)),
    "po_select": lambda s, d: O.select(_src(s, d), prefix="female", contains="ORDER", has="printf").select("ord", "msgid"),
    "po_ids": lambda s, d: _src(s, d).select("ord", "internal_id", G.segment_id(F.col("domain"), F.col("msgctxt"), F.col("msgid")).alias("segment_id")),
    "po_unescape": lambda s, d: _src(s, d).select("ord", unescaped(F.col("msgid")).alias("shown")),
    "po_markup_rules": _lines,
    "po_markup_balance": lambda s, d: O.markup_findings(_src(s, d), "msgid", ["ord"]).groupBy("severity", "rule", "detail").agg(F.count("*").alias("n")),
    "po_crosslocale": _pairs,
    "po_crosslocale_summary": lambda s, d: findings.summary(O.crosslocale(_src(s, d), _tr(s, d))),
    "po_self_check": lambda s, d: O.self_check(_src(s, d)),
    "po_bundle_rows": _flat_bundle,
    "po_bundle_census": lambda s, d: bilingual.census(bilingual.derived(_src(s, d))),
    "po_bundle_verify": lambda s, d: bilingual.verify(bilingual.rows(_src(s, d))),
    "delivery_diff": lambda s, d: common.changed(_src(s, d).select("ord", "msgid"), _tr(s, d).select("ord", "msgid"), ["ord"], "msgid"),
    "inconsistent_translations": lambda s, d: common.inconsistent(_src(s, d).withColumn("t", F.get("msgstr", F.lit(0))), "msgid", "t"),
    "pages_angle_tokens": _angles,
}

_ANGLE = "<\\s*(/)?\\s*([a-zA-Z]\\w*)[^>]*?(/)?\\s*>"
_PREFIX = "nullif(regexp_extract(msgid, '^([^\\^]{1,40})\\^', 1), '')"
_NAMED = "list_distinct(list_concat(list_transform(regexp_extract_all({0}, '\\$[_a-zA-Z]\\w*(?:\\.[_a-zA-Z]\\w*)*(?:\\[\\d+\\])?[|]?'), lambda x: rtrim(x, '|')), regexp_extract_all({0}, '\\{{[_a-zA-Z][_a-zA-Z0-9]*\\}}')))"
_PRINTF = "regexp_extract_all({0}, '%[-#0-9.]*\\$?[cdefgiopsuxEFGX%]')"
_HOLD = f"list_sort(list_distinct(list_concat({_NAMED}, {_PRINTF})))"
_UNESCAPE = "replace(replace(replace(replace({0}, chr(92) || chr(92), chr(1)), chr(92) || 'n', chr(10)), chr(92), ''), chr(1), chr(92))"
_FAM = """CASE WHEN prefix = 'gender' OR contains(lower(prefix), 'female') OR starts_with(lower(prefix), 'male') OR contains(lower(prefix), '_male') OR contains(lower(prefix), 'plural') OR contains(lower(prefix), 'addressed') OR regexp_matches(lower(prefix), '^(self_|friend_is_|race\\+)') THEN 'gender/agreement'
  WHEN starts_with(prefix, 'addon') THEN 'add-ons' WHEN regexp_matches(prefix, '^(prefix_|infix_)') THEN 'SI number units' WHEN regexp_matches(prefix, '^(conjunct|disjunct)') THEN 'list grammar' WHEN contains(prefix, 'hotkey') THEN 'hotkeys'
  WHEN regexp_matches(prefix, '^(filesystem|save_compression|cache|dir_size)') THEN 'files/storage' WHEN regexp_matches(prefix, '^(log_level|cpu_architecture|operating_system|pixel_scale|game_version)') THEN 'system/env' ELSE 'other/UI' END"""
_STATE = "CASE WHEN flag = 'fuzzy' THEN 'fuzzy' WHEN list_contains(forms, '') THEN 'untranslated' ELSE 'translated' END"


def _x(name: str) -> str:
    return f"""SELECT *, {_PREFIX} AS prefix, regexp_replace(msgid, '^[^\\^]{{1,40}}\\^', '') AS display, CASE WHEN msgid_plural IS NULL THEN [msgstr_0] ELSE list_filter([msgstr_0, msgstr_1, msgstr_2], lambda f: f IS NOT NULL) END AS forms,
  domain || ':' || sha1(domain || chr(31) || coalesce(msgctxt, '') || chr(31) || msgid || chr(31) || coalesce(msgid_plural, ''))[1:10] AS internal_id, domain || ':' || sha1(coalesce(msgctxt, '') || '|' || msgid)[1:12] AS segment_id,
  CASE WHEN regexp_matches(msgid, '[A-Z]<') AND NOT regexp_matches(msgid, '</[A-Za-z]\\w*\\s*>') THEN 'po4a' ELSE 'tag' END AS markup FROM {name}"""


_W = f"WITH RECURSIVE {with_('po_src', 'po_tr')}, x AS ({_x('po_src')}), y AS ({_x('po_tr')})"
_CLASSES = {
    "wml_var": r"\$[_a-zA-Z]\w*(?:\.[_a-zA-Z]\w*)*(?:\[\d+\])?\|?", "markup_tag": r"</?[a-zA-Z]\w*(?:\s[^>]*|/)?>", "text_attr": r"text=''[^'']*''", "entity": r"&(?:amp|lt|gt|quot|apos|#[0-9]+|#0?x[a-fA-F0-9]+);",
    "escape": r'\\[\\nrt"]', "printf": r"%[-#.0-9]*\$?[diouxXeEfgGcsp%]", "brace_var": r"\{[a-zA-Z_][a-zA-Z_0-9]*\}",
}
_TOKENS = " UNION ALL ".join(f"SELECT ord, '{n}' AS cls, unnest(regexp_extract_all(msgid, '{p}')) AS token FROM x" for n, p in _CLASSES.items())
_PANGO = "('b', 'big', 'bold', 'character', 'format', 'h', 'header', 'i', 'img', 'italic', 'jump', 'ref', 's', 'small', 'span', 'sub', 'sup', 'tt', 'u', 'underline')"
_DOCBOOK = """('citetitle', 'emphasis', 'guibutton', 'guiicon', 'guilabel', 'guimenu', 'guimenuitem', 'imagedata', 'imageobject', 'inlinemediaobject', 'keycap', 'keycombo', 'link', 'listitem', 'literal', 'mediaobject', 'menuchoice', 'phrase',
  'placeholder', 'quote', 'screenshot', 'simpara', 'subscript', 'superscript', 'ulink', 'varlistentry')"""
_KNOWN = _PANGO[:-1] + ", " + _DOCBOOK[1:]
_TAGS = f"list_transform(regexp_extract_all(msgid, '{_ANGLE}'), lambda t: lower(regexp_extract(t, '{_ANGLE}', 2)))"
_ENTITY = "&(?:amp|apos|gt|lt|quot|#[0-9]+|#0?x[0-9a-fA-F]+);"
_BUNDLE = f""", derived AS (SELECT *, nullif(forms[1], '') AS target, coalesce(flag = 'fuzzy', false) AS fuzzy, {_HOLD.format("msgid")} AS hold, list_filter(forms, lambda f: f <> '') AS live FROM x),
held AS (SELECT *, list_distinct(flatten(list_transform(live, lambda f: {_HOLD.format("f")}))) AS thold FROM derived),
made AS (SELECT *, CASE WHEN target IS NULL OR fuzzy THEN 'untranslated' ELSE 'eval' END AS pool,
  CASE WHEN len(live) = 0 OR (len(hold) = 0 AND len(thold) = 0) THEN 'not_applicable' WHEN list_has_all(hold, thold) AND list_has_all(thold, hold) THEN 'ok' WHEN list_has_all(hold, thold) THEN 'source_only' WHEN list_has_all(thold, hold) THEN 'target_only' ELSE 'mismatch' END AS placeholder_check,
  list_sort(list_distinct(list_concat(CASE WHEN contains(msgid, chr(92) || 'n') THEN ['newline'] ELSE [] END, CASE WHEN regexp_matches(msgid, '{_ENTITY}') THEN ['entity'] ELSE [] END,
    CASE WHEN markup = 'po4a' THEN ['po4a'] ELSE list_transform({_TAGS}, lambda t: CASE WHEN t IN {_PANGO} THEN 'pango' WHEN t IN {_DOCBOOK} THEN 'docbook' ELSE 'metasyntax' END) END))) AS flags,
  CASE domain WHEN 'wesnoth-lib' THEN 'ui/' WHEN 'wesnoth' THEN 'core/' WHEN 'wesnoth-units' THEN 'units/' WHEN 'wesnoth-manpages' THEN 'manpages/' WHEN 'wesnoth-httt' THEN 'campaign/' END
    || CASE WHEN prefix IS NULL THEN 'plain' ELSE CASE {_FAM} WHEN 'gender/agreement' THEN 'gender_agreement' WHEN 'add-ons' THEN 'addons' WHEN 'SI number units' THEN 'si_units' WHEN 'list grammar' THEN 'list_grammar' WHEN 'hotkeys' THEN 'hotkeys' WHEN 'files/storage' THEN 'files_storage' WHEN 'system/env' THEN 'system_env' ELSE 'other_ui' END END AS cls FROM held)
"""
_CROSS = f""", s AS (SELECT coalesce(msgctxt, '') AS c, msgid AS i, coalesce(msgid_plural, '') AS p, max_by(display, ord) AS sd FROM x GROUP BY ALL),
j AS (SELECT y.*, s.sd, s.i IS NOT NULL AS in_source, msgid_plural IS NOT NULL AS is_plural FROM y LEFT JOIN s ON coalesce(msgctxt, '') = c AND msgid = i AND coalesce(msgid_plural, '') = p WHERE len(list_filter(forms, lambda f: f <> '')) > 0),
n AS (SELECT *, list_sort(list_distinct(list_concat({_NAMED.format("sd")}, CASE WHEN is_plural THEN {_NAMED.format("msgid_plural")} ELSE [] END))) AS names FROM j WHERE in_source),
f AS (SELECT ord, is_plural, names, sd, msgid_plural, CAST(k - 1 AS INTEGER) AS form, forms[k] AS text FROM (SELECT *, unnest(range(1, len(forms) + 1)) AS k FROM n) WHERE forms[k] <> ''),
c AS (SELECT ord, form, is_plural, sd, msgid_plural, text, token, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, unnest({_PRINTF.format("text")}) AS token FROM f) GROUP BY ALL),
lines_ AS (SELECT ord, form, text FROM f),
e AS (SELECT ord, form, token, n - greatest(len(list_filter({_PRINTF.format("sd")}, lambda t: t = token)), CASE WHEN is_plural THEN len(list_filter({_PRINTF.format("msgid_plural")}, lambda t: t = token)) ELSE 0 END) AS g FROM c)
"""

# Tags that open and close are taken one by one from the left, with those still open as a list.
_MARKUP = f""", fam AS (SELECT *, CASE WHEN regexp_matches(text, '[A-Z]<') AND NOT regexp_matches(text, '</[A-Za-z]\\w*\\s*>') THEN 'po4a' ELSE 'tag' END AS markup FROM lines_),
seen AS (SELECT DISTINCT text FROM fam WHERE markup = 'tag' AND contains(text, '<')),
tags AS (SELECT text, list_filter(list_transform(regexp_extract_all(text, '{_ANGLE}'), lambda t: {{'raw': t, 'name': lower(regexp_extract(t, '{_ANGLE}', 2)), 'close': regexp_extract(t, '{_ANGLE}', 1) = '/', 'alone': regexp_extract(t, '{_ANGLE}', 3) = '/'}}),
  lambda t: t.name IN {_KNOWN} AND t.name NOT IN ('imagedata', 'xref', 'anchor', 'inlinegraphic', 'colspec') AND (t.close OR NOT t.alone)) AS ts FROM seen),
step AS (SELECT text, ts, 0 AS k, CAST([] AS VARCHAR[]) AS open_, CAST([] AS VARCHAR[]) AS wrong FROM tags UNION ALL
  SELECT text, ts, k + 1, CASE WHEN NOT ts[k + 1].close THEN list_append(open_, ts[k + 1].name) WHEN open_[-1] = ts[k + 1].name THEN open_[1:-2] ELSE open_ END,
    CASE WHEN ts[k + 1].close AND open_[-1] IS DISTINCT FROM ts[k + 1].name THEN list_append(wrong, ts[k + 1].raw) ELSE wrong END FROM step WHERE k < len(ts)),
ended AS (SELECT * FROM step WHERE k = len(ts)),
unfit AS (SELECT text, 'po.markup.unbalanced' AS rule, unnest(wrong) AS detail FROM ended UNION ALL SELECT text, 'po.markup.unclosed', array_to_string(open_, ',') FROM ended WHERE len(open_) > 0),
marked AS (SELECT ord, form, severity, rule, detail FROM (SELECT ord, form, 'ERROR' AS severity, 'po.stray_backslash' AS rule, array_to_string(list_filter(regexp_extract_all(text, '\\\\(.)', 1), lambda c: NOT contains('ntr"' || chr(92), c)), '') AS detail FROM fam WHERE markup = 'tag' UNION ALL
  SELECT ord, form, 'WARN', 'po.unescaped_amp', CASE WHEN (regexp_matches(text, '{_ENTITY}') OR list_has_any({_TAGS.replace("msgid", "text")}, {_KNOWN.replace("(", "[").replace(")", "]")})) AND len(regexp_extract_all(text, '&')) > len(regexp_extract_all(text, '{_ENTITY}')) THEN CAST(len(regexp_extract_all(text, '&')) - len(regexp_extract_all(text, '{_ENTITY}')) AS VARCHAR) ELSE '' END FROM fam WHERE markup = 'tag' UNION ALL
  SELECT ord, form, 'ERROR', 'po.po4a_balance', CASE WHEN len(regexp_extract_all(text, '[A-Z]<')) <> len(regexp_extract_all(text, '>')) THEN len(regexp_extract_all(text, '[A-Z]<')) || '/' || len(regexp_extract_all(text, '>')) ELSE '' END FROM fam WHERE markup = 'po4a' UNION ALL
  SELECT ord, form, 'ERROR', 'po.bare_angle', CASE WHEN len(regexp_extract_all(text, '<')) > len(regexp_extract_all(text, '[A-Z]<')) THEN CAST(len(regexp_extract_all(text, '<')) - len(regexp_extract_all(text, '[A-Z]<')) AS VARCHAR) ELSE '' END FROM fam WHERE markup = 'po4a') WHERE detail <> ''
  UNION ALL SELECT ord, form, 'ERROR', rule, detail FROM fam JOIN unfit USING (text) WHERE markup = 'tag')
"""
_BROKEN = f"""SELECT ord, severity, rule, form, detail FROM (SELECT ord, 'ERROR' AS severity, 'po.pair.orphan' AS rule, -1 AS form, '' AS detail FROM j WHERE NOT in_source UNION ALL
      SELECT ord, 'WARN', 'po.pair.plural_arity', -1, CAST(len(list_filter(forms, lambda z: z <> '')) AS VARCHAR) FROM n WHERE is_plural AND len(list_filter(forms, lambda z: z <> '')) < nplurals UNION ALL
      SELECT ord, 'ERROR', 'po.pair.invented', form, array_to_string(list_filter(list_sort({_NAMED.format("text")}), lambda z: NOT list_contains(names, z)), ',') FROM f UNION ALL
      SELECT ord, 'ERROR', 'po.pair.dropped', form, array_to_string(list_filter(names, lambda z: NOT list_contains({_NAMED.format("text")}, z)), ',') FROM f WHERE NOT is_plural UNION ALL
      SELECT ord, 'ERROR', 'po.pair.printf_extra', form, string_agg(token || 'x' || g, ' ' ORDER BY token) FROM e WHERE g > 0 GROUP BY ord, form UNION ALL
      SELECT ord, severity, 'po.pair.' || rule[4:], form, detail FROM marked) WHERE detail <> '' OR rule = 'po.pair.orphan'"""

ORACLES = {
    "po_read_entries": _W + """SELECT domain || '/' || (ord // 997) || '.po' AS file, CAST(row_number() OVER (PARTITION BY domain, ord // 997 ORDER BY ord) AS INTEGER) AS turn, CAST(ord // 997 AS VARCHAR) AS domain, msgctxt, msgid, msgid_plural,
      array_to_string(forms, '|') AS forms, coalesce(flag, '') AS flags, coalesce(extracted, '') AS extracted, coalesce(ref, '') AS refs, prefix AS context_prefix, display FROM x""",
    "po_read_headers": _W + "SELECT DISTINCT CAST(ord // 997 AS VARCHAR) AS domain, 3 AS nplurals, '2024-01-01' AS revision_date FROM x",
    "po_summary": _W + """SELECT count(*) AS strings, count(DISTINCT internal_id) AS unique_ids, count(prefix) AS with_prefix, count(msgid_plural) AS plural, count(ref) AS with_refs, count(extracted) AS with_extracted FROM x""",
    "po_token_inventory": _W + f"SELECT cls, count(*) AS occurrences, count(DISTINCT token) AS distinct_tokens, count(DISTINCT ord) AS entries FROM ({_TOKENS}) GROUP BY cls",
    "po_prefix_registry": _W + f"SELECT *, {_FAM} AS family FROM (SELECT prefix, count(*) AS n, array_to_string(list_sort(list(DISTINCT domain)), ',') AS domains, min(ord) AS first_ord FROM x WHERE prefix IS NOT NULL GROUP BY prefix)",
    "po_families": _W + f"SELECT {_FAM} AS family, count(DISTINCT prefix) AS prefixes, count(*) AS entries FROM x WHERE prefix IS NOT NULL GROUP BY ALL",
    "po_completeness": _W + f"""SELECT coalesce(domain, '*') AS domain, count(*) AS total, CAST(count_if(st = 'translated') AS BIGINT) AS translated, CAST(count_if(st = 'fuzzy') AS BIGINT) AS fuzzy, CAST(count_if(st = 'untranslated') AS BIGINT) AS untranslated,
      round(100 * CAST(count_if(st = 'translated') AS DOUBLE) / count(*), 6) AS percent FROM (SELECT domain, {_STATE} AS st FROM x) GROUP BY ROLLUP (domain)""",
    "po_coverage": _W + """SELECT coalesce(domain, '*') AS domain, count(*) AS strings, count(DISTINCT internal_id) AS unique_ids, count(prefix) AS with_prefix, count(msgid_plural) AS plural, CAST(count_if(prefix IS NULL AND NOT coalesce(contains(extracted, 'id='), false)) AS BIGINT) AS without_context FROM x GROUP BY ROLLUP (domain)""",
    "po_flags": _W + "SELECT flag, count(*) AS n FROM x WHERE flag IS NOT NULL GROUP BY flag",
    "po_unknown_angles": _W + f"SELECT name, count(*) AS n FROM (SELECT unnest({_TAGS}) AS name FROM x WHERE markup = 'tag') WHERE name NOT IN {_KNOWN} GROUP BY name",
    "po_select": _W + f"SELECT ord, msgid FROM x WHERE prefix = 'female' AND contains(lower(display), 'order') AND len({_PRINTF.format('msgid')}) > 0",
    "po_ids": _W + "SELECT ord, internal_id, segment_id FROM x",
    "po_unescape": _W + f"SELECT ord, {_UNESCAPE.format('msgid')} AS shown FROM x",
    "po_markup_rules": _W + ", lines_ AS (SELECT ord, 0 AS form, msgid AS text FROM x)" + _MARKUP + "SELECT ord, severity, rule, detail FROM marked",
    "po_markup_balance": _W + ", lines_ AS (SELECT ord, 0 AS form, msgid AS text FROM x)" + _MARKUP + "SELECT severity, rule, detail, count(*) AS n FROM marked GROUP BY ALL",
    "po_crosslocale": _W + _CROSS + _MARKUP + _BROKEN,
    "po_crosslocale_summary": _W + _CROSS + _MARKUP + f"SELECT severity, rule, count(*) AS n FROM ({_BROKEN}) GROUP BY ALL",
    "po_self_check": _W + "SELECT count(internal_id) - count(DISTINCT internal_id) AS collisions, CAST(count_if(msgid = '' AND msgctxt IS NULL) AS BIGINT) AS empty_msgids FROM x",
    "po_bundle_rows": _W + _BUNDLE + f"""SELECT segment_id, row_number() OVER (ORDER BY domain, ord) - 1 AS seq, domain AS textdomain, domain || '/pl.po' AS file, coalesce(msgctxt, prefix) AS msgctxt, msgid AS source_en, {_UNESCAPE.format("msgid")} AS source_en_display, target AS target_pl, {_UNESCAPE.format("target")} AS target_pl_display, fuzzy,
      array_to_string(hold, ',') AS placeholders, array_to_string(flags, ',') AS markup_flags, coalesce(cls, 'unknown') AS string_class, lag(segment_id) OVER (PARTITION BY domain ORDER BY ord) AS prev, lead(segment_id) OVER (PARTITION BY domain ORDER BY ord) AS next, pool, placeholder_check, coalesce(ref, '') AS source_ref,
      CASE WHEN msgid_plural IS NOT NULL THEN CAST(len(forms) AS INTEGER) END AS forms, CASE WHEN msgid_plural IS NOT NULL THEN array_to_string(forms, '|') END AS form_texts FROM made""",
    "po_bundle_census": _W + _BUNDLE + """SELECT what, name, count(*) AS n FROM (SELECT 'string_class' AS what, coalesce(cls, 'unknown') AS name FROM made UNION ALL SELECT 'placeholder_check', placeholder_check FROM made UNION ALL SELECT 'pool', pool FROM made UNION ALL SELECT 'markup_flag', unnest(flags) FROM made) GROUP BY ALL""",
    "po_bundle_verify": _W + "SELECT segment_id, 'duplicate_id' AS problem FROM x GROUP BY segment_id HAVING count(*) > 1",
    "delivery_diff": _W + """SELECT ord, CASE WHEN x.msgid IS NULL THEN 'added' WHEN y.msgid IS NULL THEN 'removed' ELSE 'changed' END AS change, x.msgid AS old, y.msgid AS new FROM x FULL JOIN y USING (ord) WHERE x.msgid IS DISTINCT FROM y.msgid""",
    "inconsistent_translations": _W + "SELECT msgid, count(DISTINCT msgstr_0) AS targets, count(*) AS n FROM x GROUP BY msgid HAVING count(DISTINCT msgstr_0) > 1",
    "pages_angle_tokens": f"""SELECT lower(regexp_extract(t, '{_ANGLE}', 2)) AS name, CASE WHEN regexp_extract(t, '{_ANGLE}', 1) = '/' THEN 'close' WHEN regexp_extract(t, '{_ANGLE}', 3) = '/' THEN 'selfclose' ELSE 'open' END AS kind, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '{_ANGLE}')) AS t FROM pages) GROUP BY ALL""",
}
