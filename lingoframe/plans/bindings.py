"""The driver's tables as localisation files: SQL that both engines read alike, with constructs and defects by the rows' keys.

A binding is a common table expression over the driver's tables or other bindings. view() gives its rows in Spark, with_() the WITH
clause that DuckDB needs. Every row of the table underneath is there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("part", "orders", "events", "pages", "conversations", "documents")
B = "chr(92)"


def _case(*pairs: str, other: str = "''") -> str:
    return "CASE " + " ".join(f"WHEN {pairs[i]} THEN {pairs[i + 1]}" for i in range(0, len(pairs), 2)) + f" ELSE {other} END"


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


BINDINGS = {
    "csv_wide": f"""
SELECT CAST(p_partkey + 2 AS BIGINT) AS row_no,
  {_case("k % 17 = 3", "'loose'", "k % 5 = 0", "'menu:item'", "k % 5 = 1", "'quest:line'", "k % 5 = 2", "'enemy:name'", other="'ui:label'")} || '_' || {_text("k")}
    || {_case("k % 11 = 0", f"'-' || {_text('k % 3')}", "k % 13 = 0", "'_X_line'")} AS key,
  {_case("k % 23 = 0", "'[EMPTY]'", "k % 29 = 0", "'old [DEPRECATED] [noun]'", "k % 31 = 0", "'[MYSTERY] note'", "k % 5 = 0", "'[verb] say it'", other="'plain note'")} AS description,
  {_case("k % 46 = 0", "''", "k % 7 = 0", "'[\"' || p_name || '\", \"' || p_brand || '\"]'", "k % 19 = 0", "'[\"' || p_name || '\"],'", other=f"p_name || ' costs {{0}} of {{1}}' || " + _case("k % 3 = 0", f"{B} || 'n<b>' || p_type || '</b>'"))} AS en,
  {_case("k % 37 = 0", "'  '", "k % 46 = 0", "''", "k % 35 = 0", "'[\"' || p_name || '\"]'", "k % 7 = 0", "'[\"a ' || p_name || '\", \"b\"]'", "k % 19 = 0", "p_name", "k % 41 = 0", "p_name || ' kosztuje {0} {2}'", "k % 43 = 0", "p_name || ' kosztuje &amp; %d $gold'", other="p_name || ' kosztuje {1} z {0}'")} AS pl,
  {_case("k % 14 = 0", "'[\"x\", \"y\"]'", "k % 7 = 0", "'kein Feld'", "k % 12 = 0", "p_name || ' kostet {0}'", other="p_name || ' kostet {0} von {1} @ort'")} AS de,
  {_case("k % 3 = 0", "p_name || ' {0} {1}'")} AS uk
FROM (SELECT *, p_partkey % 1999 AS k FROM part) AS p""",
    "cwz_en": f"""
SELECT o_orderkey AS ord, 'english' AS lang, 'f' || {_text("k % 7")} || '_l_english.yml' AS file, CAST((k - k % 7) / 7 AS BIGINT) AS line, CAST(k % 3 AS INT) AS version,
  {_case("k % 5 = 0", f"'news.' || {_text('k % 700')} || '.' || " + _case("k % 9 = 0", "'t'", "k % 9 = 1", "'d'", "k % 9 = 2", "'a'", "k % 9 = 3", "'b.tt'", "k % 9 = 4", "'desc2'", "k % 9 = 5", "'option3'", "k % 9 = 6", "'rejection'", "k % 9 = 7", "'4'"),
         other=_case("k % 4 = 0", "'GER_'", "k % 4 = 1", "'SOV_plan_'", "k % 4 = 2", "'idea_'", other="'focus_'") + f" || {_text('o_custkey')} || " + _case("k % 3 = 0", "'_desc'", "k % 3 = 1", "'_ADJ'"))} AS key,
  {_case("k % 10 = 0", "'§YGold§! for $COUNTRY$ ' || o_orderpriority", "k % 10 = 1", "'£pol_power 5 @GER flag'", "k % 10 = 2", f"'[Root.GetName] says $idea_' || {_text('o_custkey')} || '_desc|Y$'", "k % 10 = 3", f"'[?GetDate|+=%]' || {B} || 'n$VALUE|+=%1$ due'",
         "k % 10 = 4", "'§Zodd $missing_key$ ' || o_orderstatus", "k % 10 = 5", f"'escaped ' || {B} || '\"quote' || {B} || '\" ' || {B} || 'q'", "k % 10 = 6", "''", "k % 10 = 7", "'#key x#! @icon! {{brace}}'".replace("{{", "{").replace("}}", "}"), "k % 10 = 8", "'[GetDate] plain text'", other="'plain words  here ' || o_orderpriority")} AS value
FROM (SELECT *, o_orderkey AS k FROM orders) AS o""",
    "cwz_other": f"""
SELECT ord, 'polish' AS lang, file, line, version, key,
  {_case("ord % 14 = 0", "replace(replace(value, '$COUNTRY$', ''), '[Root.GetName]', '')", "ord % 9 = 0", "value || ' i jeszcze bardzo wiele innych zbytecznych slow'", "ord % 11 = 0", "value || ' $NEW$ @SOV'", "ord % 6 = 3", "replace(value, '|+=%1', '|Y')", other="value")} AS value
FROM cwz_en WHERE ord % 12 <> 7""",
    "cwz_lines": f"""
SELECT file, line + 1 AS line,
  {_case("ord % 50 = 0", "'l_english:'", "ord % 50 = 25", "'l_german: # switched'", "ord % 50 = 10", "' # remark'", "ord % 50 = 11", "''", "ord % 50 = 12", "' broken line'", "ord % 50 = 13", "' key:0 \"unclosed'", "ord % 50 = 14", "' bare: \"no version\" # said \"so\"'",
         other=f"' ' || key || ':' || {_text('version')} || ' \"' || value || '\"'")} AS text
FROM cwz_en""",
    "po_src": f"""
SELECT o_orderkey AS ord, CAST(o_orderkey + 1 AS BIGINT) AS lineno, {_case("k % 6 = 0", "'wesnoth-lib'", "k % 6 = 1", "'wesnoth'", "k % 6 = 2", "'wesnoth-units'", "k % 6 = 3", "'wesnoth-manpages'", "k % 6 = 4", "'wesnoth-httt'", other="'strange'")} AS domain,
  CASE WHEN k % 33 = 7 THEN 'menu' END AS msgctxt,
  {_case("k % 9 = 0", "'female^'", "k % 9 = 4", "'hotkey_menu^'", "k % 27 = 5", "'prefix_kilo^'", "k % 27 = 14", "'conjunct start^'", "k % 27 = 23", "'addons_of^'", "k % 27 = 1", "'cache dir^'", "k % 27 = 10", "'log_level^'", "k % 27 = 19", "'Title^'")} || 'Order ' || {_text("o_custkey")}
    || {_case("k % 8 = 0", "' for $unit.name| and {leader}'", "k % 8 = 1", "' has <b>bold</b> text & more <i>'", "k % 8 = 2", "' &amp; more $gold. ' || o_orderstatus", "k % 8 = 3", "' %d of %s'", "k % 8 = 4", f"' line' || {B} || 'n' || 'two ' || {B} || 'q'", "k % 8 = 5", "' use <side> <emphasis>now</emphasis>'", "k % 8 = 6", "' I<italic> B<bold < x'", other="' plain'")} AS msgid,
  CASE WHEN k % 8 = 3 THEN 'Orders %d of %s many {{leader}}' END AS msgid_plural,
  CASE WHEN k % 23 = 0 THEN 'fuzzy' WHEN k % 8 = 3 THEN 'c-format' END AS flag,
  CASE WHEN k % 15 = 0 THEN 'id=unit_' || {_text("k")} WHEN k % 4 = 0 THEN 'a remark' END AS extracted,
  CASE WHEN k % 2 = 0 THEN 'data/file.cfg:' || {_text("k")} END AS ref, CAST(3 AS INT) AS nplurals,
  {_case("k % 11 = 0", "''", other="'Zlecenie ' || " + _case("k % 13 = 0", "'puste'", "k % 17 = 0", "'nr $ghost {leader} $unit.name|'", "k % 19 = 0", "'<b>otwarte %x'", "k % 8 = 0", "'dla $unit.name| oraz {leader}'", "k % 8 = 1", "'ma <b>tekst</b>'", "k % 8 = 2", "'&amp; wiecej $gold|'", "k % 8 = 3", "'%d z %s'", other="'zwykle'"))} AS msgstr_0,
  CASE WHEN k % 8 = 3 THEN CASE WHEN k % 5 = 0 THEN '' ELSE 'Zlecenia %d z %s' END END AS msgstr_1,
  CASE WHEN k % 8 = 3 AND k % 7 <> 0 THEN 'Zlecen %d' END AS msgstr_2
FROM (SELECT *, o_orderkey AS k FROM orders) AS o""",
    "po_tr": """
SELECT ord, lineno, domain, msgctxt, CASE WHEN ord % 41 = 0 THEN msgid || ' (stale)' ELSE msgid END AS msgid, msgid_plural, flag, extracted, ref, nplurals, msgstr_0, msgstr_1, msgstr_2
FROM po_src WHERE ord % 10 <> 9""",
    "ftl_src": f"""
SELECT event_id AS ord, 'f' || {_text("m % 5")} || '.ftl' AS file, CAST(m + 1 AS BIGINT) AS line, a AS pos, {_case("m % 31 = 0", "'Msg_'", "m % 29 = 0", "'-term-'", other="'msg-'")} || {_text("m % 4001")} AS id,
  CASE a WHEN 0 THEN NULL WHEN 1 THEN 'desc' WHEN 2 THEN 'fem' WHEN 3 THEN 'masc' WHEN 4 THEN 'a0' ELSE CASE WHEN m % 2 = 0 THEN 'wibble' ELSE 'burning' END END AS attr,
  {_case("t = 0", "'Hello { $user }, ' || event_type", "t = 1", "'{ $count ->' || chr(10) || '    [one] One item' || chr(10) || '   *[other] { $count } items' || chr(10) || '}'", "t = 2", "'Use { -brand } and { NUMBER($n, x: 1) }'", "t = 3", "'{ \"\" }'", "t = 4", "'Broken { $x ' || event_type", "t = 5", "'{ msg.attr } of { $Big-Name2 }'",
         "t = 6", "'{ FOO() } {?} { \"lit}\" }'", "t = 7", "'{ $n ->' || chr(10) || ' [few] a' || chr(10) || ' [lots] b' || chr(10) || '}'", "t = 8", "'plain words'", "t = 9", "'{ $USER } says ' || event_type", "t = 10", "'{ $user_gender ->' || chr(10) || ' [male] he' || chr(10) || ' *[female] she' || chr(10) || '} left'")} AS text
FROM (SELECT *, event_id % 6 AS a, (event_id - event_id % 6) / 6 AS m0, CAST((event_id - event_id % 6) / 6 AS BIGINT) AS m, (CAST((event_id - event_id % 6) / 6 AS BIGINT) + event_id % 6) % 12 AS t FROM events) AS e""",
    "po_files": f"""
SELECT domain || '/' || {_text("CAST((ord - ord % 997) / 997 AS BIGINT)")} || '.po' AS file, ord,
  CASE WHEN extracted IS NULL THEN '' ELSE '#. ' || extracted || chr(10) END || CASE WHEN ref IS NULL THEN '' ELSE '#: ' || ref || chr(10) END || CASE WHEN flag IS NULL THEN '' ELSE '#, ' || flag || chr(10) END
    || CASE WHEN msgctxt IS NULL THEN '' ELSE 'msgctxt "' || msgctxt || '"' || chr(10) END || 'msgid ' || CASE WHEN ord % 3 = 0 THEN '""' || chr(10) ELSE '' END || '"' || msgid || '"' || chr(10)
    || CASE WHEN msgid_plural IS NULL THEN 'msgstr "' || msgstr_0 || '"' ELSE 'msgid_plural "' || msgid_plural || '"' || chr(10) || 'msgstr[0] "' || msgstr_0 || '"' || coalesce(chr(10) || 'msgstr[1] "' || msgstr_1 || '"', '')
      || coalesce(chr(10) || 'msgstr[2] "' || msgstr_2 || '"', '') END AS block
FROM po_src""",
    "ftl_files": f"""
SELECT file || '-' || {_text("CAST((line - line % 499) / 499 AS BIGINT)")} AS file, ord, line, pos, id, attr, text, CASE WHEN attr IS NULL THEN CASE WHEN line % 3 = 0 THEN '## Part ' || {_text("line")} || chr(10) WHEN line % 3 = 1 THEN '# on ' || id || chr(10) ELSE '' END || id || ' = ' || text ELSE '    .' || attr || ' = ' || text END AS block
FROM (SELECT file, ord, line, pos, id, attr, replace(text, 'Broken {{ $x', 'Broken $x') AS text FROM ftl_src) AS u""",
    "csv_files": f"""
SELECT 'part' || {_text("CAST((row_no - row_no % 499) / 499 AS BIGINT)")} || '.csv' AS file, row_no, key, description, en, pl, de, uk,
  '"' || replace(key, '"', '""') || '","' || replace(description, '"', '""') || '","' || replace(en, '"', '""') || '",' || CASE WHEN pl LIKE '%"%' OR pl LIKE '%,%' OR pl = '' THEN '"' || replace(pl, '"', '""') || '"' ELSE pl END || ',"' || replace(de, '"', '""') || chr(10) || 'x","' || uk || '"' AS block
FROM csv_wide""",
    "ftl_tr": """
SELECT ord, locale, CASE WHEN ord % 43 = 0 THEN id || '-old' ELSE id END AS id, attr,
  CASE WHEN ord % 13 = 0 THEN replace(text, '$user', '$uzytkownik') WHEN ord % 17 = 0 THEN replace(text, '{ $user }', 'ktos') WHEN ord % 19 = 0 THEN text || ' }' WHEN ord % 23 = 0 THEN 'tylko slowa' WHEN ord % 7 = 0 THEN text || ' { -nazwa } { $player_gender }' WHEN ord % 11 = 0 THEN '' ELSE text END AS text
FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN 'pl' ELSE 'de' END AS locale FROM ftl_src) AS s
WHERE NOT (attr IS NOT NULL AND attr IN ('fem', 'masc') AND line % 3 = 0)""",
}


def _needed(name: str) -> list[str]:
    out: list[str] = []
    for other in BINDINGS:
        if other != name and re.search(rf"\b{other}\b", BINDINGS[name]):
            out += [x for x in _needed(other) if x not in out] + [other]
    return list(dict.fromkeys(out))


def with_(*names: str) -> str:
    """A WITH clause of these bindings and what they need, without the word at its end."""
    every = list(dict.fromkeys(x for n in names for x in [*_needed(n), n]))
    return ", ".join(f"{n} AS ({BINDINGS[n]})" for n in every)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = f"WITH {with_(name)} SELECT * FROM {name}"
    for table in TABLES:
        if re.search(rf"\bFROM {table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"lf_{table}")
            sql = re.sub(rf"\bFROM {table}\b", f"FROM lf_{table}", sql)
    return spark.sql(sql)
