"""Queries over CSV files and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoframe import registry
from lingoframe.functions import tabular as T
from lingoframe.operators import findings
from lingoframe.operators import tabular as O
from lingoframe.plans.bindings import view, with_
from lingoframe.sources import table

LOCALES = ("en", "pl", "de", "uk")


def wide(spark, sf_dir: str) -> DataFrame:
    cells = F.create_map(*[x for c in LOCALES for x in (F.lit(c), F.col(c))])
    return view(spark, sf_dir, "csv_wide").select(F.col("row_no").alias("row"), "key", "description", cells.alias("values"))


def _listed(found: DataFrame, column: str) -> DataFrame:
    return found.withColumn(column, F.array_join(F.transform(column, lambda x: x.cast("string")), ","))


def _read(spark, sf_dir: str) -> DataFrame:
    """The rows as CSV files of a bounded size, with line breaks inside cells, and read again."""
    blocks = view(spark, sf_dir, "csv_files").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("row_no", "block"))).alias("b"))
    text = F.concat(F.lit("key,description,en,pl,de,uk\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n"), F.lit("\n"))
    rows = table.parsed(blocks.select("file", text.alias("text")), empty_mark="[EMPTY]")
    return rows.select("file", "row", "key", "description", *[F.col("values")[c].alias(c) for c in LOCALES])


QUERIES = {
    "csv_read_rows": _read,
    "csv_census": lambda s, d: O.census(wide(s, d)),
    "csv_namespace_sizes": lambda s, d: O.namespace_sizes(wide(s, d)),
    "csv_value_shapes": lambda s, d: O.shapes(O.long(wide(s, d))),
    "csv_completeness": lambda s, d: O.completeness(O.long(wide(s, d), shapes=False)),
    "csv_inventory_tokens": lambda s, d: O.token_inventory(O.long(wide(s, d), shapes=False)),
    "csv_tag_audit": lambda s, d: O.tag_audit(wide(s, d)),
    "csv_key_constructs": lambda s, d: O.key_constructs(wide(s, d)),
    "csv_duplicate_keys": lambda s, d: _listed(O.duplicate_keys(wide(s, d)), "places"),
    "csv_select": lambda s, d: O.select(wide(s, d), namespace="quest", contains="line", untranslated="uk").select("row", "key", F.col("values")["en"].alias("en")),
    "csv_slot_parity": lambda s, d: O.slot_parity(O.long(wide(s, d), shapes=False)),
    "csv_array_parity": lambda s, d: O.array_parity(O.long(wide(s, d))),
    "csv_malformed_arrays": lambda s, d: O.malformed_arrays(O.long(wide(s, d))),
    "csv_empty_marker": lambda s, d: _listed(O.lying_markers(O.long(wide(s, d), shapes=False)), "locales"),
    "csv_array_view": lambda s, d: O.array_view(O.long(wide(s, d)), F.lit(True)),
    "csv_drift": lambda s, d: O.drift(O.long(wide(s, d)), wide(s, d)),
    "csv_findings": lambda s, d: findings.summary(O.validate(wide(s, d))),
    "csv_parity_summary": lambda s, d: O.parity_summary(O.long(wide(s, d))),
    "registry_join": lambda s, d: registry.labelled(wide(s, d).select(F.explode(T.tags(F.col("description"))).alias("tag")), "tag", "csv", "tag").groupBy("tag", "role", "origin").agg(F.count("*").alias("n")),
}

_SHAPE = "CASE WHEN trim({0}) = '' THEN 'empty' WHEN starts_with(trim({0}), '[') AND ends_with(trim({0}), ']') AND json_valid(trim({0})) THEN 'array' ELSE 'scalar' END"
_LONG = f"""WITH {with_("csv_wide")},
base AS (SELECT *, regexp_extract_all(description, '\\[([^\\]]+)\\]', 1) AS tags, CASE WHEN contains(key, ':') THEN split_part(key, ':', 1) ELSE '' END AS namespace FROM csv_wide),
cells AS ({" UNION ALL ".join(f"SELECT row_no, key, namespace, list_contains(tags, 'DEPRECATED') AS deprecated, list_contains(tags, 'EMPTY') AS marked_empty, '{c}' AS locale, {c} AS value, en AS source FROM base" for c in LOCALES)}),
lng AS (SELECT *, {_SHAPE.format("value")} AS shape, {_SHAPE.format("source")} AS source_shape, trim(value) = '' AND NOT marked_empty AND trim(source) <> '' AS untranslated FROM cells)
"""
_SLOTS = "list_sort(list_distinct(regexp_extract_all({0}, '\\{{([0-9]+)\\}}', 1)))"
_PARITY = f"""slots AS (SELECT row_no AS row, key, locale,
  array_to_string(list_filter({_SLOTS.format("value")}, lambda x: NOT list_contains({_SLOTS.format("source")}, x)), ',') AS invented,
  array_to_string(list_filter({_SLOTS.format("source")}, lambda x: NOT list_contains({_SLOTS.format("value")}, x)), ',') AS dropped
  FROM lng WHERE locale <> 'en' AND NOT deprecated AND trim(value) <> '' AND trim(source) <> ''),
parity AS (SELECT * FROM slots WHERE invented <> '' OR dropped <> ''),
arrays AS (SELECT * FROM (SELECT row_no AS row, key, locale, CAST(json_array_length(source) AS INTEGER) AS source_length, CASE WHEN shape = 'array' THEN CAST(json_array_length(value) AS INTEGER) END AS length
  FROM lng WHERE locale <> 'en' AND source_shape = 'array' AND trim(value) <> '' AND NOT deprecated) WHERE length IS NULL OR length <> source_length)
"""
_PROBES = (
    ("angle-tag", "<[^>]+>"), ("html-entity", "&[a-zA-Z0-9#]+;"), ("bbcode", "\\[/?[a-zA-Z][a-zA-Z0-9 _.=-]*\\]"), ("curly-nonnum", "\\{[^}0-9][^}]*\\}"), ("dollar-var", "\\$\\{?[a-zA-Z_]"), ("percent-spec", "%[0-9]*[a-zA-Z]"),
    ("at-var", "@[A-Za-z_]"), ("other-escape", "\\\\[a-mo-zA-Z]"),
)
_TAGS = "SELECT tag, count(*) AS n, min(row_no) AS first_row FROM (SELECT row_no, unnest(tags) AS tag FROM base) GROUP BY tag"
_KNOWN = "('EMPTY', 'DEPRECATED', 'noun', 'verb')"

ORACLES = {
    "csv_read_rows": f"WITH {with_('csv_files')} SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY row_no) + 1 AS INTEGER) AS row, key, CASE WHEN description = '[EMPTY]' THEN '' ELSE description END AS description, en, pl, de || chr(10) || 'x' AS de, uk FROM csv_files",
    "csv_census": _LONG + """SELECT count(*) AS records, count(DISTINCT key) AS unique_keys, count(DISTINCT namespace) AS namespaces, CAST(count_if(list_contains(tags, 'DEPRECATED')) AS BIGINT) AS deprecated,
      CAST(count_if(list_contains(tags, 'EMPTY')) AS BIGINT) AS marked_empty, count(*) - count(DISTINCT key) AS surplus_rows FROM base""",
    "csv_namespace_sizes": _LONG + "SELECT namespace, count(*) AS n FROM base GROUP BY namespace",
    "csv_value_shapes": _LONG + "SELECT locale, shape, count(*) AS n FROM lng GROUP BY ALL",
    "csv_completeness": _LONG + """SELECT locale, CAST(count_if(trim(value) <> '') AS BIGINT) AS filled, CAST(count_if(trim(value) = '') AS BIGINT) AS blank, CAST(count_if(trim(value) = '' AND marked_empty) AS BIGINT) AS intentional,
      CAST(count_if(untranslated) AS BIGINT) AS untranslated, CAST(count_if(untranslated AND NOT deprecated) AS BIGINT) AS active_untranslated FROM lng GROUP BY locale""",
    "csv_inventory_tokens": _LONG + """SELECT cls, token, count(*) AS occurrences, count(DISTINCT row_no) AS records, min(row_no) AS first_row FROM (
      SELECT row_no, 'format-slot' AS cls, unnest(regexp_extract_all(value, '\\{[0-9]+\\}')) AS token FROM cells UNION ALL SELECT row_no, 'newline', unnest(regexp_extract_all(value, '\\\\n')) FROM cells) GROUP BY ALL""",
    "csv_tag_audit": _LONG + f"SELECT *, tag IN {_KNOWN} AS known FROM ({_TAGS})",
    "csv_key_constructs": _LONG + """SELECT kind, count(*) AS n, min(row_no) AS first_row FROM (SELECT row_no, 'variant-suffix' AS kind FROM base WHERE regexp_matches(key, '-(-?[0-9]+)$')
      UNION ALL SELECT row_no, 'template-slot' FROM base WHERE regexp_matches(key, '(^|_)X(_|$)')) GROUP BY kind""",
    "csv_duplicate_keys": _LONG + "SELECT key, count(*) AS n, string_agg(CAST(row_no AS VARCHAR), ',' ORDER BY row_no) AS places FROM base GROUP BY key HAVING count(*) > 1",
    "csv_select": _LONG + "SELECT row_no AS row, key, source AS en FROM lng WHERE locale = 'uk' AND NOT deprecated AND namespace = 'quest' AND contains(key, 'line') AND untranslated",
    "csv_slot_parity": _LONG + f", {_PARITY} SELECT * FROM parity",
    "csv_array_parity": _LONG + f", {_PARITY} SELECT * FROM arrays",
    "csv_malformed_arrays": _LONG + "SELECT row_no AS row, key, locale, value FROM lng WHERE starts_with(trim(value), '[') AND shape <> 'array'",
    "csv_empty_marker": _LONG + "SELECT row_no AS row, key, string_agg(locale, ',' ORDER BY locale) AS locales FROM lng WHERE marked_empty AND trim(value) <> '' GROUP BY ALL",
    "csv_array_view": _LONG + """SELECT row_no AS row, key, locale, CAST(i AS INTEGER) AS idx, json_extract_string(value, '$[' || i || ']') AS element
      FROM (SELECT *, unnest(range(CAST(json_array_length(value) AS BIGINT))) AS i FROM lng WHERE shape = 'array')""",
    "csv_drift": _LONG + f"""SELECT 'desc-tag' AS category, tag AS name, n, first_row FROM ({_TAGS}) WHERE tag NOT IN {_KNOWN} UNION ALL
      SELECT 'token', name, count(*), min(row_no) FROM ({" UNION ALL ".join(f"SELECT row_no, '{n}' AS name FROM lng WHERE shape <> 'array' AND regexp_matches(value, '{p}')" for n, p in _PROBES)}) GROUP BY name""",
    "csv_findings": _LONG + f""", {_PARITY} SELECT severity, rule, count(*) AS n FROM (
      SELECT 'ERROR' AS severity, 'csv.duplicate_key' AS rule FROM base GROUP BY key HAVING count(*) > 1 UNION ALL
      SELECT 'ERROR', 'csv.unknown_tag' FROM (SELECT unnest(tags) AS tag FROM base) WHERE tag NOT IN {_KNOWN} UNION ALL
      SELECT 'ERROR', 'csv.malformed_array' FROM lng WHERE starts_with(trim(value), '[') AND shape <> 'array' UNION ALL
      SELECT DISTINCT 'WARN', 'csv.empty_marker' FROM lng WHERE false UNION ALL
      SELECT 'WARN', 'csv.empty_marker' FROM (SELECT DISTINCT row_no FROM lng WHERE marked_empty AND trim(value) <> '') UNION ALL
      SELECT 'INFO', 'csv.untranslated' FROM lng WHERE untranslated AND NOT deprecated UNION ALL
      SELECT 'ERROR', 'csv.slot_parity' FROM parity UNION ALL SELECT 'ERROR', 'csv.array_parity' FROM arrays) GROUP BY ALL""",
    "csv_parity_summary": _LONG + f""", {_PARITY} SELECT locale, rule, count(*) AS n FROM (SELECT locale, 'slot_invented' AS rule FROM parity WHERE invented <> '' UNION ALL
      SELECT locale, 'slot_dropped' FROM parity WHERE dropped <> '' UNION ALL SELECT locale, 'array_length' FROM arrays) GROUP BY ALL""",
    "registry_join": _LONG + """SELECT tag, CASE WHEN tag IN ('EMPTY', 'DEPRECATED') THEN 'status' WHEN tag IN ('noun', 'verb') THEN 'pos' ELSE 'other' END AS role,
      CASE WHEN tag IN ('EMPTY', 'DEPRECATED', 'noun', 'verb') THEN 'project' ELSE 'unknown' END AS origin, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM base) GROUP BY ALL""",
}
