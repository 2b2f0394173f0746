"""Tools over CSV files: (row, key, description, values) and its long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingoframe.functions import tabular as T
from lingoframe.functions.strings import blank, found, stripped
from lingoframe.operators.common import duplicates, probes, tokens
from lingoframe.operators.findings import finding, together

TAGS = ("EMPTY", "DEPRECATED", "noun", "verb")


def described(wide: DataFrame) -> DataFrame:
    """Add namespace, name, tags, deprecated and marked_empty."""
    tags = T.tags(F.col("description"))
    key = F.col("key")
    return wide.withColumns({"namespace": T.namespace(key), "name": T.name(key), "tags": tags, "deprecated": F.array_contains(tags, "DEPRECATED"), "marked_empty": F.array_contains(tags, "EMPTY")})


def long(wide: DataFrame, source: str = "en", shapes: bool = True) -> DataFrame:
    """A row for each cell: row, key, namespace, tags, deprecated, marked_empty, locale, value, source (the cell of the source
    locale, '' without one) and untranslated; with shape and source_shape unless not asked for."""
    rows = described(wide).withColumn("source", F.coalesce(F.try_element_at("values", F.lit(source)), F.lit("")))
    cells = rows.select("row", "key", "namespace", "tags", "deprecated", "marked_empty", "source", F.explode("values").alias("locale", "value"))
    cells = cells.withColumn("untranslated", blank(F.col("value")) & ~F.col("marked_empty") & ~blank(F.col("source")))
    return cells.withColumns({"shape": T.shape(F.col("value")), "source_shape": T.shape(F.col("source"))}) if shapes else cells


def census(wide: DataFrame) -> DataFrame:
    rows = described(wide)
    return rows.agg(
        F.count("*").alias("records"), F.countDistinct("key").alias("unique_keys"), F.countDistinct("namespace").alias("namespaces"),
        F.count_if("deprecated").alias("deprecated"), F.count_if("marked_empty").alias("marked_empty"),
    ).withColumn("surplus_rows", F.col("records") - F.col("unique_keys"))


def namespace_sizes(wide: DataFrame) -> DataFrame:
    return wide.groupBy(T.namespace(F.col("key")).alias("namespace")).agg(F.count("*").alias("n"))


def shapes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("locale", "shape").agg(F.count("*").alias("n"))


def completeness(cells: DataFrame) -> DataFrame:
    no = blank(F.col("value"))
    return cells.groupBy("locale").agg(
        F.count_if(~no).alias("filled"), F.count_if(no).alias("blank"), F.count_if(no & F.col("marked_empty")).alias("intentional"),
        F.count_if("untranslated").alias("untranslated"), F.count_if(F.col("untranslated") & ~F.col("deprecated")).alias("active_untranslated"),
    )


def token_inventory(cells: DataFrame) -> DataFrame:
    hits = tokens(cells, "value", T.TOKENS, ["row", "locale"])
    return hits.groupBy("cls", "token").agg(F.count("*").alias("occurrences"), F.countDistinct("row").alias("records"), F.min("row").alias("first_row"))


def tag_audit(wide: DataFrame) -> DataFrame:
    """Every description tag, whether it is known, how often and where first."""
    rows = wide.select("row", F.explode(T.tags(F.col("description"))).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.min("row").alias("first_row")).withColumn("known", F.col("tag").isin(*TAGS))


def key_constructs(wide: DataFrame) -> DataFrame:
    return wide.select("row", F.explode(T.key_constructs(F.col("key"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))


def duplicate_keys(wide: DataFrame) -> DataFrame:
    return duplicates(wide, "key", "row")


def select(wide: DataFrame, namespace: str | None = None, contains: str | None = None, shape: str | None = None, untranslated: str | None = None, with_deprecated: bool = False, source: str = "en") -> DataFrame:
    """Rows that meet all that is asked for; deprecated ones only if asked for."""
    rows = described(wide)
    cell = lambda name: F.coalesce(F.try_element_at("values", F.lit(name)), F.lit(""))
    if not with_deprecated:
        rows = rows.where("not deprecated")
    if namespace is not None:
        rows = rows.where(F.col("namespace") == namespace)
    if contains is not None:
        rows = rows.where(F.contains("key", F.lit(contains)))
    if shape is not None:
        rows = rows.where(T.shape(cell(source)) == shape)
    if untranslated is not None:
        rows = rows.where(blank(cell(untranslated)) & ~F.col("marked_empty") & ~blank(cell(source)))
    return rows


def dropped_by_selection(wide: DataFrame) -> DataFrame:
    """How many rows a selection without deprecated ones leaves out."""
    return described(wide).agg(F.count_if("deprecated").alias("deprecated_rows"))


def slot_parity(cells: DataFrame, source: str = "en") -> DataFrame:
    """Active filled cells whose slots aren't those of the source, with what is invented and dropped."""
    rows = cells.where((F.col("locale") != source) & ~F.col("deprecated") & ~blank(F.col("value")) & ~blank(F.col("source")))
    mine, theirs = T.slots(F.col("value")), T.slots(F.col("source"))
    rows = rows.withColumn("invented", F.array_join(F.array_except(mine, theirs), ",")).withColumn("dropped", F.array_join(F.array_except(theirs, mine), ","))
    return rows.where("invented <> '' or dropped <> ''").select("row", "key", "locale", "invented", "dropped")


def array_parity(cells: DataFrame, source: str = "en", with_deprecated: bool = False) -> DataFrame:
    """Cells whose source is an array and that are none, or of another length. with_deprecated: as the array tool counts."""
    rows = cells.where((F.col("locale") != source) & (F.col("source_shape") == T.ARRAY) & ~blank(F.col("value")))
    rows = rows if with_deprecated else rows.where("not deprecated")
    n = lambda c: F.coalesce(F.size(F.from_json(stripped(F.col(c)), "array<string>")), F.lit(-1))
    length = F.when(F.col("shape") == T.ARRAY, n("value"))
    rows = rows.withColumn("source_length", n("source")).withColumn("length", length)
    return rows.where(F.col("length").isNull() | (F.col("length") != F.col("source_length"))).select("row", "key", "locale", "source_length", "length")


def malformed_arrays(cells: DataFrame) -> DataFrame:
    return cells.where(stripped(F.col("value")).startswith("[") & (F.col("shape") != T.ARRAY)).select("row", "key", "locale", "value")


def lying_markers(cells: DataFrame) -> DataFrame:
    """Rows marked empty that aren't, with the locales."""
    return cells.where(F.col("marked_empty") & ~blank(F.col("value"))).groupBy("row", "key").agg(F.array_sort(F.collect_list("locale")).alias("locales"))


def array_view(cells: DataFrame, where: Column) -> DataFrame:
    """Elements of array cells: row, key, locale, idx, element."""
    rows = cells.where((F.col("shape") == T.ARRAY) & where)
    return rows.select("row", "key", "locale", F.posexplode(F.from_json(stripped(F.col("value")), "array<string>")).alias("idx", "element"))


def drift(cells: DataFrame, wide: DataFrame) -> DataFrame:
    """(category, name, n, first_row) of what the registry doesn't know: tags, and probes met by cells that are no arrays."""
    tags = tag_audit(wide).where("not known").select(F.lit("desc-tag").alias("category"), F.col("tag").alias("name"), "n", "first_row")
    hits = probes(cells.where(F.col("shape") != T.ARRAY), "value", T.PROBES, ["row"])
    return tags.unionByName(hits.groupBy("name").agg(F.count("*").alias("n"), F.min("row").alias("first_row")).withColumn("category", F.lit("token")))


def validate(wide: DataFrame, source: str = "en") -> DataFrame:
    """All rules as findings."""
    cells = long(wide, source)
    dup = duplicate_keys(wide).withColumn("d", F.array_join(F.transform("places", lambda p: p.cast("string")), ","))
    tags = wide.select("row", "key", F.explode(T.tags(F.col("description"))).alias("tag")).where(~F.col("tag").isin(*TAGS))
    lies = lying_markers(cells)
    slots, arrays = slot_parity(cells, source), array_parity(cells, source)
    return together(
        finding(dup, "ERROR", "csv.duplicate_key", "key", F.col("d")),
        finding(tags, "ERROR", "csv.unknown_tag", "key", F.col("tag"), line="row"),
        finding(malformed_arrays(cells), "ERROR", "csv.malformed_array", "key", line="row", locale="locale"),
        finding(lies, "WARN", "csv.empty_marker", "key", F.array_join("locales", ","), line="row"),
        finding(cells.where("untranslated and not deprecated"), "INFO", "csv.untranslated", "key", line="row", locale="locale"),
        finding(slots, "ERROR", "csv.slot_parity", "key", F.concat_ws("/", "invented", "dropped"), line="row", locale="locale"),
        finding(arrays, "ERROR", "csv.array_parity", "key", F.concat_ws("/", F.col("source_length").cast("string"), F.col("length").cast("string")), line="row", locale="locale"),
    )


def parity_summary(cells: DataFrame, source: str = "en") -> DataFrame:
    """How many active cells of each locale invent a slot, drop one, or change an array."""
    slots = slot_parity(cells, source).select("locale", F.explode(F.array_compact(F.array(F.when(F.col("invented") != "", F.lit("slot_invented")), F.when(F.col("dropped") != "", F.lit("slot_dropped"))))).alias("rule"))
    arrays = array_parity(cells, source).select("locale", F.lit("array_length").alias("rule"))
    return slots.unionByName(arrays).groupBy("locale", "rule").agg(F.count("*").alias("n"))


def columns_audit(header: DataFrame, known: tuple[str, ...] = ("description", "key", "en", "es", "fr", "pl", "pt", "th", "ua", "zh")) -> DataFrame:
    """Header columns that the registry doesn't know."""
    return header.where(~F.col("column").isin(*known))


def column_tokens(cells: DataFrame, name: str) -> Column:
    return found(F.col(name), T.TOKENS[0][1])
