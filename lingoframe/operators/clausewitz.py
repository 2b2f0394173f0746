"""Tools over Clausewitz entries (key, version, value, lang, file, line, ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoframe.functions import clausewitz as C
from lingoframe.functions.strings import found, shown, surplus
from lingoframe.operators.common import duplicates, last_of, probes, tokens
from lingoframe.operators.findings import finding, together


def keyed(entries: DataFrame) -> DataFrame:
    """Add dotted, namespace, event_id, part, part_kind, tag and suffix."""
    key = F.col("key")
    return entries.withColumns({"dotted": C.is_dotted(key), "namespace": C.namespace(key), "event_id": C.event_id(key), "part": C.part(key), "part_kind": C.part_kind(C.part(key)), "tag": C.country_tag(key), "suffix": C.suffix(key)})


def census(entries: DataFrame) -> DataFrame:
    rows = entries.withColumn("dotted", C.is_dotted(F.col("key")))
    return rows.agg(
        F.countDistinct("file").alias("files"), F.countDistinct("lang").alias("langs"), F.count("*").alias("entries"), F.countDistinct("key").alias("unique_keys"),
        F.count_if("dotted").alias("dotted"), F.count_if(~F.col("dotted")).alias("underscore"), F.count_if(F.col("value") == "").alias("empty"),
    )


def versions(entries: DataFrame) -> DataFrame:
    return entries.groupBy("version").agg(F.count("*").alias("n"))


def catalogue(entries: DataFrame) -> DataFrame:
    """(what, name, n) of namespaces and part kinds of dotted keys, tags and suffixes of the others: one pass."""
    rows = keyed(entries)
    pair = lambda what, c: F.struct(F.lit(what).alias("what"), F.col(c).alias("name"))
    which = F.when(F.col("dotted"), F.array(pair("namespace", "namespace"), pair("part-kind", "part_kind"))).otherwise(F.array(pair("tag", "tag"), pair("suffix", "suffix")))
    return rows.select(F.inline(which)).where("name <> ''").groupBy("what", "name").agg(F.count("*").alias("n"))


def part_examples(entries: DataFrame, n: int = 6) -> DataFrame:
    """The first n distinct parts of each kind."""
    from lingoframe.operators.common import examples

    firsts = keyed(entries).where("dotted").groupBy("part_kind", "part").agg(F.min("ord").alias("first"))
    return examples(firsts, ["part_kind"], "part", ["first"], n)


def top(counts: DataFrame, n: int, by: str = "n", tie: str = "first_ord") -> DataFrame:
    """The n largest; ties in the order of first appearance."""
    return counts.orderBy(F.desc(by), F.asc(tie)).limit(n)


def inventory(entries: DataFrame) -> DataFrame:
    hits = tokens(entries, "value", C.INLINE, ["ord", "key"])
    return hits.groupBy("cls").agg(F.count("*").alias("occurrences"), F.countDistinct("ord").alias("entries"), F.min_by("key", "ord").alias("first_key"))


def formats(entries: DataFrame) -> DataFrame:
    hits = entries.select("ord", F.explode(found(F.col("value"), C.INLINE[4][1])).alias("token")).withColumn("format", C.variable_format(F.col("token")))
    return hits.where("format is not null").groupBy("format").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def scope_forms(entries: DataFrame) -> DataFrame:
    hits = entries.select(F.explode(found(F.col("value"), C.INLINE[5][1])).alias("token")).select(C.scope_form(F.col("token")).alias("s"))
    forms = F.array_compact(F.array(F.col("s.form"), F.when(F.col("s.has_format"), F.lit("+|fmt"))))
    return hits.select(F.explode(forms).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


def colours(entries: DataFrame) -> DataFrame:
    """Colour letters, whether known, and how often."""
    hits = entries.select(F.explode(found(F.col("value"), "§([A-Za-z])", 1)).alias("letter"))
    return hits.groupBy("letter").agg(F.count("*").alias("n")).withColumn("known", F.instr(F.lit(C.COLOURS), F.col("letter")) > 0)


def unbalanced(entries: DataFrame) -> DataFrame:
    opens, closes = C.colour_counts(F.col("value"))
    return entries.withColumns({"opens": opens, "closes": closes}).where("opens <> closes")


def escaped_quotes(entries: DataFrame) -> DataFrame:
    return entries.where(F.contains("value", F.lit('\\"')))


def drift(entries: DataFrame) -> DataFrame:
    """(tier, name, n, first_ord): probes by entry, unknown colours by occurrence (tier 1); what is only noted (tier 2)."""
    value = F.col("value")
    opens, closes = C.colour_counts(value)
    probe = probes(entries, "value", C.PROBES, ["ord"]).select("ord", F.lit(1).alias("tier"), "name")
    letters = entries.select("ord", F.explode(found(value, "§([A-Za-z])", 1)).alias("letter")).where(F.instr(F.lit(C.COLOURS), F.col("letter")) == 0)
    letters = letters.select("ord", F.lit(1).alias("tier"), F.concat(F.lit("unknown-color §"), "letter").alias("name"))
    noted = F.array_compact(F.array(F.when(value.contains('\\"'), F.lit("escaped-quote")), F.when(opens != closes, F.lit("unclosed-color"))))
    noted = entries.select("ord", F.lit(2).alias("tier"), F.explode(noted).alias("name"))
    return probe.unionByName(letters).unionByName(noted).groupBy("tier", "name").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def references(entries: DataFrame) -> DataFrame:
    """Every $NAME$: ord, key, name and whether it is resolved, engine or dangling. The keys are joined by name, whatever
    their number."""
    used = entries.select("ord", F.col("key"), F.explode(C.references(F.col("value"))).alias("name"))
    keys = entries.select(F.col("key").alias("k")).distinct()
    kind = F.when(F.col("k").isNotNull(), "resolved").when(C.is_engine_value(F.col("name")), "engine").otherwise("dangling")
    return used.join(keys, F.col("name") == F.col("k"), "left").select("ord", "key", "name", kind.alias("kind"))


def dangling(refs: DataFrame) -> DataFrame:
    lost = refs.where("kind = 'dangling'")
    return lost.groupBy("name").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.min_by("key", "ord").alias("first_key"))


def is_partial(entries: DataFrame, least: int = 10) -> DataFrame:
    """Whether there are too few files for dangling references to mean much."""
    return entries.agg(F.countDistinct("file").alias("files")).withColumn("partial", F.col("files") < least)


def event_coverage(entries: DataFrame) -> DataFrame:
    """(namespace, event_id, kinds, has_title, has_body) of the events."""
    rows = keyed(entries).where("dotted").groupBy("namespace", "event_id").agg(F.array_sort(F.collect_set("part_kind")).alias("k"))
    return rows.select("namespace", "event_id", F.array_join("k", ",").alias("kinds"), F.array_contains("k", "title").alias("has_title"), F.array_contains("k", "body").alias("has_body"))


def _pairs(en: DataFrame, other: DataFrame, by_lang: bool = False) -> DataFrame:
    """Values of keys on both sides, the last of each. The key alone decides, unless by_lang."""
    keys = ["key", "lang"] if by_lang else ["key"]
    a = last_of(en.select(*keys, "value", "ord"), keys, ["ord"]).select(*keys, F.col("value").alias("source"))
    b = last_of(other.select(*keys, "value", "ord"), keys, ["ord"]).select(*keys, F.col("value").alias("target"))
    return a.join(b, keys)


def token_preservation(en: DataFrame, other: DataFrame, advisory: bool = False) -> DataFrame:
    """Keys whose tokens aren't the same multiset on both sides: key, dropped, added."""
    pairs = _pairs(en, other).withColumns({"a": C.signature(F.col("source"), advisory), "b": C.signature(F.col("target"), advisory)})
    rows = pairs.withColumns({"dropped": shown(surplus(F.col("a"), F.col("b"))), "added": shown(surplus(F.col("b"), F.col("a")))})
    return rows.where("dropped <> '' or added <> ''").select("key", "dropped", "added")


def length_reference(en: DataFrame, other: DataFrame, ratio: float = 1.6) -> DataFrame:
    """Keys whose words are ratio times longer or shorter than the source's: key, source_length, length, ratio."""
    rows = _pairs(en, other).withColumns({"source_length": F.length(C.clean_text(F.col("source"))), "length": F.length(C.clean_text(F.col("target")))})
    rows = rows.where("source_length > 0").withColumn("ratio", F.col("length") / F.col("source_length"))
    return rows.where((F.col("ratio") >= ratio) | (F.col("ratio") <= 1 / ratio)).select("key", "source_length", "length", "ratio")


def furthest(rows: DataFrame, n: int = 30) -> DataFrame:
    """The first n of a length report, the longest against their sources first; ties by key, from the end of the alphabet."""
    return rows.orderBy(F.desc("ratio"), F.desc("key")).limit(n)


def select(entries: DataFrame, file: str | None = None, namespace: str | None = None, tag: str | None = None, style: str | None = None, clean: bool = False) -> DataFrame:
    key = F.col("key")
    rows = entries
    if file is not None:
        rows = rows.where(F.contains("file", F.lit(file)))
    if namespace is not None:
        rows = rows.where(C.namespace(key) == namespace)
    if tag is not None:
        rows = rows.where(C.country_tag(key) == tag)
    if style is not None:
        rows = rows.where(C.is_dotted(key) if style == "dotted" else ~C.is_dotted(key))
    return rows.withColumn("value", C.clean_text(F.col("value"))) if clean else rows


def aligned(entries: DataFrame, langs: list[str]) -> DataFrame:
    """A row a key and a column a language (the last value), null where there is none."""
    last = F.max_by("value", "ord")
    return entries.groupBy("key").pivot("lang", langs).agg(last)


def languages(entries: DataFrame) -> DataFrame:
    """Files whose name's language isn't that of their headers: file, named, found."""
    rows = entries.groupBy("file").agg(F.array_sort(F.collect_set("lang")).alias("found")).withColumn("named", F.regexp_extract("file", r"_l_([a-z_]+)\.ya?ml\z", 1))
    return rows.where((F.col("named") == "") | (F.col("found") != F.array("named")))


def validate(entries: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    dup = duplicates(entries, "key", "ord").withColumn("d", F.col("n").cast("string"))
    parts = [
        finding(dup, "INFO", "cwz.duplicate_key", "key", F.col("d")),
        finding(unbalanced(entries), "NOTED", "cwz.unbalanced_colour", "key", file="file", line="line"),
        finding(escaped_quotes(entries), "NOTED", "cwz.escaped_quote", "key", file="file", line="line"),
        finding(references(entries).where("kind = 'dangling'"), "ERROR", "cwz.dangling_reference", "key", F.col("name"), line="ord"),
    ]
    if warnings is not None:
        parts.append(finding(warnings, "INFO", "cwz.parse_warning", "text", F.col("kind"), file="file", line="line"))
    return together(*parts)
