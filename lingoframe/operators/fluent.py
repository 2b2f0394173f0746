"""Tools over Fluent units (id, attr, text, and what else the source has)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingoframe.functions import fluent as L
from lingoframe.functions import scanners
from lingoframe.functions.strings import found
from lingoframe.operators.common import last_of
from lingoframe.operators.findings import finding, together


def census(units: DataFrame) -> DataFrame:
    """Messages, terms, attributes and empty units."""
    value = F.col("attr").isNull()
    return units.agg(
        F.count_if(value & ~F.col("id").startswith("-")).alias("messages"), F.count_if(value & F.col("id").startswith("-")).alias("terms"),
        F.count_if(~value).alias("attributes"), F.count_if(L.is_empty(F.col("text"))).alias("empty"), F.count_if(~L.is_empty(F.col("text"))).alias("translatable"),
    )


def roles(units: DataFrame) -> DataFrame:
    return units.groupBy(L.attribute_role(F.col("attr")).alias("role")).agg(F.count("*").alias("n"))


def unknown_attributes(units: DataFrame) -> DataFrame:
    return units.where(L.attribute_role(F.col("attr")) == "other").groupBy("attr").agg(F.count("*").alias("n"))


def key_outliers(units: DataFrame) -> DataFrame:
    return units.where(F.col("attr").isNull() & ~F.regexp_like("id", F.lit(r"\A-?[a-z][-_a-z0-9]*\z")))


def prefixes(units: DataFrame) -> DataFrame:
    return units.where("attr is null").groupBy(F.regexp_extract("id", r"^-?([A-Za-z]+)", 1).alias("prefix")).agg(F.count("*").alias("n"))


def placeables(units: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, start, end, inner, kind, detail) of the outermost placeables. Distinct texts with a brace are scanned."""
    rows = units.where(F.contains("text", F.lit("{"))).select(*keep, scanners.placeables_of("text").alias("spans"))
    rows = rows.select(*keep, F.inline("spans"))
    return rows.withColumn("c", L.classify(F.col("inner"))).select(*keep, "start", "end", "inner", "c.kind", "c.detail")


def placeable_kinds(units: DataFrame) -> DataFrame:
    return placeables(units, ["id"]).groupBy("kind", "detail").agg(F.count("*").alias("n"))


def tokens(units: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, start, end, syntax, payload) of the flat pieces of syntax."""
    return units.where(F.contains("text", F.lit("{"))).select(*keep, F.inline(scanners.tokens_of("text")))


def variable_inventory(units: DataFrame) -> DataFrame:
    """Each variable's class of spelling, occurrences, and how many ids and values or attributes use it."""
    rows = units.select("id", "attr", F.explode(L.variables(F.col("text"))).alias("variable"))
    return rows.groupBy("variable", L.charset(F.col("variable")).alias("charset")).agg(
        F.count("*").alias("occurrences"), F.countDistinct("id").alias("ids"), F.count_if(F.col("attr").isNull()).alias("in_values"), F.count_if(F.col("attr").isNotNull()).alias("in_attributes")
    )


def variant_keys(units: DataFrame) -> DataFrame:
    """Bracketed keys of texts with a selector: key, starred, origin and how often."""
    rows = units.where(F.contains("text", F.lit("->"))).select(F.inline(L.variant_keys(F.col("text"))))
    origin = F.when(F.col("key").isin(*L.CLDR) | L.is_number_key(F.col("key")), "fluent").otherwise("unknown")
    return rows.groupBy("key", "starred", origin.alias("origin")).agg(F.count("*").alias("n"))


def gender_sets(units: DataFrame) -> DataFrame:
    """Messages with gender forms: the three side by side ('' where there is none) and whether both of the first two are there."""
    rows = units.where(F.col("attr").isin(*L.GENDER))
    form = lambda g: F.max_by(F.when(F.col("attr") == g, F.col("text")), F.when(F.col("attr") == g, F.col("ord")))
    out = rows.groupBy("id").agg(*[form(g).alias(g) for g in ("masc", "fem", "neut")])
    return out.select("id", *[F.coalesce(g, F.lit("")).alias(g) for g in ("masc", "fem", "neut")], (F.col("masc").isNotNull() & F.col("fem").isNotNull()).alias("complete"))


def select(units: DataFrame, file: str | None = None, prefix: str | None = None, roles_: list[str] | None = None, attr: str | None = None, with_selector: bool = False, with_variable: bool = False, include_empty: bool = False) -> DataFrame:
    rows = units if include_empty else units.where(~L.is_empty(F.col("text")))
    if file is not None:
        rows = rows.where(F.contains("file", F.lit(file)))
    if prefix is not None:
        rows = rows.where(F.startswith("id", F.lit(prefix)))
    if roles_ is not None:
        rows = rows.where(L.attribute_role(F.col("attr")).isin(roles_))
    if attr is not None:
        rows = rows.where(F.col("attr") == attr)
    if with_selector:
        rows = rows.where(F.contains("text", F.lit("->")))
    return rows.where(F.size(L.variables(F.col("text"))) > 0) if with_variable else rows


def validate(units: DataFrame, marked_files: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Findings on braces, selectors and placeables; files with a byte order mark too, if given."""
    scan = scanners.unit_problems_compat if compat else scanners.unit_problems_of
    rows = units.where(F.regexp_like("text", F.lit('[{}"]'))).select("id", "attr", F.inline(scan("text")))
    out = finding(rows, F.col("severity"), F.col("rule"), "id", F.col("detail"), attr="attr")
    if marked_files is None:
        return out
    return together(out, finding(marked_files, "ERROR", "ftl.bom", "file", file="file"))


def _terms(text: Column) -> Column:
    """Terms that outermost placeables of a text refer to, as the scan of both texts gives them."""
    refs = F.filter(text, lambda s: s["inner"].startswith("-") & ~s["inner"].contains("->"))
    return F.array_distinct(F.transform(refs, lambda s: F.regexp_extract(s["inner"], f"^(-{L.IDENT})", 1)))


def pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """The last unit of each (locale, id, attr) of target with the source's, null where there is none."""
    src = last_of(source.select("id", "attr", "text", "ord"), ["id", "attr"], ["ord"]).select(F.col("id").alias("sid"), F.col("attr").alias("sattr"), F.col("text").alias("source"))
    tgt = last_of(target.select("locale", "id", "attr", "text", "ord"), ["locale", "id", "attr"], ["ord"])
    return tgt.join(src, (F.col("id") == F.col("sid")) & F.col("attr").eqNullSafe(F.col("sattr")), "left").select("locale", "id", "attr", F.col("text").alias("target"), "source", F.col("sid").isNull().alias("orphan"))


def crosslocale(source: DataFrame, target: DataFrame) -> DataFrame:
    """What translations break: findings of rules ftl.pair.*, all locales in one join."""
    both = pairs(source, target)
    live = both.where(~F.col("orphan") & ~L.is_empty(F.col("target")) & ~L.is_empty(F.col("source")))
    # Only texts with a brace are scanned; the others are balanced and have no placeable.
    braced = lambda c: F.when(F.regexp_like(c, F.lit("[{}]")), F.col(c))
    none = F.array().cast("array<struct<start:int,end:int,inner:string>>")
    live = live.withColumns({"ok": F.coalesce(scanners.is_balanced(braced("target")), F.lit(True)), "ts": F.coalesce(scanners.placeables_of(braced("target")), none), "ss": F.coalesce(scanners.placeables_of(braced("source")), none)})
    free = L.attribute_role(F.col("attr")) != "variant"
    a, b = F.array_sort(F.array_distinct(L.variables(F.col("source")))), F.array_sort(F.array_distinct(L.variables(F.col("target"))))
    arrow, there = F.contains("source", F.lit("->")), F.contains("target", F.lit("->"))
    invented = F.array_join(F.filter(F.array_except(b, a), lambda v: ~L.is_engine(v)), ",")
    dropped, terms = F.array_join(F.array_except(a, b), ","), F.array_join(F.array_sort(F.array_except(_terms(F.col("ts")), _terms(F.col("ss")))), ",")
    rule = lambda when, severity, name, detail: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule"), detail.alias("detail")))
    nothing = F.lit("")
    checks = F.array_compact(F.array(
        rule(~F.col("ok"), "ERROR", "ftl.pair.unbalanced", nothing),
        rule(F.col("ok") & free & (invented != ""), "ERROR", "ftl.pair.invented_var", invented),
        rule(F.col("ok") & free & ~arrow & (dropped != ""), "ERROR", "ftl.pair.dropped_var", dropped),
        rule(F.col("ok") & free & arrow & ~there, "WARN", "ftl.pair.dropped_selector", nothing),
        rule(F.col("ok") & (terms != ""), "WARN", "ftl.pair.invented_term", terms),
    ))
    rows = live.select("locale", "id", "attr", F.inline(checks))
    return together(
        finding(both.where("orphan"), "WARN", "ftl.pair.orphan", "id", attr="attr", locale="locale"),
        finding(rows, F.col("severity"), F.col("rule"), "id", F.col("detail"), attr="attr", locale="locale"),
        finding(missing_gender(source, target), "WARN", "ftl.pair.missing_gender", "id", F.col("forms"), locale="locale"),
    )


def missing_gender(source: DataFrame, target: DataFrame) -> DataFrame:
    """(locale, id, forms): the source has gender forms, the locale has the message and none of these forms."""
    gender = F.col("attr").isin(*L.GENDER)
    src = source.where(gender).groupBy("id").agg(F.array_sort(F.collect_set("attr")).alias("forms"))
    tgt = target.groupBy("locale", "id").agg(F.collect_set(F.when(gender, F.col("attr"))).alias("have"))
    rows = tgt.join(src, "id").where(~F.arrays_overlap("forms", "have"))
    return rows.select("locale", "id", F.array_join("forms", ",").alias("forms"))


def pair_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """(locale, translated, skipped_empty, orphans)."""
    gone = L.is_empty(F.col("target")) | L.is_empty(F.col("source"))
    return pairs(source, target).groupBy("locale").agg(F.count_if(~F.col("orphan") & ~gone).alias("translated"), F.count_if(~F.col("orphan") & gone).alias("skipped_empty"), F.count_if("orphan").alias("orphans"))


def drift(units: DataFrame) -> DataFrame:
    """(category, name, n) of attributes, functions, placeables and variant keys that the registry doesn't know."""
    marks = placeables(units, ["id"])
    attrs = unknown_attributes(units).select(F.lit("attribute").alias("category"), F.col("attr").alias("name"), "n")
    calls = marks.where((F.col("kind") == "function") & ~F.col("detail").isin("NUMBER", "DATETIME", "TAIL")).groupBy(F.col("detail").alias("name")).agg(F.count("*").alias("n")).withColumn("category", F.lit("function"))
    odd = marks.where("kind = 'other'").groupBy(F.substring("inner", 1, 40).alias("name")).agg(F.count("*").alias("n")).withColumn("category", F.lit("placeable"))
    keys = marks.where("kind = 'selector'").select(F.inline(L.variant_keys(F.col("inner")))).where(~F.col("key").isin(*L.CLDR) & ~L.is_number_key(F.col("key")))
    keys = keys.groupBy(F.col("key").alias("name")).agg(F.count("*").alias("n")).withColumn("category", F.lit("variant-key"))
    return together(attrs, calls, odd, keys).select("category", "name", "n")


def category(rule: Column) -> Column:
    """The short name of a rule: its last part, with hyphens."""
    return F.replace(F.substring_index(rule, ".", -1), F.lit("_"), F.lit("-"))


def all_locales_report(found_: DataFrame, counts: DataFrame | None = None) -> str:
    """A sweep as Markdown: totals by kind of defect, every error in the order of locale, id and attribute, and a row a locale,
    worst first, with its three commonest kinds. counts: pair_counts(), for the translated units. Counts and errors reach the
    driver, warnings don't."""
    rows = found_.withColumn("kind", category(F.col("rule")))
    kinds = rows.groupBy("kind", "severity").agg(F.count("*").alias("n")).orderBy("severity", F.desc("n"), "kind").collect()
    per = rows.groupBy("locale", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "ERROR").alias("e"), F.count_if(F.col("severity") == "WARN").alias("w"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind"))), 1, 3)
    places = per.groupBy("locale").agg(F.sum("e").alias("e"), F.sum("w").alias("w"), F.array_join(F.transform(top, lambda t: F.concat(t["kind"], F.lit("×"), (-t["n"]).cast("string"))), ", ").alias("top"))
    if counts is not None:
        places = places.join(counts.select("locale", "translated"), "locale", "full_outer")
    places = places.orderBy(F.desc_nulls_last("e"), F.desc_nulls_last("w"), "locale").collect()
    errors = rows.where("severity = 'ERROR'").orderBy("locale", "unit_id", F.coalesce("attr", F.lit("")), "kind", "detail")
    total = {s: sum(r.n for r in kinds if r.severity == s) for s in ("ERROR", "WARN")}
    out = [f"# Technical defects of {len(places)} locales: {total['ERROR']} errors, {total['WARN']} warnings", "", "| defect | severity | count |", "|---|---|---|", *[f"| {r.kind} | {r.severity} | {r.n} |" for r in kinds], "", "## Errors", ""]
    listed = [f"| {r.locale} | `{r.unit_id}{'.' + r.attr if r.attr else ''}` | {r.kind} | {r.detail or ''} |" for r in errors.toLocalIterator()]
    out += ["| locale | unit | defect | detail |", "|---|---|---|---|", *listed] if listed else ["none"]
    out += ["", "## Locales", "", "| locale | translated | errors | warnings | commonest |", "|---|---|---|---|---|"]
    out += [f"| {r.locale} | {r['translated'] or 0 if counts is not None else ''} | {r.e or 0} | {r.w or 0} | {r.top or ''} |" for r in places]
    return "\n".join(out) + "\n"


def morphology(units: DataFrame) -> DataFrame:
    """Where grammar is decided: how many units choose by selector, and how many bracketed keys that takes."""
    return units.agg(F.count_if(F.contains("text", F.lit("->"))).alias("with_selector"), F.sum(F.size(found(F.col("text"), r"\[[^\]]*\]"))).alias("brackets"))
