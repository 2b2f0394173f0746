"""The bilingual bundle: a row for each gettext entry with its translation, and checks of such rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingoframe.functions import gettext as G
from lingoframe.functions.strings import unescaped
from lingoframe.operators.common import numbered
from lingoframe.operators.findings import finding, together

#: Numbers of a file whose rows are compared with their neighbours at a time.
RUN = 1 << 16
VERDICTS = ("mismatch", "not_applicable", "ok", "source_only", "target_only")
FLAGS = ("docbook", "entity", "metasyntax", "newline", "pango", "po4a")
CLASSES = ["unknown", *[f"{g}/{f}" for g in G.GROUPS for f in [*G.SLUGS.values(), "plain"]]]


def _first(forms: Column) -> Column:
    return F.nullif(F.get(forms, F.lit(0)), F.lit(""))


def _identified(entries: DataFrame) -> DataFrame:
    return entries.withColumn("segment_id", G.segment_id(F.col("domain"), F.col("msgctxt"), F.col("msgid")))


def derived(entries: DataFrame) -> DataFrame:
    """Add segment_id, displays, pool, placeholder_check, markup_flags, string_class and the other fields that need no other row."""
    return _described(_identified(entries))


def _described(entries: DataFrame) -> DataFrame:
    msgid, forms = F.col("msgid"), F.col("msgstr")
    target = _first(forms)
    fuzzy = F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), "fuzzy")
    return entries.withColumns({
        "source_display": unescaped(msgid),
        "target": target,
        "target_display": unescaped(target),
        "fuzzy": fuzzy,
        "pool": F.when(target.isNull() | fuzzy, "untranslated").otherwise("eval"),
        "placeholders": G.placeholders(msgid),
        "placeholder_check": G.verdict(msgid, forms),
        "markup_flags": G.markup_flags(msgid),
        "string_class": G.string_class(F.col("domain"), F.col("context_prefix")),
        "context": F.coalesce(F.nullif("msgctxt", F.lit("")), F.col("context_prefix")),
    })


def rows(entries: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The twenty fields of a row and msgctxt_raw, numbered from 0 by domain and place. entries: strings of all files, with file
    and ord; facts: (domain, nplurals), else entries have nplurals. A domain is one file."""
    if facts is not None:
        entries = entries.join(facts.select("domain", "nplurals"), "domain", "left")
    out = _described(numbered(_identified(entries), "domain", ["ord"], value="segment_id"))
    plural = F.when(F.col("msgid_plural").isNotNull(), F.struct(
        F.col("msgid_plural").alias("source_plural"), unescaped(F.col("msgid_plural")).alias("source_plural_display"), F.col("msgstr").alias("target_forms"),
        F.transform("msgstr", unescaped).alias("target_forms_display"), F.col("nplurals").alias("target_nplurals"),
    ))
    refs = F.when(F.size("comments.refs") > 0, F.col("comments.refs"))
    return out.select(
        "segment_id", F.col("seq").cast("bigint").alias("seq"), F.col("domain").alias("textdomain"), "file", F.col("context").alias("msgctxt"), F.col("msgid").alias("source_en"), F.col("source_display").alias("source_en_display"),
        F.col("target").alias("target_pl"), F.col("target_display").alias("target_pl_display"), "fuzzy", plural.alias("plural_forms"), "placeholders", "markup_flags", "string_class",
        F.struct("prev", "next").alias("neighbours"), F.lit(None).cast("int").alias("char_limit"), F.lit(None).cast("string").alias("last_changed"), "pool", "placeholder_check", refs.alias("source_ref"),
        F.col("msgctxt").alias("msgctxt_raw"),
    )


def gate(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """What makes a bundle untrustworthy: domains without a header, plurals without nplurals, plurals without forms."""
    strings = entries.where(~F.col("is_header"))
    per = entries.groupBy("domain").agg(F.max("is_header").alias("headed"), F.max(F.col("msgid_plural").isNotNull()).alias("plural")).join(facts, "domain", "left")
    bare = strings.where(F.col("msgid_plural").isNotNull() & (F.size("msgstr") == 0))
    return together(
        finding(per.where("not headed"), "ERROR", "bundle.no_header", "domain"),
        finding(per.where("plural and nplurals is null"), "ERROR", "bundle.no_nplurals", "domain"),
        finding(bare, "ERROR", "bundle.plural_without_forms", "internal_id", line="lineno"),
    )


def census(made: DataFrame) -> DataFrame:
    """(what, name, n) of string classes, markup flags, verdicts and pools: one pass."""
    pair = lambda what, c: F.struct(F.lit(what).alias("what"), c.alias("name"))
    each = F.concat(F.array(pair("string_class", F.col("string_class")), pair("placeholder_check", F.col("placeholder_check")), pair("pool", F.col("pool"))), F.transform("markup_flags", lambda f: pair("markup_flag", f)))
    return made.select(F.inline(each)).groupBy("what", "name").agg(F.count("*").alias("n"))


def plural_arity(made: DataFrame) -> DataFrame:
    """Rows whose forms aren't as many as the header says."""
    return made.where(F.col("plural_forms.target_nplurals").isNotNull() & (F.size("plural_forms.target_forms") != F.col("plural_forms.target_nplurals")))


def _misplaced(made: DataFrame) -> DataFrame:
    """Rows whose neighbours aren't those before and after them in their file. A file's rows are compared within runs of RUN numbers;
    then the rows at the ends of runs, two a run, with those of the runs beside theirs."""
    wrong = ~F.col("neighbours.prev").eqNullSafe(F.col("p")) | ~F.col("neighbours.next").eqNullSafe(F.col("n"))
    line = Window.partitionBy("file", "run").orderBy("seq")
    beside = lambda c, line: [F.lag(c).over(line).alias(f"{c}_before"), F.lead(c).over(line).alias(f"{c}_after")]
    rows = made.select("file", F.floor(F.col("seq") / RUN).alias("run"), "seq", "segment_id", "neighbours", F.struct("segment_id").alias("id"))
    rows = rows.select("*", *beside("id", line))
    first, last = F.col("id_before").isNull(), F.col("id_after").isNull()
    rows = rows.select("file", "run", "seq", "segment_id", "neighbours", first.alias("first"), last.alias("last"), F.col("id_before.segment_id").alias("p"), F.col("id_after.segment_id").alias("n"))
    rows = rows.where(F.col("first") | F.col("last") | wrong)
    # Rows inside of runs stay with their run, those at the ends of a file's runs come together.
    inside = ~F.col("first") & ~F.col("last")
    ends = Window.partitionBy("file", "inside", "part").orderBy("seq", F.col("first").desc())
    rows = rows.withColumns({"inside": inside, "part": F.when(inside, F.col("run"))}).select("*", *beside("segment_id", ends))
    rows = rows.withColumns({"p": F.when(F.col("first"), F.col("segment_id_before")).otherwise(F.col("p")), "n": F.when(F.col("last"), F.col("segment_id_after")).otherwise(F.col("n"))})
    return rows.where(wrong)


def verify(made: DataFrame) -> DataFrame:
    """(segment_id, problem) of rows that break the contract; no rows mean that it holds. Identity is computed anew from the raw
    context, domain and text; numbers must be dense and neighbours must follow them."""
    bad: list[tuple[str, Column]] = [
        ("segment_id", ~F.col("segment_id").eqNullSafe(G.segment_id(F.col("textdomain"), F.col("msgctxt_raw"), F.col("source_en")))),
        ("source_display", ~F.col("source_en_display").eqNullSafe(unescaped(F.col("source_en")))),
        ("target_display", ~F.col("target_pl_display").eqNullSafe(unescaped(F.col("target_pl")))),
        ("target_empty", F.coalesce(F.col("target_pl") == "", F.lit(False))),
        ("pool", ~F.col("pool").isin("eval", "untranslated")),
        ("pool_eval", (F.col("pool") == "eval") & (F.col("target_pl").isNull() | F.col("fuzzy"))),
        ("placeholder_check", ~F.col("placeholder_check").isin(*VERDICTS)),
        ("string_class", ~F.col("string_class").isin(CLASSES)),
        ("markup_flags", F.exists("markup_flags", lambda f: ~f.isin(*FLAGS))),
        ("plural_display", F.col("plural_forms").isNotNull() & ~F.col("plural_forms.target_forms_display").eqNullSafe(F.transform("plural_forms.target_forms", unescaped))),
        ("nplurals", F.col("plural_forms").isNotNull() & ~F.coalesce(F.col("plural_forms.target_nplurals") >= 1, F.lit(False))),
    ]
    own = made.select("segment_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in bad]))).alias("problem"))
    chain = _misplaced(made).select("segment_id", F.lit("neighbours").alias("problem"))
    twice = made.groupBy("segment_id").count().where("count > 1").select("segment_id", F.lit("duplicate_id").alias("problem"))
    dense = made.agg(F.count("*").alias("c"), F.countDistinct("seq").alias("d"), F.min("seq").alias("a"), F.max("seq").alias("z")).where("c > 0 and (c <> d or a <> 0 or z <> c - 1)")
    return own.unionByName(chain).unionByName(twice).unionByName(dense.select(F.lit(None).cast("string").alias("segment_id"), F.lit("seq").alias("problem")))
