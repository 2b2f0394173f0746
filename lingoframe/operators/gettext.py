"""Tools over gettext entries (domain, ord, msgctxt, msgid, msgid_plural, msgstr, flags, and what else the source has)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingoframe.functions import gettext as G
from lingoframe.functions import scanners
from lingoframe.functions.strings import shown, surplus
from lingoframe.operators.common import last_of, tokens
from lingoframe.operators.findings import finding, together

KEYS = ["lf_ctxt", "msgid", "lf_plural"]


def summary(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count("*").alias("strings"), F.countDistinct("internal_id").alias("unique_ids"), F.count("context_prefix").alias("with_prefix"),
        F.count("msgid_plural").alias("plural"), F.count_if(F.size("comments.refs") > 0).alias("with_refs"), F.count_if(F.size("comments.extracted") > 0).alias("with_extracted"),
    )


def token_inventory(entries: DataFrame) -> DataFrame:
    """(cls, occurrences, distinct_tokens, entries)."""
    hits = tokens(entries, "msgid", G.TOKENS, ["ord"])
    return hits.groupBy("cls").agg(F.count("*").alias("occurrences"), F.countDistinct("token").alias("distinct_tokens"), F.countDistinct("ord").alias("entries"))


def first_examples(entries: DataFrame) -> DataFrame:
    """(cls, token, n, first_id)."""
    hits = tokens(entries, "msgid", G.TOKENS, ["ord", "internal_id"])
    return hits.groupBy("cls", "token").agg(F.count("*").alias("n"), F.min_by("internal_id", "ord").alias("first_id"))


def prefix_registry(entries: DataFrame, family: str | None = None) -> DataFrame:
    """(prefix, family, n, domains, first_ord)."""
    rows = entries.where("context_prefix is not null").groupBy(F.col("context_prefix").alias("prefix")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"), F.min("ord").alias("first_ord"))
    rows = rows.withColumn("family", G.family(F.col("prefix")))
    return rows if family is None else rows.where(F.col("family") == family)


def families(entries: DataFrame) -> DataFrame:
    """How many distinct prefixes each family has, and how many entries."""
    return prefix_registry(entries).groupBy("family").agg(F.count("*").alias("prefixes"), F.sum("n").alias("entries"))


def completeness(entries: DataFrame) -> DataFrame:
    """(domain, total, translated, fuzzy, untranslated, percent) with a row '*' over all."""
    rows = entries.select("domain", G.state(F.col("flags"), F.col("msgstr")).alias("state"))
    out = rows.rollup("domain").agg(F.grouping("domain").alias("g"), F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("translated", "fuzzy", "untranslated")])
    return out.select(F.when(F.col("g") == 1, "*").otherwise(F.col("domain")).alias("domain"), "total", "translated", "fuzzy", "untranslated", F.coalesce(100 * F.col("translated") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("percent"))


def coverage(entries: DataFrame) -> DataFrame:
    """By domain and over all: strings, ids, prefixes, plurals, and strings with neither prefix nor id remark."""
    gap = F.col("context_prefix").isNull() & ~F.exists("comments.extracted", lambda c: c.contains("id="))
    out = entries.rollup("domain").agg(F.grouping("domain").alias("g"), F.count("*").alias("strings"), F.countDistinct("internal_id").alias("unique_ids"), F.count("context_prefix").alias("with_prefix"), F.count("msgid_plural").alias("plural"), F.count_if(gap).alias("without_context"))
    return out.withColumn("domain", F.when(F.col("g") == 1, "*").otherwise(F.col("domain"))).drop("g")


def flags(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def unknown_angles(entries: DataFrame) -> DataFrame:
    """Tag-like tokens that are no markup, of strings that aren't po4a."""
    rows = entries.where(G.markup_family(F.col("msgid")) == "tag").select(F.inline(G.angles(F.col("msgid"))))
    return rows.where(~F.col("name").isin(G.KNOWN)).groupBy("name").agg(F.count("*").alias("n"))


def select(entries: DataFrame, prefix: str | None = None, contains: str | None = None, has: str | None = None) -> DataFrame:
    rows = entries
    if prefix is not None:
        rows = rows.where(F.col("context_prefix") == prefix)
    if contains is not None:
        rows = rows.where(F.lower("display").contains(contains.lower()))
    return rows if has is None else rows.where(F.regexp_like("msgid", F.lit(G.PATTERN[has])))


PROBLEMS = "array<struct<severity:string,rule:string,detail:string>>"


def _problem(when: Column, severity: str, rule: str, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.alias("detail")))


def markup_checks(t: Column) -> Column:
    """(severity, rule, detail) of a text: balance by a scan of the texts that have an angle, the rest by expressions; a null
    text has none."""
    tag = G.markup_family(t) == "tag"
    opens, closes, bare = G.po4a_balance(t)
    stray, amp = F.array_join(G.stray_backslashes(t), ""), G.bare_ampersands(t)
    plain = F.array_compact(F.array(
        _problem(tag & (stray != ""), "ERROR", "po.stray_backslash", stray),
        _problem(tag & (amp > 0), "WARN", "po.unescaped_amp", amp.cast("string")),
        _problem(~tag & (opens != closes), "ERROR", "po.po4a_balance", F.concat(opens.cast("string"), F.lit("/"), closes.cast("string"))),
        _problem(~tag & (bare > 0), "ERROR", "po.bare_angle", bare.cast("string")),
    ))
    scanned = scanners.tag_problems_of(F.when(tag & t.contains("<"), t))
    return F.concat(F.coalesce(plain, F.array().cast(PROBLEMS)), F.coalesce(scanned, F.array().cast(PROBLEMS)))


def markup_findings(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, severity, rule, detail) of a text column, in one pass."""
    return rows.select(*keep, F.inline(markup_checks(F.col(text))))


def validate_markup(entries: DataFrame) -> DataFrame:
    found = markup_findings(entries, "msgid", ["internal_id", "ord"])
    return finding(found, F.col("severity"), F.col("rule"), "internal_id", F.col("detail"), line="ord")


def _keyed(entries: DataFrame) -> DataFrame:
    return entries.withColumns({"lf_ctxt": F.coalesce("msgctxt", F.lit("")), "lf_plural": F.coalesce("msgid_plural", F.lit(""))})


def pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Translated entries of target with the source entry of the same context, id and plural (the last one), null where there is none."""
    src = last_of(_keyed(source).select(*KEYS, "display", "msgid_plural", "ord"), KEYS, ["ord"])
    src = src.select(*KEYS, F.col("display").alias("src_display"), F.col("msgid_plural").alias("src_plural"), F.lit(True).alias("in_source"))
    live = _keyed(target).where(F.exists("msgstr", lambda f: f != ""))
    return live.join(src, KEYS, "left")


def crosslocale(source: DataFrame, target: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """What translations break, as findings of rules po.pair.*. facts: (domain, nplurals) of the target's headers, else the
    target has a column nplurals.

    Named placeholders are compared form by form with singular and plural together; a form of a plural may drop some."""
    if facts is not None:
        target = target.join(facts.select("domain", "nplurals"), "domain", "left")
    both = pairs(source, target).withColumns({
        "plural": F.col("src_plural").isNotNull(),
        "names": F.array_sort(F.array_union(G.named(F.col("src_display")), F.coalesce(G.named(F.col("src_plural")), F.array().cast("array<string>")))),
    })
    # Each entry is a row as a whole (its form is null) and one for each of its forms, so that all rules go through one pass.
    kind = "array<struct<form:int,text:string>>"
    forms = F.filter(F.transform("msgstr", lambda f, i: F.struct(i.cast("int").alias("form"), f.alias("text"))), lambda x: x["text"] != "")
    each = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("form"), F.lit(None).cast("string").alias("text"))).cast(kind), F.when(F.col("in_source"), forms.cast(kind)).otherwise(F.array().cast(kind)))
    full = F.size(F.filter("msgstr", lambda f: f != ""))
    rows = both.select("internal_id", "ord", "plural", "names", "src_display", "src_plural", "in_source", "nplurals", full.alias("full"), F.inline(each))
    mine, specs, whole = G.named(F.col("text")), G.printf(F.col("text")), F.col("form").isNull()
    # A multiset union takes the larger count, so what exceeds it exceeds both.
    extra = F.when(F.col("plural"), _least(surplus(specs, G.printf(F.col("src_display"))), surplus(specs, G.printf(F.col("src_plural"))))).otherwise(surplus(specs, G.printf(F.col("src_display"))))
    rows = rows.withColumns({"invented": F.array_join(F.array_except(mine, F.col("names")), ","), "dropped": F.when(F.col("plural"), "").otherwise(F.array_join(F.array_except(F.col("names"), mine), ",")), "extra": shown(extra), "markup": markup_checks(F.col("text"))})
    own = F.array_compact(F.array(
        _problem(whole & F.col("in_source").isNull(), "ERROR", "po.pair.orphan", F.lit(None).cast("string")),
        _problem(whole & F.col("in_source") & F.col("plural") & (F.col("full") < F.col("nplurals")), "WARN", "po.pair.plural_arity", F.col("full").cast("string")),
        _problem(~whole & (F.col("invented") != ""), "ERROR", "po.pair.invented", F.col("invented")),
        _problem(~whole & (F.col("dropped") != ""), "ERROR", "po.pair.dropped", F.col("dropped")),
        _problem(~whole & (F.col("extra") != ""), "ERROR", "po.pair.printf_extra", F.col("extra")),
    ))
    markup = F.transform("markup", lambda m: F.struct(m["severity"].alias("severity"), F.concat(F.lit("po.pair."), F.regexp_replace(m["rule"], "^po\\.", "")).alias("rule"), m["detail"].alias("detail")))
    found = rows.select("internal_id", "ord", "form", F.inline(F.concat(own, markup)))
    return finding(found, F.col("severity"), F.col("rule"), "internal_id", F.col("detail"), line="ord", form_idx="form")


def _least(a, b):
    """Of two surpluses over the same tokens, the smaller count of each; a token that one lacks is gone."""
    count = lambda items, t: F.get(F.transform(F.filter(items, lambda x: x["token"] == t), lambda x: x["n"]), F.lit(0))
    return F.filter(F.transform(a, lambda p: F.struct(p["token"].alias("token"), F.least(p["n"], F.coalesce(count(b, p["token"]), F.lit(0))).alias("n"))), lambda p: p["n"] > 0)


def self_check(entries: DataFrame) -> DataFrame:
    """Ids that aren't unique and strings without a msgid, as counts."""
    return entries.agg((F.count("internal_id") - F.countDistinct("internal_id")).alias("collisions"), F.count_if((F.col("msgid") == "") & F.col("msgctxt").isNull()).alias("empty_msgids"))
