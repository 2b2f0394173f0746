"""Expressions over gettext entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingoframe.functions.strings import found, hex_id, sorted_set

UNIT = "\u001f"
_NAMES = "amp|apos|gt|lt|quot|#[0-9]+|#0?x[0-9a-fA-F]+"
TOKENS = (
    ("wml_var", r"(?U)\$[_a-zA-Z]\w*(\.[_a-zA-Z]\w*)*(\[\d+\])?[|]?"),
    ("markup_tag", r"(?U)</?[a-zA-Z]\w*(\s[^>]*|/)?>"),
    ("text_attr", r"text='[^']*'"),
    ("entity", f"&({_NAMES});"),
    ("escape", r'\\[ntr"\\]'),
    ("printf", r"%[-#0-9.]*\$?[cdefgiopsuxEFGX%]"),
    ("brace_var", r"\{[_a-zA-Z][_a-zA-Z0-9]*\}"),
)
PATTERN = dict(TOKENS)
ANGLE = r"(?U)<\s*(/)?\s*([a-zA-Z]\w*)[^>]*?(/)?\s*>"
PANGO = "b big bold character format h header i img italic jump ref s small span sub sup tt u underline".split()
DOCBOOK = "citetitle emphasis guibutton guiicon guilabel guimenu guimenuitem imagedata imageobject inlinemediaobject keycap keycombo link listitem literal mediaobject menuchoice phrase placeholder quote screenshot simpara subscript superscript ulink varlistentry".split()
#: Elements without a closing tag.
ALONE = "imagedata xref anchor inlinegraphic colspec".split()
KNOWN = PANGO + DOCBOOK
GROUPS = {
    "ui": ["wesnoth-lib"], "core": ["wesnoth"], "units": ["wesnoth-units"], "help": ["wesnoth-help", "wesnoth-manual"], "manpages": ["wesnoth-manpages"],
    "tutorial": ["wesnoth-tutorial"], "mp_editor": ["wesnoth-multiplayer", "wesnoth-editor"], "tools": ["wesnoth-tools"],
    "campaign": ["wesnoth-" + x for x in "anl did dod dw ei h2tt httt l low nr pap sof sota sotbe tb tdg thot trow tsg utbs wc wof".split()],
}
SLUGS = dict(reversed(x.split("=")) for x in "addons=add-ons|files_storage=files/storage|gender_agreement=gender/agreement|hotkeys=hotkeys|list_grammar=list grammar|other_ui=other/UI|si_units=SI number units|system_env=system/env".split("|"))


def prefix(msgid: Column, mark: str = "^") -> Column:
    """The context before the first mark, of 1 to 40 characters, else null."""
    head = F.regexp_extract(msgid, rf"(?s)^([^\{mark}]{{1,40}})\{mark}", 1)
    return F.when(head != "", head)


def shown_text(msgid: Column, mark: str = "^") -> Column:
    return F.when(prefix(msgid, mark).isNotNull(), F.regexp_replace(msgid, rf"(?s)^[^\{mark}]{{1,40}}\{mark}", "")).otherwise(msgid)


def family(prefix_: Column) -> Column:
    """One of eight families of context prefixes; the first case that holds."""
    low = F.lower(prefix_)
    starts = lambda c, *words: F.regexp_like(c, F.lit("^(" + "|".join(words) + ")"))
    gendered = (prefix_ == "gender") | low.contains("female") | starts(low, "male", "self_", "friend_is_", r"race\+") | low.contains("_male") | low.contains("plural") | low.contains("addressed")
    return (
        F.when(gendered, "gender/agreement")
        .when(starts(prefix_, "addon"), "add-ons")
        .when(starts(prefix_, "prefix_", "infix_"), "SI number units")
        .when(starts(prefix_, "conjunct", "disjunct"), "list grammar")
        .when(prefix_.contains("hotkey"), "hotkeys")
        .when(starts(prefix_, "cache", "dir_size", "filesystem", "save_compression"), "files/storage")
        .when(starts(prefix_, "cpu_architecture", "game_version", "log_level", "operating_system", "pixel_scale"), "system/env")
        .otherwise("other/UI")
    )


def internal_id(domain: Column, msgctxt: Column, msgid: Column, plural: Column) -> Column:
    return hex_id(domain, [domain, msgctxt, msgid, plural], UNIT, 10)


def segment_id(domain: Column, msgctxt: Column, msgid: Column) -> Column:
    return hex_id(domain, [msgctxt, msgid], "|", 12)


def state(flags: Column, msgstr: Column) -> Column:
    """fuzzy, untranslated (a form is missing or all are) or translated."""
    open_ = F.coalesce(F.size(msgstr), F.lit(0)) == 0
    return F.when(F.array_contains(F.coalesce(flags, F.array().cast("array<string>")), "fuzzy"), "fuzzy").when(open_ | F.exists(msgstr, lambda f: f == ""), "untranslated").otherwise("translated")


def markup_family(text: Column) -> Column:
    """po4a if a capital opens an angle and no closing tag stands there, else tag."""
    return F.when(F.regexp_like(text, F.lit("[A-Z]<")) & ~F.regexp_like(text, F.lit(r"(?U)</[a-zA-Z]\w*\s*>")), "po4a").otherwise("tag")


def angles(text: Column) -> Column:
    """(raw, name, kind) of every tag-like token."""
    pick = lambda t, g: F.regexp_extract(t, ANGLE, g)
    kind = lambda t: F.when(pick(t, 1) == "/", "close").when(pick(t, 3) == "/", "selfclose").otherwise("open")
    return F.transform(found(text, ANGLE), lambda t: F.struct(t.alias("raw"), F.lower(pick(t, 2)).alias("name"), kind(t).alias("kind")))


def tag_family(name: Column) -> Column:
    return F.when(name.isin(PANGO), "pango").when(name.isin(DOCBOOK), "docbook")


def markup_flags(raw: Column) -> Column:
    """Sorted set of newline, entity, po4a, pango, docbook and metasyntax."""
    po4a = markup_family(raw) == "po4a"
    tags = F.transform(angles(raw), lambda t: F.coalesce(tag_family(t["name"]), F.lit("metasyntax")))
    own = F.array_compact(F.array(F.when(raw.contains("\\n"), F.lit("newline")), F.when(F.regexp_like(raw, F.lit(PATTERN["entity"])), F.lit("entity")), F.when(po4a, F.lit("po4a"))))
    return sorted_set(F.concat(own, F.when(po4a, F.array().cast("array<string>")).otherwise(tags)))


def string_class(domain: Column, prefix_: Column) -> Column:
    """group/family; unknown for a domain in no group."""
    group = F.lit(None).cast("string")
    for name, members in GROUPS.items():
        group = F.when(domain.isin(members), name).otherwise(group)
    # A map, so that the cases of family() stand in the plan once.
    fam = F.try_element_at(F.create_map(*[F.lit(x) for pair in SLUGS.items() for x in pair]), family(prefix_))
    return F.coalesce(F.concat(group, F.lit("/"), F.when(F.coalesce(prefix_, F.lit("")) == "", "plain").otherwise(F.coalesce(fam, F.lit("other_ui")))), F.lit("unknown"))


def named(text: Column) -> Column:
    """Sorted set of named placeholders; the bar that ends a variable is dropped."""
    return sorted_set(F.concat(F.transform(found(text, PATTERN["wml_var"]), lambda t: F.regexp_replace(t, r"\|+\z", "")), found(text, PATTERN["brace_var"])))


def printf(text: Column) -> Column:
    return found(text, PATTERN["printf"])


def placeholders(text: Column) -> Column:
    return F.array_sort(F.array_union(named(text), printf(text)))


def verdict(source: Column, forms: Column) -> Column:
    """not_applicable, ok, source_only, target_only or mismatch, over the union of the forms that are there."""
    live = F.filter(F.coalesce(forms, F.array().cast("array<string>")), lambda f: f != "")
    target = F.array_distinct(F.flatten(F.transform(live, placeholders)))
    mine = placeholders(source)
    lost, new = F.size(F.array_except(mine, target)) > 0, F.size(F.array_except(target, mine)) > 0
    none = (F.size(live) == 0) | ((F.size(mine) == 0) & (F.size(target) == 0))
    return F.when(none, "not_applicable").when(lost & new, "mismatch").when(lost, "source_only").when(new, "target_only").otherwise("ok")


def stray_backslashes(text: Column) -> Column:
    """Escaped characters that no escape has; pairs are read from the left."""
    return F.filter(found(text, r"\\(.)", 1), lambda c: ~c.isin("n", "t", "r", '"', "\\"))


def bare_ampersands(text: Column) -> Column:
    """How many & begin no entity, in a text that has markup; else 0."""
    markup = F.regexp_like(text, F.lit(PATTERN["entity"])) | F.exists(angles(text), lambda t: t["name"].isin(KNOWN))
    return F.when(markup, F.regexp_count(text, F.lit(f"&(?!({_NAMES});)"))).otherwise(0)


def po4a_balance(text: Column) -> tuple[Column, Column, Column]:
    """Openers, closers, and angles that no capital precedes."""
    return F.regexp_count(text, F.lit("[A-Z]<")), F.regexp_count(text, F.lit(">")), F.regexp_count(text, F.lit(r"(?<!\p{Lu})<"))
