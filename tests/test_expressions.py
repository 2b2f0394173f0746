"""Expressions on strings, keys and tokens."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lingoframe.functions import clausewitz as C
from lingoframe.functions import fluent as L
from lingoframe.functions import gettext as G
from lingoframe.functions import strings as X
from lingoframe.functions import tabular as T


def values(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in rows.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def slow_unescape(raw):
    return re.sub(r"\\(.)", lambda m: dict(zip("abfnrtv", "\a\b\f\n\r\t\v")).get(m[1], m[1]), raw, flags=re.S)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet='\\ntq"x\n{}[]*$ ', max_size=12), min_size=150, max_size=150))
def test_unescape(spark, texts):
    assert values(spark, texts, X.unescaped) == [slow_unescape(t) for t in texts]


def test_unescape_by_hand(spark):
    assert values(spark, ["a\\nb", "\\\\n", "end\\", "\\q", "", None], X.unescaped) == ["a\nb", "\\n", "end\\", "q", "", None]


def slow_shape(text):
    s = text.strip()
    if not s:
        return "empty"
    if s[0] == "[" and s[-1] == "]":
        try:
            return "array" if isinstance(json.loads(s), list) else "scalar"
        except ValueError:
            pass
    return "scalar"


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet='[]",: a1{}', max_size=12), min_size=200, max_size=200))
def test_shape_of_noise(spark, texts):
    assert values(spark, texts, T.shape) == [slow_shape(t) for t in texts]


def test_shape(spark):
    cells = ['["a", "b"]', '["a"],["b"]', '["?"],', " ", None, "[x]", '["x"], "b": ["y"]', '["a"]],["b"]', "[[1], 2]", "[]", "words", '\u2003["a"]\u2003']
    assert values(spark, cells, T.shape) == ["array", "scalar", "scalar", "empty", "empty", "scalar", "scalar", "scalar", "array", "array", "scalar", "array"]
    assert values(spark, cells[:2], T.elements) == [["a", "b"], None]


def test_csv_keys(spark):
    assert values(spark, ["a:b:c", "loose", ":x"], T.namespace) == ["a", "", ""]
    assert values(spark, ["a:b:c", "loose", ":x"], T.name) == ["b:c", "loose", "x"]
    assert values(spark, ["foe-2", "foe--1", "rank_X_up", "plain"], T.key_constructs) == [["variant-suffix"], ["variant-suffix"], ["template-slot"], []]
    assert values(spark, ["[EMPTY] x [noun]", "none"], T.tags) == [["EMPTY", "noun"], []]


def test_event_keys(spark):
    keys = ["war.12.t", "war.x.3.a.tt", "war.12.desc2", "war.12", "GER_plan_ADJ", "no.digits"]
    assert values(spark, keys, C.is_dotted) == [True, True, True, True, False, False]
    assert values(spark, keys, C.namespace) == ["war", "war.x", "war", "war", "", "no.digits"]
    assert values(spark, keys, C.event_id) == ["12", "3", "12", "12", "", ""]
    assert values(spark, keys, lambda k: C.part_kind(C.part(k))) == ["title", "tooltip", "body", "none", "none", "none"]
    assert values(spark, ["opt3", "a", "r", "4", "refused", "desc.a"], C.part_kind) == ["option", "option", "option", "option", "named-variant", "body"]
    assert values(spark, keys, C.country_tag)[4] == "GER" and values(spark, keys, C.suffix)[4] == "ADJ"


def test_clean_text(spark):
    assert values(spark, ["§YGold§!\\nfor [Root.Name] £złoto $X|Y$ @GER  now"], C.clean_text) == ["Gold for now"]


def test_surplus_counts(spark):
    row = spark.sql("SELECT array('a', 'a', 'b') AS l, array('a', 'c') AS r").select(X.shown(X.surplus(F.col("l"), F.col("r"))).alias("x"), X.shown(X.surplus(F.col("r"), F.col("l"))).alias("y")).first()
    assert (row.x, row.y) == ("ax1 bx1", "cx1")


def test_segment_id(spark):
    row = spark.sql("SELECT 'd' AS d, cast(null AS string) AS c, 'Konrad' AS m").select(G.segment_id(F.col("d"), F.col("c"), F.col("m")).alias("s")).first()
    assert row.s == "d:53bdcea5c81e"


def test_prefix(spark):
    texts = ["female^She goes", "^no prefix", "plain", "x" * 41 + "^long", "a^b^c"]
    assert values(spark, texts, G.prefix) == ["female", None, None, None, "a"]
    assert values(spark, texts, G.shown_text) == ["She goes", "^no prefix", "plain", "x" * 41 + "^long", "b^c"]


def test_families(spark):
    prefixes = ["female", "self_x", "addon", "prefix_mega", "conjunct pair", "hotkey", "cache", "log_level", "Title", "race+male"]
    assert values(spark, prefixes, G.family) == ["gender/agreement", "gender/agreement", "add-ons", "SI number units", "list grammar", "hotkeys", "files/storage", "system/env", "other/UI", "gender/agreement"]


def test_verdicts(spark):
    rows = spark.createDataFrame([("$a", ["$a"]), ("$a", ["x"]), ("x", ["$a"]), ("$a", ["$b"]), ("x", ["y"]), ("$a", [""]), ("$a $b", ["$a", "$b|"]), ("100%percent", ["x"])], "s string, t array<string>")
    assert [r.v for r in rows.select(G.verdict(F.col("s"), F.col("t")).alias("v")).collect()] == "ok source_only target_only mismatch not_applicable not_applicable ok source_only".split()


def test_variable_ends_before_a_full_stop(spark):
    assert values(spark, ["$version. $unit.name| {leader} {1}"], G.named) == [["$unit.name", "$version", "{leader}"]]


def test_markup_flags(spark):
    texts = ["<b>x</b> &amp;", "B<bold>", "HP<b>x</b>", "<side> a\\nb", "<emphasis>x</emphasis>", "plain"]
    assert values(spark, texts, G.markup_flags) == [["entity", "pango"], ["po4a"], ["pango"], ["metasyntax", "newline"], ["docbook"], []]


def test_ampersands(spark):
    assert values(spark, ["Save & go", "<b>a</b> & b", "&amp; & &", "x"], G.bare_ampersands) == [0, 1, 2, 0]


def test_fluent_expressions(spark):
    assert values(spark, ['{ "" }', "", ' {""} ', "x", None], L.is_empty) == [True, True, True, False, True]
    assert values(spark, [None, "desc", "fem", "a12", "axe", "other"], L.attribute_role) == ["value", "metadata", "gender", "variant", "enum", "other"]
    assert values(spark, ["XP", "a-b", "a1", "name", "aB"], L.charset) == ["UPPER", "has-hyphen", "has-digit", "lower_snake", "lower_snake"]
    got = values(spark, ["*[other] x [one] y"], L.variant_keys)[0]
    assert [tuple(x) for x in got] == [("other", True), ("one", False)]


@pytest.mark.parametrize("inner", ["$x", "$a-b -> [x] y", "-brand", "FOO ($x)", '"lit"', '"', "msg.attr", "msg", "a b", "$", "-", "", "X()"])
def test_classify_like_the_scan(spark, inner):
    from lingoframe.functions.scanners import kind_of

    assert tuple(values(spark, [inner], L.classify)[0]) == kind_of(inner)
