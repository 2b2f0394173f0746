"""Scans against slow versions that keep all state by hand."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lingoframe.functions import scanners as S

SIGNS = st.text(alphabet='{}"\\$[]*<>-|^ \naA0', max_size=40)


def slow_placeables(text):
    out, i = [], 0
    while i < len(text):
        if text[i] != "{":
            i += 1
            continue
        depth, quoted, j = 1, False, i + 1
        while j < len(text) and depth:
            if quoted and text[j] == "\\":
                j += 2
                continue
            if text[j] == '"':
                quoted = not quoted
            elif not quoted:
                depth += (text[j] == "{") - (text[j] == "}")
            j += 1
        if depth or j > len(text):
            break
        inside, start = text[i + 1 : j - 1].strip(), i
        i = j
        out.append((start, j, inside))
    return out


@settings(max_examples=400, deadline=None)
@given(SIGNS)
def test_placeables(text):
    assert S.placeables(text) == slow_placeables(text)


@settings(max_examples=400, deadline=None)
@given(SIGNS)
def test_tokens_are_in_order_and_rebuild_the_text(text):
    tokens = S.placeable_tokens(text)
    ends = [0, *[e for _, e, *_ in tokens]]
    assert all(a <= s < e for a, (s, e, *_) in zip(ends, tokens))
    pieces = [text[s:e] for s, e, *_ in tokens]
    gaps = [text[a:b] for a, b in zip(ends, [*[s for s, *_ in tokens], len(text)])]
    assert "".join(g + p for g, p in zip(gaps, [*pieces, ""])) == text
    assert S.complement(text, [(s, e) for s, e, *_ in tokens]) == [g for g in gaps if g]


@settings(max_examples=300, deadline=None)
@given(SIGNS)
def test_balance_is_that_of_the_placeables(text):
    if S.balanced(text):
        rest = S.complement(text, [(a, b) for a, b, _ in slow_placeables(text)])
        assert not any(sign in "{}" for part in rest for _, sign in S.outside_strings(part)) or '"' in text


def test_spans():
    assert S.placeables("see { $x } now") == [(4, 10, "$x")]
    assert S.placeables("open { $x") == []
    assert S.placeables('{ "}" }') == [(0, 7, '"}"')]


def test_flat_selector():
    text = "Got { $n ->\n [one] just { $n }\n *[other] [F] many\n} today"
    tokens = S.placeable_tokens(text)
    assert [(text[a:b], kind) for a, b, kind, _ in tokens] == [("{ $n ->", "selector-head"), ("[one]", "selector-key"), ("{ $n }", "placeable"), ("*[other]", "selector-key"), ("}", "selector-close")]
    assert [p for *_, p in tokens] == ["n", "one", "$n", "other", None]
    assert " [F] many\n" in S.complement(text, [(a, b) for a, b, *_ in tokens])


def test_nested_selector():
    text = "{ $a ->\n [one] { $b ->\n  [few] x\n  *[other] y\n }\n *[other] z\n}"
    keys = [p for *_, kind, p in S.placeable_tokens(text) if kind == "selector-key"]
    assert keys == ["one", "few", "other", "other"]
    assert S.unit_problems(text) == []
    assert ("ERROR", "ftl.selector_default", "2") in S.unit_problems(text, compat=True)


def test_kinds():
    for inner, kind in (("$x", "var"), ("$x -> [a] b", "selector"), ("-brand", "term-ref"), ("NUMBER($x)", "function"), ('"lit"', "literal"), ("msg.attr", "msg-ref"), ("??", "other")):
        assert S.kind_of(inner)[0] == kind


def test_structure():
    rules = lambda t: [r for _, r, _ in S.unit_problems(t)]
    assert rules("{ $x") == ["ftl.brace_balance"]
    assert rules("{ $n ->\n [one] a\n [lots] b\n}") == ["ftl.selector_default", "ftl.variant_key"]
    assert rules("{ ?? }") == ["ftl.unclassified_placeable"]
    assert rules("plain { $x } words") == []


def test_tags():
    assert S.tag_problems("<b>x</b> <imagedata/> <imagedata> <side>") == []
    assert S.tag_problems("<b>x</i>") == [("ERROR", "po.markup.unbalanced", "</i>"), ("ERROR", "po.markup.unclosed", "b")]


def test_scans_as_columns(spark):
    rows = spark.createDataFrame([("a { $x } {", 1), (None, 2), ("", 3), ("{ $x }", 4), ("{ $x }", 5)], "text string, n int")
    found = {r.n: r for r in rows.select("n", S.placeables_of("text").alias("p"), S.is_balanced("text").alias("b"), S.tokens_of("text").alias("t")).collect()}
    assert [tuple(x) for x in found[1].p] == [(2, 8, "$x")] and found[1].b is False
    assert found[2].p is None and found[2].b is None
    assert found[3].p == [] and found[3].b is True
    assert found[4].t == found[5].t and found[4].t[0].syntax == "placeable"


def test_table_function(spark):
    S.register(spark)
    spark.createDataFrame([("x { -brand } { $y }",)], "text string").createOrReplaceTempView("units_sql")
    got = spark.sql("SELECT p.kind, p.detail FROM units_sql, LATERAL placeables(text) p ORDER BY p.start").collect()
    assert [tuple(r) for r in got] == [("term-ref", "-brand"), ("var", "y")]
    assert spark.sql("SELECT is_balanced(text) AS b FROM units_sql").first().b is True
