"""Tools over small tables, where the driver tables have no such case."""

from pyspark.sql import functions as F

from lingoframe import registry, sinks
from lingoframe.operators import clausewitz as C
from lingoframe.operators import findings, fluent, tabular

WIDE = "row int, key string, description string, values map<string,string>"


def test_csv_rules(spark):
    rows = [
        (2, "a:x", "note", {"en": "go {0} {1}", "pl": "idz {0} {2}", "de": ""}),
        (3, "a:x", "[DEPRECATED]", {"en": "{0}", "pl": "nic", "de": "nix"}),
        (4, "a:e", "[EMPTY]", {"en": "", "pl": "", "de": "doch"}),
        (5, "a:l", "[odd]", {"en": '["a","b"]', "pl": '["a"]', "de": "kein"}),
        (6, "a:m", None, {"en": '["?"],', "pl": None, "de": "x"}),
    ]
    found = tabular.validate(spark.createDataFrame(rows, WIDE))
    got = sorted((r.rule, r.unit_id, r.locale or "", r.detail or "") for r in found.collect())
    assert ("csv.slot_parity", "a:x", "pl", "2/1") in got and not any(r[0] == "csv.slot_parity" and r[1] != "a:x" for r in got)
    assert ("csv.duplicate_key", "a:x", "", "2,3") in got and ("csv.unknown_tag", "a:l", "", "odd") in got
    assert ("csv.array_parity", "a:l", "pl", "2/1") in got and ("csv.array_parity", "a:l", "de", "2") in got
    assert ("csv.malformed_array", "a:m", "en", "") in got and ("csv.empty_marker", "a:e", "", "de") in got
    assert ("csv.untranslated", "a:x", "de", "") in got and not any(r[:3] == ("csv.untranslated", "a:e", "pl") for r in got)


def test_array_tool_counts_deprecated(spark):
    rows = spark.createDataFrame([(2, "k", "[DEPRECATED]", {"en": '["a"]', "pl": "x"})], WIDE)
    cells = tabular.long(rows)
    assert tabular.array_parity(cells).count() == 0 and tabular.array_parity(cells, with_deprecated=True).count() == 1


def test_references(spark):
    rows = spark.createDataFrame([("a", "$b$ $VALUE$ $B_2|Y$ $gone|x$", 1), ("b", "x", 2)], "key string, value string, ord int")
    assert sorted((r.name, r.kind) for r in C.references(rows).collect()) == [("B_2", "engine"), ("VALUE", "engine"), ("b", "resolved"), ("gone", "dangling")]


def test_tokens_must_stay(spark):
    en = spark.createDataFrame([("k", "$A$ $A|Y$ [x] £i", 1), ("k", "$A$ $A$", 2), ("same", "$A|Y$", 3)], "key string, value string, ord int")
    pl = spark.createDataFrame([("k", "$A$ @GER", 1), ("same", "$A|R$", 2)], "key string, value string, ord int")
    assert [tuple(r) for r in C.token_preservation(en, pl).collect()] == [("k", "$A$x1", "@GERx1")]


def test_noted_is_not_drift(spark):
    rows = spark.createDataFrame([('say \\"x\\"', 1), ("§Yopen", 2), ("#TODO later", 3), ("\\t tab", 4), ("§Qx§!", 5)], "value string, ord int")
    assert sorted((r.tier, r.name) for r in C.drift(rows).collect()) == [(1, "unknown-color §Q"), (2, "escaped-quote"), (2, "unclosed-color")]


def test_fluent_pairs(spark):
    src = spark.createDataFrame([("a", None, "Hi { $x } { $y }", 1), ("a", "fem", "f", 2), ("b", "a0", "{ $x }", 3), ("c", None, "{ $n ->\n [one] x\n *[other] y\n}", 4), ("e", None, "x", 5)], "id string, attr string, text string, ord int")
    tgt = spark.createDataFrame([("pl", "a", None, "Cz { $x } { $user_gender } { -nowy }", 1), ("pl", "b", "a0", "{ $z }", 2), ("pl", "c", None, "bez", 3), ("pl", "z", None, "sierota", 4), ("pl", "e", None, "{ x", 5)], "locale string, id string, attr string, text string, ord int")
    got = sorted((r.rule, r.unit_id, r.detail or "") for r in fluent.crosslocale(src, tgt).collect())
    assert got == [("ftl.pair.dropped_selector", "c", ""), ("ftl.pair.dropped_var", "a", "y"), ("ftl.pair.invented_term", "a", "-nowy"), ("ftl.pair.missing_gender", "a", "fem"), ("ftl.pair.orphan", "z", ""), ("ftl.pair.unbalanced", "e", "")]
    report = fluent.all_locales_report(fluent.crosslocale(src, tgt), fluent.pair_counts(src, tgt))
    assert report.startswith("# Technical defects of 1 locales: 2 errors, 4 warnings\n")
    assert "| pl | 4 | 2 | 4 | dropped-selector×1, dropped-var×1, invented-term×1 |" in report
    assert "| locale | unit | defect | detail |\n|---|---|---|---|\n| pl | `a` | dropped-var | y |\n| pl | `e` | unbalanced |  |\n" in report and "| orphan | WARN | 1 |" in report
    assert "| pl |  | 2 | 4 |" in fluent.all_locales_report(fluent.crosslocale(src, tgt)) and "none" in fluent.all_locales_report(fluent.crosslocale(src, tgt.limit(0)))


def test_labels(spark):
    rows = spark.createDataFrame([("NUMBER",), ("ODD",)], "f string")
    assert sorted((r.f, r.origin) for r in registry.labelled(rows, "f", "ftl", "function").collect()) == [("NUMBER", "fluent"), ("ODD", "unknown")]


def test_sinks(spark, tmp_path):
    wide = spark.createDataFrame([(2, "k", 'd "q"', {"en": "a,b", "pl": ""})], WIDE)
    sinks.slice_csv(wide.coalesce(1), ["en", "pl"], str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_text() == 'key,description,en,pl\nk,"d ""q""","a,b",\n'
    sinks.slice_json(wide.select("key", F.lit(None).cast("string").alias("x")).coalesce(1), str(tmp_path / "j"))
    assert next((tmp_path / "j").glob("*.txt")).read_text() == '{"key":"k","x":null}\n'
    entries = spark.createDataFrame([("k", "a\tb\nc", "f", 2), ("j", "x", "f", 1)], "key string, value string, file string, line int")
    assert [r.value for r in sinks.key_text(entries).collect()] == ["j\tx", "k\ta\\tb\\nc"]


def test_totals(spark):
    rows = spark.createDataFrame([("pl", "r1", "ERROR"), ("pl", "r1", "WARN"), ("de", "r2", "WARN")], "locale string, rule string, severity string")
    got = {(r.locale, r.rule): (r.n, r.errors, r.warnings) for r in findings.by_locale(rows).collect()}
    assert got[("*", "*")] == (3, 1, 2) and got[("pl", "*")] == (2, 1, 1) and got[("pl", "r1")] == (2, 1, 1)
