"""Files of the four formats, written here, to rows."""

import zipfile

import pytest
from pyspark.sql import functions as F

from lingoframe.functions import fluent as L
from lingoframe.sources import clausewitz, datasource, detect, files, fluent, gettext, table

PO = """# licence remark

msgid ""
msgstr ""
"Language: pl\\n"
"PO-Revision-Date: 2024-05-06 10:00+0100\\n"
"Plural-Forms: nplurals=3; plural=n;\\n"

#. id=unit_a
#: src/a.c:3
#, fuzzy, c-format
#| msgid "old"
# by hand
msgctxt "menu"
msgid "long "
"text"
msgid_plural "%d texts"
msgstr[0] "tekst"
msgstr[1] "teksty"
msgstr[2] ""

msgid "female^She\\nruns"
msgstr "Biegnie"

#~ msgid "gone"
"""
FTL = """### About things
### of two lines

# told below
hello = Hello { $user }
    .desc = More
    .fem = ona

## Group
-brand = Firm
pick = { $n ->
    [one] One

   *[other] Many
}
flush = { $n ->
[one] a
*[other] b
}
empty = {""}
# apart

after = x
 .attr.bad = y
"""
CWZ = '﻿l_english:\n key:0 "val "inner" end"\n bare: "x" # said "so"\n\n # remark\n broken\n open:0 "abc\nl_german:\n key2:1 ""\n'


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "po" / "demo").mkdir(parents=True)
    (root / "po" / "demo" / "pl.po").write_text(PO)
    (root / "po" / "demo" / "demo.pot").write_text(PO)
    (root / "po" / "bare").mkdir()
    (root / "po" / "bare" / "bare.pot").write_text(PO)
    (root / "ftl" / "pl").mkdir(parents=True)
    (root / "ftl" / "a.ftl").write_text(FTL)
    (root / "ftl" / "pl" / "b.ftl").write_bytes(b"\xef\xbb\xbfhello = Czesc\n")
    (root / "cwz").mkdir()
    (root / "cwz" / "x_l_english.yml").write_text(CWZ)
    (root / "csv").mkdir()
    (root / "csv" / "t.csv").write_bytes('﻿key,description,en,pl\r\na:b,[EMPTY],"x, ""y""\nz",\r\na:b,note,"[""p""]",q\r\n'.encode())
    return root


def test_numbers_too_long_are_null(spark):
    lines = spark.createDataFrame([("f", 1, "l_english:"), ("f", 2, ' a:99999999999 "x"'), ("f", 3, " b:" + "9" * 30 + ' "y"'), ("f", 4, ' c: "z"')], "file string, line int, text string")
    assert [(r.key, r.version) for r in clausewitz.entries(clausewitz.parsed(lines)).orderBy("line").collect()] == [("a", 99999999999), ("b", None), ("c", None)]
    text = 'msgid ""\nmsgstr ""\n"Plural-Forms: nplurals=99999999999;\\n"\n'
    assert [r.nplurals for r in gettext.header_facts(gettext.parsed(spark.createDataFrame([("d.po", text)], "file string, text string"))).collect()] == [None]


def test_marks_of_empty_cells(spark):
    rows = table.parsed(spark.createDataFrame([("f.csv", 'key,description,en\nk,[EMPTY],"[EMPTY]"\n')], "file string, text string"), empty_mark="[EMPTY]").collect()
    assert rows[0].description == "" and rows[0]["values"] == {"en": ""}


def test_clausewitz_lines_as_a_source(spark, tmp_path):
    (tmp_path / "a_l_english.yml").write_bytes('\ufeffl_english:\r\n a:0 "x"\n'.encode())
    datasource.register(spark)
    rows = spark.read.format("clausewitz").load(str(tmp_path))
    assert [(r.key, r.value, r.lang) for r in clausewitz.entries(clausewitz.parsed(rows)).collect()] == [("a", "x", "english")]


def test_po(spark, corpus):
    rows = gettext.read(spark, str(corpus / "po"), "pl.po").orderBy("lineno").collect()
    assert [r.is_header for r in rows] == [True, True, False, False, True]
    a, b = rows[2], rows[3]
    assert (a.msgctxt, a.msgid, a.msgid_plural, a.msgstr) == ("menu", "long text", "%d texts", ["tekst", "teksty", ""])
    assert a.flags == ["fuzzy", "c-format"] and a.comments.asDict() == {"translator": ["by hand"], "extracted": ["id=unit_a"], "refs": ["src/a.c:3"], "previous": ['msgid "old"']}
    assert (b.context_prefix, b.display, b.msgid) == ("female", "She\\nruns", "female^She\\nruns")
    assert rows[0].internal_id is None and b.internal_id.startswith("pl:") and len(b.internal_id) == 13
    facts = gettext.header_facts(gettext.read(spark, str(corpus / "po"), "pl.po", domain="demo")).collect()
    assert [tuple(r) for r in facts] == [("demo", 3, "2024-05-06 10:00+0100")]
    assert gettext.strings(gettext.read(spark, str(corpus / "po"), "pl.po", mark=None)).where("context_prefix is not null").count() == 0


def test_po_ids_stay_where_lines_move():
    a, b = gettext.parse(PO), gettext.parse("\n\n" + PO)
    assert [r["msgid"] for r in a] == [r["msgid"] for r in b] and a[2]["lineno"] + 2 == b[2]["lineno"]


def test_inventory(spark, corpus):
    assert sorted(tuple(r) for r in gettext.inventory(spark, str(corpus / "po"), "pl").collect()) == [("bare", False), ("demo", True)]


def test_ftl(spark, corpus):
    rows = {r.id: r for r in fluent.read(spark, str(corpus / "ftl")).where("file = 'a.ftl'").collect()}
    assert set(rows) == {"hello", "-brand", "pick", "flush", "empty", "after"}
    hello = rows["hello"]
    assert (hello.value, hello.comment, hello.section) == ("Hello { $user }", "told below", "About things\nof two lines")
    assert [(a.name, a.value) for a in hello.attributes] == [("desc", "More"), ("fem", "ona")]
    assert rows["-brand"].kind == "term" and rows["pick"].section == "Group"
    assert rows["pick"].value == "{ $n ->\n[one] One\n\n*[other] Many\n}" and rows["flush"].value.endswith("*[other] b\n}")
    assert rows["after"].comment is None and rows["after"].value == "x\n.attr.bad = y"
    units = fluent.units(fluent.read(spark, str(corpus / "ftl"))).where("file = 'a.ftl'")
    assert units.where("id = 'empty'").count() == 0 and units.where("role = 'gender'").count() == 1
    assert fluent.units(fluent.read(spark, str(corpus / "ftl")), True).where("id = 'empty' and empty").count() == 1
    assert [r.file for r in fluent.marked(spark, str(corpus / "ftl")).collect()] == ["pl/b.ftl"]
    assert [r.locale for r in fluent.by_locale(fluent.read(spark, str(corpus / "ftl"))).collect()] == ["pl"]
    assert fluent.parse("junk here\nx = y")[0]["kind"] == "junk"
    assert L.GENDER


def test_clausewitz(spark, corpus):
    rows = clausewitz.read(spark, str(corpus / "cwz"))
    got = {r.key: r for r in clausewitz.entries(rows).collect()}
    assert (got["key"].value, got["key"].version, got["key"].lang, got["key"].line) == ('val "inner" end', 0, "english", 2)
    assert got["bare"].version is None and got["bare"].value == 'x" # said "so'
    assert (got["key2"].value, got["key2"].lang) == ("", "german")
    assert sorted((r.line, r.kind) for r in clausewitz.warnings(rows).collect()) == [(6, "malformed"), (7, "multiline?")]


def test_replacing_folders_win(spark):
    rows = spark.createDataFrame([("k", "en", "a", False, 1), ("k", "en", "b", True, 0), ("k", "en", "c", False, 2), ("j", "en", "d", False, 1), ("j", "en", "e", False, 3)], "key string, lang string, value string, rep boolean, o int")
    assert sorted((r.key, r.value) for r in clausewitz.overridden(rows, F.col("rep"), [F.col("o")]).collect()) == [("j", "e"), ("k", "b")]


def test_csv(spark, corpus):
    rows = table.read(spark, str(corpus / "csv")).orderBy("row").collect()
    assert [(r.row, r.key, r["values"]["en"]) for r in rows] == [(2, "a:b", 'x, "y"\nz'), (3, "a:b", '["p"]')]
    assert [r.column for r in table.header(spark, str(corpus / "csv")).collect()] == "key description en pl".split()
    for bad in ("", "key,en\n1,2\n", "key,description\n1,2,3\n"):
        with pytest.raises(ValueError):
            table.parse(bad)
    assert table.parse("id;en\n1;x\n", delimiter=";", key="id", context=None)[0]["values"] == {"en": "x"}


def test_formats_by_their_signs(spark, corpus):
    got = {r.file.rsplit(".", 1)[-1]: r.format for r in detect.detect(spark, str(corpus), "*").collect()}
    assert got == {"po": "po", "pot": "po", "ftl": "ftl", "yml": "clausewitz", "csv": "csv"}


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "dlc.zip", "w") as z:
        z.writestr("loc/a_l_english.yml", CWZ)
        z.writestr("readme.txt", "x")
    got = files.zipped(spark, str(tmp_path)).collect()
    assert [r.file for r in got] == ["dlc.zip!loc/a_l_english.yml"] and bytes(got[0].content).decode() == CWZ


def test_data_sources(spark, corpus):
    datasource.register(spark)
    assert spark.read.format("po").load(str(corpus / "po")).where("msgctxt = 'menu'").count() == 1
    assert spark.read.format("ftl").load(str(corpus / "ftl")).where("attr = 'desc'").first().text == "More"
    assert spark.read.format("locale_csv").load(str(corpus / "csv")).count() == 2
