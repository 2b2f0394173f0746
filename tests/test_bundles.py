"""Bundles: the same bytes twice, every broken row found, manifests and payloads checked."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lingoframe.bundle import artifact, bilingual, mono, schema
from lingoframe.operators import common
from lingoframe.operators import gettext as O
from lingoframe.sources import fluent, gettext

HEAD = 'msgid ""\nmsgstr "nplurals=3; PO-Revision-Date: 2024-01-02\\\\n"\n\n'
DOMAIN = HEAD + 'msgid "female^One $x"\nmsgstr "Jedna $x"\n\nmsgid "Two\\n <b>big</b>"\nmsgstr ""\n\n#, fuzzy\nmsgid "Three {name}"\nmsgstr "Trzy"\n\nmsgid "%d day"\nmsgid_plural "%d days"\nmsgstr[0] "dzien"\nmsgstr[1] "dni"\nmsgstr[2] "%d dni"\n\n#: a.c:1\nmsgid "Five"\nmsgstr "Piec $new"\n'


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("po")
    for name in ("wesnoth-lib", "wesnoth"):
        (root / f"{name}.po").write_text(DOMAIN.replace("Five", f"Five {name}"))
    return gettext.read(spark, str(root), "*.po").cache()


@pytest.fixture(scope="module")
def made(entries):
    return bilingual.rows(gettext.strings(entries), gettext.header_facts(entries)).cache()


def test_rows(made):
    rows = made.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(10)) and [r.textdomain for r in rows] == ["wesnoth"] * 5 + ["wesnoth-lib"] * 5
    one, two, three, four, five = rows[:5]
    assert (one.msgctxt, one.string_class, one.pool, one.placeholder_check) == ("female", "core/gender_agreement", "eval", "ok")
    assert (two.target_pl, two.target_pl_display, two.pool, two.markup_flags, two.source_en_display) == (None, None, "untranslated", ["newline", "pango"], "Two\n <b>big</b>")
    assert three.fuzzy and three.pool == "untranslated" and three.placeholder_check == "source_only"
    assert four.plural_forms.target_nplurals == 3 and four.plural_forms.target_forms == ["dzien", "dni", "%d dni"] and four.placeholder_check == "ok"
    assert five.placeholder_check == "target_only" and five.source_ref == ["a.c:1"] and one.source_ref is None
    assert one.neighbours.prev is None and one.neighbours.next == two.segment_id and five.neighbours.next is None and rows[5].neighbours.prev is None


def test_a_good_bundle_has_no_problems(made, entries):
    assert bilingual.verify(made).collect() == [] and bilingual.gate(entries, gettext.header_facts(entries)).collect() == []


@pytest.mark.parametrize("column,value,problem", [("segment_id", "'wesnoth:000000000000'", "segment_id"), ("source_en_display", "'?'", "source_display"), ("target_pl", "''", "target_empty"), ("pool", "'reference'", "pool"), ("pool", "'eval'", "pool_eval"), ("placeholder_check", "'fine'", "placeholder_check"), ("string_class", "'ui'", "string_class"), ("markup_flags", "array('html')", "markup_flags"), ("seq", "seq + 1", "seq"), ("neighbours", "named_struct('prev', 'x', 'next', 'y')", "neighbours"), ("source_en", "concat(source_en, '!')", "segment_id")])
def test_mutations_are_found(made, column, value, problem):
    assert problem in {r.problem for r in bilingual.verify(made.withColumn(column, F.expr(value))).collect()}


def test_structural_gate(spark, tmp_path):
    (tmp_path / "a.po").write_text('msgid "x"\nmsgid_plural "xs"\n\nmsgid "y"\nmsgstr "z"\n')
    rows = gettext.read(spark, str(tmp_path))
    assert {r.rule for r in bilingual.gate(rows, gettext.header_facts(rows)).collect()} == {"bundle.no_header", "bundle.no_nplurals", "bundle.plural_without_forms"}


def _manifest(digest, n):
    return artifact.manifest("demo", "pl", {"remote": "https://example.org/x.git", "commit": "a" * 40, "branch": "main"}, {"wesnoth": "2024"}, ["wesnoth-lib", "wesnoth"], digest, n, "2024-01-01T00:00:00Z")


def test_export_is_stable(made, tmp_path):
    out = made.drop("msgctxt_raw")
    a = artifact.export(out, tmp_path / "a", bilingual.verify(made), _manifest)
    artifact.export(out.repartition(7), tmp_path / "b", bilingual.verify(made), _manifest)
    data = (tmp_path / "a" / artifact.LINES).read_bytes()
    assert data == (tmp_path / "b" / artifact.LINES).read_bytes() and a["content_hash"]["value"] == hashlib.sha256(data).hexdigest()
    assert artifact.check(tmp_path / "a", out) == [] and list(a) == list(artifact.MANIFEST)
    first = json.loads(data.split(b"\n")[0])
    assert list(first)[:3] == ["segment_id", "seq", "textdomain"] and first["char_limit"] is None and len(first) == 20
    artifact.write_parts(out, str(tmp_path / "parts"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "parts").glob("*.txt"))) == data
    (tmp_path / "a" / artifact.LINES).write_bytes(data.replace(b"Jedna", b"Jeden"))
    assert "built anew it differs from line 1 on" in artifact.check(tmp_path / "a", out)


def test_a_bad_bundle_is_refused(made, tmp_path):
    bad = made.withColumn("pool", F.lit("x"))
    with pytest.raises(ValueError):
        artifact.export(bad, tmp_path / "c", bilingual.verify(bad), _manifest)
    assert not (tmp_path / "c").exists()


def test_payloads():
    assert artifact.payload_problems(b"{}\n") == []
    assert set(artifact.payload_problems(b"\xef\xbb\xbf{}\r\n\n\x00\xff")) == {"byte order mark", "CR", "NUL", "no final line break", "blank line", "not UTF-8"}
    assert artifact.read_lines(b'{"a":1}\n[]\n{\n') == ([{"a": 1}], [2, 3])
    assert artifact.first_difference(b"a\nb", b"a\nc") == 2 and artifact.first_difference(b"a", b"a") is None


def test_manifests():
    data = b"{}\n"
    good = _manifest(hashlib.sha256(data).hexdigest(), 1)
    assert artifact.manifest_problems(good, {"wesnoth"}, 1, data) == []
    for change in ({"bundle_version": "0.3.0"}, {"line_count": 2}, {"textdomains": ["wesnoth"]}, {"upstream": good["upstream"] | {"commit": "x"}}):
        assert artifact.manifest_problems(good | change, {"wesnoth-lib"}, 1, data)


def test_provenance(tmp_path):
    git = tmp_path / ".git"
    (git / "refs" / "heads").mkdir(parents=True)
    (git / "config").write_text('[remote "origin"]\n\turl = https://example.org/r.git\n')
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text(f"{'b' * 40} refs/heads/main\n")
    assert artifact.provenance(tmp_path) == {"remote": "https://example.org/r.git", "commit": "b" * 40, "branch": "main"}
    (git / "refs" / "heads" / "main").write_text("c" * 40)
    assert artifact.provenance(tmp_path)["commit"] == "c" * 40
    (git / "HEAD").write_text("d" * 40)
    with pytest.raises(artifact.ProvenanceError):
        artifact.provenance(tmp_path)


def test_schema_checker():
    fields = {"a": dict(type="integer", minimum=1), "b": {"$ref": "#/$defs/w"}, "c": dict(type=["string", "null"])}
    s = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": fields, "$defs": {"w": dict(type="array", items={"enum": ["x"]})}}
    assert schema.problems({"a": 1, "b": ["x"], "c": None}, s) == []
    assert len(schema.problems({"a": True, "b": ["y"], "z": 1}, s)) == 3 and schema.problems({}, s) and schema.problems([], s)


FTL = "## Part\nhi = Hello { $user }\n    .desc = { $n ->\n        [one] One\n       *[lots] Many { -brand }\n    }\nvoid = { \"\" }\n"


def test_mono(spark, tmp_path):
    (tmp_path / "b.ftl").write_text(FTL)
    (tmp_path / "a.ftl").write_text("")
    units = fluent.units(fluent.read(spark, str(tmp_path)), True)
    made = mono.rows(units)
    rows = made.orderBy("seq").collect()
    assert [(r.seq, r.native_ref.id, r.native_ref.attr) for r in rows] == [(1, "hi", None), (2, "hi", "desc"), (3, "void", None)] and rows[0].context.section == "Part" and rows[0].context.comment is None
    assert [(p.token, p.kind, p.origin) for p in rows[1].placeholders] == [("{ $n ->", "selector", "spec"), ("[one]", "selector", "spec"), ("*[lots]", "selector", "unknown"), ("{ -brand }", "term-ref", "spec"), ("}", "selector", "spec")]
    assert (rows[2].empty, rows[2].empty_reason) == (True, mono.BLANK) and rows[0].empty is None and rows[0].empty_reason is None
    index = mono.files_index(made, spark.createDataFrame([("a.ftl",), ("b.ftl",)], "file string"))
    assert sorted(tuple(r) for r in index.collect()) == [("a.ftl", 0, "utf-8"), ("b.ftl", 3, "utf-8")]
    assert mono.verify(made, index).collect() == []
    moved = fluent.units(fluent.read(spark, str(tmp_path)).withColumn("line", F.col("line") + 9), True)
    assert {r.line_id for r in mono.rows(moved).collect()} == {r.line_id for r in rows}


def test_mono_leaves_absent_values_out(spark, tmp_path):
    (tmp_path / "a.ftl").write_text("### All\n# about the box\nbox =\n    .desc = words { TAIL($x) } { FOO() }\n    .none =\n# more\nlid = { \"\" }\nplain = text\n")
    units = fluent.units(fluent.read(spark, str(tmp_path)), True)
    made = mono.rows(units)
    rows = made.orderBy("seq").collect()
    assert [(r.seq, r.key, r.native_ref.attr, r.source_text) for r in rows] == [(1, "box", "desc", "words { TAIL($x) } { FOO() }"), (2, "lid", None, '{ "" }'), (3, "plain", None, "text")]
    assert [(p.kind, p.origin, p.detail) for p in rows[0].placeholders] == [("function", "project", "TAIL"), ("function", "unknown", "FOO")]
    assert rows[0].context.asDict() == {"comment": "about the box", "section": "All"} and rows[2].context.asDict() == {"comment": None, "section": "All"}
    stats = {(r.what, r.name): r.n for r in mono.statistics(made, units).collect()}
    want = {"rows": 3, "placeholders": 3, "empty": 1, "with_context": 3, "with_section": 3, "with_comment": 2, "skipped_absent_value": 1, "skipped_absent_attr": 1, "fully_masked_empty": 1, "role_other": None, "fully_masked_nonempty": None}
    assert {k: stats.get(("unit", k)) for k in want} == want and stats["origin", "unknown"] == 1


def test_mono_problems(spark, tmp_path):
    (tmp_path / "b.ftl").write_text(FTL)
    made = mono.rows(fluent.units(fluent.read(spark, str(tmp_path)), True))
    found = lambda df, index=None: {r.problem for r in mono.verify(df, index).collect()}
    each = lambda **change: made.withColumn("placeholders", F.transform("placeholders", lambda p: p.withField(*next(iter(change.items())))))
    assert {"slice", "bounds"} <= found(made.withColumn("placeholders", F.transform("placeholders", lambda p: p.withField("end", p["end"] + 1))))
    assert "origin" in found(each(origin=F.lit("format"))) and "kind" in found(each(kind=F.lit("thing"))) and "span" in found(each(detail=F.lit(""))) and "shape" in found(each(token=F.lit("x")))
    assert found(made.withColumn("placeholders", F.slice("placeholders", 1, 0))) == {"leak"}
    assert found(made.withColumn("empty", F.lit(None).cast("boolean"))) == {"empty_reason"} and found(made.withColumn("line_no", F.lit(0))) == {"line_no"}
    assert found(made.withColumn("file", F.lit(None).cast("string"))) == {"no file"} and found(made.withColumn("structural_role", F.lit(""))) == {"structural_role"}
    assert found(made.unionByName(made)) == {"duplicate_id", "seq"} and found(made.withColumn("line_id", F.reverse("line_id"))) == {"line_id"}
    index = spark.createDataFrame([("a.ftl", 0, "utf-8"), ("b.ftl", 9, "utf-8")], "path string, line_count long, encoding string")
    assert found(made, index) == {"count of b.ftl"} and found(made, index.where("path = 'a.ftl'")) == {"not in files: b.ftl"}
    assert mono.verify(made.limit(0), index.limit(0)).collect() == []


def test_mono_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.ftl").write_text(FTL)
    units = fluent.units(fluent.read(spark, str(tmp_path / "in")), True)
    made = mono.rows(units)
    index, stats = mono.files_index(made, units), mono.statistics(made, units)
    make = lambda digest, n: mono.manifest("demo-1", "Demo (en)", "en", "tests", index, stats, digest, n)
    a = artifact.export(made, tmp_path / "a", mono.verify(made, index), make, bare=mono.bare)
    artifact.export(made.repartition(5), tmp_path / "b", mono.verify(made, index), make, bare=mono.bare)
    data = (tmp_path / "a" / artifact.LINES).read_bytes()
    assert data == (tmp_path / "b" / artifact.LINES).read_bytes() and (tmp_path / "a" / "manifest.json").read_bytes() == (tmp_path / "b" / "manifest.json").read_bytes()
    assert mono.check(tmp_path / "a", made) == [] and a["files"] == [{"path": "b.ftl", "line_count": 3, "encoding": "utf-8"}] and "produced_at" not in a
    rows, bad = artifact.read_lines(data)
    assert not bad and list(rows[0]) == "line_id seq native_ref file line_no key source_text placeholders structural_role context".split()
    assert rows[0]["native_ref"] == {"kind": "message", "id": "hi", "attr": None} and rows[0]["context"] == {"section": "Part"} and "detail" not in rows[1]["placeholders"][-1] and rows[2]["empty"] is True
    digest = hashlib.sha256(data).hexdigest()
    for change, problem in (({"bundle_version": "0.2.0"}, "wrong bundle_version"), ({"source_id": "Demo"}, "wrong source_id"), ({"line_count": 2}, "wrong line_count"), ({"files": []}, "wrong files"), ({"content_hash": {}}, "wrong content_hash.value")):
        assert problem in mono.manifest_problems(a | change, 3, digest)
    assert mono.manifest_problems({k: v for k, v in a.items() if k != "files"}, 3, digest) == ["lacks files", "wrong files"]
    assert mono.key_problems(rows[0] | {"more": 1}) == ["has more"] and "lacks seq" in mono.key_problems({k: v for k, v in rows[0].items() if k != "seq"}) and mono.key_problems(rows[0] | {"context": "Part"}) == ["wrong context"]
    (tmp_path / "a" / artifact.LINES).write_bytes(data.replace(b"Hello", b"Hallo"))
    assert {"built anew it differs from line 1 on", "wrong content_hash.value"} <= set(mono.check(tmp_path / "a", made))


def test_pairs(spark, tmp_path):
    src = HEAD + "".join(f'msgid "{m}"\n{p}msgstr ""\n\n' for m, p in (("Go $x", ""), ("Keep {n}", ""), ("%d a", 'msgid_plural "%d as"\n'), ("Tag", "")))
    tgt = HEAD + 'msgid "Go $x"\nmsgstr "Idz $y"\n\nmsgid "Keep {n}"\nmsgstr "Zostaw %s"\n\nmsgid "%d a"\nmsgid_plural "%d as"\nmsgstr[0] "jeden"\nmsgstr[1] "%d"\n\nmsgid "Tag"\nmsgstr "<b>x"\n\nmsgid "Old"\nmsgstr "Stary"\n'
    (tmp_path / "s.po").write_text(src)
    (tmp_path / "t.po").write_text(tgt)
    a, b = (gettext.read(spark, str(tmp_path), f"{x}.po", domain="d") for x in "st")
    found = sorted((r.rule, r.form_idx, r.detail) for r in O.crosslocale(gettext.strings(a), gettext.strings(b), gettext.header_facts(b)).fillna("").fillna(-1).collect())
    assert found == [("po.pair.dropped", 0, "$x"), ("po.pair.dropped", 0, "{n}"), ("po.pair.invented", 0, "$y"), ("po.pair.markup.unclosed", 0, "b"), ("po.pair.orphan", -1, ""), ("po.pair.plural_arity", -1, "2"), ("po.pair.printf_extra", 0, "%sx1")]


def test_numbers_are_dense(spark):
    rnd = random.Random(3)
    rows = spark.createDataFrame([(rnd.choice("abc"), i) for i in range(200)], "g string, o int").repartition(9)
    got = common.numbered(rows, "g", ["o"]).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(200)) and [(r.g, r.o) for r in got] == sorted((r.g, r.o) for r in got)


def _largest(spark, df):
    """Rows of the fullest partition, of how many; what Spark puts together afterwards doesn't count."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(F.xxhash64(*df.columns))).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return max(sizes), sum(sizes)


def _around(rows, group, order, value):
    rows = sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in (group, *order)])
    same = lambda a, b: rows[b][value] if 0 <= b < len(rows) and rows[a][group] == rows[b][group] else None
    return [(n, r[group], r[order[0]], r[value], same(n, n - 1), same(n, n + 1)) for n, r in enumerate(rows)]


@pytest.mark.parametrize("runs,drawn", [(512, 4096), (7, 40), (3, 3), (1, 5)])
def test_numbers_and_neighbours_over_runs(spark, monkeypatch, runs, drawn):
    monkeypatch.setattr(common, "RUNS", runs, raising=False)
    monkeypatch.setattr(common, "DRAWN", drawn, raising=False)
    rnd = random.Random(5)
    orders = [None, *rnd.sample(range(10**12), 149), *range(50)]
    rows = spark.createDataFrame([(rnd.choice(["a", "b", "b", "b", None]), o, rnd.choice([None, f"v{o}"])) for o in orders], "g string, o long, v string").repartition(5)
    want = _around(rows.collect(), "g", ["o"], "v")
    assert sorted((r.seq, r.g, r.o, r.v, r.prev, r.next) for r in common.numbered(common.neighbours(rows, "g", ["o"], "v"), "g", ["o"]).collect()) == want
    assert common.numbered(rows.limit(0), "g", ["o"]).collect() == [] and common.neighbours(rows.limit(0), "g", ["o"], "v").columns == ["g", "o", "v", "prev", "next"]


def test_a_large_group_is_not_one_task(spark):
    rows = spark.range(4000).select(F.lit("a").alias("g"), F.col("id").alias("o"), F.col("id").cast("string").alias("v"))
    for made in (common.numbered(rows, "g", ["o"]), common.neighbours(rows, "g", ["o"], "v")):
        most, of = _largest(spark, made)
        assert of == 4000 and most < 2000


@pytest.fixture(scope="module")
def long_file(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("long")
    for name, n in (("wesnoth", 60), ("wesnoth-lib", 3)):
        (root / f"{name}.po").write_text(HEAD + "".join(f'msgid "Text {i}"\nmsgstr "Tekst {i}"\n\n' for i in range(n)))
    entries = gettext.read(spark, str(root), "*.po")
    return bilingual.rows(gettext.strings(entries), gettext.header_facts(entries)).cache()


@pytest.mark.parametrize("change,bad", [
    ("seq", []), ("seq * 1000", []), ("-seq", range(63)), ("if(seq = 5, null, seq)", [0, 4, 5, 6]), ("if(seq in (7, 8), 15 - seq, seq)", [6, 7, 8, 9]), ("if(seq in (3, 4), 7 - seq, seq)", [2, 3, 4, 5]), ("if(seq = 59, -1, seq)", [0, 58, 59]), ("if(seq = 5, 1000, seq)", [4, 5, 6, 59]),
])
def test_neighbours_are_compared_over_runs(long_file, monkeypatch, change, bad):
    monkeypatch.setattr(bilingual, "RUN", 4, raising=False)
    changed = long_file.select("*", F.col("seq").alias("was")).withColumn("seq", F.expr(change))
    rows = changed.collect()
    want = []
    for file in {r.file for r in rows}:
        line = sorted((r for r in rows if r.file == file), key=lambda r: (r.seq is not None, r.seq, r.was))
        ids = [None, *(r.segment_id for r in line), None]
        want += [r.segment_id for k, r in enumerate(line) if (r.neighbours.prev, r.neighbours.next) != (ids[k], ids[k + 2])]
    got = sorted(r.segment_id for r in bilingual.verify(changed).where("problem = 'neighbours'").collect())
    assert got == sorted(want) == sorted(r.segment_id for r in rows if r.was in bad)


def test_a_large_file_is_not_checked_by_one_task(spark, long_file, monkeypatch):
    monkeypatch.setattr(bilingual, "RUN", 4, raising=False)
    bad = long_file.withColumn("neighbours", F.expr("named_struct('prev', 'x', 'next', 'y')"))
    most, of = _largest(spark, bilingual.verify(bad).where("problem = 'neighbours'"))
    assert of == 63 and most < 40


def test_small_tools(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert sorted((r.k, r.change) for r in common.changed(a, b, ["k"], "v").collect()) == [(1, "removed"), (2, "changed"), (4, "added")]
    assert common.over_limit(spark.createDataFrame([("abc", 2), ("abc", 3), ("abc", None)], "t string, n int"), "t", "n").count() == 1
