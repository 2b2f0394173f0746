"""Files that arrive in a folder are audited once each."""

from lingoframe.streaming import watch


def test_watch(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_l_english.yml").write_text('l_english:\n k:0 "§Zodd§! {x}"\n')
    watch.watch(spark, inbox, out, mark).awaitTermination()
    (tmp_path / "in" / "b_l_english.yml").write_text('l_english:\n k:0 "fine §Yx§!"\n j:0 "bad \\q"\n')
    watch.watch(spark, inbox, out, mark).awaitTermination()
    got = sorted((r.file, r.name, r.n) for r in spark.read.parquet(out).collect())
    assert got == [("a_l_english.yml", "curly-brace", 1), ("a_l_english.yml", "unknown-color", 1), ("b_l_english.yml", "other-escape", 1)]
