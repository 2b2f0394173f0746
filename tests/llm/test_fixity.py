import hashlib

from pyspark.sql import functions as F

from lingoframe.llm import fixity

PAGES = "page_id long, url string, html string"


def pages(spark, n=400):
    rows = [(i, f"https://h/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, PAGES)


def slow(a, b):
    """All records of two manifests that differ, by a plain comparison."""
    left = {(r.file, r.start): r for r in a.collect()}
    right = {(r.file, r.start): r for r in b.collect()}
    out = set()
    for k in left.keys() | right.keys():
        x, y = left.get(k), right.get(k)
        if x and y and x.digest != y.digest:
            out.add((*k, "corrupt"))
        elif not (x and y):
            out.add((*k, "missing" if x else "extra"))
    return out


def found(rows):
    return {(r.file, r.start, r.status) for r in rows.collect()}


def test_records_are_those_of_the_format(spark):
    r = fixity.warc_records(pages(spark, 3)).orderBy("page_id").collect()
    block = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: https://h/1\r\nContent-Length: 8\r\n\r\n<p>1</p>\r\n\r\n"
    assert r[1].digest == hashlib.sha256(block.encode()).hexdigest() and r[1].length == len(block)
    assert [x.start for x in r] == [0, r[0].length, r[0].length + r[1].length]


def test_damage_is_found_as_by_comparing_everything(spark):
    good = fixity.warc_records(pages(spark), 50).cache()
    bad = good.where("page_id not in (3, 120)").withColumn("digest", F.when(F.col("page_id").isin(7, 8, 399), F.lit("f" * 64)).otherwise(F.col("digest")))
    more = spark.createDataFrame([(99, 5, 0, 10, "e" * 64)], bad.schema)
    bad = bad.unionByName(more)
    for range_bytes, fanout in ((256, 2), (1 << 16, 16)):
        assert found(fixity.audit(good, bad, range_bytes, fanout)) == slow(good, bad)
    assert len(slow(good, bad)) == 6


def test_same_replicas_and_empty_ones(spark):
    good = fixity.warc_records(pages(spark, 60), 20).withColumn("extra", F.lit(1))
    none = good.limit(0)
    assert fixity.audit(good, good).collect() == []
    assert fixity.audit(none, none).collect() == []
    assert {s for *_, s in found(fixity.audit(good, none))} == {"missing"} and fixity.audit(none, good).count() == 60


def test_nulls_and_repeated_pages(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "u", None), (2, "u", ""), (None, None, None), (3, "u", "long " * 100_000)]
    good = fixity.warc_records(spark.createDataFrame(rows, PAGES))
    got = good.collect()
    assert len(got) == 6 and {r.file for r in got} == {0, -1}
    assert len({(r.file, r.start) for r in got}) == 6
    bad = good.withColumn("digest", F.when(F.col("page_id") == 3, F.lit("0")).otherwise(F.col("digest")))
    assert [(r.page_id, r.status) for r in fixity.audit(good, bad).collect()] == [(3, "corrupt")]


def test_drill(spark):
    p = pages(spark)
    good = fixity.warc_records(p, 50)
    bad = fixity.damaged(good, p)
    got = found(fixity.audit(good, bad))
    assert got == slow(good, bad) and {s for *_, s in got} == {"corrupt", "missing"}


def test_replica_takes_no_digest_of_the_primary(spark):
    p = pages(spark)
    good = fixity.warc_records(p, 50)
    blind = fixity.damaged(good.withColumn("digest", F.lit("none")), p)
    assert sorted(blind.collect()) == sorted(fixity.damaged(good, p).collect()) and blind.count() > 300
    twice = p.unionByName(p.limit(30)).unionByName(p.limit(3).withColumn("page_id", F.lit(None).cast("long")))
    records = fixity.warc_records(twice, 50)
    same = fixity.damaged(records, twice).where("page_id is null or substr(md5(cast(page_id as string)), 1, 2) not in ('07', '70')")
    assert same.exceptAll(records).count() == 0 and same.where("page_id is null").count() == 3
