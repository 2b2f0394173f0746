"""Merkle fixity audit of WARC replicas.

Every record's bytes are hashed; records lie at offsets in their files, and a file's offset axis is cut into equal
ranges. The digest of a range is the hash of its records' (offset, digest) in order, a node covers `fanout` ranges, and
so on up to one root a file, then over files up to one root a replica. An audit compares the two roots and then, level
by level, only the children of nodes that differ, until it holds the records that were damaged, lost or added. Ranges
are cut by offset and not by count, so a lost record changes its own branch only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingoframe.llm.shared import running, written

FANOUT = 16
#: Bytes of a lowest range.
RANGE_BYTES = 1 << 16
#: Records of one WARC file.
FILE_RECORDS = 1000


def warc_block(url: Column, record_id: Column, html: Column) -> Column:
    """A WARC/1.1 response record; nulls count as empty."""
    html, url = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    head = [F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n")]
    return F.concat(*head, html, F.lit("\r\n\r\n"))


def warc_records(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """One row a record: file, page_id, start, length, digest. Files hold runs of page ids; within a file records follow each
    other by page_id, then digest (so the order of repeated ids is defined). Pages of a null id form the file -1. The bytes
    are read and hashed once; a file of any size is spread over tasks."""
    block = warc_block(F.col("url"), F.col("page_id"), F.col("html"))
    file = F.coalesce(F.floor(F.col("page_id") / F.lit(file_records)).cast("long"), F.lit(-1).cast("long"))
    rows = written(pages.select(file.alias("file"), "page_id", F.octet_length(block).cast("long").alias("length"), F.sha2(block, 256).alias("digest")), "records")
    return running(rows, "file", ["page_id", "digest", "length"], "length", "start").select("file", "page_id", "start", "length", "digest")


def _folded(parts: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """Hash of the values of each key, in order: one row a node, whose number of children the fan-out bounds."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order), value.alias("v"))))
    return parts.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["v"]), ";"), 256).alias("digest"))


def merkle_levels(records: DataFrame, range_bytes: int, fanout: int, within: int, across: int, by: list[str] | None = None) -> list[DataFrame]:
    """The nodes (file, node, digest) of each level, lowest first: ranges of a file, nodes of a file, nodes over files. by: columns
    that tell several trees apart, whose levels are then made and written together."""
    by = by or []
    leaf = records.withColumn("node", F.floor(F.col("start") / F.lit(range_bytes)).cast("long"))
    value = F.concat_ws(":", F.col("start").cast("string"), F.col("length").cast("string"), F.col("digest"))
    levels = [written(_folded(leaf, [*by, "file", "node"], "start", value), "merkle")]
    child = F.concat_ws(":", F.col("child").cast("string"), F.col("digest"))
    for up in ["node"] * within + ["file"] * across:
        parent = F.floor(F.col(up) / F.lit(fanout)).cast("long")
        below = levels[-1].withColumn("child", F.col(up)).withColumn(up, parent)
        levels.append(written(_folded(below, [*by, "file", "node"], "child", child), "merkle"))
    return levels


def _height(n: int, fanout: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records of two replicas (file, page_id, start, length, digest) that differ: file, start, page_id, length, expected, found, status.

    status: 'corrupt' (both have a record at that offset, with different bytes), 'missing' or 'extra'; expected and found
    are the digests, null where there is no record. Replicas that agree give no rows. An empty replica leaves all records
    of the other missing or extra. Records of the same file and offset pair off by digest order; columns beyond the five
    are ignored. Both manifests are written to the shared folder once (about a hundred bytes a record) and every level is
    read from there; the only figures that reach the driver are the largest file number and range.
    """
    names = ["file", "page_id", "start", "length", "digest"]
    both = written(primary.select(*names, F.lit(False).alias("theirs")).unionAll(replica.select(*names, F.lit(True).alias("theirs"))), "manifests")
    most = both.agg(F.max("start"), F.max("file")).first()
    within, across = _height((most[0] or 0) // range_bytes + 1, fanout), _height(max((most[1] or 0) + 1, 1), fanout)
    levels = merkle_levels(both, range_bytes, fanout, within, across, ["theirs"])
    suspects = None
    side = lambda of, c: F.max(F.when(F.col("theirs") == F.lit(of), F.col(c)))
    for depth in reversed(range(len(levels))):
        nodes = levels[depth] if suspects is None else _under(levels[depth], suspects, fanout, depth >= within)
        pairs = nodes.groupBy("file", "node").agg(side(False, "digest").alias("mine"), side(True, "digest").alias("other"))
        suspects = written(pairs.where(~F.col("mine").eqNullSafe(F.col("other"))).select("file", "node"), "branches")
    rows = both.withColumn("node", F.floor(F.col("start") / F.lit(range_bytes)).cast("long")).join(suspects, ["file", "node"], "left_semi")
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("theirs", "file", "start").orderBy("length", "digest")))
    rows = rows.withColumn("record", F.struct("page_id", "length", "digest"))
    pairs = rows.groupBy("file", "start", "turn").agg(side(False, "record").alias("a"), side(True, "record").alias("b"))
    pairs = pairs.where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    return pairs.select(
        "file",
        "start",
        F.when(F.col("a").isNotNull(), F.col("a.page_id")).otherwise(F.col("b.page_id")).alias("page_id"),
        F.coalesce("a.length", "b.length").alias("length"),
        F.col("a.digest").alias("expected"),
        F.col("b.digest").alias("found"),
        status.alias("status"),
    )


def _under(nodes: DataFrame, parents: DataFrame, fanout: int, across: bool) -> DataFrame:
    """The nodes of a level whose parent differs."""
    up = parents.select(F.col("file").alias("pf"), F.col("node").alias("pn"))
    file = F.floor(F.col("file") / F.lit(fanout)).cast("long") if across else F.col("file")
    node = F.col("node") if across else F.floor(F.col("node") / F.lit(fanout)).cast("long")
    return nodes.join(up, (file == F.col("pf")) & (node == F.col("pn")), "left_semi")


def damaged(records: DataFrame, pages: DataFrame) -> DataFrame:
    """A replica of records for a drill, with about 1 of 128 page ids lost and 1 of 128 with other bytes, chosen by the ids' hashes.

    The bytes of all its records are hashed anew from the pages, and nothing of the primary's digests is taken over; offsets
    are those of the index, as in a file whose blocks went bad in place. Records of one id pair off with its pages by digest,
    so repeated rows stay repeated; null ids are neither lost nor harmed; no pages give no records.
    """
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    html = F.when(mark.isin("07", "70"), F.concat(F.coalesce("html", F.lit("")), F.lit("?"))).otherwise(F.col("html"))
    there = ~F.coalesce(mark.isin("0d", "d0"), F.lit(False))
    fresh = written(pages.where(there).select(F.col("page_id").alias("id"), F.sha2(warc_block(F.col("url"), F.col("page_id"), html), 256).alias("now"), F.lit(1).alias("one")), "replica")
    fresh = running(fresh, "id", ["now"], "one", "at")
    kept = running(records.where(there).withColumn("one", F.lit(1)), "page_id", ["digest", "start"], "one", "turn")
    both = kept.join(fresh.select("id", "now", "at"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("turn") == F.col("at")))
    return both.select("file", "page_id", "start", "length", F.col("now").alias("digest"))
