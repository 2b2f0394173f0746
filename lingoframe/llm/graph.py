"""Connected components by alternating large-star and small-star passes over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoframe.llm.shared import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, root): every node that has an edge to another, with the smallest node of its component.

    Edges are undirected; nulls, loops and repeated edges are ignored; no edges give no rows. Each pass hangs the larger
    (then the smaller) neighbours of a node onto its smallest one, so the number of passes grows with the logarithm of
    the longest chain and a huge component is never gathered in one place. Each pass is written to the shared folder.
    """
    u, v = F.greatest(F.col(src), F.col(dst)).alias("u"), F.least(F.col(src), F.col(dst)).alias("v")
    now = written(edges.where(F.col(src) != F.col(dst)).select(u, v).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionAll(floor.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
