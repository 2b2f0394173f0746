"""Longest-processing-time scheduling of groups onto shards.

Groups that must stay together are taken in the order of size, largest first, and each goes to the least-loaded shard,
popped from a heap. The schedule depends on the groups only through how many there are of each size, so the driver needs
the histogram of sizes, not the groups: it has at most sqrt(2 x total size) entries. Within one size the heap's pops are
written out until all loads lie within that size of each other; from then on they repeat in a fixed cycle, which is
stored once. The groups then find their shard by their rank among those of their size.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoframe.llm.shared import running, written

SHARDS = 64


def schedule(sizes: list[int], counts: list[int], shards: int = SHARDS) -> tuple[list[tuple[int, list[int], list[int]]], list[int]]:
    """For each size, given in falling order: the shards its first groups go to, and the cycle that the others follow;
    and the final loads. Ties of load go to the lower shard number."""
    if shards < 1:
        raise ValueError("there must be a shard")
    heap = [(0, s) for s in range(shards)]
    top, rows = 0, []
    for size, count in zip(sizes, counts):
        if not size:  # they add no load: the heap would give all of them to one shard
            rows.append((0, [], [s for _, s in sorted(heap)]))
            continue
        first: list[int] = []
        while len(first) < count and top - heap[0][0] >= size:
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            first.append(shard)
            top = max(top, load + size)
        left = count - len(first)
        cycle: list[int] = []
        if left:
            order = sorted(heap)
            cycle = [s for _, s in order[:left]]
            rounds, rest = divmod(left, shards)
            heap = [(load + size * (rounds + (i < rest)), s) for i, (load, s) in enumerate(order)]
            heapq.heapify(heap)
            top = max(load for load, _ in heap)
        rows.append((size, first, cycle))
    loads = [0] * shards
    for load, s in heap:
        loads[s] = load
    return rows, loads


def assign(df: DataFrame, group_col: str, size_col: str, shards: int = SHARDS) -> DataFrame:
    """Add group_size and shard (int) to the rows of df, all rows of a group on one shard.

    Groups of one size are taken in the order of their keys. Rows of a null group are each a group of their own, in the
    order of their size only (any two of one size may change places). A null or negative size counts as 0; groups of size
    0 are dealt out in turn. Repeated rows are placed alike if they have a group. An empty table gives an empty table;
    columns of any names pass, but those named group_size or shard are replaced.
    """
    names = [c for c in df.columns if c.lower() not in ("group_size", "shard")]
    size = F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)), F.lit(0))
    rows = written(df.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in names]).alias("row"), F.col(f"`{group_col}`").alias("g"), size.alias("s")), "lpt-rows")
    groups = rows.where("g is not null").groupBy("g").agg(F.sum("s").alias("size"))
    groups = written(groups, "lpt-groups")
    alone = rows.where("g is null")
    histogram = groups.select("size").unionAll(alone.select("s")).groupBy("size").count().toPandas().sort_values("size", ascending=False)
    plan, _ = schedule(histogram["size"].tolist(), histogram["count"].tolist(), shards)
    table = df.sparkSession.createDataFrame(pd.DataFrame(plan, columns=["size", "first", "cycle"]), "size long, first array<int>, cycle array<int>")
    start = F.size("first")
    shard = F.when(F.col("n") < start, F.get("first", F.col("n"))).otherwise(F.get("cycle", (F.col("n") - start) % F.greatest(F.size("cycle"), F.lit(1))))
    keyed = groups.select("size", "g", F.lit(None).cast(alone.schema["row"].dataType).alias("row"))
    # Of the groups of one size each has its rank by key, those without a key last.
    every = keyed.unionAll(alone.select(F.col("s").alias("size"), "g", "row")).withColumn("one", F.lit(1))
    both = running(every, "size", ["g"], "one", "n").join(table, "size").withColumn("shard", shard.cast("int"))
    both = written(both.select("g", "row", F.col("size").alias("group_size"), "shard"), "lpt-placed")
    together = rows.where("g is not null").select("row", "g").join(both.where("g is not null").drop("row"), "g")
    single = both.where("g is null").select("row", "g", "group_size", "shard")
    return together.select("row", "g", "group_size", "shard").unionAll(single).select("row.*", "group_size", "shard")
