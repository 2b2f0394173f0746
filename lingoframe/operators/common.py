"""What the tools of several formats share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingoframe.functions.strings import found

#: Rows are numbered in so many runs of keys at most, parted by bounds from so many keys.
RUNS, DRAWN = 512, 4096


def last_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. Nulls are a key of their own; one shuffle by the keys, with partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("lf_row"))
    return best.select(*keys, *[F.col(f"lf_row.{c}").alias(c) for c in rest]).select(*df.columns)


def tokens(df: DataFrame, text: str, classes: tuple[tuple[str, str], ...], keep: list[str]) -> DataFrame:
    """(keep, cls, token) for every match of every class: one pass over the rows, no self-union."""
    per = F.array(*[F.struct(F.lit(n).alias("cls"), found(F.col(text), p).alias("tokens")) for n, p in classes])
    rows = df.select(*keep, F.inline(per))
    return rows.select(*keep, "cls", F.explode("tokens").alias("token"))


def inventory(found_: DataFrame, keys: list[str], entry: str, order: Column) -> DataFrame:
    """Occurrences, entries with one, and the first entry, of each key."""
    return found_.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.countDistinct(entry).alias("entries"), F.min_by(F.col(entry), order).alias("first_seen"))


def examples(found_: DataFrame, keys: list[str], value: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    turn = Window.partitionBy(*keys).orderBy(*order)
    return found_.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= n).select(*keys, "turn", value)


def probes(df: DataFrame, text: str, classes: tuple[tuple[str, str], ...], keep: list[str]) -> DataFrame:
    """(keep, name) for every row and every probe that it meets."""
    hits = F.array_compact(F.array(*[F.when(F.regexp_like(F.col(text), F.lit(p)), F.lit(n)) for n, p in classes]))
    return df.select(*keep, F.explode(hits).alias("name"))


def duplicates(df: DataFrame, key: str, place: str) -> DataFrame:
    """Keys that stand more than once, with their places."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(place)).alias("places")).where("n > 1")


def _in_runs(df: DataFrame, key: Column) -> DataFrame:
    """Add lf_run: which of at most RUNS intervals of keys, of about as many rows each, the row is in; the numbers are dense from 0. The
    bounds are taken from the DRAWN keys of the least hashes, so that they are the same whenever they are computed."""
    drawn = df.select(key.alias("lf_key")).orderBy(F.xxhash64("lf_key"), "lf_key").limit(DRAWN).agg(F.sort_array(F.collect_set("lf_key")).alias("lf_keys"))
    every = F.ceil(F.size("lf_keys") / RUNS)
    bounds = drawn.select(F.filter("lf_keys", lambda _, i: i % every == 0))
    steps = F.array(*[F.lit(1 << n) for n in reversed(range((RUNS - 1).bit_length()))])
    # The last bound that the key isn't below, by bisection; keys below all go with the first.
    place = lambda k: F.aggregate(steps, F.lit(0), lambda i, s: i + F.when(F.get("lf_bounds", i + s) <= k, s).otherwise(F.lit(0)))
    return df.withColumn("lf_bounds", bounds.scalar()).withColumn("lf_run", F.get(F.transform(F.array(key), place), F.lit(0))).drop("lf_bounds")


def numbered(df: DataFrame, group: str, order: list[str], name: str = "seq", start: int = 0, value: str | None = None) -> DataFrame:
    """A dense number over all rows, by group and then order. value: also add prev and next, its neighbours within the group.
    Rows are numbered within runs of keys, however large a group is; only what a run holds and has at its ends (a row a run)
    goes through one partition."""
    near = [] if value is None else [value]
    rows = _in_runs(df, F.struct(group, *order)).withColumn("lf_item", F.struct(F.col(group).alias("g"), *[F.col(c).alias("v") for c in near]))
    line, runs = Window.partitionBy("lf_run").orderBy(group, *order, *near), Window.orderBy("lf_run")
    ends = [f("lf_item", F.struct(group, *order, *near)).alias(n) for f, n in ((F.min_by, "lf_first"), (F.max_by, "lf_last"))] if near else []
    around = [F.lag("lf_last").over(runs).alias("prev"), F.lead("lf_first").over(runs).alias("next")] if near else []
    before = F.coalesce(F.sum("lf_n").over(runs.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    each = rows.groupBy("lf_run").agg(F.count("*").alias("lf_n"), *ends).select(F.struct("lf_run", before, *around).alias("lf_each"))
    each = each.agg(F.sort_array(F.collect_list("lf_each")))
    out = rows.withColumn("lf_turn", F.row_number().over(line))
    for side, f in (("prev", F.lag), ("next", F.lead)) if near else ():
        out = out.withColumn(f"lf_{side}", f("lf_item").over(line))
    out = out.withColumn("lf_ends", F.get(each.scalar(), "lf_run"))
    added = {name: F.col("lf_ends.before") + F.col("lf_turn") - 1 + start}
    for side in ("prev", "next") if near else ():
        item = F.coalesce(f"lf_{side}", f"lf_ends.{side}")
        added[side] = F.when(item["g"].eqNullSafe(F.col(group)), item["v"])
    return out.withColumns(added).select(*dict.fromkeys([*df.columns, *added]))


def neighbours(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Add prev and next, null at the ends of a group."""
    return numbered(df, group, order, "lf_seq", value=value).drop("lf_seq")


def changed(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Units added, removed or with another value between two deliveries."""
    a, b = before.select(*keys, F.col(value).alias("old")), after.select(*keys, F.col(value).alias("new"))
    a, b = a.withColumn("in_old", F.lit(True)), b.withColumn("in_new", F.lit(True))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
    both = a.join(b, keys, "full_outer").where(F.col("in_old").isNull() | F.col("in_new").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
    return both.select(*keys, kind.alias("change"), "old", "new")


def inconsistent(df: DataFrame, source: str, target: str) -> DataFrame:
    """Sources with more than one translation."""
    return df.groupBy(source).agg(F.countDistinct(target).alias("targets"), F.count("*").alias("n")).where("targets > 1")


def over_limit(df: DataFrame, text: str, limit: str) -> DataFrame:
    """Rows whose text is longer than their limit; no limit, no row."""
    return df.where(F.length(text) > F.col(limit))
