"""The checks of a translation against its source for a format of one's own: which patterns are placeholders, what identifies
an entry, and how its text is shown are parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingoframe.functions.strings import found, shown, sorted_set, surplus
from lingoframe.operators.common import last_of
from lingoframe.operators.findings import finding, together


def crosslocale(source: DataFrame, target: DataFrame, keys: list[str], unit_id: str, named: list[str], counted: str | None = None, display: Callable[[Column], Column] = lambda c: c, problems: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Findings of rules pair.orphan, pair.invented, pair.dropped, pair.counted_extra, and what problems() adds.

    source and target have the keys, text and ord; of repeated keys in the source the last counts. named: patterns compared as
    sets; counted: a pattern of which the target may not have more. Null keys are a key; null or empty targets are
    left out. problems: from (unit_id, text) of the targets to (unit_id, severity, rule, detail).
    """
    names = lambda c: sorted_set(F.concat(*[found(c, p) for p in named]))
    src = last_of(source.select(*keys, "text", "ord"), keys, ["ord"]).select(*[F.col(k).alias(f"lf_{k}") for k in keys], F.col("text").alias("source"), F.lit(True).alias("lf_there"))
    on = [F.col(k).eqNullSafe(F.col(f"lf_{k}")) for k in keys]
    live = target.where(F.coalesce("text", F.lit("")) != "")
    both = live.join(src, on, "left").withColumns({"a": names(display(F.col("source"))), "b": names(F.col("text"))})
    there = both.where("lf_there").withColumns({"invented": F.array_join(F.array_except("b", "a"), ","), "dropped": F.array_join(F.array_except("a", "b"), ",")})
    parts = [
        finding(both.where("lf_there is null"), "ERROR", "pair.orphan", unit_id, line="ord"),
        finding(there.where("invented <> ''"), "ERROR", "pair.invented", unit_id, F.col("invented"), line="ord"),
        finding(there.where("dropped <> ''"), "ERROR", "pair.dropped", unit_id, F.col("dropped"), line="ord"),
    ]
    if counted is not None:
        extra = shown(surplus(found(F.col("text"), counted), found(display(F.col("source")), counted)))
        parts.append(finding(there.withColumn("extra", extra).where("extra <> ''"), "ERROR", "pair.counted_extra", unit_id, F.col("extra"), line="ord"))
    if problems is not None:
        parts.append(finding(problems(live.select(unit_id, "text")), F.col("severity"), F.col("rule"), unit_id, F.col("detail")))
    return together(*parts)
