"""What the operators of this subpackage share: the cluster's folder, written tables, and passes over text columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points that one numpy pass holds at a time (a longer text is a pass of its own).
SLAB_CHARS = 1 << 20
#: The same where a code point takes many bytes on the way; its arrays fit the processor's cache.
NARROW_CHARS = 1 << 18
#: Bytes of rows that Spark's JVM puts into one Arrow batch, and its setting for that.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, else the context's checkpoint folder, else, where driver and executors
    are one process (as in tests), one made here. A cluster that names none is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="lingoframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and tells the optimizer its real size."""
    path = f"{shared_folder(df.sparkSession)}/lingoframe-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of `value` over the rows before each within its group, in the order of some columns (nulls last; rows that
    agree in all of them stand in any order). Ranges of (group, order) are summed by themselves and moved by the sums of those
    before them, so that a group of any size is spread over tasks."""
    by = [F.col(c).asc_nulls_last() for c in [*order, "lf_tie"]]
    ranges = df.withColumn("lf_tie", F.monotonically_increasing_id()).repartitionByRange(F.col(group).asc_nulls_last(), *by)
    ranges = written(ranges.withColumn("lf_part", F.spark_partition_id()), "ranges")
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy(F.col(group).alias("lf_group"), "lf_part").agg(F.sum(value).alias("lf_sum"))
    starts = sums.select("lf_group", F.col("lf_part").alias("lf_of"), F.coalesce(F.sum("lf_sum").over(before("lf_group").orderBy("lf_part")), F.lit(0)).alias("lf_start"))
    inside = F.coalesce(F.sum(value).over(before(group, "lf_part").orderBy(*by)), F.lit(0))
    both = ranges.withColumn("lf_inside", inside).join(starts, F.col(group).eqNullSafe(F.col("lf_group")) & (F.col("lf_part") == F.col("lf_of")))
    return both.withColumn(name, F.col("lf_inside") + F.col("lf_start")).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)


def slabs(column: pa.Array, limit: int = SLAB_CHARS) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of rows of at most `limit` code points together, or one row, with their texts: no more than these are Python's at a time."""
    lengths = pc.utf8_length(column.cast(pa.string()) if pa.types.is_null(column.type) else column)
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(lengths, 0).to_pylist()):
        if i > start and held + n > limit:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n
    if start < len(column):
        yield start, len(column), column.slice(start).to_pylist()


def small_batches(spark: SparkSession) -> None:
    """Have the session make Arrow batches of BATCH_BYTES, unless it was told a size: by rows alone, a batch of long texts takes
    tens of megabytes in each task, in the JVM (outside its heap) and in Python."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def map_texts(df: DataFrame, text_col: str, fields: list[tuple[str, T.DataType, pa.DataType]], make: Callable[[], Callable[[list[str | None]], list]], keep: list[str] | None = None, limit: int = SLAB_CHARS) -> DataFrame:
    """Add columns computed by slabs of texts. make() gives, once per task, a function from texts to one sequence for each field.

    keep: the columns that stay (all by default). A column of df that has the name of a new one is replaced by it.
    """
    new = {name.lower() for name, _, _ in fields}
    stay = [f for f in df.schema.fields if f.name.lower() not in new and (keep is None or f.name in keep)]
    names = [f.name for f in stay]
    schema = T.StructType(stay + [T.StructField(name, kind) for name, kind, _ in fields])
    # The Arrow functions take no names with dots, so columns go by number.
    source = df.select(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate([*names, text_col])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            *kept, last = batch.columns
            for a, b, texts in slabs(last, limit):
                made = apply(texts)
                columns = [c.slice(a, b - a) for c in kept] + [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, kind) for x, (_, _, kind) in zip(made, fields)]
                yield pa.RecordBatch.from_arrays(columns, names=names + [n for n, _, _ in fields])

    return source.mapInArrow(run, schema)


def kept(df: DataFrame, judge: Callable[[DataFrame], DataFrame], made: tuple[str, ...]) -> DataFrame:
    """The rows of df that judge() marks with keep, in df's own columns, of which those named like what judge() makes stand aside."""
    aside = {c: f"lf_aside_{k}" for k, c in enumerate(df.columns) if c.lower() in made}
    marked = judge(df.withColumnsRenamed(aside)).where("keep")
    return marked.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in df.columns])
