"""An extension: files that arrive in a folder are read as a stream and audited as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lingoframe.functions.clausewitz import COLOURS, PROBES
from lingoframe.operators.common import probes
from lingoframe.sources import clausewitz, files


def arriving(spark: SparkSession, folder: str, glob: str = "*.yml") -> DataFrame:
    """(file, text) of new files, whole."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(folder)
    return raw.select(files.relative(F.col("path"), folder).alias("file"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "").alias("text"))


def audited(batch: DataFrame) -> DataFrame:
    """(file, name, n) of drift in a batch of whole files. Windows run within a file, so a batch is enough."""
    entries = clausewitz.entries(clausewitz.parsed(files.lines(batch)))
    hits = probes(entries, "value", (*PROBES, ("unknown-color", f"§[A-Za-z&&[^{COLOURS}]]")), ["file"])
    return hits.groupBy("file", "name").agg(F.count("*").alias("n"))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write audits of what arrives to Parquet until all that is there is done; a batch that is repeated replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        audited(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key in windows of event time, late rows within the watermark included."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
