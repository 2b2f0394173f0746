"""Sessions for local use, and getting this package to the executors."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session on this machine with the settings that the tests and the bench use."""
    paths = os.environ.get("PYTHONPATH", "")
    if str(ROOT) not in paths.split(":"):
        os.environ["PYTHONPATH"] = f"{ROOT}:{paths}"
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": cores if cores.isdigit() else "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.appName("lingoframe").config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, where their Python can't import it already."""
    context = spark.sparkContext
    if getattr(context, "_lingoframe_shipped", False):
        return
    context._lingoframe_shipped = True
    if context.parallelize([0], 1).mapPartitions(_importable_rows()).first():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((ROOT / "lingoframe").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    # The driver serves the file to the executors from Spark's own folder there.
    target = Path(context._temp_dir) / f"lingoframe-{uuid.uuid4().hex}.zip"
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))


def _importable_rows():
    # A closure, so that it is sent by value: the executors may not have this module.
    def rows(_):
        import importlib.util

        return iter([importlib.util.find_spec("lingoframe") is not None])

    return rows
