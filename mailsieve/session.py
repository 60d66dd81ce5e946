"""Sessions: the settings the engine expects, and how its code reaches Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitted session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("mailsieve")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        # rules cost time per row, not per byte: small inputs are to use every core too
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers that don't find it by themselves: it is added to the session
    as a zip, once. Nothing is done where the path or the working directory already has it."""
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [Path.cwd()]
    context = spark.sparkContext
    if ROOT in paths or any("mailsieve" in str(f) for f in context._python_includes):
        return
    folder = tempfile.mkdtemp(prefix="mailsieve-")
    context.addPyFile(shutil.make_archive(f"{folder}/mailsieve", "zip", ROOT, "mailsieve"))
