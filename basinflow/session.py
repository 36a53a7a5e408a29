"""Session defaults, and the package on the executors."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: Hour and day truncation, and every comparison of zoned and naive times, assume UTC.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
#: What Python workers and their executors hold of a table at a time.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def build(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Before Python stages: this package on the executors, once for each application, through Spark's own file server, and Arrow
    batches of at most BATCH_BYTES. Spark reads that setting when a plan runs, so it stays set for the session."""
    kept = re.fullmatch(r"(\d+)b?", spark.conf.get(ARROW_BYTES))
    if not kept or int(kept[1]) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    name = "basinflow_package"
    if any(name in str(path) for path in spark.sparkContext._python_includes):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{name}", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only one machine's own session (local[...]) may do without: a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
