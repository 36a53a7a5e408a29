"""Files of the shared store, through Hadoop's file system: whatever Spark can read. Only names and small texts pass the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _open(spark: SparkSession, path: str):
    """(file system, path) of a path."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _open(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """A file or a folder with all it has; nothing if there is none."""
    fs, at = _open(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder has, in order; nothing if there is none."""
    fs, at = _open(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def move(spark: SparkSession, old: str, new: str, replace: bool = False) -> None:
    """Rename in one step. Without replace the new path must not exist; with it, a file there is replaced at once."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    given = gateway.new_array(options, 1)
    given[0] = options.valueOf("OVERWRITE" if replace else "NONE")
    fs, source = _open(spark, old)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(source).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(source), fs.makeQualified(_open(spark, new)[1]), given)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text, visible only once it is whole."""
    draft = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    fs, at = _open(spark, draft)
    out = fs.create(at)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    move(spark, draft, path, replace=True)


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text, None if there is none."""
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if exists(spark, path) else None


def files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, size_bytes) of a folder's files at any depth. Their contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return listed.select("path", F.col("length").alias("size_bytes"))
