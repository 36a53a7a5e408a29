"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.session import scratch, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the corpus, by whatever store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores appended until no column has it (upper and lower case are one)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def portions(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches, whose bytes Spark bounds, in parts of so many rows at most."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """At a task's end: memory that Arrow keeps for later goes back to the system, since a worker that idles counts like a busy one."""
    pa.default_memory_pool().release_unused()


def by_text(docs: DataFrame, prepare: Callable[[], Callable[[str | None], tuple]], fields: str, finish: Callable[[], None] = give_back) -> DataFrame:
    """doc_id and the fields ("name type, ...") that a function gives for each whole text. prepare() makes that function once
    for each task, and finish() is called at its end. One pass without a shuffle; doc_id goes through as it is, null or not."""
    ship(docs.sparkSession)
    names = ["doc_id", *(part.split()[0] for part in fields.split(", "))]
    schema = f"doc_id long, {fields}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = prepare()
        for batch in batches:
            found = [of(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), *map(list, zip(*found))] if found else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        finish()

    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}[part.split()[1]] for part in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Paths of the innermost open discarding(); each thread has its own.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def materialize(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, and the rows outlive lost executors. batch_rows: rows of an Arrow
    batch in this job; the session's setting is put back."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    if (scope := _scope.get()) is not None:
        scope.append(path)
    before = spark.conf.get(ARROW_ROWS)
    try:
        if batch_rows:
            spark.conf.set(ARROW_ROWS, batch_rows)
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*made: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing reads any more."""
    for df in made:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if folder.rsplit("/", 1)[-1].startswith("table-"):
                _delete(df.sparkSession, folder)


@contextmanager
def discarding(spark: SparkSession):
    """Deletes at its end whatever materialize() wrote inside; what outlives it must be written by another name or outside."""
    made: list[str] = []
    outer = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(outer)
        for path in made:
            _delete(spark, path)


def union_components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) long edges: (node, root), root the smallest node reachable; isolated nodes are left out.

    Each round every node points at its smallest neighbour, pointers are followed to their ends by doubling, and edges are
    rewritten between the ends, so that at most half of the nodes stay. Nodes have one row each, so a hub is one row, and
    skewed joins on it are left to adaptive execution. Every round is written to the shared folder.
    """
    rounds = []
    left = materialize(edges.where("a <> b").select("a", "b"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        points = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")).select(F.col("a").alias("node"), F.col("p").alias("root")))
        points = _follow(points)
        rounds.append(points)
        to = points.select(F.col("node").alias("a"), F.col("root").alias("x"))
        half = left.join(to, "a").select("x", "b")
        moved = half.join(to.select(F.col("a").alias("b"), F.col("x").alias("y")), "b").where("x <> y")
        before, left = left, materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(before)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    whole = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("end"))
        before, whole = whole, materialize(whole.join(step, "root", "left").select("node", F.coalesce("end", "root").alias("root")))
        discard(before, later)
    return whole


def _follow(points: DataFrame) -> DataFrame:
    """Pointer doubling until every node points at an end."""
    while True:
        step = points.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("end"))
        if points.join(step, "root", "left_semi").isEmpty():
            return points
        before, points = points, materialize(points.join(step, "root", "left").select("node", F.coalesce("end", "root").alias("root")))
        discard(before)
