"""Reading, shaping and writing tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basinflow.schemas import schema as declared


def read_raw(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A raw table by its declared schema, whatever order its files' columns have."""
    return conform(spark.read.parquet(path), declared(name))


def read_seed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV with a header; types are given, so keys such as 01010000 keep their zeros."""
    return spark.read.csv(path, header=True, schema=schema)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def conform(df: DataFrame, schema: StructType, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Known columns, renamed and cast; missing ones null; the rest dropped."""
    source = {new: old for old, new in (renames or {}).items() if old in df.columns}
    present = {f.name: source.get(f.name, f.name) for f in schema.fields}
    return df.select(*[(F.col(f"`{present[f.name]}`") if present[f.name] in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def unpack_series(df: DataFrame, variables: Iterable[str], keys: Iterable[str] = ("longitude", "latitude")) -> DataFrame:
    """Rows from one array for each variable between start and end (exclusive), step seconds apart. Variables that are no column
    are left out; null or empty arrays give no rows; a shorter array ends in nulls."""
    variables = [v for v in variables if v in df.columns]
    rows = df.select(*keys, "start", "end", "step", F.posexplode(F.arrays_zip(*variables)).alias("pos", "values"))
    at = F.col("start") + F.col("pos") * F.col("step")
    return rows.where(at < F.col("end")).select(*keys, F.timestamp_seconds(at).alias("datetime"), *[F.col("values")[v].alias(v) for v in variables])


def flatten_features(df: DataFrame, fields: Iterable[str], column: str = "features") -> DataFrame:
    """One row for each feature, with fields of its properties; absent ones null."""
    rows = df.select(F.explode(column).alias("feature"))
    known = set(rows.select("feature.properties.*").columns)
    return rows.select(*[(F.col(f"feature.properties.{f}") if f in known else F.lit(None).cast("string")).alias(f) for f in fields])


#: Holds the text of what does not parse by the schema.
CORRUPT = "_corrupt_record"


def read_landed_json(spark: SparkSession, path: str, schema: StructType, whole_files: bool = False) -> DataFrame:
    """Landed responses by a declared schema, one in each line (blank ones aside), or one in each file over any number of lines. What
    is no JSON or does not fit has its text in CORRUPT; fields that a response lacks are null. Folders named key=value give columns.
    Texts are parsed with the whole schema whatever is read later, so that what counts as malformed does not depend on it."""
    texts = spark.read.text(path, wholetext=whole_files)
    if not whole_files:
        texts = texts.where(F.trim("value") != "")
    kept = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = texts.withColumn("parsed", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    corrupt = F.when(F.col("parsed").isNull(), F.col("value")).otherwise(F.col(f"parsed.{CORRUPT}"))
    folders = [c for c in texts.columns if c != "value"]
    return parsed.select(*folders, *[F.col(f"parsed.{f.name}").alias(f.name) for f in schema.fields], corrupt.alias(CORRUPT))


def well_formed(landed: DataFrame) -> DataFrame:
    return landed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def malformed(landed: DataFrame) -> DataFrame:
    return landed.where(F.col(CORRUPT).isNotNull())


def landed_features(landed: DataFrame, fields: Iterable[str]) -> DataFrame:
    """One row for each feature of the well-formed collections, with what their folders say; empty collections give none."""
    rows = well_formed(landed)
    kept = [c for c in rows.columns if c not in ("type", "features")]
    return rows.select(*kept, F.explode("features").alias("feature")).select(*kept, *[F.col(f"feature.properties.{f}").alias(f) for f in fields])


def landed_series(landed: DataFrame, variables: Iterable[str], keys: Iterable[str] = ("longitude", "latitude")) -> DataFrame:
    """Rows of the well-formed responses' hourly blocks; a response without a block, or with one that names no time, gives none. A
    variable that a response lacks is null in its rows, as long as another one has values."""
    rows = well_formed(landed)
    blocks = rows.select(*keys, "hourly.start", "hourly.end", "hourly.step", *[F.col(f"hourly.{v}").alias(v) for v in variables])
    longest = F.greatest(F.lit(0), *[F.coalesce(F.size(v), F.lit(0)) for v in variables])
    filled = {v: F.coalesce(v, F.array_repeat(F.lit(None).cast(blocks.schema[v].dataType.elementType), longest)) for v in variables}
    return unpack_series(blocks.withColumns(filled), variables, keys)


def bucketed(df: DataFrame, name: str, by: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """A stored table whose files are dealt out by the hash of some columns and sorted by them, so that joins and groups by these
    need no shuffle. Tables to be joined need equal numbers of buckets. Rows are dealt out first: one file for each bucket."""
    writer = df.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def union_batches(batches: Iterable[DataFrame]) -> DataFrame:
    """All rows by column name; columns that a batch lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def with_extracted_at(df: DataFrame, at) -> DataFrame:
    return df.withColumn("extracted_at", F.lit(at))


def replace_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """The whole table anew, in the warehouse or at a path."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def ensure_table(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """The table, made empty with this schema if it wasn't there."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.saveAsTable(name)
    return spark.table(name)


def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def list_tables(spark: SparkSession, database: str = "default") -> list[str]:
    return [t.name for t in spark.catalog.listTables(database)]


def materialize_model(df: DataFrame, name: str, as_table: bool, path: str | None = None) -> DataFrame:
    """A view for staging layers, a stored table for marts."""
    if as_table:
        replace_table(df, name, path)
    else:
        df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def write_snapshot(df: DataFrame, path: str, by: Iterable[str] = ()) -> None:
    """Parquet in a new directory, one folder for each value of `by`."""
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)


def sample_sites(df: DataFrame, n: int, key: str = "site_id") -> DataFrame:
    """The first n by key: smoke runs always take the same ones."""
    return df.orderBy(key).limit(n)
